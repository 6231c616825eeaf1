"""Structured Streaming forms: keyed feedback state, tailed logs, windows with watermarks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracewell.operators import feedback as B
from tracewell.operators.folds import Fold
from tracewell.sources import readers


def _fold(events: DataFrame, key: str, order: list[str], value: str, out: str, state: str, start: tuple, step, result) -> DataFrame:
    """Folds each key's events into its state in order within a batch, and emits the state after each batch."""

    def run(k: tuple[Any], batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else start
        rows = pd.concat(list(batches)).sort_values(order)
        for v in rows[value]:
            now = step(now, v)
        held.update(now)
        yield pd.DataFrame([(k[0], *result(now))], columns=[c.split()[0] for c in out.split(", ")])

    return events.groupBy(key).applyInPandasWithState(run, out, state, "update", GroupStateTimeout.NoTimeout)


def ewma(events: DataFrame, key: str, order: list[str], value: str, kind: str = "long", alpha: float = B.ALPHA) -> DataFrame:
    """Exponential means by key, event by event: what feedback.ewma folds in a batch."""
    return _fold(events, key, order, value, f"{key} {kind}, ewma double, n long", "ewma double, n long", (0.0, 0), lambda s, v: ((1 - alpha) * s[0] + alpha * v, s[1] + 1), lambda s: (round(s[0], 9), s[1]))


def beta(events: DataFrame, key: str, order: list[str], hit: str, kind: str = "string") -> DataFrame:
    """Decayed hits and wastes and their posterior mean by key."""
    d = B.POSTERIOR_DECAY
    return _fold(events, key, order, hit, f"{key} {kind}, hits double, wastes double, mean double", "h double, w double", (0.0, 0.0), lambda s, v: (d * s[0] + bool(v), d * s[1] + (not v)), lambda s: (round(s[0], 6), round(s[1], 6), round((s[0] + 1) / (s[0] + s[1] + 2), 6)))


def quota(events: DataFrame, key: str, order: list[str], tokens: str, kind: str = "long") -> DataFrame:
    """Tokens used so far by key: a meter that only grows."""
    return _fold(events, key, order, tokens, f"{key} {kind}, used long", "used long", (0,), lambda s, v: (s[0] + int(v),), lambda s: s)


class _Kept(StatefulProcessor):
    """A fold's state of a key in the state store; emits its result after each micro-batch in which the key has events."""

    def __init__(self, fold: Fold, key: str, order: list[str]):
        self.fold, self.key, self.order = fold, key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.fold.state)

    def handleInputRows(self, key: tuple[Any], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = tuple(self.state.get()) if self.state.exists() else self.fold.start
        events = pd.concat(list(rows)).sort_values(self.order)
        columns = [events[c].astype(object).where(events[c].notna(), None) for c in self.fold.columns]
        for event in zip(*columns, strict=True):
            now = self.fold.step(now, *event)
        self.state.update(tuple(now))
        yield pd.DataFrame([(key[0], *self.fold.result(now))], columns=[self.key, *(c.split()[0] for c in self.fold.out.split(", "))])


def folded(events: DataFrame, key: str, order: list[str], fold: Fold) -> DataFrame:
    """A stream's form of `folds.folded`: the same states, held between micro-batches; needs the RocksDB state store.

    Events of a micro-batch are taken in order. What comes late in a later one is taken then, and the fold decides: the
    engine rejects epochs before its own.
    """
    kind = dict(events.dtypes)[key]
    return events.groupBy(key).transformWithStateInPandas(_Kept(fold, key, order), f"{key} {kind}, {fold.out}", "Update", "None")


def tail_usage(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """A stream of a usage log's new files; each file counts once, by the query's checkpoint."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_a_batch).text(folder)
    parsed = lines.filter(F.trim("value") != "").withColumn("j", F.from_json("value", readers.USAGE)).filter("j.session_id is not null")
    return parsed.select("j.*")


def rollup_stream(usage: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Sums by day, provider and model over a stream; days older than the watermark are closed."""
    at = F.timestamp_seconds(F.col("at"))
    rows = usage.withColumn("ts", at).withWatermark("ts", lateness)
    return rows.groupBy(F.window("ts", "1 day").alias("w"), "provider", "model").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "provider", "model", "tokens_in", "tokens_out", "n")


def windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """An extension: tumbling or sliding windows over (ts, event_type, value)."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return rows.groupBy(F.window("ts", width, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def upserts(stream: DataFrame, path: str, checkpoint: str, merge):
    """A query that merges each batch into a table by `merge(batch, epoch)`; a batch that is run again is told by its epoch."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).option("path", path)


def false_hits(requests: DataFrame, threshold: float = 0.6, idle: str = "1 hour") -> DataFrame:
    """Requests (session, seq, ts, query, l3_reuse) much like the session's last one that a cache answered.

    A remembered reuse is consumed by the next request; a session that is idle for that long by event time is forgotten.
    """

    def like(a: str, b: str) -> float:
        if max(len(a), len(b)) > 2048:
            return 0.0
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return 1 - row[-1] / max(len(a), len(b), 1)

    millis = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(k: tuple[Any], batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        before, out, rows = held.get[0] if held.exists else None, [], pd.concat(list(batches)).sort_values("seq")
        for r in rows.itertuples():
            if before is not None and (score := like(before, r.query)) >= threshold:
                out.append((k[0], r.seq, round(score, 6)))
            before = r.query if r.l3_reuse else None
        held.update((before,))
        held.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), held.getCurrentWatermarkMs()) + millis)
        yield pd.DataFrame(out, columns=["session", "seq", "likeness"])

    seen = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", idle)
    return seen.groupBy("session").applyInPandasWithState(run, "session long, seq long, likeness double", "before string", "append", GroupStateTimeout.EventTimeTimeout)
