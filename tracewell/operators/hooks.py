"""Calls to what is outside of Spark (models, judges, executors), which fail softly: each row has ok, value and error.

A hook takes an Arrow batch of its input columns and gives a value for each row. Where it raises, or gives another number
of values, the batch's rows are tried alone, so one bad row doesn't cost the others theirs. A value that its check
refuses is a failure like any other. Rows whose call failed have the fallback's value, and say why.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

Hook = Callable[[pa.RecordBatch], Sequence[Any]]
#: Says what is wrong with a value for a row, if anything is.
Check = Callable[[Any, dict], str | None]
#: Characters of an error that are kept.
TOLD = 200


def called(rows: DataFrame, inputs: Sequence[str], hook: Hook, kind: str, check: Check | None = None, when: Column | None = None, fallback: Column | None = None) -> DataFrame:
    """Adds ok, value (of the type `kind`) and error to rows.

    Where `when` is given and doesn't hold, the hook isn't called: ok is false, the error `not called`. fallback is a
    column of rows, by default null. No rows call nothing.
    """
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(f"_go boolean, ok boolean, value {kind}, error string").fields])
    given = rows.withColumn("_go", F.coalesce(F.lit(True) if when is None else when, F.lit(False)))
    value_type = to_arrow_type(schema["value"].dataType)

    def one(batch: pa.RecordBatch) -> tuple[bool, Any, str | None]:
        try:
            values = hook(batch)
            if len(values) != 1:
                raise ValueError(f"{len(values)} values for 1 row")
            return judged(values[0], batch.to_pylist()[0])
        except Exception as e:  # noqa: BLE001 - whatever an outside call raises is a failure of its row
            return False, None, f"{type(e).__name__}: {e}"[:TOLD]

    def judged(value: Any, row: dict) -> tuple[bool, Any, str | None]:
        wrong = check(value, row) if check else None
        pa.array([value], value_type)  # a value of another type is refused here
        return (False, None, wrong[:TOLD]) if wrong else (True, value, None)

    def tried(batch: pa.RecordBatch) -> list[tuple[bool, Any, str | None]]:
        try:
            values = hook(batch)
            if len(values) != batch.num_rows:
                raise ValueError(f"{len(values)} values for {batch.num_rows} rows")
            return [judged(v, row) for v, row in zip(values, batch.to_pylist(), strict=True)]
        except Exception:  # noqa: BLE001
            return [one(batch.slice(i, 1)) for i in range(batch.num_rows)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            go = batch.column("_go").to_pylist()
            asked = batch.select(list(inputs)).filter(pa.array(go))
            answers = iter(tried(asked) if asked.num_rows else [])
            out = [next(answers) if g else (False, None, "not called") for g in go]
            ok, values, errors = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok, pa.bool_()), pa.array(values, value_type), pa.array(errors, pa.string())], names=schema.names)

    done = given.mapInArrow(run, schema).drop("_go")
    return done if fallback is None else done.withColumn("value", F.when(F.col("ok"), F.col("value")).otherwise(fallback.cast(schema["value"].dataType)))


def embedded(rows: DataFrame, text: str, model: Callable[[list[str]], Sequence[Sequence[float]]], dim: int, fallback: Column | None = None) -> DataFrame:
    """Adds a model's vectors of texts (null: empty) as value; one of another length, not finite or all zero is a failure."""

    def check(v: Any, _: dict) -> str | None:
        if len(v) != dim:
            return f"{len(v)} dimensions instead of {dim}"
        return None if all(map(math.isfinite, v)) and any(v) else "a vector that isn't finite, or zero"

    return called(rows, [text], lambda b: [list(map(float, v)) for v in model([x or "" for x in b.column(0).to_pylist()])], "array<double>", check, fallback=fallback)


def verdicts(pairs: DataFrame, query: str, content: str, judge: Callable[[str, str], Any], when: Column | None = None) -> DataFrame:
    """Adds verdict to pairs: yes, no, or error where the judge failed or said something else, which isn't an approval; null where it wasn't asked."""
    check = lambda v, _: None if v in ("yes", "no") else f"no verdict: {v!r}"
    out = called(pairs, [query, content], lambda b: [judge(*x) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)], "string", check, when)
    return out.withColumn("verdict", F.when(F.col("ok"), F.col("value")).when(F.col("error") != "not called", "error")).drop("ok", "value", "error")


def executed(calls: DataFrame, tool: str, arguments: str, run: Callable[[str, str], str], read_only: Column) -> DataFrame:
    """Adds the outputs of calls ahead of time as value; only calls that are read-only are made."""
    return called(calls, [tool, arguments], lambda b: [run(*x) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)], "string", when=read_only)


def reranked(hits: DataFrame, scorer: Callable[[Any, list[dict]], Sequence[tuple[Any, float]]], most: int = 20, k: int = 5, shown: Sequence[str] = ()) -> DataFrame:
    """(query_id, doc_id, score, rank, reranked): the best `most` hits of each query scored anew, the k best of them.

    scorer gets a query_id and its hits, dicts of doc_id and the columns `shown`, and gives (doc_id, score) pairs. They are
    taken only as a whole: an unknown id, one twice, one missing or a score that isn't finite leaves the query in its
    order. Scores are clamped to 0..1; ties go by doc_id. A query with one hit isn't asked. hits has query_id,
    doc_id, score, rank.
    """
    most = max(most, k)
    top = hits.filter(F.col("rank") <= most)
    groups = top.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*dict.fromkeys(("rank", "doc_id", "score", *shown))))).alias("hits"))  # `most` at most
    id_kind = dict(hits.dtypes)["doc_id"]

    def hook(batch: pa.RecordBatch) -> list[list[dict]]:
        out = []
        for q, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            given = scorer(q, [{"doc_id": h["doc_id"]} | {c: h[c] for c in shown} for h in found])
            out.append([{"doc_id": i, "score": float(s)} for i, s in given])
        return out

    def check(value: list[dict], row: dict) -> str | None:
        known, got = {h["doc_id"] for h in row["hits"]}, [x["doc_id"] for x in value]
        if odd := [i for i in got if i not in known]:
            return f"unknown id {odd[0]!r}"
        if len(set(got)) < len(got):
            return "an id twice"
        if len(got) < len(known):
            return "an id is missing"
        return None if all(math.isfinite(x["score"]) for x in value) else "a score that isn't finite"

    done = called(groups, ["query_id", "hits"], hook, f"array<struct<doc_id:{id_kind},score:double>>", check, F.size("hits") > 1)
    scores = F.map_from_entries(F.transform("value", lambda x: F.struct(x["doc_id"], F.least(F.greatest(x["score"], F.lit(0.0)), F.lit(1.0)))))
    new = F.transform("hits", lambda h: F.struct((-scores[h["doc_id"]]).alias("by"), h["doc_id"].alias("doc_id"), scores[h["doc_id"]].alias("score")))
    old = F.transform("hits", lambda h: F.struct(h["rank"].cast("double").alias("by"), h["doc_id"].alias("doc_id"), h["score"].cast("double").alias("score")))
    ordered = F.slice(F.sort_array(F.when(F.col("ok"), new).otherwise(old)), 1, k)
    out = done.select("query_id", F.col("ok").alias("reranked"), F.posexplode(ordered).alias("at", "h"))
    return out.select("query_id", "h.doc_id", "h.score", (F.col("at") + 1).alias("rank"), "reranked")
