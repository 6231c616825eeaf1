"""States that branch, event by event: one step function for a batch over all events and for a stream.

In a batch, events are dealt out by key and sorted; a task passes them by and holds one key's state. A key's history is
never gathered, however long it is. `streaming.state.folded` keeps the same states between micro-batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# The engine's rates, steps, bounds and windows.
ALPHA, TAU_STEP, PREFETCH_STEP, MIN_SAMPLES, FREEZE = 0.1, 0.05, 0.05, 20, 60
MIN_TAU, MAX_TAU, START_TAU = 0.30, 0.80, 0.55
MIN_CONFIDENCE, MAX_CONFIDENCE, START_CONFIDENCE = 0.05, 0.95, 0.5
POLLUTION_RISE, POLLUTION_LOW, HIT_TARGET = 0.10, 0.05, 0.70
# An entry's threshold: fixed values.
ADAPT_ALPHA, ADAPT_STEP, ADAPT_BOUND, ADAPT_SAMPLES, ADAPT_FREEZE, ADAPT_HITS = 0.1, 0.02, 0.05, 20, 60, 5


class Fold(NamedTuple):
    """A state (a flat tuple of the schema `state`) that starts at `start`; step(state, *event values) and result(state) are plain functions."""

    columns: tuple[str, ...]
    start: tuple
    state: str
    step: Callable[..., tuple]
    result: Callable[[tuple], tuple]
    out: str


def folded(rows: DataFrame, key: str, order: list[str], fold: Fold) -> DataFrame:
    """(key, the fold's result) of each key's events in an order; a null key is a key."""
    dealt = rows.select(key, *order, *fold.columns).repartition(key).sortWithinPartitions(key, *order)
    kind = dict(dealt.dtypes)[key]
    schema = StructType.fromDDL(f"`{key}` {kind}, {fold.out}")
    names, at = schema.names, 1 + len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        none = object()
        now: Any = none
        state, out = fold.start, []

        def rows_out() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], names=names)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for k, *event in zip(columns[0], *columns[at:], strict=True):
                if k != now or now is none:
                    if now is not none:
                        out.append((now, *fold.result(state)))
                    now, state = k, fold.start
                state = fold.step(state, *event)
            if len(out) > 10_000:
                yield rows_out()
                out = []
        if now is not none:
            out.append((now, *fold.result(state)))
        if out:
            yield rows_out()

    return dealt.mapInArrow(run, schema)


def scanned(rows: DataFrame, key: str, order: list[str], value: str, step: Callable[[Any, Any], Any], out: str) -> DataFrame:
    """(key, order, the state after each event) of a state that starts as None; `out` is its column and type."""
    dealt = rows.select(key, *order, value).repartition(key).sortWithinPartitions(key, *order)
    schema = StructType([*dealt.schema.fields[:-1], *StructType.fromDDL(out).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(schema).field(len(schema) - 1).type
        now, state = object(), None
        for batch in batches:
            found = []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                now, state = k, step(state if k == now else None, x)
                found.append(state)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], names=schema.names)

    return dealt.mapInArrow(run, schema)


class Entry(NamedTuple):
    mean: float
    pos: int
    neg: int
    frozen: int
    tau: float
    relaxed: bool
    n_adjust: int


def _observe(prior: float, state: tuple, negative: bool | None) -> tuple:
    a = Entry(*state)
    mean = (1 - ADAPT_ALPHA) * a.mean + (ADAPT_ALPHA if negative else 0.0)
    a = a._replace(mean=mean, pos=a.pos + (not negative), neg=a.neg + bool(negative))
    if a.frozen:
        return a._replace(frozen=a.frozen - 1)
    if a.pos + a.neg < ADAPT_SAMPLES:
        return a
    up, down = mean > ADAPT_BOUND, mean < ADAPT_BOUND / 2 and a.pos >= ADAPT_SAMPLES
    base = a.tau if a.tau > 0 else prior
    tau = min(max(base + (ADAPT_STEP if up else -ADAPT_STEP if down else 0.0), MIN_TAU), MAX_TAU)
    if tau == base:
        return a
    return a._replace(tau=tau, relaxed=not up, frozen=ADAPT_FREEZE, n_adjust=a.n_adjust + 1)


def _in_effect(prior: float, state: tuple) -> tuple:
    a = Entry(*state)
    tau = prior if a.tau <= 0 or (a.relaxed and a.pos < ADAPT_HITS) else a.tau
    return round(a.mean, 6), a.pos, a.neg, round(tau, 6), a.n_adjust


def adaptive(negative: str, prior: float) -> Fold:
    """An entry's learned threshold: tightened while the mean of negatives is high, relaxed while it is low.

    An adjustment freezes the entry for ADAPT_FREEZE observations, which are counted but don't adjust. A relaxed threshold
    is in effect only after ADAPT_HITS good ones.
    """
    state = "mean double, pos int, neg int, frozen int, tau double, relaxed boolean, n_adjust int"
    out = "neg_ewma double, pos int, neg int, tau_low double, n_adjust int"
    return Fold((negative,), Entry(0.0, 0, 0, 0, 0.0, False, 0), state, partial(_observe, prior), partial(_in_effect, prior), out)


class Engine(NamedTuple):
    hit: float
    pol: float
    pre: float
    waste: float
    n: int
    epoch: int
    until: int
    tau: float
    conf: float


#: Which mean a signal feeds, and which one then fades.
_MEANS = {"cache_hit": ("hit", None), "success": ("hit", None), "inject_pollution": ("pol", None), "prefetch_hit": ("pre", "waste"), "prefetch_waste": ("waste", "pre")}


def _signal(state: tuple, epoch: int | None, name: str | None, value: float | None) -> tuple:
    a = Engine(*state)
    if value is None or not math.isfinite(value) or (epoch is not None and epoch < a.epoch):
        return a
    a = a._replace(n=a.n + 1, epoch=a.epoch if epoch is None else max(a.epoch, epoch))
    if name not in _MEANS:
        return a
    feeds, fades = _MEANS[name]
    a = a._replace(**{feeds: ALPHA * min(max(value, 0.0), 1.0) + (1 - ALPHA) * getattr(a, feeds)})
    if fades:
        a = a._replace(**{fades: (1 - ALPHA) * getattr(a, fades)})
    if a.n < MIN_SAMPLES or a.epoch < FREEZE:
        return a
    if a.epoch >= a.until:
        move = TAU_STEP if a.pol >= POLLUTION_RISE else -TAU_STEP if a.hit >= HIT_TARGET and a.pol <= POLLUTION_LOW else 0.0
        tau = min(max(a.tau + move, MIN_TAU), MAX_TAU)
        if tau != a.tau:
            a = a._replace(tau=tau, until=a.epoch + FREEZE)
    lean = PREFETCH_STEP if a.waste > a.pre else -PREFETCH_STEP if a.pre > a.waste else 0.0
    return a._replace(conf=min(max(a.conf + lean, MIN_CONFIDENCE), MAX_CONFIDENCE))


def _parameters(state: tuple) -> tuple:
    a = Engine(*state)
    return (a.n, *(round(x, 6) for x in (a.hit, a.pol, a.pre, a.waste, a.tau, a.conf)))


#: The engine's parameters after a run of signals (epoch, name, v). Late epochs and values that aren't finite are rejected.
#: After MIN_SAMPLES and the first FREEZE epochs, the threshold moves by pollution and hits, the prefetch confidence by
#: hits and wastes; a threshold that moved is frozen for FREEZE epochs.
ENGINE = Fold(
    ("epoch", "name", "v"),
    Engine(0.0, 0.0, 0.0, 0.0, 0, 0, 0, START_TAU, START_CONFIDENCE),
    "hit double, pol double, pre double, waste double, n long, epoch long, until long, tau double, conf double",
    _signal,
    _parameters,
    "n long, hit double, pol double, pre double, waste double, tau double, conf double",
)
