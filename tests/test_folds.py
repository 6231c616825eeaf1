import math
import random

from pyspark.sql import functions as F

from tracewell.operators import feedback, folds
from tracewell.streaming import state


def signals(n, seed):
    rng = random.Random(seed)
    names = ["cache_hit", "success", "inject_pollution", "prefetch_hit", "prefetch_waste", "other", None]
    value = lambda: rng.choice([rng.random(), 1.0, 0.0, -3.0, 7.0, math.nan, math.inf, None])
    return [(rng.choice(["a", "b", "c"]), i, i - rng.choice([0, 0, 0, 5]), rng.choices(names, [5, 4, seed % 3, 3, 3, 1, 1])[0], value()) for i in range(n)]


def engine_by_hand(events):
    """The engine's rules one after the other, over plain variables."""
    m = dict.fromkeys(("hit", "pol", "pre", "waste"), 0.0)
    n = last = until = 0
    tau, conf = 0.55, 0.5
    for epoch, name, v in events:
        if v is None or math.isnan(v) or math.isinf(v) or epoch < last:
            continue
        last, n = epoch, n + 1
        v = 0.0 if v < 0 else 1.0 if v > 1 else v
        if name in ("cache_hit", "success"):
            m["hit"] = 0.1 * v + 0.9 * m["hit"]
        elif name == "inject_pollution":
            m["pol"] = 0.1 * v + 0.9 * m["pol"]
        elif name == "prefetch_hit":
            m["pre"], m["waste"] = 0.1 * v + 0.9 * m["pre"], 0.9 * m["waste"]
        elif name == "prefetch_waste":
            m["waste"], m["pre"] = 0.1 * v + 0.9 * m["waste"], 0.9 * m["pre"]
        else:
            continue
        if n < 20 or last < 60:
            continue
        if last >= until:
            old = tau
            if m["pol"] >= 0.10:
                tau = min(0.80, tau + 0.05)
            elif m["hit"] >= 0.70 and m["pol"] <= 0.05:
                tau = max(0.30, tau - 0.05)
            if tau != old:
                until = last + 60
        if m["waste"] > m["pre"]:
            conf = min(0.95, conf + 0.05)
        elif m["pre"] > m["waste"]:
            conf = max(0.05, conf - 0.05)
    return (n, *(round(x, 6) for x in (m["hit"], m["pol"], m["pre"], m["waste"], tau, conf)))


def test_engine_follows_its_rules(spark):
    moved = set()
    for seed in range(4):
        rows = signals(900, seed)
        df = spark.createDataFrame(rows, "key string, o int, epoch long, name string, v double").repartition(3)
        got = {r.key: tuple(r)[1:] for r in feedback.evolve(df, "key", ["o"]).collect()}
        assert got == {k: engine_by_hand([r[2:] for r in rows if r[0] == k]) for k in "abc"}
        moved |= {(r[5] > 0.55) - (r[5] < 0.55) for r in got.values()}
    assert len(moved) > 1


def entry_by_hand(bad, prior):
    mean, good, ill, frozen, tau, relaxed, moves = 0.0, 0, 0, 0, 0.0, False, 0
    for x in bad:
        mean = 0.9 * mean + (0.1 if x else 0.0)
        good, ill = good + (not x), ill + bool(x)
        if frozen:
            frozen -= 1
            continue
        if good + ill < 20:
            continue
        base = new = tau if tau > 0 else prior
        if mean > 0.05:
            new = min(0.8, max(0.3, base + 0.02))
        elif mean < 0.025 and good >= 20:
            new = min(0.8, max(0.3, base - 0.02))
        if new != base:
            relaxed, tau, frozen, moves = mean <= 0.05, new, 60, moves + 1
    return round(mean, 6), good, ill, round(prior if tau <= 0 or (relaxed and good < 5) else tau, 6), moves


def test_thresholds_follow_their_rules(spark):
    rng = random.Random(8)
    rows = [(k, i, rng.random() < p) for k, p in (("a", 0.3), ("b", 0.01), ("c", 0.05), (None, 0.5)) for i in range(400)]
    got = {r.k: tuple(r)[1:] for r in feedback.adaptive_tau(spark.createDataFrame(rows, "k string, i int, bad boolean").repartition(5), "k", ["i"], "bad").collect()}
    assert got == {k: entry_by_hand([x for key, _, x in rows if key == k], 0.55) for k in ("a", "b", "c", None)}


def test_a_long_history_is_passed_by(spark):
    """One key has all events: they come in batches, and one state is held."""
    rows = spark.range(60_000).select(F.lit("k").alias("k"), "id", (F.col("id") % 40 == 0).alias("bad"))
    assert "collect_list" not in feedback.adaptive_tau(rows, "k", ["id"], "bad")._jdf.queryExecution().toString()
    (r,) = feedback.adaptive_tau(rows, "k", ["id"], "bad").collect()
    assert tuple(r)[1:] == entry_by_hand([i % 40 == 0 for i in range(60_000)], 0.55)


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = signals(240, 1)
    schema = "key string, o int, epoch long, name string, v double"
    for i in range(3):
        spark.createDataFrame(rows[80 * i : 80 * i + 80], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = []

    def run():
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = state.folded(events, "key", ["o"], folds.ENGINE).writeStream.outputMode("update").foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c"))
        q.trigger(availableNow=True).start().awaitTermination(180)

    try:
        run()
        late = signals(300, 1)[240:]  # the query starts again with the states it had
        spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last = {}
    for r in out:
        last[r.key] = tuple(r)[1:]
    want = {r.key: tuple(r)[1:] for r in feedback.evolve(spark.createDataFrame(rows + late, schema), "key", ["o"]).collect()}
    assert last == want and len(out) > 3
