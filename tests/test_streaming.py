import json

from pyspark.sql import functions as F

from tracewell.operators import feedback as B
from tracewell.streaming import state


def drain(stream, name, mode="update"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def parts(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("session"), "event_id", "value", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    n = events.count()
    for i in range(3):  # one file a batch, in order of ids
        events.filter(F.col("event_id").between(i * n // 3, (i + 1) * n // 3 - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path))
    return events, spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))


def test_stream_ends_where_the_batch_fold_does(spark, sf, tmp_path):
    events, stream = parts(spark, sf, tmp_path)
    got = drain(state.ewma(stream, "session", ["event_id"], "value"), "ewma_out")
    last = {r.session: r.ewma for r in got.groupBy("session").agg(F.max_by("ewma", "n").alias("ewma")).collect()}
    want = {r.session: r.ewma for r in B.ewma(events, "session", ["event_id"], "value").collect()}
    assert last.keys() == want.keys() and all(abs(last[k] - want[k]) < 1e-6 for k in want)


def test_windows(spark, sf, tmp_path):
    events, stream = parts(spark, sf, tmp_path)
    got = drain(state.windows(stream), "win_out", "complete")
    assert got.agg(F.sum("n")).first()[0] == events.count()


def test_tailed_usage(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.jsonl").write_text("\n".join([json.dumps({"session_id": f"s{i}", "provider": "p", "model": "m", "tokens_in": 10, "tokens_out": 1, "at": 1_700_000_000 + i}), "bad"]))
    got = drain(state.rollup_stream(state.tail_usage(spark, str(tmp_path))), "tail_out", "complete").collect()
    assert [(r.day, r.tokens_in, r.n) for r in got] == [("2023-11-14", 30, 3)]


def test_beta_and_quota(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, True, 5), ("a", 2, False, 6), ("b", 3, True, 7)], "key string, i int, hit boolean, tokens int")
    rows.write.parquet(str(tmp_path / "x"))
    read = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "x"))
    beta = {r.key: (r.hits, r.wastes) for r in drain(state.beta(read(), "key", ["i"], "hit"), "beta_out").collect()}
    assert beta == {"a": (0.8, 1.0), "b": (1.0, 0.0)}
    used = {r.key: r.used for r in drain(state.quota(read(), "key", ["i"], "tokens", "string"), "quota_out").collect()}
    assert used == {"a": 11, "b": 7}


def test_false_hits(spark, tmp_path):
    from datetime import datetime

    rows = [(1, 1, "how to sort a list", True), (1, 2, "how to sort a list?", False), (1, 3, "how to sort a list?", True), (1, 4, "other words", False), (2, 1, "x", False), (2, 2, "x", False)]
    schema = "session long, seq long, ts timestamp, query string, l3_reuse boolean"
    spark.createDataFrame([(s, i, datetime(2024, 1, 1, 0, i), q, r) for s, i, q, r in rows], schema).write.parquet(str(tmp_path / "r"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "r"))
    got = drain(state.false_hits(stream), "false_out", "append").collect()
    assert [(r.session, r.seq) for r in got] == [(1, 2)]
