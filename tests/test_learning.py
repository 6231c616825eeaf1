from pyspark.sql import functions as F

from tracewell.operators import learning as L
from tracewell.operators.ranking import global_rank


def test_release():
    good = {"n": 5, "ndcg": 0.5, "mrr": 0.5}
    assert L.release(good, good)[0]
    assert not L.release(good | {"n": 0}, good)[0] and not L.release(good | {"mrr": 0.4}, good)[0] and not L.release(good | {"ndcg": 0.4}, good)[0]


def test_currencies(spark):
    df = spark.createDataFrame([(x,) for x in ("rmb", "US$", " € ", "pounds", "yen", "chf", "weird one", "")], "c string")
    assert [r.k for r in df.select(L.currency(F.col("c")).alias("k")).collect()] == ["CNY", "USD", "EUR", "GBP", "JPY", "CHF", "weird one", ""]


def test_a_failing_scorer_keeps_the_order(spark):
    hits = spark.createDataFrame([(q, d, 1.0 / k, k) for q in (1, 2) for k, d in enumerate((7, 8, 9), 1)], "query_id int, doc_id long, score double, rank int")

    def score(rows):
        if rows["query_id"].iloc[0] == 2:
            raise RuntimeError
        return rows["doc_id"] - 8

    got = {(r.query_id, r.rank): (r.doc_id, r.score) for r in L.rerank(hits, score, k=2).collect()}
    assert got == {(1, 1): (9, 1.0), (1, 2): (7, 0.0), (2, 1): (7, 1.0), (2, 2): (8, 0.5)}


def test_fit_moves_toward_what_ranks(spark):
    rows = [(i, 0, 1000 + i * 86_400, i % 3, 0, i % 2, 0.0, i % 2 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, created long, last_used long, hits int, injected int, rejected int, feedback double, relevant boolean")
    got = L.fit_weights(df, 1000 + 50 * 86_400)
    assert all(0.8 * v - 1e-9 <= got[k] <= 1.2 * v + 1e-9 for k, v in L.DEFAULTS.items())
    assert L.fit_weights(df.filter("relevant"), 10**9) == L.DEFAULTS


def test_verdicts_changes_and_counters(spark):
    cache = spark.createDataFrame([("q", 1, "no", 100), ("q", 1, "yes", 200), ("q", 2, "yes", 1)], "query string, slice_id int, verdict string, at long")
    pairs = spark.createDataFrame([("q", 1), ("q", 2), ("r", 1)], "query string, slice_id int")
    assert {(r.query, r.slice_id): r.verdict for r in L.with_verdicts(pairs, cache, 250, 200).collect()} == {("q", 1): "yes", ("q", 2): None, ("r", 1): None}
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, digest string")
    b = spark.createDataFrame([(2, "y"), (3, "w"), (4, "v")], "id int, digest string")
    assert {r.id: r.change for r in L.changed(a, b).collect()} == {1: "removed", 3: "changed", 4: "added"}


def test_global_rank(spark):
    df = spark.range(500).withColumn("v", F.col("id") * 7 % 500)
    got = {r.id: r.rank for r in global_rank(df, ["v"]).collect()}
    assert got == {i: i * 7 % 500 + 1 for i in range(500)}
