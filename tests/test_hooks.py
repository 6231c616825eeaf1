import math

import pytest
from pyspark.sql import functions as F

from tracewell.operators import hooks as H
from tracewell.operators import learning as L


def test_bad_rows_fail_alone(spark):
    df = spark.createDataFrame([(i, None if i == 5 else f"t{i}") for i in range(12)], "i int, text string").coalesce(2)

    def hook(batch):
        texts = batch.column(0).to_pylist()
        if any(t == "t3" for t in texts):
            raise OSError("no route to " + "x" * 500)
        return [len(t or "") if t != "t4" else "four" for t in texts] + ([0] if "t7" in texts else [])

    out = H.called(df, ["text"], hook, "long", lambda v, row: "eight" if row["text"] == "t8" else None, F.col("i") != 9, F.col("i") * -1)
    got = {r.i: (r.ok, r.value, r.error) for r in out.collect()}
    assert got[0] == (True, 2, None) and got[5] == (True, 0, None) and got[11] == (True, 3, None)
    assert got[3][:2] == (False, -3) and got[3][2].startswith("OSError: no route") and len(got[3][2]) == H.TOLD
    assert got[4][:2] == (False, -4) and got[7][:2] == (False, -7) and "2 values" in got[7][2]
    assert got[8] == (False, -8, "eight") and got[9] == (False, -9, "not called")
    assert H.called(df.limit(0), ["text"], hook, "long").collect() == []


def test_embedder_judge_and_executor(spark):
    texts = {"a": [1.0, 0.0], "b": [1.0], "c": [0.0, 0.0], "d": [math.nan, 1.0], None: [0.5, 0.5]}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: (r.ok, r.value) for r in H.embedded(df, "text", lambda ts: [texts[t or None] for t in ts], 2, F.array(F.lit(9.0))).collect()}
    assert got == {"a": (True, [1.0, 0.0]), "b": (False, [9.0]), "c": (False, [9.0]), "d": (False, [9.0]), None: (True, [0.5, 0.5])}

    pairs = spark.createDataFrame([("q", c, z) for c, z in (("good", "grey"), ("bad", "grey"), ("odd", "grey"), ("down", "grey"), ("good", "hit"))], "query string, content string, zone string")

    def judge(query, content):
        if content == "down":
            raise TimeoutError
        return {"good": "yes", "bad": "no"}.get(content, "perhaps")

    out = H.verdicts(pairs, "query", "content", judge, F.col("zone") == "grey")
    found = {(r.content, r.zone): (r.verdict, r.d) for r in out.withColumn("d", L.judged(F.col("zone"), F.lit(False), F.col("verdict"))).collect()}
    assert found == {("good", "grey"): ("yes", "approved"), ("bad", "grey"): ("no", "judge_reject"), ("odd", "grey"): ("error", "judge_error"), ("down", "grey"): ("error", "judge_error"), ("good", "hit"): (None, "approved")}

    calls = spark.createDataFrame([("read", "x", True), ("rm", "y", False), ("read", "!", True), ("read", "z", None)], "tool string, args string, safe boolean")
    made = []

    def run(tool, args):
        assert tool != "rm"
        if args == "!":
            raise FileNotFoundError(args)
        return f"{tool} {args}"

    got = sorted((r.tool, r.args, r.ok, r.value, r.error) for r in H.executed(calls, "tool", "args", run, F.col("safe")).collect())
    assert got == [("read", "!", False, None, "FileNotFoundError: !"), ("read", "x", True, "read x", None), ("read", "z", False, None, "not called"), ("rm", "y", False, None, "not called")] and not made


@pytest.mark.parametrize("fault", ["none", "raise", "unknown", "twice", "missing", "empty", "nan", "type", "text"])
def test_a_fault_leaves_its_query_as_it_was(spark, fault):
    hits = [(q, i, 10.0 - i, i) for q in (1, 2) for i in range(1, 6)] + [(3, 7, 4.0, 1)]
    df = spark.createDataFrame(hits, "query_id long, doc_id long, score double, rank int").withColumn("content", F.concat(F.lit("c"), "doc_id"))

    def scorer(q, found):
        assert set(found[0]) == {"doc_id", "content"} and len(found) > 1
        good = [(h["doc_id"], h["doc_id"] - 3) for h in found]
        if q != 2 or fault == "none":
            return good
        if fault == "raise":
            raise ConnectionError
        return {"unknown": [*good[1:], (99, 1.0)], "twice": [good[0], *good], "missing": good[1:], "empty": [], "nan": [*good[1:], (1, math.nan)], "type": [("1", 1.0), *good[1:]], "text": [(1, "high"), *good[1:]]}[fault]

    got = {}
    for r in H.reranked(df, scorer, most=4, k=3, shown=["content"]).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.score, r.reranked))
    anew = [(1, 4, 1.0, True), (2, 1, 0.0, True), (3, 2, 0.0, True)]
    assert got[1] == anew and got[3] == [(1, 7, 4.0, False)]
    assert got[2] == (anew if fault == "none" else [(1, 1, 9.0, False), (2, 2, 8.0, False), (3, 3, 7.0, False)])
