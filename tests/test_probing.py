import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewell.operators import probing as P
from tracewell.operators.ranking import running


def by_hand(docs, queries, k):
    """The library built anew for each query's session, every document scored."""
    out = set()
    for session, q, text in queries:
        library = [(i, t.split()) for s, i, t in docs if s < session and t]
        n = len(library)
        if not n:
            continue
        mean = sum(len(w) for _, w in library) / n
        df = Counter(x for _, w in library for x in set(w))
        scores = {}
        for i, w in library:
            tf = Counter(w)
            if any(x in tf for x in set((text or "").split())):
                scores[i] = round(sum(math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * tf[x] * 2.2 / (tf[x] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x in set(text.split()) if x in tf), 6)
        out |= {(q, i, s, r) for r, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k], 1)}
    return out


@pytest.mark.parametrize("k", [1, 3])
def test_pruned_search_finds_what_a_library_for_each_session_finds(spark, k):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(60)]
    line = lambda: " ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.randint(1, 14)))
    docs = [(rng.randint(0, 12), i, line()) for i in range(150)] + [(3, 150, None), (3, 151, ""), (4, 152, "w0 w0 w0"), (5, 153, "w0 w0 w0"), (5, 154, "only")]
    queries = [(rng.randint(0, 14), f"q{i}", line()) for i in range(60)] + [(0, "qa", "w1"), (9, "qb", None), (9, "qc", "nowhere"), (9, "qd", "w0"), (14, "qe", "only w0")]
    got = P.earlier_topk(spark.createDataFrame(docs, "session int, doc_id int, text string"), spark.createDataFrame(queries, "session int, query_id string, text string"), k)
    got = {(r.query_id, r.doc_id, r.score, r["rank"]) for r in got.collect()}
    want = by_hand(docs, queries, k)
    assert {x[:2] + x[3:] for x in got} == {x[:2] + x[3:] for x in want}
    assert sorted(round(x[2], 5) for x in got) == pytest.approx(sorted(round(x[2], 5) for x in want), abs=2e-5)


def test_common_terms_bring_nothing_in_where_a_rare_one_decides(spark):
    docs = [(0, i, "the common words of all " + ("needle " if i == 7 else "") + f"x{i}") for i in range(200)]
    queries = [(1, 0, "the needle of all")]
    df = spark.createDataFrame(docs, "session int, doc_id int, text string")
    terms = P.query_terms(spark.createDataFrame(queries, "session int, query_id int, text string")).withColumn("session", F.lit(1))
    found, _ = P.term_counts(df.select(F.col("session").alias("scope"), "doc_id", "text"), terms)
    found = found.withColumnRenamed("scope", "session")
    stats = spark.createDataFrame([(0, 200, 1000)], "session int, n long, dl long")
    weighted = P.weighted_terms(found, stats, terms)
    rest = {r.term: r.idf * 2.2 for r in weighted.collect()}
    score = P.best(weighted, found, 1).first()
    assert score.doc_id == 7 and sum(v for t, v in rest.items() if t != "needle") < score.score


def test_probe_counts(spark):
    docs = [(0, "a", "prompt", "s0", "alpha beta"), (1, "b", "result", "s1", "gamma delta"), (2, "c", "prompt", "s1", "gamma"), (2, "d", "prompt", "", "epsilon")]
    queries = [(0, "q0", "s0", "alpha"), (2, "q1", "s1", "gamma delta"), (2, "q2", "s1", "alpha beta"), (3, "q3", "s3", "zeta"), (3, "q4", "s3", "epsilon")]
    probed = P.probe(spark.createDataFrame(docs, "session int, doc_id string, kind string, source string, text string"), spark.createDataFrame(queries, "session int, query_id string, source string, text string"))
    rows = {r.query_id: (r.doc_id, r.kind, r.cross) for r in probed.collect()}
    assert rows == {"q0": (None, None, False), "q1": ("b", "result", False), "q2": ("a", "prompt", True), "q3": (None, None, False), "q4": ("d", "prompt", False)}
    kinds = {r.kind: (r.hit + r.grey + r.miss, r.cross) for r in P.by_kind(probed).collect()}
    assert kinds == {"none": (2, 0), "result": (1, 0), "prompt": (2, 1)}
    assert {r.session: r.cross_hits + r.same_hits for r in P.by_session(probed).collect()} == {r.session: r.hit for r in P.by_session(probed).collect()}


def test_running_sums(spark):
    rows = spark.createDataFrame([(k, i, i, 1) for k in "ab" for i in range(20)], "k string, i int, v long, w long")
    got = {(r.k, r.i): (r.v, r.w) for r in running(rows, ["k"], "i", ["v", "w"]).collect()}
    assert got == {(k, i): (sum(range(i)), i) for k in "ab" for i in range(20)}
