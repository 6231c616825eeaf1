import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewell.operators.index import TermIndex

SCHEMA = "scope string, source string, doc_id int, kind string, text string"


def by_hand(docs, queries, k, kinds=None):
    """Every document scored; docs are {source: [(scope, doc_id, kind, text)]}."""
    out = set()
    rows = [(s or "", i, kind, (t or "").split()) for held in docs.values() for s, i, kind, t in held]
    for scope in {r[0] for r in rows}:
        some = [r for r in rows if r[0] == scope and r[3]]
        if not some:
            continue
        mean = sum(len(r[3]) for r in some) / len(some)
        df = Counter(x for r in some for x in set(r[3]))
        for q, text in queries:
            scores = {}
            for _, i, kind, w in some:
                tf = Counter(w)
                if (kinds is None or kind in kinds) and any(x in tf for x in set(text.split())):
                    scores[i] = round(sum(math.log(1 + (len(some) - df[x] + 0.5) / (df[x] + 0.5)) * tf[x] * 2.2 / (tf[x] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x in set(text.split()) if x in tf), 5)
            out |= {(q, scope, i, r) for r, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k], 1)}
    return out


@pytest.fixture(scope="module")
def made():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    line = lambda: " ".join(rng.choices(words, [1 / (i + 1) for i in range(40)], k=rng.randint(1, 12)))
    queries = [(i, line()) for i in range(15)] + [(15, ""), (16, "nowhere")]
    return line, queries


def rows(spark, docs):
    return spark.createDataFrame([(s, source, i, kind, t) for source, held in docs.items() for s, i, kind, t in held], SCHEMA)


def test_increments_end_where_a_rebuild_does(spark, tmp_path, made):
    line, queries = made
    asked = spark.createDataFrame(queries, "query_id int, text string")
    docs = {f"s{j}": [("ab"[j % 2], 10 * j + i, "xy"[i % 2], line()) for i in range(6)] for j in range(12)}
    docs["odd"] = [(None, 500, "x", line()), ("a", 501, "x", None), ("a", 502, "x", "")]
    index = TermIndex(spark, str(tmp_path / "i"), "kind string", "int", buckets=4)
    found = lambda ix, **how: {tuple(r[c] for c in ("query_id", "scope", "doc_id", "rank")) for r in ix.search(asked, 3, **how).collect()}
    assert found(index) == set()
    index.append(rows(spark, docs))
    assert found(index) == by_hand(docs, queries, 3)
    more = {f"s{j}": [("ab"[j % 2], 2000 + 10 * j + i, "x", line()) for i in range(3)] for j in range(4)}
    index.append(rows(spark, more))  # sources grew
    docs = docs | {s: docs[s] + held for s, held in more.items()}
    assert found(index) == by_hand(docs, queries, 3)
    changed = {s: [("b", i + 1000, "y", line()) for _, i, _, _ in docs[s]][:2] for s in ("s1", "s7")}
    index.replace(rows(spark, changed))
    docs |= changed
    assert found(index) == by_hand(docs, queries, 3)
    index.remove(spark.createDataFrame([("s2",), ("nowhere",)], "source string"))
    del docs["s2"]
    assert found(index) == by_hand(docs, queries, 3)
    back = {"s2": [("a", 3000, "x", line())]}
    batch = index.append(rows(spark, back))
    docs |= back
    index.append(rows(spark, back), batch=batch)  # the same batch again
    want = by_hand(docs, queries, 3)
    assert found(index) == want == found(index, prune=True)
    assert found(index, where="kind = 'y'") == by_hand(docs, queries, 3, {"y"}) == found(index, where=F.col("kind") == "y", prune=True)
    # A batch that failed before its last table doesn't count.
    index._write(rows(spark, docs).select("scope", "source", "doc_id", F.lit(5).alias("dl"), "kind"), "documents", 99)
    index._write(index.live("totals"), "totals", 99)
    assert found(index) == want
    index.merge()
    assert found(index) == want
    index.replace(rows(spark, {"s2": []}), spark.createDataFrame([("s2",)], "source string"))
    docs["s2"] = []
    assert found(index) == by_hand(docs, queries, 3)
    rebuilt = TermIndex(spark, str(tmp_path / "again"), "kind string", "int", buckets=7)
    rebuilt.append(rows(spark, docs))
    assert found(rebuilt) == found(index)


def test_lookups_read_their_terms_buckets_only(spark, tmp_path, made):
    line, _ = made
    index = TermIndex(spark, str(tmp_path / "i"), "kind string", "int", buckets=16)
    index.append(rows(spark, {"s": [("a", i, "x", line()) for i in range(50)]}))
    plan = index.live("postings").filter(F.col("bucket").isin([3]) & F.col("term").isin(["w1"]))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200] and "term" in plan.split("PushedFilters")[1][:120]
