import hashlib
import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tracewell.llm import mixing

SCHEMA = "doc_id long, text string, source string, copies string"


def level(sizes, weights=mixing.WEIGHTS, most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        left = sum(w[s] for s in order if s not in capped)
        out = {s: most * sizes[s] if s in capped else rest * w[s] / left for s in order}
        over = {s for s in order if s not in capped and out[s] > most * sizes[s]}
        if not over:
            return out
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 50, None: 7}, {"x": 1, "y": 1, "z": 1000}, {"one": 9}, {"a": 5, "b": 0}, {f"s{i:02}": i * i for i in range(1, 25)}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    want = level(sizes)
    assert {s: pytest.approx(t) for s, t in want.items()} == got


def corpus():
    rows = [(i, "w " * (i * 37 % 90 + (5000 if i == 100 else 0)), f"s{i % 5 if i % 3 else 0}", "old") for i in range(900)]
    return rows + [(1000, None, "s1", ""), (1001, "", "s1", ""), (None, "a b c", None, ""), (5, "w w", "s0", ""), (5, "w w", "s0", "")]


def test_taken_words_come_near_the_targets(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    rows = mixing.copies(mixing.sized(docs, "doc_id")).collect()
    assert len(rows) == len(corpus()) and all(0 <= r.copies <= 3 for r in rows)
    for s in {r.source for r in rows} - {None}:
        mine = [r for r in rows if r.source == s]
        assert sum(r.size * r.copies for r in mine) == pytest.approx(mine[0].target, rel=0.05, abs=max(r.size for r in mine))
    again = mixing.copies(mixing.sized(docs.repartition(7), "doc_id")).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mixed_rows_repeat(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    want = mixing.copies(mixing.sized(docs, "doc_id")).agg(F.sum("copies")).first()[0]
    rows = mixed.collect()
    assert len(rows) == want > len(set(rows))


def crossed(mine, large, seed=mixing.SEED, most=3):
    """A source's rows in order, their expected copies and the integers that the running sum crosses, by hand."""
    mine = sorted(mine, key=lambda r: (-r.size, r.doc_id is None, r.doc_id or 0))
    total, source = sum(r.size for r in mine), mine[0].source
    rate = min(most, mine[0].target / total) if total else 0
    offset = Fraction(int(hashlib.md5(f"{seed}:{chr(0) if source is None else source}".encode()).hexdigest()[:8], 16) % 1_000_000, 10**6)
    big = [r for r in mine if r.size * large > total]
    expected, left = [], 0.0
    for r in big:
        want = left + rate * r.size
        n = min(max(math.floor(want / r.size + float(offset)), math.floor(rate)), math.ceil(rate), most)
        expected.append(Fraction(n))
        left = want - n * r.size
    small = sum(r.size for r in mine) - sum(r.size for r in big)
    rest = min(most, max(0, rate + left / small)) if small else 0
    expected += [Fraction(round(rest * 10**12), 10**12) if r.size else Fraction(0) for r in mine[len(big) :]]
    at, out = offset, []
    for e in expected:
        out.append(math.floor(at + e) - math.floor(at))
        at += e
    return mine, expected, out


@pytest.mark.parametrize("large", [3, 20, 256])
def test_copies_are_the_borders_crossed(spark, monkeypatch, large):
    monkeypatch.setattr(mixing, "LARGE", large)
    rows = mixing.copies(mixing.sized(spark.createDataFrame(corpus(), SCHEMA), "doc_id")).collect()
    assert len(rows) == len(corpus())
    for s in {r.source for r in rows}:
        mine, expected, want = crossed([r for r in rows if r.source == s], large)
        assert [r.copies for r in mine] == want
        assert all(math.floor(e) <= r.copies <= math.ceil(e) and (r.copies == e or e.denominator > 1) for r, e in zip(mine, expected, strict=True))


def test_copies_of_the_test_table_are_the_borders_crossed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.copies(mixing.sized(docs, "doc_id")).collect()
    smaller = 0
    for s in {r.source for r in rows}:
        mine, expected, want = crossed([r for r in rows if r.source == s], mixing.LARGE)
        assert [r.copies for r in mine] == want
        smaller += sum(e.denominator > 1 for e in expected)
        taken = sum(r.size * r.copies for r in mine)
        assert abs(taken - mine[0].target) <= 0.01 * mine[0].target, (s, taken, mine[0].target)
        share = mine[0].target / mine[0].source_size
        assert all(math.floor(share) <= r.copies <= math.ceil(share) for r in mine if r.size * mixing.LARGE > r.source_size)
    assert smaller > 50


def test_sources_of_the_test_table_come_near_their_targets(spark):
    rows = mixing.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source"), "doc_id")
    got = rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 0.1 * r.target for r in got), got


def test_empty_tables_and_high_rates(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.copies(mixing.sized(none, "doc_id")).count() == 0 and mixing.mix(none).count() == 0
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "big" if i else "a", "") for i in range(400)], SCHEMA)
    rows = mixing.copies(mixing.sized(docs, "doc_id"), weights=(1000, 1), most=50).collect()
    assert {r.copies for r in rows if r.source == "a"} == {50}
