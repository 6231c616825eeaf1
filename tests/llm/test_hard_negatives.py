import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import hard_negatives as H

NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def by_hand(rows, every=50):
    """All rows against all anchors; rows are (vec_id, label, whole numbers)."""
    out = []
    last = lambda i: (i is None, i)
    for a, label, q in {(i, y, tuple(v)) for i, y, v in rows if i is not None and i % every == 0}:
        scored = [(sum(x * z for x, z in zip(q, v, strict=True)), i, y) for i, y, v in rows if len(v) == len(q) and i != a]
        scored.sort(key=lambda r: (-r[0], last(r[1])))
        for ps, p, _ in [r for r in scored if r[2] == label][:5]:
            found = [r for r in scored if r[2] != label and 50 * ps <= 100 * r[0] <= 95 * ps][:3]
            out += [(a, p, k, n, ps, ns) for k, (ns, n, _) in enumerate(found, 1)]
    return sorted(out, key=str)


def mined(df, every=50):
    return sorted((tuple(r) for r in H.mine(df, F.col("vec_id") % every == 0).select(*NAMES).collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, y, list(map(int, v)), "x", 1) for i, y, v in rows], "vec_id long, label long, v array<long>, segment string, band int").repartition(3)


@pytest.mark.parametrize("seed", range(3))
def test_against_all_rows(spark, monkeypatch, seed):
    """Clusters, ties and repeated vectors, over segments, blocks and groups of a few rows each."""
    for name, value in {"SEGMENT": 16, "FIRST": 40, "BLOCK": 7, "ASKING": 5}.items():
        monkeypatch.setattr(H, name, value)
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 60, (6, 5))
    rows = [(i, int(rng.integers(0, 3)), np.floor(centres[rng.integers(0, 6)] + rng.normal(0, 12, 5))) for i in range(500)]
    rows += [(500 + i, 1, rows[20][2]) for i in range(90)] + [(600 + i, 2, rows[20][2] * 0.8 // 1) for i in range(60)]
    rows += [(1000 + i, i % 2, v) for i, v in enumerate(rng.integers(-2, 3, (80, 5)))]
    rows = [(i, y, tuple(map(int, v))) for i, y, v in rows]
    assert mined(frame(spark, rows), 20) == by_hand(rows, 20)


def test_searches_prune_and_expand(monkeypatch):
    """Segments far from the annulus stay unread, and what the second interval leaves out can't have a better row."""
    monkeypatch.setattr(H, "SEGMENT", 16)
    rng = np.random.default_rng(5)
    x = np.concatenate([c + rng.normal(0, 3, (100, 4)) for c in rng.normal(0, 100, (8, 4))]).round()
    norm2 = float((x * x).sum(axis=1).max())
    pivots, borders = H.fit(x, norm2, len(x))
    far = H._apart(H._augmented(x, norm2), pivots)
    home, near = far.argmin(axis=1), far.min(axis=1)
    segment = home * (borders.shape[1] + 1) + (borders[home] < near[:, None]).sum(axis=1)
    names = np.unique(segment)
    stats = [np.array([f(near[segment == s]) for s in names]) for f in (np.min, np.max, len)]
    ix = H.Index(pivots, borders, norm2, names, *stats, np.ones(len(names), int), 40, 7, 5)
    read = 0
    for q in x[::40]:
        scores = x @ q
        best = sorted(scores, reverse=True)
        hi, lo = best[30], best[200]
        allowed = [s for s in best if lo <= s <= hi]
        band = {"hi": hi, "lo": lo, "reach": None}
        first = next(H._chosen(ix, q[None], [[band]], False))
        seen = np.isin(segment, names[first])
        got = sorted((s for s in scores[seen] if lo <= s <= hi), reverse=True)[:3]
        band["reach"] = got[2] if len(got) == 3 else None
        more = next(H._chosen(ix, q[None], [[band]], True))
        assert not set(first) & set(more)
        seen |= np.isin(segment, names[more])
        assert sorted((s for s in scores[seen] if lo <= s <= hi), reverse=True)[:3] == allowed[:3]
        read += seen.mean()
    assert read / len(x[::40]) < 0.7


def test_odd_rows(spark):
    rows = [(0, 1, [3, 4]), (0, 1, [3, 4]), (7, 1, [3, 3]), (None, 1, [3, 3]), (8, 2, [2, 2]), (9, 2, [2, 2]), (9, 2, [2, 2]), (None, 3, [2, 2]), (10, 1, [1]), (50, 2, [5]), (60, 2, [4]), (61, 1, [3]), (100, 1, []), (101, 1, []), (102, 2, []), (150, 4, [-9, -9]), (151, 4, [9, 9])]
    assert mined(frame(spark, rows)) == by_hand(rows) and by_hand(rows)
    assert mined(frame(spark, [(100, 1, []), (101, 1, []), (102, 2, [])])) == [(100, 101, 1, 102, 0, 0)]
    assert mined(frame(spark, rows).limit(0)) == []
    big = [(0, 1, [H.LARGEST] * 40), (1, 1, [H.LARGEST] * 40), (2, 2, [H.LARGEST - 99_999] * 40), (3, 2, [H.LARGEST - 99_998] * 40)]
    assert mined(frame(spark, big)) == by_hand(big)


def test_whole_numbers(spark):
    given = [(7, 9, [0.5, -0.001]), (1, None, [1.0]), (2, 1, None), (3, 1, [1.0, None]), (4, 1, [float("nan")]), (5, 1, [-math.inf]), (None, 2, [1e30, -1e30, 0.999]), (14, 2**31 - 1, [])]
    got = H.whole_numbers(spark.createDataFrame(given, "vec_id long, label int, embedding array<double>")).collect()
    assert [tuple(r) for r in got] == [(7, 0, [128, -1]), (None, 2, [1 << 20, -(1 << 20), 255]), (14, 2**31 % 10, [])]


def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = con.sql(f"select {', '.join(NAMES)} from ({H.SQL})").fetchall()
    got = [tuple(r) for r in H.query(spark, sf).select(*NAMES).collect()]
    assert want and sorted(got) == sorted(want)
