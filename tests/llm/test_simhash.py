import random
import re

import numpy as np
import pytest
import xxhash

from tracewell.llm import components, simhash


def by_hand(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def groups(fps):
    out = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = out[i], out[j]
                out = [min(a, b) if x in (a, b) else x for x in out]
    return out


def test_fingerprints():
    for t in (None, "", " \n", "A", "a b c", "The CAT sat É on the mat " * 9, "a b c d a b c d a b c d", "x y z"):
        assert simhash.fingerprint(t.encode() if t is not None else None) == by_hand(t)


def test_tree_joins_what_all_pairs_join():
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    points = [int(s) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for s in seeds for k in (0, 1, 3, 4, 5, 7)]
    cluster = [int(seeds[0]) ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]
    points = np.unique(np.array(points + cluster, np.uint64))
    pairs, tree = simhash.links(points)
    assert tree.pruned and tree.compared < len(points) ** 2 / 2 and pairs.shape[1] < len(points)
    assert (np.bitwise_count(pairs[0] ^ pairs[1]) <= 4).all()
    place = {int(p): i for i, p in enumerate(points)}
    parent = list(range(len(points)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs.T:
        x, y = root(place[int(a)]), root(place[int(b)])
        parent[max(x, y)] = min(x, y)
    assert [root(i) for i in range(len(points))] == groups([int(p) for p in points])


def test_groups_of_documents(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") * 3 for _ in range(60)) for _ in range(12)]
    texts = [b + (" tail" * k if k else "") for b in base for k in (0, 0, 1)] + [None, "", "  ", "one", "ONE"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, base[0], "y"), (None, base[1], "z")]
    got = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    fps = [by_hand(t) for _, t, _ in rows]
    ids = [i for i, _, _ in rows]
    parts = groups(fps)
    want = sorted((-1 if i is None else i, f"{f:016x}", min(ids[k] for k in range(len(ids)) if parts[k] == p and ids[k] is not None)) for i, f, p in zip(ids, fps, parts))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_shards_are_dealt_again(spark):
    rng = np.random.default_rng(9)
    seeds = rng.integers(0, 1 << 62, 40, dtype=np.int64)
    points = sorted({int(s) ^ (1 << int(a)) ^ (1 << int(b)) for s in seeds for a, b in rng.integers(0, 60, (12, 2))})
    fps = spark.createDataFrame([(p,) for p in points], "fp long")
    found = {}
    for largest in (4, 10**6):
        rows = components.components(simhash.near_links(fps, len(points), largest)).collect()
        found[largest] = {(r.node, r.root) for r in rows}
    assert found[4] == found[10**6] and found[4]


def test_fingerprints_close_together_stay_one_shard(spark):
    """Dealing out doesn't multiply what no distance tells apart; random ones it does deal out, at most 1.5 times each a round."""
    rng = np.random.default_rng(2)
    centre = 0x123456789ABCDEF
    close = sorted({centre ^ sum(1 << int(b) for b in rng.choice(62, 3, replace=False)) for _ in range(400)})
    wide = sorted({int(x) for x in rng.integers(0, 1 << 62, 300, np.int64)})
    shards = spark.createDataFrame([(1, p) for p in close] + [(2, p) for p in wide], "shard long, fp long")
    sizes = [r["count"] for r in simhash._dealt(shards, 50).groupBy("shard").count().collect()]
    assert len(close) in sizes and sum(sizes) <= 3 * (len(close) + len(wide))
    points = np.array(close, np.uint64)
    got = components.components(simhash.near_links(spark.createDataFrame([(p,) for p in close], "fp long"), len(close), 50)).collect()
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= simhash.RADIUS
    want = simhash._forest(np.stack(np.nonzero(np.triu(near, 1))), len(points))
    assert len(got) == want.shape[1] > 100


def test_branches_are_pruned_on_the_query_s_own_table(spark):
    rows = simhash.fingerprints(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").select("fp").distinct().collect()
    points = np.unique(np.array([r.fp for r in rows], np.int64).view(np.uint64))
    pairs, tree = simhash.links(points)
    print(len(points), tree.compared, tree.pruned)
    assert len(points) > 20 * simhash.LEAF and tree.compared < 0.7 * len(points) ** 2 / 2
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= simhash.RADIUS
    want = simhash._forest(np.stack(np.nonzero(np.triu(near, 1))), len(points))
    assert pairs.shape == want.shape
    got = simhash._forest(np.concatenate((np.searchsorted(points, pairs), want), axis=1), len(points))
    assert got.shape == want.shape


@pytest.mark.parametrize("n", [10, 10**5, 10**7, 10**9, 10**11])
def test_near_fingerprints_share_a_shard(n):
    masks, rng = [m & (1 << 64) - 1 for m in simhash._masks(n)], random.Random(n)
    assert len(masks) <= 70
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << i for i in rng.sample(range(64), 4))
        assert any((a ^ b) & m == 0 for m in masks)


def test_hot_fingerprints_meet_by_broadcast(spark, monkeypatch):
    from tracewell.llm import common

    docs = spark.createDataFrame([(i, "" if i % 3 else f"text number {i} of its own words {i * 7}") for i in range(60)], "doc_id long, text string")
    plain = sorted(map(str, simhash.simhash_groups(docs).collect()))
    monkeypatch.setattr(common, "HOT", 4)
    assert sorted(map(str, simhash.simhash_groups(docs).collect())) == plain


def test_one_of_each_group_stays(spark):
    text = "some words of a text that two documents share in full or nearly so " * 4
    rows = [(5, text, "a"), (2, text, "b"), (9, "other words entirely stand in this one here now", "c"), (2, text, "b"), (None, text, "d"), (7, None, "e"), (8, "", "f")]
    kept = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert kept.columns == ["doc_id", "text", "source"]
    assert sorted(r.doc_id for r in kept.collect()) == [2, 7, 9]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (600, 601)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {601: 600}
