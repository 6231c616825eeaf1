"""Near-dedup: texts whose sets of 5-word shingles are alike to 0.8 or more (Jaccard) are linked, by SimHash first.

Each distinct set has a SimHash, and vantage-point trees (see simhash) find those within RADIUS bits of each other. That
is a forest of fingerprints; its links hold where the whole sets are alike. At a likeness of 0.8 most SimHashes differ in
more bits, so what trees can't reach goes another way: each set draws BANDS keys of ROWS least hashes, and sets that
share a key meet. A pair alike to 0.8 shares none with a chance of (1 - 0.8 ** ROWS) ** BANDS = 0.0002. What meets is
compared on the whole sets. Keys that the very same sets share are one shard. Within a shard a search from set to set
emits a forest of links, never all pairs; a shard's sets are held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import guarded, hash2, stored
from .components import components

SHINGLE = 5
SEED = 42
#: Texts are alike where five times the common shingles are four times all of them, or more.
COMMON, ALL = 5, 4
BANDS, ROWS = 16, 4
#: Shingles that draw their least hashes together.
_DRAWN = 2_048
#: Odd factors: each orders the shingles in its own way.
_WAYS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """Hashes of a UTF-8 text's distinct shingles, ascending; none where it has no word.

    A-Z are lowered; words are split at ASCII white space; a text with fewer words than a shingle is one.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(SHINGLE, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    cuts = zip(starts.tolist(), last.tolist(), strict=False)
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in cuts), np.uint64, len(last)))


def band_keys(found: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles, one a band; none of an empty set."""
    if not len(found):
        return np.empty(0, np.uint64)
    least = np.min([(found[at : at + _DRAWN, None] * _WAYS).min(axis=0) for at in range(0, len(found), _DRAWN)], axis=0)
    return np.array([xxhash.xxh64_intdigest(least[at : at + ROWS].tobytes(), at) for at in range(0, len(least), ROWS)], np.uint64)


def fingerprint(found: np.ndarray) -> int:
    """The SimHash of a set of shingles, 0 of an empty set."""
    votes = sum((simhash.votes(found[at : at + _DRAWN]) for at in range(0, len(found), _DRAWN)), np.zeros(64, np.int64))
    return int(np.packbits(2 * votes > len(found), bitorder="little").view(np.int64)[0])


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the likeness of two sets is 0.8 or more."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return COMMON * common >= ALL * (len(a) + len(b) - common)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *keys, texts = batch.columns
        sets, bands, fps = [], [], []
        for x in texts:
            found = shingles(x.as_py())
            sets.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
            bands.append(band_keys(found).view(np.int64))
            fps.append(fingerprint(found))
        offsets = np.cumsum([0, *map(len, bands)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *bands])))
        yield pa.RecordBatch.from_arrays([*keys, pa.array(np.array(sets, np.uint64).view(np.int64)), lists, pa.array(fps, pa.int64())], names=[*batch.schema.names[:-1], "set_id", "bands", "fp"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.columns
        yield pa.RecordBatch.from_arrays([ids, pa.array([shingles(x.as_py()).tobytes() for x in texts], pa.binary())], names=["set_id", "hashes"])


def search(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A forest of links between alike sets: a walk from each set to those not yet reached."""
    sizes = np.array(list(map(len, sets)))
    out, rest = [], np.arange(len(sets))
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            p = front.pop()
            near = rest[ALL * np.maximum(sizes[rest], sizes[p]) <= COMMON * np.minimum(sizes[rest], sizes[p])]
            if not len(near):
                continue
            values = np.concatenate([sets[i] for i in near])
            at = np.minimum(np.searchsorted(sets[p], values), sizes[p] - 1)
            common = np.add.reduceat(sets[p][at] == values, np.cumsum(sizes[near]) - sizes[near], dtype=np.int64)
            new = near[COMMON * common >= ALL * (sizes[near] + sizes[p] - common)]
            out += [(int(p), int(i)) for i in new]
            front.extend(new)
            rest = rest[~np.isin(rest, new)]
    return out


def _shard_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each shard; rows come sorted by shard."""
    shard, ids, sets = None, [], []

    def found() -> pa.RecordBatch:
        pairs = search(sets)
        return pa.RecordBatch.from_arrays([pa.array([ids[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for s, i, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if s != shard:
                if len(ids) > 1:
                    yield found()
                shard, ids, sets = s, [], []
            ids.append(i)
            sets.append(np.frombuffer(x, np.uint64))
    if len(ids) > 1:
        yield found()


def _shards(sets: DataFrame) -> DataFrame:
    """(shard, set_id) of sets that share a band's key; bands in which the same sets meet give one shard."""
    flat = sets.select("set_id", F.posexplode("bands").alias("band", "key"))
    h1, h2 = hash2(F.col("set_id"))
    met = flat.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h1).alias("x1"), F.bit_xor(h2).alias("x2")).filter("n > 1")
    once = met.groupBy("n", "x1", "x2").agg(F.min(F.struct("band", "key")).alias("at")).select("at.band", "at.key")
    return stored(flat.join(once, ["band", "key"]).select(F.xxhash64("band", "key").alias("shard"), "set_id"))


def _near_fingerprints(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose SimHashes are equal, each with the least of them, or linked by vantage-point trees, the least of either."""
    of = stored(sets.groupBy("fp").agg(F.min("set_id").alias("least")))
    equal = sets.join(of, "fp").filter("set_id <> least").select(F.col("least").alias("a"), F.col("set_id").alias("b"))
    linked = simhash.near_links(of.select("fp"), of.count())
    ends = [of.select(F.col("fp").alias(f), F.col("least").alias(c)) for f, c in (("x", "a"), ("y", "b"))]
    return stored(equal.unionByName(linked.toDF("x", "y").join(ends[0], "x").join(ends[1], "y").select("a", "b")).distinct())


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of whole sets (ha, hb) that are alike."""
    for batch in batches:
        ok = [alike(*(np.frombuffer(x.as_py(), np.uint64) for x in pair)) for pair in zip(batch.column(2), batch.column(3), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


@guarded
def near_dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs without all but one of each group: the least doc_id (null last), then text hash, stays.

    Groups are what links between texts alike to 0.8 join; texts without a word are one group. Of rows alike in
    both one stays. Columns pass through.
    """
    given = docs.columns
    k1, k2 = hash2(F.col("doc_id"), F.col("doc_id").isNull(), F.coalesce(F.col(text), F.lit("")))
    rows = docs.withColumn("_k1", k1).withColumn("_k2", k2)
    keyed = rows.select("doc_id", "_k1", "_k2", F.col(text).cast("binary").alias("_text")).mapInArrow(_keyed, "doc_id long, _k1 long, _k2 long, set_id long, bands array<long>, fp long")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_k1"), F.col("_k2"))
    sets = stored(stored(keyed).groupBy("set_id").agg(F.min(place).alias("first"), F.first("bands").alias("bands"), F.first("fp").alias("fp")))
    shards, near = _shards(sets), _near_fingerprints(sets)
    met = shards.select("set_id").union(near.select("a")).union(near.select("b")).distinct()
    asked = sets.join(met, "set_id", "left_semi").select("set_id", "first._k1", "first._k2")
    texts = rows.select("_k1", "_k2", F.col(text).cast("binary").alias("_text")).join(asked, ["_k1", "_k2"]).dropDuplicates(["set_id"]).select("set_id", "_text")
    hashed = stored(texts.mapInArrow(_hashed, "set_id long, hashes binary"))
    sides = [hashed.select(F.col("set_id").alias(c), F.col("hashes").alias(f"h{c}")) for c in ("a", "b")]
    by_simhash = near.join(sides[0], "a").join(sides[1], "b").select("a", "b", "ha", "hb").mapInArrow(_alike, "a long, b long")
    met = shards.join(hashed, "set_id").select("shard", "set_id", "hashes").repartition("shard").sortWithinPartitions("shard")
    roots = components(by_simhash.unionByName(met.mapInArrow(_shard_links, "a long, b long")))
    rooted = sets.select("set_id", "first").join(roots, F.col("set_id") == F.col("node"), "left").select("first", F.coalesce("root", "set_id").alias("root"))
    stay = stored(rooted.groupBy("root").agg(F.min("first").alias("first")).select("first._k1", "first._k2").distinct())
    # Both steps need rows by the two hashes only, so the texts are shuffled once.
    return rows.join(stay, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select(*given)
