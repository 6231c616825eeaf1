"""SimHash near-dedup: exact links between 64-bit fingerprints by vantage-point trees.

A vantage point deals fingerprints out by their Hamming distance to it. By the triangle bound two fingerprints
within RADIUS differ by at most RADIUS in that distance: pairs further apart in it are pruned unseen.

* First the fingerprints are partitioned. Two within four bits agree on one of five blocks of bits, so a block's
  values are vantage points at whose distance 0 both stand: each fingerprint goes to a shard a block, of about
  TARGET fingerprints (finer for more: two blocks of six, three of seven, four of eight). A shard that is still too
  large is dealt out again over the cluster by rings of whole distance to one of its fingerprints, if that halves it;
  where a ball crosses a ring's border the fingerprint goes to the next ring too.
* A shard's tree then splits at the median distance to a vantage point into an inner and an outer part, and goes on
  with each. Pairs across the border are searched between the strips within RADIUS of it only, by further vantage
  points. Leaves of LEAF fingerprints are compared.

A shard's links are cut down to a forest; all pairs are never emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import done_with, guarded, hash2, split_join, stored, table
from .components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Width of a ring of distances; a ball then crosses one border at most.
RING = 8
#: Fingerprints that a shard of random ones has at most, and from which a shard is dealt out again over the cluster.
TARGET, SHARD = 2_048, 20_000
#: Rounds in which large shards are dealt out again.
ROUNDS = 3
#: Fingerprints of a tree's leaf.
LEAF = 32


def votes(hashes: np.ndarray) -> np.ndarray:
    """For each bit the hashes that have it set."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text, 0 where it has no word.

    A-Z are lowered; words are split at ASCII white space; a text with fewer words than a shingle is one.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    cast, total = np.zeros(64, np.int64), len(last)
    for at in range(0, total, 65_536):
        cuts = zip(starts[at : at + 65_536].tolist(), last[at : at + 65_536].tolist(), strict=False)
        cast += votes(np.array([digest(joined[a:b], SEED) for a, b in cuts], np.uint64))
    return int(np.packbits(2 * cast > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *keys, texts = batch.columns
        found = np.fromiter((fingerprint(x.as_py()) for x in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([*keys, pa.array(found)], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """The key columns and fp, the fingerprint as a signed long."""
    narrow = docs.select(*keys, F.col(text).cast("binary").alias("_text"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in narrow.dtypes[:-1])
    return narrow.mapInArrow(_fingerprints, f"{kinds}, fp long")


class _Tree:
    """The search for pairs within RADIUS among distinct fingerprints; counts pairs compared and branches pruned."""

    def __init__(self, points: np.ndarray):
        self.points, self.compared, self.pruned = points, 0, 0
        self.found: list[np.ndarray] = []

    def leaf(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        near = np.bitwise_count(self.points[a][:, None] ^ self.points[b][None, :]) <= RADIUS
        self.compared += near.size
        i, j = np.nonzero(np.triu(near, 1) if same else near)
        if len(i):
            self.found.append(np.stack((a[i], b[j])))
            if sum(x.shape[1] for x in self.found) > 1 << 16:
                self.found = [_forest(np.concatenate(self.found, axis=1), len(self.points))]

    def split(self, a: np.ndarray, depth: int) -> None:
        """Pairs within a."""
        while len(a) > LEAF:
            far = np.bitwise_count(self.points[a] ^ self.points[a[depth * 7919 % len(a)]]).astype(np.int64)
            middle = int(np.partition(far, len(far) // 2)[len(far) // 2])
            inner = far < middle if (far < middle).any() else far <= middle
            if inner.all():
                break
            border = int(far[inner].max())
            self.across(a[inner & (far > border - RADIUS)], a[~inner & (far <= border + RADIUS)], depth + 1)
            self.split(a[inner], depth + 1)
            a, depth = a[~inner], depth + 1
        if len(a) <= 4 * LEAF:
            self.leaf(a, a, True)
        else:  # all at one distance
            half = len(a) // 2
            self.across(a[:half], a[half:], depth + 1)
            self.split(a[:half], depth + 1)
            self.split(a[half:], depth + 1)

    def across(self, a: np.ndarray, b: np.ndarray, depth: int) -> None:
        """Pairs between a and b."""
        if not len(a) or not len(b):
            self.pruned += 1
            return
        if min(len(a), len(b)) <= LEAF:
            for at in range(0, max(len(a), len(b)), 4096):
                some = (a[at : at + 4096], b) if len(a) > len(b) else (a, b[at : at + 4096])
                self.leaf(*some, False)
            return
        at = a[depth * 7919 % len(a)]
        x, y = (np.bitwise_count(self.points[s] ^ self.points[at]).astype(np.int64) for s in (a, b))
        middle = int(np.partition(x, len(x) // 2)[len(x) // 2])
        low, high = x <= middle, y <= middle
        if low.all() and (high.all() or depth > 200):
            half = len(a) // 2
            self.across(a[:half], b, depth + 1)
            self.across(a[half:], b, depth + 1)
            return
        self.across(a[low], b[high], depth + 1)
        self.across(a[~low], b[~high], depth + 1)
        self.across(a[low & (x > middle - RADIUS)], b[~high & (y <= middle + RADIUS)], depth + 1)
        self.across(a[~low & (x <= middle + RADIUS)], b[high & (y > middle - RADIUS)], depth + 1)


def _forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """The pairs, each of which joins two parts that those before it left apart."""
    parent, keep = list(range(n)), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for k, (a, b) in enumerate(pairs.T.tolist()):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            keep.append(k)
    return pairs[:, keep]


def links(points: np.ndarray) -> tuple[np.ndarray, _Tree]:
    """A forest of links, 2 x n, that joins what RADIUS joins among distinct fingerprints; and the tree that found it."""
    tree = _Tree(points)
    tree.split(np.arange(len(points)), 0)
    pairs = _forest(np.concatenate(tree.found, axis=1), len(points)) if tree.found else np.empty((2, 0), np.int64)
    return points[pairs], tree


def _shard_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each shard; rows come sorted by shard, so only one shard is held beyond a batch."""

    def found(shard: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.diff(shard)) + 1
        out = [links(np.unique(x))[0] for x in np.split(fp, cut) if len(x) > 1]
        pairs = np.concatenate(out, axis=1).view(np.int64) if out else np.empty((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        shard, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        cut = int(np.searchsorted(shard, shard[-1]))
        if cut or (held and held[0][0][0] != shard[0]):
            held.append((shard[:cut], fp[:cut]))
            yield found(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = []
        held.append((shard[cut:], fp[cut:]))
    if held:
        yield found(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _masks(n: int) -> list[int]:
    """Bit masks of the blocks on which fingerprints may agree, so that n random ones have shards of TARGET at most.

    RADIUS + 1 blocks, of which two near fingerprints agree on one; where their bits don't do, more blocks, of which
    they agree on as many more.
    """
    bits = max(0, (-(-n // TARGET) - 1).bit_length())
    if not bits:
        return [0]
    more = next((k for k in range(4) if 64 // (RADIUS + 1 + k) * (k + 1) >= bits), 3)
    width = min(64 // (RADIUS + 1 + more), -(-bits // (more + 1)))
    block = [((1 << width) - 1) << (width * i) for i in range(RADIUS + 1 + more)]
    return [sum(c) - (1 << 64 if sum(c) >> 63 else 0) for c in combinations(block, more + 1)]


def _dealt(shards: DataFrame, largest: int, rounds: int = ROUNDS) -> DataFrame:
    """Deals shards over `largest` rows out by rings of whole distance to a fingerprint of theirs, another one in each round.

    A shard is dealt out only where that halves it at least and repeats no more than every second row, so rows grow by
    1.5 a round at most; fingerprints close together, which no distance tells apart, stay one shard, whose tree finds them.
    """
    dense = None
    for i in range(rounds):
        big = shards.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min_by("fp", F.xxhash64("fp", F.lit(i))).alias("at")).filter(F.col("n") > largest)
        big = stored(big if dense is None else big.join(dense, "shard", "left_anti"))
        if big.isEmpty():
            break
        far = F.bit_count(F.col("fp").bitwiseXOR(F.col("at")))
        ring = lambda d: F.floor(d / RING)
        split = shards.join(big, "shard").withColumn("ring", F.explode(F.array_distinct(F.array(ring(far), ring(far + RADIUS)))))
        sizes = split.groupBy("shard", "n", "ring").agg(F.count(F.lit(1)).alias("m")).groupBy("shard", "n").agg(F.max("m").alias("most"), F.sum("m").alias("all"))
        apart = stored(sizes.filter("2 * most <= n and 2 * all <= 3 * n").select("shard"))
        still = big.join(apart, "shard", "left_anti").select("shard")
        dense = stored(still if dense is None else dense.unionByName(still))
        if not apart.isEmpty():
            parts = split.join(apart, "shard", "left_semi").select(F.xxhash64("shard", "ring").alias("shard"), "fp")
            shards = stored(shards.join(apart, "shard", "left_anti").unionByName(parts))
    return shards


def near_links(fps: DataFrame, n: int, largest: int = SHARD) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp that join the same groups as all pairs within RADIUS."""
    keys = [F.struct(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(mask))).alias("shard"), F.col("fp")) for i, mask in enumerate(_masks(n))]
    shards = fps.select(F.inline(F.array(*keys)))
    shards = _dealt(shards, largest)
    shards = shards.repartition("shard").sortWithinPartitions("shard")
    return shards.mapInArrow(_shard_links, "a long, b long")


def near_groups(keyed: DataFrame, first: Column) -> DataFrame:
    """(fp, first, n) for each fingerprint of keyed: the least `first` of the group that links join it to, and its rows."""
    fps = stored(keyed.groupBy("fp").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n")))
    roots = components(near_links(fps.select("fp"), fps.count()))
    rooted = stored(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")))
    # The least of a group is worked out before its members meet it, so that a group of any size spreads.
    least = stored(rooted.groupBy("root").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("_n")))
    out = stored(split_join(rooted, least, ["root"], "_n", rooted.count()).select("fp", F.col("least").alias("first"), "n"))
    done_with(fps, rooted, least)
    return out


def simhash_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id reachable over links.

    Null, empty and blank texts have fingerprint 0 and link like any other. Null ids are reached last:
    component_id is null only where a group has no other. Repeated rows and ids each give a row. Other
    columns of docs are not read. A fingerprint that a hot share of all rows has is joined by broadcast.
    """
    keyed = stored(fingerprints(docs, "doc_id", text=text))
    groups = near_groups(keyed, F.col("doc_id"))
    met = split_join(keyed, groups, ["fp"], "n", keyed.count())
    return met.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


@guarded
def near_dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs without all but one of each group: the least doc_id (null last), then text hash, stays.

    Of rows alike in both one stays. Columns pass through.
    """
    given = docs.columns
    k1, k2 = hash2(F.col("doc_id"), F.col("doc_id").isNull(), F.coalesce(F.col(text), F.lit("")))
    rows = docs.withColumn("_k1", k1).withColumn("_k2", k2)
    keyed = stored(fingerprints(rows, "doc_id", "_k1", "_k2", text=text))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_k1"), F.col("_k2"))
    stay = near_groups(keyed, place).select("first._k1", "first._k2").distinct()
    # Both steps need rows by the two hashes only, so the texts are shuffled once.
    return rows.join(stay, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select(*given)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
