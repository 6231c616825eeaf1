"""Hard-negative mining over one-dimensional distance keys.

A largest inner product is made a least distance: every vector x gets one more component, sqrt(M^2 - |x|^2), where M is
the largest norm; an anchor q gets a zero there, so its squared distance to x is |q|^2 + M^2 - 2 qx. Each row's key is
its nearest pivot and its distance to it; rows are stored sorted by key and fall into segments, intervals of the keys.

A search goes outward from the distance of the highest score that it may return. By the triangle bound a segment has
rows within an annulus of the anchor only. The interval of keys that is scanned first reaches until it has FIRST rows;
it then expands until the distance that the rest can't fall below certifies the k best rows found. Positives are searched
for in that way, then, for each of an anchor's positives' scores, the negatives in the annulus of the scores allowed.

A segment's rows are dealt out in blocks, anchors in groups, so what one task holds is bounded: BLOCK rows and ASKING
anchors. Pivots are fitted to a bounded sample; every row is in the index, and results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import FEW, stored, table

#: Positives of an anchor, negatives of a positive, and the percentages of the positive's score that a negative's lies between.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Rows that pivots are fitted to: those of the least hashes.
SAMPLE = 20_000
#: Rows that a segment has about, and the most pivots and rings of a pivot.
SEGMENT, PIVOTS, RINGS = 2_048, 64, 16
#: Rows that the first interval of a search has at least.
FIRST = 4_096
#: Rows of a segment and anchors that meet in a task.
BLOCK, ASKING = 16_384, 2_048
#: Components are whole numbers within this, so scores and their hundredfold fit a long.
LARGEST = 1 << 20
#: Stands for a null id, which comes last among ties.
_NONE = (1 << 63) - 1
#: Distances are taken for uncertain by so much of the largest norm.
_SLACK = 1e-6


class Index(NamedTuple):
    """The pivots and the segments' intervals: at most PIVOTS * RINGS + 1 of these. Segment -1 has the rows of other dimensions.

    first, block and asking are FIRST, BLOCK and ASKING.
    """

    pivots: np.ndarray
    borders: np.ndarray  # of rings, a row a pivot
    norm2: float  # the largest
    segment: np.ndarray
    least: np.ndarray
    most: np.ndarray
    rows: np.ndarray
    anchors: np.ndarray
    first: int
    block: int
    asking: int

    @property
    def dim(self) -> int:
        return self.pivots.shape[1] - 1

    def blocks(self, i: int) -> int:
        return -(-int(self.rows[i]) // self.block)


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dim)


def _lengths(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().to_numpy(zero_copy_only=False)


def _augmented(rows: np.ndarray, norm2: float) -> np.ndarray:
    rows = rows.astype(np.float64)
    return np.hstack((rows, np.sqrt(np.maximum(norm2 - (rows * rows).sum(axis=1), 0.0))[:, None]))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0.0))


def fit(sample: np.ndarray, norm2: float, rows: int, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Pivots by k-means over a sample, and the borders of their rings: quantiles of its distances."""
    wanted = max(1, rows // SEGMENT)
    n = max(1, min(PIVOTS, len(sample), round((2 * wanted) ** 0.5)))
    rings = max(1, min(RINGS, -(-wanted // n)))
    points = _augmented(sample, norm2)
    pivots = points[np.linspace(0, len(points) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        home = _apart(points, pivots).argmin(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, home, points)
        count = np.bincount(home, minlength=n)[:, None]
        pivots = np.where(count > 0, sums / np.maximum(count, 1), pivots)
    far = _apart(points, pivots)
    home, far = far.argmin(axis=1), far.min(axis=1)
    at = np.arange(1, rings) / rings
    return pivots, np.array([np.quantile(far[home == i], at) if (home == i).any() else np.zeros(rings - 1) for i in range(n)]).reshape(n, rings - 1)


def _keyed(pivots: np.ndarray, borders: np.ndarray, norm2: float):
    """Adds segment and far, the distance to its pivot, to rows that end with v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, rings = pivots.shape[1] - 1, borders.shape[1] + 1
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            segment, far = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            mine = np.flatnonzero(_lengths(lists) == dim)
            if len(mine):
                apart = _apart(_augmented(_matrix(lists.take(pa.array(mine)), dim), norm2), pivots)
                home, near = apart.argmin(axis=1), apart.min(axis=1)
                segment[mine], far[mine] = home * rings + (borders[home] < near[:, None]).sum(axis=1), near
            yield batch.append_column("segment", pa.array(segment)).append_column("far", pa.array(far))

    return run


def index(rows: DataFrame, anchor: Column) -> tuple[DataFrame, Index]:
    """The rows (vec_id, label, v) with segment and far, stored by key; and the index."""
    norm2 = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(norm2).alias("norm2"))
    main = sizes.orderBy(F.desc("n"), "dim").first()
    dim, n, largest = (main["dim"], main["n"], float(main["norm2"])) if main else (0, 0, 0.0)
    sample = rows.filter(F.size("v") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column("v")
    sample = _matrix(sample.combine_chunks(), dim) if n else np.zeros((1, 0))
    pivots, borders = fit(sample, largest, n)
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    placed = rows.mapInArrow(_keyed(pivots, borders, largest), f"{kinds}, segment int, far double")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(placed.repartitionByRange(parts, "segment", "far").sortWithinPartitions("segment", "far"))
    found = placed.groupBy("segment").agg(F.min("far"), F.max("far"), F.count(F.lit(1)), F.count_if(anchor)).orderBy("segment").collect()
    columns = [np.array(c) for c in zip(*found, strict=True)] or [np.zeros(0)] * 5
    return placed, Index(pivots, borders, largest, *columns, FIRST, BLOCK, ASKING)


def _chosen(ix: Index, q: np.ndarray, wants: list[list[dict]], again: bool) -> Iterator[np.ndarray]:
    """For each anchor of the index's dimension the places of the segments to scan: of the first interval, or (again) of what it has to expand by."""
    mine = ix.segment >= 0
    q2 = (q * q).sum(axis=1)
    apart = _apart(np.hstack((q, np.zeros((len(q), 1)))), ix.pivots)
    slack = _SLACK * (ix.norm2**0.5 + q2**0.5 + 1.0)
    rings = ix.borders.shape[1] + 1
    pivot = np.where(mine, ix.segment // rings, 0)

    for i, bands in enumerate(wants):
        d = apart[i, pivot]
        low = np.maximum(np.maximum(ix.least - d, d - ix.most), 0.0) - slack[i]
        high = d + ix.most + slack[i]
        at = lambda score: max(q2[i] + ix.norm2 - 2.0 * score, 0.0) ** 0.5  # noqa: B023, E731
        out = np.zeros(len(mine), bool)
        for band in bands:
            start = 0.0 if band["hi"] is None else at(band["hi"])
            end = np.inf if band["lo"] is None else at(band["lo"])
            key = np.maximum(low, start - slack[i])
            can = np.flatnonzero(mine & (high >= start - slack[i]) & (low <= end + slack[i]))
            can = can[np.lexsort((ix.segment[can], key[can]))]
            first = can[np.cumsum(ix.rows[can]) - ix.rows[can] < ix.first]
            if not again:
                out[first] = True
                continue
            # Rows further away than the k-th best can't take its place; where there are fewer than k, all up to the end can come in.
            bound = end if band["reach"] is None else at(band["reach"])
            out[can[key[can] <= bound + slack[i]]] = True
        if again:
            done = np.zeros(len(mine), bool)
            done[next(_chosen(ix, q[i : i + 1], [bands], False))] = True
            out &= ~done
        yield np.flatnonzero(out)


def _asks(ix: Index, again: bool):
    """Anchors (anchor_id, tag, label, v, segment, hash, wants) -> a row for each block of each segment to scan, with the anchors' group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto = np.cumsum(ix.anchors) - ix.anchors
        for batch in batches:
            lists = batch.column("v")
            home = np.searchsorted(ix.segment, batch.column("segment").to_numpy())
            group = (upto[home] + batch.column("hash").to_numpy() % np.maximum(ix.anchors[home], 1)) // ix.asking
            chosen: list[np.ndarray] = [np.zeros(0, np.int64)] * batch.num_rows
            mine = np.flatnonzero(_lengths(lists) == ix.dim)
            other = np.flatnonzero(_lengths(lists) != ix.dim)
            if len(mine):
                wants = batch.column("wants").take(pa.array(mine)).to_pylist()
                for i, x in zip(mine, _chosen(ix, _matrix(lists.take(pa.array(mine)), ix.dim).astype(np.float64), wants, again), strict=True):
                    chosen[i] = x
            for i in other if not again else ():
                chosen[i] = np.flatnonzero(ix.segment < 0)
            blocks = [ix.blocks(j) for j in range(len(ix.segment))]
            at = [(i, j, b) for i, x in enumerate(chosen) for j in x.tolist() for b in range(blocks[j])]
            for k in range(0, len(at), 4096):
                i, j, b = map(np.array, zip(*at[k : k + 4096], strict=True))
                some = batch.select(["anchor_id", "tag", "label", "v", "wants"]).take(pa.array(i))
                columns = [*some.columns, pa.array(ix.segment[j].astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(group[i].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=[*some.schema.names, "segment", "block", "grp"])

    return run


def _best(same: bool, k: int):
    """A block's rows and a group's anchors -> the k best rows of each band of each anchor."""

    def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        a, b = q.astype(np.float64), x.astype(np.float64)
        if (a * a).sum(axis=1).max(initial=0) * (b * b).sum(axis=1).max(initial=0) < 2.0**104:
            return (a @ b.T).astype(np.int64)  # all sums are whole numbers that a double holds
        return q @ x.T

    def run(key: tuple, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        rows, anchors = rows.combine_chunks(), anchors.combine_chunks()
        lists, asked = (t.column("v").combine_chunks() for t in (rows, anchors))
        ids, labels = (rows.column(c).to_numpy() for c in ("vec_id", "label"))
        own, tags, theirs = (anchors.column(c).to_numpy() for c in ("anchor_id", "tag", "label"))
        wants = anchors.column("wants").to_pylist()
        out: list[tuple] = []
        sizes, dims = _lengths(lists), _lengths(asked)
        for dim in np.unique(dims).tolist():
            at, who = np.flatnonzero(sizes == dim), np.flatnonzero(dims == dim)
            if not len(at):
                continue
            x, q = _matrix(lists.take(pa.array(at)), dim), _matrix(asked.take(pa.array(who)), dim)
            id_, label = ids[at], labels[at]
            for n in range(0, len(who), 256):
                for i, s in zip(who[n : n + 256], scores(q[n : n + 256], x), strict=True):
                    may = np.flatnonzero(((label == theirs[i]) == same) & (id_ != own[i]))
                    for band, want in enumerate(wants[i]):
                        hi, lo = want["hi"], want["lo"]
                        some = may
                        if hi is not None:
                            some = may[(s[may] <= hi) & (s[may] >= lo)]
                        if len(some) > k:
                            some = some[s[some] >= np.partition(s[some], len(some) - k)[len(some) - k]]
                        some = some[np.lexsort((id_[some], -s[some]))[:k]]
                        out += [(own[i], tags[i], band, a, b) for a, b in zip(id_[some].tolist(), s[some].tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["anchor_id", "tag", "band", "vec_id", "score"])

    return run


_BAND = ["anchor_id", "tag", "band"]


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy(*_BAND).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _scan(placed: DataFrame, ix: Index, anchors: DataFrame, same: bool, k: int, again: bool) -> DataFrame:
    given = ", ".join(f"{c} {t}" for c, t in anchors.dtypes if c not in ("segment", "hash"))
    asks = stored(anchors.mapInArrow(_asks(ix, again), f"{given}, segment int, block int, grp long"))
    key = ["segment", "block", "grp"]
    pairs = asks.select(*key).distinct()
    pairs = F.broadcast(pairs) if pairs.limit(FEW + 1).count() <= FEW else pairs
    sizes = {int(s): ix.blocks(i) for i, s in enumerate(ix.segment)}
    blocks = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[F.col("segment")] if sizes else F.lit(1)
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int")).join(pairs, ["segment", "block"])
    met = dealt.select("vec_id", "label", "v", *key).groupBy(*key).cogroup(asks.toDF(*asks.columns).groupBy(*key))
    return met.applyInArrow(_best(same, k), "anchor_id long, tag long, band int, vec_id long, score long")


def search(placed: DataFrame, ix: Index, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor_id, tag, band, vec_id, score, rank): the k best rows of each band of the anchors' `wants`.

    wants are an array of (hi, lo): scores allowed, both inclusive, or both null. Rows have the anchor's label
    (same) or another one, and never its id. Higher scores come first, then lesser ids.
    """
    anchors = stored(anchors.withColumn("wants", F.transform("wants", lambda w: F.struct(w["hi"].cast("long").alias("hi"), w["lo"].cast("long").alias("lo"), F.lit(None).cast("long").alias("reach")))))
    first = stored(_top(_scan(placed, ix, anchors, same, k, False), k))
    reach = first.groupBy("anchor_id", "tag").agg(F.collect_list(F.when(F.col("rank") == k, F.struct("band", "score"))).alias("ends"))  # one a band at most
    met = anchors.join(reach, ["anchor_id", "tag"], "left")
    end = lambda i: F.get(F.filter("ends", lambda e: e["band"] == i), F.lit(0))["score"]
    wider = met.withColumn("wants", F.transform("wants", lambda w, i: F.struct(w["hi"].alias("hi"), w["lo"].alias("lo"), end(i).alias("reach")))).select(*anchors.columns)
    return stored(_top(first.drop("rank").unionByName(_scan(placed, ix, wider, same, k, True)), k))


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows have vec_id long, label long and v array<long> (whole numbers within LARGEST). The rows that `anchor` holds for
    are anchors, repeated ones once; their positives are the first `positives` rows of their label, their negatives the
    first `negatives` rows of another label with low % to high % of the positive's score. Rows of the anchor's id are
    never among them; other repeated rows stand for themselves. Rows meet rows of their own dimension only; an empty
    vector scores 0. A null id comes last among ties and is returned as null. Negative scores of positives have no
    negatives, and an anchor without positives no rows.
    """
    rows = rows.select(F.coalesce("vec_id", F.lit(_NONE)).alias("vec_id"), "label", "v")
    anchor = anchor & (F.col("vec_id") != _NONE)
    placed, ix = index(rows, anchor)
    mark = F.xxhash64("label", "v")
    anchors = placed.filter(anchor).select(F.col("vec_id").alias("anchor_id"), mark.alias("tag"), "label", "v", "segment", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)).alias("hash"))
    anchors = stored(anchors.dropDuplicates(["anchor_id", "tag"]))
    free = F.struct(F.lit(None).cast("long").alias("hi"), F.lit(None).cast("long").alias("lo"))
    found = search(placed, ix, anchors.withColumn("wants", F.array(free)), True, positives)
    liked = found.select("anchor_id", "tag", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    band = F.struct(F.expr(f"{high} * positive_score div 100").alias("hi"), F.expr(f"({low} * positive_score + 99) div 100").alias("lo"), "positive_score")
    wants = liked.filter("positive_score >= 0").groupBy("anchor_id", "tag").agg(F.sort_array(F.collect_set(band), asc=False).alias("wants"))  # `positives` at most
    wants = wants.withColumn("wants", F.filter("wants", lambda w: w["hi"] >= w["lo"])).filter("size(wants) > 0")
    asking = stored(anchors.join(wants, ["anchor_id", "tag"]))
    against = search(placed, ix, asking, False, negatives).select(*_BAND, "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    bands = asking.select("anchor_id", "tag", F.posexplode("wants").alias("band", "w")).select(*_BAND, F.col("w.positive_score").alias("positive_score"))
    met = against.join(bands, _BAND).join(liked, ["anchor_id", "tag", "positive_score"])
    shown = lambda c: F.nullif(F.col(c), F.lit(_NONE)).alias(c)
    return met.select("anchor_id", shown("positive_id"), "rank", shown("negative_id"), "positive_score", "negative_score")


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): v is floor(256 * x) of each component, within LARGEST; every seventh id's label is the next one.

    Rows with a null label, vector or component, or a component that isn't finite, take no part.
    """
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    some = vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(sound)
    label = F.col("label").cast("long")
    near = lambda x: F.least(F.greatest(F.lit(256.0) * x.cast("double"), F.lit(-float(LARGEST))), F.lit(float(LARGEST)))
    return some.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform("embedding", lambda x: F.floor(near(x)).cast("long")).alias("v"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(whole_numbers(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


SQL = f"""
with r as (select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end l, list_transform(embedding, lambda x: floor(256 * x::double)) v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id a, b.vec_id b, a.l = b.l same, list_inner_product(a.v, b.v)::bigint score from r a join r b on a.vec_id % 50 = 0 and b.vec_id <> a.vec_id and len(a.v) = len(b.v)),
p as (select a, b, score from s where same qualify row_number() over (partition by a order by score desc, b) <= {POSITIVES})
select p.a anchor_id, p.b positive_id, (row_number() over (partition by p.a, p.b order by s.score desc, s.b))::int "rank", s.b negative_id, p.score positive_score, s.score negative_score
from p join s on s.a = p.a and not s.same and {LOW} * p.score <= 100 * s.score and 100 * s.score <= {HIGH} * p.score
qualify "rank" <= {NEGATIVES}
"""
