"""Document fingerprints by locally consistent parsing.

A text's code points are named level by level. Within a stretch of unlike neighbours, coin tossing turns
each name and its left neighbour into a label (the place of their lowest differing bit and its value), again
until labels are below six; a local maximum of the labels starts a phrase. A run of one name is cut into
twos, the last of them three where the run is odd. A phrase's name is a hash of the names in it. A border
depends on a bounded neighbourhood only, so equal substrings have equal phrases inside, wherever they stand.

The fingerprint keeps, for each level of LEVELS, the least hashes of the text's phrases, a phrase's second
and later turns under hashes of their own; likeness is the share in common, as in a bottom-k sketch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import stored, table

#: Levels whose phrases go into a fingerprint: about 6 and 15 characters each.
LEVELS = (2, 3)
#: Names kept of each level.
KEPT = 32
#: Rounds that bring labels of 64-bit names below six.
ROUNDS = 4
#: Characters that are parsed together.
_SLICE = 2_000_000
#: Ranges of documents for each task, and sampled ids that tell a range's borders.
RANGES, SAMPLED = 3, 20
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _Q
    return x ^ (x >> np.uint64(29))


def _toss(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round: a label for each name from its lowest bit unlike its left neighbour's, and that bit."""
    one, left = names.dtype.type(1), np.concatenate((names[:1], names[:-1]))
    left[first] = ~names[first]  # a text's first name tosses against its own complement
    unlike = names ^ left
    low = np.bitwise_count((unlike & (~unlike + one)) - one)
    bit = ((names >> low.astype(names.dtype)) & one).astype(np.uint8)
    return 2 * low + bit


def _level(names: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level's names and texts. names of one text stand together; text has their numbers."""
    n = len(names)
    new = np.ones(n, bool)
    np.not_equal(text[1:], text[:-1], out=new[1:])
    like = np.zeros(n + 1, bool)  # like the name before, in one text
    like[1:-1] = (names[1:] == names[:-1]) & ~new[1:]
    run = like[:-1] | like[1:]
    label, first = names, np.flatnonzero(new)
    for _ in range(ROUNDS):
        label = _toss(label, first)
    begin = new.copy()
    if n > 2:
        peak = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
        alone = run[:-2] | run[1:-1] | run[2:] | new[1:-1] | new[2:] | new[:-2]
        begin[1:-1] |= peak & ~alone
    change = np.flatnonzero(run[1:] != run[:-1]) + 1
    begin[change] = True
    starts = np.flatnonzero(run & ~like[:-1])
    if len(starts):
        begin[starts] = True
        inside = np.flatnonzero(run)
        length = np.diff(np.concatenate((np.searchsorted(inside, starts), [len(inside)])))
        turn = inside - np.repeat(starts, length)
        begin[inside] = (turn % 2 == 0) & ((turn == 0) | (turn + 1 < np.repeat(length, length)))
        # A name alone before a run is one phrase with the run's first names.
        lone = starts[starts > 0]
        lone = lone[begin[lone - 1] & ~run[lone - 1] & ~new[lone]]
        begin[lone] = False
    wide = names.astype(np.uint64)
    before = wide[:-1] * _Q
    before[begin[1:]] = 0
    wide *= _P
    wide[1:] += before
    at = np.flatnonzero(begin)
    return _mix(np.add.reduceat(_mix(wide), at)), text[at]


def _turns(names: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of phrases, each turn of a phrase in a text under its own; sorted by text, then hash."""
    order = np.lexsort((names, text))
    names, text = names[order], text[order]
    again = np.concatenate(([False], (names[1:] == names[:-1]) & (text[1:] == text[:-1])))
    place = np.arange(len(names))
    turn = place - np.maximum.accumulate(np.where(again, 0, place))
    short = (_mix(names + turn.astype(np.uint64) * _P) >> np.uint64(32)).astype(np.uint32)
    both = np.sort(text.astype(np.uint64) << np.uint64(32) | short)
    return (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), (both >> np.uint64(32)).astype(np.int64)


def fingerprints(texts: list[str]) -> list[str]:
    """A fingerprint for each text: for each level, its least names in hex, levels parted by a slash; '' for ''."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if not sizes.sum():
        return [""] * len(texts)
    names = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    out: list[list[str]] = [[] for _ in texts]
    for level in range(1, max(LEVELS) + 1):
        names, text = _level(names, text)
        if level in LEVELS:
            s, t = _turns(names, text)
            edge = np.searchsorted(t, np.arange(len(texts) + 1))
            # Hex digits of all kept names at once, eight for each.
            digits = s.astype(">u4").tobytes().hex()
            for i, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
                out[i].append(digits[8 * a : 8 * min(b, a + KEPT)])
    return ["/".join(x) if n else "" for x, n in zip(out, sizes.tolist(), strict=True)]


def likeness(one: str, other: str) -> float:
    """0 to 1: the mean over levels of the share in common of the least names of both; 1 for equal fingerprints."""
    if one == other:
        return 1.0
    if not one or not other:
        return 0.0
    total = 0.0
    for a, b in zip(one.split("/"), other.split("/"), strict=True):
        a, b = ({x[i : i + 8] for i in range(0, len(x), 8)} for x in (a, b))
        least = sorted(a | b)[: KEPT if max(len(a), len(b)) >= KEPT else None]
        total += sum(x in a and x in b for x in least) / len(least)
    return total / len(LEVELS)


def fingerprint(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns to keep and fingerprint. A null text counts as empty and has an empty fingerprint."""
    narrow = docs.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in narrow.dtypes[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *keys, texts = batch.columns
            yield pa.RecordBatch.from_arrays([*keys, pa.array(fingerprints([x or "" for x in texts.to_pylist()]), pa.string())], names=[*batch.schema.names[:-1], "fingerprint"])

    return narrow.mapInArrow(run, f"{kinds}, fingerprint string")


_ROW = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by the first as many of the one that follows."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _rows(ids: pa.Array, texts: list[str], following: list[str]) -> pa.RecordBatch:
    """The result's rows for texts and what follows each; a text that follows another is parsed once."""
    new = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    own = fingerprints([*texts, following[-1]] if texts else [])
    theirs = fingerprints(new)
    sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in new]
    cols = [list(map(len, texts)), sha, own[:-1], theirs, list(map(likeness, own, theirs)), list(map(likeness, own, own[1:]))]
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, _KINDS, strict=True))], names=["doc_id", *_NAMES])


_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, doc_id, text), sorted: the result for all of a part but its last document, which another part's first follows."""
    part, ids, texts, total = None, [], [], 0

    def found() -> pa.RecordBatch:
        return _rows(pa.array(ids[:-1], kind), texts[:-1], texts[1:])

    for batch in batches:
        kind = batch.schema.types[1]
        for p, i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != part or (total >= _SLICE and len(texts) > 1):
                if len(texts) > 1:
                    yield found()
                ids, texts = (ids[-1:], texts[-1:]) if p == part else ([], [])
                part, total = p, sum(map(len, texts))
            ids.append(i)
            texts.append(t)
            total += len(t)
    if len(texts) > 1:
        yield found()


def _compare_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, (text, following) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
            yield _rows(batch.column(0).slice(k, 1), [text], [following])


def _part(ids: DataFrame, n: int) -> Column:
    """The number of the range, of about n, that a doc_id falls into. Borders are sampled once and then fixed."""
    known = ids.filter("doc_id is not null")
    share = min(1.0, SAMPLED * n / max(1, known.count()))
    seen = sorted({r.doc_id for r in known.sample(share, 7).collect()})
    borders = seen[:: max(1, -(-len(seen) // n))][1:]
    if not borders:
        return F.lit(0)
    width = max(1, int(len(borders) ** 0.5))
    integral = isinstance(ids.schema["doc_id"].dataType, IntegralType)
    array = lambda xs: F.expr(f"array({', '.join(f'{x}L' for x in xs)})") if integral else F.array(*map(F.lit, xs))
    upto = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col("doc_id")))
    groups = [borders[k : k + width] for k in range(0, len(borders), width)]
    group = upto(array([g[0] for g in groups])) - 1
    inside = upto(F.get(F.array(*map(array, groups)), group))
    return F.when(F.col("doc_id").isNull() | (group < 0), 0).otherwise(group * width + inside)


def edit_likeness(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each document beside its edited text and the next document, by doc_id.

    The edited text has its last floor(n / 4) code points replaced by the first as many of the next document;
    the first follows the last. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next. A null text counts as empty; two empty texts have likeness 1. Null ids come
    first; rows of one id stand by text and in one range. A lone row follows itself. No rows give no rows.

    Texts are dealt out once, by ranges of doc_id with fixed borders. Of each range the last text meets the next
    range's first: those two a range are looked up by their ids beside it.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = _part(docs.select("doc_id"), RANGES * n).alias("part")
    rows = docs.select(part, "doc_id", F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {kind}, {_ROW}"
    inner = rows.repartition(n, "part").sortWithinPartitions("part", "doc_id", "_text").mapInArrow(_compare, result)
    # One narrow row a range.
    place = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")
    ends = stored(docs.select(part, "doc_id").groupBy("part").agg(F.min(place)["doc_id"].alias("_first"), F.max(place)["doc_id"].alias("_last")))
    by_part = Window.orderBy("part")
    after = F.coalesce(F.lead("part").over(by_part), F.first("part").over(by_part))
    order = ends.select("part", F.col("_last").alias("doc_id"), after.alias("_after"))
    # The texts at a range's ends.
    at = rows.join(F.broadcast(ends), "part")
    at = at.select("part", F.col("doc_id").eqNullSafe(F.col("_first")).alias("a"), F.col("doc_id").eqNullSafe(F.col("_last")).alias("b"), "_text").filter("a or b")
    texts = stored(at.groupBy("part").agg(F.min(F.when(F.col("a"), F.col("_text"))).alias("_head"), F.max(F.when(F.col("b"), F.col("_text"))).alias("_tail")))
    heads = texts.select(F.col("part").alias("_after"), "_head")
    last = order.join(texts.select("part", "_tail"), "part").join(heads, "_after").select("doc_id", "_tail", "_head")
    return inner.unionByName(last.mapInArrow(_compare_edges, result))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(table(spark, sf_dir, "documents"))
