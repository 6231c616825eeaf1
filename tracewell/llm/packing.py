"""Packing documents into training sequences: shortest pack first over the length histogram.

A document of more than a sequence gives whole sequences; what is left of it (its rest) is packed with others' rests.
Rests are counted by length, at most one count a length. Lengths are placed longest first: each goes to the shortest
pack that it fits, a new pack where it fits none. Packs of one filling are one pattern with a count, so placing costs
steps by patterns, never by documents. Documents may be cut, so the shortest packs are then given up, and their tokens,
in one line, fill the room of the others; a pack of 2^k tokens needs no padding and stays as it is. Less than a sequence
is left, which is cut into powers of two. So nothing is padded, and only given up packs' documents are cut.

A pattern's places are runs of ranks within a length. Each document has its rank: the number of documents of its length
before it (by partition of the input, then in it), so patterns and documents join without another shuffle of tokens.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import checked_join, stored, table

#: The vocabulary file that the query reads.
MODEL = "/opt/tokenizers/word_bpe_49k.json"
#: The id that ends a document.
END = 1
#: Tokens of a sequence.
SIZE = 2_048
#: Chunks whose ids a worker remembers; then it starts anew.
REMEMBERED = 1_500_000
#: Bytes of text or tokens that a task works on together, and chunks of a call.
_BATCH, _CHUNKS = 4_000_000, 5_000

_models: dict[str, Callable[[list[bytes]], list[bytes]]] = {}


def tokenizer(model: str) -> Callable[[list[bytes]], list[bytes]]:
    """A function from UTF-8 texts to their ids, four bytes each with the lowest first; `model` is a vocabulary file's content.

    No pre-token of this kind of vocabulary holds white space and no normal form reaches over it, so what stands between
    white space is encoded once and remembered. The texts' unknown chunks are encoded in one call, between special tokens.
    """
    if model in _models:
        return _models[model]
    encoder = Tokenizer.from_str(model)
    border, mark = max(((i, t.content) for i, t in encoder.get_added_tokens_decoder().items()), default=(-1, ""))
    known: dict[bytes, bytes] = {}

    def learn(chunks: list[bytes]) -> None:
        plain = [c for c in chunks if b"<|" not in c] if mark else []
        for at in range(0, len(plain), _CHUNKS):
            some = plain[at : at + _CHUNKS]
            (found,) = encoder.encode_batch_fast([mark.join([c.decode() for c in some])], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            cuts, found = 4 * np.flatnonzero(ids == border), ids.tobytes()
            for c, i, j in zip(some, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(found)], strict=True):
                known[c] = found[i:j]
        for c in chunks:
            if c not in known:
                known[c] = np.array(encoder.encode(c.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def ids(texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        if len(known) > REMEMBERED:
            known.clear()
        learn(list(set(chain.from_iterable(split)).difference(known)))
        return [b"".join(map(known.__getitem__, chunks)) for chunks in split]

    _models.clear()
    _models[model] = ids
    return ids


def _groups(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Places (from, to) of rows whose sizes come to `most` together, or a single row's."""
    start = held = at = 0
    for at, n in enumerate(sizes, 1):
        held += n
        if held > most:
            yield start, at
            start, held = at, 0
    if at > start:
        yield start, at


class Pattern(NamedTuple):
    """`count` packs of `filled` tokens, each holding documents of the same lengths: (length, times), longest first."""

    filled: int
    count: int
    held: tuple[tuple[int, int], ...]


def shortest_first(histogram: dict[int, int], size: int = SIZE) -> list[Pattern]:
    """Patterns of the histogram's lengths, uncut: longest lengths first, each document into the shortest pack that it fits.

    A length splits one pattern at most and opens two at most, so there are at most three patterns a length, however
    many documents there are.
    """
    packs: list[tuple[int, int, Pattern]] = []
    number = 0

    def push(filled: int, count: int, held: tuple[tuple[int, int], ...]) -> None:
        nonlocal number
        if count:
            number += 1
            heapq.heappush(packs, (filled, number, Pattern(filled, count, held)))

    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        while left and packs and packs[0][0] + length <= size:
            filled, count, held = heapq.heappop(packs)[2]
            n = min(count, left)
            more = (*held[:-1], (length, held[-1][1] + 1)) if held[-1][0] == length else (*held, (length, 1))
            push(filled + length, n, more)
            push(filled, count - n, held)
            left -= n
        most = size // length
        push(most * length, left // most, ((length, most),))
        push(left % most * length, int(left % most > 0), ((length, left % most),))
    return [p for _, _, p in sorted(packs)]


class Place(NamedTuple):
    """Where the documents of a length go whose ranks follow `rank`: one to each pack of a pattern.

    In a pack that is kept they are whole, at `offset` of the sequences from `sequence` on. In a pack that is given up
    (`stride` tokens long) they are tokens of the line, the first of them `offset` tokens after `sequence`.
    """

    rank: int
    sequence: int
    offset: int
    stride: int


class Room(NamedTuple):
    """Tokens of the line from `start` on fill `width` tokens each in `count` sequences from `sequence` on, at `offset`."""

    start: int
    width: int
    count: int
    sequence: int
    offset: int


class Plan(NamedTuple):
    """Where rests go. Its size follows the number of lengths: a place for each document of a pattern, a room for each pattern."""

    places: dict[int, tuple[list[int], list[Place]]]
    rooms: list[Room]
    sequences: int

    def of(self, rest: int, rank: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of a document's pieces."""
        ranks, places = self.places[rest]
        place = places[bisect_right(ranks, rank) - 1]
        nth = rank - place.rank
        if not place.stride:
            yield 0, rest, place.sequence + nth, place.offset
            return
        first = at = place.sequence + nth * place.stride + place.offset
        i = bisect_right(self.rooms, at, key=lambda r: r.start) - 1
        while at < first + rest:
            room = self.rooms[i]
            nth, inside = divmod(at - room.start, room.width)
            if nth >= room.count:
                i += 1
                continue
            n = min(room.width - inside, first + rest - at)
            yield at - first, n, room.sequence + nth, room.offset + inside
            at += n


def planned(histogram: dict[int, int], size: int = SIZE) -> Plan:
    """The plan of a histogram of rests (1 to size - 1).

    Packs filled to `size` or a power of two are kept as they are. Of the others the longest are kept and the shortest
    given up: the documents of the latter stand in a line, whose tokens fill the room of the former, just as many as
    they have room for. What is left of the line, less than a sequence, gives sequences by its binary digits.
    """
    patterns = sorted(shortest_first(histogram, size), reverse=True)
    whole = [p for p in patterns if p.filled & (p.filled - 1) == 0 or p.filled == size]
    partly = [p for p in patterns if p not in whole]
    room, line = 0, sum(p.filled * p.count for p in partly)
    kept, given = [], []
    for p in partly:
        # A pack that is kept takes its tokens out of the line and has room for more.
        n = min(p.count, (line - room) // size)
        room, line = room + n * (size - p.filled), line - n * p.filled
        kept.append(p._replace(count=n))
        given.append(p._replace(count=p.count - n))
    used: Counter[int] = Counter()
    places, rooms = defaultdict(list), []
    sequence = at = 0
    for p, keep in [*((p, True) for p in (*whole, *kept)), *((p, False) for p in given)]:
        if not p.count:
            continue
        offset = 0
        for length, times in p.held:
            for _ in range(times):
                places[length].append(Place(used[length], sequence, offset, 0) if keep else Place(used[length], at, offset, p.filled))
                used[length] += p.count
                offset += length
        if not keep:
            at += p.count * p.filled
            continue
        if p.filled & (p.filled - 1) and p.filled < size:
            start = rooms[-1].start + rooms[-1].width * rooms[-1].count if rooms else 0
            rooms.append(Room(start, size - p.filled, p.count, sequence, p.filled))
        sequence += p.count
    left = line - room
    for bit in reversed(range(left.bit_length())):
        if left >> bit & 1:
            rooms.append(Room(line - (left & ((2 << bit) - 1)), 1 << bit, 1, sequence, 0))
            sequence += 1
    return Plan({k: ([x.rank for x in v], v) for k, v in places.items()}, rooms, sequence)


def _tokens(model, size: int, end: int):
    """doc_id, text -> doc_id, part, rest, nth (documents of this rest before it in the partition), before (whole sequences before it), whole, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = tokenizer(model.value), TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        whole, last = 0, np.array([end], "<u4").tobytes()

        def table_of(rows: list[tuple], keys: pa.Array) -> pa.RecordBatch:
            rests, nths, befores, wholes, ids = zip(*rows, strict=True)
            n = len(rows)
            columns = [keys, pa.array([part] * n, pa.int32()), pa.array(rests, pa.int32()), pa.array(nths, pa.int64()), pa.array(befores, pa.int64()), pa.array(wholes, pa.int64()), pa.array(ids, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "rest", "nth", "before", "whole", "ids"])

        for batch in batches:
            keys, texts = batch.columns
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for i, j in _groups(sizes, _BATCH):
                rows = []
                for ids in encode([x or b"" for x in texts.slice(i, j - i).to_pylist()]):
                    n, rest = divmod(len(ids) // 4 + 1, size)
                    rows.append((rest, seen[rest], whole, n, ids + last))
                    seen[rest] += 1
                    whole += n
                yield table_of(rows, keys.slice(i, j - i))

    return run


def _cut(plan, size: int):
    """Documents with their places -> their pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = plan.value
        for batch in batches:
            keys, *columns = batch.columns
            for i, j in _groups(pc.binary_length(columns[-1]).to_pylist(), _BATCH):
                found, rows = [], []
                for at, (rest, rank, first, ids) in enumerate(zip(*(c.slice(i, j - i).to_pylist() for c in columns), strict=True), i):
                    n = len(ids) // 4
                    whole = n // size
                    pieces = [(k * size, size, where.sequences + first + k, 0) for k in range(whole)]
                    if rest:
                        pieces += [(whole * size + start, *piece) for start, *piece in where.of(rest, rank)]
                    for start, length, sequence, offset in pieces:
                        found.append(at)
                        rows.append((start, length, ids[4 * start : 4 * (start + length)], n, sequence, offset))
                kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 3]
                out = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(found, pa.int64())), *out], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, model: str, text: str = "text", size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, start, length, ids (unsigned, four bytes each with the lowest first), doc_tokens, sequence_id, offset of every piece.

    `model` is a vocabulary file's content; each document's ids are followed by the id `end`, so a null or empty text
    has one token. Every token is in one piece, every sequence is filled without gaps to `size` or to a power of two.
    Rows stand for themselves: repeated rows and null ids are packed like any other, equal lengths are told apart by
    their place in the input. Reruns over the same partitions agree. No documents give no rows. doc_id may be of any
    type; other columns aren't read.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    narrow = docs.select("doc_id", F.col(text).cast("binary").alias("text"))
    kind = narrow.dtypes[0][1]
    rows = stored(narrow.mapInArrow(_tokens(held, size, end), f"doc_id {kind}, part int, rest int, nth long, before long, whole long, ids binary"))
    counts = stored(rows.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("n"), F.sum("whole").alias("whole")))
    histogram = {r["rest"]: r["n"] for r in counts.filter("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # size - 1 rows at most
    plan = spark.sparkContext.broadcast(planned(histogram, size))
    upto = lambda *by: Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy("part").agg(F.sum("whole").alias("whole"))
    parts = parts.select("part", F.coalesce(F.sum("whole").over(upto()), F.lit(0)).alias("first"))  # a row a partition
    starts = counts.select("part", "rest", "n", F.coalesce(F.sum("n").over(upto("rest")), F.lit(0)).alias("ranks")).join(parts, "part")
    met = checked_join(rows, stored(starts), ["part", "rest"], "n", sum(histogram.values()))
    met = met.select("doc_id", "rest", (F.col("ranks") + F.col("nth")).alias("rank"), (F.col("first") + F.col("before")).alias("first"), "ids")
    return met.mapInArrow(_cut(plan, size), f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def read_model(path: str = MODEL) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), read_model())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
