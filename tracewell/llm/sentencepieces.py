"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Pieces never hold a blank after another character, so a text falls into chunks (blanks, then what follows
them) that are encoded alone. A chunk's candidate merges wait in an agenda by score, then place; each is
skipped with the dropout's chance by a hash keyed with the seed, the document, its copy, the chunk's place in
it, and the candidate's place and piece. So each occurrence of a word is split anew, yet every run and every
retry of a task gives the same ids.

Splits are remembered by chunk and set of skipped candidates, with the candidates that each met. An occurrence
starts at its chunk's split without dropout; while its own draws skip any of the candidates met, it goes on to the
split that leaves those out too. Where its draws skip no more, that split is what its own merging would give.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hash2, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 20_240_229
#: When so many splits are remembered, all are forgotten.
REMEMBERED = 400_000
_CHUNK = re.compile(r" *[^ \n]+| +|\n")
_BLANK = "▁"
_WHOLE = (1 << 64) - 1
#: Factors of the hash that skips candidates.
_PLACE, _PIECE, _MIX, _END = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0x9FB21C651E98DF25
#: The order of a candidate that is none.
_LAST = (1 << 31) - 1
#: Characters that are encoded together.
_SLICE = 300_000
#: Longer chunks merge by an agenda.
_STEPPED = 64


class _Pairs:
    """Which piece two neighbouring pieces make, and its place in the agenda: a hash table over arrays."""

    def __init__(self, left: list[int], right: list[int], piece: list[int], order: list[int], n: int):
        self.n, keys = np.uint64(n), np.array(left, np.uint64) * np.uint64(n) + np.array(right, np.uint64)
        bits = max(4, len(keys).bit_length() + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, _WHOLE, np.uint64)
        self.piece, self.order = np.zeros(1 << bits, np.int32), np.full(1 << bits, _LAST, np.int32)
        todo, at = np.arange(len(keys)), self._at(keys)
        while len(todo):
            free = self.key[at] == _WHOLE
            slot, who = np.unique(at[free], return_index=True)
            won = todo[free][who]
            self.key[slot], self.piece[slot], self.order[slot] = keys[won], np.array(piece, np.int32)[won], np.array(order, np.int32)[won]
            rest = ~np.isin(todo, won)
            todo, at = todo[rest], at[rest] + 1 & self.mask

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order (_LAST where there is no such piece) and piece."""
        keys = left.astype(np.uint64) * self.n + right.astype(np.uint64)
        at = self._at(keys)
        held = self.key[at]
        rest = np.flatnonzero((held != keys) & (held != _WHOLE))
        while len(rest):
            at[rest] = at[rest] + 1 & self.mask
            held[rest] = k = self.key[at[rest]]
            rest = rest[(k != keys[rest]) & (k != _WHOLE)]
        none = (left < 0) | (right < 0) | (held != keys)
        return np.where(none, _LAST, self.order[at]), self.piece[at]


def _skips(drawn: np.ndarray, salts: np.ndarray, skip: int) -> np.ndarray:
    """Which candidates (by _salts) fall out, under each one's draw."""
    mixed = (drawn ^ salts) * np.uint64(_MIX)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(_END) >> np.uint64(24) & np.uint64(0xFFFFFFFF)) < skip


def _salts(at: np.ndarray, piece: np.ndarray) -> np.ndarray:
    return at.astype(np.uint64) * np.uint64(_PLACE) + piece.astype(np.uint64) * np.uint64(_PIECE)


def _within(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where the numbers of runs are: each run's start and what follows it, run after run."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _draws(keys: np.ndarray, counts: np.ndarray, seed: int) -> np.ndarray:
    """One draw for each place of each text."""
    place = _within(np.zeros(len(counts), np.int64), counts)
    x = np.repeat(keys, counts) ^ np.uint64(xxhash.xxh64_intdigest(str(seed)))
    x = x + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(_PLACE)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Rows:
    """Rows of numbers of unlike lengths, one after another in an array that grows."""

    def __init__(self, kind: type):
        self.data, self.starts, self.sizes = np.empty(1024, kind), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.n = self.end = 0

    def add(self, data: np.ndarray, sizes: np.ndarray) -> None:
        n, end = self.n + len(sizes), self.end + len(data)
        if n > len(self.sizes):
            self.starts, self.sizes = (np.concatenate((x, np.zeros(n, np.int64))) for x in (self.starts, self.sizes))
        if end > len(self.data):
            self.data = np.concatenate((self.data[: self.end], np.empty(end, self.data.dtype)))
        self.data[self.end : end], self.sizes[self.n : n] = data, sizes
        self.starts[self.n : n] = self.end + np.cumsum(sizes) - sizes
        self.n, self.end = n, end

    def places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the numbers of some rows are, and how many each row has."""
        n = self.sizes[rows]
        return _within(self.starts[rows], n), n

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of some rows, and how many each row has."""
        where, n = self.places(rows)
        return self.data[where], n


class _Splits:
    """Splits by number: their chunks, ids, the salts of the candidates that each met, and those that it leaves out."""

    def __init__(self, sign: list[int]):
        self.ids, self.met, self.left_out, self.chars = _Rows(np.int32), _Rows(np.uint64), _Rows(np.uint64), _Rows(np.uint32)
        self.chunk = np.zeros(1024, np.int64)
        self.plain: dict[str, int] = {}
        self.next: dict[int, int] = {}
        self.fixed(np.array(sign, np.int32))

    def chunks(self, new: list[str]) -> np.ndarray:
        """The numbers of new chunks, by which their characters are found."""
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        first = self.chars.n
        self.chars.add(np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32), sizes)
        return np.arange(first, self.chars.n)

    def add(self, chunks: np.ndarray, left_out: np.ndarray, n_left_out: np.ndarray, ids: np.ndarray, n_ids: np.ndarray, met: np.ndarray, n_met: np.ndarray) -> np.ndarray:
        first, end = self.ids.n, self.ids.n + len(chunks)
        if end > len(self.chunk):
            self.chunk = np.concatenate((self.chunk, np.zeros(end, np.int64)))
        self.chunk[first:end] = chunks
        self.left_out.add(left_out, n_left_out)
        self.ids.add(ids, n_ids)
        self.met.add(met, n_met)
        return np.arange(first, end)

    def fixed(self, ids: np.ndarray) -> int:
        """The number of a split that no draw changes."""
        none, zero = np.empty(0, np.uint64), np.zeros(1, np.int64)
        return int(self.add(zero, none, zero, ids, np.array([len(ids)]), none, zero)[0])


class Pieces:
    """A BPE model with byte fallback, read from the bytes of a SentencePiece model file."""

    def __init__(self, model: bytes, dropout: float = DROPOUT, seed: int = SEED):
        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.rank, self.text, self.byte = {}, [], {}
        for i in range(p.get_piece_size()):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            else:
                self.text.append(piece.replace(_BLANK, " ").encode())
                if not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
                    self.rank[piece.replace(_BLANK, " ")] = (-p.get_score(i), i)
        self.skip, self.seed = int(dropout * (1 << 32)), seed
        order = {score: k for k, score in enumerate(sorted({score for score, _ in self.rank.values()}))}
        self.char = np.full(0x110000, -1, np.int32)
        pairs = []
        for piece, (score, i) in self.rank.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
            for k in range(1, len(piece)):
                if piece[:k] in self.rank and piece[k:] in self.rank:
                    pairs.append((self.rank[piece[:k]][1], self.rank[piece[k:]][1], i, order[score]))
        self.pairs = _Pairs(*map(list, zip(*pairs, strict=True)), n=len(self.text))
        self.known = _Splits(self._bytes(_BLANK))

    def _bytes(self, chars: str) -> list[int]:
        return [self.byte[b] for b in chars.encode()]

    def _learn(self, chunks: np.ndarray, left_out: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The numbers of new splits: of chunks by number, and the salts of the candidates that are left out of each.

        They merge in step, each its first candidate, which gives what agendas give. Either all leave out some
        candidate or none does.
        """
        numbers = np.zeros(len(chunks), np.int64)
        lengths, starts = self.known.chars.sizes[chunks], np.cumsum(sizes) - sizes
        below = 0
        for width in (4, 8, 12, 16, 24, 40, _STEPPED):
            picked = np.flatnonzero((lengths > below) & (lengths <= width))
            below = width
            for at in range(0, len(picked), 50_000):
                some = picked[at : at + 50_000]
                given = chunks[some], left_out[_within(starts[some], sizes[some])], sizes[some]
                numbers[some] = self.known.add(*given, *self._in_step(*given, width))
        return numbers

    def _in_step(self, chunks: np.ndarray, without: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, their number for each chunk, salts of the candidates met, and their number for each chunk."""
        n = len(chunks)
        met: list[tuple[np.ndarray, np.ndarray]] = []
        # The salts left out, one row a split; short rows repeat their first.
        most = int(sizes.max(initial=0))
        if most:
            starts = np.cumsum(sizes) - sizes
            left_out = np.repeat(without[starts], most)
            left_out[_within(np.arange(n) * most, sizes)] = without
            left_out = left_out.reshape(n, most)
        codes, lengths = self.known.chars.take(chunks)
        chars = np.zeros(n * width, np.uint32)
        chars[_within(np.arange(n) * width, lengths)] = codes
        chars = chars.reshape(n, width)
        # Places are numbered over all chunks; those beyond a chunk hold no symbol, so they end in no piece.
        there = np.arange(width) < lengths[:, None]
        symbol = np.where(there, self.char[chars], -1).ravel()
        alive = there.ravel()
        after, before = (np.tile(np.arange(d, width + d, dtype=np.int32), n) for d in (1, -1))
        order, piece = np.full(n * width, _LAST, np.int32), np.zeros(n * width, np.int32)

        def look(row: np.ndarray, at: np.ndarray, nxt: np.ndarray) -> None:
            left = row * width + at
            found, p = self.pairs.find(symbol[left], symbol[row * width + nxt])
            if self.skip:
                k = np.flatnonzero(found < _LAST)
                salts, who = _salts(at[k], p[k]), row[k]
                if most:
                    out = (left_out[who] == salts[:, None]).any(axis=1)
                    found[k[out]] = _LAST
                    who, salts = who[~out], salts[~out]
                met.append((who, salts))
            order[left], piece[left] = found, p

        row, at = np.nonzero(there[:, 1:])
        look(row, at, at + 1)
        row, by_row = np.arange(n), order.reshape(n, width)
        while True:
            waiting = by_row[row]
            best = waiting.argmin(axis=1)
            going = waiting[np.arange(len(row)), best] < _LAST
            row, best = row[going], best[going]
            if not len(row):
                break
            first = row * width
            left = first + best
            gone = first + after[left]
            symbol[left] = piece[left]
            alive[gone], order[gone], order[left] = False, _LAST, _LAST
            nxt, prev = after[gone], before[left]
            after[left] = nxt
            has_next, has_prev = np.flatnonzero(nxt < width), np.flatnonzero(prev >= 0)
            before[first[has_next] + nxt[has_next]] = best[has_next]
            ends = np.concatenate((best[has_next], prev[has_prev])), np.concatenate((nxt[has_next], best[has_prev]))
            look(np.concatenate((row[has_next], row[has_prev])), *ends)
        there = alive.reshape(n, width)
        ids, counts = symbol[alive], there.sum(axis=1)
        if (ids < 0).any():  # characters without a piece go as bytes
            rows, at = np.nonzero(there)
            as_bytes = {i: self._bytes(chr(chars[rows[i], at[i]])) for i in np.flatnonzero(ids < 0).tolist()}
            many = np.ones(len(ids), np.int64)
            many[list(as_bytes)] = list(map(len, as_bytes.values()))
            counts = np.bincount(rows, many, n).astype(np.int64)
            ids = np.repeat(ids, many)
            ids[ids < 0] = np.concatenate(list(as_bytes.values()))
        who, salts = (np.concatenate(x) for x in zip(*met, strict=True)) if met else (np.empty(0, np.int64), np.empty(0, np.uint64))
        return ids.astype(np.int32), counts, salts[np.argsort(who, kind="stable")], np.bincount(who, minlength=n)

    def _chunk(self, chunk: str, drawn: int | None) -> bytes:
        """Ids of one chunk, by an agenda."""
        symbols, rank = list(chunk), self.rank
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            if found := rank.get(symbols[i] + symbols[i + 1]):
                agenda.append((found[0], i, i + 1, found[1], 2))
        heapify(agenda)
        while agenda:
            _, left, right, piece, size = heappop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != size:
                continue  # one of the two has grown or gone
            if self.skip and drawn is not None:
                mixed = (drawn ^ (left * _PLACE + piece * _PIECE)) * _MIX & _WHOLE
                if (mixed ^ (mixed >> 29)) * _END >> 24 & 0xFFFFFFFF < self.skip:
                    continue
            symbols[left], symbols[right] = a + b, ""
            after[left] = nxt = after[right]
            if nxt < n:
                before[nxt] = left
                if found := rank.get(a + b + symbols[nxt]):
                    heappush(agenda, (found[0], left, nxt, found[1], size + len(symbols[nxt])))
            prev = before[left]
            if prev >= 0 and (found := rank.get(symbols[prev] + a + b)):
                heappush(agenda, (found[0], prev, left, found[1], size + len(symbols[prev])))
        ids: list[int] = []
        for s in filter(None, symbols):
            found = rank.get(s)
            ids += [found[1]] if found else self._bytes(s)
        return np.array(ids, np.int32).tobytes()

    def _plain(self, chunks: list[str]) -> np.ndarray:
        """The numbers of the chunks' splits without dropout; -1 for those over _STEPPED characters."""
        plain = self.known.plain
        at = np.fromiter(map(plain.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(at < 0).tolist()
        new = list(dict.fromkeys(c for c in map(chunks.__getitem__, missing) if len(c) <= _STEPPED))
        plain.update(zip(new, self._learn(self.known.chunks(new), np.empty(0, np.uint64), np.zeros(len(new), np.int64)).tolist(), strict=True))
        at[missing] = [plain.get(chunks[i], -1) for i in missing]
        return at

    def _dropped(self, at: np.ndarray, drawn: np.ndarray) -> np.ndarray:
        """The split of each occurrence under its draw; at has its split without dropout."""
        at, known = at.copy(), self.known
        going = np.arange(len(at)) if self.skip else np.empty(0, np.int64)
        while len(going):
            place, n = known.met.places(at[going])
            owner = np.repeat(np.arange(len(going)), n)
            salts = known.met.data[place]
            skipped = np.flatnonzero(_skips(drawn[going][owner], salts, self.skip))
            owner, salts = owner[skipped], salts[skipped]
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else skipped
            if not len(first):
                break
            going = going[owner[first]]
            # Occurrences of a split that skip the same of its candidates go on together, under one name.
            name = np.add.reduceat((salts ^ (salts >> np.uint64(29))) * np.uint64(_MIX), first) ^ (at[going].astype(np.uint64) + np.uint64(1)) * np.uint64(_END)
            names, lead, group = np.unique(name, return_index=True, return_inverse=True)
            names = names.tolist()
            new = [j for j, x in enumerate(names) if x not in known.next]
            if new:
                who = lead[new]
                sizes = (np.append(first[1:], len(owner)) - first)[who]
                before, n_before = known.left_out.take(at[going[who]])
                n = n_before + sizes
                left_out, starts = np.empty(n.sum(), np.uint64), np.cumsum(n) - n
                left_out[_within(starts, n_before)] = before
                left_out[_within(starts + n_before, sizes)] = salts[_within(first[who], sizes)]
                learned = self._learn(known.chunk[at[going[who]]], left_out, n)
                known.next.update(zip([names[j] for j in new], learned.tolist(), strict=True))
            at[going] = np.fromiter(map(known.next.__getitem__, names), np.int64, len(names))[group]
        return at

    def encode_flat(self, texts: list[str], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids as 32-bit numbers, and how many each has; none for an empty text. A key draws what is skipped."""
        if self.known.ids.n > REMEMBERED:
            self.known = _Splits(self._bytes(_BLANK))
        # A blank's own sign in a text goes as bytes; as a piece it would come back as a blank.
        split = [_CHUNK.findall(" " + t) if _BLANK not in t else None for t in texts]
        parted = {i: [_CHUNK.findall(part) for part in (" " + texts[i]).split(_BLANK)] for i, x in enumerate(split) if x is None}
        for i, parts in parted.items():
            split[i] = sum(parts, [])
        for i, t in enumerate(texts):
            if not t:
                split[i] = []
        counts = np.fromiter(map(len, split), np.int64, len(split))
        flat = [c for chunks in split for c in chunks]
        drawn = _draws(np.array(keys, np.uint64), counts, self.seed)
        at = self._plain(flat)
        few = np.flatnonzero(at >= 0)
        at[few] = self._dropped(at[few], drawn[few])
        for i in np.flatnonzero(at < 0).tolist():
            ids = np.frombuffer(self._chunk(flat[i], int(drawn[i])), np.int32)
            at[i] = self.known.fixed(ids)
        if parted:
            ends = np.cumsum(counts) - counts
            signs = [(int(ends[i]) + sum(map(len, parts[: k + 1])), i) for i, parts in parted.items() for k in range(len(parts) - 1)]
            at = np.insert(at, [k for k, _ in signs], 0)
            np.add.at(counts, [i for _, i in signs], 1)
        where, n = self.known.ids.places(at)
        upto = np.concatenate(([0], np.cumsum(n)))
        ends = np.cumsum(counts)
        return self.known.ids.data[where], upto[ends] - upto[ends - counts]

    def counts(self, texts: list[str]) -> np.ndarray:
        """How many ids each text has without dropout."""
        return self.encode_flat(texts, [0] * len(texts))[1] if texts else np.empty(0, np.int64)

    def encode_all(self, texts: list[str], keys: list[int]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit numbers."""
        ids, n = self.encode_flat(texts, keys)
        data, ends = ids.tobytes(), np.cumsum(n)
        return [data[4 * a : 4 * b] for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]

    def encode(self, text: str, key: int = 0) -> bytes:
        return self.encode_all([text], [key])[0]

    def decode(self, ids: list[int]) -> str:
        """The text that was encoded."""
        return b"".join(map(self.text.__getitem__, ids)).decode(errors="replace")[1:]


@lru_cache(maxsize=2)
def _pieces(model: bytes, dropout: float, seed: int) -> Pieces:
    return Pieces(model, dropout, seed)


def plain(model: bytes) -> Pieces:
    """A model without dropout, one for all tasks of a process."""
    return _pieces(model, 0.0, 0)


def _key(doc_id: int | None, text: str, copy: int, seed: int) -> int:
    """Names a document and its copy: null and repeated ids have their texts besides."""
    return xxhash.xxh64_intdigest(f"{doc_id} {copy} {xxhash.xxh64_hexdigest(text)}", seed & _WHOLE)


def read_model(path: str = MODEL) -> bytes:
    """A model file's bytes, read where the job is planned and sent with it."""
    return Path(path).read_bytes()


def _slices(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[int, list[str], list[int]]]:
    """Runs of a batch's (key, text) rows with about _SLICE characters: the first row, texts, keys."""
    first, texts, keys, total = 0, [], [], 0
    for i, (d, t, *c) in enumerate(zip(*batch.columns, strict=True)):
        texts.append(t.as_py() or "")
        keys.append(_key(d.as_py(), texts[-1], c[0].as_py() if c else 0, seed))
        total += len(texts[-1])
        if total >= _SLICE:
            yield first, texts, keys
            first, texts, keys, total = i + 1, [], [], 0
    if texts:
        yield first, texts, keys


def _id(rows: DataFrame) -> str:
    """doc_id and its type, which may be any."""
    return f"doc_id {rows.schema['doc_id'].dataType.simpleString()}"


def encode(docs: DataFrame, model: bytes, dropout: float = DROPOUT, seed: int = SEED, text: str = "text", copies: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids (array<int>) of each row; a null or empty text has no ids.

    Ids depend on the row's doc_id and text only; with copies, also on which of the rows alike in both it is.
    Other columns of docs are not read.
    """
    rows = docs.select("doc_id", F.col(text).alias("_text"))
    if copies:  # rows alike in both are the same in any order
        same = Window.partitionBy("doc_id", *hash2(F.coalesce("_text", F.lit("")))).orderBy("doc_id")
        rows = rows.withColumn("_copy", F.row_number().over(same) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model, dropout, seed)
        for batch in batches:
            for first, texts, keys in _slices(batch, seed):
                ids, n = pieces.encode_flat(texts, keys)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(n.astype(np.int32)), lists], names=["doc_id", "n_tokens", "ids"])

    return rows.mapInArrow(run, f"{_id(docs)}, n_tokens int, ids array<int>")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """doc_id and text of rows with ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model, 0.0, 0)
        for batch in batches:
            texts = [None if x is None else pieces.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"{_id(encoded)}, text string")


def round_trip(docs: DataFrame, model: bytes, dropout: float = DROPOUT, seed: int = SEED, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (of the text read back from the ids) and lossless.

    A null text counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model, dropout, seed)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for first, texts, keys in _slices(batch, seed):
                ids = pieces.encode_all(texts, keys)
                back = [pieces.decode(np.frombuffer(x, np.int32).tolist()) for x in ids]
                cols = [
                    pa.array([len(x) // 4 for x in ids], pa.int32()),
                    pa.array(list(map(sha, ids))),
                    pa.array([sha(x.encode()) for x in back]),
                    pa.array([a == b for a, b in zip(back, texts, strict=True)]),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *cols], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "lossless"])

    return docs.select("doc_id", F.col(text).alias("_text")).mapInArrow(run, f"{_id(docs)}, n_tokens int, ids_sha256 string, decoded_sha256 string, lossless boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), read_model())
