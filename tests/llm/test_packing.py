import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tracewell.llm import packing


def plainly(lengths, size):
    """Shortest pack first, one document at a time: the packs as lists of lengths."""
    packs = []
    for n in sorted(lengths, reverse=True):
        fits = [p for p in packs if sum(p) + n <= size]
        if fits:
            min(fits, key=sum).append(n)
        else:
            packs.append([n])
    return sorted(map(tuple, packs))


@pytest.mark.parametrize("size", [8, 16, 64])
def test_patterns_are_the_packs_of_a_plain_walk(size):
    rng = random.Random(size)
    for _ in range(60):
        lengths = [rng.randint(1, size - 1) for _ in range(rng.randint(0, 40))] + [rng.randint(1, size - 1)] * rng.randint(0, 30)
        histogram = {n: lengths.count(n) for n in set(lengths)}
        patterns = packing.shortest_first(histogram, size)
        packs = sorted(tuple(n for n, times in p.held for _ in range(times)) for p in patterns for _ in range(p.count))
        assert sorted(map(sum, packs)) == sorted(map(sum, plainly(lengths, size)))
        assert sorted(n for p in packs for n in p) == sorted(lengths)
        assert all(p.filled == sum(n * t for n, t in p.held) <= size for p in patterns)
        assert len(patterns) <= 3 * len(histogram)


@pytest.mark.parametrize("size", [8, 64, 2048])
def test_plans_place_every_token_once_and_pad_nothing(size):
    rng = random.Random(size)
    cases = [{}, {1: 1}, {size - 1: 1}, {size - 1: 500}, {size * 3 // 4: 99}, {1: 1000, size - 1: 3}]
    cases += [{rng.randint(1, size - 1): rng.randint(1, 60) for _ in range(rng.randint(1, 30))} for _ in range(40)]
    for histogram in cases:
        plan = packing.planned(histogram, size)
        sequences = defaultdict(list)
        for rest, n in histogram.items():
            for rank in range(n):
                at = 0
                for start, length, sequence, offset in plan.of(rest, rank):
                    assert start == at and length > 0
                    at += length
                    sequences[sequence].append((offset, length))
                assert at == rest
        assert set(sequences) == set(range(plan.sequences))
        total = 0
        for pieces in sequences.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at == size or (at < size and at & (at - 1) == 0)
            total += at
        assert total == sum(k * n for k, n in histogram.items())


def test_plans_dont_grow_with_documents():
    rng = random.Random(4)
    histogram = {n: rng.randint(1, 9) for n in range(1, 2048)}
    small, large = (packing.planned({n: c * k for n, c in histogram.items()}) for k in (1, 1_000_003))
    assert large.sequences > 1_000_000 * small.sequences / 2
    assert len(large.rooms) <= 3 * 2047 and sum(len(r) for r, _ in large.places.values()) < 40_000


def test_remembered_ids_are_the_tokenizer_s():
    model = packing.read_model()
    whole = Tokenizer.from_str(model)
    mine = packing.tokenizer(model)
    texts = ["", " ", "It's  DON'T\tstop\nİSTANBUL é é ́x  a b", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "<|end of| text|> x", "3.14 ½² 你好世界 \U0001f600\U0001f468‍\U0001f469", "x" * 5000, "ΣΣΣ ﬁ \x85\x1c\x0b\x0c\0", "가 ᅡ"]
    rng = random.Random(1)
    alphabet = "abC'sXYZ019 \n\t.,<|>endoftextßé́你 "
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for t, ids in zip(texts + texts[-30:], mine([t.encode() for t in texts]) + mine([t.encode() for t in texts[-30:]]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def check(rows, docs, size=2048):
    """Pieces against a plain reading of the documents: ids whole and in order, sequences gapless and unpadded."""
    whole = Tokenizer.from_str(packing.read_model())
    want = defaultdict(int)
    for i, t in docs:
        want[i, np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()] += 1
    if len({i for i, _ in docs}) == len(docs):
        by_doc = defaultdict(list)
        for r in rows:
            by_doc[r.doc_id].append(r)
        for i, ids in want:
            at = 0
            for r in sorted(by_doc.pop(i), key=lambda r: r.start):
                assert (r.start, r.doc_tokens) == (at, len(ids) // 4)
                assert zlib.crc32(ids[4 * at : 4 * (at + r.length)]) == r.ids_crc32
                at += r.length
            assert 4 * at == len(ids)
        assert not by_doc
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == size or (at < size and at & (at - 1) == 0)
    assert sum(r.length for r in rows) == sum(n * len(ids) // 4 for (_, ids), n in want.items())


def test_query(spark, sf):
    rows = packing.query(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    check(rows, [tuple(d) for d in docs])


def test_odd_rows(spark):
    from pyspark.sql import functions as F

    model = packing.read_model()
    many = "one two three " * 9000
    docs = [("a", "one"), ("b", None), ("c", ""), ("d", many), ("e", "x " * 2047), ("f", "x " * 2048), ("g", "tie tie"), ("h", "tie tie")]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id string, text string, part int, rest int, n int").repartition(3)
    out = packing.pack(df, model)
    assert out.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    check(out.withColumn("ids_crc32", F.crc32("ids")).collect(), docs)
    docs = [(None, "one two"), (None, "one two"), (1, "again"), (1, "again"), (2, None)]
    out = packing.pack(spark.createDataFrame(docs, "doc_id int, text string"), model, size=4)
    check(out.withColumn("ids_crc32", F.crc32("ids")).collect(), docs, 4)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), model).collect() == []
