import numpy as np
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import sentencepieces as s

MODEL = s.read_model()
PLAIN, DROPPED = s.Pieces(MODEL, 0.0), s.Pieces(MODEL, 0.1)
TEXTS = ["", " ", "a  b", "  a\n\nb ", "x\ty é 中 \u0000 z", "</s> <s> <0x0A>", "é ﬁ ①", "a" * 700, "     x    y\n   z  ", "🙂🙂 你好 こんにちは", "\n", "ab " * 400]


def ids(data):
    return np.frombuffer(data, np.int32).tolist()


def test_without_dropout_ids_are_the_library_s():
    p = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    for t in TEXTS:
        assert ids(PLAIN.encode(t)) == p.encode(t)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(" \n▁ab<>0x"), max_size=60), st.integers(0, 3))
def test_round_trip(text, key):
    for p in (PLAIN, DROPPED):
        assert p.decode(ids(p.encode(text, key))) == text


def test_in_step_is_what_agendas_give():
    chunks = [" hello", "tokenization", " Überraschung", "x", "  spaced", "aaaaaaaaaaaa", "zz" * 30, "é中🙂"]
    which, drawn = np.arange(4000) % len(chunks), s._draws(np.array([3], np.uint64), np.array([4000]), 1)
    for p in (DROPPED, s.Pieces(MODEL, 0.5), PLAIN):
        where = [p.known.ids.places(np.array([k]))[0] for k in p._dropped(p._plain(chunks)[which], drawn)]
        assert [p.known.ids.data[k].tobytes() for k in where] == [p._chunk(chunks[i], int(d)) for i, d in zip(which, drawn)]


def test_dropout_varies_and_repeats():
    text = "international considerations regarding tokenization experiments " * 20
    a, b, plain = DROPPED.encode(text, 0), DROPPED.encode(text, 0), PLAIN.encode(text)
    assert a == b == s.Pieces(MODEL, 0.1).encode(text, 0) and a != plain and len(a) > len(plain)
    assert s.Pieces(MODEL, 0.1, seed=1).encode(text, 0) != a
    words = ids(a)
    assert len({tuple(words[i : i + 3]) for i in range(len(words) - 3)}) > len({tuple(ids(plain)[i : i + 3]) for i in range(len(ids(plain)) - 3)})


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(s, "REMEMBERED", 50)
    p = s.Pieces(MODEL, 0.1)
    for i in range(20):
        text = " ".join(f"w{j}q" for j in range(i * 40, i * 40 + 60))
        assert p.decode(ids(p.encode(text, i))) == text
    assert p.known.ids.n < 1500


def test_tables(spark):
    rows = [(1, "The quick fox", "x"), (1, "The quick fox", "y"), (2, None, "z"), (3, "", ""), (None, "null id", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    enc = s.encode(docs, MODEL)
    got = enc.collect()
    assert len(got) == 5 and {r.n_tokens for r in got if r.doc_id in (2, 3)} == {0}
    assert len({tuple(r.ids) for r in got if r.doc_id == 1}) == 1 and all(r.n_tokens == len(r.ids) for r in got)
    back = sorted((r.doc_id or 0, r.text) for r in s.decode(enc, MODEL).collect())
    assert back == sorted((i or 0, t or "") for i, t, _ in rows)
    assert all(r.lossless for r in s.round_trip(docs, MODEL).collect())
    assert s.encode(docs.limit(0), MODEL).count() == 0 and s.round_trip(docs.limit(0), MODEL).count() == 0


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a", "one text"), (None, "none"), ("b", None)], "doc_id string, text string")
    enc = s.encode(docs, MODEL, copies=True)
    assert {r.doc_id: r.text for r in s.decode(enc, MODEL).collect()} == {"a": "one text", None: "none", "b": ""}
    assert {r.doc_id for r in s.round_trip(docs, MODEL).collect() if r.lossless} == {"a", None, "b"}


def test_query_is_lossless(spark, sf):
    import hashlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = s.query(spark, sf).collect()
    assert len(rows) == len(texts)
    assert all(r.lossless and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)


@pytest.mark.parametrize("dropout", [0.5, 1.0])
def test_strong_dropout_is_lossless(dropout):
    p = s.Pieces(MODEL, dropout)
    for t in TEXTS:
        assert p.decode(ids(p.encode(t, 1))) == t


def test_each_occurrence_is_split_anew():
    word, n = " international", 400
    plain = PLAIN.encode("x" + word)[len(PLAIN.encode("x")) :]
    first = {DROPPED.encode("x" + word, k) for k in range(n)}
    assert len(first) > 8
    within = {DROPPED._chunk(word, int(d)) for d in s._draws(np.array([7], np.uint64), np.array([n]), s.SEED)}
    assert len(within) > 8 and plain in within


def test_whole_texts_are_what_agendas_give():
    texts = ["the international tokenization of words " * 30, "", "a▁b Überraschung é中🙂 " + "y" * 90, "z"]
    keys = [5, 6, 7, 8]
    split = [[c for part in (" " + t).split("▁") for c in s._CHUNK.findall(part)] if t else [] for t in texts]
    drawn = s._draws(np.array(keys, np.uint64), np.array(list(map(len, split))), s.SEED).tolist()
    for t, chunks, got in zip(texts, split, DROPPED.encode_all(texts, keys)):
        own, drawn = drawn[: len(chunks)], drawn[len(chunks) :]
        want = [DROPPED._chunk(c, d) for c, d in zip(chunks, own)]
        sign = np.array(DROPPED._bytes("▁"), np.int32).tobytes()
        assert got == b"".join(want) if "▁" not in t else got == want[0] + want[1] + sign + b"".join(want[2:]) or got == want[0] + sign + b"".join(want[1:])


def test_copies_are_split_in_their_own_ways(spark):
    text = "international considerations regarding tokenization experiments " * 20
    docs = spark.createDataFrame([(1, text), (1, text), (1, text), (None, text), (None, text + "x")], "doc_id long, text string")
    assert len({tuple(r.ids) for r in s.encode(docs, MODEL, copies=True).collect()}) == 5
    assert len({tuple(r.ids) for r in s.encode(docs, MODEL).collect()}) == 3


M64 = (1 << 64) - 1


def plainly(text, key, vocabulary, dropout=s.DROPOUT, seed=s.SEED):
    """Merge-dropout without an agenda: every pair of neighbours is looked at before each merge.

    vocabulary has (score, id) of the library's pieces, blanks for their sign. Nothing of the operator is called.
    """
    if not text:
        return []
    spans, out, place = [], [], 0
    for k, part in enumerate((" " + text).split("▁")):
        spans += [None] * (k > 0)
        at = 0
        while at < len(part):  # blanks and what follows them, a line end alone
            end = at
            if part[at] == "\n":
                end = at + 1
            else:
                while end < len(part) and part[end] == " ":
                    end += 1
                while end < len(part) and part[end] not in " \n":
                    end += 1
            spans.append(part[at:end])
            at = end
    for chunk in spans:
        if chunk is None:
            out += vocabulary["bytes", "▁"]
            continue
        x = ((key ^ xxhash.xxh64_intdigest(str(seed))) + (place + 1) * 0x9E3779B97F4A7C15) & M64
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M64
        x = (x ^ x >> 27) * 0x94D049BB133111EB & M64
        draw, place = x ^ x >> 31, place + 1

        def falls_out(left, piece):
            m = (draw ^ (left * 0x9E3779B97F4A7C15 + piece * 0xC2B2AE3D27D4EB4F) & M64) * 0xFF51AFD7ED558CCD & M64  # noqa: B023
            return ((m ^ m >> 29) * 0x9FB21C651E98DF25 & M64) >> 24 & 0xFFFFFFFF < int(dropout * 2**32)

        symbols, starts = list(chunk), list(range(len(chunk)))
        while True:
            found = []
            for i in range(len(symbols) - 1):
                if piece := vocabulary.get(symbols[i] + symbols[i + 1]):
                    if not falls_out(starts[i], piece[1]):
                        found.append((-piece[0], starts[i], i))
            if not found:
                break
            i = min(found)[2]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del starts[i + 1]
        for x in symbols:
            out += [vocabulary[x][1]] if x in vocabulary else vocabulary["bytes", x] if ("bytes", x) in vocabulary else [vocabulary["byte", b] for b in x.encode()]
    return out


@pytest.fixture(scope="module")
def vocabulary():
    p = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    out = {}
    for i in range(p.get_piece_size()):
        if p.is_byte(i):
            out["byte", int(p.id_to_piece(i)[3:5], 16)] = i
        elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)):
            out[p.id_to_piece(i).replace("▁", " ")] = (p.get_score(i), i)
    out["bytes", "▁"] = [out["byte", b] for b in "▁".encode()]
    return out


def test_the_model_s_pieces_fit_the_chunks(vocabulary):
    """No piece has a blank or a line end after another character, so none reaches over two chunks."""
    words = [x for x in vocabulary if isinstance(x, str)]
    assert len(words) > 30_000 and all(" " not in x.lstrip(" ") and ("\n" not in x or x == "\n") for x in words)


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.6])
def test_splits_are_a_plain_loop_s(vocabulary, dropout):
    pieces = s.Pieces(MODEL, dropout)
    texts = [*TEXTS, "international considerations of tokenization " * 12, "a▁b Überraschung é中🙂 ▁ " + "y" * 90]
    for key, t in enumerate(texts):
        assert ids(pieces.encode(t, key)) == plainly(t, key, vocabulary, dropout)


def test_the_table_s_ids_are_a_plain_loop_s(spark, sf, vocabulary):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: list(r.ids) for r in s.encode(docs, MODEL).select("doc_id", "ids").collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        key = xxhash.xxh64_intdigest(f"{r.doc_id} 0 {xxhash.xxh64_hexdigest(r.text)}", s.SEED)
        assert got[r.doc_id] == plainly(r.text, key, vocabulary), r.doc_id
