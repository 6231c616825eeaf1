import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from tracewell.llm import spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(words):
    """Every pair compared."""
    out, form = {}, {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = len(near)
    rows = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n, out[w], words.get(form[w])))
    return rows


def rows(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


@pytest.mark.parametrize("seed", range(4))
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    alphabet = ["ab", "abc", "aé\U0001f600z", "abcdefghij"][seed]
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(0 if seed < 2 else 3, 6))): rng.choice([1, 2, 3, 5, 9, 20, 50, 200]) for _ in range(120)}
    words |= {"aaaa": 3, "aaaaa": 7, "aaaaaa": 15, "": 1} if seed < 2 else {}
    got = rows(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert len(got) == len(words) and set(got) == by_hand(words)


def test_a_word_leaves_heavy_paths_as_often_as_the_logarithm_says(spark):
    rng = random.Random(7)
    words = {"".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(900)} | {"abcdefgh"[:i] for i in range(9)}
    light = spelling._leaving(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).groupBy("word").count().collect()
    assert max(r["count"] for r in light) <= 1 + len(words).bit_length()


def test_odd_words(spark):
    odd = [("house", 5), ("house", 6), (None, 9), ("mouse", None), ("louse", 4), ("hou\0se", 1)]
    df = spark.createDataFrame([(w, n, "x", "y", "z") for w, n in odd], "word string, n long, p string, c string, best string")
    assert set(rows(spelling.variants(df))) == by_hand({"house": 11, "louse": 4, "hou\0se": 1})
    assert rows(spelling.variants(df.limit(0))) == []


def text_words(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}


def test_long_texts_are_cut_at_blanks(monkeypatch):
    monkeypatch.setattr(spelling, "_BYTES", 50)
    for text in (b"", b"x" * 300, b"letters,letters;Letters " * 40, b"y" * 80 + b" " + b"z" * 80, b" " * 200):
        parts = list(spelling._parts(text))
        assert b"".join(parts) == text and all(p.startswith(b" ") for p in parts[1:]) and all(len(p) <= 130 or b" " not in p[50:] for p in parts)


def test_words(spark):
    docs = [(1, None), (2, ""), (None, "Straße STRAßE Straße ÀÉÎ×÷ÿ ÀÉÎ×÷ÿ ÀÉÎ×÷ÿ"), (3, "letters,letters;LETTERS Ālphabet " * 40), (3, "again again again"), (4, "x" * 300 + " " + "long" * 30)]
    docs += [(i, "apple orange  banana-cherry") for i in range(200)]
    got = spelling.words(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(text_words(docs)) and dict(map(tuple, got)) == text_words(docs)


def test_query_equals_its_sql(spark, sf):
    got = rows(spelling.query(spark, sf))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(f"select word, form, root, n, n_near, form_n from ({spelling.SQL})").fetchall()
    assert len(got) > 1000 and sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[1] is not None for r in got) > 10 and any(r[1] != r[2] for r in got if r[1])
