import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import parsing as p


def prose(seed, n=400):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 9))) for _ in range(n))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab c"), max_size=40), max_size=8))
def test_texts_are_parsed_alone(texts):
    assert p.fingerprints(texts) == [p.fingerprints([t])[0] for t in texts]


def test_equal_substrings_share_signatures_wherever_they_stand():
    a = prose(1)
    for shift in ("x", "yz ", "0123456789" * 7, prose(2, 30)):
        assert p.likeness(*p.fingerprints([a, shift + a])) > 0.8
    assert p.likeness(*p.fingerprints([a, prose(3)])) < 0.1
    assert p.likeness(*p.fingerprints([a, a])) == 1.0


def test_edits_keep_likeness_near_their_share():
    for seed in range(5):
        a = prose(seed, 800)
        assert 0.35 < p.likeness(*p.fingerprints([a, p.edited(a, prose(seed + 50, 800))])) < 0.85
    run = "For " * 900
    assert p.likeness(*p.fingerprints([run, p.edited(run, prose(9, 900))])) > 0.3


def test_short_and_empty_texts():
    got = p.fingerprints(["", "a", "aa", "ab", "a" * 9, ""])
    assert got[0] == got[5] == "" and len(set(got[:5])) == 5
    assert p.likeness("", "") == 1 and p.likeness("", got[1]) == 0


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_documents_beside_their_edits(spark, n):
    rng = random.Random(n)
    rows = [(i * 3 % 7 if i % 9 == 0 else i, None if i % 11 == 5 else prose(i, rng.randint(0, 60)), "x") for i in range(n)]
    rows += [(None, prose(77, 20), "y")] if n > 2 else []
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = p.edit_likeness(docs).collect()
    order = sorted(((i is not None, i or 0, t or ""), i, t or "") for i, t, _ in rows)
    texts = [t for _, _, t in order]
    new = [p.edited(a, b) for a, b in zip(texts, texts[1:] + texts[:1])]
    own, theirs = p.fingerprints(texts), p.fingerprints(new)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in new]
    want = [(i, len(t), h, f, g, p.likeness(f, g), p.likeness(f, k)) for (_, i, t), h, f, g, k in zip(order, sha, own, theirs, own[1:] + own[:1])]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_empty_table_and_slices(spark, monkeypatch):
    assert p.edit_likeness(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(f"id {i % 40}", prose(i, 20)) for i in range(60)], "doc_id string, text string")
    whole = sorted(map(str, p.edit_likeness(docs).collect()))
    monkeypatch.setattr(p, "_SLICE", 300)
    assert sorted(map(str, p.edit_likeness(docs).collect())) == whole and len(whole) == 60


def test_result_does_not_hang_on_exchange_reuse(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cut = docs.select("doc_id", docs.text.substr(1, 200).alias("text"))
    got = []
    for reuse in ("true", "false"):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        got.append(sorted(map(str, p.edit_likeness(cut).collect())))
    spark.conf.unset("spark.sql.exchange.reuse")
    assert got[0] == got[1] and len(got[0]) == docs.count()


WHOLE, P, Q = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def mixed(x):
    x = ((x ^ (x >> 31)) * Q) & WHOLE
    return x ^ (x >> 29)


def plain_level(names, bits):
    """The next level's names by loops over one text, written from the rules alone."""
    n, labels = len(names), list(names)
    for _ in range(p.ROUNDS):
        new = []
        for i, x in enumerate(labels):
            left = labels[i - 1] if i else x ^ ((1 << bits) - 1)
            unlike = (x ^ left) & ((1 << bits) - 1)
            low = (unlike & -unlike).bit_length() - 1 if unlike else bits
            new.append(2 * low + (x >> low & 1 if low < bits else 0))
        labels, bits = new, 8
    runs, i = [], 0  # (first, length) of stretches of one name
    while i < n:
        j = i
        while j < n and names[j] == names[i]:
            j += 1
        runs.append((i, j - i))
        i = j
    in_run = {k for a, m in runs if m > 1 for k in range(a, a + m)}
    begin = {0}
    for i in range(1, n - 1):
        if labels[i - 1] < labels[i] > labels[i + 1] and not {i - 1, i, i + 1} & in_run and i > 1:
            begin.add(i)
    for a, m in runs:
        if m > 1:
            begin -= set(range(a, a + m))
            begin |= {a + k for k in range(0, m, 2) if k == 0 or k + 1 < m}
            if a + m < n:
                begin.add(a + m)
    for a, m in runs:  # a name alone before a run joins the run's first phrase
        if m > 1 and a > 0 and a - 1 in begin and a - 1 not in in_run:
            begin.discard(a)
    starts = sorted(begin)
    out = []
    for a, b in zip(starts, starts[1:] + [n]):
        total = sum(mixed((names[i] * P + (names[i - 1] * Q if i > a else 0)) & WHOLE) for i in range(a, b)) & WHOLE
        out.append(mixed(total))
    return out


def plain_fingerprint(text):
    if not text:
        return ""
    names, parts = [ord(c) for c in text], []
    for level in range(1, max(p.LEVELS) + 1):
        names = plain_level(names, 32 if level == 1 else 64)
        if level in p.LEVELS:
            turn, least = {}, []
            for x in names:
                least.append(mixed((x + turn.get(x, 0) * P) & WHOLE) >> 32)
                turn[x] = turn.get(x, 0) + 1
            parts.append("".join(f"{x:08x}" for x in sorted(least)[: p.KEPT]))
    return "/".join(parts)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abc dé中"), max_size=60) | st.text(st.sampled_from("ab"), max_size=30))
def test_fingerprints_are_what_a_plain_parser_gives(text):
    assert p.fingerprints([text]) == [plain_fingerprint(text)]


def test_plain_parser_on_prose():
    for t in (prose(5), "aaa " * 60, "x", "xy" * 40, prose(6, 30) + "\n" * 9):
        assert p.fingerprints([t, "other"])[0] == plain_fingerprint(t)
