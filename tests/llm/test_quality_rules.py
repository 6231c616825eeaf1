import re

import pytest

from tracewell.llm import quality_rules as q

SCHEMA = "doc_id long, text string, n_words string"


def by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(8)}
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "a b c d e f g h",
    "a b c d e f g h a b c d e f g h",
    "x " * 50,
    "the cat sat on the mat and the dog ran to the hill with it\n" * 3,
    "é ü # $ % | <b>\n\n#\n#\n \n",
    " ".join(f"w{i % 17}" for i in range(300)),
    " ".join(f"w{i}" for i in range(5000)) + " a b c d e f g h i j a b c d e f g h i j",
    "y z \x0b q\x1cr",
]


def test_counts_equal_a_plain_loop(spark):
    rows = [(i, t, "given") for i, t in enumerate(TEXTS)] + [(1, "", "given"), (None, "a b", None)]
    got = q.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == by_hand(r.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_verdicts(spark):
    good = "the cat sat on the mat and the dog ran to a hill with the sun in its eyes for most of that long day"
    bad = " ".join(f"{w}###" for w in good.split())
    got = {r.doc_id: r for r in q.quality_rules(spark.createDataFrame([(1, good, ""), (2, bad, "")], SCHEMA)).collect()}
    assert got[1].kept and got[1].failed_rules == []
    assert not got[2].kept and "symbols" in got[2].failed_rules


def test_empty_table_and_native_plan(spark):
    out = q.quality_rules(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("least,kept", [(20, False), (3, False)])
def test_rules_are_a_table(spark, least, kept):
    rules = (q.Rule("words", "n_words", None, least, None),)
    (r,) = q.quality_rules(spark.createDataFrame([(1, "a b c d", "")], SCHEMA), rules=rules).collect()
    assert r.kept is kept and (r.failed_rules == ["words"]) == (least == 20)
