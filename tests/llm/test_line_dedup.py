import random
import re

from tracewell.llm import line_dedup as d

SCHEMA = "doc_id long, text string, kept_text string, source string"


def words(line):
    return re.findall(r"[^\x20\x09-\x0D]+", line)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def by_hand(docs):
    lines = sorted(((i is None, i or 0, n), tuple(words(x))) for i, t in docs for n, x in enumerate((t or "").split("\n")))
    gone = {}
    distinct = {}
    for place, w in lines:
        if w:
            distinct.setdefault(w, place)
    near_gone = {w for w, p in distinct.items() if len(w) >= d.NEAR_WORDS and any(q < p and len(v) >= d.NEAR_WORDS and near(list(w), list(v)) for v, q in distinct.items())}
    for place, w in lines:
        if w in near_gone:
            gone[place] = "near"
        elif w in distinct and distinct[w] != place:
            gone[place] = "exact"
    out = {}
    for i, t in docs:
        kept = [x for n, x in enumerate((t or "").split("\n")) if ((i is None, i or 0, n)) not in gone]
        kinds = [v for k, v in gone.items() if k[:2] == (i is None, i or 0)]
        out[i] = (None if t is None else "\n".join(kept), kinds.count("exact"), kinds.count("near"))
    return out


def run(spark, docs):
    rows = d.line_dedup(spark.createDataFrame([(i, t, "old", "s") for i, t in docs], SCHEMA)).collect()
    return {r.doc_id: (r.kept_text, r.n_exact, r.n_near) for r in rows}, rows


def test_small_cases(spark):
    base = "the quick brown fox jumps over the lazy dog near a river"
    docs = [
        (1, f"{base}\nshort line\n{base}"),
        (2, base.replace("fox", "cat") + "\nshort line\na fresh line with enough words to count here"),
        (3, base + " bank\n\n"),
        (4, base.replace("lazy ", "")),
        (5, base.replace("fox", "cow").replace("river", "lake")),
        (6, base.replace(" ", "\t") + " "),
        (7, None),
        (8, ""),
        (None, base.upper() + "\n" + base),
    ]
    got, rows = run(spark, docs)
    assert got == by_hand(docs)
    assert got[2][2] == got[3][2] == got[4][2] == 1 and got[5][2] == 0 and got[6][1] == 1
    assert all(r.source == "s" for r in rows) and got[7] == (None, 0, 0) and got[8] == ("", 0, 0)


def test_random_corpora(spark):
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(12)]
    seeds = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 14))] for _ in range(25)]
    docs = []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(1, 5)):
            w = list(rng.choice(seeds))
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                k, kind = rng.randrange(len(w)), rng.choice("cda")
                if kind == "c":
                    w[k] = rng.choice(vocabulary)
                elif kind == "d":
                    del w[k]
                else:
                    w.insert(k, rng.choice(vocabulary))
            lines.append(" ".join(w))
        docs.append((i, "\n".join(lines)))
    got, _ = run(spark, docs)
    assert got == by_hand(docs)


def test_hot_line_long_text_repeats_and_empty_table(spark):
    hot = "this very line stands in every document of the whole corpus again"
    long = "\n".join(f"line {i} of a long text with its own words w{i} x{i} y{i} z{i}" for i in range(3000))
    docs = [(i, hot + f"\nown words of document {i} are u{i} v{i} w{i} and t{i}") for i in range(200)] + [(500, long)]
    got, _ = run(spark, docs)
    assert got[0][1] == 0 and all(got[i][1] == 1 for i in range(1, 200)) and got[500] == (long, 0, 0)
    twice, rows = run(spark, [(1, hot), (1, hot), (2, hot)])
    assert len(rows) == 3 and twice == {1: (hot, 0, 0), 2: ("", 1, 0)}
    assert run(spark, [])[1] == []


def test_plan_is_native(spark):
    plan = d.line_dedup(spark.createDataFrame([(1, "a b c d e f g h i j k", "", "")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_short_lines(spark):
    rights, four, six = "All rights reserved.", "one two three four", "a b c d e f"
    docs = [(1, f"{rights}\n\nMenu\n{four}\n{six}"), (2, f"Menu\n\n{rights}\none two three five\na b x d e f"), (3, f"{four}\na b c d e"), (4, "b c d e\nown")]
    got, _ = run(spark, docs)
    # Lines without a word stay; one word in four or fewer is no small edit; one in five to nine is.
    assert got == {1: (docs[0][1], 0, 0), 2: ("\none two three five", 2, 1), 3: ("", 1, 1), 4: ("b c d e\nown", 0, 0)}


def test_lines_of_any_length_against_all_pairs(spark):
    rng, docs = random.Random(11), []
    for i in range(150):
        docs.append((i, "\n".join(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(3))))
    seen, want = [], {}
    for i, text in docs:
        kept = []
        for line in text.split("\n"):
            w = line.split()
            if not (w and any(w == v or (min(len(w), len(v)) >= 5 and near(w, v)) for v in seen)):
                kept.append(line)
            seen.append(w)
        want[i] = "\n".join(kept)
    got, _ = run(spark, docs)
    assert {i: r[0] for i, r in got.items()} == want
