import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tracewell import plans
from tracewell.operators import consolidate as C
from tracewell.plans.consolidate import cards


def lines(card):
    return [x for x in (y.strip() for y in (card or "").split("\n")) if x and not x.startswith("Project context")]


def cut(entry):
    i = entry.rfind(" (")
    return (entry[:i], entry[i + 2 : -1]) if i > 0 and entry.endswith(")") else (entry, None)


def tokens(card):
    return {w for x in lines(card) if not x.endswith(":") for w in cut(x.removeprefix("- "))[0].lower().split()}


def parsed(card):
    out, now = [], None
    for x in lines(card):
        if x.endswith(":") and not x.startswith("- "):
            now = {}
            out.append((x, now))
        elif now is not None and x.startswith("- "):
            bare, told = cut(x[2:])
            m = re.match(r"\+?(\d+)", told or "")
            entry, n = (bare, int(m[1])) if m and int(m[1]) > 0 else (x[2:], 1)
            now[entry] = now.get(entry, 0) + n
    return out


def walk(rows, threshold=0.6):
    """Greedy groups by id, one card after the other: {rep: [ids]}."""
    groups = []
    for i, card, same in sorted(rows):
        mine = tokens(card)
        for g in groups:
            rep, words, key = g[0]
            if key == same and (mine or words) and len(mine & words) / len(mine | words) >= threshold:
                g.append(i)
                break
        else:
            groups.append([(i, mine, same)])
    return {g[0][0]: [g[0][0], *g[1:]] for g in groups}


def united(texts):
    sums = {}
    for card in texts:
        for title, entries in parsed(card):
            held = sums.setdefault(title, {})
            for e, n in entries.items():
                held[e] = held.get(e, 0) + n
    if not sums:
        return None
    out = [C.TITLE]
    for title, held in sums.items():
        out += [title, *(f"- {e} ({n})" for e, n in sorted(held.items(), key=lambda x: (-x[1], x[0].encode()))[:8])]
    return "\n".join(out)


def odd_cards():
    rng = random.Random(2)
    entry = lambda: f"- {rng.choice('abcdefghij')}/{rng.choice('xy')}.py" + rng.choice(["", f" ({rng.randint(1, 30)})", " (0)", " (many)", " (3 times)", " (x) (2)", " ("])
    rows = [(i, "\n".join(["Project context seen:", *(rng.choice(["Paths:", " Tools: ", "- odd:"]) if rng.random() < 0.3 else entry() for _ in range(rng.randint(0, 9)))]), i % 2) for i in range(150)]
    rows += [(200 + i, rows[9][1], 1) for i in range(30)] + [(300, None, 0), (301, "", 0), (302, "words only", 0), (303, "words only", 0), (304, "- (7)\nT:\n- (7)", None), (305, "- (7)\nT:\n- (7)", None)]
    return rows


def test_merging_is_the_plain_walk_s(spark):
    rows = odd_cards()
    df = spark.createDataFrame(rows, "id long, content string, same int")
    got_tokens = {r.id: set(r.t) for r in df.select("id", C.card_tokens(F.col("content")).alias("t")).collect()}
    assert got_tokens == {i: tokens(c) for i, c, _ in rows}
    groups = C.merge_groups(df, ["same"])
    found = {}
    for r in groups.collect():
        found.setdefault(r.rep, []).append(r.id)
    want = {k: v for k, v in walk(rows).items() if tokens(dict((i, c) for i, c, _ in rows)[k])}
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    text = {i: c for i, c, _ in rows}
    merged = {r.rep: (r.n, r.content) for r in C.merged_cards(df, groups).collect()}
    assert merged == {k: (len(v), u) for k, v in want.items() if len(v) > 1 and (u := united([text[i] for i in sorted(v)]))}


def test_merged_context_query(spark, sf):
    rows = cards(lambda n: spark.read.parquet(f"{sf}/{n}.parquet")).collect()
    by_id = {r.id: r for r in rows}
    want = {}
    for rep, ids in walk([(r.id, r.content, r.scope) for r in rows]).items():
        if len(ids) > 1:
            some = [by_id[i] for i in sorted(ids)]
            digest = hashlib.sha256(united([r.content for r in some]).encode()).hexdigest()
            want[rep] = (len(ids), digest, sum(r.hits for r in some), max(r.created for r in some), len({r.source for r in some}))
    got = {r.rep: (r.n, r.content_sha256, r.hits, r.created, r.n_sources) for r in plans.QUERIES["merged_context"](spark, sf).collect()}
    assert got == want and len(got) > 3


@pytest.mark.parametrize("led", [1, 7, 40])
@pytest.mark.parametrize("settled", [0.0, 2.0])
def test_leaders_are_the_plain_walk_s_without_all_pairs(spark, monkeypatch, led, settled):
    """Before, all alike pairs were made and stored, which grow with the square of what is alike."""
    from tracewell.operators import cards as K

    rng = random.Random(led)
    sets = {frozenset(rng.sample(range(12), rng.randint(1, 6))): None for _ in range(160)}
    sets = dict(enumerate(sets, 5))
    want, reps = {}, []
    for i, s in sets.items():
        want[i] = next((r for r in reps if len(s & sets[r]) / len(s | sets[r]) >= 0.6), i)
        reps += [i] if want[i] == i else []
    monkeypatch.setattr(K, "LED", led)
    monkeypatch.setattr(K, "SETTLED", settled)  # 2: the second round's rest by pairs
    monkeypatch.setattr(K, "WORDS", 5 if led == 7 else 2_048)
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, words array<long>").repartition(3)
    assert {r.id: r.rep for r in K.led(df, 0.6).collect()} == want
