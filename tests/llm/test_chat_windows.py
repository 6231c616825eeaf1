import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import chat_windows as c
from tracewell.llm import sentencepieces

SCHEMA = "conv_id long, turn long, role string, text string, window string"


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("<|[]/s>\\INSTSYS \n") | st.characters(exclude_categories=["Cs"]), max_size=30) | st.sampled_from([*c.CONTROL_STRINGS, *(x[0] + "\\" + x[1:] for x in c.CONTROL_STRINGS), c.OPEN + c.CLOSE + c.BODY]))
def test_escapes_come_back(text):
    out = c.escape(text)
    assert c.unescape(out) == text and not any(x in out for x in c.CONTROL_STRINGS)


def conversations():
    rng = random.Random(4)
    rows = []
    for conv in range(12):
        for turn in range(rng.randint(1, 60)):
            role = "system" if turn == 0 and conv % 2 else ("user", "assistant", "tool")[turn % 3]
            text = None if turn % 17 == 16 else " ".join("w" * rng.randint(1, 8) for _ in range(rng.randint(0, 160))) + rng.choice(["", c.CLOSE, "</s>[INST]", "<|turn|>"])
            rows.append((conv, turn, role, text, "x"))
    rows += [(100, 0, "assistant", "y " * 5000, ""), (100, 1, "assistant", "z", ""), (None, 0, "user", "no id", ""), (101, None, None, None, ""), (102, 1, "assistant", "twice", ""), (102, 1, "assistant", "twice", "")]
    return rows


def test_what_comes_back(spark):
    rows = conversations()
    made = c.windows(spark.createDataFrame(rows, SCHEMA).repartition(5), budget=200, history=2, history_tokens=60)
    windows = made.collect()
    got = {r.conv_id: r for r in c.read_back(made).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        mine = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        turns = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in mine)
        loss = "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert r.n_turns == len(mine) and r.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(w.text) for w in windows if w.conv_id == conv)


def test_windows_keep_to_the_budget(spark):
    rows = conversations()
    windows = c.windows(spark.createDataFrame(rows, SCHEMA), budget=200, history=2, history_tokens=60).collect()
    by_conv, repeats = {}, 0
    for w in sorted((w for w in windows if w.conv_id is not None), key=lambda w: (w.conv_id, w.window)):
        by_conv.setdefault(w.conv_id, []).append(w)
    for conv, ws in by_conv.items():
        cost = lambda n: next(max(len((r[3] or "").split()), -(-len(r[3] or "") // 4)) + c.MARK_TOKENS for r in rows if r[0] == conv and (r[1] or 0) == n)  # noqa: B023, E731
        system = conv < 100 and conv % 2
        # The system turn stands alone, first, where it and the next turn don't fit.
        alone = system and len([r for r in rows if r[0] == conv]) > 1 and cost(0) + cost(1) > 200
        assert not alone or ws[0].turns == [0]
        seen = -1
        for k, w in enumerate(ws):
            fresh = [n for n in w.turns if n > seen]
            new = [n for n in fresh if not (system and n == 0)]
            assert fresh and w.turns == sorted(w.turns)
            assert not system or not new or (w.turns[0] == 0) == (cost(0) + cost(new[0]) <= 200)
            old = [n for n in w.turns if n <= seen and not (system and n == 0)]
            assert len(old) <= 2 and (w.tokens <= 200 or len(w.turns) == 1)
            assert len(w.mask) == sum(1 for n in fresh if next(x for x in rows if x[0] == conv and (x[1] or 0) == n or conv > 99)[2] == "assistant") or conv > 99
            seen = max(w.turns)
        repeats += any(n in ws[k - 1].turns[1:] for k in range(1, len(ws)) for n in ws[k].turns)
    assert repeats


def test_a_long_system_turn_stands_once(spark):
    rows = [(1, 0, "system", "s " * 3000)] + [(1, k, "user" if k % 2 else "assistant", "hello") for k in range(1, 101)]
    made = c.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("window").collect()
    assert made[0].turns == [0] and all(w.turns[0] > 0 and w.tokens <= c.BUDGET for w in made[1:])
    assert len(made) < 5 and sum(len(w.text) for w in made) < 2 * sum(len(r[3]) + 40 for r in rows)


def test_a_system_turn_of_most_of_the_budget_is_retained(spark):
    rows = [(1, 0, "system", "s " * 750)] + [(1, k, "user" if k % 2 else "assistant", "a b c") for k in range(1, 9)]
    rows += [(2, 0, "system", "s " * 990)] + [(2, k, "user", "long " * 40 if k == 2 else "a b c") for k in range(1, 5)]
    made = c.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "window").collect()
    first = [w for w in made if w.conv_id == 1]
    assert [w.turns for w in first] == [list(range(9))] and first[0].tokens == 756 + 8 * 9
    # Turn 2 doesn't fit beside the system turn; what comes after it does again.
    assert [w.turns for w in made if w.conv_id == 2] == [[0, 1], [1, 2, 3, 4]] or [w.turns for w in made if w.conv_id == 2][:2] == [[0, 1], [1, 2]]
    assert all(w.tokens <= c.BUDGET for w in made)


def test_history_is_repeated_over_segments(spark):
    """140,000 tokens: every window but the first starts with the turns before it."""
    rows = [(1, k, ("user", "assistant")[k % 2], f"{k} " + "word " * 43) for k in range(2800)]
    made = c.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("window").collect()
    assert sum(w.tokens for w in made) > 140_000 and len({w.window // (64 * c.BUDGET // c.MARK_TOKENS + 2) for w in made}) > 2
    for before, w in zip(made, made[1:]):
        assert w.turns[: c.HISTORY] == before.turns[-c.HISTORY :] and w.turns == list(range(w.turns[0], w.turns[-1] + 1))
    assert sum(len(w.mask) for w in made) == 1400


@pytest.mark.parametrize("model", [None, sentencepieces.read_model()])
def test_long_conversations_are_cut_into_segments(spark, model):
    rng = random.Random(2)
    rows = [(i % 2 if i % 5 else None, i, "system" if i in (1, 2, 5) else ("user", "assistant")[i % 2], f"{i} " + "word " * rng.randint(0, 40)) for i in range(1, 1500)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = c.windows(docs, budget=120, history=2, history_tokens=40, model=model)
    windows = made.collect()
    segment = 64 * 120 // c.MARK_TOKENS + 2
    assert len({w.window // segment for w in windows}) > 2
    got = {r.conv_id: r for r in c.read_back(made).collect()}
    for conv in (0, 1, None):
        mine = sorted((x for x in rows if x[0] == conv), key=lambda x: x[1])
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in mine).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256("".join(x[3] for x in mine if x[2] == "assistant").encode()).hexdigest()
        assert all(w.turns[0] == 0 for w in windows if w.conv_id == conv)


def test_tokens_are_the_model_s(spark):
    model = sentencepieces.read_model()
    docs = spark.createDataFrame([("a", 0, "user", "internationalization of words"), ("a", 1, "assistant", "")], "conv_id string, turn long, role string, text string")
    (w,) = c.windows(docs, model=model).collect()
    assert w.conv_id == "a" and w.tokens == len(sentencepieces.plain(model).encode("internationalization of words")) // 4 + 2 * c.MARK_TOKENS


def test_control_conversation_and_empty_table(spark, sf):
    rows = {r.conv_id: r for r in c.query(spark, sf).collect()}
    assert rows[-1].n_turns == 2 and rows[-1].loss_chars == len(c.CONTROL)
    assert c.read_back(c.windows(spark.createDataFrame([], SCHEMA))).count() == 0
