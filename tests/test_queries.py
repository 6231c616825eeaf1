"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import hashlib
import json
import math
from collections import Counter

import duckdb
import pytest
import regex

from tracewell import plans

TABLES = "region nation supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(frame[cols].astype(object).where(frame[cols].notna(), None).astype(str).values.tolist())


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_its_sql(spark, sf, duck, name):
    got, want = plans.QUERIES[name](spark, sf).toPandas(), duck.sql(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.fixture(scope="module")
def tables(spark, sf):
    return lambda name: spark.read.parquet(f"{sf}/{name}.parquet").toPandas()


def got(spark, sf, name):
    return plans.QUERIES[name](spark, sf).toPandas()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def parts(word):
    """A word's segments by case, underscore and digit, by hand."""
    kind = lambda c: "_" if c == "_" else "d" if c.isdecimal() else "u" if c.isupper() else "l" if c.islower() else "o"
    out = [""]
    for i, c in enumerate(word):
        k, before = kind(c), kind(word[i - 1]) if i else ""
        after = kind(word[i + 1]) if i + 1 < len(word) else ""
        cut = i and (k == "_" or before == "_" or (before == "l" and k == "u") or (before == "d") != (k == "d") or (before == k == "u" and after == "l"))
        out = [*out, c] if cut else [*out[:-1], out[-1] + c]
    out = [x for x in out if x.strip("_")]
    return [x.lower() for x in out if len(x) > 1] if len(out) > 1 else []


def symbol_tokens(text):
    return [y for w in regex.findall(r"[\p{L}\p{Nd}_]+", text or "") for y in (w.lower(), *parts(w))]


def test_symbol_tokens(spark, sf, tables):
    docs = tables("documents")
    want = {r.doc_id: len(symbol_tokens(r.text)) for r in docs.itertuples()}
    assert dict(got(spark, sf, "symbol_tokens").itertuples(index=False)) == want


def test_bm25f(spark, sf, tables):
    docs, weights = tables("documents"), (("source", 2.5), ("lang", 2.0), ("text", 1.0))
    counts = {r.doc_id: Counter() for r in docs.itertuples()}
    for r in docs.itertuples():
        for column, w in weights:
            for x in symbol_tokens(getattr(r, column)):
                counts[r.doc_id][x] += w
    size = {i: sum(c.values()) for i, c in counts.items()}
    some = [i for i in size if size[i]]
    n, mean = len(some), sum(size.values()) / len(some)
    df = Counter(x for c in counts.values() for x in c)
    want = set()
    for q in tables("benchmark").itertuples():
        terms = set(symbol_tokens(q.text))
        scores = {i: round(sum(math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * c[x] * 2.2 / (c[x] + 1.2 * (0.25 + 0.75 * size[i] / mean)) for x in terms if x in c), 6) for i, c in counts.items() if terms & c.keys()}
        want |= {(q.item_id, i, k) for k, (i, _) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5], 1)}
    rows = got(spark, sf, "bm25f_topk")
    assert set(rows[["query_id", "doc_id", "rank"]].itertuples(index=False, name=None)) == want


def test_context_hash(spark, sf, tables):
    want = {}
    for conv, g in tables("conversations").groupby("conv_id"):
        g = g.sort_values(["turn", "role", "text"])
        want[conv] = sha(json.dumps([{"role": r.role, "content": r.text} for r in g.itertuples()], ensure_ascii=False, separators=(",", ":")))
    assert dict(got(spark, sf, "context_hash").itertuples(index=False)) == want


def test_adapt_summary(spark, sf):
    rows = got(spark, sf, "adaptive_tau")
    taus = sorted(rows.tau_low)
    assert got(spark, sf, "adapt_summary").iloc[0].to_dict() == {"least": taus[0], "median": taus[len(taus) // 2], "most": taus[-1], "entries": len(taus), "adjustments": rows.n_adjust.sum()}


def test_injection_blocks_hold_what_is_admitted(spark, sf):
    from tracewell.plans.decisions import _admission

    want = _admission(lambda n: spark.read.parquet(f"{sf}/{n}.parquet")).filter("reason = 'admitted'").groupBy("query_id").count().toPandas()
    rows = got(spark, sf, "injection_block")
    assert set(rows.query_id) == set(want.query_id) and (rows.n_bytes > 100).all()


def test_recall_block_keeps_to_its_budget(spark, sf):
    rows, hits = got(spark, sf, "recall_block"), got(spark, sf, "auto_recall").groupby("query_id").size()
    assert (rows.used <= 1_200).all() and (rows.n + rows.omitted == rows.query_id.map(hits)).all() and (rows.n > 0).all()


def test_near_duplicate_merge(spark, sf, tables):
    sets = {r.doc_id: frozenset(regex.findall(r"[\p{L}\p{Nd}_]+", (r.text or "").lower())) for r in tables("documents").sort_values("doc_id").itertuples()}
    reps, n = [], Counter()
    for i, s in sets.items():
        if s:
            rep = next((r for r in reps if round(len(s & sets[r]) / len(s | sets[r]), 6) >= 0.6), i)
            reps += [i] if rep == i else []
            n[rep] += 1
    assert dict(got(spark, sf, "near_duplicate_merge").itertuples(index=False)) == {i: k for i, k in n.items() if k > 1}


def test_ann_recall_of_the_query_itself(spark, sf):
    found, exact = (set(got(spark, sf, n)[["query_id", "vec_id"]].itertuples(index=False, name=None)) for n in ("vector_ann", "vector_topk"))
    assert len(found & exact) >= 0.9 * len(exact)


def test_reranked(spark, sf):
    rows = got(spark, sf, "reranked")
    for _, g in rows.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, len(g) + 1)) and len(g) <= 5
        assert g.sort_values(["score", "doc_id"], ascending=[False, True]).doc_id.tolist() == g.doc_id.tolist()
        assert all(abs(r.score - 1 / (1 + r.doc_id % 7)) < 1e-12 for r in g.itertuples())


def test_false_hits_over_whole_prompts(spark, sf, tables):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
        return row[-1]

    users = tables("conversations").query("role == 'user'").sort_values(["conv_id", "turn"])
    want = {}
    for conv, g in users.groupby("conv_id"):
        r = list(g.itertuples())
        for k in range(1, len(r)):
            if k % 2 == 1:  # the one before, by an odd number, was answered from the cache
                a, b = r[k - 1].text, r[k].text
                like = round(1 - distance(a, b) / max(len(a), len(b)), 6)
                if like >= 0.2:
                    want[conv, r[k].turn] = like
    rows = got(spark, sf, "false_hit_whole")
    assert {(r.conv_id, r.turn): round(r.likeness, 6) for r in rows.itertuples()} == pytest.approx(want)


def test_compacted_and_sanitized(spark, sf, tables):
    from tracewell.operators.cards import _compact

    docs = {r.doc_id: r.text for r in tables("documents").itertuples()}
    rows = got(spark, sf, "compacted")
    assert all(r.text_sha256 == sha(_compact(docs[r.doc_id], 2000)) and r.n_bytes <= 2000 for r in rows.itertuples())
    clean = {i: t for i, t in docs.items() if t and "@" not in t and not regex.search(r"[\x1b\x80-\x9f]|sk-|AKIA|ghp_|xox|/home|/Users|instructions|prompt", t)}
    got_ = dict(got(spark, sf, "sanitized").itertuples(index=False))
    assert clean and all(got_[i] == sha(t) for i, t in clean.items())


CHECKED = {"symbol_tokens", "bm25f_topk", "context_hash", "adapt_summary", "injection_block", "recall_block", "near_duplicate_merge", "vector_ann", "reranked", "false_hit_whole", "compacted", "sanitized"}


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL) - CHECKED))
def test_other_queries_without_sql_repeat_themselves(spark, sf, name):
    first, again = got(spark, sf, name), got(spark, sf, name)
    assert len(first) and rows(first) == rows(again)
