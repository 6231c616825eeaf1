import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import test_line_dedup, test_mixing, test_quality_rules, test_simhash
from tracewell.llm import quality_rules, sentencepieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    for df in stages[1:-1]:
        assert tuple(df.columns) == corpus_pipeline.COLUMNS


def test_rules_then_lines(stages):
    before, kept = rows(stages[0]), rows(stages[1])
    for i, r in before.items():
        n, chars, symbols, _, covered = test_quality_rules.by_hand(r.text)
        if n < 20 or 100 * covered > 30 * n or symbols > 0.25 * n:
            assert i not in kept
    want = test_line_dedup.by_hand([(i, r.text) for i, r in kept.items()])
    after = rows(stages[2])
    for i, (text, exact, near) in want.items():
        if exact + near and not text.strip():
            assert i not in after
        else:
            assert after[i].text == text and after[i].n_chars == len(text)


def test_one_of_each_group_stays(stages):
    docs = sorted(rows(stages[2]).values(), key=lambda r: r.doc_id)
    parts = test_simhash.groups([test_simhash.by_hand(r.text) for r in docs])
    assert sorted(rows(stages[3])) == [docs[i].doc_id for i in sorted(set(parts))]


def test_mixing_and_pieces(stages):
    mixed = stages[4].groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = {r.doc_id: len((r.text or "").split()) for r in stages[3].collect()}
    sources = {r.doc_id: r.source for r in stages[3].collect()}
    assert all(1 <= r.n <= 3 and r.doc_id in sizes for r in mixed)
    total = {}
    for i, s in sources.items():
        total[s] = total.get(s, 0) + sizes[i]
    goal, taken = test_mixing.level(total), {}
    for r in mixed:
        taken[sources[r.doc_id]] = taken.get(sources[r.doc_id], 0) + r.n * sizes[r.doc_id]
    largest = {s: max(sizes[i] for i in sources if sources[i] == s) for s in goal}
    assert all(abs(taken.get(s, 0) - g) <= 2 * largest[s] + 0.1 * g for s, g in goal.items())
    pieces, texts = sentencepieces.Pieces(sentencepieces.read_model(), 0.0), rows(stages[3])
    out = stages[5].collect()
    assert len(out) == stages[4].count()
    assert all(pieces.decode(r.ids) == texts[r.doc_id].text for r in out)


def test_run_is_its_stages(spark, sf, stages):
    same = lambda df: sorted((r.doc_id, r.n_tokens, int(np.sum(r.ids))) for r in df.collect())
    assert same(corpus_pipeline.run(spark, sf)) == same(stages[-1])


def test_odd_tables(spark, sf):
    good = "the cat sat on the mat and the dog ran to a hill with the sun in its eyes for most of that long day"
    odd = [(1, good, "en", "a", 9, "x"), (1, good, "en", "a", 9, "x"), (None, good + " or so", None, None, None, None), (3, None, "en", "b", 0, ""), (4, "", "en", "b", 0, ""), (5, "w " * 30_000, "en", "b", 1, "")]
    for some in (odd, []):
        docs = spark.createDataFrame(some, SCHEMA)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
            docs.count()


def test_queries_are_registered(spark, sf):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)}
    assert quality_rules.query(spark, sf).count() > 0


def test_names_that_operators_use_themselves(spark):
    from tracewell.llm import line_dedup, mixing, simhash, url_filter

    names = ("_k1", "_k2", "_text", "_th", "_w", "_h", "_s", "_keys", "_in", "in", "_hits", "fp", "near", "_gone", "_n", "first", "kept", "rule", "copies", "size", "_tie")
    text = "the cat sat on the mat and the dog ran to a hill with the sun in its eyes for most of that long day"
    docs = spark.createDataFrame([(1, text, "s", "http://a.com/en/", *names), (2, text, "s", None, *names)], "doc_id long, text string, source string, url string, " + ", ".join(f"`{n}` string" for n in names))
    for f in (quality_rules.quality_rules, line_dedup.line_dedup, simhash.near_dedup, mixing.mix, url_filter.url_filter):
        out = f(docs)
        made = {"quality_rules": {"kept"}, "url_filter": {"rule"}}.get(f.__name__, set())
        for r in out.collect():
            assert all(r[n] == n for n in names if n not in made), f.__name__
