"""Search over a history that came in by parts: an index that grows, of which sources are replaced."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators.index import TermIndex
from tracewell.operators.ranking import new_folder

from .registry import query
from .retrieval import BENCH, QUERY, _bench, _docs, _one, _sql
from .sessions import _HIST, _history

#: Runs of words; of a run of Han, kana or Hangul its pairs.
_CJK = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}"
_RUNS = rf"regexp_extract_all(lower(coalesce(text, '')), '[{_CJK}]+|(?:[\p{{Nd}}_]|[^\P{{L}}{_CJK}])+')"
_PAIRS = rf"flatten(list_transform({_RUNS}, lambda r: case when regexp_full_match(r, '[{_CJK}]{{2,}}') then list_transform(range(1, length(r)), lambda i: substr(r, i::int, 2)) else [r] end))"

_SQL = rf"""with {_HIST}, q as ({BENCH} union all select -1 - conv_id, any_value(text order by turn) from conversations where role = 'user' group by conv_id having conv_id % 10 = 0),
t as (select query_id, unnest(list_distinct({_PAIRS})) term from q),
d as (select conv_id || ':' || turn || ':' || kind doc_id, kind, {_PAIRS} w from k), l as (select doc_id, kind, len(w) dl, w from d where len(w) > 0),
s as (select count(*) n, sum(dl) / count(*) avgdl from l), p as (select doc_id, kind, dl, term, count(*) tf from (select doc_id, kind, dl, unnest(w) term from l) group by all),
f as (select term, count(*) df from p group by term),
h as (select query_id, doc_id, kind, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))), 6) score from p join f using (term) join t using (term), s group by all)"""


def _index(t) -> TermIndex:
    """The history's documents in three batches: some of their first turns are wrong until the last one replaces them."""
    docs = _history(t).select(F.lit("").alias("scope"), F.col("session").cast("string").alias("source"), F.col("id").alias("doc_id"), "kind", "order", "text")
    spark = docs.sparkSession
    index = TermIndex(spark, new_folder(spark), "kind string", buckets=8)
    changed = F.col("source").cast("long") % 3 == 0
    early = docs.filter("order < 4")
    index.append(early.withColumn("text", F.when(changed, F.lit("of another time")).otherwise(F.col("text"))))
    index.append(docs.filter("order >= 4").filter(~changed))
    index.replace(docs.filter(changed))
    return index


def _asks(t):
    prompts = t("conversations").filter("role = 'user' and conv_id % 10 = 0").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return _bench(t).unionByName(prompts.select((-1 - F.col("conv_id")).alias("query_id"), "text"))


@query("history_search", _SQL + ', r as (select *, row_number() over (partition by query_id order by score desc, doc_id) "rank" from h) select query_id, doc_id, score, "rank" from r where "rank" <= 5')
def _(t):
    """Pairs of CJK characters are terms; what common words bring in alone is left out unseen."""
    return _index(t).search(_asks(t), 5, prune=True).drop("scope")


@query("history_search_kinds", _SQL + """, r as (select *, row_number() over (partition by query_id order by score desc, doc_id) "rank" from h where kind in ('user', 'tool_error')) select query_id, doc_id, score, "rank" from r where "rank" <= 5""")
def _(t):
    return _index(t).search(_asks(t), 5, "kind in ('user', 'tool_error')").drop("scope")


@query("index_by_scope", _sql(f"select 0 query_id, '{QUERY}' text") + ' select scope, doc_id, score, "rank" from r where "rank" <= 5')
def _(t):
    """The search of bm25_topk_by_scope, on a stored index."""
    docs = _docs(t)
    index = TermIndex(docs.sparkSession, new_folder(docs.sparkSession), doc_id="long", tokenize=text.tokens)
    index.append(docs.withColumn("source", F.lit("documents")))
    return index.search(_one(t), 5).drop("query_id")
