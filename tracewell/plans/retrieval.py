"""Queries of retrieval over documents (lang is the scope), benchmark texts as queries, and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.functions import scores, text
from tracewell.operators import blocks, retrieval as R
from tracewell.operators.ranking import kept, small

from .registry import query

QUERY = "the error of token and with la de und von que"
TOK = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{Nd}}_]+')"


def _docs(t):
    return t("documents").select(F.col("lang").alias("scope"), "doc_id", "text")


def _one(t):
    return t("region").limit(1).select(F.lit(0).alias("query_id"), F.lit(QUERY).alias("text"))


def _bench(t):
    return t("benchmark").select(F.col("item_id").alias("query_id"), "text")


def _sql(queries: str) -> str:
    return rf"""with q as ({queries}), t as (select query_id, unnest(list_distinct({TOK.format("text")})) term, len(list_distinct({TOK.format("text")})) n_terms from q),
d as (select lang scope, doc_id, {TOK.format("text")} w from documents), l as (select scope, doc_id, len(w) dl, w from d where len(w) > 0),
s as (select scope, count(*) n, sum(dl) / count(*) avgdl from l group by scope),
p as (select scope, doc_id, dl, term, count(*) tf from (select scope, doc_id, dl, unnest(w) term from l) where term in (select term from t) group by all),
f as (select scope, term, count(*) df from p group by all),
h as (select query_id, scope, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))), 6) score, count(*) n_matched, any_value(n_terms) n_terms
      from p join f using (scope, term) join s using (scope) join t using (term) group by all),
r as (select *, row_number() over (partition by query_id, scope order by score desc, doc_id) rank from h)"""


ONE = f"select 0 query_id, '{QUERY}' text"
BENCH = "select item_id query_id, text from benchmark"


@query("bm25_topk_by_scope", _sql(ONE) + " select scope, doc_id, score, rank from r where rank <= 5")
def _(t):
    return R.bm25_top(_docs(t), _one(t), 5).select("scope", "doc_id", "score", "rank")


ZONE = "case when {s} <= 0 or {t} <= 0 or {t} < 0.45 then 'miss' when {s} / {t} >= 0.8 and {t} >= 0.7 then 'hit' when {s} / {t} >= 0.55 then 'grey' else 'miss' end"


@query("bm25_zone", _sql(ONE) + f", z as (select scope, doc_id, score, {ZONE.format(s='score', t='max(score) over (partition by scope)')} zone, rank from r) select * from z where rank <= 50")
def _(t):
    hits = R.bm25_top(_docs(t), _one(t), 50).withColumn("top1", F.max("score").over(Window.partitionBy("query_id", "scope")))
    return hits.select("scope", "doc_id", "score", scores.zone(F.col("score"), F.col("top1")).alias("zone"), "rank")


@query("bm25_multi_query", _sql(BENCH) + ", b as (select *, max(score) over (partition by query_id, scope) t from r) select query_id, scope, doc_id, score, rank, round(n_matched / n_terms, 6) coverage from b where score >= 0.15 * t and rank <= 5")
def _(t):
    hits = R.floor_by_top(R.bm25_top(_docs(t), _bench(t), 5), 0.15)
    return hits.select("query_id", "scope", "doc_id", "score", "rank", F.round(R.coverage(), 6).alias("coverage"))


@query("query_top1_margin", _sql(BENCH) + """, m as (select query_id, max(score) filter (g = 1) top1, coalesce(max(score) filter (g = 2), 0) top2 from (select query_id, score, row_number() over (partition by query_id order by score desc, doc_id) g from r) group by query_id)
select query_id, top1, top2, round(top1 - top2, 6) margin, case when top1 <= 0 or top1 < 0.45 then 'miss' when top1 >= 0.7 and top1 - top2 >= 0.55 * top1 then 'hit' else 'grey' end zone from m""")
def _(t):
    hits = R.bm25_top(_docs(t), _bench(t), 2, by=("query_id",))
    pick = lambda k: F.max(F.when(F.col("rank") == k, F.col("score")))
    out = hits.groupBy("query_id").agg(pick(1).alias("top1"), F.coalesce(pick(2), F.lit(0.0)).alias("top2"))
    return out.select("query_id", "top1", "top2", F.round(F.col("top1") - F.col("top2"), 6).alias("margin"), scores.zone_top1(F.col("top1"), F.col("top2")).alias("zone"))


@query("zone_histogram", _sql(BENCH) + f", z as (select query_id, {ZONE.format(s='score', t='max(score) over (partition by query_id, scope)')} zone from r) select zone, count(*)::bigint n, count(distinct query_id)::bigint n_queries from z group by zone")
def _(t):
    z = R.with_top(R.bm25(_docs(t), _bench(t))).select("query_id", scores.zone(F.col("score"), F.col("top1")).alias("zone"))
    return z.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("query_id").alias("n_queries"))


@query("bm25_over_fetch", _sql(BENCH) + ", g as (select *, row_number() over (partition by query_id order by score desc, doc_id) g from r) select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) rank from g where g <= 20 and scope = 'en' qualify rank <= 5")
def _(t):
    """Fetches four times the hits, then keeps those of a scope: fewer than k may be left."""
    wide = R.bm25_top(_docs(t), _bench(t), 20, by=("query_id",)).filter("scope = 'en'").drop("rank")
    return R.top(wide, 5, by=("query_id",)).select("query_id", "doc_id", "score", "rank")


VEC = "with q as (select vec_id query_id, embedding q from embeddings where vec_id % 100 = 0)"


def _vectors(t):
    v = t("embeddings")
    return v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), v


@query("vector_topk", VEC + ", s as (select query_id, vec_id, round(list_dot_product(q::double[], embedding::double[]), 6) score from q join embeddings on len(q) = len(embedding)) select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) rank from s qualify rank <= 10")
def _(t):
    """Queries are the rows whose id is divisible by 100, against all rows."""
    return R.vector_topk(*_vectors(t), 10)


@query("vector_cosine", VEC + ", s as (select query_id, vec_id, round(list_dot_product(q::double[], embedding::double[]) / (sqrt(list_dot_product(q::double[], q::double[])) * sqrt(list_dot_product(embedding::double[], embedding::double[]))), 6) cosine from q join embeddings on len(q) = len(embedding)) select * from s where cosine >= 0.5")
def _(t):
    q, v = _vectors(t)
    return blocks.cosines(q, v, 0.5)


@query("vector_ann")
def _(t):
    q, v = _vectors(t)
    return R.ann_topk(q, v, 10)


HASHED = r"""with {q}
k as (select id, tok, count(*) n from (select id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+')) tok from src) group by all),
hh as (select id, n, list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(tok, ''), lambda c: ord(c)::bigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) h from k),
sl as (select id, h % 256 slot, sum(case when h % 2 = 0 then n else -n end)::double v from hh group by all having v <> 0),
e as (select id, slot, v / sqrt(sum(v * v) over (partition by id)) v from sl)"""


@query("hash_embed_topk", HASHED.format(q="src as (select doc_id id, text from documents union all select -1 - item_id, text from benchmark),") + " , s as (select -1 - a.id query_id, b.id doc_id, round(sum(a.v * b.v), 6) score from e a join e b using (slot) where a.id < 0 and b.id >= 0 group by all) select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) rank from s qualify rank <= 10")
def _(t):
    return R.hashed_topk(t("documents").select("doc_id", "text"), _bench(t), 10)


_ROUTES = _sql(BENCH) + """, a as (select query_id, doc_id, score from (select *, row_number() over (partition by query_id order by score desc, doc_id) g from r) where g <= 20),
src as (select doc_id id, text from documents union all select -1 - item_id, text from benchmark),
k as (select id, tok, count(*) n from (select id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+')) tok from src) group by all),
hh as (select id, n, list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(tok, ''), lambda c: ord(c)::bigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) h from k),
sl as (select id, h % 256 slot, sum(case when h % 2 = 0 then n else -n end)::double v from hh group by all having v <> 0),
e as (select id, slot, v / sqrt(sum(v * v) over (partition by id)) v from sl),
v as (select -1 - x.id query_id, y.id doc_id, round(sum(x.v * y.v), 6) score from e x join e y using (slot) where x.id < 0 and y.id >= 0 group by 1, 2 qualify row_number() over (partition by query_id order by score desc, doc_id) <= 20)"""


def _routes(t):
    lexical = R.bm25_top(_docs(t), _bench(t), 20, by=("query_id",)).select("query_id", "doc_id", "score")
    return lexical, R.hashed_topk(t("documents").select("doc_id", "text"), _bench(t), 20).select("query_id", "doc_id", "score")


@query("fusion_weighted", _ROUTES + """, n as (select query_id, doc_id, coalesce(x, 0) lexical, coalesce(y, 0) y from (select query_id, doc_id, score / max(score) over (partition by query_id) x from a) full join (select query_id, doc_id, score / max(score) over (partition by query_id) y from v) using (query_id, doc_id))
select query_id, doc_id, round(0.5 * lexical + 0.5 * y, 6) score, round(lexical, 6) lexical from n where round(0.5 * lexical + 0.5 * y, 6) > 0""")
def _(t):
    return R.fuse_weighted(*_routes(t))


@query("fusion_rrf", _ROUTES + """, u as (select query_id, doc_id, 1.0::double / (60 + row_number() over (partition by query_id order by score desc, doc_id)) s from a union all select query_id, doc_id, 1.0::double / (60 + row_number() over (partition by query_id order by score desc, doc_id)) from v)
select query_id, doc_id, round(sum(s) * 61 / 2, 6) score from u group by all""")
def _(t):
    return R.fuse_ranks([*_routes(t)])


@query("near_duplicates", rf"""with s as (select doc_id, list_sort(list_distinct({TOK.format("text")})) w from documents), r as (select doc_id, w from s where len(w) > 0),
p as (select x.doc_id a, y.doc_id b, len(list_intersect(x.w, y.w)) c, len(x.w) m, len(y.w) n from r x join r y on x.doc_id < y.doc_id and least(len(x.w), len(y.w)) >= 0.6 * greatest(len(x.w), len(y.w)))
select a, b, round(c / (m + n - c), 6) jaccard from p where round(c / (m + n - c), 6) >= 0.6""")
def _(t):
    return R.near_duplicate_pairs(t("documents").select("doc_id", "text"))


@query("near_duplicate_members", rf"with s as (select doc_id, list_sort(list_distinct({TOK.format('text')})) w from documents) select doc_id, min(doc_id) over (partition by w) representative from s where len(w) > 0")
def _(t):
    """The exact copies of each document, by the least of them."""
    return R.set_members(t("documents").select("doc_id", "text"))


@query("tokens", rf"select doc_id, len({TOK.format('text')})::bigint n_tokens, len(list_distinct({TOK.format('text')}))::bigint n_distinct, sha256(array_to_string({TOK.format('text')}, ' ')) tokens_sha256 from documents")
def _(t):
    w = text.tokens(F.col("text"))
    return t("documents").select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.sha2(F.array_join("w", " "), 256).alias("tokens_sha256"))


@query("symbol_tokens")
def _(t):
    w = text.symbol_tokens(F.col("text"))
    return t("documents").select("doc_id", F.size(w).cast("long").alias("n_tokens"))


@query("bigram_tokens", rf"select doc_id, len({TOK.format('text')})::bigint n_tokens from documents")
def _(t):
    return t("documents").select("doc_id", F.size(text.bigram_tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("bm25f_topk")
def _(t):
    docs = t("documents").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("keywords"), F.col("text").alias("body"))
    return R.top(R.bm25f(docs, _bench(t), {"title": 2.5, "keywords": 2.0, "body": 1.0}, k=5), 5, by=("query_id",))


@query("snippets", _sql(ONE) + r""", b as (select doc_id, trim(regexp_replace(text, '[\t\n\x0B\f\r ]+', ' ', 'g')) f from (select * from r where rank <= 5) join documents using (doc_id)), c as (select doc_id, f, greatest(instr(lower(f), 'token') - 80, 1) p from b)
select doc_id, (case when p > 1 then '...' else '' end) || substring(f, p, 160) || (case when p + 159 < length(f) then '...' else '' end) snippet from c""")
def _(t):
    hits = R.bm25_top(_docs(t), _one(t), 5).select("doc_id")
    return t("documents").join(hits, "doc_id").select("doc_id", text.snippet(F.col("text"), F.lit("token")).alias("snippet"))


@query("prefetch_assembly", _sql("select 0 query_id, 'error token' text") + ", g as (select doc_id, row_number() over (order by score desc, doc_id) g from r) select doc_id, (row_number() over (order by doc_id))::int rank from g where g <= 3")
def _(t):
    """The three best hits for a tool's name, in the order of their ids."""
    q = t("region").limit(1).select(F.lit(0).alias("query_id"), F.lit("error token").alias("text"))
    return R.top(R.bm25_top(_docs(t), q, 3, by=("query_id",)).select(F.lit(0).alias("g"), "doc_id", (-F.col("doc_id")).alias("score")), 3, by=("g",)).select("doc_id", "rank")


@query("overlap_ranking", r"""with q as (select item_id query_id, list_distinct(regexp_split_to_array(lower(trim(text)), '\s+')) w from benchmark), d as (select doc_id, list_distinct(regexp_split_to_array(lower(trim(text)), '\s+')) w from documents),
c as (select query_id, doc_id, count(*) n, any_value(m) m from (select query_id, unnest(w) x, len(w) m from q) join (select doc_id, unnest(w) x from d) using (x) group by all)
select query_id, doc_id, round(n / m, 6) score, row_number() over (partition by query_id order by round(n / m, 6) desc, doc_id) rank from c qualify rank <= 5""")
def _(t):
    """Shares of a query's white-space words found in a document."""
    split = lambda c: F.array_distinct(F.split(F.lower(F.trim(c)), r"\s+"))
    q = _bench(t).select("query_id", split(F.col("text")).alias("w")).select("query_id", F.size("w").alias("m"), F.explode("w").alias("x"))
    d = t("documents").select("doc_id", F.explode(split(F.col("text"))).alias("x"))
    # Only asked words of documents go on.
    c = d.join(small(kept(q.select("x").distinct())), "x", "left_semi").join(q, "x").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("m").alias("m"))
    return R.top(c.select("query_id", "doc_id", F.round(F.col("n") / F.col("m"), 6).alias("score")), 5, by=("query_id",))
