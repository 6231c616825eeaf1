"""Queries of fitting, gates, caches, arms, probes and incremental catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import catalog as C
from tracewell.operators import hooks as H
from tracewell.operators import learning as L
from tracewell.operators import retrieval as R

from .quality import NOW, SLICES, slices
from .registry import query
from .retrieval import BENCH, ZONE, _bench, _docs, _sql
from .usage import USAGE, usage


@query("fit_weights")
def _(t):
    """Parameters after one fit to whether a document is of good quality."""
    rows = slices(t).join(t("labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("relevant")), "id")
    got = L.fit_weights(rows, NOW)
    return t("region").limit(1).select(*[F.lit(v).alias(k) for k, v in got.items()])


@query("lookup", _sql(BENCH) + f", g as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) rank, max(score) over (partition by query_id) t from r) select query_id, doc_id, score, {ZONE.format(s='score', t='t')} zone from g where rank <= 5")
def _(t):
    hits = R.bm25_top(_docs(t), _bench(t), 50, by=("query_id",))
    return L.lookup(hits).select("query_id", "doc_id", "score", "zone")


_ANEW = """, g as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) k from r), n as (select *, count(*) over (partition by query_id) > 1{} ok from g where k <= 20),
y as (select query_id, doc_id, case when ok then 1 / (1 + doc_id % 7)::double else score end score, ok reranked, row_number() over (partition by query_id order by case when ok then doc_id % 7 else k end, doc_id)::int "rank" from n) select {} from y where "rank" <= 5"""


@query("reranked", _sql(BENCH) + _ANEW.format("", 'query_id, doc_id, score, "rank"'))
def _(t):
    """Hits scored again by a stand-in for an outside model: the share of terms found."""
    hits = R.bm25_top(_docs(t), _bench(t), 20, by=("query_id",))
    return L.rerank(hits, lambda rows: 1 / (1 + rows["doc_id"] % 7))


@query("reranked_guarded", _sql(BENCH) + _ANEW.format(" and query_id % 5 <> 0", 'query_id, doc_id, score, reranked, "rank"'))
def _(t):
    """A stand-in for an outside model forgets a hit of every fifth query, which keeps its order."""
    hits = R.bm25_top(_docs(t), _bench(t), 20, by=("query_id",))
    return H.reranked(hits, lambda q, found: [(h["doc_id"], 1 / (1 + h["doc_id"] % 7)) for h in found[q % 5 == 0 :]])


@query("verdict_cache", f"with {USAGE}, q as (select distinct 'q' || k % 50 query, session slice_id from u), c as (select 'q' || k % 50 query, session slice_id, arg_max(case when k % 2 = 0 then 'yes' else 'no' end, event_id) verdict from u where event_id > 3000 group by 1, 2) select query, slice_id, verdict from q left join c using (query, slice_id)")
def _(t):
    q = F.concat(F.lit("q"), (F.col("k") % 50).cast("string"))
    rows = usage(t).select(q.alias("query"), F.col("session").alias("slice_id"), F.when(F.col("k") % 2 == 0, "yes").otherwise("no").alias("verdict"), F.col("event_id").alias("at"))
    return L.with_verdicts(rows.select("query", "slice_id").distinct(), rows, 3000 + 86_400).select("query", "slice_id", "verdict")


@query("judge_chain", "select event_id, case when event_id % 9 = 0 then 'fingerprint' when event_type = 'error' then 'zone' when event_type = 'view' then 'approved' when event_id % 3 = 1 then 'approved' when event_id % 3 = 2 then 'judge_error' else 'judge_reject' end decision from events")
def _(t):
    i, e = F.col("event_id"), F.col("event_type")
    zone = F.when(e == "error", "miss").when(e == "view", "hit").otherwise("grey")
    return t("events").select("event_id", L.judged(zone, i % 9 == 0, F.when(i % 3 == 1, "yes").when(i % 3 == 2, "error").otherwise("no")).alias("decision"))


@query("arm_summary", f"with {USAGE}, a as (select case session % 2 when 0 then 'on' else 'off' end arm, * from u), d as (select arm, count(*) candidates, count(*) filter (k > 60) admitted from a where provider = 'view' group by arm) select arm, count(*) requests, sum(tokens_in)::bigint tokens_in, sum(tokens_out)::bigint tokens_out, any_value(candidates) candidates, any_value(admitted) admitted, round(any_value(admitted) / any_value(candidates), 6) acceptance from a join d using (arm) group by arm")
def _(t):
    rows = usage(t).withColumn("arm", F.when(F.col("session") % 2 == 0, "on").otherwise("off"))
    return L.arm_summary(rows, rows.filter("provider = 'view'").withColumn("admitted", F.col("k") > 60))


@query("probe_rotation", "with d as (select event_type tool, row_number() over (order by event_type) - 1 slot from (select distinct event_type from events where event_type in ('error', 'signup', 'view'))), p as (select event_id plan_no from events) select plan_no, case when plan_no % 10 = 9 then tool else '' end probe from p left join d on (plan_no // 10) % 3 = slot")
def _(t):
    from pyspark.sql import Window

    tools = t("events").filter(F.col("event_type").isin("error", "signup", "view")).select(F.col("event_type").alias("tool")).distinct()
    demoted = tools.withColumn("slot", (F.row_number().over(Window.orderBy("tool")) - 1).cast("long"))  # a row a tool
    return L.probes(t("events").select(F.col("event_id").alias("plan_no")), demoted).select("plan_no", F.coalesce("probe", F.lit("")).alias("probe"))


@query("currencies", "select event_id, case event_id % 6 when 0 then 'CNY' when 1 then 'USD' when 2 then 'EUR' when 3 then 'CHF' when 4 then 'odd money' else '' end code from events")
def _(t):
    raw = F.element_at(F.array(*map(F.lit, (" rmb ", "$", "Euros", "chf", "odd money", " "))), (F.col("event_id") % 6 + 1).cast("int"))
    return t("events").select("event_id", L.currency(raw).alias("code"))


@query("context_hash")
def _(t):
    return L.context_hash(t("conversations"))


@query("history_changes", "with k as (select doc_id id, md5(text) d from documents where n_chars > 300), s as (select doc_id id, md5(case when lang = 'de' then text || '!' else text end) d from documents where n_chars < 3000) select id, case when k.d is null then 'added' when s.d is null then 'removed' else 'changed' end change from k full join s using (id) where k.d is distinct from s.d")
def _(t):
    d = t("documents")
    known = d.filter("n_chars > 300").select(F.col("doc_id").alias("id"), F.md5("text").alias("digest"))
    seen = d.filter("n_chars < 3000").select(F.col("doc_id").alias("id"), F.md5(F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("digest"))
    return L.changed(known, seen)


@query("carried_stats", f"with {SLICES} select id, case when lang = 'en' then hits else 0 end hits from s")
def _(t):
    """Extracted again: counters stay where the evidence is the same."""
    old = slices(t).withColumn("evidence", F.col("lang"))
    new = old.withColumn("evidence", F.when(F.col("lang") == "en", "en").otherwise("new")).withColumn("hits", F.lit(0).cast("long"))
    return L.carried(new, old, ("hits",)).select("id", "hits")


@query("outcome_counts", "with d as (select distinct user_id id, (event_id // 10)::bigint delivery from events), o as (select id, delivery, case delivery % 3 when 0 then 'useful' when 1 then 'neutral' else 'harmful' end outcome from d) select id, count(*) filter (outcome = 'useful') useful, count(*) filter (outcome = 'neutral') neutral, count(*) filter (outcome = 'harmful') harmful from o group by id")
def _(t):
    delivery = F.floor(F.col("event_id") / 10)
    outcome = F.element_at(F.array(*map(F.lit, ("useful", "neutral", "harmful"))), (delivery % 3 + 1).cast("int"))
    return L.outcome_counts(t("events").select(F.col("user_id").alias("id"), delivery.alias("delivery"), outcome.alias("outcome")))


@query("topic_projection", """with recursive t as (select event_id id, case when event_id % 7 = 0 then null else event_id - 1 - event_id % 3 end parent, case when event_id % 4 = 0 then '' else event_type end topic, ts from events),
r as (select id, id root from t where parent is null or parent not in (select id from t) union all select t.id, r.root from t join r on t.parent = r.id), f as (select root, arg_min(topic, (ts, t.id)) f from r join t using (id) where topic <> '' group by root)
select r.id, r.root, coalesce(nullif(o.topic, ''), f, '') topic from r join t o on o.id = r.root left join f on f.root = r.root""")
def _(t):
    i = F.col("event_id")
    rows = t("events").select(i.alias("id"), F.when(i % 7 != 0, i - 1 - i % 3).alias("parent"), F.when(i % 4 == 0, "").otherwise(F.col("event_type")).alias("topic"), F.col("ts").alias("created"))
    return L.anchored(rows, C.roots(rows.select("id", "parent")))


@query("reuse_panel", f"with {USAGE}, s as (select session, provider, count(*) n, min(seq) f from u where l3_reuse group by all) select session, provider, n, row_number() over (partition by session order by n desc, f) place from s qualify place <= 3")
def _(t):
    from pyspark.sql import Window

    s = usage(t).filter("l3_reuse").groupBy("session", "provider").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("f"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("n"), "f"))).filter("place <= 3").drop("f")
