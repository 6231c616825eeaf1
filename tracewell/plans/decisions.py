"""Queries of reuse decisions: benchmark texts are the queries, documents the slices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.operators import decisions as D
from tracewell.operators import retrieval as R
from tracewell.operators import sessions as S

from .registry import query
from .retrieval import BENCH, _bench, _docs, _sql
from .usage import USAGE, usage

_KIND = "case doc_id % 4 when 0 then 'prompt' when 1 then 'result' when 2 then 'memory' else 'result' end"
HITS = _sql(BENCH) + f""", h20 as (select query_id, doc_id, score, n_matched / n_terms coverage from r qualify row_number() over (partition by query_id order by score desc, doc_id) <= 20),
x as (select *, {_KIND} kind, case doc_id % 3 when 0 then 'import' when 1 then 'session-auto' else 'user-curated' end origin, case when doc_id % 5 = 0 then 'probation' else 'verified' end status, doc_id % 7 = 0 stale, doc_id % 6 <> 0 context_ok, case doc_id % 4 when 1 then 'yes' when 3 then 'no' end judged from h20)"""


def hits(t):
    i = F.col("doc_id")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (i % len(v) + 1).cast("int"))
    h = R.bm25_top(_docs(t), _bench(t), 20, by=("query_id",))
    return h.select(
        "query_id", "doc_id", "score", (F.col("n_matched") / F.col("n_terms")).alias("coverage"), pick("prompt", "result", "memory", "result").alias("kind"), pick("import", "session-auto", "user-curated").alias("origin"),
        F.when(i % 5 == 0, "probation").otherwise("verified").alias("status"), (i % 7 == 0).alias("stale"), (i % 6 != 0).alias("context_ok"), pick(None, "yes", None, "no").alias("judged"),
    )


_L3 = HITS + """, g as (select *, max(score) over (partition by query_id) gt, max(score) filter (kind = 'result') over (partition by query_id) rt from x), z as (select *, case when score <= 0 or gt < 0.45 then 'miss' when score / rt >= 0.8 and score / gt >= 0.45 and gt >= 0.7 then 'hit' when score / rt >= 0.55 and score / gt >= 0.45 then 'grey' else 'miss' end zone from g where kind = 'result'),
j as (select *, zone = 'grey' or origin = 'import' or coverage < 0.05 judge from z), y as (select *, case when zone = 'miss' then 'rules_reject' when judge and judged is null then 'no_judge' when judge and judged <> 'yes' then 'judge_reject' when not context_ok then 'isolated' when stale then 'fingerprint' else 'reusable' end reason from j),
l3 as (select query_id, doc_id, zone, reason, reason = 'reusable' and row_number() over (partition by query_id order by (reason = 'reusable') desc, score desc, doc_id) = 1 winner from y)"""


def _l3(t):
    return D.l3_decisions(hits(t).withColumn("created", F.lit(1)).withColumn("lexical", F.col("coverage")))


@query("l3_decision", _L3 + " select * from l3")
def _(t):
    return _l3(t).select("query_id", "doc_id", "zone", "reason", "winner")


@query("l3_counters", _L3.replace("l3 as (select query_id, doc_id, zone, reason,", "l3 as (select query_id, doc_id, zone, reason, judge and zone <> 'miss' asked, judged,") + """ select count(*) candidates, count(distinct query_id) lookups, count(*) filter (zone = 'hit') hit, count(*) filter (zone = 'grey') grey, count(*) filter (zone = 'miss') miss, count(*) filter (asked) judge_called, count(*) filter (asked and judged = 'yes') judge_approved,
count(*) filter (reason = 'judge_reject') judge_reject, 0::bigint judge_error, count(*) filter (reason = 'no_judge') no_judge, count(*) filter (reason = 'rules_reject') rules_reject, count(*) filter (reason = 'isolated') isolated, count(*) filter (reason = 'fingerprint') fingerprint, count(*) filter (winner) reused from l3""")
def _(t):
    return D.l3_counters(_l3(t))


@query("l3_learned_threshold", _L3.replace("zone from g where", "zone0, score / rt share from g where").replace("j as (select *,", "z1 as (select *, case when share < least(0.6 + doc_id % 4 / 10.0::double, 0.8) then 'miss' else zone0 end zone from z), j as (select *,").replace(" judge from z)", " judge from z1)") + " select query_id, doc_id, zone, reason, winner from l3")
def _(t):
    """Entries with lower thresholds of their own, as online feedback has learned them."""
    rows = hits(t).withColumn("created", F.lit(1)).withColumn("lexical", F.col("coverage"))
    return D.l3_decisions(rows, tau_low=0.6 + F.col("doc_id") % 4 / 10.0).select("query_id", "doc_id", "zone", "reason", "winner")


_KINDS = f"ks as (select {_KIND} kind, count(*) n, count(distinct source) sources from documents group by 1)"
_ADM = HITS + f""", {_KINDS}, a as (select x.*, sources, kind in ('result', 'memory') and not (kind = 'result' and status <> 'verified') and origin <> 'import' and not stale eligible from x join ks using (kind)),
b5 as (select *, row_number() over w rk, sum(eligible::int) over w e from a window w as (partition by query_id order by score desc, doc_id)), c5 as (select *, coalesce(max(score) filter (eligible and e = 1) over (partition by query_id), 0) top1, coalesce(max(score) filter (eligible and e = 1) over (partition by query_id) - max(score) filter (eligible and e = 2) over (partition by query_id), 0) top_margin from b5 where case when eligible then e <= 5 else rk <= 5 end),
d5 as (select *, case when score <= 0 or top1 <= 0 or top1 < 0.45 then 'miss' when score / top1 >= 0.8 and top1 >= 0.7 then 'hit' when score / top1 >= 0.55 then 'grey' else 'miss' end zone from c5),
adm as (select query_id, doc_id, score, rk, eligible, round(top_margin, 6) top_margin, zone, case when kind not in ('result', 'memory') then 'type_not_allowed' when kind = 'result' and status <> 'verified' then 'result_probation' when origin = 'import' then 'origin_below_floor' when stale then 'freshness' when sources < 2 then 'type_sources_too_few' when coverage < 0.2 then 'coverage_low' when zone = 'miss' then 'zone_miss' when zone = 'grey' then 'zone_grey' else 'admitted' end reason from d5)"""


def _library(t):
    kind = F.element_at(F.array(*map(F.lit, ("prompt", "result", "memory", "result"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return D.library_gates(t("documents").select(kind.alias("kind"), F.col("source").alias("session")))


def _admission(t, gates=D.Gates(("result", "memory"), 2, sources=2, coverage=0.2)):
    return D.admission(R.beside(hits(t), t("documents").select("doc_id", F.col("text").alias("content"))), _library(t), gates)


_STRICT = _ADM.replace("not stale eligible", "not stale and not (kind = 'memory' and doc_id % 8 = 2) eligible").replace("adm as (select", """strict as (select query_id, doc_id, eligible, case when kind not in ('result', 'memory') then 'type_not_allowed' when kind = 'result' and status <> 'verified' then 'result_probation' when origin = 'import' then 'origin_below_floor' when stale then 'freshness'
when max(case when eligible and e = 2 then 1 else 0 end) over (partition by query_id) = 0 then 'runner_up_missing' when top_margin < 0.5 then 'top_margin_low' when score < 4 then 'below_min_score' when coverage < 0.1 then 'coverage_low' when kind = 'memory' and doc_id % 8 = 2 then 'task_type_mismatch' when zone = 'miss' then 'zone_miss' else 'admitted' end reason from d5),
adm as (select""")


@query("admission_strict", _STRICT + " select query_id, doc_id, eligible, reason from strict")
def _(t):
    """All gates at once, grey hits let in: runner-up, margin, score, coverage and the task that a card is tagged with."""
    tag = F.concat(F.lit("Plan (task="), F.when(F.col("doc_id") % 8 == 2, "docs").otherwise("bugfix"), F.lit("):\n"), "text")
    rows = R.beside(hits(t), t("documents").select("doc_id", tag.alias("content")))
    gates = D.Gates(("result", "memory"), 2, "bugfix", 100, 2, True, 0.5, 4.0, 0.1, True)
    return D.admission(rows, _library(t), gates).select("query_id", "doc_id", "eligible", "reason")


@query("library_too_small", _ADM + " select query_id, doc_id, case when reason in ('type_not_allowed', 'result_probation', 'origin_below_floor', 'freshness') then reason else 'library_too_small' end reason from adm")
def _(t):
    return _admission(t, D.Gates(("result", "memory"), 2, library=1 << 40)).select("query_id", "doc_id", "reason")


@query("task_tags", "select doc_id, case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then 'bug-fix_2' else 'docs' end tag from documents")
def _(t):
    head = F.when(F.col("doc_id") % 3 == 0, "No tag").when(F.col("doc_id") % 3 == 1, "Plan (task=bug-fix_2):").otherwise("Outcome task=docs. X")
    return t("documents").select("doc_id", D.T.task_tag(F.concat(head, F.lit("\ntask=later "), F.coalesce("text", F.lit("")))).alias("tag"))


@query("admission_reasons", _ADM + " select query_id, doc_id, eligible, top_margin, zone, reason from adm")
def _(t):
    return _admission(t).select("query_id", "doc_id", "eligible", F.round("top_margin", 6).alias("top_margin"), "zone", "reason")


@query("retrieval_log", _ADM + " select reason, count(*) n, count(distinct query_id) n_queries, round(avg(score), 5) mean_score from adm group by reason")
def _(t):
    return _admission(t).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("query_id").alias("n_queries"), F.round(F.avg("score"), 5).alias("mean_score"))


@query("retrieval_provenance", _ADM + " select a.reason, d.source, d.doc_id is not null known, count(*) n, count(distinct query_id) n_queries from adm a left join (select * from documents where doc_id % 10 <> 3) d using (doc_id) group by all")
def _(t):
    """Decisions by where their slices come from; some slices are gone from the library."""
    known = t("documents").filter("doc_id % 10 <> 3").select("doc_id", "source")
    rows = D.with_provenance(_admission(t).select("query_id", "doc_id", "reason"), known)
    return rows.groupBy("reason", "source", "known").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("query_id").alias("n_queries"))


@query("prefetch_outcomes", "select event_type kind, case when user_id % 3 = 0 then 'blocked' when event_type in ('view', 'click') then 'warmed' else 'stored' end outcome, count(*) n from events group by all")
def _(t):
    """Tasks of three localities: what isn't local is blocked, and counted."""
    kind = F.when(F.col("event_type") == "view", "embedding").when(F.col("event_type") == "click", "file").otherwise(F.col("event_type"))
    tasks = t("events").select("event_type", kind.alias("kind"), F.when(F.col("user_id") % 3 == 0, F.when(F.col("user_id") % 2 == 0, "remote")).otherwise("local").alias("locality"))
    return D.prefetch_outcomes(tasks).groupBy(F.col("event_type").alias("kind"), "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("injection_packing")
def _(t):
    """Admitted texts packed into a budget of bytes, best first; one that doesn't fit is passed over."""
    rows = _admission(t).filter("reason = 'admitted'").select("query_id", "rank", F.col("doc_id").alias("id"))
    sized = R.beside(rows, t("documents").select(F.col("doc_id").alias("id"), F.octet_length("text").alias("size")), "id")
    return D.packed(sized, 4096).select("query_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "used")


@query("injection_order", _ADM + ", o as (select query_id, string_agg(doc_id::varchar, ',' order by score desc, doc_id) ids, count(*) n from adm where reason = 'admitted' group by query_id) select * from o")
def _(t):
    items = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id")))
    return _admission(t).filter("reason = 'admitted'").groupBy("query_id").agg(F.array_join(F.transform(items, lambda x: x["doc_id"].cast("string")), ",").alias("ids"), F.count(F.lit(1)).alias("n"))


@query("canonical_ids", _ADM + " select query_id, array_to_string(list_sort(list(doc_id))[:3], ',') ids from adm group by query_id")
def _(t):
    return _admission(t).groupBy("query_id").agg(F.array_join(F.transform(F.slice(F.sort_array(F.collect_list("doc_id")), 1, 3), lambda x: x.cast("string")), ",").alias("ids"))


@query("false_hit_retry", "with u as (select conv_id, turn, row_number() over (partition by conv_id order by turn) seq, regexp_replace(text, '[^A-Za-z ]', '', 'g') q from conversations where role = 'user'), l as (select *, lag(q) over (partition by conv_id order by seq) b, coalesce(lag(seq % 2 = 1) over (partition by conv_id order by seq), false) reused from u), s as (select conv_id, turn, case when greatest(length(b), length(q)) > 2048 then 0 else round(1 - levenshtein(b, q) / nullif(greatest(length(b), length(q)), 0)::double, 6) end likeness, reused from l) select conv_id, turn, likeness from s where reused and likeness >= 0.2")
def _(t):
    """Prompts that resemble the one before by all their ASCII letters and blanks, as edit distances count bytes elsewhere."""
    q = F.regexp_replace("text", "[^A-Za-z ]", "")
    rows = t("conversations").filter("role = 'user'").withColumn("seq", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    rows = rows.select(F.col("conv_id").alias("session"), "turn", "seq", q.alias("query"), (F.col("seq") % 2 == 1).alias("l3_reuse")).filter("true")
    return D.false_hits(rows, 0.2).filter(F.greatest(F.length("before"), F.length("query")) > 0).select(F.col("session").alias("conv_id"), "turn", "likeness")


@query("false_hit_whole")
def _(t):
    """Prompts that resemble the one before over their whole texts; false_hit_retry and its SQL see their ASCII letters."""
    rows = t("conversations").filter("role = 'user'").withColumn("seq", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    rows = rows.select(F.col("conv_id").alias("session"), "turn", "seq", F.col("text").alias("query"), (F.col("seq") % 2 == 1).alias("l3_reuse"))
    return D.false_hits(rows, 0.2).select(F.col("session").alias("conv_id"), "turn", "likeness")


_ROUND = "c as (select user_id session, event_type tool, row_number() over (partition by user_id order by ts, event_id) seq from events), rd as (select *, sum((tool = 'signup')::int) over (partition by session order by seq)::bigint round from c)"


@query("tier_decision", f"with {_ROUND}, n as (select session, round, count(*) n, bool_or(tool in ('purchase', 'signup')) writer from rd group by all) select session, round, n, case when writer or n > 3 then 'pro' else 'flash' end tier from n")
def _(t):
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = S.calls(t("events")).withColumn("round", F.sum((F.col("tool") == "signup").cast("int")).over(w)).withColumn("read_only", ~F.col("tool").isin("purchase", "signup"))
    return D.tiers(rows).select("session", "round", "n", "tier")


_LEARNED = f"""with {_ROUND}, n as (select session, round, min(seq) moment, count(*) n, arg_min(tool, seq) filter (tool = 'purchase') writer from rd group by all),
o as (select session, seq moment, case tool when 'click' then 'flash' else 'pro' end tier, seq % 9 <> 4 success, (seq * 37) % 11 * (case tool when 'click' then 1 else 2 end) tokens from c where tool in ('click', 'error')),
l as (select n.session, round, list(success::int::double order by o.moment) filter (tier = 'flash') s, list(tokens::double order by o.moment) filter (tier = 'flash' and tokens > 0) c, list(tokens::double order by o.moment) filter (tier = 'pro' and tokens > 0) p from n left join o on o.session = n.session and o.moment < n.moment group by all),
m as (select session, round, coalesce(len(s), 0) k, list_reduce(s, lambda a, v: 0.2::double * v + 0.8::double * a) s, list_reduce(c, lambda a, v: 0.2::double * v + 0.8::double * a) c, list_reduce(p, lambda a, v: 0.2::double * v + 0.8::double * a) p from l),
r as (select session, round, n, k, round(s, 6) success, case when session % 13 = 0 and round % 3 = 0 then 'intent:mutation' when writer is not null then 'writer:' || writer when n <= 3 then 'default' when k < 10 then 'complex:' || n
  when s >= 0.7 and (c is null or p is null or c <= p) then 'learned:complex-cheap-ok' else 'learned:complex-needs-pro' end reason from n join m using (session, round))"""


@query("tiers_learned", _LEARNED + " select *, case when reason in ('default', 'learned:complex-cheap-ok') then 'flash' else 'pro' end tier from r")
def _(t):
    """Rounds' tiers with what the session's outcomes before them have taught."""
    from tracewell.operators import tiers as M

    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    calls = S.calls(t("events")).withColumn("round", F.sum((F.col("tool") == "signup").cast("int")).over(w))
    rounds = calls.groupBy("session", "round").agg(F.min("seq").cast("long").alias("at"), F.count(F.lit(1)).alias("n"), F.min_by("tool", F.when(F.col("tool") == "purchase", F.col("seq"))).alias("writer"))
    rounds = rounds.withColumn("writer", F.when(F.col("writer") == "purchase", F.col("writer"))).withColumn("intent", F.when((F.col("session") % 13 == 0) & (F.col("round") % 3 == 0), " Mutation "))
    click, seq = F.col("tool") == "click", F.col("seq").cast("long")
    outcomes = calls.filter("tool in ('click', 'error')").select("session", seq.alias("at"), F.when(click, "flash").otherwise("pro").alias("tier"), (seq % 9 != 4).alias("success"), ((seq * 37) % 11 * F.when(click, 1).otherwise(2)).alias("tokens"))
    out = M.decided(M.learned_until(rounds, outcomes))
    return out.select("session", "round", "n", F.coalesce("learned.n", F.lit(0)).cast("long").alias("k"), F.round("learned.success", 6).alias("success"), "reason", "tier")


@query("parallel_groups", f"with {_ROUND}, p as (select *, tool in ('view', 'click') p from c), s as (select *, (not p or not coalesce(lag(p) over (partition by session order by seq), false))::int st from p), g as (select *, sum(st) over (partition by session order by seq) run from s), k as (select *, (row_number() over (partition by session, run order by seq) - 1) // 8 chunk from g) select session, min(seq) first_seq, count(*) n from k group by session, run, chunk")
def _(t):
    out = D.parallel_groups(S.calls(t("events")), F.col("tool").isin("view", "click"))
    return out.select("session", F.col("first_seq").cast("long").alias("first_seq"), "n")


@query("suspended_tools", "select event_id, event_type from events where event_type not in (select event_type from events where value > 480)")
def _(t):
    bad = t("events").filter("value > 480").select("event_type").distinct()
    return t("events").select("event_id", "event_type").join(bad, "event_type", "left_anti")


@query("tool_behaviour", f"with {USAGE} select provider tool, count(*) runs, count(*) filter (k % 10 = 0) failures, sum(tokens_out)::bigint duration, round((count(*) - count(*) filter (k % 10 = 0)) / count(*), 6) success_rate from u group by 1")
def _(t):
    fail = F.count_if(F.col("k") % 10 == 0)
    return usage(t).groupBy(F.col("provider").alias("tool")).agg(F.count(F.lit(1)).alias("runs"), fail.alias("failures"), F.sum("tokens_out").alias("duration"), F.round((F.count(F.lit(1)) - fail) / F.count(F.lit(1)), 6).alias("success_rate"))
