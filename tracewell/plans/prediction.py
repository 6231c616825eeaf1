"""Queries of prediction and online feedback over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import feedback as B
from tracewell.operators import prediction as P
from tracewell.operators import sessions as S

from .registry import query
from .usage import USAGE, usage

_M = "c as (select user_id session, event_type tool, row_number() over (partition by user_id order by ts, event_id) seq from events), n as (select *, lead(tool) over (partition by session order by seq) nx from c), m as (select tool prev, nx next, count(*) n from n where nx is not null group by all), mp as (select *, round(n / sum(n) over (partition by prev), 6) prob from m)"


@query("transition_matrix", f"with {_M} select prev, next, n, prob from mp")
def _(t):
    return P.matrix(S.calls(t("events")))


@query("prefetch_plan", f"with {_M} select prev, next, prob, (row_number() over (partition by prev order by prob desc, next))::int rank from mp where next in ('view', 'click', 'signup') qualify rank <= 3")
def _(t):
    return P.plan(P.matrix(S.calls(t("events"))), ("view", "click", "signup"), 200, 1000, 3).select("prev", "next", "prob", "rank")


@query("prefetch_online", f"with {_M} select prev, next, prob, (row_number() over (partition by prev order by prob desc, next))::int rank from mp where prob >= 0.2 qualify rank <= 3")
def _(t):
    return P.plan(P.matrix(S.calls(t("events"))), None, 512, 2000, 3, 0.2).select("prev", "next", "prob", "rank")


@query("prefetch_read_only", f"with {_M}, d as (select event_type x, 'click' y from events where value > 495 group by 1) select prev, next, prob, (row_number() over (partition by prev order by prob desc, next))::int rank from mp where prob >= 0.15 and next in ('view', 'click', 'error') and (prev, next) not in (select (x, y) from d) qualify rank <= 3")
def _(t):
    """Only tools that read, without pairs that feedback has demoted."""
    bad = t("events").filter("value > 495").select(F.col("event_type").alias("prev"), F.lit("click").alias("next")).distinct()
    return P.plan(P.matrix(S.calls(t("events"))), ("view", "click", "error"), 512, 2000, 3, 0.15, bad).select("prev", "next", "prob", "rank")


@query("prefetch_coverage", f"with {_M}, p as (select prev, next from mp where prob >= 0.2 qualify row_number() over (partition by prev order by prob desc, next) <= 3) select tool, count(*) n, count(p.next) covered, round(count(p.next) / count(*), 6) share from n left join p on tool = prev and nx = p.next where nx is not null group by tool")
def _(t):
    calls = S.calls(t("events"))
    return P.coverage(calls, P.plan(P.matrix(calls), None, 512, 2000, 3, 0.2))


@query("ewma_hit", f"with {USAGE}, o as (select session, list((k % 10 = 3)::int::double order by ts, event_id) x from u group by session) select session, round(list_reduce(list_prepend(0.0::double, x), lambda a, v: 0.9::double * a + 0.1::double * v), 9) ewma, len(x)::bigint n from o")
def _(t):
    return B.ewma(usage(t).withColumn("v", F.col("l3_reuse").cast("double")), "session", ["ts", "event_id"], "v")


@query("tier_ewma", "with o as (select user_id session, list(value order by ts, event_id) x from events group by 1) select session, round(list_reduce(x, lambda a, v: 0.8::double * a + 0.2::double * v), 9) ewma from o")
def _(t):
    return B.ewma_first(t("events").withColumnRenamed("user_id", "session"), "session", ["ts", "event_id"], "value")


@query("beta_posterior", f"""with {USAGE}, o as (select provider || ':' || session k2, list((k % 3 = 0)::int::double order by ts, event_id) x from u group by 1), s as (select k2, list_reduce(list_prepend(0.0::double, x), lambda a, v: 0.8::double * a + v) h, list_reduce(list_prepend(0.0::double, x), lambda a, v: 0.8::double * a + (1 - v)) w from (select k2, x from o)),
f as (select k2, h, list_reduce(list_prepend(0.0::double, list_transform(x, lambda v: 1 - v)), lambda a, v: 0.8::double * a + v) w from o join s using (k2)), p as (select *, h + w n, h / (h + w) p from f)
select k2 "key", round(h, 6) hits, round(w, 6) wastes, round((h + 1) / (n + 2), 6) mean, case when low < 5e-7 then 0 else round(low, 6) end wilson_low, (h + 1) / (n + 2) < 0.25 demoted from (select *, (p + 2.706025::double / (2 * n) - 1.645::double * sqrt(p * (1 - p) / n + 2.706025::double / (4 * n * n))) / (1 + 2.706025::double / n) low from p)""")
def _(t):
    rows = usage(t).select(F.concat_ws(":", "provider", "session").alias("key"), "ts", "event_id", (F.col("k") % 3 == 0).alias("hit"))
    return B.beta(rows, "key", ["ts", "event_id"], "hit")


@query("adaptive_tau")
def _(t):
    rows = usage(t).withColumn("bad", F.col("k") % 15 == 0)
    return B.adaptive_tau(rows, "session", ["ts", "event_id"], "bad")


@query("adapt_summary")
def _(t):
    """Least, upper median and greatest learned threshold, and how many entries and adjustments there are."""
    rows = B.adaptive_tau(usage(t).withColumn("bad", F.col("k") % 15 == 0), "session", ["ts", "event_id"], "bad")
    return B.tau_summary(rows)


@query("evolve_params")
def _(t):
    names = F.element_at(F.array(*map(F.lit, ("cache_hit", "inject_pollution", "prefetch_hit", "prefetch_waste", "success"))), (F.col("k") % 5 + 1).cast("int"))
    rows = usage(t).select((F.col("session") % 8).alias("key"), "ts", "event_id", (F.col("event_id") - F.col("k") % 3).alias("epoch"), names.alias("name"), (F.col("k") / 100).alias("v"))
    return B.evolve(rows, "key", ["ts", "event_id"])


@query("evolution_signals", f"with {USAGE}, s as (select day, l3_reuse, case when l3_reuse then 1.0::double else coalesce(cache_hit / nullif(tokens_in, 0), 0) end v, (k % 4) / (k % 4 + 1.0::double) pollution from u) select day, count(*) n, round(avg(v), 6) hit, round(avg(pollution), 6) pollution from s group by day")
def _(t):
    """What a usage log says to the engine: reuse counts as a full hit, rejects over decisions as pollution."""
    v = F.when(F.col("l3_reuse"), 1.0).otherwise(F.coalesce(F.try_divide(F.col("cache_hit").cast("double"), F.col("tokens_in").cast("double")), F.lit(0.0)))
    rejects = F.col("k") % 4
    return usage(t).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(v), 6).alias("hit"), F.round(F.avg(rejects / (rejects + 1.0)), 6).alias("pollution"))
