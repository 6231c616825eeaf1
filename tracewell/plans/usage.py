"""Queries of usage: events stand in for calls; value gives tokens, props.k flags, event_type the provider."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.functions import scores
from tracewell.functions import text as T
from tracewell.operators import usage as U

from .registry import query

_K = "(json_extract(props, '$.k'))::bigint"
USAGE = f"""u as (select user_id session, row_number() over (partition by user_id order by ts, event_id) seq, event_id, ts, event_type provider, floor(value * 10)::bigint tokens_in, floor(value)::bigint tokens_out,
 least(floor(value * 10)::bigint, {_K} * 3) cache_hit, case when {_K} % 5 = 0 then {_K} else 0 end injected, {_K} % 10 = 3 l3_reuse, {_K} % 7 <> 0 exact, {_K} k, strftime(ts, '%Y-%m-%d') as day from events)"""


def usage(t):
    from pyspark.sql import Window

    k = F.get_json_object("props", "$.k").cast("long")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    t_in = F.floor(F.col("value") * 10).cast("long")
    return t("events").select(
        F.col("user_id").alias("session"), seq.alias("seq"), "event_id", "ts", F.col("event_type").alias("provider"), t_in.alias("tokens_in"), F.floor("value").cast("long").alias("tokens_out"),
        F.least(t_in, k * 3).alias("cache_hit"), F.when(k % 5 == 0, k).otherwise(0).alias("injected"), (k % 10 == 3).alias("l3_reuse"), (k % 7 != 0).alias("exact"), k.alias("k"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
    )


@query("usage_summary", f"""with {USAGE}, a as (select count(*) events, sum(tokens_in)::bigint tokens_in, sum(tokens_out)::bigint tokens_out, sum(cache_hit)::bigint cache_hit, sum(injected)::bigint injected, count(*) filter (l3_reuse) l3_reuses, count(*) filter (injected > 0) l2_hits,
 sum(tokens_in) filter (l3_reuse) l3_in, sum(tokens_out) filter (l3_reuse) l3_out from u), b as (select *, ((tokens_in - cache_hit - l3_in) * 0.27::double + cache_hit * 0.07::double + (tokens_out - l3_out) * 0.27::double) / 1e6 p, (tokens_in + tokens_out) * 0.27::double / 1e6 f from a)
select events, tokens_in, tokens_out, cache_hit, injected, l3_reuses, l2_hits, round(p, 6) paid, round(f, 6) no_cache, round(f - p, 6) savings, round((f - p) / f, 6) savings_rate, round((injected * 0.2::double + (l3_in + l3_out) * 0.27::double) / 1e6 / injected * 1e6, 6) inject_roi, round((l3_reuses + l2_hits) / events, 6) hit_rate from b""")
def _(t):
    return U.summary(usage(t))


_PROV = f"{USAGE}, p as (select provider, count(*) events, count(*) filter (exact) exact_events, count(*) filter (l3_reuse) l3_reuses, coalesce(sum(tokens_in) filter (exact), 0)::bigint tokens_in, coalesce(sum(cache_hit) filter (exact), 0)::bigint cache_hit from u group by provider), ph as (select *, round(coalesce(cache_hit / nullif(tokens_in, 0), 0), 6) hit_rate from p)"


@query("usage_by_provider", f"with {_PROV} select * from ph")
def _(t):
    return U.by_provider(usage(t))


@query("provider_prices", f"with {_PROV} select provider, events, case provider when 'view' then 0.5 when 'click' then 0.1 else 0.27 end::double miss, case provider when 'view' then 0.05 when 'click' then 0.02 else 0.07 end::double hit, (row_number() over (order by provider = '', provider))::int place from ph")
def _(t):
    stats = U.by_provider(usage(t)).select("provider", "events")
    own = F.when(F.col("provider") == "view", F.struct(F.lit(0.5).alias("miss"), F.lit(0.05).alias("hit"))).when(F.col("provider") == "click", F.struct(F.lit(0.1).alias("miss"), F.lit(0.02).alias("hit")))
    prices = t("events").select(F.col("event_type").alias("provider")).distinct().withColumn("p", own).filter("p is not null").select("provider", "p.*")
    return U.priced(stats, prices, 0.27, 0.07)


@query("provider_health", f"with {_PROV} select provider, exact_events, hit_rate from ph where exact_events >= 20 and hit_rate < 0.85")
def _(t):
    return U.unhealthy(U.by_provider(usage(t))).select("provider", "exact_events", "hit_rate")


@query("usage_rollup", f"with {USAGE} select day, provider source, case when k % 2 = 0 then 'a/m' || k % 3 else 'm' || k % 3 end model_ref, sum(tokens_in + tokens_out)::bigint total, sum(case when k % 4 = 0 and tokens_in + tokens_out > 0 then 1 else k % 4 end)::bigint requests, count(*) n from u group by all")
def _(t):
    ref = F.when(F.col("k") % 2 == 0, F.concat(F.lit("a/m"), (F.col("k") % 3).cast("string"))).otherwise(F.concat(F.lit("m"), (F.col("k") % 3).cast("string")))
    rows = usage(t).select("day", F.col("provider").alias("source"), ref.alias("model_ref"), (F.col("tokens_in") + F.col("tokens_out")).alias("total"), (F.col("k") % 4).alias("requests"))
    return U.rollup(rows)


@query("usage_daily_series", f"with {USAGE}, d as (select strftime(unnest(generate_series(date '2023-12-25', date '2024-02-05', interval 1 day)), '%Y-%m-%d') as day), s as (select day, sum(tokens_in + tokens_out) total, count(*) n from u group by day), x as (select day, coalesce(total, 0)::bigint total, coalesce(n, 0) n from d left join s using (day)) select day, total, n, round(coalesce(total / nullif(sum(total) over (), 0), 0), 6) share from x")
def _(t):
    return U.daily(usage(t).withColumn("total", F.col("tokens_in") + F.col("tokens_out")), "2023-12-25", "2024-02-05")


@query("usage_by_model", f"with {USAGE}, m as (select case when k % 2 = 0 then 'a/m' else 'm' end ref, tokens_in, day from u) select case when instr(ref, '/') > 1 then split_part(ref, '/', 1) else 'default' end provider, sum(tokens_in)::bigint tokens_in, count(distinct day) active_days, round(sum(tokens_in) / sum(sum(tokens_in)) over (), 6) share from m group by 1")
def _(t):
    from pyspark.sql import Window

    ref = F.when(F.col("k") % 2 == 0, "a/m").otherwise("m")
    out = usage(t).groupBy(T.provider(ref).alias("provider")).agg(F.sum("tokens_in").alias("tokens_in"), F.countDistinct("day").alias("active_days"))
    return out.withColumn("share", F.round(U.ratio(F.col("tokens_in"), F.sum("tokens_in").over(Window.partitionBy())), 6))


@query("ledger", f"""with {USAGE} select 'm' || k % 3 model, provider source, left(sha256('r' || k % 2), 16) fingerprint, day rate_day, case when k % 2 = 0 then 'USD' else 'CNY' end currency, sum(tokens_in)::bigint tokens, sum(round(tokens_in * 0.27::double / 1e6, 9)::decimal(28, 9))::double amount,
 bool_or(k % 11 = 0) any_estimated, bool_and(exact) all_exact, max(ts) latest from u group by all""")
def _(t):
    k = F.col("k")
    rows = usage(t).select(
        F.concat(F.lit("m"), (k % 3).cast("string")).alias("model"), F.col("provider").alias("source"), F.substring(F.sha2(F.concat(F.lit("r"), (k % 2).cast("string")), 256), 1, 16).alias("fingerprint"), F.col("day").alias("rate_day"),
        F.when(k % 2 == 0, "USD").otherwise("CNY").alias("currency"), F.col("tokens_in").alias("tokens"), scores.money(F.col("tokens_in") * 0.27 / 1e6).alias("amount"), (k % 11 == 0).alias("estimated"), "exact", F.col("ts").alias("at"),
    )
    return U.ledger(rows).withColumn("amount", F.col("amount").cast("double"))


@query("provider_cost", f"""with {USAGE}, c as (select event_id, tokens_in prompt, tokens_out, case when k % 3 = 0 then 0 else cache_hit end h, case when k % 4 = 0 then tokens_in - cache_hit else 0 end m, k % 6 w from u),
d as (select *, case when h + m = 0 and prompt > 0 then prompt when m = 0 and h > 0 and prompt > h then prompt - h else m end mm from c), e as (select *, least(greatest(w, 0), mm) ww from d)
select event_id, round((h * 0.07::double + (mm - ww + case when ww > 0 then ww::double * 2::double else 0 end) * 0.27::double + tokens_out * 1.1::double) / 1e6, 9)::decimal(28, 9)::double cost from e""")
def _(t):
    k = F.col("k")
    rows = usage(t).select("event_id", F.col("tokens_in").alias("p"), "tokens_out", F.when(k % 3 == 0, 0).otherwise(F.col("cache_hit")).alias("h"), F.when(k % 4 == 0, F.col("tokens_in") - F.col("cache_hit")).otherwise(0).alias("m"), (k % 6).alias("w"))
    m = F.when((F.col("h") + F.col("m") == 0) & (F.col("p") > 0), F.col("p")).when((F.col("m") == 0) & (F.col("h") > 0) & (F.col("p") > F.col("h")), F.col("p") - F.col("h")).otherwise(F.col("m"))
    billed = F.least(F.col("w"), m) * 2.0
    return rows.select("event_id", scores.provider_cost(F.col("p"), F.col("tokens_out"), F.col("h"), F.col("m"), F.col("w"), billed, 0.07, 0.27, 1.1).cast("double").alias("cost"))


@query("budget_action", f"with {USAGE}, s as (select session, seq, sum(tokens_out) over (partition by session order by seq) spent from u) select session, seq, case when spent / 2000 >= 1 then 'hard_stop' when spent / 2000 >= 0.9 then 'degrade_tier' when spent / 2000 >= 0.8 then 'degrade_inject' when spent / 2000 >= 0.7 then 'halt_prefetch' else '' end action from s")
def _(t):
    from pyspark.sql import Window

    spent = F.sum("tokens_out").over(Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return usage(t).select("session", F.col("seq").cast("long").alias("seq"), scores.budget_action(spent.cast("double"), F.lit(2000.0)).alias("action"))


@query("quota_running", f"with {USAGE}, s as (select session, seq, sum(case when l3_reuse then 0 else tokens_in + tokens_out end) over (partition by session order by seq)::bigint used from u) select session, seq, used, case when used <= 10000 then 'free' when used <= 20000 then 'paid' else 'blocked' end state from s")
def _(t):
    return U.running_quota(usage(t), 10_000).select("session", F.col("seq").cast("long").alias("seq"), "used", "state")


@query("savings_delta", f"with {USAGE}, s as (select session, seq, sum(case when k % 9 = 0 then -cache_hit else cache_hit end) over (partition by session order by seq)::bigint total from u) select session, seq, greatest(total - coalesce(lag(total) over (partition by session order by seq), 0), 0)::bigint delta from s")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = usage(t).withColumn("total", F.sum(F.when(F.col("k") % 9 == 0, -F.col("cache_hit")).otherwise(F.col("cache_hit"))).over(w))
    return U.savings_delta(rows, "total").select("session", F.col("seq").cast("long").alias("seq"), "delta")


@query("judge_decisions", f"with {USAGE}, j as (select provider, unnest(list_transform(range(k % 4), lambda i: i)) i, k from u) select provider, case when i = 0 then 'yes' when i = 1 then 'no' else 'error' end verdict, count(*) n, coalesce(sum(k * 10) filter (k % 2 = 0), 0)::bigint prompt_tokens from j group by all")
def _(t):
    """Nested decisions: tokens count only where the judge was called."""
    k = F.col("k")
    judged = F.transform(F.slice(F.array(F.lit("yes"), F.lit("no"), F.lit("error")), 1, (k % 4).cast("int")), lambda v: F.struct(v.alias("verdict"), (k % 2 == 0).alias("called"), (k * 10).alias("prompt_tokens")))
    j = usage(t).select("provider", F.inline(judged))
    return j.groupBy("provider", "verdict").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("called"), F.col("prompt_tokens"))), F.lit(0)).alias("prompt_tokens"))


@query("upstream_usage", f"with {USAGE} select event_id, coalesce(nullif(case when k % 3 = 0 then tokens_in else 0 end, 0), nullif(case when k % 3 = 1 then tokens_in + cache_hit else 0 end, 0), 0)::bigint prompt, coalesce(nullif(case when k % 2 = 0 then cache_hit else 0 end, 0), nullif(k, 0), 0)::bigint cache_hit from u where exact")
def _(t):
    """Shapes of several vendors folded into one; the first that is not 0 counts, estimates are left out."""
    k = F.col("k")
    first = lambda *c: F.coalesce(*[F.nullif(x, F.lit(0)) for x in c], F.lit(0)).cast("long")
    a, b = F.when(k % 3 == 0, F.col("tokens_in")).otherwise(0), F.when(k % 3 == 1, F.col("tokens_in") + F.col("cache_hit")).otherwise(0)
    return usage(t).filter("exact").select("event_id", first(a, b).alias("prompt"), first(F.when(k % 2 == 0, F.col("cache_hit")).otherwise(0), k).alias("cache_hit"))


@query("false_hit_rate", f"with {USAGE} select provider, round(100.0::double * count(*) filter (l3_reuse and k % 20 = 3) / nullif(count(*) filter (l3_reuse), 0), 6) rate from u group by provider")
def _(t):
    return usage(t).groupBy("provider").agg(F.round(F.try_divide(100.0 * F.count_if(F.col("l3_reuse") & (F.col("k") % 20 == 3)), F.count_if("l3_reuse").cast("double")), 6).alias("rate"))


@query("load_gate", f"with {USAGE} select event_id, case when k / 100 >= 0.8 then 'load_saturated' when tokens_out > 0 and injected > 0 and tokens_out < injected then 'window_too_short' else '' end reason from u")
def _(t):
    return usage(t).select("event_id", scores.load_gate(F.col("k"), F.lit(100), F.col("tokens_out"), F.col("injected")).alias("reason"))


@query("safe_cells", r"select event_id, case when regexp_matches(regexp_replace('=' || event_type || chr(9) || props, '[\x00-\x1F\x7F]', ' ', 'g'), '^[=+\-@]') then '''' || regexp_replace('=' || event_type || chr(9) || props, '[\x00-\x1F\x7F]', ' ', 'g') else props end cell from events")
def _(t):
    return t("events").select("event_id", T.safe_cell(F.concat(F.lit("="), "event_type", F.lit("\t"), "props")).alias("cell"))
