"""Queries of listings, lineage and time windows over orders, suppliers and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.operators import catalog as C
from tracewell.operators import sessions as S

from .registry import query
from .usage import USAGE, usage


@query("keyset_page", "select o_orderkey, o_totalprice from orders where o_totalprice < 400000.0 or (o_totalprice = 400000.0 and o_orderkey > 10) order by o_totalprice desc, o_orderkey limit 51")
def _(t):
    rows = t("orders").select("o_orderkey", "o_totalprice")
    return C.keyset_page(rows, [("o_totalprice", True), ("o_orderkey", False)], (400000.0, 10), 50)


@query("event_page", "select event_id, event_type from events where event_id > 500 order by event_id limit 100")
def _(t):
    return C.keyset_page(t("events").select("event_id", "event_type"), [("event_id", False)], (500,), 99)


@query("catalog_search", "select p_partkey, p_name from part where lower(p_name) like '%a_e%' or lower(p_brand) like '%a_e%'")
def _(t):
    return C.search(t("part"), ["p_name", "p_brand"], "A_e").select("p_partkey", "p_name")


@query("age_groups", "select case when ts >= timestamp '2024-01-20' then 'today' when ts >= timestamp '2024-01-19' then 'yesterday' else 'older' end age, count(*) n from events where ts < timestamp '2024-01-20 15:00:00' group by 1")
def _(t):
    rows = t("events").filter("ts < timestamp_ntz'2024-01-20 15:00:00'")
    return rows.groupBy(C.age_group(F.col("ts"), F.expr("timestamp_ntz'2024-01-20 15:00:00'")).alias("age")).agg(F.count(F.lit(1)).alias("n"))


_NOW = "timestamp '2024-01-20 15:00:00'"


@query("time_filters", f"select event_id, ts >= date_trunc('day', {_NOW}) and ts <= {_NOW} \"today\", ts >= date_trunc('day', {_NOW}) - interval 1 day and ts < date_trunc('day', {_NOW}) \"yesterday\", ts >= {_NOW} - interval 7 days and ts <= {_NOW} \"week\", ts >= {_NOW} - interval 30 days and ts <= {_NOW} \"month\", ts >= {_NOW} - interval 150 minutes and ts <= {_NOW} \"span\" from events")
def _(t):
    now = F.expr("timestamp_ntz'2024-01-20 15:00:00'")
    names = {"today": "today", "yesterday": "yesterday", "week": "week", "month": "month", "2h30m": "span"}
    return t("events").select("event_id", *[C.since(F.col("ts"), now, w).alias(n) for w, n in names.items()])


@query("task_filters", "select event_id, user_id from events where event_type in ('error', 'click') and props like '%7%'")
def _(t):
    return t("events").filter(F.col("event_type").isin("error", "click") & F.col("props").contains("7")).select("event_id", "user_id")


@query("topic_rollup", f"with {USAGE} select (session % 20)::bigint topic, provider, count(*) sessions, count(*) filter (k > 50) open_sessions, sum(tokens_out)::bigint turns, min(ts) first_at, max(ts) last_at, coalesce(arg_max(case when k % 3 > 0 then 't' || k end, (ts, event_id)) filter (k % 3 > 0), '') title from u group by all")
def _(t):
    k = F.col("k")
    title = F.when(k % 3 > 0, F.concat(F.lit("t"), k.cast("string"))).otherwise("")
    rows = usage(t).select((F.col("session") % 20).alias("topic"), "provider", F.col("event_id").alias("id"), F.col("ts").alias("at"), title.alias("title"), (k > 50).alias("open"), F.col("tokens_out").alias("turns"))
    return C.topics(rows, ["topic", "provider"])


@query("catalog_joins", "select n_name, count(*) n, round(sum(s_acctbal), 2) balance from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name <> 'x' group by n_name")
def _(t):
    met = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).filter("r_name <> 'x'")
    return met.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("semi_anti", "select (select count(*) from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 49)) n_semi, (select count(*) from orders where o_orderkey not in (select l_orderkey from lineitem)) n_anti")
def _(t):
    big = t("lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    semi, anti = t("orders").join(big, "o_orderkey", "left_semi"), t("orders").join(t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(semi, "n_semi").crossJoin(one(anti, "n_anti"))  # one row each


_TREE = "t as (select event_id id, case when event_id % 7 = 0 then null else event_id - 1 - event_id % 3 end parent from events)"


@query("recovery_lineage", f"with recursive {_TREE}, r as (select id, id root, 0::bigint depth from t where parent is null or parent not in (select id from t) union all select t.id, r.root, r.depth + 1 from t join r on t.parent = r.id) select id, root, depth from r")
def _(t):
    i = F.col("event_id")
    return C.roots(t("events").select(i.alias("id"), F.when(i % 7 != 0, i - 1 - i % 3).alias("parent")))


@query("recovery_rank", "select user_id, event_id from (select *, row_number() over (partition by user_id order by case event_type when 'purchase' then 0 when 'signup' then 1 else 2 end, value desc, ts desc, event_id) r from events) where r = 1")
def _(t):
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    return C.preferred(t("events"), "user_id", [rank, F.desc("value"), F.desc("ts"), F.asc("event_id")]).select("user_id", "event_id")


@query("recovery_status", "select count(distinct user_id) groups, count(*) filter (event_type = 'error') failed, count(*) filter (event_type <> 'error') fine from events")
def _(t):
    return t("events").agg(F.countDistinct("user_id").alias("groups"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type") != "error").alias("fine"))


@query("recovery_groups", "select user_id, string_agg(distinct event_type, ',' order by event_type) kinds, case when bool_or(event_type = 'error') then 'failed' when bool_or(event_type = 'purchase') then 'done' else 'open' end state from events group by user_id")
def _(t):
    has = lambda x: F.bool_or(F.col("event_type") == x)
    return t("events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"), F.when(has("error"), "failed").when(has("purchase"), "done").otherwise("open").alias("state"))


@query("lineage_promotion", """with l as (select conv_id // 3 g, conv_id id, list(md5(text) order by turn) m from conversations group by 1, 2), b as (select g, arg_max(id, (len(m), -id)) best, arg_max(m, (len(m), -id)) a from l group by g), p as (select l.g, id, best, a[: len(m)] = m pre from l join b using (g))
select g::bigint "group", id, case when not bool_and(pre) over (partition by g) then 'diverged' when id = best then 'adopted' else 'covered_copy' end state from p""")
def _(t):
    m = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.md5("text").alias("x")))), lambda x: x["x"])
    leaves = t("conversations").groupBy(F.floor(F.col("conv_id") / 3).cast("long").alias("group"), F.col("conv_id").alias("id")).agg(m.alias("messages"))
    return C.covered(leaves)


@query("as_of_reuse", f"with {USAGE}, c as (select session, seq, k, l3_reuse, max(case when l3_reuse then seq end) over (partition by session order by seq rows between unbounded preceding and 1 preceding) last_reuse from u) select session, seq, coalesce(last_reuse, 0) last_reuse from c")
def _(t):
    """The latest reuse before each request of a session."""
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = usage(t).withColumn("last_reuse", F.max(F.when(F.col("l3_reuse"), F.col("seq"))).over(w))
    return rows.select("session", F.col("seq").cast("long").alias("seq"), F.coalesce("last_reuse", F.lit(0)).cast("long").alias("last_reuse"))


@query("mutation_risk", f"with {USAGE} select session, count(distinct k) paths, case when bool_or(k > 97) or count(distinct k) >= 45 then 'high' when bool_and(k < 95) then 'low' else 'medium' end risk from u group by session")
def _(t):
    k, paths = F.col("k"), F.countDistinct("k")
    return usage(t).groupBy("session").agg(paths.alias("paths"), F.when(F.bool_or(k > 97) | (paths >= 45), "high").when(F.bool_and(k < 95), "low").otherwise("medium").alias("risk"))


@query("progress_score", f"""with {USAGE}, f as (select session, seq, provider, k, row_number() over (partition by session, k order by seq) = 1 fresh, provider = 'error' and lag(provider) over (partition by session order by seq) = 'error' again, provider = 'view' look from u),
g as (select *, seq - row_number() over (partition by session, look order by seq) isl from f), h as (select *, case when look then row_number() over (partition by session, look, isl order by seq) else 0 end run from g)
select session, seq, case when run > 2 then 0 else fresh::int + (provider = 'purchase')::int * 2 - coalesce(again, false)::int * 2 end::int score from h""")
def _(t):
    """New evidence scores, a repeated failure costs 2, a long run of looking only scores nothing."""
    w = Window.partitionBy("session").orderBy("seq")
    look = F.col("provider") == "view"
    rows = usage(t).withColumn("fresh", F.row_number().over(Window.partitionBy("session", "k").orderBy("seq")) == 1)
    rows = rows.withColumn("again", F.coalesce((F.col("provider") == "error") & (F.lag("provider").over(w) == "error"), F.lit(False))).withColumn("look", look)
    rows = rows.withColumn("isl", F.col("seq") - F.row_number().over(Window.partitionBy("session", "look").orderBy("seq")))
    run = F.when(F.col("look"), F.row_number().over(Window.partitionBy("session", "look", "isl").orderBy("seq"))).otherwise(0)
    score = F.col("fresh").cast("int") + (F.col("provider") == "purchase").cast("int") * 2 - F.col("again").cast("int") * 2
    return rows.withColumn("run", run).select("session", F.col("seq").cast("long").alias("seq"), F.when(F.col("run") > 2, 0).otherwise(score).alias("score"))


@query("outcome_decomposition", f"with {USAGE}, c as (select *, max(case when provider = 'signup' then seq end) over (partition by session order by seq rows between unbounded preceding and 1 preceding) chk from u) select session, count(*) filter (provider = 'purchase') churn, count(*) filter (provider in ('view', 'click')) exploration, count(*) filter (provider = 'signup') verification, count(*) filter (provider = 'purchase' and chk is null) blind, coalesce(max(seq - chk) filter (provider = 'purchase'), 0)::bigint debt_age from c group by session")
def _(t):
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    p = F.col("provider")
    rows = usage(t).withColumn("chk", F.max(F.when(p == "signup", F.col("seq"))).over(w))
    return rows.groupBy("session").agg(
        F.count_if(p == "purchase").alias("churn"), F.count_if(p.isin("view", "click")).alias("exploration"), F.count_if(p == "signup").alias("verification"),
        F.count_if((p == "purchase") & F.col("chk").isNull()).alias("blind"), F.coalesce(F.max(F.when(p == "purchase", F.col("seq") - F.col("chk"))), F.lit(0)).cast("long").alias("debt_age"),
    )


@query("seed_validation", "with g as (select source repo, count(*) n, count(distinct lang) kinds, count(*) filter (length(text) < 20) short from documents group by 1) select repo, n, kinds, array_to_string(list_filter([case when n < 50 then 'too_few' end, case when kinds < 3 then 'too_narrow' end, case when short > 2 then 'short_texts' end], lambda x: x is not null), ',') errors from g")
def _(t):
    g = t("documents").groupBy(F.col("source").alias("repo")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lang").alias("kinds"), F.count_if(F.length("text") < 20).alias("short"))
    errors = F.array_compact(F.array(F.when(F.col("n") < 50, "too_few"), F.when(F.col("kinds") < 3, "too_narrow"), F.when(F.col("short") > 2, "short_texts")))
    return g.select("repo", "n", "kinds", F.array_join(errors, ",").alias("errors"))


@query("retrieval_events", f"with {USAGE}, d as (select session, seq, unnest(range(k % 4)) i, k from u) select session, i::bigint pos, count(*) n, count(*) filter ((k + i) % 3 = 0) admitted from d group by all")
def _(t):
    """A log with an array of decisions each, taken apart."""
    d = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")), lambda i: i < F.col("k") % 4)
    rows = usage(t).select("session", "k", F.explode(d).alias("pos"))
    return rows.groupBy("session", "pos").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("k") + F.col("pos")) % 3 == 0).alias("admitted"))


@query("set_operations", "select (select count(*) from (select o_custkey from orders where o_orderstatus = 'F' union select o_custkey from orders where o_orderstatus = 'O')) n_union, (select count(*) from (select o_custkey from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O')) n_intersect, (select count(*) from (select o_custkey from orders where o_orderstatus = 'F' except select o_custkey from orders where o_orderstatus = 'O')) n_except")
def _(t):
    a, b = (t("orders").filter(F.col("o_orderstatus") == s).select("o_custkey") for s in "FO")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(a.union(b).distinct(), "n_union").crossJoin(one(a.intersect(b), "n_intersect")).crossJoin(one(a.subtract(b), "n_except"))  # one row each


@query("session_windows", "with g as (select user_id, ts, event_id, (coalesce(epoch(ts - lag(ts) over (partition by user_id order by ts, event_id)), 1e9) >= 1800)::int n from events), s as (select *, sum(n) over (partition by user_id order by ts, event_id) s from g) select user_id, min(ts) started, count(*) n from s group by user_id, s")
def _(t):
    """An extension: sessions by gaps of 30 minutes, as the streaming package also has them."""
    rows = t("events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("w.start").alias("started"), "n")


@query("tumbling_windows", "select time_bucket(interval 1 hour, ts) started, event_type, count(*) n, round(sum(value), 4) total from events group by all")
def _(t):
    rows = t("events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").alias("started"), "event_type", "n", "total")


@query("tool_pairs_time", "with c as (select user_id session, event_type tool, ts, row_number() over (partition by user_id order by ts, event_id) seq from events) select tool, count(*) n, round(avg(epoch(ts) - epoch(b)), 3) mean_gap from (select *, lag(ts) over (partition by session order by seq) b from c) where b is not null group by tool")
def _(t):
    rows = S.calls(t("events")).withColumn("b", F.lag("ts").over(Window.partitionBy("session").orderBy("seq"))).filter("b is not null")
    sec = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    return rows.groupBy("tool").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(sec("ts") - sec("b")), 3).alias("mean_gap"))
