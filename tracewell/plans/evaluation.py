"""Queries of offline evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.functions import scores
from tracewell.operators import evaluation as E
from tracewell.operators import retrieval as R

from .registry import query
from .retrieval import BENCH, ZONE, _bench, _docs, _sql
from .usage import USAGE, usage


@query("chronological_split", "with u as (select conv_id, turn, row_number() over (order by conv_id, turn) r, count(*) over () n from conversations where role = 'user') select conv_id, turn, r > greatest(least(n - floor(n * 0.3)::bigint, n - 1), 1) is_holdout from u")
def _(t):
    return E.chronological(t("conversations").filter("role = 'user'").select("conv_id", "turn"), ["conv_id", "turn"], 0.3)


@query("session_split", "with u as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) r, count(*) over (partition by user_id) n from events) select event_id, r > greatest(least(n - floor(n * 0.3)::bigint, n - 1), 1) is_holdout from u")
def _(t):
    return E.chronological(t("events"), ["ts", "event_id"], 0.3, ["user_id"]).select("event_id", "is_holdout")


@query("hash_split", "select doc_id, (('0x' || left(sha256(text), 16))::uhugeint % 10000)::int < 2500 is_test from documents")
def _(t):
    return t("documents").select("doc_id", E.hash_split(F.col("text"), 0.25).alias("is_test"))


_TOP2 = _sql(BENCH) + """, m as (select query_id, max(score) filter (g = 1) top1, coalesce(max(score) filter (g = 2), 0) top2, max(doc_id) filter (g = 1) doc_id from (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) g from r) group by query_id), c as (select *, top2 / top1 ratio, doc_id % 3 <> 0 relevant from m)"""


def _top2(t):
    hits = R.bm25_top(_docs(t), _bench(t), 2, by=("query_id",))
    pick = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    out = hits.groupBy("query_id").agg(pick(1, "score").alias("top1"), F.coalesce(pick(2, "score"), F.lit(0.0)).alias("top2"), pick(1, "doc_id").alias("doc_id"))
    return out.withColumn("ratio", F.col("top2") / F.col("top1")).withColumn("relevant", F.col("doc_id") % 3 != 0)


@query("calibration_bins", _TOP2 + ", b as (select least(floor(ratio * 10), 9)::int bin, count(*) n, round(avg(top1), 5) mean_top1, round(avg(relevant::int), 6) prec from c group by 1) select r.bin::int bin, coalesce(n, 0) n, coalesce(mean_top1, 0) mean_top1, coalesce(prec, 0) \"precision\" from (select unnest(range(10))::int bin) r left join b using (bin)")
def _(t):
    return E.bins(_top2(t), "ratio")


@query("verify_verdict", _TOP2 + ", z as (select *, case when top1 < 0.45 then 'miss' when top1 >= 0.7 and top1 - top2 >= 0.55 * top1 then 'hit' else 'grey' end zone from c) select count(*) n, count(*) filter (zone = 'hit') hit, count(*) filter (zone = 'grey') grey, round(count(*) filter (relevant) / count(*), 6) relevance, case when count(*) filter (relevant) / count(*) >= 0.7 and count(*) filter (zone = 'grey') / count(*) <= 0.3 then 'pass' else 'fail' end verdict from z")
def _(t):
    z = _top2(t).withColumn("zone", scores.zone_top1(F.col("top1"), F.col("top2")))
    n, right, grey = F.count(F.lit(1)), F.count_if("relevant"), F.count_if(F.col("zone") == "grey")
    return z.agg(n.alias("n"), F.count_if(F.col("zone") == "hit").alias("hit"), grey.alias("grey"), F.round(right / n, 6).alias("relevance"), F.when((right / n >= 0.7) & (grey / n <= 0.3), "pass").otherwise("fail").alias("verdict"))


@query("eval_single_vs_three", _TOP2 + """, z as (select *, case when top1 < 0.45 then 'miss' when top1 >= 0.7 and top1 - top2 >= 0.55 * top1 then 'hit' else 'grey' end zone from c)
select 'single' policy, count(*) filter (top1 >= 20) reused, 0::bigint grey, round(count(*) filter (top1 >= 20) / count(*), 6) reuse_rate, round(coalesce(count(*) filter (top1 >= 20 and not relevant) / nullif(count(*) filter (top1 >= 20), 0), 0), 6) error_rate from z union all
select 'three', count(*) filter (zone = 'hit'), count(*) filter (zone = 'grey'), round(count(*) filter (zone = 'hit') / count(*), 6), round(coalesce(count(*) filter (zone = 'hit' and not relevant) / nullif(count(*) filter (zone = 'hit'), 0), 0), 6) from z""")
def _(t):
    rows = _top2(t).withColumn("zone", scores.zone_top1(F.col("top1"), F.col("top2"))).withColumn("right", F.col("relevant"))
    return E.policies(rows, 20.0)


@query("confusion", "with p as (select case when doc_id % 23 = 0 then null else n_chars > 400 end p, quality = 1 a from labels join documents using (doc_id)), c as (select count(*) filter (p and a) tp, count(*) filter (p and not a) fp, count(*) filter (not p and not a) tn, count(*) filter (not p and a) fn, count(*) filter (p is null) errors, count(*) n from p) select *, round(tp / (tp + fp), 6) \"precision\", round(tp / (tp + fn), 6) recall, round(2 * tp / (2 * tp + fp + fn), 6) f1 from c")
def _(t):
    rows = t("labels").join(t("documents"), "doc_id")
    return E.confusion(rows, F.when(F.col("doc_id") % 23 != 0, F.col("n_chars") > 400), F.col("quality") == 1)


_RANKED = _sql(BENCH) + ", k as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) rank from r), j as (select *, doc_id % 4 = query_id % 4 relevant from k where rank <= 20)"


def _ranked(t):
    return R.bm25_top(_docs(t), _bench(t), 20, by=("query_id",)).withColumn("relevant", F.col("doc_id") % 4 == F.col("query_id") % 4)


@query("ndcg_mrr", _RANKED + ", g as (select query_id, sum(case when relevant and rank <= 10 then 1 / log2(rank + 1) else 0 end) gain, count(*) filter (relevant) n, min(rank) filter (relevant and rank <= 10) f from j group by query_id having n > 0) select query_id, round(gain / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 6) ndcg, round(coalesce(1 / f, 0), 6) rr from g")
def _(t):
    return E.ranking(_ranked(t), 10)


@query("rank_auc", _RANKED + ", pa as (select a.query_id, avg(case when a.score > b.score then 1 when a.score = b.score then 0.5 else 0 end) auc from j a join j b on a.query_id = b.query_id and a.relevant and not b.relevant group by 1) select query_id, round(auc, 6) auc from pa")
def _(t):
    return E.auc(_ranked(t), "score", "relevant", ["query_id"]).filter("auc is not null")


@query("training_pairs", _RANKED + ", tr as (select query_id, doc_id, case doc_id % 5 when 0 then 'admitted' when 1 then 'zone_miss' when 2 then 'coverage_low' when 3 then 'below_min_score' else 'budget' end reason from j) select tr.query_id, tr.doc_id, lang, case when reason = 'admitted' then 1 else 0 end as label from tr join documents using (doc_id) where reason <> 'budget'")
def _(t):
    """Admitted hits are positives, three reasons hard negatives; others are left out, as are documents that are gone."""
    reason = F.element_at(F.array(*map(F.lit, ("admitted", "zone_miss", "coverage_low", "below_min_score", "budget"))), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = _ranked(t).withColumn("reason", reason).filter("reason <> 'budget'")
    return rows.join(t("documents").select("doc_id", "lang"), "doc_id").select("query_id", "doc_id", "lang", (F.col("reason") == "admitted").cast("int").alias("label"))


@query("distribution", "select event_type, round(avg(value), 6) mean, round(quantile_cont(value, 0.5), 6) median, round(quantile_cont(value, 0.75), 6) p75, round(quantile_cont(value, 0.9), 6) p90, list_sort(list(value))[count(*) // 2 + 1] upper_median from events group by event_type")
def _(t):
    return E.distribution(t("events"), "value", ["event_type"])


@query("paired_arms", "with a as (select user_id instance, round(sum(value) filter (event_type = 'view'), 4) a, round(sum(value) filter (event_type = 'click'), 4) b from events group by user_id) select instance, round(a - b, 6) delta from a where a is not null and b is not null")
def _(t):
    rows = t("events").groupBy(F.col("user_id").alias("instance"), F.col("event_type").alias("arm")).agg(F.round(F.sum("value"), 4).alias("v"))
    return E.paired(rows, "view", "click", "v")


@query("unpaired_arms", "select user_id instance, case when bool_or(event_type = 'view') then 'click' else 'view' end missing from events where event_type in ('view', 'click') and value > 60 group by user_id having bool_or(event_type = 'view') <> bool_or(event_type = 'click')")
def _(t):
    """Users with large views or large clicks, but not both."""
    return E.unpaired(t("events").filter("value > 60").select(F.col("user_id").alias("instance"), F.col("event_type").alias("arm")), "view", "click")


@query("run_report", "select user_id, map_extract_value(m, 'view') n_view, map_extract_value(m, 'click') n_click, total, round(coalesce(map_extract_value(m, 'error'), 0) / total, 6) error_share from (select user_id, map(list(event_type), list(n)) m, sum(n)::bigint total from (select user_id, event_type, count(*) n from events group by all) group by user_id)")
def _(t):
    """Counts by name merged into a map for each run."""
    n = t("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"), F.sum("n").alias("total"))
    return m.select("user_id", F.col("m")["view"].alias("n_view"), F.col("m")["click"].alias("n_click"), "total", F.round(F.coalesce(F.col("m")["error"], F.lit(0)) / F.col("total"), 6).alias("error_share"))


@query("stratified_quotas", 'with g as (select source "group", count(*) n from documents group by 1), s as (select *, n * 137 / sum(n) over () s from g), f as (select *, floor(s) f, 137 - sum(floor(s)) over () l from s) select "group", n, (f + (row_number() over (order by round(s - f, 9) desc, "group") <= l)::int)::bigint quota from f')
def _(t):
    return E.quotas(t("documents").groupBy(F.col("source").alias("group")).agg(F.count(F.lit(1)).alias("n")), 137)


@query("reuse_labels", f"with {USAGE}, a as (select session, count(*) h, max(seq) l from u where day < '2024-01-15' group by 1), b as (select session, count(*) h, max(seq) l from u group by 1) select session, (b.h > a.h or b.l > a.l)::int as label from a join b using (session)")
def _(t):
    """1 where a slice was used between two snapshots."""
    snap = lambda rows: rows.groupBy("session").agg(F.count(F.lit(1)).alias("h"), F.max("seq").alias("l"))
    a, b = snap(usage(t).filter("day < '2024-01-15'")), snap(usage(t))
    b = b.withColumnsRenamed({"h": "h1", "l": "l1"})
    return a.join(b, "session").select("session", ((F.col("h1") > F.col("h")) | (F.col("l1") > F.col("l"))).cast("int").alias("label"))


@query("library_gates", "select lang, count(*) n, count(distinct source) n_sources, count(distinct source) >= 2 and count(*) >= 50 ready from documents group by lang")
def _(t):
    return t("documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("n_sources")).withColumn("ready", (F.col("n_sources") >= 2) & (F.col("n") >= 50))


_PROBE = r"""with q as (select conv_id, turn, text from conversations where role = 'user'), w as (select conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{Nd}_]+'))) term from q), f as (select term, min(conv_id) first_conv from w group by term)
select w.conv_id, w.turn, count(*) n_terms, count(*) filter (first_conv < w.conv_id) n_known, round(count(*) filter (first_conv < w.conv_id) / count(*), 6) share from w join f using (term) group by 1, 2"""


@query("probe_earlier_sessions", _PROBE)
def _(t):
    """How much of a prompt earlier sessions hold: each term's first session decides, so each is looked at once."""
    from tracewell.functions import text

    w = t("conversations").filter("role = 'user'").select("conv_id", "turn", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term"))
    first = w.groupBy("term").agg(F.min("conv_id").alias("first_conv"))
    known = F.count_if(F.col("first_conv") < F.col("conv_id"))
    return w.join(first, "term").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_terms"), known.alias("n_known"), F.round(known / F.count(F.lit(1)), 6).alias("share"))


@query("top_sources", _RANKED + ", so as (select query_id, source, count(*) n, min(rank) pos from j join documents using (doc_id) group by all) select query_id, source, n, row_number() over (partition by query_id order by n desc, pos) place from so qualify place <= 3")
def _(t):
    """The sources with most hits; ties go to the one seen first."""
    s = R.beside(_ranked(t), t("documents").select("doc_id", "source")).groupBy("query_id", "source").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("pos"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "pos"))).filter("place <= 3").drop("pos")


@query("zone_by_type", _sql(BENCH) + f", z as (select doc_id % 3 kind, {ZONE.format(s='score', t='max(score) over (partition by query_id, scope)')} zone from r) select kind, count(*) filter (zone = 'hit') hit, count(*) filter (zone = 'grey') grey, count(*) filter (zone = 'miss') miss from z group by kind")
def _(t):
    z = R.with_top(R.bm25(_docs(t), _bench(t))).select((F.col("doc_id") % 3).alias("kind"), scores.zone(F.col("score"), F.col("top1")).alias("zone"))
    return z.groupBy("kind").agg(*[F.count_if(F.col("zone") == x).alias(x) for x in ("hit", "grey", "miss")])
