"""Reuse decisions: the L3 chain, admission traces with a budget, false hits, tiers, parallel groups."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import scores as S
from tracewell.functions import text as T
from tracewell.operators.cards import sanitized


def l3_counters(decided: DataFrame) -> DataFrame:
    """One row of counts over l3_decisions: what was looked at, how far it came, and what was reused."""
    n = lambda test: F.count_if(test)
    reason, asked = F.col("reason"), F.col("asks_judge") & (F.col("reason") != "rules_reject")
    return decided.agg(
        F.count(F.lit(1)).alias("candidates"), F.countDistinct("query_id").alias("lookups"), *[n(F.col("zone") == z).alias(z) for z in ("hit", "grey", "miss")], n(asked).alias("judge_called"),
        n(asked & (F.col("judged") == "yes")).alias("judge_approved"), n(reason == "judge_reject").alias("judge_reject"), n(reason == "judge_error").alias("judge_error"), n(reason == "no_judge").alias("no_judge"),
        n(reason == "rules_reject").alias("rules_reject"), n(reason == "isolated").alias("isolated"), n(reason == "fingerprint").alias("fingerprint"), n("winner").alias("reused"),
    )


def l3_decisions(hits: DataFrame, least_origin: int = 2, ttl: int = 0, now: int = 0, tau_low: Column | None = None) -> DataFrame:
    """Adds zone and reason to result candidates, and winner to the first of a query that passes.

    hits has query_id, doc_id, score, kind, created, origin, lexical, judged (yes, no, error or null), context_ok
    and stale. A zone can only fall by freshness; hits of low origin or without lexical support need the judge,
    as grey ones do; context, then fingerprint come last. Windows are over a query's fetched hits only. tau_low, an
    entry's learned lower threshold where it has one, raises the bar under which a hit is a miss.
    """
    q = Window.partitionBy("query_id")
    rows = hits.withColumn("global_top1", F.max("score").over(q)).withColumn("result_top1", F.max(F.when(F.col("kind") == "result", F.col("score"))).over(q)).filter("kind = 'result'")
    zone, fresh = S.zone_l3(F.col("score"), F.col("result_top1"), F.col("global_top1")), S.freshness(F.col("created"), F.lit(now), F.lit(ttl))
    level = lambda z: F.when(z == "hit", 2).when(z == "grey", 1).otherwise(0)
    zone = zone if tau_low is None else F.when(F.col("score") / F.col("result_top1") < F.least(F.greatest(F.coalesce(tau_low, F.lit(0.0)), F.lit(0.0)), F.lit(MOST_TAU)), "miss").otherwise(zone)
    rows = rows.withColumn("zone", F.when(level(fresh) < level(zone), fresh).otherwise(zone))
    judge = (F.col("zone") == "grey") | (S.origin_level(F.col("origin")) < least_origin) | (F.col("lexical") < 0.05)
    reason = (
        F.when(F.col("zone") == "miss", "rules_reject")
        .when(judge & F.col("judged").isNull(), "no_judge")
        .when(judge & (F.col("judged") == "error"), "judge_error")
        .when(judge & (F.col("judged") != "yes"), "judge_reject")
        .when(~F.col("context_ok"), "isolated")
        .when(F.col("stale"), "fingerprint")
        .otherwise("reusable")
    )
    rows = rows.withColumn("asks_judge", judge).withColumn("reason", reason)
    first = F.row_number().over(q.orderBy((F.col("reason") == "reusable").desc(), F.desc("score"), "doc_id"))
    return rows.withColumn("winner", (F.col("reason") == "reusable") & (first == 1))


#: A learned threshold is clamped to this.
MOST_TAU = 0.80


class Gates(NamedTuple):
    """What admission asks for; 0, None and False ask for nothing."""

    kinds: tuple[str, ...] | None = None
    least_origin: int = 0
    task: str = ""
    library: int = 0
    sources: int = 0
    runner_up: bool = False
    margin: float = 0.0
    score: float = 0.0
    coverage: float = 0.0
    grey: bool = False


def library_gates(library: DataFrame, kind: str = "kind", session: str = "session") -> DataFrame:
    """(kind, n, sources): how many slices of a kind a library has, and of how many sessions."""
    return library.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(session).alias("sources"))


def admission(hits: DataFrame, library: DataFrame, gates: Gates, k: int = 5) -> DataFrame:
    """Adds rank, eligible, top1, top_margin, zone and reason: the first gate that a hit fails, or admitted.

    hits has query_id, doc_id, score, coverage, kind (null: the slice is gone), status, origin, stale and content;
    library is what library_gates gives, a row a kind. Only eligible hits count for the best score and the margin; the
    window is the first k eligible ones and ineligible ones ranked in k. Packing into a budget comes after (packed).
    """
    q = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    gone = F.col("kind").isNull()
    wrong_kind = F.lit(False) if gates.kinds is None else ~F.col("kind").isin(*gates.kinds)
    probation = F.lit(gates.kinds is not None) & (F.col("kind") == "result") & (F.coalesce("status", F.lit("")) != "verified")
    low = S.origin_level(F.col("origin")) < gates.least_origin
    tag = T.task_tag(F.col("content"))
    other_task = F.lit(bool(gates.task)) & (F.col("kind") == "memory") & (tag != "") & (tag != gates.task)
    fits = ~(wrong_kind | probation | low | other_task | F.col("stale"))
    rows = hits.withColumn("eligible", ~gone & F.coalesce(fits, F.lit(False)))
    rows = rows.withColumn("rank", F.row_number().over(q)).withColumn("_e", F.sum(F.col("eligible").cast("int")).over(q.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.filter(F.when(F.col("eligible"), F.col("_e") <= k).otherwise(F.col("rank") <= k))
    whole = Window.partitionBy("query_id")
    nth = lambda n: F.max(F.when(F.col("eligible") & (F.col("_e") == n), F.col("score"))).over(whole)
    rows = rows.withColumn("top1", F.coalesce(nth(1), F.lit(0.0))).withColumn("_top2", nth(2)).withColumn("top_margin", F.coalesce(F.col("top1") - F.col("_top2"), F.lit(0.0)))
    total = library.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_library"))  # one row
    rows = rows.join(library.select(F.col("kind"), F.col("sources").alias("_sources")), "kind", "left").crossJoin(F.broadcast(total))
    zone = S.zone(F.col("score"), F.col("top1"))
    reason = (
        F.when(gone, "nil_slice").when(wrong_kind, "type_not_allowed").when(probation, "result_probation").when(low, "origin_below_floor").when(F.col("stale"), "freshness")
        .when(F.col("_library") < gates.library, "library_too_small").when(F.coalesce("_sources", F.lit(0)) < gates.sources, "type_sources_too_few")
        .when(F.lit(gates.runner_up) & F.col("_top2").isNull(), "runner_up_missing").when(F.col("top_margin") < gates.margin, "top_margin_low")
        .when(F.lit(gates.score > 0) & (F.col("score") < gates.score), "below_min_score").when(F.col("coverage") < gates.coverage, "coverage_low").when(other_task, "task_type_mismatch")
        .when(zone == "miss", "zone_miss").when((zone == "grey") & ~F.lit(gates.grey), "zone_grey").when(sanitized(F.col("content")) == "", "sanitized_empty").otherwise("admitted")
    )
    return rows.withColumn("zone", F.when(gone, "miss").otherwise(zone)).withColumn("reason", reason).drop("_e", "_top2", "_library", "_sources")


def packed(items: DataFrame, budget: int, group: str = "query_id") -> DataFrame:
    """(group, ids, left_out, used): items in order of rank, each taken if it still fits; later smaller ones may.

    items has rank, id, size; a group is the few candidates of one query, folded in one expression.
    """
    ordered = F.sort_array(F.collect_list(F.struct("rank", F.col("id").alias("id"), F.col("size").cast("long").alias("size"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids"), F.array().cast("array<bigint>").alias("left_out"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["size"] <= budget
        return F.struct(F.when(fits, acc["used"] + x["size"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["ids"], F.array(x["id"].cast("long")))).otherwise(acc["ids"]).alias("ids"), F.when(fits, acc["left_out"]).otherwise(F.concat(acc["left_out"], F.array(x["id"].cast("long")))).alias("left_out"))

    out = items.groupBy(group).agg(F.aggregate(ordered, start, step).alias("p"))
    return out.select(group, F.col("p.ids").alias("ids"), F.col("p.left_out").alias("left_out"), F.col("p.used").alias("used"))


def false_hits(requests: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Requests that look like a retry: much like the one before in their session, which a cache answered."""
    w = Window.partitionBy("session").orderBy("seq")
    rows = requests.withColumn("before", F.lag("query").over(w)).withColumn("reused", F.coalesce(F.lag("l3_reuse").over(w), F.lit(False)))
    return rows.withColumn("likeness", F.round(S.likeness(F.col("before"), F.col("query")), 6)).filter(F.col("reused") & (F.col("likeness") >= threshold))


def with_provenance(decided: DataFrame, slices: DataFrame, by: str = "doc_id") -> DataFrame:
    """Decisions with what is known of their slices (by, once each, and columns of provenance); of unknown ones all null, and known is false."""
    return decided.join(slices.withColumn("known", F.lit(True)), by, "left").withColumn("known", F.coalesce("known", F.lit(False)))


#: Kinds of prefetch tasks that only warm what they touch: nothing of them is stored.
WARMING = ("embedding", "file")


def prefetch_outcomes(tasks: DataFrame) -> DataFrame:
    """Adds outcome to prefetch tasks (kind, locality): blocked unless local, warmed where nothing is stored, else stored."""
    return tasks.withColumn("outcome", F.when(F.coalesce("locality", F.lit("")) != "local", "blocked").when(F.col("kind").isin(*WARMING), "warmed").otherwise("stored"))


def tiers(calls: DataFrame, most: int = 3) -> DataFrame:
    """(round keys, tier, n): pro where a round has a writer or more than `most` calls, else flash."""
    n, writer = F.count(F.lit(1)), F.bool_or(~F.col("read_only"))
    out = calls.groupBy("session", "round").agg(n.alias("n"), writer.alias("writer"))
    return out.withColumn("tier", F.when(F.col("writer") | (F.col("n") > most), "pro").otherwise("flash"))


def parallel_groups(calls: DataFrame, parallel: Column, most: int = 8) -> DataFrame:
    """(session, group_no, n, first_seq): runs of parallel calls in chunks of `most`; other calls stand alone."""
    w = Window.partitionBy("session").orderBy("seq")
    rows = calls.withColumn("p", parallel)
    rows = rows.withColumn("start", (~F.col("p") | ~F.coalesce(F.lag("p").over(w), F.lit(False))).cast("int")).withColumn("run", F.sum("start").over(w))
    place = F.row_number().over(Window.partitionBy("session", "run").orderBy("seq"))
    rows = rows.withColumn("chunk", F.floor((place - 1) / most))
    return rows.groupBy("session", "run", "chunk").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n"))
