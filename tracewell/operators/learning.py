"""Fitting and publishing: weight parameters, gates, verdict caches, arms, rotating probes, reranking."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import scores as S
from tracewell.operators import hooks
from tracewell.operators.evaluation import auc

# Factors that a fit tries, and how far a parameter may move at once.
FACTORS = (0.25, 0.5, 0.8, 1.0, 1.25, 2.0, 4.0)
MOST_STEP = 0.2
DEFAULTS = {"half_life_days": 30.0, "freq_pseudo": 3.0, "reject_cost": 2.0, "feedback_gain": 0.5}


def weight_by(now: int, p: dict[str, Column]) -> Column:
    """The value weight under given parameters, of rows with created, last_used, hits, injected, rejected, feedback."""
    active = F.greatest("last_used", "created")
    age = F.greatest(now - active, F.lit(0)).cast("double")
    decay = F.when(active > 0, F.exp(-0.6931471805599453 * age / (p["half_life_days"] * 86400))).otherwise(0.5)
    use = (F.col("hits") + F.col("injected")).cast("double")
    liked = F.least(F.greatest(1 + p["feedback_gain"] * F.when(S.finite(F.col("feedback")), F.col("feedback")).otherwise(0.0), F.lit(0.25)), F.lit(2.0))
    w = decay * (use + 0.5) / (use + p["freq_pseudo"]) * (F.col("injected") + 1.0) / (F.col("injected") + 1.0 + p["reject_cost"] * F.col("rejected")) * liked
    return F.least(F.greatest(w, F.lit(S.LEAST_WEIGHT)), F.lit(1.0))


def fit_weights(rows: DataFrame, now: int, current: dict[str, float] = DEFAULTS) -> dict[str, float]:
    """One pass over parameters: each takes the factor of the best rank AUC, 1 on a tie, then at most MOST_STEP.

    All factors of a parameter are scored in one job; seven numbers come back. rows has relevant.
    """
    fitted = dict(current)
    for key in current:
        tries = F.explode(F.array(*map(F.lit, FACTORS))).alias("factor")
        params = {k: F.lit(v) if k != key else F.lit(current[k]) * F.col("factor") for k, v in fitted.items()}
        scored = rows.select("*", tries).withColumn("score", F.round(weight_by(now, params), 12))
        found = {r.factor: r.auc for r in auc(scored, "score", "relevant", ["factor"]).collect() if r.auc is not None}
        if not found:
            return dict(current)
        best = max(found.values())
        at = 1.0 if found.get(1.0) == best else min(f for f, v in found.items() if v == best)
        fitted[key] = current[key] * at
    return {k: min(max(v, current[k] * (1 - MOST_STEP)), current[k] * (1 + MOST_STEP)) for k, v in fitted.items()}


def release(new: dict[str, float], reference: dict[str, float]) -> tuple[bool, str]:
    """Whether a model may be published: there is evidence, and no metric is lower."""
    if new.get("n", 0) <= 0:
        return False, "no held-out rows"
    for metric in ("ndcg", "mrr"):
        if new[metric] < reference[metric]:
            return False, f"{metric} is lower: {new[metric]:.4f} < {reference[metric]:.4f}"
    return True, "no metric is lower"


def arm_summary(usage: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row for each arm: requests, tokens, candidates, admitted and their share."""
    u = usage.groupBy("arm").agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    d = decisions.groupBy("arm").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("admitted").alias("admitted"))
    out = u.join(d, "arm", "left").na.fill(0, ["candidates", "admitted"])
    return out.withColumn("acceptance", F.round(F.coalesce(F.try_divide(F.col("admitted").cast("double"), F.col("candidates").cast("double")), F.lit(0.0)), 6))


def with_verdicts(pairs: DataFrame, cache: DataFrame, now: int, ttl: int = 86_400) -> DataFrame:
    """Pairs (query, slice_id) with a cached verdict that is young enough; null asks the judge."""
    key = lambda: F.substring(F.sha2(F.concat("query", F.lit("\0"), F.col("slice_id").cast("string")), 256), 1, 32)
    fresh = cache.filter(F.col("at") > now - ttl).withColumn("key", key()).groupBy("key").agg(F.max_by("verdict", "at").alias("verdict"))
    return pairs.withColumn("key", key()).join(fresh, "key", "left").drop("key")


def judged(zone: Column, stale: Column, verdict: Column) -> Column:
    """The chain of gates: fingerprint, zone, judge; an error of the judge is not an approval."""
    return F.when(stale, "fingerprint").when(zone == "miss", "zone").when(zone == "hit", "approved").when(verdict == "yes", "approved").when(verdict == "error", "judge_error").otherwise("judge_reject")


def rerank(hits: DataFrame, score: Callable[[pd.DataFrame], pd.Series], most: int = 20, k: int = 5) -> DataFrame:
    """The best `most` hits scored again from outside, clamped to [0, 1]; a query whose scorer fails keeps its order.

    hits has query_id, doc_id, score, rank; see `hooks.reranked`.
    """

    def scorer(query_id: object, found: list[dict]) -> list[tuple]:
        got = score(pd.DataFrame(found).assign(query_id=query_id))
        return list(zip((h["doc_id"] for h in found), got, strict=True))

    return hooks.reranked(hits, scorer, most, k, ("score", "rank")).drop("reranked")


def probes(plans: DataFrame, demoted: DataFrame, every: int = 10) -> DataFrame:
    """Plans (plan_no) with a probe: every tenth tries a demoted tool (slot 0..), in turn."""
    n = demoted.agg(F.count(F.lit(1)).alias("n"))
    turn = plans.crossJoin(F.broadcast(n)).filter("n > 0")  # one row
    turn = turn.filter(F.col("plan_no") % every == every - 1).withColumn("slot", F.pmod(F.floor(F.col("plan_no") / every), F.col("n")))
    return plans.join(turn.join(demoted, "slot").select("plan_no", F.col("tool").alias("probe")), "plan_no", "left")


def escape(key: Column, share: float, seed: int = 1) -> Column:
    """Whether a plan strays from the best: a keyed hash stands in for a random stream."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(10_000)) < int(share * 10_000)


def currency(text: Column) -> Column:
    """ISO codes of names and signs; other codes of three letters in capitals, the rest as it is."""
    t, up = F.trim(text), F.upper(F.trim(text))
    return (
        F.when(up.isin("CNY", "RMB", "CNH", "YUAN", "RENMINBI", "¥", "￥"), "CNY").when(up.isin("USD", "US$", "DOLLAR", "DOLLARS", "$"), "USD").when(up.isin("EUR", "EURO", "EUROS", "€"), "EUR")
        .when(up.isin("GBP", "POUND", "POUNDS", "STERLING", "£"), "GBP").when(up.isin("JPY", "YEN"), "JPY").when(t.rlike("^[A-Za-z]{3}$"), up).otherwise(t)
    )


def context_hash(lines: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """(session, hash): sha256 over the JSON of a session's messages in order."""
    items = F.sort_array(F.collect_list(F.struct(order, "role", "text")))
    return lines.groupBy(session).agg(F.sha2(F.to_json(F.transform(items, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))), 256).alias("hash"))


def changed(known: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    """(id, change): added, removed or changed between two tables of digests; what is alike is left out."""
    k, s = known.select(key, F.col("digest").alias("_k")), seen.select(key, F.col("digest").alias("_s"))
    change = F.when(F.col("_k").isNull(), "added").when(F.col("_s").isNull(), "removed").when(F.col("_k") != F.col("_s"), "changed")
    return k.join(s, key, "full_outer").select(key, change.alias("change")).filter("change is not null")


def carried(new: DataFrame, old: DataFrame, columns: tuple[str, ...], key: str = "id") -> DataFrame:
    """New extractions with the counters of an old row of the same id and evidence, else their own."""
    before = old.select(key, "evidence", *[F.col(c).alias(f"_{c}") for c in columns])
    met = new.join(before, [key, "evidence"], "left")
    return met.select(*[c for c in new.columns if c not in columns], *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """(id, useful, neutral, harmful): one count an id and delivery, however often it stands there."""
    return outcomes.dropDuplicates(["delivery", "id"]).groupBy("id").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("useful", "neutral", "harmful")])


def anchored(rows: DataFrame, lineage: DataFrame) -> DataFrame:
    """Recovered rows under their root's topic; a root without one takes its earliest member's.

    rows has id, topic, created; lineage has id, root.
    """
    own = rows.select(F.col("id").alias("root"), F.col("topic").alias("_t"))
    named = F.col("topic").isNotNull() & (F.col("topic") != "")
    member = rows.join(lineage.select("id", "root"), "id")
    first = member.filter(named).groupBy("root").agg(F.min_by("topic", F.struct("created", "id")).alias("_f"))
    return member.join(own, "root", "left").join(first, "root", "left").select("id", "root", F.coalesce(F.nullif("_t", F.lit("")), "_f", F.lit("")).alias("topic"))


def lookup(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """The tool's answer: at most 50 hits a query, 5 where no limit is given, with their zones."""
    k = min(50, limit if limit and limit > 0 else 5)
    top1 = F.max("score").over(Window.partitionBy("query_id"))
    return hits.withColumn("zone", S.zone(F.col("score"), top1)).filter(F.col("rank") <= k)
