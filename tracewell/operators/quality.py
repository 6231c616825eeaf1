"""Library maintenance: scoring, eviction, pruning, duplicates, stores, trust, promotion, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import scores as S
from tracewell.operators.ranking import global_rank


def gc(slices: DataFrame, now: int, retention_days: int, least_weight: float, capacity: int, grace_days: int = 7) -> DataFrame:
    """Adds reason: expired, low_score, over_cap or null (kept).

    A retention or least weight of 0 evicts nothing. Over the capacity, the first to go are those out of grace, of the types that go stale fastest, of the
    least weight, the oldest, by id. Ranks come from ranges of that order, so no task sorts all rows.
    """
    cutoff = now - retention_days * 86400
    aged = F.lit(retention_days > 0) & (F.col("created") > 0) & (F.col("created") < cutoff)
    low = F.lit(least_weight > 0) & (F.col("weight") > 0) & (F.col("weight") < least_weight)
    rows = slices.withColumn("reason", F.when(aged, "expired").when(low, "low_score"))
    order = [(F.col("created") > 0) & (now - F.col("created") < grace_days * 86400), S.evict_priority(F.col("kind")), F.col("weight"), F.col("created"), F.col("id")]
    live = rows.filter("reason is null").select("id", *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    over = F.greatest(F.count(F.lit(1)) - capacity, F.lit(0)).alias("over")
    ranked = global_rank(live, ["_o0", "_o1", "_o2", "_o3", "_o4"], "_rank").crossJoin(F.broadcast(live.agg(over)))  # one row
    gone = ranked.filter(F.col("_rank") <= F.col("over")).select("id", F.lit(True).alias("_gone"))
    return rows.join(gone, "id", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("_gone"), "over_cap"))).drop("_gone")


def prune_plan(slices: DataFrame, now: int, older_than_days: int) -> DataFrame:
    """(id, reasons, retained): rows that go, why, and which copy stays for a duplicate. Protected rows stay.

    slices has id, kind, content, created, last_used, rejected, feedback, status, protected, missing.
    """
    cutoff = now - older_than_days * 86400
    stale = (F.col("created") < cutoff) & (F.col("last_used") < cutoff)
    own = F.array_compact(
        F.array(
            F.when(F.col("missing"), "missing_dependency"),
            F.when(stale, "stale_unused"),
            F.when(stale & (F.col("kind") == "result") & (F.col("status") == "probation"), "stale_probation"),
            F.when(stale & ((F.col("rejected") > 0) | (F.col("feedback") < 0)), "stale_rejected"),
        )
    )
    rows = slices.withColumn("own", F.when(F.col("protected"), F.array().cast("array<string>")).otherwise(own))
    survives = F.col("protected") | (F.size("own") == 0)
    group = ["kind", F.sha2("content", 256)]
    # The place in the group as a struct whose least value is the copy to keep; no window, so no task sorts a group.
    place = F.struct((~F.col("protected")).alias("a"), (-F.col("last_used")).alias("b"), (-F.col("created")).alias("c"), F.col("id"))
    reps = rows.filter(F.length("content") > 0).groupBy(F.col("kind").alias("_k"), F.sha2("content", 256).alias("_c")).agg(F.min(F.when(survives, place))["id"].alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1 and rep is not null")
    met = rows.join(reps, (rows["kind"] == reps["_k"]) & (F.sha2("content", 256) == reps["_c"]), "left")
    copy = F.col("rep").isNotNull() & (F.col("rep") != F.col("id")) & ~F.col("protected")
    reasons = F.concat(F.when(copy, F.array(F.lit("exact_duplicate"))).otherwise(F.array().cast("array<string>")), "own")
    return met.select("id", reasons.alias("reasons"), F.when(copy, F.col("rep")).alias("retained")).filter(F.size("reasons") > 0)


def protected(now: int, recent_days: int, kinds: tuple[str, ...] = ("prompt", "context", "tool_pattern", "result", "memory")) -> Column:
    """Whether pruning may not touch a slice: odd, recent, curated, praised or verified ones.

    Of columns kind, created, last_used, hits, injected, origin, feedback, useful and result_status.
    """
    cutoff = now - recent_days * 86400
    origin, status = F.coalesce("origin", F.lit("")), F.coalesce("result_status", F.lit(""))
    return (
        ~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)) | (F.col("created") <= 0) | (F.col("created") >= cutoff) | (F.col("last_used") < 0) | (F.col("last_used") >= cutoff)
        | (((F.col("hits") > 0) | (F.col("injected") > 0)) & (F.col("last_used") == 0)) | (origin == "user-curated") | ~origin.isin("", *S.ORIGINS)
        | (F.col("feedback") > 0) | ~S.finite(F.col("feedback")) | (F.col("useful") > 0) | ~status.isin("", "probation")
    )


def merge_stats(slices: DataFrame, deltas: DataFrame, counters: tuple[str, ...], last: str = "last_used") -> DataFrame:
    """Adds summed counters of deltas (id, ...) to the rows that exist, and takes the later time."""
    sums = deltas.groupBy("id").agg(*[F.sum(c).alias(f"_{c}") for c in counters], F.max(last).alias("_last"))
    out = slices.join(sums, "id", "left")
    return out.select(*[c for c in slices.columns if c not in (*counters, last)], *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in counters], F.greatest(last, F.coalesce("_last", F.lit(0))).alias(last))


def upsert(base: DataFrame, journal: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The rows that a journal of puts and deletes leaves: the last entry of a key counts; base comes before all."""
    entries = base.withColumn(seq, F.lit(-1).cast("long")).withColumn("op", F.lit("put")).unionByName(journal)
    cols = [c for c in entries.columns if c != key]
    last = entries.groupBy(key).agg(F.max_by(F.struct(*cols), seq).alias("e"))
    return last.filter("e.op = 'put'").select(key, *[F.col(f"e.{c}").alias(c) for c in cols if c not in (seq, "op")])


def swept(known: DataFrame, seen: DataFrame, now: int, grace: int, key: str = "id") -> DataFrame:
    """Marks rows that a scan hasn't seen, clears those it has, and leaves out what has been missing for the grace."""
    out = known.join(seen.select(key, F.lit(True).alias("_seen")).distinct(), key, "left")
    since = F.when(F.col("_seen"), 0).when(F.col("missing_since") > 0, F.col("missing_since")).otherwise(now)
    out = out.withColumn("missing_since", since).drop("_seen")
    return out.filter((F.col("missing_since") == 0) | (F.col("missing_since") > now - grace))


def stale_ids(deps: DataFrame, files: DataFrame) -> DataFrame:
    """Ids with a captured dependency (id, path, sha256) that is gone, a link or other than the file now."""
    met = deps.join(files.withColumnRenamed("sha256", "now"), "path", "left")
    bad = F.col("now").isNull() | F.coalesce("is_link", F.lit(False)) | (F.col("now") != F.col("sha256"))
    return met.groupBy("id").agg(F.bool_or(bad).alias("stale")).filter("stale").select("id")


def commit_reason(commit: Column, current: Column) -> Column:
    """Why a slice's commit keeps it from being used beside the current one; null where it is the same."""
    none = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.when(none(current), "current_commit_unknown").when(none(commit), "commit_unknown").when(commit != current, "stale_commit")


def first_facts(facts: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """Facts that are the first of their order under each of their identity keys; ones without a key stay.

    A fact that shares any key with an earlier one goes, whether that one stays or not.
    """
    key = F.explode(F.array_compact(F.array(*[F.when(F.coalesce(F.trim(k), F.lit("")) != "", F.concat(F.lit(f"{k}:"), F.lower(F.trim(k)))) for k in keys])))
    rows = facts.select(order, key.alias("key"))
    first = rows.groupBy("key").agg(F.min(order).alias("_first"))
    late = rows.join(first, "key").filter(F.col(order) > F.col("_first")).select(order).distinct()
    return facts.join(late, order, "left_anti")


def blacklisted(rejections: DataFrame, now: int, window: int, limit: int) -> DataFrame:
    """Slices with as many rejections within the window."""
    return rejections.filter(F.col("at") >= now - window).groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= limit)


def promoted(promotions: DataFrame, rejected: DataFrame, now: int, ttl: int) -> DataFrame:
    """Promotions (id, version, query, at) still valid: young enough, the slice not blacklisted."""
    return promotions.filter(F.col("at") >= now - ttl).join(rejected, "id", "left_anti")


def trust_upgrade(slices: DataFrame, to: Column) -> DataFrame:
    """Sets the origin where its level rises; adds upgraded."""
    up = S.origin_level(to) > S.origin_level(F.col("origin"))
    return slices.withColumn("upgraded", up).withColumn("origin", F.when(up, to).otherwise(F.col("origin")))


def shadowed(project: DataFrame, world: DataFrame, keys: list[str]) -> DataFrame:
    """Global facts that share no identity key with a project fact."""
    key = F.explode(F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}:"), F.lower(F.col(k)))) for k in keys])))
    taken = project.select(key.alias("key")).distinct()
    hit = world.select("id", key.alias("key")).join(taken, "key", "left_semi").select("id").distinct()
    return world.join(hit, "id", "left_anti")
