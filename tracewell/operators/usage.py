"""Usage and cost: totals, rollups, ranges with empty days, ledgers, quotas, savings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import scores as S


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def summary(rows: DataFrame, miss: float = S.PRICE_MISS, hit: float = S.PRICE_HIT) -> DataFrame:
    """One row: tokens, what was paid and would have been without caches, savings, what injection returns."""
    l3 = lambda c: F.sum(F.when(F.col("l3_reuse"), F.col(c)).otherwise(0))
    total = rows.agg(
        F.count(F.lit(1)).alias("events"), *[F.sum(c).alias(c) for c in ("tokens_in", "tokens_out", "cache_hit", "injected")],
        F.count_if("l3_reuse").alias("l3_reuses"), F.count_if(F.col("injected") > 0).alias("l2_hits"), l3("tokens_in").alias("l3_in"), l3("tokens_out").alias("l3_out"),
    )
    paid = S.paid(F.col("tokens_in"), F.col("cache_hit"), F.col("l3_in"), F.col("tokens_out"), F.col("l3_out"), miss, hit)
    full = (F.col("tokens_in") + F.col("tokens_out")) * miss / 1e6
    gain = (F.col("injected") * (miss - hit) + (F.col("l3_in") + F.col("l3_out")) * miss) / 1e6
    out = total.withColumn("paid", paid).withColumn("full", full)
    return out.select(
        "events", "tokens_in", "tokens_out", "cache_hit", "injected", "l3_reuses", "l2_hits", F.round("paid", 6).alias("paid"), F.round("full", 6).alias("no_cache"),
        F.round(F.col("full") - F.col("paid"), 6).alias("savings"), F.round(ratio(F.col("full") - F.col("paid"), F.col("full")), 6).alias("savings_rate"),
        F.round(ratio(gain, F.col("injected")) * 1e6, 6).alias("inject_roi"), F.round(ratio(F.col("l3_reuses") + F.col("l2_hits"), F.col("events")), 6).alias("hit_rate"),
    )


def by_provider(rows: DataFrame) -> DataFrame:
    """Events and, of exact ones, tokens and the hit rate of each provider."""
    exact = lambda c: F.coalesce(F.sum(F.when(F.col("exact"), F.col(c))), F.lit(0))
    out = rows.groupBy("provider").agg(F.count(F.lit(1)).alias("events"), F.count_if("exact").alias("exact_events"), F.count_if("l3_reuse").alias("l3_reuses"), exact("tokens_in").alias("tokens_in"), exact("cache_hit").alias("cache_hit"))
    return out.withColumn("hit_rate", F.round(ratio(F.col("cache_hit"), F.col("tokens_in")), 6))


def priced(stats: DataFrame, prices: DataFrame, miss: float, hit: float) -> DataFrame:
    """Adds each provider's own prices, or the common ones; unnamed providers come last by the order column."""
    out = stats.join(prices, "provider", "left").withColumn("miss", F.coalesce("miss", F.lit(miss))).withColumn("hit", F.coalesce("hit", F.lit(hit)))
    place = F.row_number().over(Window.orderBy(F.col("provider") == "", "provider"))
    return out.withColumn("place", place)


def rollup(rows: DataFrame) -> DataFrame:
    """Sums by (day, source, model_ref); an unset request count is 1 where there are tokens."""
    asked = F.when((F.col("requests") == 0) & (F.col("total") > 0), 1).otherwise(F.col("requests"))
    return rows.groupBy("day", "source", "model_ref").agg(F.sum("total").alias("total"), F.sum(asked).alias("requests"), F.count(F.lit(1)).alias("n"))


def daily(rows: DataFrame, first: str, last: str) -> DataFrame:
    """One row a day of a closed range, days without rows included: totals and share of the range."""
    days = rows.sparkSession.sql(f"select explode(sequence(date'{first}', date'{last}', interval 1 day)) day").select(F.date_format("day", "yyyy-MM-dd").alias("day"))
    sums = rows.filter(F.col("day").between(first, last)).groupBy("day").agg(F.sum("total").alias("total"), F.count(F.lit(1)).alias("n"))
    out = days.join(sums, "day", "left").select("day", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("n", F.lit(0)).alias("n"))
    return out.withColumn("share", F.round(ratio(F.col("total"), F.sum("total").over(Window.partitionBy())), 6))


def ledger(rows: DataFrame) -> DataFrame:
    """Token and money sums for (model, source, fingerprint, rate day) and currency, flags and latest time."""
    return rows.groupBy("model", "source", "fingerprint", "rate_day", "currency").agg(
        F.sum("tokens").alias("tokens"), F.sum("amount").alias("amount"), F.bool_or("estimated").alias("any_estimated"), F.bool_and("exact").alias("all_exact"), F.max("at").alias("latest")
    )


def running_quota(rows: DataFrame, limit: int, key: str = "session") -> DataFrame:
    """Adds used (tokens so far that no reuse served) and state: free, paid past the limit, blocked past twice it."""
    used = F.sum(F.when(F.col("l3_reuse"), 0).otherwise(F.col("tokens_in") + F.col("tokens_out"))).over(Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", used).withColumn("state", F.when(F.col("used") <= limit, "free").when(F.col("used") <= 2 * limit, "paid").otherwise("blocked"))


def savings_delta(rows: DataFrame, value: str, key: str = "session", order: str = "seq") -> DataFrame:
    """Adds delta: what a cumulative value has grown since the row before, never below 0."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("delta", F.greatest(F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)), F.lit(0)))


def unhealthy(stats: DataFrame, least_events: int = 20, floor: float = 0.85) -> DataFrame:
    """Providers with enough exact events and a hit rate under the floor."""
    return stats.filter((F.col("exact_events") >= least_events) & (F.col("hit_rate") < floor))
