"""Offline evaluation: replay splits, bins, confusion, ranking metrics, AUC, paired arms, fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.ranking import global_rank, kept, small, sums_before


def chronological(rows: DataFrame, order: list[str], holdout: float, by: list[str] | None = None) -> DataFrame:
    """Adds is_holdout: the latest share of a group's rows, at least one row on either side where there are two.

    Without groups the places come from ranges of the order, so no task sees all rows.
    """
    split = lambda n: F.greatest(F.least(n - F.floor(n * holdout), n - 1), F.lit(1))
    if not by:
        total = rows.agg(F.count(F.lit(1)).alias("_n"))
        ranked = global_rank(rows, order, "_r").crossJoin(F.broadcast(total))  # one row
        return ranked.withColumn("is_holdout", F.col("_r") > split(F.col("_n"))).drop("_r", "_n")
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("is_holdout", rank > split(n))


def hash_split(text: Column, share: float) -> Column:
    """Whether a text falls into the share, by the first 8 bytes of its sha256 modulo 10000."""
    head = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % 10_000).cast("int") < int(share * 10_000)


def bins(rows: DataFrame, value: str, n: int = 10) -> DataFrame:
    """(bin, n, mean_top1, precision) for n equal bins of a value in [0, 1]; empty bins are there."""
    every = rows.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    at = F.least(F.floor(F.greatest(F.col(value), F.lit(0.0)) * n), F.lit(n - 1)).cast("int")
    got = rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("top1"), 5).alias("mean_top1"), F.round(F.avg(F.col("relevant").cast("double")), 6).alias("precision"))
    return every.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean_top1", F.lit(0.0)).alias("mean_top1"), F.coalesce("precision", F.lit(0.0)).alias("precision"))


def confusion(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row of counts, precision, recall and F1; a null prediction is an error, counted apart."""
    n = lambda test: F.count_if(test)
    out = rows.agg(n(predicted & actual).alias("tp"), n(predicted & ~actual).alias("fp"), n(~predicted & ~actual).alias("tn"), n(~predicted & actual).alias("fn"), n(predicted.isNull()).alias("errors"), F.count(F.lit(1)).alias("n"))
    d = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), b.cast("double")), F.lit(0.0))
    out = out.withColumn("precision", F.round(d("tp", F.col("tp") + F.col("fp")), 6)).withColumn("recall", F.round(d("tp", F.col("tp") + F.col("fn")), 6))
    return out.withColumn("f1", F.round(F.coalesce(F.try_divide(2.0 * F.col("tp"), (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double")), F.lit(0.0)), 6))


def ranking(rows: DataFrame, k: int) -> DataFrame:
    """(query_id, ndcg, rr) at k of rows with rank and relevant; queries without a relevant row are left out."""
    gain = F.sum(F.when(F.col("relevant") & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    n = F.count_if("relevant")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    out = rows.groupBy("query_id").agg(gain.alias("gain"), n.alias("n"), F.min(F.when(F.col("relevant") & (F.col("rank") <= k), F.col("rank"))).alias("first")).filter("n > 0")
    return out.select("query_id", F.round(F.col("gain") / ideal, 6).alias("ndcg"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"))


def auc(rows: DataFrame, score: str, positive: str, by: list[str]) -> DataFrame:
    """Rank AUC with ties at one half, from counts of distinct scores: no row is compared with another.

    Sums over lower scores come from ranges, so a group of any size is ranked by many tasks.
    """
    counts = rows.groupBy(*by, score).agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    won = sums_before(counts, by, score, F.col("n"), "below").withColumn("won", F.col("p") * (F.col("below") + F.col("n") / 2))
    out = won.groupBy(*by).agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return out.select(*by, F.round(F.try_divide(F.col("won"), (F.col("p") * F.col("n")).cast("double")), 6).alias("auc"))


def distribution(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean and interpolated median, p75 and p90; and the upper median, which is an element. Nulls aren't counted.

    Places come from counts of distinct values and their sums in ranges, so a group of any size is ranked by many tasks.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    placed = kept(sums_before(counts, by, "_v", F.col("_c"), "_below"))
    whole = placed.groupBy(*by).agg(F.sum("_c").alias("_n"), (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("_mean"))
    shares = {"median": 0.5, "p75": 0.75, "p90": 0.9}
    met = placed.join(small(kept(whole)), by)
    here = lambda i: F.max(F.when((F.col("_below") <= i) & (i < F.col("_below") + F.col("_c")), F.col("_v")))
    at = lambda share: F.lit(share) * (F.col("_n") - 1)
    ends = [x for k, s in shares.items() for x in (here(F.floor(at(s))).alias(f"_{k}0"), here(F.ceil(at(s))).alias(f"_{k}1"))]
    out = met.groupBy(*by, "_n", "_mean").agg(*ends, here(F.floor(F.col("_n") / 2)).alias("upper_median"))
    part = lambda k, s: F.col(f"_{k}0") + (F.col(f"_{k}1") - F.col(f"_{k}0")) * (at(s) - F.floor(at(s)))
    return out.select(*by, F.round("_mean", 6).alias("mean"), *[F.round(part(k, s), 6).alias(k) for k, s in shares.items()], "upper_median")


def unpaired(rows: DataFrame, arm: str, base: str) -> DataFrame:
    """(instance, missing): instances that only one of two arms has, and the arm that lacks them; arms are comparable where there are none."""
    has = lambda a: F.bool_or(F.col("arm") == a)
    sides = rows.filter(F.col("arm").isin(arm, base)).groupBy("instance").agg(has(arm).alias("a"), has(base).alias("b")).filter("a <> b")
    return sides.select("instance", F.when(F.col("a"), base).otherwise(arm).alias("missing"))


def paired(rows: DataFrame, arm: str, base: str, value: str) -> DataFrame:
    """(instance, delta): an arm beside the baseline on the same instances."""
    a = rows.filter(F.col("arm") == arm).select("instance", F.col(value).alias("a"))
    b = rows.filter(F.col("arm") == base).select("instance", F.col(value).alias("b"))
    return a.join(b, "instance").select("instance", F.round(F.col("a") - F.col("b"), 6).alias("delta"))


def quotas(groups: DataFrame, total: int) -> DataFrame:
    """Adds quota: shares of a total by largest remainders, ties by group. One row a group."""
    share = F.col("n") * total / F.sum("n").over(Window.partitionBy())
    rows = groups.withColumn("_s", share).withColumn("_f", F.floor("_s"))
    left = total - F.sum("_f").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("_s") - F.col("_f"), 9)), "group"))
    return rows.withColumn("quota", (F.col("_f") + (place <= left).cast("int")).cast("long")).drop("_s", "_f")


def policies(rows: DataFrame, tau: float) -> DataFrame:
    """Reuse and error rates of a single threshold and of the three regions, where grey ones aren't reused.

    rows has top1, zone and right (whether the best hit has the query's class).
    """
    single = F.col("top1") >= tau
    hit = F.col("zone") == "hit"

    def of(name: str, reused: Column, grey: Column) -> Column:
        n = F.count_if(reused)
        rate = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)
        return F.struct(F.lit(name).alias("policy"), n.alias("reused"), F.count_if(grey).alias("grey"), rate(n, F.count(F.lit(1))).alias("reuse_rate"), rate(F.count_if(reused & ~F.col("right")), n).alias("error_rate"))

    return rows.agg(F.array(of("single", single, F.lit(False)), of("three", hit, F.col("zone") == "grey")).alias("p")).select(F.inline("p"))
