"""Online state over a key's events in order: means and posteriors as weighted sums, the rest as folds.

The streaming package keeps the same states event by event; both take these functions' constants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.folds import ALPHA, ENGINE, START_TAU, adaptive, folded
from tracewell.operators.ranking import global_rank

# Rates of decay.
POSTERIOR_DECAY, WILSON_Z = 0.8, 1.645
TIER_ALPHA = 0.2


def aged(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds age, 0 for a key's latest event, and n, its events. Rows stay rows: a long history spills, it isn't gathered."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return rows.withColumn("age", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])) - 1).withColumn("n", n)


def ewma(rows: DataFrame, key: str, order: list[str], value: str, alpha: float = ALPHA) -> DataFrame:
    """The exponential mean from 0, as a sum of values weighted by age."""
    weight = alpha * F.pow(F.lit(1 - alpha), F.col("age"))
    return aged(rows, key, order).groupBy(key).agg(F.round(F.sum(F.col(value) * weight), 9).alias("ewma"), F.count(F.lit(1)).alias("n"))


def ewma_first(rows: DataFrame, key: str, order: list[str], value: str, alpha: float = TIER_ALPHA) -> DataFrame:
    """The mean that starts at its first sample, whose weight is what the others leave."""
    weight = F.when(F.col("age") == F.col("n") - 1, 1.0).otherwise(alpha) * F.pow(F.lit(1 - alpha), F.col("age"))
    return aged(rows, key, order).groupBy(key).agg(F.round(F.sum(F.col(value) * weight), 9).alias("ewma"))


def beta(rows: DataFrame, key: str, order: list[str], hit: str) -> DataFrame:
    """Decayed hits and wastes, their posterior mean, Wilson's lower bound, and whether the key is demoted."""
    weight = F.pow(F.lit(POSTERIOR_DECAY), F.col("age"))
    got = aged(rows, key, order).groupBy(key).agg(F.sum(F.when(F.col(hit), weight).otherwise(0.0)).alias("h"), F.sum(F.when(F.col(hit), 0.0).otherwise(weight)).alias("w"))
    h, w = F.col("h"), F.col("w")
    n, z = h + w, WILSON_Z
    p = h / n
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    mean = (h + 1) / (n + 2)
    return got.select(key, F.round(h, 6).alias("hits"), F.round(w, 6).alias("wastes"), F.round(mean, 6).alias("mean"), F.when(low < 5e-7, 0.0).otherwise(F.round(low, 6)).alias("wilson_low"), (mean < 0.25).alias("demoted"))


def adaptive_tau(rows: DataFrame, key: str, order: list[str], negative: str, prior: float = START_TAU) -> DataFrame:
    """Each entry's learned threshold after its observations; see `folds.adaptive`."""
    return folded(rows, key, order, adaptive(negative, prior))


def tau_summary(rows: DataFrame) -> DataFrame:
    """Least, upper median and greatest threshold of entries (tau_low, n_adjust), their number and adjustments; one row."""
    ranked = global_rank(rows.select("tau_low", "n_adjust"), ["tau_low"], "_r")
    ends = ranked.agg(F.count(F.lit(1)).alias("entries"), F.min("tau_low").alias("least"), F.max("tau_low").alias("most"), F.sum("n_adjust").alias("adjustments"))
    middle = F.max(F.when(F.col("_r") == F.floor(F.col("entries") / 2) + 1, F.col("tau_low"))).alias("median")
    return ranked.crossJoin(F.broadcast(ends)).groupBy("least", "most", "entries", "adjustments").agg(middle).select("least", "median", "most", "entries", "adjustments")  # one row


def evolve(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The engine's parameters after a run of signals (epoch, name, v) for each key; see `folds.ENGINE`."""
    return folded(rows, key, order, ENGINE)
