"""Transition matrices over tool calls, and prefetch plans from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pairs(calls: DataFrame) -> DataFrame:
    """Each call with the next of its session."""
    return calls.withColumn("next", F.lead("tool").over(Window.partitionBy("session").orderBy("seq")))


def matrix(calls: DataFrame) -> DataFrame:
    """(prev, next, n, prob): counted once by pair, then shared out within prev."""
    n = pairs(calls).filter("next is not null").groupBy(F.col("tool").alias("prev"), "next").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("prob", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("prev")), 6))


def plan(transitions: DataFrame, allowed: tuple[str, ...] | None, cost: int, budget: int, most: int, least: float = 0.0, demoted: DataFrame | None = None) -> DataFrame:
    """The likeliest next tools of each tool that a budget allows, by probability, then name.

    allowed are the tools that only read; demoted (prev, next) are pairs that feedback has ruled out.
    """
    rows = transitions.filter(F.col("prob") >= least)
    rows = rows if allowed is None else rows.filter(F.col("next").isin(*allowed))
    rows = rows if demoted is None else rows.join(demoted.select("prev", "next"), ["prev", "next"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("prev").orderBy(F.desc("prob"), "next"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= min(most, budget // cost))


def coverage(calls: DataFrame, plans: DataFrame) -> DataFrame:
    """(n, covered, share): calls that the plan after the call before them had proposed."""
    had = plans.select(F.col("prev").alias("tool"), "next", F.lit(1).alias("hit"))
    met = pairs(calls).filter("next is not null").join(had, ["tool", "next"], "left")
    return met.groupBy("tool").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("covered"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("share"))
