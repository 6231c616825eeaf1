"""Model tiers of rounds: hard rules, and for complex rounds what was learned up to that moment.

Outcomes and rounds of a key are one sequence in time; the state that a round meets has seen the outcomes before it only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.folds import scanned

# Tiers, intents that ask for the better one, and the learner's rate, samples and floor.
CHEAP, PRO = "flash", "pro"
INTENTS = ("mutation", "persistent_action")
RATE, SAMPLES, FLOOR, CALLS = 0.2, 10, 0.7, 3

_STATE = "struct<n:int,success:double,cost:double,pro_cost:double>"


def _mean(old: float | None, value: float) -> float:
    return value if old is None else RATE * value + (1 - RATE) * old


def _learned(now: dict | None, seen: dict | None) -> dict | None:
    """The cheap tier's outcomes and mean success, and both tiers' mean cost, after one more outcome; a round changes nothing."""
    if seen is None:
        return now
    now = dict(now or {"n": 0, "success": None, "cost": None, "pro_cost": None})
    spent = seen["tokens"] if seen["tokens"] and seen["tokens"] > 0 else None
    if seen["tier"] == CHEAP:
        now["n"] += 1
        now["success"] = _mean(now["success"], float(bool(seen["success"])))
        if spent:
            now["cost"] = _mean(now["cost"], float(spent))
    elif seen["tier"] == PRO and spent:
        now["pro_cost"] = _mean(now["pro_cost"], float(spent))
    return now


def learned_until(rounds: DataFrame, outcomes: DataFrame, key: str = "session", at: str = "at") -> DataFrame:
    """rounds (key, at once each) with learned (n, success, cost, pro_cost): from outcomes (key, at, tier, success, tokens) before `at`; null without any.

    Outcomes of the same moment come after the round; several at one moment are taken by tier, success and tokens.
    """
    seen = F.struct("tier", F.col("success").cast("boolean").alias("success"), F.col("tokens").cast("double").alias("tokens"))
    rows = outcomes.select(key, at, F.lit(1).alias("_kind"), seen.alias("_seen"), F.struct("tier", "success", "tokens").cast("string").alias("_tie"))
    asks = rounds.select(key, at, F.lit(0).alias("_kind"), F.lit(None).cast("struct<tier:string,success:boolean,tokens:double>").alias("_seen"), F.lit("").alias("_tie"))
    states = scanned(rows.unionByName(asks), key, [at, "_kind", "_tie"], "_seen", _learned, f"learned {_STATE}")
    return rounds.join(states.filter("_kind = 0").select(key, at, "learned"), [key, at], "left")


def decided(rounds: DataFrame, most: int = CALLS, samples: int = SAMPLES, floor: float = FLOOR) -> DataFrame:
    """Adds tier and reason to rounds (intent, n calls, writer: a tool of the round that isn't read-only, learned).

    Intents and writers ask for the better tier, always. So does a round of more than `most` calls, unless `samples`
    outcomes of the cheap tier are known: then that is kept while it succeeds often enough and costs no more.
    """
    intent, x = F.lower(F.btrim(F.coalesce("intent", F.lit("")))), F.col("learned")
    known = F.coalesce(x["n"], F.lit(0)) >= samples
    holds = (x["success"] >= floor) & (x["pro_cost"].isNull() | x["cost"].isNull() | (x["cost"] <= x["pro_cost"]))
    reason = (
        F.when(intent.isin(*INTENTS), F.concat(F.lit("intent:"), intent))
        .when(F.col("writer").isNotNull(), F.concat(F.lit("writer:"), "writer"))
        .when(F.col("n") <= most, "default")
        .when(~known, F.concat(F.lit("complex:"), F.col("n").cast("string")))
        .when(holds, "learned:complex-cheap-ok")
        .otherwise("learned:complex-needs-pro")
    )
    return rounds.withColumn("reason", reason).withColumn("tier", F.when(F.col("reason").isin("default", "learned:complex-cheap-ok"), CHEAP).otherwise(PRO))
