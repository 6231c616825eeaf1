"""Scores and decisions as expressions: zones, value weight, costs, freshness, budgets."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zone thresholds.
TAU_HIGH, TAU_LOW, ABS_HIGH, ABS_LOW = 0.8, 0.55, 0.7, 0.45
# Prices for a million tokens, missed and hit.
PRICE_MISS, PRICE_HIT = 0.27, 0.07
# Value weight.
HALF_LIFE_DAYS, FREQ_PSEUDO, REJECT_COST, FEEDBACK_GAIN, LEAST_WEIGHT = 30.0, 3.0, 2.0, 0.5, 0.001


# Where a slice can come from.
ORIGINS = ("user-curated", "import", "session-auto", "prefetch")


def finite(*values: Column) -> Column:
    out = F.lit(True)
    for v in values:
        out = out & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf)
    return out


def zone(score: Column, top1: Column, tau_high: float | Column = TAU_HIGH, tau_low: float | Column = TAU_LOW, abs_high: float | Column = ABS_HIGH, abs_low: float | Column = ABS_LOW) -> Column:
    """hit, grey or miss of a score beside the best score of its query."""
    ratio = F.try_divide(score, top1)
    return (
        F.when(~finite(score, top1) | (score <= 0) | (top1 <= 0) | (top1 < abs_low), "miss")
        .when((ratio >= tau_high) & (top1 >= abs_high), "hit")
        .when(ratio >= tau_low, "grey")
        .otherwise("miss")
    )


def zone_l3(score: Column, result_top1: Column, global_top1: Column, tau_low: float | Column = TAU_LOW) -> Column:
    """The two-axis zone: how a result stands among results, and beside the best hit of all."""
    near, far = F.try_divide(score, result_top1), F.try_divide(score, global_top1)
    return (
        F.when(~finite(score, result_top1, global_top1) | (score <= 0) | (result_top1 <= 0) | (global_top1 <= 0) | (global_top1 < ABS_LOW), "miss")
        .when((near >= TAU_HIGH) & (far >= ABS_LOW) & (global_top1 >= ABS_HIGH), "hit")
        .when((near >= tau_low) & (far >= ABS_LOW), "grey")
        .otherwise("miss")
    )


def zone_top1(top1: Column, top2: Column) -> Column:
    """The zone of a query's best hit by its lead over the second."""
    return F.when(top1.isNull() | (top1 <= 0) | (top1 < ABS_LOW), "miss").when((top1 >= ABS_HIGH) & (top1 - F.coalesce(top2, F.lit(0.0)) >= TAU_LOW * top1), "hit").otherwise("grey")


def freshness(created: Column, now: Column, ttl: Column) -> Column:
    """hit, grey or miss by age in whole seconds; a time of 0 or in the future can't be trusted."""
    age = now - created
    return F.when(ttl <= 0, "hit").when((created <= 0) | (age < 0) | (age > ttl), "miss").when(age > F.floor(ttl / 2), "grey").otherwise("hit")


def value_weight(now: Column, created: Column, last_used: Column, hits: Column, injected: Column, rejected: Column, feedback: Column) -> Column:
    """Decay x frequency x success x feedback, between LEAST_WEIGHT and 1."""
    active = F.greatest(last_used, created)
    age = F.greatest(now - active, F.lit(0)).cast("double")
    decay = F.when(active > 0, F.exp(-F.lit(math.log(2)) * age / (HALF_LIFE_DAYS * 86400))).otherwise(0.5)
    use = (hits + injected).cast("double")
    frequency = (use + 0.5) / (use + FREQ_PSEUDO)
    success = (injected + 1.0) / (injected + 1.0 + REJECT_COST * rejected)
    liked = F.least(F.greatest(1 + FEEDBACK_GAIN * F.when(finite(feedback), feedback).otherwise(0.0), F.lit(0.25)), F.lit(2.0))
    return F.least(F.greatest(decay * frequency * success * liked, F.lit(LEAST_WEIGHT)), F.lit(1.0))


def evict_priority(kind: Column) -> Column:
    out = F.lit(5)
    for i, name in reversed(list(enumerate(("result", "tool_pattern", "memory", "prompt", "context")))):
        out = F.when(kind == name, i).otherwise(out)
    return out


def paid(tokens_in: Column, hit: Column, l3_in: Column, tokens_out: Column, l3_out: Column, miss_price: float | Column = PRICE_MISS, hit_price: float | Column = PRICE_HIT) -> Column:
    """What was paid: input that no cache served, cached input, output, each at its price for a million."""
    return ((tokens_in - hit - l3_in) * miss_price + hit * hit_price + (tokens_out - l3_out) * miss_price) / 1e6


def money(value: Column) -> Column:
    """An amount of billionths, rounded half away from zero; what isn't finite is nothing."""
    return F.round(F.when(finite(value), value).otherwise(0.0), 9).cast("decimal(28,9)")


def provider_cost(prompt: Column, completion: Column, hit: Column, miss: Column, write: Column, write_billed: Column, p_hit: float, p_in: float, p_out: float) -> Column:
    """Cost by rates; misses are what the prompt leaves where they aren't told, and cache writes bill apart."""
    missed = F.when((hit + miss == 0) & (prompt > 0), prompt).when((miss == 0) & (hit > 0) & (prompt > hit), prompt - hit).otherwise(miss)
    wrote = F.least(F.greatest(write, F.lit(0)), missed)
    billed = F.when(wrote > 0, F.when(write_billed > 0, write_billed).otherwise(wrote.cast("double"))).otherwise(0.0)
    return money((hit * p_hit + (missed - wrote + billed) * p_in + completion * p_out) / 1e6)


def budget_action(spent: Column, limit: Column) -> Column:
    r = F.try_divide(spent, limit)
    return F.when((limit <= 0) | (spent < 0), "").when(r >= 1, "hard_stop").when(r >= 0.9, "degrade_tier").when(r >= 0.8, "degrade_inject").when(r >= 0.7, "halt_prefetch").otherwise("")


def load_gate(used: Column, limit: Column, window: Column, estimate: Column, most: float = 0.8) -> Column:
    return F.when((used >= 0) & (limit > 0) & (F.try_divide(used.cast("double"), limit.cast("double")) >= most), "load_saturated").when((window > 0) & (estimate > 0) & (window < estimate), "window_too_short").otherwise("")


def ewma(values: Column, alpha: float, start: float = 0.0) -> Column:
    """The exponential mean of an array in order."""
    return F.aggregate(values, F.lit(start), lambda a, v: (1 - alpha) * a + alpha * v)


def likeness(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; 0 over 2048 characters."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 2048, 0.0).when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def origin_level(origin: Column) -> Column:
    """Trust of an origin: curated by a user 3, made by the system 2, imported or unknown 1."""
    return F.when(origin == "user-curated", 3).when(origin.isin("session-auto", "prefetch"), 2).otherwise(1)
