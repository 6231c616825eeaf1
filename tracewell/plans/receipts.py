"""Usage by receipts: events as lines of daily logs, of which some are known, some come again and some are written anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import receipts as R

from .registry import query

_SQL = """with e as (select *, strftime(ts::timestamp, '%Y-%m-%d') "day", case event_type when 'click' then 'acme/click' else event_type end model, floor(value)::bigint + case when user_id % 7 = 0 then 1 else 0 end n from events where event_type <> 'error')
select "day", 'cli' source, model, case event_type when 'click' then 'acme' else 'default' end provider, sum(n)::bigint prompt, 0::bigint completion, 0::bigint reasoning, 0::bigint cache_hit, 0::bigint cache_miss, sum(n)::bigint total, sum((n > 0)::int)::bigint requests, count(*) filter (event_type = 'view') turns from e group by all"""


def _lines(t, more: int):
    """A line for each event; errors are no JSON, and every seventh user's logs say `more`."""
    e = t("events").withColumn("day", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd"))
    n = F.floor("value") + F.when(F.col("user_id") % 7 == 0, more).otherwise(0)
    model = F.when(F.col("event_type") == "click", "acme/click").otherwise(F.col("event_type"))
    text = F.to_json(F.struct(model.alias("model"), F.lit("cli").alias("source"), n.alias("prompt"), n.alias("total"), (F.col("event_type") == "view").alias("turn")))
    value = F.when(F.col("event_type") == "error", "not json").otherwise(text)
    return e.select(F.concat_ws("/", "user_id", F.concat("day", F.lit(".jsonl"))).alias("path"), (F.col("event_id") * 1000).alias("offset"), (F.octet_length(value) + 1).alias("length"), "event_type", value.alias("value"))


@query("receipts_applied", _SQL)
def _(t):
    """Clicks and views are known; then every line comes (again), and every seventh user's contradict what is known."""
    known = R.read(_lines(t, 0).filter("event_type in ('click', 'view')").drop("event_type"))
    now = R.read(_lines(t, 1).drop("event_type"))
    return R.rollup(R.applied(known, now.unionByName(now), now))
