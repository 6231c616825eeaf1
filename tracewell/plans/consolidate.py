"""Context cards of users' days, and what is left of them when like ones are merged."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import consolidate as C
from tracewell.operators.ranking import kept

from .registry import query

_CARDS = """with e as (select user_id, ts::date d, event_type, event_id % 6 p, value from events),
l as (select user_id, d, 'Frequent paths:' title, 'src/' || event_type || '_' || p || '.py' entry, count(*) n from e group by all union all select user_id, d, 'Frequent tools:', event_type, count(*) from e group by all),
c as (select *, row_number() over (partition by user_id, d, title order by n desc, entry) k from l)
select user_id, strftime(d, '%Y-%m-%d') "day", sha256('Project context observed from repeated tool calls:' || chr(10) || string_agg(title || chr(10) || x, chr(10) order by title)) content_sha256
from (select user_id, d, title, string_agg('- ' || entry || ' (' || n || ')', chr(10) order by k) x from c where k <= 8 group by all) group by all"""


def _counts(t):
    e = t("events").select("user_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("day"), "event_type", (F.col("event_id") % 6).alias("p"))
    path = F.concat(F.lit("src/"), "event_type", F.lit("_"), "p", F.lit(".py"))
    kinds = F.array(F.struct(F.lit("Frequent paths:").alias("title"), path.alias("entry")), F.struct(F.lit("Frequent tools:").alias("title"), F.col("event_type").alias("entry")))
    return e.select("user_id", "day", F.inline(kinds)).groupBy("user_id", "day", "title", "entry").agg(F.count(F.lit(1)).alias("n"))


@query("context_cards", _CARDS)
def _(t):
    return C.context_card(_counts(t), ["user_id", "day"]).select("user_id", "day", F.sha2("content", 256).alias("content_sha256"))


def cards(t):
    """id, content, scope, hits, created, source: a card for each user and day."""
    made = C.context_card(_counts(t), ["user_id", "day"])
    facts = t("events").groupBy("user_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("hits"), F.max("event_id").alias("created"))
    id_ = F.col("user_id") * 100_000_000 + F.translate("day", "-", "").cast("long")
    return made.join(facts, ["user_id", "day"]).select(id_.alias("id"), "content", (F.col("user_id") % 4).alias("scope"), "hits", "created", F.col("user_id").cast("string").alias("source"))


@query("merged_context")
def _(t):
    """Cards of one scope whose entries are alike, as one card with the sums of their facts."""
    rows = kept(cards(t))
    groups = C.merge_groups(rows, ["scope"])
    facts = C.merged_facts(rows, groups, ["hits"], "created", "source")
    return C.merged_cards(rows, groups).drop("content").join(facts, "rep")
