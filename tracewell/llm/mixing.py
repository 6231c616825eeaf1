"""Mixing sources to target weights by systematic sampling.

Each document has expected copies. Within a source documents descend by size; the running sum of expected copies plus
one random offset crosses integers, and a document is taken once for each that it crosses.

A document that holds more than one LARGE-th of its source's words would put the source off its target by its own size.
Such documents, fewer than LARGE in a source, have whole numbers of expected copies, next to target / source size, so
that the words expected up to each of them stay near that share; what they leave sets the rate of all smaller ones,
which is the same for each. So a source is out by about the size of its largest smaller document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, guarded, hash2, ranged, stored, table

WEIGHTS = (5, 2, 1)
#: No source gives more than so many times its size, no document more than so many copies.
MOST = 3
#: A document is large if it holds more than one in so many words of its source.
LARGE = 256
SEED = 20_240_229


def _before(rows: DataFrame, order: Sequence[Column | str], **sums: Column) -> DataFrame:
    """Adds sums over the rows that come before in an order. Ranges are summed up alone, and one row a range together."""
    dealt = ranged(rows, order)
    whole = dealt.groupBy("_p").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    upto = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select("_p", *[F.coalesce(F.sum(f"_{n}").over(upto), F.lit(0)).alias(f"_{n}") for n in sums])
    own = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.select("*", *[F.coalesce(F.sum(c).over(own), F.lit(0)).alias(n) for n, c in sums.items()]).join(starts, "_p")
    return out.select(*rows.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Adds target to (source, source_size): shares of all words by weight, each at most `most` times its size.

    Weights repeat over sources by code point, null last. What a source can't give is dealt out by weight
    over the others until none is above its limit: the level at which the limits and the weighted shares
    fill the total is found in one pass over sources by limit a weight. Sources are summed up in ranges.
    """
    w = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_r") % len(weights) + 1).cast("int"))
    rows = _before(sizes, [F.col("source").asc_nulls_last()], _r=F.lit(1)).withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    rows = stored(rows.drop("_r").withColumn("_at", F.col("_cap") / F.col("_w")))
    rows = _before(rows, [F.col("_at").asc(), F.col("source").asc_nulls_last()], _full=F.col("_cap"), _closed=F.col("_w"))
    total = rows.agg(F.sum("source_size").cast("double").alias("_all"), F.sum("_w").alias("_weights"))  # one row
    rows = stored(rows.crossJoin(F.broadcast(total)).withColumn("_level", (F.col("_all") - F.col("_full")) / (F.col("_weights") - F.col("_closed"))))
    level = rows.agg(F.max(F.when(F.col("_level") <= F.col("_at"), F.col("_level"))).alias("_level"))  # one row
    goal = F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap")))
    return rows.drop("_level").crossJoin(F.broadcast(level)).withColumn("target", goal).select(*sizes.columns, "target")


def sized(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """source, size (words; 0 for null), _tie (the text's hash) and the columns to keep."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(*keep, "source", F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(body).alias("_tie"))


def _whole(sizes: Column, rate: Column, offset: Column, most: float) -> Column:
    """Whole expected copies of large documents by descending size: next to the rate, so that the words expected stay near its share.

    sums are the running sums of the copies, left the words that they are too few (or, below 0, too many).
    """
    least, top = F.floor(rate), F.least(F.ceil(rate), F.lit(int(most)).cast("long"))

    def step(acc: Column, size: Column) -> Column:
        want = acc["left"] + rate * size
        n = F.least(F.greatest(F.floor(want / size + offset), least), top)
        return F.struct((want - n * size).alias("left"), F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + n)).alias("sums"))

    return F.aggregate(sizes, F.struct(F.lit(0.0).alias("left"), F.array(F.lit(0).cast("long")).alias("sums")), step)


def copies(rows: DataFrame, seed: int = SEED, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Adds source_size, target and copies to rows with doc_id, source, size and _tie.

    Places in a source come from ranges of the whole order (source, size, doc_id, _tie), whose counts are summed up in
    a small table, so a source that holds most rows is ranked by many tasks, in the same way at every size. The offset
    is drawn from the seed and the source. Null sources are one source; null ids come last. Rows without words are
    never taken, nor is a row more than `most` times. Rows alike in the order may stand for each other.
    """
    digest = lambda c: F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")
    key = F.coalesce(F.col("source"), F.lit("\0"))
    order = ["_src", F.desc("size"), F.col("doc_id").asc_nulls_last(), "_tie"]
    dealt = ranged(rows.withColumn("_src", key), order)
    block = ["_src", "_p"]
    counts = stored(dealt.groupBy(*block, "source").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_words"), F.max("size").alias("_top")))
    goals = stored(targets(counts.groupBy("_src", "source").agg(F.sum("_words").alias("source_size")), weights, most).drop("source"))
    before = F.sum("_n").over(Window.partitionBy("_src").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*block, F.coalesce(before, F.lit(0)).alias("_start"))
    # Only a block whose largest document is large has large ones.
    large = F.col("size") * LARGE > F.col("source_size")
    heads = counts.join(goals, "_src").filter(F.col("_top") * LARGE > F.col("source_size")).select(*block, "source_size")
    top = dealt.join(heads, block).filter(large).groupBy("_src").agg(F.sort_array(F.collect_list("size"), asc=False).alias("_sizes"))  # fewer than LARGE
    offset = digest(F.concat(F.lit(f"{seed}:"), F.col("_src")).cast("binary")) % 1_000_000 / F.lit(1e6)
    share = F.least(F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0)), F.lit(float(most)))
    sizes = F.coalesce("_sizes", F.array().cast("array<bigint>"))
    plan = goals.join(top, "_src", "left").withColumn("_sizes", sizes).withColumn("_u", offset).withColumn("_b", _whole(F.col("_sizes"), share, F.col("_u"), most))
    small = F.col("source_size") - F.aggregate("_sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    rate = F.coalesce(share + F.try_divide(F.col("_b.left"), small.cast("double")), F.lit(0.0))
    rate = F.least(F.greatest(rate, F.lit(0.0)), F.lit(float(most))).cast("decimal(20,12)")
    plan = plan.select("_src", "source_size", "target", F.col("_b.sums").alias("_sums"), F.col("_u").cast("decimal(7,6)").alias("_u"), rate.alias("_rate"))
    # One row a source and range, so a source's rows don't meet its plan in one task.
    met = dealt.join(starts.join(plan, "_src"), block)
    met = met.withColumn("_rank", F.col("_start") + F.row_number().over(Window.partitionBy(*block).orderBy(*order[1:])))
    smaller = lambda i: F.greatest(i - F.size("_sums") + 1, F.lit(0)).cast("decimal(18,0)") * F.col("_rate")
    expected = lambda i: F.element_at("_sums", F.least(i + 1, F.size("_sums")).cast("int")).cast("decimal(18,0)") + smaller(i)
    crossed = lambda i: F.floor(F.col("_u") + expected(i))
    n = F.when(F.col("size") > 0, crossed(F.col("_rank")) - crossed(F.col("_rank") - 1)).otherwise(0)
    return met.withColumn("copies", n.cast("int")).select(*rows.columns, "source_size", "target", "copies")


@guarded
def mix(docs: DataFrame, text: str = "text", **how: object) -> DataFrame:
    """The mixed rows: each row of docs as often as its copies, columns as they were."""
    given = docs.columns
    k1, k2 = hash2(*[x for c in given for x in (F.col(c).isNull(), F.col(c))])
    rows = docs.withColumn("_k1", k1).withColumn("_k2", k2)
    taken = copies(sized(rows, "doc_id", "_k1", "_k2", text=text), **how).groupBy("_k1", "_k2").agg(F.sum("copies").alias("_n")).filter("_n > 0")
    # Rows alike in every column are one row here, repeated as often as all of them.
    met = rows.join(taken, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"])
    return met.select(*given, F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_c")).select(*given)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = copies(sized(table(spark, sf_dir, "documents"), "doc_id"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


_DIGEST = "('0x' || left(md5({}), 8))::bigint"

SQL = rf"""
with recursive d as (select doc_id, source, coalesce(source, chr(0)) s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size from documents),
z as (select s, source, sum(size)::bigint source_size from d group by all),
w as (select *, [{", ".join(f"{w:.1f}" for w in map(float, WEIGHTS))}][1 + (row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)}] w, source_size * {float(MOST)}::double cap from z),
v as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0.0::double))
             / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) lv from w),
t as (select s, source_size, least(cap, coalesce(max(case when lv <= cap / w then lv end) over () * w, cap)) target from v),
g as (select *, least(coalesce(target / nullif(source_size, 0), 0), {MOST})::double share, ({_DIGEST.format(f"'{SEED}:' || s")} % 1000000) / 1e6::double u from t),
r as (select d.s, doc_id, size, row_number() over (partition by d.s order by size desc, doc_id nulls last) k, size * {LARGE} > source_size large from d join z using (s)),
f(s, k, rest, size, n) as (select s, 0::bigint, 0.0::double, 0::bigint, 0::bigint from g union all
  select r.s, r.k, f.rest + share * r.size - x.n * r.size, r.size, x.n from f join r on r.s = f.s and r.k = f.k + 1 and r.large join g on g.s = f.s,
    lateral (select least(greatest(floor((f.rest + share * r.size) / r.size + u), floor(share)), ceil(share), {MOST})::bigint n) x),
e as (select s, arg_max(rest, k) rest, sum(size)::bigint words from f group by s),
p as (select g.s, source_size, target, u::decimal(7, 6) u, least(greatest(coalesce(share + rest / nullif(source_size - words, 0), 0), 0), {MOST})::decimal(20, 12) rate from g join e using (s)),
c as (select doc_id, r.size, source_size, target, u, case when r.size = 0 then 0::decimal(20, 12) when large then f.n::decimal(20, 12) else rate end expected, r.s, k from r join p using (s) left join f using (s, k)),
b as (select *, u + sum(expected) over (partition by s order by k) upto from c)
select doc_id, size, source_size, target, (size * (floor(upto) - floor(upto - expected)))::bigint taken from b
"""
