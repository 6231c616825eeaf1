"""Usage records by receipt: a line of a log is known by its file, its first byte and the hash of its text.

A receipt that is known changes nothing. One that says another text for a place means that the file was written
anew: its records are replaced as a whole. All is stated on tables; `streaming.receipts` keeps them on disk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a line says, with the names of its JSON.
RAW = "ts timestamp, model string, source string, prompt long, completion long, reasoning long, cache_hit long, cache_miss long, total long, requests long, turn boolean"
COUNTS = ["prompt", "completion", "reasoning", "cache_hit", "cache_miss", "total", "requests", "turns"]
KEY = ["path", "offset"]


def day_of(path: Column) -> Column:
    """A daily file's name without its ending."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.jsonl)?$", 1)


def read(lines: DataFrame) -> DataFrame:
    """Receipts of lines (path, offset, length, value): line_hash, day, model, provider, source, counts, and corrupt.

    Blank lines are none. A line that isn't the JSON expected is corrupt, with null counts. A line with a total but no
    requests is one request; the provider stands before the model's slash, and is `default` without one.
    """
    text = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    rows = lines.select("*", text.alias("_t")).filter("_t <> ''")
    rows = rows.withColumn("_j", F.from_json("_t", f"{RAW}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("_j").isNull() | F.col("_j._bad").isNotNull()
    n = lambda c: F.when(~bad, F.coalesce(F.col(f"_j.{c}"), F.lit(0).cast("long")))
    model = F.coalesce("_j.model", F.lit(""))
    requests = F.when((n("total") > 0) & (n("requests") <= 0), F.lit(1).cast("long")).otherwise(n("requests"))
    named = {"requests": requests, "turns": F.when(~bad, F.coalesce(F.col("_j.turn"), F.lit(False)).cast("long"))}
    return rows.select(
        *[c for c in lines.columns if c != "value"],
        F.sha2("_t", 256).alias("line_hash"),
        day_of(F.col("path")).alias("day"),
        model.alias("model"),
        F.when(F.locate("/", model) > 1, F.substring_index(model, "/", 1)).otherwise("default").alias("provider"),
        F.coalesce("_j.source", F.lit("")).alias("source"),
        *[(named[c] if c in named else n(c)).alias(c) for c in COUNTS],
        bad.alias("corrupt"),
    )


def settle(receipts: DataFrame, records: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The receipts that are new, once each, and the paths (path) whose files have to be read again.

    files (path, indexed) say up to which byte a file is in the records; only receipts before that are looked up there. A
    place with two texts, in the records or among the receipts, sends its file to be read again; of such a file no
    receipt is new.
    """
    place = receipts.groupBy(*KEY).agg(F.min("line_hash").alias("_least"), F.max("line_hash").alias("_most"))
    doubtful = place.filter("_least <> _most").select("path")
    late = place.join(files.select("path", "indexed"), "path").filter("offset < indexed").drop("indexed")
    known = late.join(records.select(*KEY, F.col("line_hash").alias("_known")), KEY)
    again = known.filter("_known <> _least").select("path").union(doubtful).distinct()
    fresh = receipts.dropDuplicates(KEY).join(again, "path", "left_anti").join(known.select(*KEY), KEY, "left_anti")
    return fresh, again


def applied(records: DataFrame, receipts: DataFrame, whole: DataFrame) -> DataFrame:
    """The records after a batch of receipts. whole has the receipts of all lines of the files that may have to be read again."""
    files = records.groupBy("path").agg(F.max(F.col("offset") + F.col("length")).alias("indexed"))
    fresh, again = settle(receipts, records, files)
    replaced = whole.join(again, "path", "left_semi").dropDuplicates(KEY)
    return records.join(again, "path", "left_anti").unionByName(fresh.select(*records.columns)).unionByName(replaced.select(*records.columns))


def rollup(records: DataFrame) -> DataFrame:
    """Sums by day, source and model; a corrupt line has none."""
    return records.filter(~F.col("corrupt")).groupBy("day", "source", "model", "provider").agg(*[F.sum(c).alias(c) for c in COUNTS])
