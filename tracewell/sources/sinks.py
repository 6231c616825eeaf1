"""Writers: exports, logs, audit lines, partitioned roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_slices(slices: DataFrame, path: str) -> None:
    """Slices as JSON lines with base64 content: what readers.slice_export reads."""
    slices.withColumn("Content", F.base64(F.encode("Content", "UTF-8"))).write.mode("error").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Rows added to a log of JSON lines."""
    rows.write.mode("append").json(path)


def audit(rows: DataFrame, action: str, path: str) -> None:
    """One audit line for each row: when, what, and the row."""
    append_log(rows.select(F.unix_timestamp().alias("at"), F.lit(action).alias("action"), F.struct("*").alias("row")), path)


def write_rollup(rows: DataFrame, path: str) -> None:
    """A roll-up by day folders; days that rows have are replaced, others stay."""
    rows.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def archive_then_keep(rows: DataFrame, gone: DataFrame, archive: str, kept: str, key: str = "id") -> None:
    """Evicted rows are archived first; only then what stays is written."""
    ids = gone.select(key).distinct()
    rows.join(ids, key, "left_semi").write.mode("append").json(archive)
    rows.join(ids, key, "left_anti").write.mode("overwrite").parquet(kept)
