"""A ledger of usage records on disk, fed by a stream of log lines; batches that are run again change nothing.

A batch writes folders of its own: its new records, then a row for each file that it touched. A record counts if its
batch has written that second folder and it has its file's latest generation, so a batch that fails half way counts as
nothing, and a batch that is run again writes its folders anew. A file that starts anew, or whose receipts contradict
the records, gets a new generation: its old records count no more, without being rewritten. `compact` writes what
counts as a batch that hides the older ones.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.operators import receipts as R
from tracewell.sources.tail import TailedLines

_COUNTS = ", ".join(f"{c} long" for c in R.COUNTS)
RECORDS = f"path string, generation long, offset long, length int, line_hash string, day string, model string, provider string, source string, {_COUNTS}, corrupt boolean"
FILES = "path string, generation long, indexed long, modified timestamp, base boolean"


class Ledger:
    """The tables under a folder that Spark can write: `records` and `rollup` are what counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        spark.dataSource.register(TailedLines)

    def _there(self, kind: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _table(self, kind: str, schema: str, before: int | None) -> DataFrame:
        empty = self.spark.createDataFrame([], f"{schema}, batch long")
        rows = self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.folder}/{kind}") if self._there(kind) else empty
        return rows if before is None else rows.filter(F.col("batch") < before)

    def _batches(self, before: int | None) -> DataFrame:
        """Rows of files of the batches that count: the latest base and what came after it."""
        rows = self._table("files", FILES, before)
        base = rows.agg(F.coalesce(F.max(F.when(F.col("base"), F.col("batch"))), F.lit(-1)).alias("_base"))  # one row
        return rows.join(F.broadcast(base), F.col("batch") >= F.col("_base")).drop("_base")

    def files(self, before: int | None = None) -> DataFrame:
        """path, generation, indexed (bytes) and modified of each file, as the latest batch (below `before`) has them."""
        last = Window.partitionBy("path").orderBy(F.desc("batch"))
        rows = self._batches(before).withColumn("_n", F.row_number().over(last)).filter("_n = 1")
        return rows.select("path", "generation", "indexed", "modified")

    def records(self, before: int | None = None) -> DataFrame:
        written = self._batches(before).select("batch", "path").distinct()
        rows = self._table("records", RECORDS, before).join(written, ["batch", "path"], "left_semi")
        return rows.join(self.files(before).select("path", "generation"), ["path", "generation"], "left_semi").drop("batch")

    def rollup(self) -> DataFrame:
        return R.rollup(self.records())

    def _write(self, rows: DataFrame, kind: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{kind}/batch={batch}")

    def _lines(self, paths: list[str]) -> DataFrame:
        return self.spark.read.format("tailed_lines").option("path", json.dumps(paths)).load()

    def apply(self, lines: DataFrame, batch: int) -> None:
        """Takes a batch of lines of `tailed_lines` in. Batches are numbered upwards; the same number again replaces the batch."""
        lines = lines.persist()
        try:
            before = self.files(batch)
            started = lines.filter("fresh").select("path").distinct()
            kept = before.join(started, "path", "left_anti")
            receipts = R.read(lines.filter("not fresh"))
            fresh, again = R.settle(receipts, self.records(batch).join(started, "path", "left_anti"), kept)
            again = [r.path for r in again.collect()]  # files written anew in place: a few
            whole = self._lines(again) if again else lines.limit(0)
            rows = fresh.unionByName(R.read(whole)) if again else fresh
            renewed = started.select("path").union(self.spark.createDataFrame([(p,) for p in again], "path string")).distinct().withColumn("_new", F.lit(True))
            known = lambda df: df.join(before.select("path", F.col("generation").alias("_g"), F.col("indexed").alias("_i")), "path", "left").join(renewed, "path", "left")
            generation = F.when(F.col("_new") | F.col("_g").isNull(), F.lit(batch).cast("long")).otherwise(F.col("_g")).alias("generation")
            self._write(known(rows).select("*", generation).selectExpr(*[c.split()[0] for c in RECORDS.split(", ")]), "records", batch)
            touched = lines.filter(~F.col("path").isin(again)).unionByName(whole).groupBy("path").agg(F.max(F.col("offset") + F.col("length")).alias("_end"), F.max("modified").alias("modified"))
            indexed = F.when(F.col("_new"), F.col("_end")).otherwise(F.greatest("_end", F.coalesce("_i", F.lit(0).cast("long")))).alias("indexed")
            gone = renewed.join(touched, "path", "left_anti").select("path", F.lit(0).cast("long").alias("_end"), F.lit(None).cast("timestamp").alias("modified"))  # no line left
            self._write(known(touched.unionByName(gone)).select("path", generation, indexed, "modified", F.lit(False).alias("base")), "files", batch)
        finally:
            lines.unpersist()

    def reconcile(self, paths: list[str], batch: int) -> None:
        """Reads whole files anew and replaces their records. Files that aren't there any more keep theirs."""
        lines = self._lines(paths)
        start = lines.select("path", "modified").distinct().select("path", F.lit(0).cast("long").alias("offset"), F.lit(0).alias("length"), "modified", F.lit(True).alias("fresh"), F.lit(None).cast("string").alias("value"))
        self.apply(start.unionByName(lines), batch)

    def compact(self, batch: int) -> None:
        """Writes what counts as one batch; the older batches' folders can be deleted then."""
        self._write(self.records(batch), "records", batch)
        self._write(self.files(batch).withColumn("base", F.lit(True)), "files", batch)

    def follow(self, logs: str, checkpoint: str, **options: str):
        """The stream of a folder's logs into the ledger, as a writer to start."""
        lines = self.spark.readStream.format("tailed_lines").option("path", logs).options(**options).load()
        return lines.writeStream.foreachBatch(lambda df, batch: self.apply(df, batch)).option("checkpointLocation", checkpoint)
