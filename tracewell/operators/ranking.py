"""Places in a global order, without one task that sees all rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A table of so many narrow rows or fewer is broadcast.
FEW = 200_000


def _shared(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where all runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="tracewell-"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession) -> str:
    """A path for tables in the shared folder that nothing else uses."""
    return f"{_shared(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"


def small(df: DataFrame, most: int = FEW) -> DataFrame:
    """A kept table, marked for broadcast if its rows, counted here, are `most` or fewer."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(rows.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))


def running(rows: DataFrame, by: list[str], order: str, values: list[str]) -> DataFrame:
    """Replaces values by their sums over the rows of a group that come before in an order without ties.

    Ranges of (group, order) are summed up alone, then one row a group and range together.
    """
    dealt = _ranges(rows, [*by, order])
    whole = dealt.groupBy(*by, "_p").agg(*[F.sum(v).alias(v) for v in values])
    upto = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select(*by, "_p", *[F.coalesce(F.sum(v).over(upto), F.lit(0)).alias(f"_s{i}") for i, v in enumerate(values)])
    own = Window.partitionBy(*by, "_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    met = dealt.withColumns({v: F.coalesce(F.sum(v).over(own), F.lit(0)) for v in values}).join(starts, [*by, "_p"])
    return met.withColumns({v: F.col(v) + F.col(f"_s{i}") for i, v in enumerate(values)}).select(*rows.columns)


def sums_before(rows: DataFrame, by: list[str], order: str, value: Column, name: str) -> DataFrame:
    """Adds the sum of a value over the rows of a group that come before in an order without ties."""
    return running(rows.withColumn(name, value), by, order, [name])


def global_rank(rows: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """Adds the place of each row in an ascending order: ranges are ranked alone and offset by their counts.

    The dealt rows are written out once, so that counts and places see the same ranges.
    """
    dealt = _ranges(rows, order)
    counts = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # one row a range
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return dealt.withColumn("_own", own).join(before, "_p").withColumn(name, F.col("_before") + F.col("_own")).drop("_p", "_before", "_own")
