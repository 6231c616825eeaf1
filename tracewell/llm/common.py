"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Sequence
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def settled(value: Column) -> Column:
    """The value as it is, in a projection that filters above it don't pass.

    The optimizer moves a filter below a projection by writing the projection's expressions into it; over a
    chain of projections that use a column more than once, the work would grow with every step.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def hash2(*cols: Column) -> tuple[Column, Column]:
    """Two XXH64 values under unlike seeds: together a 128-bit name."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(7), *cols)


def guarded(operator):
    """For operators that pass columns through: names with a leading underscore, which they use, are put aside."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **kwargs):
        names = {c: f"given {i}" for i, c in enumerate(docs.columns) if c.startswith("_")}
        if not names:
            return operator(docs, *args, **kwargs)
        kwargs = {k: names.get(v, v) if isinstance(v, str) else v for k, v in kwargs.items()}
        return operator(docs.withColumnsRenamed(names), *args, **kwargs).withColumnsRenamed({v: c for c, v in names.items()})

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='tracewell-')}"
        spark.sparkContext.setCheckpointDir(path)
    return path


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tracewell/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it again: cuts the lineage and outlives executors."""
    path = f"{_own_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def done_with(*tables: DataFrame) -> None:
    """Deletes tables of `stored` that nothing reads any more, and has the driver notice finished shuffles, so that their files go too."""
    spark = tables[0].sparkSession
    for t in tables:
        _delete(spark, t.stored_at)
    gc.collect(0)
    spark.sparkContext._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application has stored; results that still read them fail then."""
    _delete(spark, _own_dir(spark))


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], salts: int = 16) -> DataFrame:
    """Inner join in which each key's left rows spread over several tasks.

    right must have few rows a key: it is repeated once for each salt.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(salts)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return left.withColumn("_salt", salt).join(right.withColumn("_salt", every), [*keys, "_salt"]).drop("_salt")


#: A key is hot if more than one in so many rows has it; there are fewer hot keys than this.
HOT = 1_000


def split_join(left: DataFrame, right: DataFrame, keys: Sequence[str], n: str, total: int) -> DataFrame:
    """Inner join with a row a key on the right, whose column n says how many of left's `total` rows have the key.

    Hot keys, fewer than HOT rows by their counts, are broadcast, so their rows aren't shuffled; the others meet by
    shuffle. Both sides may be read twice, so they should be stored tables; n is dropped.
    """
    hot = F.col(n) * HOT > total
    some = right.filter(hot).drop(n)
    if some.isEmpty():
        return left.join(right.drop(n), list(keys))
    cold = left.join(F.broadcast(some.select(*keys)), list(keys), "left_anti").join(right.filter(~hot).drop(n), list(keys))
    return left.join(F.broadcast(some), list(keys)).unionByName(cold)


#: A stored table of so many narrow rows or fewer is broadcast.
FEW = 200_000


def checked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], n: str, total: int) -> DataFrame:
    """Inner join with a stored table of a row a key: broadcast if its rows, counted here, are FEW; else split_join."""
    if right.limit(FEW + 1).count() <= FEW:
        return left.join(F.broadcast(right.drop(n)), list(keys))
    return split_join(left, right, keys, n, total)


def ranged(rows: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """The rows, stored, with _p, the number of the range of the order that a row is in. Rows alike in the order share a range."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))
