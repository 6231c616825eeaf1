"""A stored inverted index that grows by batches and is asked without reading a text again.

A batch is a folder of postings (by bucket of the term, sorted by term), one of its documents, one of their numbers and
tokens by source, and one of the sources that it replaces, which is written last: a batch without it doesn't count, and
a batch that is written again takes its own place. Documents of a source count from the latest batch that replaced it
on, so a changed source is replaced and a grown one appended to, and nothing is rewritten until `merge`.

A lookup reads the buckets of its terms only, of them the row groups that the terms' order leaves, and joins postings
with little tables: what counts by source, and the asked terms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators import probing
from tracewell.operators.ranking import kept, small
from tracewell.operators.retrieval import idf, query_terms

#: Terms up to which a lookup gives its terms to the scan as values.
VALUES = 500


class TermIndex:
    """An index under a folder; documents have scope, source, doc_id (unique) and text, and the columns that `meta` (a schema) names.

    Statistics are those of a document's scope. source and scope are strings; a null scope or text counts as empty.
    """

    def __init__(self, spark: SparkSession, folder: str, meta: str = "", doc_id: str = "string", tokenize: Callable[[Column], Column] = T.bigram_tokens, buckets: int = 64):
        self.spark, self.folder, self.tokenize, self.buckets = spark, folder.rstrip("/"), tokenize, buckets
        self.meta = [c.split()[0].strip("`") for c in meta.split(",") if c.strip()]
        own = f"scope string, source string, doc_id {doc_id}"
        self.schemas = {
            "postings": f"{own}, dl int, term string, tf int, batch long, bucket int",
            "documents": f"{own}, dl int{', ' + meta if meta else ''}, batch long",
            "totals": "scope string, source string, n long, dl long, batch long",
            "replaced": "source string, base boolean, batch long",
        }

    def _table(self, kind: str) -> DataFrame:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], self.schemas[kind])
        return self.spark.read.schema(self.schemas[kind]).parquet(f"{self.folder}/{kind}")

    def _write(self, rows: DataFrame, kind: str, batch: int, *by: str) -> None:
        rows.drop("batch").write.mode("overwrite").partitionBy(*by).parquet(f"{self.folder}/{kind}/batch={batch}")

    def _next(self) -> int:
        return int(self._table("replaced").agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]) + 1

    def append(self, docs: DataFrame, replacing: DataFrame | None = None, batch: int | None = None, base: bool = False) -> int:
        """Writes documents as a batch; the earlier documents of the sources of `replacing` (source) count no more. Returns its number."""
        batch = self._next() if batch is None else batch
        empty = F.lit("")
        rows = docs.select(F.coalesce("scope", empty).alias("scope"), "source", "doc_id", *self.meta, self.tokenize(F.col("text")).alias("_w"))
        rows = rows.withColumn("dl", F.size("_w")).filter("dl > 0")
        self._write(rows.select("scope", "source", "doc_id", "dl", *self.meta), "documents", batch)
        counts = rows.select("scope", "source", "doc_id", "dl", F.explode("_w").alias("term")).groupBy("scope", "source", "doc_id", "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
        self._postings(counts, batch)
        self._totals(batch)
        names = replacing.select("source").distinct() if replacing is not None else self.spark.createDataFrame([], "source string")
        mark = self.spark.range(1).select(F.lit(None).cast("string").alias("source"), F.lit(base).alias("base"))  # a batch has a row at least
        self._write(names.withColumn("base", F.lit(False)).unionByName(mark), "replaced", batch)
        return batch

    def _postings(self, counts: DataFrame, batch: int) -> None:
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")
        dealt = counts.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "term", "doc_id")
        self._write(dealt, "postings", batch, "bucket")

    def _totals(self, batch: int) -> None:
        own = self.spark.read.schema(self.schemas["documents"]).parquet(f"{self.folder}/documents/batch={batch}")
        self._write(own.groupBy("scope", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("dl")), "totals", batch)

    def replace(self, docs: DataFrame, sources: DataFrame | None = None) -> int:
        """Appends documents in place of all earlier ones of their sources, or of `sources` (source), which may have none now."""
        return self.append(docs, docs if sources is None else sources)

    def remove(self, sources: DataFrame) -> int:
        return self.append(self.spark.createDataFrame([], self._given()), sources)

    def _given(self) -> str:
        kinds = dict(c.strip().split(" ", 1) for c in self.schemas["documents"].split(", "))
        return ", ".join(f"{c} {kinds[c]}" for c in ("scope", "source", "doc_id", *self.meta)) + ", text string"

    def live(self, kind: str) -> DataFrame:
        """Rows of a table that count."""
        told = self._table("replaced")
        marks = told.filter("source is null").groupBy("batch").agg(F.max("base").alias("base"))
        first = marks.agg(F.coalesce(F.max(F.when(F.col("base"), F.col("batch"))), F.lit(-1)).alias("_first"))  # one row
        batches = marks.join(F.broadcast(first), F.col("batch") >= F.col("_first")).select("batch", "_first")
        since = told.filter("source is not null").groupBy("source").agg(F.max("batch").alias("_since"))
        rows = self._table(kind).join(F.broadcast(batches), "batch")  # a row a batch that isn't merged yet
        return rows.join(small(since), "source", "left").filter(F.coalesce("_since", F.lit(-1)) <= F.col("batch")).drop("_first", "_since", "batch")

    def merge(self) -> int:
        """Writes all that counts as one batch, which hides the ones before; their folders can be deleted then."""
        batch = self._next()
        for kind in ("documents", "totals"):
            self._write(self.live(kind), kind, batch)
        self._postings(self.live("postings").drop("bucket"), batch)
        self._write(self.spark.range(1).select(F.lit(None).cast("string").alias("source"), F.lit(True).alias("base")), "replaced", batch)
        return batch

    def search(self, queries: DataFrame, k: int, where: Column | str | None = None, prune: bool = False) -> DataFrame:
        """(query_id, scope, doc_id, score, rank): the k best documents of each query (query_id, text) and scope by BM25; ties by doc_id.

        `where` is a condition on meta columns that hits have to meet; statistics stay those of all documents. Pairs
        are scored in blocks (see `probing.best`); `prune` makes no difference any more.
        """
        terms = kept(query_terms(queries, self.tokenize).select("query_id", "term"))
        asked = terms.select("term").distinct()
        values = [r.term for r in asked.limit(VALUES + 1).collect()]
        rows = self.live("postings")
        if len(values) <= VALUES:
            at = [r[0] for r in self.spark.createDataFrame([(v,) for v in values], "term string").select(F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")).distinct().collect()]
            found = rows.filter(F.col("bucket").isin(at) & F.col("term").isin(values))
        else:
            found = rows.join(small(asked), "term", "left_semi")
        found = kept(found.select("scope", "doc_id", "dl", "term", "tf"))
        stats = self.live("totals").groupBy("scope").agg(F.sum("n").alias("n"), F.sum("dl").alias("all"))
        df = found.groupBy("scope", "term").agg(F.count(F.lit(1)).alias("df"))
        weights = df.join(small(stats), "scope").select("scope", "term", "df", idf(F.col("n"), F.col("df")).alias("idf"), (F.col("all") / F.col("n")).alias("avgdl"))
        if where is not None:
            found = kept(found.join(self.live("documents").filter(where).select("doc_id"), "doc_id", "left_semi"))
        # Terms are named with their scope, so a query meets each scope alone.
        both = F.concat(F.length("scope").cast("string"), F.lit(":"), "scope", "term").alias("term")
        asks = weights.join(terms, "term").select(F.struct("query_id", "scope").alias("query_id"), F.lit(1).alias("session"), both, "idf", "avgdl")
        hits = probing.best(asks, found.select(F.lit(0).alias("session"), "doc_id", "dl", both, "tf"), k)
        return hits.select("query_id.query_id", "query_id.scope", "doc_id", "score", "rank")
