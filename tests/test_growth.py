"""What queries cost as tables grow, shown by plans and by what is shuffled."""

import re

import pytest
from pyspark.sql import functions as F

from tracewell import plans
from tracewell.operators import cards as K


def test_a_lift_reads_freshness_once(spark):
    assert str(K.lift(F.col("project"), F.col("how_fresh"))).count("how_fresh") == 1
    rows = spark.createDataFrame([(p, f) for p in (True, False, None) for f in ("fresh", "current", "stale", "expired", "other", None)], "p boolean, f string")
    got = {(r.p, r.f): r.x for r in rows.select("p", "f", K.lift(F.col("p"), F.col("f")).alias("x")).collect()}
    assert got == {(p, f): None if f in ("expired", None) else (1.08 if p else 1.0) * (0.92 if f == "stale" else 1.0) for p, f in got}
    assert len(got) == 18


@pytest.mark.parametrize("name", ["recall_block", "injection_order", "injection_packing", "retrieval_provenance", "library_too_small", "canonical_ids", "admission_strict", "top_sources"])
def test_texts_are_not_shuffled_for_few_hits(spark, sf, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if all tables were large
    try:
        plan = plans.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not re.search(r"SortMergeJoin\(?.*\[(doc_id|id)#.*Inner", plan)
    assert re.search(r"BroadcastHashJoin \[(doc_id|id)#.*Inner", plan)


@pytest.fixture(scope="module")
def copies(spark, sf, tmp_path_factory):
    """Folders with the documents repeated 4 and 16 times, keys shifted, in one file each."""
    base, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for n in (4, 16):
        folder = tmp_path_factory.mktemp(f"copies{n}")
        more = base.crossJoin(spark.range(n)).withColumn("doc_id", F.col("doc_id") + F.col("id") * 1_000_003).drop("id")
        more.coalesce(1).write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
        out.append(str(folder))
    return out


def shuffled(spark, run) -> int:
    """Rows written to shuffles by all stages of a run, as Spark counts them."""
    sc = spark.sparkContext._jsc.sc()

    def rows() -> int:
        sc.listenerBus().waitUntilEmpty()
        none = spark._jvm.java.util.ArrayList()
        stages = sc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = rows()
    run().write.format("noop").mode("overwrite").save()
    return rows() - before


@pytest.mark.parametrize("name", ["injection_order", "l3_counters", "l3_learned_threshold", "eval_single_vs_three", "lookup", "zone_by_type", "reranked", "ndcg_mrr"])
def test_what_is_shuffled_does_not_grow_with_documents(spark, copies, name):
    """Before, each term of a document, then each pair, was gathered in tasks whose memory grew with the documents."""
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")  # one task reads each table, so both have k rows a query from it
    try:
        few, many = (shuffled(spark, lambda f=f: plans.QUERIES[name](spark, f)) for f in copies)
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum") if before is None else spark.conf.set("spark.sql.files.minPartitionNum", before)
    assert 0 < many < 2 * few
