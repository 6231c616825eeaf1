"""Cleaning a corpus in five stages; each takes (spark, docs, sf_dir) and returns what it keeps.

Stages read the columns of documents only; others fall away. Null ids, null and empty texts, repeated rows
and empty tables pass as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import sentencepieces
from tracewell.llm.common import stored, table
from tracewell.llm.line_dedup import line_dedup
from tracewell.llm.mixing import mix
from tracewell.llm.near_copies import near_dedup
from tracewell.llm.quality_rules import quality_rules

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that has nothing else goes with them. n_chars follows the text."""
    out = line_dedup(docs.select(*COLUMNS))
    empty = (F.col("n_exact") + F.col("n_near") > 0) & ~F.coalesce("kept_text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return out.filter(~empty).withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles alike to 0.8 or more) stays."""
    return near_dedup(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents leave or repeat, so that sources come to their target weights."""
    return mix(docs.select(*COLUMNS))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row; copies that mixing made are split each in its own way."""
    return sentencepieces.encode(docs.select(*COLUMNS), sentencepieces.read_model(), copies=True)


STAGES = [
    ("quality rules", rules_stage),
    ("line dedup", lines_stage),
    ("near-dedup", copies_stage),
    ("mixing", mixing_stage),
    ("sentencepieces", pieces_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has no XXH64 and no closure over links, so the run is tested against a brute-force version.
ORACLE_SQL = None
