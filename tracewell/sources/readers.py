"""Readers: transcripts, event and usage logs, daily records, exports, tab-separated lists, traces, SSE logs.

All have fixed schemas, skip blank and malformed lines, and take columns that a line lacks as null or 0.
They work on any path that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest lines, in bytes: transcripts, and stores or logs.
LINE, LOG_LINE = 4 << 20, 8 << 20

TRANSCRIPT = "role string, type string, content string, name string, tool_call_id string, verification string, workspace_mutation boolean, tool_calls array<struct<id:string,name:string,arguments:string>>"
USAGE = "session_id string, turn bigint, provider string, vendor string, model string, exact boolean, tokens_in bigint, tokens_out bigint, cache_hit_tokens bigint, injected_tokens bigint, l3_reuse boolean, l3_false_hit boolean, l3_slice_id string, slice_hits int, judge array<struct<slice_id:string,verdict:string,reason:string,error:string,rel_confidence:double,called:boolean,fail_closed:boolean,latency_ms:bigint,prompt_tokens:bigint>>, at bigint"
RECORD = "ts timestamp, model string, source string, prompt bigint, completion bigint, reasoning bigint, cache_hit bigint, cache_miss bigint, total bigint, requests int, turn boolean"
STATS = "Hits:bigint,Misses:bigint,Injected:bigint,Rejected:bigint,Useful:bigint,Neutral:bigint,Harmful:bigint,UserFeedback:double,last_used:bigint"
META = "SourceSession:string,TaskType:string,Language:string,ProjectSlug:string,source_sessions:array<string>,base_commit:string,origin:string,deps:map<string,string>,mtimes:map<string,bigint>,l3_safe:boolean,historical:boolean,context_hash:string,model:string,result_status:string"
SLICE = f"ID string, Type int, Scope int, Content string, Embedding array<float>, Stats struct<{STATS}>, Weight double, Meta struct<{META}>, created_at bigint"


def _parsed(lines: DataFrame, schema: str, most: int) -> DataFrame:
    """Lines (value and more columns) parsed; blank, oversized and malformed ones are left out."""
    kept = lines.filter((F.trim("value") != "") & (F.octet_length("value") <= most))
    bad = "_corrupt"
    out = kept.withColumn("j", F.from_json("value", f"{schema}, {bad} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}))
    return out.filter(F.col("j").isNotNull() & F.col(f"j.{bad}").isNull()).drop("value")


def _lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """value with file, line_no and modified. A file is one task's rows in order, so places number its lines."""
    rows = spark.read.option("wholetext", False).text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_o"))
    return rows.withColumn("line_no", F.struct("_b", "_o")).drop("_b", "_o")


def transcripts(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Lines of sessions, one file each: session (the file's name), line_no to order by, and the line's fields.

    A line without a role is left out unless its type is tool, which is its role then.
    """
    out = _parsed(_lines(spark, paths), TRANSCRIPT, LINE).select(F.regexp_extract("file", r"([^/]+?)(?:\.jsonl)?$", 1).alias("session"), "line_no", "modified", "j.*").drop("_corrupt")
    role = F.when(F.coalesce("role", F.lit("")) != "", F.col("role")).when(F.col("type") == "tool", "tool")
    return out.withColumn("role", role).filter("role is not null")


def arguments(column: Column, schema: str) -> Column:
    """Tool arguments: an object, or a JSON string that holds one."""
    inner = F.get_json_object(F.concat(F.lit('{"v":'), column, F.lit("}")), "$.v")
    text = F.when(column.rlike(r'^\s*"'), inner).otherwise(column)
    return F.when(text.rlike(r"^\s*\{"), F.from_json(text, schema))


def usage_log(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    rows = _parsed(spark.read.text(paths), USAGE, LOG_LINE).select("j.*").drop("_corrupt")
    counts = ("tokens_in", "tokens_out", "cache_hit_tokens", "injected_tokens", "slice_hits", "at")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts} | {c: F.coalesce(c, F.lit(False)) for c in ("exact", "l3_reuse", "l3_false_hit")})


def daily_records(spark: SparkSession, folder: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Records of YYYY-MM-DD.jsonl files with their day; days out of a closed range aren't parsed."""
    rows = spark.read.text(f"{folder}/*.jsonl").withColumn("day", F.regexp_extract(F.col("_metadata.file_name"), r"^(\d{4}-\d{2}-\d{2})\.jsonl$", 1)).filter("day <> ''")
    if first:
        rows = rows.filter(F.col("day") >= first)
    if last:
        rows = rows.filter(F.col("day") <= last)
    return _parsed(rows, RECORD, LOG_LINE).select("day", "j.*").drop("_corrupt")


def slice_export(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Slices of an export, content decoded; lines without an id are left out."""
    rows = _parsed(spark.read.text(paths), SLICE, LOG_LINE).select("j.*").drop("_corrupt").filter("coalesce(ID, '') <> ''")
    return rows.withColumn("Content", F.decode(F.unbase64("Content"), "UTF-8"))


def export_counts(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(taken, oversized, malformed, nameless): lines of an export that slice_export takes, and why it skips others; one row. Blank lines aren't counted."""
    bad = "_corrupt"
    lines = spark.read.text(paths).filter(F.trim("value") != "").select(F.when(F.octet_length("value") <= LOG_LINE, F.col("value")).alias("value"))
    rows = lines.withColumn("j", F.from_json("value", f"{SLICE}, {bad} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}))
    large, wrong = F.col("value").isNull(), F.col("j").isNull() | F.col(f"j.{bad}").isNotNull()
    none = F.coalesce(F.col("j.ID"), F.lit("")) == ""
    return rows.agg(F.count_if(~large & ~wrong & ~none).alias("taken"), F.count_if(large).alias("oversized"), F.count_if(~large & wrong).alias("malformed"), F.count_if(~large & ~wrong & none).alias("nameless"))


def imported(slices: DataFrame, origin: str = "import") -> DataFrame:
    """Slices as an import takes them: their origin forced, results on probation, one row an id."""
    status = F.when(F.col("Type") == 3, "probation").otherwise(F.col("Meta.result_status"))
    rows = slices.withColumn("Meta", F.col("Meta").withField("origin", F.lit(origin)).withField("result_status", status))
    cols = [c for c in rows.columns if c != "ID"]
    return rows.groupBy("ID").agg(F.max_by(F.struct(*cols), "created_at").alias("s")).select("ID", "s.*")


def journal(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """A store's journal: op (put, del, stat), id, the slice of a put, the counters of a stat."""
    return _parsed(_lines(spark, paths), "op string, id string, s string, d string", LOG_LINE).select("line_no", "j.op", F.coalesce("j.id", F.get_json_object("j.s", "$.ID")).alias("id"), "j.s", "j.d").filter("op is not null")


def tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A tab-separated list; blank lines and # comments are left out, a line of another width is an error."""
    rows = spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").startswith("#")).select(F.split("value", "\t", -1).alias("v"))
    right = F.when(F.size("v") == len(columns), F.col("v")).otherwise(F.raise_error(F.concat(F.lit("malformed line: "), F.array_join("v", " "))))
    return rows.select(right.alias("v")).select(*[F.col("v")[i].alias(c) for i, c in enumerate(columns)])


def traces(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Normalised traces to transcript lines: each step's text, then its calls, each with its result after it."""
    schema = "session string, steps array<struct<role:string,content:string,tools:array<struct<id:string,name:string,result:string>>>>"
    rows = _parsed(spark.read.text(paths), schema, LOG_LINE).select("j.session", F.posexplode("j.steps").alias("step", "s"))
    own = F.array(F.struct(F.lit(0).alias("k"), F.col("s.role").alias("role"), F.col("s.content").alias("content"), F.lit(None).cast("string").alias("tool_call_id")))
    tools = F.transform(F.coalesce("s.tools", F.array().cast("array<struct<id:string,name:string,result:string>>")), lambda x, i: F.struct((i + 1).alias("k"), F.lit("tool").alias("role"), x["result"].alias("content"), x["id"].alias("tool_call_id")))
    return rows.select("session", "step", F.inline(F.concat(own, tools)))


def sse(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Streams of `data:` lines, a file each, put together: the joined content, and whether [DONE] came."""
    rows = _lines(spark, paths).filter(F.col("value").startswith("data:")).withColumn("data", F.trim(F.substring("value", 6, 1 << 30)))
    part = F.coalesce(F.get_json_object("data", "$.choices[0].delta.content"), F.get_json_object("data", "$.content"), F.lit(""))
    parts = F.sort_array(F.collect_list(F.struct("line_no", part.alias("c"))))
    return rows.groupBy("file").agg(F.array_join(F.transform(parts, lambda x: x["c"]), "").alias("content"), F.bool_or(F.col("data") == "[DONE]").alias("done"))
