"""Transcripts to turns and slices: numbering, pairing, prompts, patterns, stages, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import text as T


def _upto(session: str, order: list) -> Window:
    return Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def turns(lines: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """Adds turn_no: how many user lines a session has had so far."""
    return lines.withColumn("turn_no", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(_upto(session, [order])).cast("long"))


def prompts(lines: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """The first user line of each turn, blank ones left out."""
    numbered = turns(lines, session, order).filter((F.col("role") == "user") & (F.trim("text") != ""))
    first = F.row_number().over(Window.partitionBy(session, "turn_no").orderBy(order))
    return numbered.withColumn("_f", first).filter("_f = 1").drop("_f")


def results(lines: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """Each session's last assistant line without tool calls (column has_calls, where there is one)."""
    own = F.col("role") == "assistant"
    if "has_calls" in lines.columns:
        own = own & ~F.coalesce("has_calls", F.lit(False))
    return lines.filter(own).groupBy(session).agg(F.max_by("text", order).alias("text"), F.max(order).alias("at"))


def last_user_text(lines: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    spoken = lines.filter((F.col("role") == "user") & (T.normalized(F.col("text")) != ""))
    return spoken.groupBy(session).agg(T.normalized(F.max_by("text", order)).alias("text"))


def calls(events: DataFrame) -> DataFrame:
    """Tool calls (session, tool, seq) from an event stream in order of (ts, event_id)."""
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select(F.col("user_id").alias("session"), F.col("event_type").alias("tool"), seq.alias("seq"), "ts", "event_id", "value")


def segments(tool_calls: DataFrame, boundary: Column, least: int = 2) -> DataFrame:
    """(session, segment, n, pattern): runs of tools, each ending with a boundary; shorter ones are left out.

    A segment's number is a running sum of the boundaries before a call, so a session's calls need one sort.
    """
    before = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    cut = tool_calls.withColumn("segment", F.coalesce(F.sum(boundary.cast("int")).over(before), F.lit(0)))
    out = cut.groupBy("session", "segment").agg(F.count(F.lit(1)).alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("seq", "tool"))), lambda x: x["tool"]).alias("tools"))
    return out.filter(F.col("n") >= least).select("session", "segment", "n", F.array_join("tools", " ").alias("pattern"))


def stages(tool_calls: DataFrame, most: int = 24) -> DataFrame:
    """(session, skeleton): equal neighbours fold into one stage with its count; the first `most` stages."""
    w = Window.partitionBy("session").orderBy("seq")
    island = tool_calls.withColumn("_g", F.col("seq") - F.row_number().over(Window.partitionBy("session", "tool").orderBy("seq")))
    runs = island.groupBy("session", "tool", "_g").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n"))
    kept = runs.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most)
    name = F.when(F.col("n") > 1, F.concat("tool", F.lit("(×"), F.col("n").cast("string"), F.lit(")"))).otherwise(F.col("tool"))
    ordered = F.sort_array(F.collect_list(F.struct("seq", name.alias("name"))))
    return kept.groupBy("session").agg(F.array_join(F.transform(ordered, lambda x: x["name"]), " → ").alias("skeleton"), F.count(F.lit(1)).alias("n_stages"))


def pair_results(tool_calls: DataFrame, found: DataFrame) -> DataFrame:
    """Calls with the first result of their id; of repeated calls the last with the longest arguments counts."""
    call = tool_calls.withColumn("_k", F.row_number().over(Window.partitionBy("session", "call_id").orderBy(F.desc(F.length("args")), F.desc("seq")))).filter("_k = 1").drop("_k")
    first = found.withColumn("_k", F.row_number().over(Window.partitionBy("session", "call_id").orderBy("seq"))).filter("_k = 1").select("session", "call_id", F.col("content").alias("result"))
    return call.join(first, ["session", "call_id"], "left")


def latest_verified(events: DataFrame, mutation: Column, check: Column, passed: Column, pending: Column | None = None) -> DataFrame:
    """(session, verified): whether the latest check passed, came after the latest change, and no call after it still waits.

    pending tells a call without a result: it may change anything, so a check before it says nothing.
    """
    waits = F.lit(False) if pending is None else pending
    return events.groupBy("session").agg(
        F.max(F.when(mutation | waits, F.col("seq"))).alias("changed"), F.max(F.when(check & ~waits, F.col("seq"))).alias("checked"), F.max_by(F.when(check & ~waits, passed), F.when(check & ~waits, F.col("seq"))).alias("passed")
    ).select("session", (F.coalesce("passed", F.lit(False)) & (F.coalesce("checked", F.lit(0)) > F.coalesce("changed", F.lit(0)))).alias("verified"))


def around(lines: DataFrame, marks: DataFrame, before: int, after: int, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """Lines within a window of places around each marked line; the window is clamped to 3 to 10 each way."""
    b, a = (min(10, max(3, n)) for n in (before, after))
    m = marks.select(session, F.col(order).alias("mark"))
    return lines.join(m, session).filter(F.col(order).between(F.col("mark") - b, F.col("mark") + a))


def frequent(values: DataFrame, by: str, value: str, least: int = 2, most: int = 5) -> DataFrame:
    """The values a group has at least `least` times, the `most` most frequent, ties by value."""
    n = values.groupBy(by, value).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), value))).filter(F.col("rank") <= most)


def slices(lines: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """(id, kind, session, content): prompts and results of sessions, one row an id."""
    p = prompts(lines, session, order).select(F.lit("prompt").alias("kind"), F.lit(0).alias("_t"), F.col(session).alias("session"), F.col("text").alias("content"))
    r = results(lines, session, order).select(F.lit("result").alias("kind"), F.lit(3).alias("_t"), F.col(session).alias("session"), F.col("text").alias("content"))
    rows = p.unionByName(r).withColumn("id", T.slice_id(F.col("_t"), F.lit(0), F.col("content")))
    return rows.groupBy("id").agg(F.first("kind").alias("kind"), F.min("session").alias("session"), F.first("content").alias("content"))


def history_documents(lines: DataFrame, wrong: Column, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """(id, session, order, kind, text): what a session's history is searched by: a document a line; a tool line that
    looks like an error is two, tool_error and tool_output. Ids are of the session, place and kind."""
    kinds = F.when(wrong, F.array(F.lit("tool_error"), F.lit("tool_output"))).otherwise(F.array("role"))
    rows = lines.select(F.col(session).alias("session"), F.col(order).alias("order"), F.explode(kinds).alias("kind"), "text")
    return rows.withColumn("id", F.concat_ws(":", F.col("session").cast("string"), F.col("order").cast("string"), "kind"))


def history_filter(docs: DataFrame, kinds: tuple[str, ...] = (), tool: str = "", roots: tuple[str, ...] = (), scope: str = "") -> DataFrame:
    """History documents of some kinds, one tool, some roots and one scope; what isn't given asks for nothing."""
    for column, wanted in (("kind", kinds), ("tool", (tool,) if tool else ()), ("root", roots), ("scope", (scope,) if scope else ())):
        docs = docs.filter(F.col(column).isin(*wanted)) if wanted else docs
    return docs


def pipeline_counts(lines: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """(session, prompts, results): what ingesting a transcript stores of each session."""
    p = prompts(lines, session, order).groupBy(session).agg(F.count(F.lit(1)).alias("prompts"))
    r = results(lines, session, order).select(session, F.lit(1).cast("long").alias("results"))
    return p.join(r, session, "full_outer").select(session, F.coalesce("prompts", F.lit(0)).alias("prompts"), F.coalesce("results", F.lit(0)).alias("results"))


def kernel_events(lines: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """(session, turn_no, order, kind): user lines start turns, assistant lines dispatch, other lines are results."""
    kind = F.when(F.col("role") == "user", "turn_started").when(F.col("role") == "assistant", "tool_dispatch").when(F.col("role") == "tool", "tool_result").otherwise("note")
    return turns(lines, session, order).select(session, "turn_no", order, kind.alias("kind"))


def passthrough(events: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Events of some kinds again as user lines: kind and data."""
    return events.filter(F.col("kind").isin(*kinds)).withColumn("role", F.lit("user")).withColumn("text", F.concat("kind", F.lit(": "), "data"))


def lines_of_stream(events: DataFrame) -> DataFrame:
    """Transcript lines of a stream (session, seq, message_id, partial, role, text, call_id): the last full form of a
    message counts, calls without a result get a placeholder after them."""
    full = events.filter(~F.col("partial"))
    last = full.groupBy("session", "message_id").agg(F.max_by(F.struct("seq", "role", "text", "call_id"), "seq").alias("m")).select("session", "message_id", "m.*")
    done = last.filter("role = 'tool'").select("session", "call_id").distinct()
    lost = last.filter("role = 'assistant' and call_id is not null").join(done, ["session", "call_id"], "left_anti")
    mark = lost.select("session", "message_id", "seq", F.lit("tool").alias("role"), F.lit("[no result]").alias("text"), "call_id")
    return last.select("session", "message_id", "seq", "role", "text", "call_id").unionByName(mark)


def outcome_card(calls: DataFrame) -> DataFrame:
    """(session, files, checked): up to ten edited files in order of first edit, and whether a check passed.

    calls has session, seq, stage, path and ok.
    """
    edits = calls.filter("stage = 'edit'").groupBy("session", "path").agg(F.min("seq").alias("seq"))
    ten = edits.withColumn("_r", F.row_number().over(Window.partitionBy("session").orderBy("seq"))).filter("_r <= 10")
    files = ten.groupBy("session").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "path"))), lambda x: x["path"]), ", ").alias("files"))
    checked = calls.groupBy("session").agg(F.coalesce(F.bool_or((F.col("stage") == "verify") & F.col("ok")), F.lit(False)).alias("checked"))
    return checked.join(files, "session", "left").select("session", F.coalesce("files", F.lit("")).alias("files"), "checked")


def command_card(calls: DataFrame, most: int = 8) -> DataFrame:
    """(session, rank, command, outcome): a session's commands in order of first use with their latest outcome."""
    c = calls.groupBy("session", "command").agg(F.min("seq").alias("first"), F.max_by("outcome", "seq").alias("outcome"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("session").orderBy("first"))).filter(F.col("rank") <= most).drop("first")
