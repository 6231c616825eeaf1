"""All slices of transcripts: prompts, tool patterns, context cards and results with their status.

Lines are (session, order, role, text, calls), calls being an array of (name, command, paths).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators import cards as K
from tracewell.operators import consolidate as C
from tracewell.operators import sessions as S

#: Bytes of a prompt or result, calls of a pattern, and how often a value of a context card occurs, at least; values of a section.
MOST, CALLS, OFTEN, VALUES = 4000, 2, 2, 5
# Slice kinds with their numbers, a card's sections, and tools that run commands.
KINDS = {"prompt": 0, "tool_pattern": 1, "context": 2, "result": 3}
TITLES = ("Frequent paths:", "Frequent directories:", "Common command heads:")
SHELLS = ("bash", "shell", "exec_command", "run_command")


def _each_call(lines: DataFrame) -> DataFrame:
    return S.turns(lines, "session", "order").select("session", "turn_no", "order", F.posexplode("calls").alias("at", "call")).select("session", "turn_no", "order", "at", "call.*")


def prompts(lines: DataFrame) -> DataFrame:
    rows = S.prompts(lines.select("session", "order", "role", "text"), "session", "order")
    return rows.select("session", K.compacted(F.col("text"), MOST).alias("content")).filter("content <> ''")


def tool_patterns(lines: DataFrame) -> DataFrame:
    """The names of each turn's calls in order, of turns with CALLS calls or more."""
    named = _each_call(lines).filter("name <> ''").groupBy("session", "turn_no").agg(F.sort_array(F.collect_list(F.struct("order", "at", "name"))).alias("c"))
    return named.filter(F.size("c") >= CALLS).select("session", F.array_join(F.transform("c", lambda x: x["name"]), " ").alias("content"))


def contexts(lines: DataFrame) -> DataFrame:
    """A card of the paths, directories and command heads that a session's calls repeat."""
    calls = _each_call(lines)
    path = calls.select("session", F.explode("paths").alias("p")).select("session", K.clean_path(F.col("p")).alias("entry")).filter("entry is not null")
    folder = path.filter(F.contains("entry", F.lit("/"))).select("session", F.regexp_extract("entry", "^(.*)/[^/]*$", 1).alias("entry"))
    head = calls.filter(F.lower("name").isin(*SHELLS)).select("session", K.command_head(F.col("command")).alias("entry")).filter("entry <> ''")
    every = [rows.select("session", F.lit(title).alias("title"), "entry") for title, rows in zip(TITLES, (path, folder, head), strict=True)]
    counts = every[0].unionByName(every[1]).unionByName(every[2]).groupBy("session", "title", "entry").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OFTEN)
    return C.context_card(counts, ["session"], TITLES, VALUES)


def results(lines: DataFrame, verified: DataFrame | None = None) -> DataFrame:
    """Each session's last answer without calls, and its status: verified where `verified` (session, verified) says so, else probation."""
    last = S.results(lines.withColumn("has_calls", F.size(F.coalesce("calls", F.array().cast(lines.schema["calls"].dataType))) > 0), "session", "order")
    rows = last.select("session", K.compacted(F.col("text"), MOST).alias("content")).filter("content <> ''")
    if verified is None:
        return rows.withColumn("status", F.lit("probation"))
    return rows.join(verified, "session", "left").select("session", "content", F.when(F.coalesce("verified", F.lit(False)), "verified").otherwise("probation").alias("status"))


def found(lines: DataFrame, verified: DataFrame | None = None) -> DataFrame:
    """(session, kind, content, status) of every slice that sessions give, repeats included."""
    parts = {"prompt": prompts(lines), "tool_pattern": tool_patterns(lines), "context": contexts(lines), "result": results(lines, verified)}
    status = lambda rows: F.col("status") if "status" in rows.columns else F.lit("")
    rows = [part.select("session", F.lit(kind).alias("kind"), "content", status(part).alias("status")) for kind, part in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def extracted(lines: DataFrame, verified: DataFrame | None = None) -> DataFrame:
    """(id, kind, session, content, status): slices by their content, each once, of the first session that has it."""
    number = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("kind"))
    rows = found(lines, verified).withColumn("id", T.slice_id(number, F.lit(0), F.col("content")))
    return rows.groupBy("id").agg(F.min(F.struct("session", "kind", "content", "status")).alias("s")).select("id", "s.*")


def counted(lines: DataFrame, verified: DataFrame | None = None) -> DataFrame:
    """(session, prompts, tool_patterns, contexts, results): what each session gives, its repeated slices once."""
    rows = found(lines, verified).select("session", "kind", "content").distinct()
    return rows.groupBy("session").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in KINDS])
