"""What a session's calls say about files: receipts of edits, the directory that is current, and roots to strip.

Roots meet paths by the paths' own leading directories, so a session's roots are joined, not gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.folds import scanned

#: Parts of a result that are looked at: three lines, and the rest as one.
PARTS = 4
#: Instead of that: all lines of a result.
EVERY = -1


def receipt_paths(result: Column, parts: int = PARTS) -> Column:
    """Paths that a result reports as edited or written, in order: `edited <path>` and `wrote <n> bytes to <path>`.

    A result is looked at in so many parts at most, by lines; with EVERY, each of its lines is.
    """
    line = lambda x: F.btrim(x, F.lit(" \t\r\n"))
    parts = F.transform(F.split(F.coalesce(result, F.lit("")), "\n", parts), line)
    edited = lambda x: F.when(F.startswith(x, F.lit("edited ")), line(F.substr(x, F.lit(8))))
    wrote = lambda x: F.when(F.startswith(x, F.lit("wrote ")) & F.contains(x, F.lit(" bytes to ")), line(F.substr(x, F.locate(" bytes to ", x) + 10)))
    return F.filter(F.transform(parts, lambda x: F.coalesce(edited(x), wrote(x))), lambda x: x.isNotNull())


def cd_target(command: Column) -> Column:
    """Where a command that starts with `cd ` goes, up to a blank, & or ;, without slashes at the end; null where nowhere."""
    text = F.btrim(command, F.lit(" \t\r\n"))
    to = F.rtrim(F.regexp_extract(text, r"^cd ([^ \t&;]*)", 1), F.lit("/"))
    return F.when(F.startswith(text, F.lit("cd ")) & (to != ""), to)


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def is_absolute(path: Column) -> Column:
    return path.rlike(r"^(/|[A-Za-z]:/)")


def normal_path(path: str) -> str:
    """The path without `.`, `..` (with what stands before it) and double slashes."""
    done: list[str] = []
    for part in path.split("/"):
        if part == ".." and done and done[-1] != "..":
            done.pop()
        elif part not in ("", ".") and not (part == ".." and path.startswith("/")):
            done.append(part)
    return "/" * path.startswith("/") + "/".join(done)


def _gone_to(now: str | None, target: str) -> str:
    absolute = target.startswith("/") or target[1:3] == ":/"
    return normal_path(target if absolute or now is None else f"{now}/{target}")


def _moved(now: str | None, target: str) -> str:
    """Where a cd leads. Steps that have led back to where a session without an absolute directory began count as none: "" isn't the root."""
    return _gone_to(now or None, target)


def current_directory(calls: DataFrame, session: str = "session", order: str = "seq", command: str = "command") -> DataFrame:
    """Adds cwd to calls: where the session's last cd before this call has led, null before the first.

    A relative target goes on from there; `..` and `.` are resolved, an empty cwd is where the session began. Calls that aren't a cd leave it as it is. An order has
    one call. Only the calls that are a cd are walked one by one.
    """
    moves = calls.select(session, order, slashed(cd_target(F.col(command))).alias("_to")).filter("_to is not null")
    led = scanned(moves, session, [order], "_to", _moved, "_dir string")
    before = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return calls.join(led, [session, order], "left").withColumn("cwd", F.last("_dir", ignorenulls=True).over(before)).select(*calls.columns, "cwd")


def resolved(path: Column, cwd: Column) -> Column:
    """A path as it is where it is absolute or nothing is current, else below the current directory."""
    path = slashed(path)
    below = F.udf(_gone_to, "string", useArrow=True)
    return F.when(is_absolute(path) | cwd.isNull(), path).when(path.rlike(r"(^|/)\.\.?(/|$)|//"), below(cwd, path)).otherwise(F.concat(F.rtrim(cwd, F.lit("/")), F.lit("/"), path))


def roots(calls: DataFrame, session: str = "session", command: str = "command") -> DataFrame:
    """(session, root): the directories that a session went to by cd, once each."""
    return calls.select(session, slashed(cd_target(F.col(command))).alias("root")).filter("root is not null").distinct()


def stripped(paths: DataFrame, given: DataFrame, session: str = "session", path: str = "path") -> DataFrame:
    """paths with `file`: the path below the session's longest root (session, root) that it lies under, or the path itself.

    Case counts, except in paths that start with a drive. Rows repeat as they do in paths; a null path has a null file.
    """
    rows = paths.withColumn("_id", F.monotonically_increasing_id()).withColumn("_path", slashed(F.col(path)))
    drive = lambda x: x.rlike("^[^/]:/")
    parts = F.split("_path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    at = rows.filter(F.contains("_path", F.lit("/"))).select(F.col("_id"), session, F.explode(ancestors).alias("_root"), drive(F.col("_path")).alias("_drive"))
    named = lambda x, folded: F.when(folded, F.lower(x)).otherwise(x)
    below = given.select(session, F.explode(F.array(F.struct(F.col("root").alias("_key"), F.lit(False).alias("_drive")), F.struct(F.lower("root").alias("_key"), F.lit(True).alias("_drive")))).alias("_r")).select(session, "_r.*").distinct()
    met = at.withColumn("_key", named(F.col("_root"), F.col("_drive"))).join(below, [session, "_key", "_drive"])
    best = met.groupBy("_id").agg(F.max(F.length("_root")).alias("_n"))
    return rows.join(best, "_id", "left").withColumn("file", F.when(F.col("_n").isNull(), F.col("_path")).otherwise(F.substr("_path", F.col("_n") + 2))).drop("_id", "_n", "_path")
