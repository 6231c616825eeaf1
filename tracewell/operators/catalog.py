"""Listings: keyset pages, filters, topic roll-ups, lineage, recovery, time windows."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.ranking import kept


def keyset_page(rows: DataFrame, order: list[tuple[str, bool]], after: tuple | None, size: int) -> DataFrame:
    """The page after a cursor: order is (column, descending) with a unique last column.

    One row over the size comes along, to tell whether there is a next page; the sort keeps that many rows a
    task, however many there are.
    """
    if after is not None:
        test = F.lit(False)
        for i, ((c, desc), v) in enumerate(zip(order, after, strict=True)):
            step = F.col(c) < F.lit(v) if desc else F.col(c) > F.lit(v)
            for (d, _), w in zip(order[:i], after[:i], strict=True):
                step = step & (F.col(d) == F.lit(w))
            test = test | step
        rows = rows.filter(test)
    return rows.orderBy(*[F.desc(c) if desc else F.asc(c) for c, desc in order]).limit(size + 1)


def cursor(values: tuple, revision: int) -> str:
    return base64.urlsafe_b64encode(json.dumps({"r": revision, "v": list(values)}).encode()).decode()


def read_cursor(text: str, revision: int) -> tuple:
    """A cursor's values; one of another revision is refused."""
    got = json.loads(base64.urlsafe_b64decode(text))
    if got["r"] != revision:
        raise ValueError("the listing has changed since this cursor was made")
    return tuple(got["v"])


def search(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows with the text in a column, in any case. % and _ are wild, as in the listings this stands in for."""
    test = F.lit(False)
    for c in columns:
        test = test | F.lower(F.col(c).cast("string")).like(f"%{text.lower()}%")
    return rows.filter(test)


def age_group(ts: Column, now: Column) -> Column:
    day = F.date_trunc("day", now)
    return F.when(ts >= day, "today").when(ts >= day - F.expr("interval 1 day"), "yesterday").otherwise("older")


def since(ts: Column, now: Column, window: str) -> Column:
    """Whether a time lies in a window that ends now: today, yesterday, day, week, month, or a span such as 90m, 36h or 2h30m."""
    import re

    day = F.date_trunc("day", now)
    if window == "today":
        return (ts >= day) & (ts <= now)
    if window == "yesterday":
        return (ts >= day - F.expr("interval 1 day")) & (ts < day)
    spans = {"day": "1 day", "week": "7 days", "month": "30 days"}
    units = {"h": "hours", "m": "minutes", "s": "seconds"}
    if window not in spans:
        parts = re.findall(r"(\d+)([hms])", window)
        if not parts or "".join(map("".join, parts)) != window:
            raise ValueError(f"not a window of time: {window}")
        spans = {window: " ".join(f"{n} {units[u]}" for n, u in parts)}
    return (ts >= now - F.expr(f"interval {spans[window]}")) & (ts <= now)


def topics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sessions by topic: counts, first and last activity, the latest title that isn't empty."""
    title = F.max_by(F.when(F.col("title") != "", F.col("title")), F.when(F.col("title") != "", F.struct("at", "id")))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if("open").alias("open_sessions"), F.sum("turns").alias("turns"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.coalesce(title, F.lit("")).alias("title")
    )


def roots(rows: DataFrame, most: int = 32) -> DataFrame:
    """(id, root, depth) of parent chains (id, parent), by pointer doubling: chains of 2^n links take n joins.

    A parent that isn't there ends its chain; rows of a cycle, or of a chain over 2^most links, get no root.
    """
    ids = rows.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    at = rows.join(ids, "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).alias("up")).withColumn("depth", F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long"))
    at = at.withColumn("root", F.coalesce("up", "id")).withColumn("over", F.col("up").isNull())
    for _ in range(most):
        if at.filter("not over").isEmpty():
            break
        jump = at.select(F.col("id").alias("root"), F.col("root").alias("_r"), F.col("depth").alias("_d"), F.col("over").alias("_o"))
        met = at.filter("not over").join(jump, "root", "left")
        moved = met.select("id", "up", (F.col("depth") + F.col("_d")).alias("depth"), F.col("_r").alias("root"), F.col("_o").alias("over"))
        at = kept(at.filter("over").unionByName(moved))
    return at.filter("over").select("id", "root", "depth")


def preferred(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The one row of each group that comes first in an order."""
    return rows.withColumn("_p", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter("_p = 1").drop("_p")


def covered(rows: DataFrame) -> DataFrame:
    """Adds state to leaves (group, id, messages): adopted if one's messages begin with those of all others of the
    group, covered_copy for the others then, else diverged. A group has the few leaves of one session."""
    best = rows.groupBy("group").agg(F.max_by("id", F.struct(F.size("messages"), -F.col("id"))).alias("best"), F.max_by("messages", F.struct(F.size("messages"), -F.col("id"))).alias("all"))
    met = rows.join(best, "group").withColumn("prefix", F.slice("all", F.lit(1), F.size("messages")) == F.col("messages"))
    whole = met.groupBy("group").agg(F.bool_and("prefix").alias("whole"))
    state = F.when(~F.col("whole"), "diverged").when(F.col("id") == F.col("best"), "adopted").otherwise("covered_copy")
    return met.join(whole, "group").select("group", "id", state.alias("state"))
