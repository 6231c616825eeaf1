"""Context cards that say much the same, merged: sections united, counts summed, the most frequent entries kept.

A card is text: a line that ends with a colon opens a section, lines `- entry (count)` are its entries. All steps are
joins and aggregates: a cluster of any size is summed up before its largest entries are chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.cards import led
from tracewell.operators.ranking import kept, small

#: Likeness of two cards' entries from which they are merged, and entries of a section.
ALIKE, ENTRIES = 0.6, 8
# How a card starts and what ends an entry.
HEAD = "Project context"
TITLE = "Project context observed from repeated tool calls:"


def _lines(card: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(card, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: (x != "") & ~F.startswith(x, F.lit(HEAD)))


def _cut(line: Column) -> tuple[Column, Column]:
    """An entry without the bracket at its end, and what is in that bracket; null where there is none."""
    at = F.length(line) - F.locate("( ", F.reverse(line)) - 1  # characters before the last " ("
    has = (F.locate("( ", F.reverse(line)) > 0) & F.endswith(line, F.lit(")")) & (at > 0)
    return F.when(has, F.substr(line, F.lit(1), at)).otherwise(line), F.when(has, F.substr(line, at + 3, F.length(line) - at - 3))


def card_tokens(card: Column) -> Column:
    """The distinct lower-case words of a card's entries, without sections' titles and counts."""
    entries = F.filter(_lines(card), lambda x: ~F.endswith(x, F.lit(":")))
    bare = F.transform(entries, lambda x: _cut(F.regexp_replace(x, "^- ", ""))[0])
    return F.array_distinct(F.filter(F.flatten(F.transform(bare, lambda x: F.split(F.lower(x), r"\s+"))), lambda w: w != ""))


def sections(cards: DataFrame, id_: str = "id", card: str = "content", more: tuple[str, ...] = ()) -> DataFrame:
    """(id, more, line, title, entry, n): a card's entries in order with their section and count, 1 where none is told. No row is shuffled."""
    titled = lambda x: F.endswith(x, F.lit(":")) & ~F.startswith(x, F.lit("- "))
    rows = cards.select(F.col(id_).alias("id"), *more, F.explode(F.array(_lines(F.col(card)))).alias("_lines"))
    titles = F.filter(F.transform("_lines", lambda x, i: F.struct(i.alias("first"), x.alias("title"))), lambda t: titled(t["title"]))
    rows = rows.withColumn("_titles", titles).select("id", *more, "_titles", F.posexplode("_lines").alias("line", "text"))
    rows = rows.withColumn("_t", F.try_element_at(F.filter("_titles", lambda t: t["first"] <= F.col("line")), F.lit(-1))).filter("_t is not null")
    rows = rows.select("id", *more, "line", "text", F.col("_t.title").alias("title"), F.col("_t.first").alias("first"))
    body = F.substr("text", F.lit(3))
    bare, told = _cut(body)
    number = F.regexp_extract(F.coalesce(told, F.lit("")), r"^[+]?([0-9]{1,18})", 1)
    n = F.when(number != "", number.cast("long"))
    counted = n.isNotNull() & (n > 0)
    entry = F.startswith("text", F.lit("- "))
    return rows.select("id", *more, "line", "title", "first", F.when(entry, F.when(counted, bare).otherwise(body)).alias("entry"), F.when(entry, F.when(counted, n).otherwise(F.lit(1).cast("long"))).alias("n"))


def merge_groups(cards: DataFrame, same: list[str], id_: str = "id", card: str = "content", threshold: float = ALIKE) -> DataFrame:
    """(id, rep) as a walk by id gives them: a card joins the first earlier representative with equal columns `same` and a like set of words, or is one.

    Cards without words join none. Cards of one set of words and equal columns stand for each other, so copies aren't paired.
    """
    key = F.xxhash64(*[x for c in same for x in (F.col(c).isNull(), F.col(c))]) if same else F.lit(0).cast("long")
    # Words are named together with the columns that have to be equal, so unlike cards share none.
    words = F.sort_array(F.array_distinct(F.transform(card_tokens(F.col(card)), lambda w: F.xxhash64(key, w))))
    sets = lambda rows: rows.select(F.col(id_).alias("id"), F.explode(F.array(words)).alias("words")).filter(F.size("words") > 0)
    named = kept(sets(cards).select("id", F.xxhash64("words").alias("set_id"), F.xxhash64(F.lit(7), F.col("words")).alias("set_id2")))
    least = kept(named.groupBy("set_id", "set_id2").agg(F.min("id").alias("representative")))
    members = named.join(least, ["set_id", "set_id2"]).select("id", "representative")
    reps = led(sets(cards.join(small(least.select(F.col("representative").alias(id_))), id_, "left_semi")), threshold)
    return kept(members.join(small(kept(reps)).withColumnRenamed("id", "representative"), "representative").select("id", "rep"))


def merged_cards(cards: DataFrame, groups: DataFrame, id_: str = "id", card: str = "content") -> DataFrame:
    """(rep, n, content, content_sha256): the united card of each group (id, rep) of two or more.

    Sections come in the order in which the group's cards, by id, first have them; their entries by count, then value,
    ENTRIES at most. A group whose cards have no section gives no row. Ids are whole numbers, one a card.
    """
    sizes = groups.groupBy("rep").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = cards.select(F.col(id_).alias("id"), F.col(card).alias("content")).join(groups.join(small(kept(sizes)), "rep"), "id")
    rows = sections(met, more=("rep", "members"))
    order = rows.groupBy("rep", "members", "title").agg(F.min(F.struct("id", "first")).alias("at"))
    sums = rows.filter("entry is not null").groupBy("rep", "title", "entry").agg(F.sum("n").alias("n"))
    best = sums.withColumn("place", F.row_number().over(Window.partitionBy("rep", "title").orderBy(F.desc("n"), "entry"))).filter(F.col("place") <= ENTRIES)
    line = F.concat(F.lit("- "), "entry", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    texts = best.groupBy("rep", "title").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))  # ENTRIES at most
    full = order.join(texts, ["rep", "title"], "left").select("rep", "members", F.struct("at", F.concat_ws("\n", "title", "lines").alias("text")).alias("part"))
    whole = full.groupBy("rep", "members").agg(F.sort_array(F.collect_list("part")).alias("parts"))  # a row a title
    content = F.concat_ws("\n", F.lit(TITLE), F.transform("parts", lambda p: p["text"]))
    return whole.select("rep", F.col("members").alias("n"), content.alias("content")).withColumn("content_sha256", F.sha2("content", 256))


def merged_facts(cards: DataFrame, groups: DataFrame, sums: list[str], latest: str, source: str, id_: str = "id") -> DataFrame:
    """(rep, the sums, latest, n_sources) of each group of two or more: counts added up, the latest time, distinct sources that aren't empty."""
    met = cards.select(F.col(id_).alias("id"), *sums, latest, source).join(groups, "id")
    out = met.groupBy("rep").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(c) for c in sums], F.max(latest).alias(latest), F.countDistinct(F.when(F.col(source) != "", F.col(source))).alias("n_sources"))
    return out.filter("_n > 1").drop("_n")


def _order(title: Column, titles: tuple[str, ...]) -> Column:
    at = F.array_position(F.array(*map(F.lit, titles)), title) if titles else F.lit(0)
    return F.when(at > 0, at).otherwise(F.lit(len(titles) + 1))


def context_card(counts: DataFrame, by: list[str], titles: tuple[str, ...] = (), most: int = ENTRIES) -> DataFrame:
    """(by, content): cards of counts (by, title, entry, n), sections in the order of titles, then by name; entries by count, then value, `most` at most."""
    place = F.row_number().over(Window.partitionBy(*by, "title").orderBy(F.desc("n"), "entry"))
    line = F.concat(F.lit("- "), "entry", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    best = counts.withColumn("_p", place).filter(F.col("_p") <= most).groupBy(*by, "title").agg(F.sort_array(F.collect_list(F.struct("_p", line.alias("line")))).alias("_l"))
    part = F.concat_ws("\n", "title", F.transform("_l", lambda x: x["line"]))
    return best.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(_order(F.col("title"), titles).alias("order"), "title", part.alias("part")))).alias("_s")).select(*by, F.concat_ws("\n", F.lit(TITLE), F.transform("_s", lambda x: x["part"])).alias("content"))
