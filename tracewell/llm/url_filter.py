"""URL filters by a cascade of Bloom filters.

The keys that the corpus can ask for are known: each url's host and parent domains, with each length of path
prefix that a rule has. Level 1 encodes the listed keys, level 2 the unlisted keys that level 1 lets through,
level 3 the listed ones that level 2 lets through, and so on until none is left, so that over those keys the
answers are exact and no url is joined with a list.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import guarded, hash2, stored, table


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


# The rules that the query applies.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits and hashes for each key of the first level, and of the others.
FIRST, LATER = (10, 7), (4, 3)
#: Keys of whose bits a shard's first two levels have as many: its cascade then has a few MB; more make more shards, one pass each.
SHARD_KEYS = 1 << 22
#: Unlisted keys of which the first level lets one through; the second level encodes those.
PASSES = 120
MOST_LEVELS = 60


class Level(NamedTuple):
    bits: np.ndarray
    size: int
    hashes: int


def _places(h1: np.ndarray, h2: np.ndarray, level: int, size: int, hashes: int) -> np.ndarray:
    """The bits of each key at a level, one row a hash; the driver and the executors alike."""
    with np.errstate(over="ignore"):
        step = (h2 ^ np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) | np.uint64(1)
        x = h1[None, :] + np.arange(1, hashes + 1, dtype=np.uint64)[:, None] * step[None, :]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (x ^ (x >> np.uint64(29))) % np.uint64(size)


def _passes(level: Level, number: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    at = _places(h1, h2, number, level.size, level.hashes)
    return ((level.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)


def member(levels: Sequence[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which keys of the universe are listed: those that first fail at an even level, or pass all of an odd number."""
    out, left = np.zeros(len(h1), bool), np.arange(len(h1))
    for k, level in enumerate(levels):
        ok = _passes(level, k, h1[left], h2[left])
        if k % 2:
            out[left[~ok]] = True
        left = left[ok]
    out[left] = len(levels) % 2 == 1
    return out


def _words(keys: DataFrame, number: int, size: int, hashes: int) -> np.ndarray:
    """The bit array of a level. Tasks merge their own bits, then words meet by place; size/64 of them at most return."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(*(c.to_numpy().view(np.uint64) for c in batch.columns), number, size, hashes).ravel()
            word, back = np.unique(at >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, back, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    rows = keys.select("h1", "h2").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(-(-size // 64), np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _through(keys: DataFrame, level: Level, number: int) -> DataFrame:
    held = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = _passes(held.value, number, *(batch.column(i).to_numpy().view(np.uint64) for i in (0, 1)))
            yield batch.filter(pa.array(ok))

    return keys.select("h1", "h2").mapInArrow(run, "h1 long, h2 long")


def cascade(listed: DataFrame, others: DataFrame) -> list[Level]:
    """The levels over two disjoint tables of keys (h1, h2); empty where nothing is listed.

    Each level's table is written to the shared folder, and each is a fraction of the one before last.
    """
    levels: list[Level] = []
    into, against = stored(listed.select("h1", "h2")), stored(others.select("h1", "h2"))
    while n := into.count():
        if len(levels) == MOST_LEVELS:
            raise ValueError("two keys, one of them listed, have one hash")
        per, hashes = LATER if levels else FIRST
        size = max(64, n * per)
        level = Level(_words(into, len(levels), size, hashes), size, hashes)
        into, against = stored(_through(against, level, len(levels))), into
        levels.append(level)
    return levels


def shards_of(listed: int, others: int) -> int:
    """Shards of which each has SHARD_KEYS listed keys or fewer, counting the bits of the false positives that its second level encodes."""
    bits = FIRST[0] * listed + LATER[0] * -(-others // PASSES)
    return max(1, -(-bits // (FIRST[0] * SHARD_KEYS)))


def cascades(universe: DataFrame, listed: DataFrame) -> tuple[int, Iterator[list[Level]]]:
    """How many shards of keys there are by hash, and each one's cascade, built when it is asked for. universe and listed have keys (h1, h2), repeats and all."""
    rows = universe.select("h1", "h2", F.lit(False).alias("l")).distinct().unionByName(listed.select("h1", "h2", F.lit(True).alias("l")))
    marked = rows.groupBy("h1", "h2").agg(F.bool_or("l").alias("l"), F.bool_or(~F.col("l")).alias("asked")).filter("asked")
    marked = stored(marked.select("h1", "h2", "l"))
    n = marked.agg(F.count_if("l").alias("listed"), F.count_if(~F.col("l")).alias("others")).first()
    shards = shards_of(n["listed"], n["others"])
    parts = (marked.filter(F.pmod(F.col("h1"), F.lit(shards)) == s) for s in range(shards))
    return shards, (cascade(part.filter("l"), part.filter("not l")) for part in parts)


def answered(rows: DataFrame, keys: str, shards: int, built: Iterator[list[Level]]) -> DataFrame:
    """Adds `_in`, an array of booleans beside the array column keys of (h1, h2): which keys are listed.

    Shards are built, asked and let go one after the other, so the driver and each executor hold one's levels.
    """
    out = rows.withColumn("_in", F.transform(keys, lambda x: F.lit(False)))
    for s, levels in enumerate(built):
        held = rows.sparkSession.sparkContext.broadcast(levels)
        at = out.columns.index(keys)

        def run(batches: Iterator[pa.RecordBatch], s: int = s, held: object = held, at: int = at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                asked, before = batch.column(at), batch.column(batch.num_columns - 1)
                flat = asked.flatten()
                h1, h2 = (flat.field(k).to_numpy().view(np.uint64) for k in (0, 1))
                mine = np.flatnonzero(h1.view(np.int64) % shards == s)
                hit = before.flatten().to_numpy(zero_copy_only=False).copy()
                hit[mine] |= member(held.value, h1[mine], h2[mine])
                counts = np.concatenate(([0], np.cumsum(np.asarray(asked.value_lengths().fill_null(0))))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(counts), pa.array(hit))], names=batch.schema.names)

        out = out.mapInArrow(run, out.schema)
        if shards > 1:
            out = stored(out)
            held.destroy()
    return out


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty for null or without ://."""
    text = F.coalesce(url, F.lit(""))
    pattern = "://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def _labels(host: str) -> int:
    return host.count(".") + 1


@guarded
def url_filter(pages: DataFrame, rules: Sequence[Rule] = RULES, blocked: DataFrame | None = None, url: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict to each row of pages; columns of those names are replaced.

    A rule fits its host and all subdomains where the path starts with the rule's. The longest rule (host and
    path together, then host) gives rule and verdict. Else rule is null, and the verdict is block where
    blocked, a table of hosts in a column `host`, has the url's host or a parent of it, and allow otherwise.
    Null and malformed urls have empty host and path and are allowed. An empty table gives an empty table.
    """
    spark = pages.sparkSession
    blocked = spark.createDataFrame([], "host string") if blocked is None else blocked
    depths = sorted(r[0] for r in blocked.filter(F.col("host").isNotNull()).select(F.size(F.split("host", r"\."))).distinct().collect())
    host, path = parts(F.col(url))
    rows = pages.withColumn("host", host).withColumn("path", path)
    label = F.split("host", r"\.", -1)
    parent = lambda n: F.when(F.size(label) >= n, F.array_join(F.slice(label, F.size(label) - n + 1, n), "."))
    start = lambda n: F.when(F.length("path") >= n, F.substring("path", 1, n))
    shapes = sorted({(_labels(r.host), len(r.path)) for r in rules}, key=lambda x: (-x[0], -x[1]))

    def key(kind: str, text: Column) -> Column:
        h1, h2 = hash2(F.lit(kind), text)
        return F.struct(h1.alias("h1"), h2.alias("h2"), F.lit(kind).alias("kind"), text.alias("text"))

    # A null text (a host or path too short) drops out: its key is null.
    asked = [F.when(t.isNotNull(), key(v, t)) for n, m in shapes for t in [F.concat(parent(n), start(m))] for v in ("allow", "block")]
    asked += [F.when(t.isNotNull(), key("host", t)) for t in map(parent, depths)]
    rows = rows.withColumn("_keys", F.array_compact(F.array(*asked)) if asked else F.array().cast("array<struct<h1:bigint,h2:bigint,kind:string,text:string>>"))
    text = [(r.verdict, r.host + r.path) for r in rules]
    listed = spark.createDataFrame(text, "kind string, text string").unionByName(blocked.select(F.lit("host").alias("kind"), F.translate("host", UPPER, LOWER).alias("text")))
    h1, h2 = hash2(F.col("kind"), F.col("text"))
    built = cascades(rows.select(F.explode("_keys").alias("k")).select("k.h1", "k.h2"), listed.select(h1.alias("h1"), h2.alias("h2")))
    rows = answered(rows, "_keys", *built)
    hits = F.transform(F.filter(F.arrays_zip(F.col("_keys").alias("k"), F.col("_in").alias("i")), lambda x: x["i"]), lambda x: x["k"])
    rows = rows.withColumn("_hits", hits)
    rank = F.transform(F.filter("_hits", lambda x: x["kind"] != "host"), lambda x: F.struct(F.length(x["text"]).alias("n"), F.instr(x["text"], "/").alias("m"), x["text"].alias("text"), x["kind"].alias("kind")))
    best = F.array_max(rank)
    method = F.when(F.exists("_hits", lambda x: x["kind"] == "host"), "block").otherwise("allow")
    given = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return rows.select(*given, "host", "path", best["text"].alias("rule"), F.coalesce(best["kind"], method).alias("verdict"))


def tracking_hosts(pages: DataFrame, url: str = "url") -> DataFrame:
    """The hosts of which half of the pages or more are asked with a query: the list that the query below blocks."""
    rows = pages.select(parts(F.col(url))[0].alias("host"), F.contains(F.col(url), F.lit("?")).alias("q")).filter("host <> ''")
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("m")).filter("2 * m >= n").select("host")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages, RULES, stored(tracking_hosts(pages))).drop("url")


SQL = rf"""
with p as (select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') host, regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) path from pages),
r(verdict, rh, rp) as (values {", ".join(str(tuple(r)) for r in RULES)}),
b as (select host bh from (select regexp_matches(url, '[?]') q, host from p join pages using (page_id)) where host <> '' group by host having 2 * count(*) filter (q) >= count(*)),
f as (select page_id, host, path, arg_max(rh || rp, length(rh || rp)) rule, arg_max(verdict, length(rh || rp)) v
        from p left join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by all)
select page_id, host, path, rule, coalesce(v, case when list_has_any(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')), (select list(bh) from b)) then 'block' else 'allow' end) verdict from f
"""
