"""Spelling variants: words that one inserted, deleted or replaced character turns into each other.

The words form a trie. At each node that branches, the child with the most words below it is heavy, the others are
light (a word that ends at the node counts as light too). Light subtrees are merged with one error, small to large:

* with their first character replaced, into each other (terminals that coincide have one key) and into the heavy subtree;
* with their first character skipped, into the node's own subtree;
* into the heavy subtree with its first character skipped.

Where terminals coincide two words are one edit apart, and each such pair coincides at one place only: the node where the
two part. A heavy subtree is never copied, so a word goes along as often as it leaves heavy paths, which is at most
the logarithm of the number of words, instead of once for each of its characters.

Subtrees are tables here: a node is a prefix, a copied terminal a row that says which word it would be.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import split_join, stored, table

#: Code points that a word has, and occurrences, at least.
LENGTH, OFTEN = 5, 3
#: One run in so many loses a character, chosen by its hash.
TYPOS = 97
#: A form occurs so many times as often as its word, at least.
TIMES = 2
#: Words that a task counts together, and bytes of a text that it looks at together.
_HELD, _BYTES = 200_000, 1 << 20
# Letters: A-Z, a-z and U+00C0 to U+00FF, as UTF-8 of lower-cased text.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def _parts(text: bytes) -> Iterator[bytes]:
    """The text in parts that end before a blank."""
    at = 0
    while len(text) - at > _BYTES:
        end = text.find(b" ", at + _BYTES)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def _without(run: bytes, at: int) -> bytes:
    text = run.decode()
    return (text[:at] + text[at + 1 :]).encode()


def _counted(least: int, typos: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array(list(held), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        crc = zlib.crc32
        for batch in batches:
            for key, text in zip(*batch.columns, strict=True):
                first = crc(b"%s:" % (key.as_py() or "").encode())
                for part in _parts((text.as_py() or b"").lower()):
                    for w, n in Counter(_RUN.findall(part)).items():
                        if len(w) >= least:
                            h = crc(w, first)
                            if h % typos == 0:
                                w = _without(w, h % len(w.decode()))
                            held[w] += n
                if len(held) > _HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return run


def words(docs: DataFrame, text: str = "text", length: int = LENGTH, often: int = OFTEN, typos: int = TYPOS) -> DataFrame:
    """(word, n): letter runs of the texts, A-Z lowered, with typos, that have `length` code points and `often` occurrences or more.

    Where `typos` divides crc32 of "<doc_id>:<run>", the run loses the code point at crc32 % its length. A null text has
    no runs; a null id counts as an empty one. Rows stand for themselves, however often they repeat.
    """
    narrow = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    found = narrow.mapInArrow(_counted(length, typos), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.filter((F.col("n") >= often) & (F.length("word") >= length))


def _leaving(rows: DataFrame) -> DataFrame:
    """word, n, p, c, h, s for each node p at which a word leaves a heavy path: its own character c ('' at its end), the heavy one h, and what follows c."""
    at = F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i")
    steps = rows.select("word", "n", at).select("word", "n", "i", F.expr("substring(word, 1, i)").alias("p"))
    edge = F.expr("substring(word, i + 1, 1)").alias("c")
    edges = steps.groupBy("p", edge).agg(F.count(F.lit(1)).alias("weight"))
    nodes = edges.groupBy("p").agg(
        F.max(F.struct(F.col("c") != "", "weight", "c")).alias("heavy"), F.count(F.lit(1)).alias("branches"), F.sum("weight").alias("below")
    )
    nodes = stored(nodes.filter("branches > 1").select("p", F.col("heavy.c").alias("h"), "below"))
    met = split_join(steps, nodes, ["p"], "below", rows.count())
    return met.select("word", "n", "p", edge, "h", F.expr("substring(word, i + 2)").alias("s")).filter("c <> h")



def near(rows: DataFrame) -> DataFrame:
    """(word, n_near, best) of the words of rows (word, n; no word twice) that have a near word; best is its near word of largest n, then least in order, as (less = -n, word)."""
    light = stored(_leaving(rows))
    # The characters replaced tell the members of such a group apart, so it is no larger than the alphabet.
    groups = light.filter("c <> ''").groupBy("p", "s").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "word"))).alias("all")).filter("size(all) > 1")
    member = groups.select("all", F.posexplode("all").alias("at", "one"))
    among = member.select(F.col("one.word").alias("word"), (F.size("all") - 1).cast("long").alias("k"), F.when(F.col("at") == 0, F.col("all")[1]).otherwise(F.col("all")[0]).alias("best"))
    some = F.col("c") != ""
    asked = F.array(
        F.when(some, F.concat("p", "h", "s")),
        F.when(some & ~F.startswith(F.col("s"), F.col("c")), F.concat("p", "s")),
        F.concat("p", "h", "c", "s"),
    )
    asked = light.select("word", "n", F.explode(asked).alias("other")).filter("other is not null")
    pairs = asked.join(rows.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    side = lambda w, n, v: F.struct(F.col(w).alias("word"), F.lit(1).cast("long").alias("k"), F.struct((-F.col(n)).alias("less"), F.col(v).alias("word")).alias("best"))
    both = pairs.select(F.inline(F.array(side("word", "m", "other"), side("other", "n", "word"))))
    return among.unionByName(both).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def variants(rows: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of each row (word, n).

    A word's form is its near word of largest n (ties: the least by code points), if that occurs `times` (2 or more)
    times as often; else null, with a null form_n. root is the end of the chain of forms. Repeated words count
    together; null words and null counts leave no row; the empty word is near all words of one character. No words give
    no rows. Other columns aren't read. n grows along a chain, so its length is at most the logarithm of the largest
    n, and the rounds that shorten it the logarithm of that.
    """
    rows = stored(rows.filter("word is not null and n is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    met = rows.join(near(rows), "word", "left")
    fits = -F.col("best.less") >= times * F.col("n")
    out = stored(met.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best.word")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")))
    chains = stored(out.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(chains.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        chains = longer.drop("moved")
        if longer.filter("moved").isEmpty():
            break
    return out.join(chains, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(words(table(spark, sf_dir, "documents")))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = rf"""
with recursive t as (select list_transform(range(256), lambda x: list_reduce([x::bigint] || list_transform(range(8), lambda i: 0::bigint),
    lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) tab),
o as (select coalesce(doc_id::varchar, '') d, unnest(regexp_extract_all({_LOWER.format("text")}, '[a-z\x{{C0}}-\x{{FF}}]+')) run from documents where text is not null),
r as (select d, run, count(*) k, hex(encode(d || ':' || run)) x from o where length(run) >= {LENGTH} group by all),
h as (select run, k, xor(list_reduce([4294967295::bigint] || list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i::int + 1, 2))::bigint),
    lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295) crc from r, t),
w as (select word, sum(k)::bigint n from (select k, case when crc % {TYPOS} = 0 then left(run, (crc % length(run))::int) || substr(run, (crc % length(run))::int + 2) else run end word from h)
      where length(word) >= {LENGTH} group by 1 having sum(k) >= {OFTEN}),
v as (select word, n, i, left(word, i::int) || substr(word, i::int + 2) part from (select word, n, unnest(range(length(word))) i from w)),
pairs as (select a.word, b.word near, b.n m from v a join v b on a.part = b.part and a.i = b.i and a.word <> b.word
    union select v.word, w.word, w.n from v join w on w.word = v.part union select w.word, v.word, v.n from v join w on w.word = v.part),
best as (select word, count(*) n_near, first(near order by m desc, near) near, max(m) m from pairs group by 1),
f as (select w.word, n, coalesce(n_near, 0)::bigint n_near, case when m >= {TIMES} * n then near end form, case when m >= {TIMES} * n then m end::bigint form_n from w left join best using (word)),
c(word, last) as (select word, word from f union all select c.word, f.form from c join f on f.word = c.last where f.form is not null),
e as (select c.word, c.last root from c join f on f.word = c.last where f.form is null)
select word, form, root, n, n_near, form_n from f join e using (word)
"""
