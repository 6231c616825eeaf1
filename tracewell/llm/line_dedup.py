"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

Two lines are near when their words are at most one word edit apart (one word changed, added or left out).
The bound is relative: one edit for NEAR_WORDS words, so lines with fewer are matched word for word. Each line
emits its variants within the bound as hashed keys, equal variants meet, the edit is verified on the words,
and the earliest line stays.

* Changed word: the key of place i is the XOR of all place-salted word hashes but the i-th, so a key's
  lines are mutually one change apart. Each needs only the key's earliest line: least, greatest and count of
  a key say all where it has two lines; only larger ones are looked up again. No pairs are formed.
* Added word: the longer line's variants meet the shorter line whole, by the XOR of hashed neighbours.

Lines one edit apart share their first or their last half. So variants are emitted only for lines that share a
half with another line of a fitting length, and only of the other half; no pair within the bound is lost by it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from .common import HOT, checked_join, done_with, guarded, hash2, salted_join, split_join, stored, table, words

#: Words for each edit of the bound: one word is more than a fifth of a shorter line.
NEAR_WORDS = 5

#: How a line shares its first half: with a line as long, as the shorter one, as the longer one. Twice that for its last half.
EQUAL, SHORTER, LONGER = 1, 4, 16
#: Tasks over which the pairs of a hot earliest line are spread.
SALTS = 64


def _xor(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def _cut(n: Column) -> Column:
    return F.floor(n / 2).cast("int")


def _named(docs: DataFrame) -> DataFrame:
    """Adds _doc, which names a document and orders it: by doc_id (null last), then by a hash of its text.

    With integral ids it is one number (id, 31 bits of the hash, 31 zeros), as aggregates over numbers need no sort;
    otherwise a struct. A line's place is its document's, and its number in the last bits.
    """
    k1, k2 = hash2(F.coalesce(F.col("_text"), F.lit("")))
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        return docs.withColumn("_doc", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), k1.alias("k1"), k2.alias("k2")))
    number = lambda x: x.cast("decimal(19,0)")
    high = F.coalesce(number(F.col("doc_id")) * number(F.lit(1 << 62)), F.lit(str(1 << 126)).cast("decimal(38,0)"))
    return docs.withColumn("_doc", (high + number(F.shiftleft(F.shiftrightunsigned(k1, 33), 31))).cast("decimal(38,0)"))


def _place(docs: DataFrame) -> Column:
    if isinstance(docs.schema["_doc"].dataType, StructType):
        return F.struct("_doc", "_ln")
    return (F.col("_doc") + F.col("_ln").cast("decimal(10,0)")).cast("decimal(38,0)")


def _place_parts(rows: DataFrame, place: str) -> DataFrame:
    """Adds the _doc and _ln that a place was made of."""
    if isinstance(rows.schema[place].dataType, StructType):
        return rows.withColumn("_doc", F.col(f"{place}._doc")).withColumn("_ln", F.col(f"{place}._ln"))
    ln = F.pmod(F.col(place), F.lit(1 << 31).cast("decimal(10,0)"))
    return rows.withColumn("_ln", ln.cast("int")).withColumn("_doc", (F.col(place) - F.col("_ln").cast("decimal(10,0)")).cast("decimal(38,0)"))


def _lines(docs: DataFrame) -> DataFrame:
    """One row a line with a word: its place, two hashes, and hashes of the halves that it may share.

    _f0 and _f1 are its halves beside lines as long or longer, _f2 and _f3 beside lines a word shorter.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    # Most texts have single spaces only, which a search for bytes shows faster than a pattern does.
    odd = reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in ("  ", "\t", "\x0b", "\x0c", "\r")])
    even = F.when(odd, F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(text)
    rows = docs.select("_doc", F.posexplode(F.split(even, "\n", -1)).alias("_ln", "_line"))
    rows = rows.withColumn("_line", F.btrim("_line")).filter("_line <> ''")
    line = F.col("_line")
    m = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    part = lambda n: F.call_function("substring_index", line, F.lit(" "), n)
    halves = [
        F.when(m >= least, F.xxhash64(F.lit(side), n, part(_cut(n) if side > 0 else _cut(n) - n)))
        for n, least in ((m, NEAR_WORDS), (m - 1, NEAR_WORDS + 1)) for side in (1, -1)
    ]
    h1, h2 = hash2(line)
    return rows.select(_place(docs).alias("_place"), h1.alias("_h1"), h2.alias("_h2"), *[h.alias(f"_f{i}") for i, h in enumerate(halves)])


def _sharing(reps: DataFrame) -> DataFrame:
    """(_h1, _flags): the lines that share a half with a line of a fitting length, and how."""
    own = [F.struct(F.col("_h1"), F.col(f"_f{i}").alias("_half"), F.lit(i % 2).alias("_side"), F.lit(i // 2).alias("_role")) for i in range(4)]
    keys = reps.filter("_f0 is not null").select(F.inline(F.array(*own))).filter("_half is not null")
    of = lambda role, f: f(F.when(F.col("_role") == role, F.col("_h1")))
    met = keys.groupBy("_half", "_side").agg(
        F.sum(1 - F.col("_role")).alias("c0"), F.sum("_role").alias("c1"), of(0, F.min).alias("a0"), of(0, F.max).alias("b0"), of(1, F.min).alias("a1"), of(1, F.max).alias("b1")
    )
    met = met.filter("c0 > 1 or (c0 > 0 and c1 > 0)")
    twice = F.col("_side") + 1
    met = met.withColumn("_is0", (F.when(F.col("c0") > 1, EQUAL).otherwise(0) + F.when(F.col("c1") > 0, SHORTER).otherwise(0)) * twice).withColumn("_is1", F.lit(LONGER) * twice)
    met = stored(met.withColumn("_n", F.col("c0") + F.col("c1")))
    few = F.array(*[F.struct(F.col(f"{x}{role}").alias("_h1"), F.col(f"_is{role}").alias("_flags")) for role in (0, 1) for x in "ab"])
    small = met.filter("c0 <= 2 and c1 <= 2").select(F.inline(few)).filter("_h1 is not null")
    large = met.filter("c0 > 2 or c1 > 2").select("_half", "_side", "_is0", "_is1", "_n")
    again = checked_join(keys, large, ["_half", "_side"], "_n", 4 * reps.count()).select("_h1", F.when(F.col("_role") == 0, F.col("_is0")).otherwise(F.col("_is1")).alias("_flags"))
    return small.unionByName(again).groupBy("_h1").agg(F.bit_or("_flags").alias("_flags"))


def _has(flag: int) -> Column:
    return F.col("_flags").bitwiseAND(F.lit(flag)) != 0


def _from(first: int, at: Column, n: Column, rows: Column) -> Column:
    """Of an array's n places, those past `at` if the first halves are shared, those before if the last ones are."""
    start = F.when(_has(2 * first), 0).otherwise(at)
    end = F.when(_has(first), n).otherwise(at)
    return F.slice(rows, start + 1, end - start)


def _changed(near: DataFrame) -> DataFrame:
    """(_o, _with): lines one changed word from the earliest line of a key."""
    g = F.transform("_words", lambda w, j: F.struct(F.xxhash64(w, j).alias("a"), F.xxhash64(F.lit(7), w, j).alias("b")))
    rows = near.filter(_has(3 * EQUAL)).select("_o", "_flags", g.alias("_g"))
    m, all_of = F.size("_g"), lambda c: _xor(F.transform("_g", lambda x: x[c]))
    # What is beside an explosion is worked out for each of its rows, so all of it comes before.
    rows = rows.select("_o", all_of("a").alias("_sa"), all_of("b").alias("_sb"), _from(EQUAL, _cut(m), m, F.col("_g")).alias("_g"))
    variants = rows.select("_o", "_sa", "_sb", F.explode("_g").alias("_x")).select("_o", F.col("_sa").bitwiseXOR(F.col("_x.a")).alias("k1"), F.col("_sb").bitwiseXOR(F.col("_x.b")).alias("k2"))
    met = stored(variants.groupBy("k1", "k2").agg(F.min("_o").alias("_with"), F.max("_o").alias("_last"), F.count(F.lit(1)).alias("_n")).filter("_with < _last"))
    two = met.filter("_n = 2").select(F.col("_last").alias("_o"), "_with")
    large = met.filter("_n > 2").select("k1", "k2", "_with", "_n")
    total = large.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return two.unionByName(checked_join(variants, large, ["k1", "k2"], "_n", total).filter("_o <> _with").select("_o", "_with"))


def _added(near: DataFrame) -> DataFrame:
    """(_o, _with): pairs of a line and the line that one word less makes of it; the later one is _o."""
    at = lambda j: F.coalesce(F.get("_words", j), F.lit(""))
    pair = lambda a, b: F.xxhash64(a, F.lit(" "), b)
    half = lambda side, n, k: F.xxhash64(F.lit(side), n, F.array_join(F.slice("_words", F.lit(1) if side > 0 else F.size("_words") - k + 1, k), " "))
    every = _xor(F.transform("_words", lambda w, j: pair(at(j - 1), w))).bitwiseXOR(pair(at(F.size("_words") - 1), F.lit("")))
    m = F.size("_words")
    p = _cut(m - 1)
    left_out = F.transform("_words", lambda w, j: F.struct(j.alias("j"), pair(at(j - 1), w).bitwiseXOR(pair(w, at(j + 1))).bitwiseXOR(pair(at(j - 1), at(j + 1))).alias("d")))
    long = near.filter(_has(3 * LONGER)).select("_o", "_flags", p.alias("_p"), half(1, m - 1, p).alias("_hp"), half(-1, m - 1, m - 1 - p).alias("_hq"), every.alias("_e"), left_out.alias("_d"))
    long = long.select(F.col("_o").alias("_long"), "_p", "_hp", "_hq", "_e", _from(LONGER, F.col("_p"), F.size("_d"), F.col("_d")).alias("_d"))
    long = long.select("_long", "_p", "_hp", "_hq", "_e", F.explode("_d").alias("_x"))
    long = long.select("_long", F.when(F.col("_x.j") >= F.col("_p"), F.col("_hp")).otherwise(F.col("_hq")).alias("_half"), F.col("_e").bitwiseXOR(F.col("_x.d")).alias("_e"))
    whole = F.array(F.when(_has(SHORTER), half(1, m, _cut(m))), F.when(_has(2 * SHORTER), half(-1, m, m - _cut(m))))
    short = near.filter(_has(3 * SHORTER)).select("_o", every.alias("_e"), F.array_compact(whole).alias("_w")).select("_o", "_e", F.explode("_w").alias("_half"))
    return salted_join(long, short, ["_half", "_e"], 8).select(F.greatest("_o", "_long").alias("_o"), F.least("_o", "_long").alias("_with"))


def _is_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words are one word edit apart."""
    long, short = F.when(F.size(a) > F.size(b), a).otherwise(b), F.when(F.size(a) > F.size(b), b).otherwise(a)
    unlike = F.zip_with(long, short, lambda x, y: ~x.eqNullSafe(y))
    first = F.array_position(unlike, True).cast("int")
    rest = lambda x, n: F.slice(x, n, F.size(x))
    one_more = rest(long, first + 1) == rest(short, first)
    return F.when(F.size(a) == F.size(b), F.size(F.filter(unlike, lambda x: x)) == 1).otherwise((F.size(long) == F.size(short) + 1) & one_more)


def _edits(near: DataFrame) -> DataFrame:
    """_o of the lines of near (_o, _flags, _words) that are one verified edit from an earlier one."""
    pairs = stored(_changed(near).unionByName(_added(near)).distinct())
    total = pairs.count()
    hot = [r._with for r in pairs.groupBy("_with").count().filter(F.col("count") * HOT > total).collect()]  # fewer than HOT
    is_hot = F.col("_with").isin(hot) if hot else F.lit(False)
    mine = pairs.join(near.select("_o", "_words"), "_o").withColumn("_salt", F.when(is_hot, F.pmod(F.col("_o"), F.lit(SALTS))).otherwise(0).cast("long"))
    theirs = near.select(F.col("_o").alias("_with"), F.col("_words").alias("_theirs"))
    theirs = theirs.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    return mine.join(theirs, ["_with", "_salt"]).filter(_is_edit(F.col("_words"), F.col("_theirs"))).select("_o").distinct()


def _near_lines(base: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that share a half, numbered in order of their places: (_o, hashes, count), and (_o, _flags, _words)."""
    met = reps.filter("_f0 is not null").drop("_f0", "_f1", "_f2", "_f3").join(_sharing(reps), "_h1")
    n = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = stored(met.repartitionByRange(n, "_place").sortWithinPartitions("_place").withColumn("_o", F.monotonically_increasing_id()))
    wanted = _place_parts(near, "_place").groupBy("_doc").agg(F.collect_list(F.struct("_ln", "_o", "_flags")).alias("_want"))
    # Each line is taken out of its text's array before the explosion, which would copy the array for each.
    lines = base.select("_doc", F.split("_text", "\n", -1).alias("_l")).join(wanted, "_doc")
    lines = lines.select(F.explode(F.transform("_want", lambda w: F.struct(w["_o"].alias("_o"), w["_flags"].alias("_flags"), F.get("_l", w["_ln"]).alias("_line")))).alias("_w"))
    return near, stored(lines.select("_w._o", "_w._flags", words(F.col("_w._line")).alias("_words")))


def _gone(base: DataFrame) -> DataFrame:
    """(_doc, _gone): for each document that loses lines, twice their numbers, and one more for near ones."""
    lines = stored(_lines(base))
    reps = stored(lines.groupBy("_h1", "_h2").agg(F.min("_place").alias("_place"), F.count(F.lit(1)).alias("_n"), *[F.max(f"_f{i}").alias(f"_f{i}") for i in range(4)]))
    near, texts = _near_lines(base, reps)
    edits = near.join(_edits(texts), "_o").select("_h1", "_h2", "_n", F.lit(True).alias("_near")).distinct()
    repeated = reps.filter("_n > 1").select("_h1", "_h2", "_n", "_place")
    acts = stored(edits.withColumn("_place", F.lit(None).cast(reps.schema["_place"].dataType)).unionByName(repeated.join(edits, ["_h1", "_h2"], "left_anti").withColumn("_near", F.lit(False))))
    done_with(near, texts, reps)
    rows = lines.select("_h1", "_h2", F.col("_place").alias("_at"))
    met = split_join(rows, acts, ["_h1", "_h2"], "_n", rows.count()).filter(F.col("_near") | (F.col("_at") != F.col("_place")))
    out = stored(_place_parts(met, "_at").groupBy("_doc").agg(F.sort_array(F.collect_set(2 * F.col("_ln").cast("long") + F.col("_near").cast("int"))).alias("_gone")))
    done_with(lines, acts)
    return out


@guarded
def line_dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """Drops each line that equals, or is within one word edit of, an earlier line of the corpus.

    Order is by doc_id (null last), then by a hash of the text where ids repeat, then by line. White space
    counts only as a separator of words. Lines without a word stay, lines under NEAR_WORDS words are
    matched exactly. An earlier line counts even if it goes itself. Adds kept_text (lines that stay, joined
    by newlines; null for a null text), n_lines, n_exact and n_near (lines dropped as equal and as near;
    a dropped near line's copies count as near). Rows with one doc_id and one text are one document and
    end alike. Other columns pass through; columns of the added names are replaced. The result reads one
    stored table, of the lines that go.
    """
    given = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_exact", "n_near")]
    base = _named(docs.select(*[F.col(c).alias("_text" if c == text else c) for c in given]))
    gone = _gone(base.select("_doc", "_text"))
    out = base.join(gone, "_doc", "left").withColumn("_l", F.split("_text", "\n", -1))
    # What stays are the runs between the lines that go.
    at = lambda k: F.floor(F.get("_gone", k) / 2).cast("int")
    n = F.size("_l")
    start, end = (lambda k: F.when(k == 0, 0).otherwise(at(k - 1) + 1)), (lambda k: F.when(k == F.size("_gone"), n).otherwise(at(k)))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_gone")), lambda k: F.slice("_l", start(k) + 1, end(k) - start(k))))
    n_near = F.coalesce(F.size(F.filter("_gone", lambda x: x % 2 == 1)), F.lit(0)).cast("long")
    return out.select(
        *[F.col("_text" if c == text else c).alias(c) for c in given],
        F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        F.when(F.col("_text").isNull(), F.lit(0)).otherwise(n).cast("long").alias("n_lines"),
        (F.coalesce(F.size("_gone"), F.lit(0)) - n_near).alias("n_exact"),
        n_near.alias("n_near"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


SQL = rf"""
with l as (select doc_id, ln, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') w
             from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) ln from documents)),
e as (select doc_id, ln, array_to_string(w, ' ') k, w, len(w) m from l where len(w) >= 1),
r as (select k, min((doc_id, ln)) p, any_value(w) w, any_value(m) m from e group by k),
v as (select k, p, m, i, array_to_string(w[: i - 1] || ['*'] || w[i + 1 :], ' ') c, array_to_string(w[: i - 1] || w[i + 1 :], ' ') d
        from (select *, unnest(range(1, m + 1)) i from r where m >= {NEAR_WORDS})),
g as (select k from v qualify p > min(p) over (partition by m, i, c)
      union select case when v.p > r.p then v.k else r.k end from v join r on v.d = r.k and r.m >= {NEAR_WORDS}),
f as (select e.doc_id, e.ln, g.k is not null near, g.k is null and (e.doc_id, e.ln) > r.p exact from e join r using (k) left join g using (k)),
s as (select doc_id, ln, x, coalesce(near, false) near, coalesce(exact, false) exact from l left join f using (doc_id, ln))
select doc_id, count(*)::bigint n_lines, sum(exact::int)::bigint n_exact, sum(near::int)::bigint n_near,
       sha256(coalesce(string_agg(case when not near and not exact then x end, chr(10) order by ln), '')) kept_sha256
from s group by doc_id
"""
