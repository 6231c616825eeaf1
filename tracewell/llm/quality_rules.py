"""Quality rules: a table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, guarded, settled, table, words

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "he", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "für", "ist", "mit", "nicht", "sich", "und", "von", "zu", "im",
    "au", "avec", "dans", "de", "du", "en", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "al", "como", "con", "del", "el", "los", "no", "o", "para", "por", "se", "su", "y", "lo", "es",
)

#: Words of a window whose repetition counts.
WINDOW = 8


class Rule(NamedTuple):
    """A ratio of two measures and the closed range in which a document passes. Null (0/0) passes."""

    name: str
    over: str
    under: str | None
    least: float | None
    most: float | None


RULES = (
    Rule("words", "n_words", None, 20, None),
    Rule("word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.25),
    Rule("stop_words", "n_stop_words", "n_words", 0.05, None),
    Rule("repeated_words", "n_repeat_words", "n_words", None, 0.3),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.5),
)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts that rules compare; every one is a long, and 0 for a null or empty text.

    Columns of docs that have the name of a count are replaced. Rows are neither added nor dropped, so
    repeated rows each get their counts. Work for a document is n log n in its words.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    given = [c for c in docs.columns if c not in MEASURES]
    has_word = lambda line: line.rlike(WORD)
    step = docs.select(*given, words(body).alias("_w"), F.filter(F.split(body, "\n", -1), has_word).alias("_l"))
    window = F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(WINDOW)]))
    step = step.select(
        *given,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_w", lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.when(F.size("_w") >= WINDOW, window).alias("_h"),
    )
    # Most texts repeat no window; only the others sort theirs. Each step below is null for those that don't.
    step = step.select(*given, *MEASURES[:-1], F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"))
    twin = lambda x, k: (F.get("_s", k - 1)["h"] == x["h"]) | (F.get("_s", k + 1)["h"] == x["h"])
    step = step.select(*given, *MEASURES[:-1], F.sort_array(F.transform(F.filter("_s", lambda x, k: F.coalesce(twin(x, k), F.lit(False))), lambda x: x["i"])).alias("_p"))
    new = F.transform("_p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", k + 1) - p, F.lit(WINDOW))).cast("long"))
    return step.select(*given, *MEASURES[:-1], settled(F.coalesce(F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).alias("n_repeat_words"))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words")


def failed(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a measured row breaks, in the table's order."""

    def breaks(r: Rule) -> Column:
        value = F.col(r.over).cast("double")
        value = value if r.under is None else F.try_divide(value, F.col(r.under).cast("double"))
        out = F.lit(False)
        if r.least is not None:
            out = out | (value < r.least)
        if r.most is not None:
            out = out | (value > r.most)
        return F.when(out, F.lit(r.name))

    return F.array_compact(F.array(*[breaks(r) for r in rules]))


@guarded
def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Judges each row by the table of rules.

    Adds the measures, failed_rules (array of names), base_failed and kept. A null or empty text has no
    words and is not kept. Columns of the same names are replaced; other columns pass through.
    """
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = measured(docs, text).withColumn("failed_rules", failed(rules)).withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words")
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*cols)


def _test(r: Rule) -> str:
    value = f"{r.over}::double" + (f" / nullif({r.under}, 0)" if r.under else "")
    return " and ".join([f"coalesce({value} {op} {x}, true)" for op, x in ((">=", r.least), ("<=", r.most)) if x is not None])


SQL = rf"""
with d as (select row_number() over () r, doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from documents),
win as (select r, unnest(range(len(w) - 7)) i, w from d where len(w) >= 8),
named as (select r, i, array_to_string(w[i + 1 : i + 8], ' ') g from win),
twin as (select r, i from named qualify count(*) over (partition by r, g) > 1),
cover as (select r, sum(least(8, coalesce(n - i, 8))) c from (select r, i, lead(i) over (partition by r order by i) n from twin) group by r),
m as (select doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
        (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(c, 0)::bigint n_repeat_words, len(l)::bigint n_lines,
        len(list_filter(w, lambda x: list_contains([{", ".join(repr(x) for x in STOP_WORDS)}], x)))::bigint n_stop_words
      from d left join cover using (r)),
b as (select *, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and {" and ".join(_test(r) for r in RULES)}) kept, n_lines, n_stop_words from b
"""
