"""Text cards: sanitizing, compaction, query building, recall, near-duplicate merging."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators import blocks
from tracewell.operators.ranking import kept
from tracewell.operators.retrieval import alike_sets

# Phrases that try to steer a reader.
PHRASES = (
    "ignore previous instructions", "ignore all previous instructions", "ignore all instructions", "disregard previous instructions", "disregard all instructions", "forget previous instructions",
    "forget all previous instructions", "override all previous instructions", "your new system prompt", "your new instructions", "from now on you are", "pretend you are",
    "执行以下命令", "运行以下命令", "忽略之前的指令", "忽略以上所有内容", "忽略以上内容", "无视之前的指令", "忘记之前的指令", "你的新系统提示", "你的新指令",
)
# What stands for text that compaction leaves out, and words that a query leaves out.
COMPACTED = "\n...[content compacted]...\n"
QUERY_STOP_WORDS = ("a", "at", "below", "checkout", "commit", "git", "github", "in", "issue", "of", "please", "repository", "requirements", "resolve", "task", "the", "working", "you", "are")
GENERIC = ("continue", "please continue", "go on", "next", "ok", "okay", "yes", "no", "继续", "好的", "好", "是", "否", "下一步")

# What reads as a link, a repository, a path, symbol, error, test or import in a task text. A library that
# was filled elsewhere is asked by the same signals, so these have to match what filled it.
LINK = r"(?i)https?://\S+"
REPOSITORY = r"(?i)checkout\s+of\s+the\s+([a-z0-9_.-]+/[a-z0-9_.-]+)\s+repository"
SIGNALS = {
    "paths": r"(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+",
    "symbols": r"\b[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+\b|\b_+[A-Za-z0-9_]+_+\b|\b[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+\b",
    "errors": r"\b(?i:[a-z][a-z0-9]*error)\b|\b[A-Z]{2,}(?:[_-][A-Z0-9]+)+\b",
    "tests": r"\b(?:test_[A-Za-z0-9_]+|Test[A-Z][A-Za-z0-9_]*)\b",
}
IMPORTS = (r"(?i)\bimports?\s+([a-z_][a-z0-9_.]*)", r"(?i)\bfrom\s+([a-z_][a-z0-9_.]*)\s+import\b")
# Programs and words of commands by what they do; plans of transcripts are compared by these stages.
TEST_RUNNERS = ("pytest", "runtests", "unittest", "tox ")
BUILD_WORDS, BUILD_STARTS = ("install", "setup.py", " build"), ("make", "cargo build", "go build")
LOCATING = ("rg", "grep", "find", "ls", "cat", "head", "tail", "git", "sed", "awk")
REPRODUCING = ("python", "python3")
SHELL_TOOLS, LOCATING_TOOLS, EDITING_TOOLS = ("bash", "shell"), ("read", "grep", "search", "find", "list", "glob"), ("edit", "write", "patch", "replace")

_ESCAPES = (
    "[\\x1B][\\[][^\\x40-\\x7E]*[\\x40-\\x7E]",
    "[\\x1B][\\]PX^_](?s:.*?)(?:\\x07|\\u009C|\\x1B\\\\)",
    "[\\x1B][\\x00-\\x4F\\x51-\\x57\\x59\\x5A\\x5C\\x60-\\x7F]",
    "\\u009B[^\\x40-\\x7E]*[\\x40-\\x7E]",
    "[\\u0090\\u0098\\u009D-\\u009F](?s:.*?)(?:\\x07|\\u009C|\\x1B\\\\)",
    "[\\x1B\\u0090\\u0098\\u009B-\\u009F]",
)


def without_escapes(text: Column) -> Column:
    """Terminal control sequences taken out; of one that doesn't end, only its start."""
    return F.regexp_replace(text, "|".join(_ESCAPES), "")


def without_phrases(text: Column) -> Column:
    """Steering phrases taken out until none is left; white space closes up where one was."""
    alone = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
    word = r"[\p{L}\p{Nd}_&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]"
    pattern = f"(?iu)(?<!{word})(?:{'|'.join(sorted(PHRASES, key=len, reverse=True))})(?!{word})"
    once = lambda x: F.when(x.rlike(pattern), F.btrim(F.regexp_replace(F.regexp_replace(x, pattern, ""), r"\s+", " "))).otherwise(x)
    # Taking a phrase out may join another; each pass takes at least one of their last words.
    ends = f"(?iu)instructions|prompt|you are|{alone}"
    passes = F.when(text.rlike(pattern), F.regexp_count(text, F.lit(ends))).otherwise(0)
    return F.aggregate(F.sequence(F.lit(0), passes.cast("int")), text, lambda x, _: once(x))


def sanitized(text: Column) -> Column:
    """Escapes, phrases, then private data: once more changes nothing."""
    return T.redacted(without_phrases(without_escapes(F.coalesce(text, F.lit("")))))


def _compact(text: str | None, most: int) -> str:
    fence, kept = "", []
    for line in (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        line = line.rstrip(" \t")
        bare = line.strip()
        mark = bare[:3] if bare[:3] in ("```", "~~~") else ""
        if mark or fence:
            kept.append(line)
            fence = "" if mark == fence and mark else fence or mark
            continue
        decoration = len(bare) >= 3 and not set(bare) - set("-*_=~#")
        repeated = kept and ((not bare and not kept[-1].strip()) or (bare and line == kept[-1]))
        if not decoration and not repeated:
            kept.append(line)
    data = "\n".join(kept).strip().encode()
    if len(data) <= most:
        return data.decode()
    room = most - len(COMPACTED)
    if room <= 0:
        return data[:most].decode(errors="ignore")
    tail = data[len(data) - (room - room // 2) :]
    while tail and tail[0] & 0xC0 == 0x80:
        tail = tail[1:]
    return data[: room // 2].decode(errors="ignore") + COMPACTED + tail.decode(errors="ignore")


def compacted(text: Column, most: int = 4000) -> Column:
    """Decoration, repeated lines and runs of blank lines left out outside fences; over `most` bytes, head and tail."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _compact(x, most))

    return run(text)


def structured_query(text: Column) -> Column:
    """Signals of a task text: its first line (intent), repository, paths, symbols, errors, tests, imports, sorted; and the words to search for.

    Without signals the strategy is lexical, and reason says so: no_structured_signals, or empty_after_cleaning where no
    word is left.
    """
    given = F.coalesce(text, F.lit(""))
    plain = F.regexp_replace(given, LINK, " ")
    every = lambda p, g=0: F.array_sort(F.array_distinct(F.regexp_extract_all(plain, F.lit(p), F.lit(g))))
    found = {name: every(pattern) for name, pattern in SIGNALS.items()}
    found["imports"] = F.array_sort(F.filter(F.array_distinct(F.concat(*[every(p, 1) for p in IMPORTS])), lambda x: x != ""))
    words = F.filter(F.array_distinct(T.tokens(plain)), lambda w: ~w.isin(*QUERY_STOP_WORDS))
    signals = F.concat(*found.values())
    some = F.size(signals) > 0
    lines = F.filter(F.transform(F.split(given, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(
        *[c.alias(name) for name, c in found.items()],
        F.array_join(F.when(some, F.array_distinct(F.concat(signals, words))).otherwise(words), " ").alias("text"),
        F.when(some, "structured").otherwise("lexical").alias("strategy"),
        F.coalesce(F.get(lines, F.lit(0)), F.lit("")).alias("intent"),
        F.lower(F.regexp_extract(given, REPOSITORY, 1)).alias("repo"),
        F.when(some, "").when(F.size(words) > 0, "no_structured_signals").otherwise("empty_after_cleaning").alias("reason"),
    )


def memory_freshness(age_days: Column, volatility: Column, kind: Column, expired: Column) -> Column:
    """fresh, current, stale or expired by the windows of a fact's volatility, or else of its kind."""
    window = lambda a, b: F.when(age_days < 0, "current").when(age_days <= a, "fresh").when(age_days <= b, "current").otherwise("stale")
    return (
        F.when(expired, "expired").when(volatility == "evergreen", F.when(age_days < 0, "current").otherwise("fresh")).when(volatility == "stable", window(90, 365)).when(volatility == "volatile", window(7, 30))
        .when(kind == "reference", window(14, 45)).when(kind.isin("user", "feedback"), window(90, 365)).otherwise(window(30, 180))
    )


def generic_query(text: Column) -> Column:
    return F.lower(T.normalized(text)).isin(*GENERIC)


#: What stands around a word of a query and isn't part of it.
_AROUND = "#()[]{}<>,;:'\"`!?=+*/\\|"


def strong_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): the terms of queries (query_id, text) that alone make a match worth recalling.

    Long ones of queries with one or two terms; words with a digit, an underscore or a capital inside; and what stands
    after # or before a full stop.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.transform(F.split(text, r"\s+"), lambda w: F.btrim(w, F.lit(_AROUND)))
    marked = F.transform(F.filter(words, lambda w: w.rlike(r"\p{Nd}|_|.\p{Lu}")), lambda w: F.lower(w))
    rows = queries.select("query_id", text.alias("text"), F.array_distinct(T.tokens(F.col("text"))).alias("terms"), marked.alias("marked"))
    rows = rows.select("query_id", "text", "marked", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    long = (F.col("n") <= 2) & (F.length("term") >= 6)
    return rows.filter(long | F.array_contains("marked", F.col("term")) | F.contains("text", F.concat(F.lit("#"), "term")) | F.contains("text", F.concat("term", F.lit(".")))).select("query_id", "term")


#: Share of the best score that a fact needs, and facts that are brought up.
FLOOR, LIMIT = 0.24, 4


def lift(project: Column, freshness: Column) -> Column:
    """What a fact's score is multiplied by; null for an expired one.

    Freshness, a long expression, is read once: twice beside a tokenizer it makes a method too large to be compiled.
    """
    times = lambda f: F.when(f != "expired", F.when(project, 1.08).otherwise(1.0) * F.when(f == "stale", 0.92).otherwise(1.0))
    return F.get(F.transform(F.array(freshness), times), F.lit(0))


def recall(hits: DataFrame, single: DataFrame | None = None, floor: float = FLOOR, limit: int = LIMIT) -> DataFrame:
    """Facts to bring up: strong matches, project ones lifted, stale ones lowered, expired ones dropped.

    hits has query_id, doc_id, score, n_matched, project, freshness. A match is strong with two terms, or with one if
    single has its (query_id, doc_id): those that hold one of the strong_terms.
    """
    from tracewell.operators import retrieval as R

    strong = hits.filter("n_matched >= 2")
    if single is not None:
        strong = strong.unionByName(hits.filter("n_matched = 1").join(single.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi").select(*hits.columns))
    lifted = F.col("score") * F.when(F.col("project"), 1.08).otherwise(1.0) * F.when(F.col("freshness") == "stale", 0.92).otherwise(1.0)
    scored = strong.filter("freshness <> 'expired'").withColumn("score", F.round(lifted, 6))
    return R.top(R.floor_by_top(scored, floor, ("query_id",)), limit, by=("query_id",))


def clipped(items: DataFrame, budget: int, frame: int, least: int = 24, group: str = "query_id") -> DataFrame:
    """(group, texts, used, omitted): entries in order of rank in a budget of characters, of which `frame` are taken.

    items has rank, head and body. An entry that doesn't fit has its body cut, with dots after it, to what is left; one
    that would keep fewer than `least` characters of its body is omitted, and later shorter ones may still fit. A group
    is the few hits of one query, folded in one expression.
    """
    rows = F.sort_array(F.collect_list(F.struct("rank", "head", "body")))
    start = F.struct(F.lit(frame).alias("used"), F.array().cast("array<string>").alias("texts"), F.lit(0).alias("omitted"))

    def step(acc: Column, x: Column) -> Column:
        room = F.lit(budget) - acc["used"] - F.length(x["head"])
        body = F.when(F.length(x["body"]) <= room, x["body"]).when(room >= least + 3, F.concat(F.substring(x["body"], F.lit(1), room - 3), F.lit("...")))
        entry = F.concat(x["head"], body)
        return F.struct(
            (acc["used"] + F.coalesce(F.length(entry), F.lit(0))).alias("used"), F.when(entry.isNull(), acc["texts"]).otherwise(F.concat(acc["texts"], F.array(entry))).alias("texts"),
            (acc["omitted"] + entry.isNull().cast("int")).alias("omitted"),
        )

    out = items.groupBy(group).agg(F.aggregate(rows, start, step).alias("p"))
    return out.select(group, "p.texts", "p.used", "p.omitted")


def clusters(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, rep) as a walk by id would give: a row joins the first earlier representative it is like, or is one.

    pairs (a < b) are alike; they are made once and written out. A row is out once one earlier like is a representative,
    and is one once all are out, so a round needn't wait for the whole chain of likes before it; settled rows' pairs go.
    """
    edges = kept(pairs.select(F.col("b").alias("id"), F.col("a").alias("earlier")))
    fresh = kept(ids.select("id").join(edges.select("id").distinct(), "id", "left_anti"))
    reps, rest = [fresh], edges
    while not rest.isEmpty():
        out = kept(rest.join(fresh.select(F.col("id").alias("earlier")), "earlier", "left_semi").select("id").distinct())
        left = kept(rest.join(out, "id", "left_anti").join(out.select(F.col("id").alias("earlier")), "earlier", "left_anti").select("id", "earlier"))
        fresh = kept(rest.select("id").distinct().join(out, "id", "left_anti").join(left.select("id").distinct(), "id", "left_anti"))
        reps, rest = [*reps, fresh], left
    all_ = kept(reduce(DataFrame.unionByName, reps))
    first = edges.join(all_.select(F.col("id").alias("earlier")), "earlier", "left_semi").groupBy("id").agg(F.min("earlier").alias("first"))
    return ids.select("id").join(first, "id", "left").select("id", F.coalesce("first", "id").alias("rep"))


#: Sets that the driver walks at once, share of the others that they have to settle for another round, and words that are counted by matrices.
LED, SETTLED, WORDS = 4_000, 0.1, 2_048


def _common(words: np.ndarray, ends: np.ndarray, vocabulary: np.ndarray, column: np.ndarray, starts: np.ndarray, dense: np.ndarray | None, m: int) -> np.ndarray:
    """How many words each of some sets (their words, up to ends) has in common with each of m leaders, by their vocabulary."""
    n = len(ends)
    row = np.repeat(np.arange(n), np.diff(np.concatenate([[0], ends])))
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    met = vocabulary[at] == words
    row, at = row[met], at[met]
    if dense is not None:
        own = np.zeros((n, len(vocabulary)), np.float32)
        own[row, at] = 1
        return own @ dense
    each = np.diff(starts)[at]
    entry = np.repeat(starts[at] - np.cumsum(each) + each, each) + np.arange(each.sum())
    return np.bincount(np.repeat(row, each) * m + column[entry], minlength=n * m).reshape(n, m)


def _alike(common: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs (places, two arrays) whose likeness, rounded to six digits, reaches the threshold."""
    least = threshold - 6e-7
    r, c = np.nonzero(common >= least / (1 + least) * (n[:, None] + m[None, :]) - 1e-6)
    both = common[r, c].astype(np.float64)
    ok = blocks.rounded(both / (n[r] + m[c] - both), 6) >= threshold
    return r[ok], c[ok]


class _Leaders:
    """Sets (ids ascending, words) that have an inverted list."""

    def __init__(self, ids: pa.Array, lists: pa.ListArray):
        self.ids, self.n = ids, blocks.sizes(lists)
        words = lists.flatten().to_numpy(zero_copy_only=False)
        self.vocabulary, at = np.unique(words, return_inverse=True)
        order = np.argsort(at, kind="stable")
        self.column, self.starts = np.repeat(np.arange(len(ids)), self.n)[order], np.searchsorted(at[order], np.arange(len(self.vocabulary) + 1))
        self.dense = None
        if len(self.vocabulary) <= WORDS:
            self.dense = np.zeros((len(self.vocabulary), len(ids)), np.float32)
            self.dense[at, np.repeat(np.arange(len(ids)), self.n)] = 1

    def alike(self, lists: pa.ListArray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(set, leader) places that are alike, a few sets at a time."""
        m, size = len(self.ids), blocks.sizes(lists)
        words, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(size)
        step = max(1, 2_000_000 // max(m, 1))
        for i in range(0, len(size), step):
            some, lo = ends[i : i + step], ends[i] - size[i]
            r, c = _alike(_common(words[lo : some[-1]], some - lo, self.vocabulary, self.column, self.starts, self.dense, m), size[i : i + step], self.n, threshold)
            yield r + i, c


def led(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, rep): what `clusters` gives for all alike pairs of unequal sets (id, words: whole numbers, distinct, one at least), whose pairs needn't be made.

    The first sets by id are walked on the driver, and each other set that is like one of their representatives joins the
    first of these; the rest goes into the next round. Once a round settles few, the pairs of what is left are made.
    """
    kind = dict(sets.dtypes)["id"]
    rest, done = kept(sets.select("id", "words")), []
    while True:
        total = rest.count()
        some = rest.orderBy("id").limit(LED).toArrow().combine_chunks()
        if not some.num_rows:
            break
        ids, lists = (pa.chunked_array(some.column(c).chunks, some.column(c).type).combine_chunks() for c in ("id", "words"))
        earlier: dict[int, list[int]] = {}
        for r, c in _Leaders(ids, lists).alike(lists, threshold):
            for x, y in zip(*(v[c < r].tolist() for v in (r, c)), strict=True):
                earlier.setdefault(x, []).append(y)
        rep = np.arange(len(ids))
        for x in range(len(ids)):
            rep[x] = min((y for y in earlier.get(x, ()) if rep[y] == y), default=x)
        first = pa.table({"id": ids, "rep": ids.take(pa.array(rep))})
        at = pa.array(np.flatnonzero(rep == np.arange(len(ids))))
        done.append(kept(sets.sparkSession.createDataFrame(first).select(F.col("id").cast(kind).alias("id"), F.col("rep").cast(kind).alias("rep"))))
        if total <= len(ids):
            break
        shared = sets.sparkSession.sparkContext.broadcast(_Leaders(ids.take(at), lists.take(at)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            leaders = shared.value
            for batch in batches:
                joined = np.full(batch.num_rows, len(leaders.ids))
                for r, c in leaders.alike(batch.column("words"), threshold):
                    np.minimum.at(joined, r, c)
                rep = leaders.ids.take(pa.array(joined, mask=joined == len(leaders.ids)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("words"), rep], names=["id", "words", "rep"])

        later = rest.filter(F.col("id") > F.lit(ids[-1].as_py()))
        marked = kept(later.mapInArrow(run, f"id {kind}, words array<bigint>, rep {kind}").withColumn("words", F.when(F.col("rep").isNull(), F.col("words"))))
        shared.destroy()
        done.append(marked.filter("rep is not null").select("id", "rep"))
        rest = marked.filter("rep is null").select("id", "words")
        left = rest.count()
        if left > LED and total - len(ids) - left < SETTLED * (total - len(ids)):
            pairs = alike_sets(kept(rest.select(F.col("id").alias("doc_id"), F.col("words").alias("tokens"))), threshold)
            done.append(clusters(pairs, rest.select("id")))
            break
    return reduce(DataFrame.unionByName, done) if done else rest.select("id", F.col("id").alias("rep"))


def clean_path(path: Column) -> Column:
    """A relative path in plain form, or null for absolute, home, drive, URL and upward ones."""
    p = F.regexp_replace(F.trim(path), r"\\", "/")
    p = F.regexp_replace(F.regexp_replace(p, r"/+", "/"), r"(?:^|(?<=/))\./", "")
    bad = p.rlike(r"^(/|~|[A-Za-z]:)|^[a-z]+:/|(^|/)\.\.(/|$)") | (p == "")
    return F.when(~bad, F.regexp_replace(p, "/$", ""))


def command_head(command: Column) -> Column:
    """The first word of a command after leading assignments and cd."""
    c = F.regexp_replace(F.trim(command), r"^(?:cd\s+\S+\s*&&\s*)+", "")
    return F.regexp_extract(F.regexp_replace(c, r"^(?:[A-Za-z_][A-Za-z0-9_]*=\S*\s+)+", ""), r"^(\S+)", 1)


def is_test_command(command: Column) -> Column:
    c = F.lower(command)
    return c.rlike("|".join(TEST_RUNNERS)) | c.rlike(r"^\s*\S+\s.*?(?:^|\s)test(?:\s|$)|^\s*\S+\s+test(?:\s|$)")


def is_build_command(command: Column) -> Column:
    c = F.lower(command)
    return reduce(or_, [*(c.contains(w) for w in BUILD_WORDS), *(c.startswith(w) for w in BUILD_STARTS)])


def command_outcome(verification: Column, content: Column, has_result: Column) -> Column:
    """ok or failed as the host verified it, else the last exit status told, else unknown; empty without a result."""
    code = F.regexp_extract(content, r"(?s).*exit status ([^\n]{1,8})", 1)
    return F.when(~has_result, "").when(verification == "passed", "ok").when(verification == "failed", "failed").when(F.trim(code) != "", F.concat(F.lit("exit "), F.trim(code))).otherwise("unknown")


def stage(tool: Column, command: Column, path: Column) -> Column:
    """A call's stage in a plan: verify, reproduce, locate, edit or none."""
    t, c = F.lower(tool), F.lower(F.coalesce(command, F.lit("")))
    head = command_head(c)
    shell = F.when(is_test_command(c), "verify").when(c.contains("repro"), "reproduce").when(head.isin(*LOCATING), "locate").when(head.isin(*REPRODUCING), "reproduce").otherwise("")
    edit = F.when(F.lower(F.coalesce(path, F.lit(""))).contains("repro"), "reproduce").otherwise("edit")
    return F.when(t.isin(*SHELL_TOOLS), shell).when(t.rlike("|".join(LOCATING_TOOLS)), "locate").when(t.rlike("|".join(EDITING_TOOLS)), edit).otherwise("")


def block_item(kind: Column, project: Column, source: Column, commit: Column, origin: Column, status: Column, score: Column, created: Column, historical: Column) -> Column:
    """The line that says where a slice comes from, and for a historical one that it has to be checked before use."""
    quoted = lambda c: F.to_json(F.array(F.coalesce(c, F.lit("")))).substr(F.lit(2), F.length(F.to_json(F.array(F.coalesce(c, F.lit(""))))) - 2)
    verified = F.when(kind == "result", F.coalesce(status, F.lit("probation"))).otherwise("unknown")
    line = F.concat(F.lit("type="), kind, F.lit(" project="), quoted(project), F.lit(" source="), quoted(source), F.lit(" commit="), quoted(commit), F.lit(" origin="), origin, F.lit(" verified="), verified, F.lit(" score="), F.format_string("%.4f", score), F.lit(" created_at="), created.cast("string"), F.lit("\n"))
    return F.concat(line, F.when(historical, F.lit("applicability=historical_observation; revalidate_before_use\n")).otherwise(""))


def block(items: DataFrame, group: str = "query_id") -> DataFrame:
    """(group, text): admitted items as one block, verified before grey, by score, then id; markers escaped.

    items has doc_id, zone, score, content and, if it is to be told, provenance (what block_item gives).
    """
    body = F.replace(F.replace("content", F.lit("<memory"), F.lit("&lt;memory")), F.lit("</memory"), F.lit("&lt;/memory"))
    grey = F.when(F.col("zone") == "hit", "").otherwise(" (grey, unverified)")
    told = F.col("provenance") if "provenance" in items.columns else F.lit("")
    line = F.concat(F.lit("--- slice "), F.col("doc_id").cast("string"), grey, F.lit(" ---\n"), told, body, F.lit("\n"))
    rows = F.sort_array(F.collect_list(F.struct((F.col("zone") != "hit").alias("g"), (-F.col("score")).alias("s"), "doc_id", line.alias("line"))))
    return items.groupBy(group).agg(F.concat(F.lit("<memory>\n"), F.array_join(F.transform(rows, lambda x: x["line"]), ""), F.lit("</memory>\n")).alias("text"))
