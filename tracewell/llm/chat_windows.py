"""Chat formatting in budgeted windows.

Turns of a conversation get prefix sums of their tokens. Windows are turn-aligned spans that fit the budget:
the system turn is retained wherever it and the window's first new turn fit, a window after the first repeats up to
HISTORY of the turns before it, and each assistant turn is a target once: where it is repeated, the loss mask leaves
it out.

A conversation is cut at the turns where its prefix sum passes multiples of SEGMENT budgets. Segments are windowed
alone, so one very long conversation spreads over tasks; each gets the system turn and the turns that it may repeat.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import sentencepieces
from .common import FEW, stored, table

#: Tokens that a window holds, and turns and tokens that it may repeat.
BUDGET = 1_024
HISTORY = 2
HISTORY_TOKENS = 256
#: A turn's marks count as so many tokens.
MARK_TOKENS = 6
#: Budgets of tokens in a segment, and the most windows that a segment can have: each turn has MARK_TOKENS or more.
SEGMENT = 64

# The template's marks, and the beginnings and ends of control strings that texts may not hold.
OPEN, BODY, CLOSE = "<|turn|>", "<|text|>", "<|end|>\n"
CONTROL_STRINGS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

# A control string in a text gets a backslash after its first character, one more where some stand there
# already; taking one away gives the text back.
_ENDS = "|".join(re.escape(c[1:]) for c in CONTROL_STRINGS)
_BARE = re.compile(rf"([<\[])(\\*)({_ENDS})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_ENDS})")


def escape(text: str) -> str:
    """The text without any of CONTROL_STRINGS, reversibly."""
    return _BARE.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    """What was escaped."""
    return _ESCAPED.sub(r"\1\2\3", text)


class Turn(NamedTuple):
    """A turn of a window: its number in the conversation and whether the loss counts its text."""

    number: int
    role: str
    text: str
    target: bool


def formatted(turns: list[Turn]) -> tuple[str, list[tuple[int, int]], list[int]]:
    """A window's string, the spans of it under the loss mask, and its turns' numbers."""
    out, mask, at = [], [], 0
    for t in turns:
        head, body = OPEN + escape(t.role) + BODY, escape(t.text)
        if t.target:
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), mask, [t.number for t in turns]


def parsed(window: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of a window's turns, the span in the window's code points."""
    out, at = [], 0
    while at < len(window):
        body = window.index(BODY, at)
        end = window.index(CLOSE, body)
        out.append((unescape(window[at + len(OPEN) : body]), unescape(window[body + len(BODY) : end]), body + len(BODY), end))
        at = end + len(CLOSE)
    return out


class _Windows:
    """Cuts one segment's turns, which come in order, into windows; holds one window and what the next may repeat."""

    def __init__(self, budget: int, history: int, history_tokens: int):
        self.budget, self.history_tokens = budget, history_tokens
        self.system: Turn | None = None
        self.kept = 0  # the system turn's tokens
        self.shown = False  # whether a window has had the system turn
        self.past: deque[tuple[Turn, int]] = deque(maxlen=history)
        self.span: list[Turn] = []
        self.head = self.sum = self.fresh = 0  # tokens of the system turn in this window and of the span; new turns in it

    def add(self, turn: Turn, cost: int, again: bool) -> list[tuple[list[Turn], int]]:
        """A turn; gives the windows that it closes, if any, with their tokens. again: it stands in an earlier segment too."""
        out: list[tuple[list[Turn], int]] = []
        if turn.number == 0 and turn.role == "system":
            self.system, self.kept, self.shown = turn, cost, again
            return out
        if not again:
            if not self.fresh or self.head + self.sum + cost > self.budget:
                out = [*self.rest(), *self.begin(cost)] if self.fresh else self.begin(cost)
            self.span.append(turn)
            self.sum += cost
            self.fresh += 1
        self.past.append((turn, cost))
        return out

    def begin(self, cost: int) -> list[tuple[list[Turn], int]]:
        """Starts a window whose first new turn has that cost; a system turn that no window has had and that doesn't fit is one of its own."""
        fits = self.system is not None and self.kept + cost <= self.budget
        alone = [([self.system], self.kept)] if self.system and not fits and not self.shown else []
        self.shown = True
        self.head, self.span, self.sum, self.fresh = self.kept if fits else 0, [], 0, 0
        for turn, n in reversed(self.past):
            if self.sum + n > min(self.history_tokens, self.budget - self.head - cost):
                break
            self.span.insert(0, turn._replace(target=False))
            self.sum += n
        return alone

    def rest(self) -> list[tuple[list[Turn], int]]:
        """The window as it is, if it has a new turn; else a system turn that no window has had."""
        if self.fresh:
            return [([self.system, *self.span] if self.system and self.head else self.span, self.head + self.sum)]
        return [([self.system], self.kept)] if self.system and not self.shown else []


_WINDOW = "window long, tokens long, n_turns int, text string, mask array<struct<start:int,end:int>>, turns array<long>"
_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.int64())]


def _costs(texts: list[str], model: bytes | None) -> list[int]:
    """Tokens of texts by the model, or an estimate without one, and their marks'."""
    if model is None:
        return [max(len(t.split()), -(-len(t) // 4)) + MARK_TOKENS for t in texts]
    return (sentencepieces.plain(model).counts(texts) + MARK_TOKENS).tolist()


def _segments(rows: DataFrame, size: int, history: int, model: bytes | None) -> DataFrame:
    """Adds _cost, _number (a turn's place in its conversation) and _segment; later segments get the system turn and the `history` turns before them (_again) too.

    Rows are dealt out by ranges of the whole order and summed up as they stream by. Only a range's first conversation
    goes on from the range before, so what comes before it is a row a range at most, and is broadcast.
    """
    conv, order = ["_none", "_conv"], ["turn", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, k, total = None, 0, 0
        for batch in batches:
            costs = _costs(batch.column("text").to_pylist(), model)
            places, sums = [], []
            for key, cost in zip(zip(*(batch.column(c).to_pylist() for c in conv), strict=True), costs, strict=True):
                if key != now:
                    now, k, total = key, 0, 0
                places.append(k)
                sums.append(total)
                k, total = k + 1, total + cost
            for name, x in (("_cost", costs), ("_k", places), ("_s", sums)):
                batch = batch.append_column(name, pa.array(x, pa.int64()))
            yield batch

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = rows.withColumn("_none", F.col("conv_id").isNull()).withColumn("_conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    dealt = named.repartitionByRange(n, *conv, *order).sortWithinPartitions(*conv, *order).withColumn("_p", F.spark_partition_id())
    kinds = ", ".join(f"`{c}` {t}" for c, t in dealt.dtypes)
    dealt = stored(dealt.mapInArrow(run, f"{kinds}, _cost long, _k long, _s long"))
    whole = dealt.groupBy(*conv, "_p").agg(F.count(F.lit(1)).alias("_n"), F.sum("_cost").alias("_sum"))
    upto = Window.partitionBy(*conv).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = whole.select(*conv, "_p", *[F.sum(c).over(upto).alias(c) for c in ("_n", "_sum")]).filter("_n > 0")
    met = dealt.join(F.broadcast(starts), [*conv, "_p"], "left")
    before = lambda c: F.coalesce(c, F.lit(0))
    out = met.select(*rows.columns, "_cost", *conv, (F.col("_k") + before("_n")).alias("_number"), F.floor((F.col("_s") + before("_sum")) / size).alias("_segment"), F.lit(False).alias("_again"))
    later = out.filter("_segment > 0").groupBy(*conv, "_segment").agg(F.min("_number").alias("_first"))
    given, system = out.drop("_segment", "_again"), "_number = 0 and role = 'system'"
    again = given.filter(system).join(later.drop("_first"), conv)
    if history:
        before = F.explode(F.sequence(F.greatest(F.col("_first") - history, F.lit(0)), F.col("_first") - 1)).alias("_number")
        past = stored(later.select(*conv, "_segment", before))  # `history` rows a segment
        few = past.limit(FEW + 1).count() <= FEW
        again = again.unionByName(given.filter(f"not ({system})").join(F.broadcast(past) if few else past, [*conv, "_number"]))
    return out.unionByName(again.withColumn("_again", F.lit(True)))


def windows(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS, model: bytes | None = None) -> DataFrame:
    """One row a window of conversations (conv_id, turn, role, text).

    text is the formatted window, mask its spans under the loss, turns the numbers of its turns in order of
    (turn, role, text), null turns first; tokens and n_turns count them; window ascends within a conversation.
    Tokens are pieces of the model, or else an estimate. A turn over the budget is a window of its own. A system turn
    that comes first is retained in each window in which it and the first new turn keep to the budget; where the
    first window hasn't room for it, it stands once in a window of its own before. Null roles and texts are empty; a null conv_id is one
    conversation; rows alike in all are turns each. A segment's rows go to one task sorted and stream through it,
    so no task holds more than a window, or the rows of one conversation alone.
    """
    size = SEGMENT * budget
    many = size // MARK_TOKENS + 2  # windows that a segment may have
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, number, out, chars = None, None, 0, [], 0

        def emit(found: list[tuple[list[Turn], int]]) -> None:
            nonlocal number, chars
            for turns, cost in found:
                text, mask, numbers = formatted(turns)
                out.append((key[0], key[1] * many + number, cost, len(turns), text, [{"start": a, "end": b} for a, b in mask], numbers))
                number, chars = number + 1, chars + len(text)

        def flush() -> pa.RecordBatch:
            nonlocal out, chars
            (ids, *cols), out, chars = list(zip(*out, strict=True)), [], 0
            return pa.RecordBatch.from_arrays([pa.array(ids, conv), *(pa.array(c, t) for c, t in zip(cols, _KINDS, strict=True))], names=["conv_id", *[x.split()[0] for x in _WINDOW.split(", ")]])

        for batch in batches:
            conv = batch.schema.field("conv_id").type
            for c, segment, turn, role, text, cost, again in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if now is None or (c, segment) != key:
                    if now is not None:
                        emit(now.rest())
                    key, now, number = (c, segment), _Windows(budget, history, history_tokens), 0
                emit(now.add(Turn(turn, role, text, role == "assistant"), cost, again))
                if chars > 4_000_000:
                    yield flush()
        if now is not None:
            emit(now.rest())
        if out:
            yield flush()

    role, text = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))
    cut = _segments(rows.select("conv_id", "turn", role, text), size, history, model)
    dealt = cut.repartition("_none", "_conv", "_segment").sortWithinPartitions("_none", "_conv", "_segment", "_number")
    return dealt.select("conv_id", "_segment", "_number", "role", "text", "_cost", "_again").mapInArrow(run, f"conv_id {kind}, {_WINDOW}")


_BACK = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def read_back(made: DataFrame) -> DataFrame:
    """One row a conversation, from its windows alone: turns and loss text as they come out of the strings.

    Each turn counts where it first stands; the mask's spans are unescaped and joined in order. A conversation's two
    digests are chains over all of it, so its windows stream through one task.
    """
    back = f"conv_id {made.schema['conv_id'].dataType.simpleString()}, {_BACK}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", *[x.split()[0] for x in _BACK.split(", ")]]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        conv, state, out = None, None, []

        def row() -> tuple:
            return (conv, state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"], state["windows"])

        def flush() -> pa.RecordBatch:
            nonlocal out
            (ids, *cols), out = list(zip(*out, strict=True)), []
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=names)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for c, text, mask, numbers in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        out.append(row())
                    conv, state = c, {"n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0, "windows": 0}
                for (role, body, *_), number in zip(parsed(text), numbers, strict=True):
                    if number == state["n"]:
                        state["n"] += 1
                        state["turns"].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for span in mask:
                    body = unescape(text[span["start"] : span["end"]])
                    state["loss_chars"] += len(body)
                    state["loss"].update(body.encode("utf-8", "surrogatepass"))
                state["chars"] += len(text)
                state["windows"] += 1
            if out:
                yield flush()
        if state is not None:
            out.append(row())
            yield flush()

    dealt = made.select("conv_id", "window", "text", "mask", "turns").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.drop("window").mapInArrow(run, back)


CONTROL = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(windows(rows, model=sentencepieces.read_model()))


#: formatted_chars depends on how the spans are cut, which SQL has no fold for here; the rest is compared in tests.
SQL = None
