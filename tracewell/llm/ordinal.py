"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight for each hashed feature of a text gives a score, which all grades share; ordered thresholds cut
the score into grades: P(grade <= k) = sigmoid(threshold_k - score). So a text gets an expected grade, and
the chance of the top grade for selection.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Features are hashed into so many weights.
WIDTH = 1 << 18
#: The fit reads at most so many rated rows: those with the least hashes of their ids.
SAMPLE = 8_000
STEPS, RATE, DECAY = 600, 0.05, 1.0
#: A feature that fewer rated rows have keeps weight 0.
LEAST_ROWS = 8
#: A text is kept if the chance of the top grade is as high.
KEEP = 0.5
REMEMBERED = 200_000

# What is stripped off words.
STRIPPED = ".,;:!?#$%&*|<>\"'()[]{}"


#: Runs of signs, as they stand in a text.
_RUN = re.compile(r"[^\w\s]+")


class Model(NamedTuple):
    weights: np.ndarray
    thresholds: np.ndarray


@lru_cache(maxsize=REMEMBERED)
def _slot(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature.encode("utf-8", "surrogatepass")) % WIDTH


@lru_cache(maxsize=REMEMBERED)
def _word(word: str) -> int:
    return _slot("w:" + word.strip(STRIPPED).lower())


def _share(name: str, part: int, whole: int) -> int:
    return _slot(f"{name}:{min(10, 20 * part // max(1, whole))}")


def features(text: str | None) -> list[int]:
    """The slots of a text: its distinct words, and how large the shares of each run of signs, of repeats and capitals are.

    A null or empty text has the slots of shares only.
    """
    text = text or ""
    words = text.split()
    n, lines = len(words), text.split("\n")
    out = {_word(w) for w in set(words)}
    out.add(_slot(f"length:{n.bit_length()}"))
    out.update(_share(f"run:{run}", k, n) for run, k in Counter(_RUN.findall(text)).items())
    out.add(_share("again", sum(map(eq, words, words[1:])), n))
    out.add(_share("capitals", sum(map(str.isupper, words)), n))
    out.add(_share("lines", len(lines) - len(set(lines)), len(lines)))
    return sorted(out)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


class Rated(NamedTuple):
    """Rated rows: which row (rows) has which used feature (index), and each row's grade."""

    rows: np.ndarray
    index: np.ndarray
    grades: np.ndarray
    n_grades: int


def slope(rated: Rated, w: np.ndarray, free: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean negative log likelihood with its shrinkage, and its slopes by the weights and by `free`.

    free has the first threshold and the logarithms of the gaps to the next ones, so thresholds ascend whatever it is.
    """
    n, k, grades = max(1, len(rated.grades)), rated.n_grades - 1, rated.grades
    gaps = np.exp(free[1:])
    cuts = np.concatenate(([-np.inf], free[0] + np.concatenate(([0.0], gaps.cumsum())), [np.inf]))
    score = np.bincount(rated.rows, w[rated.index], len(grades))
    up, low = _sigmoid(cuts[grades + 1] - score), _sigmoid(cuts[grades] - score)
    p = np.maximum(up - low, 1e-12)
    dup, dlow = up * (1 - up) / p, low * (1 - low) / p
    by_score = (dup - dlow) / n
    by_cut = np.array([(-dup[grades == c].sum() + dlow[grades == c + 1].sum()) / n for c in range(k)])
    loss = -np.log(p).sum() / n + DECAY * (w @ w) / (2 * n)
    by_free = np.concatenate(([by_cut.sum()], [by_cut[j:].sum() * gaps[j - 1] for j in range(1, k)]))
    return loss, np.bincount(rated.index, by_score[rated.rows], len(w)) + DECAY * w / n, by_free


def fit(slots: list[np.ndarray], grades: np.ndarray, n_grades: int) -> Model:
    """Maximum likelihood with shrunk weights, by full-gradient steps of adapted size; no chance involved."""
    rows, index = np.repeat(np.arange(len(slots)), list(map(len, slots))), np.concatenate(slots) if slots else np.empty(0, np.int64)
    used, count = np.unique(index, return_counts=True)
    used = used[count >= LEAST_ROWS]
    seen = np.isin(index, used)
    rated = Rated(rows[seen], np.searchsorted(used, index[seen]), grades, n_grades)
    share = (np.bincount(grades, minlength=n_grades).cumsum()[: n_grades - 1] + 0.5) / (len(grades) + 1)
    first = np.log(share / (1 - share))
    x, m, v = np.concatenate((np.zeros(len(used)), first[:1], np.log(np.maximum(np.diff(first), 1e-3)))), 0.0, 0.0
    for t in range(1, STEPS + 1):
        g = np.concatenate(slope(rated, x[: len(used)], x[len(used) :])[1:])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    weights = np.zeros(WIDTH)
    weights[used] = x[: len(used)]
    free = x[len(used) :]
    return Model(weights, free[0] + np.concatenate(([0.0], np.exp(free[1:]).cumsum())))


def train(rated: DataFrame, n_grades: int, sample: int = SAMPLE) -> Model:
    """Fits a model to rows (slots, grade), at most `sample` of them; grades are 0 to n_grades - 1, others an error.

    The driver gets the slots, at most WIDTH numbers a row.
    """
    got = rated.select("slots", F.col("grade").cast("int").alias("grade")).limit(sample + 1).toArrow()
    if got.num_rows > sample:
        raise ValueError("more rated rows than the sample may have")
    grades = got["grade"].to_pylist()
    if any(g is None or not 0 <= g < n_grades for g in grades):
        raise ValueError(f"a grade isn't one of 0 to {n_grades - 1}")
    slots = got["slots"].to_pylist()
    order = sorted(range(got.num_rows), key=lambda i: (grades[i], slots[i]))
    return fit([np.array(slots[i], np.int64) for i in order], np.array([grades[i] for i in order], np.int64), n_grades)


def score(docs: DataFrame, model: Model, *keep: str, text: str = "text", least: float = KEEP) -> DataFrame:
    """The columns to keep, expected_grade, p_top (chance of the top grade) and kept. A null text counts as empty."""
    narrow = docs.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in narrow.dtypes[:-1])
    held = docs.sparkSession.sparkContext.broadcast(Model(model.weights.astype(np.float32), model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cuts = held.value
        for batch in batches:
            s = np.fromiter((weights[features(x.as_py())].sum(dtype=np.float64) for x in batch.columns[-1]), np.float64, batch.num_rows)
            above = 1 - _sigmoid(cuts[None, :] - s[:, None])
            cols = [pa.array(above.sum(axis=1)), pa.array(above[:, -1]), pa.array(above[:, -1] >= least)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=[*batch.schema.names[:-1], "expected_grade", "p_top", "kept"])

    return narrow.mapInArrow(run, f"{kinds}, expected_grade double, p_top double, kept boolean")


def rated(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text") -> DataFrame:
    """slots and grade of rated texts: quality, and one more where not toxic. Labels with a null are left out.

    The sample is drawn from the labels, so that it is small enough to send to every task; texts become slots where
    they are met, before the rows come together. Of an id's labels the least quality and the worst toxicity count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = pa.array([features(x.as_py()) for x in batch.column("_text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([slots, batch.column("_h"), batch.column("grade")], names=["slots", "_h", "grade"])

    some = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    one = docs.select("doc_id", F.col(text).alias("_text")).join(F.broadcast(some), "doc_id")
    one = one.select("_text", F.xxhash64("doc_id").alias("_h"), (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))
    return one.mapInArrow(run, "slots array<int>, _h long, grade int").orderBy("_h", F.xxhash64("slots")).limit(sample).select("slots", "grade")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(rated(docs, table(spark, sf_dir, "labels")), 3)
    return score(docs, model, "doc_id")
