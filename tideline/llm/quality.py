"""Quality by ordinal regression: cumulative logits over hashed text features.

P(grade >= k) = sigmoid(w.x - t_k) with one weight vector w for all grades and
ascending thresholds t_k. Features are shares of a text's words: hashed words,
hashed word shapes (runs of letters of one case, digits and marks), and the
share of words that repeat the word before them. A text's score is then a sum
over its words, and each worker remembers words' weights.

Ratings are graded from the labels: 0 for low quality, 1 for good but toxic
text, 2 for good text. Texts are selected by P(grade >= 1), so toxic text of
good quality is left to other operators.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import let_go, sliced, text_of

DIMENSIONS, REPEATS, MARKS = 1 << 15, 1 << 15, (1 << 15) + 1
SCORES = "doc_id long, expected_grade double, p_good double, p_best double, selected boolean"
_SHAPES = [(re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "X"), (re.compile(r"[a-zß-öø-ÿ]+"), "x"), (re.compile(r"\d+"), "9"), (re.compile(r"([^\sXx9])\1+"), r"\1\1")]


def shape(word: str) -> str:
    """The kinds of signs of a word in order, the first 16 of them: a feature of its beginning, beside the word itself."""
    for pattern, mark in _SHAPES:
        word = pattern.sub(mark, word)
    return word[:16]


def features(word: str) -> tuple[int, int]:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % DIMENSIONS, zlib.crc32(b"\x00" + shape(word).encode("utf-8", "surrogatepass")) % DIMENSIONS


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's features; the empty text has none but its own."""
    words = text.split()
    if not words:
        return np.array([MARKS]), np.array([1.0])
    held: Counter[int] = Counter()
    for w, n in Counter(words).items():
        for f in features(w):
            held[f] += n
    held[REPEATS] += sum(map(eq, words, words[1:]))
    at = np.fromiter(held, np.int64, len(held))
    return at, np.fromiter(held.values(), np.float64, len(held)) / len(words)


class Ordinal:
    """Weights and thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def fitted(rows: np.ndarray, at: np.ndarray, values: np.ndarray, grades: np.ndarray, top: int, penalty: float = 1e-4, rounds: int = 150) -> Ordinal:
    """Maximum likelihood with a small quadratic penalty, by accelerated gradient descent (Nesterov, restarted).

    rows, at, values: the feature matrix's entries. Thresholds are a first one and logarithms of steps, so they ascend.
    Grades that no row has leave thresholds at their start.
    """
    n, d = len(grades), DIMENSIONS + 2
    scale = 30.0  # shares of words are small
    values = values * scale
    shares = [np.clip((grades >= k).mean(), 1e-3, 1 - 1e-3) for k in range(1, top + 1)]
    start = np.log(1 / np.array(shares) - 1)
    first, steps = start[:1], np.log(np.maximum(np.diff(start), 0.1))
    theta = np.concatenate([np.zeros(d), first, steps])

    def thresholds(x: np.ndarray) -> np.ndarray:
        return x[d] + np.concatenate([[0.0], np.cumsum(np.exp(x[d + 1 :]))])

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        score = np.bincount(rows, values * x[at], n)
        t = thresholds(x)
        s = 1 / (1 + np.exp(np.clip(t[None, :] - score[:, None], -500, 500)))
        full = np.concatenate([np.ones((n, 1)), s, np.zeros((n, 1))], axis=1)
        p = np.maximum(full[np.arange(n), grades] - full[np.arange(n), grades + 1], 1e-12)
        slope = full * (1 - full)  # derivative of each tail by its argument
        upper, lower = slope[np.arange(n), grades], slope[np.arange(n), grades + 1]
        by_score = -(upper - lower) / p / n
        g = np.zeros_like(x)
        g[:d] = np.bincount(at, values * by_score[rows], d) + penalty * x[:d]
        by_t = np.array([((grades == k) * slope[:, k] / p - (grades == k - 1) * slope[:, k] / p).sum() / n for k in range(1, top + 1)])
        g[d] = by_t.sum()
        for j in range(1, top):
            g[d + j] = np.exp(x[d + j]) * by_t[j:].sum()
        return float(-np.log(p).mean() + penalty / 2 * (x[:d] ** 2).sum()), g

    x, y, momentum, rate = theta, theta, 1.0, 1.0
    value, _ = loss(x)
    for _ in range(rounds):
        here, g = loss(y)
        while True:
            new = y - rate * g
            there, _ = loss(new)
            if there <= here - rate / 2 * (g**2).sum() + 1e-12 or rate < 1e-6:
                break
            rate /= 2
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        if there > value:
            y, momentum = x, 1.0
            continue
        y = new + (momentum - 1) / following * (new - x)
        moved, x, value, momentum, rate = value - there, new, there, following, rate * 1.3
        if moved < 1e-7:
            break
    return Ordinal(x[:d] * scale, thresholds(x))


def grades_of(labels: DataFrame) -> DataFrame:
    """doc_id, grade of each labelled document; of several labels the worst counts, rows with nulls in doc_id or quality are left out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.coalesce(F.col("toxic").cast("int"), F.lit(0)).alias("toxic")).where("doc_id is not null and quality is not null")
    return rows.groupBy("doc_id").agg(F.min(F.when(F.col("quality") < 1, 0).when(F.col("toxic") > 0, 1).otherwise(2)).alias("grade"))


def fit(docs: DataFrame, labels: DataFrame, most: int = 5000, folds_out: int | None = 0) -> Ordinal:
    """The model, fitted on at most `most` labelled documents, those first by a hash of doc_id.

    Documents whose crc32(doc_id as text) mod 5 is folds_out are held out (None:
    none are). Without labels all texts score alike and are selected.
    """
    graded = grades_of(labels)
    if folds_out is not None:
        graded = graded.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != folds_out)
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 8 << 20):
            found = [vector(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.float64()))], ["grade", "at", "value"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select("grade", "text")
    table = rows.mapInArrow(each, "grade int, at array<long>, value array<double>").toArrow()
    grades = table.column("grade").to_numpy().astype(np.int64)
    if not len(grades) or grades.min() == grades.max():
        return Ordinal(np.zeros(DIMENSIONS + 2), np.array([-10.0, -9.0]))
    at, value = table.column("at").combine_chunks(), table.column("value").combine_chunks()
    rows_of = np.repeat(np.arange(len(grades)), np.diff(at.offsets.to_numpy()))
    return fitted(rows_of, at.flatten().to_numpy(), value.flatten().to_numpy(), grades, 2)


def scored(docs: DataFrame, model: Ordinal, least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, p_good (grade >= 1), p_best (grade >= 2), selected, for every whole text.

    Null text counts as empty and gets a score like any other; repeated rows get
    equal rows; a null doc_id stays null; no rows give no rows; other columns
    are not read.
    """
    weights, thresholds = model.weights.astype(np.float32), model.thresholds

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        own = Ordinal(weights, thresholds)
        of = weights.tolist()

        class Known(dict):
            def __missing__(self, word: str) -> float:
                if len(self) > 500_000:
                    self.clear()
                a, b = features(word)
                self[word] = found = of[a] + of[b]
                return found

        known = Known()
        get = known.__getitem__
        for batch in sliced(batches, "text", 8 << 20):
            scores = []
            for text in batch.column("text").to_pylist():
                words = text.split()
                scores.append((sum(map(get, words)) + of[REPEATS] * sum(map(eq, words, words[1:]))) / len(words) if words else of[MARKS])
            tails = own.tails(np.array(scores, np.float64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tails.sum(axis=1)), pa.array(tails[:, 0]), pa.array(tails[:, 1]), pa.array(tails[:, 0] >= least)], ["doc_id", "expected_grade", "p_good", "p_best", "selected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(each, SCORES)


def selected(docs: DataFrame, model: Ordinal, least: float = 0.5) -> DataFrame:
    """The documents, with all their columns, that the model selects (rows with a null doc_id stay)."""
    gone = scored(docs, model, least).where("not selected and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
