"""Toxicity of texts behind leetspeak, spacing and repetition.

A noisy channel: a disguised word, or a run of fragments of up to three letters
with the white space and marks between them, is one lattice: a sign may stand for
letters, a space or mark may end a word or be a filler, a letter of a run may be
a repetition. A Viterbi search finds the likeliest reading under a character
4-gram model of the whole corpus; it keeps every state (last three letters, so
27 ** 3 at most) and reads tokens and runs of any length. Plain numbers, words of
letters without doubled ones, and fragments of two or three letters that the model
holds for common words stand for themselves. Restored words are scored by their beginnings, inner
5-grams and whole forms, whose toxicity is counted on labelled documents; a
text's score is a logistic regression on its most toxic words, fitted on
labelled documents that took no part in the counting.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import saved, sliced, text_of

LETTERS, GRAM = 27, 4  # a to z, and 0 for all between words
CELLS, CUBE = LETTERS**GRAM, LETTERS ** (GRAM - 1)
TOP, EVIDENCE = 3, 1.5
#: A lone surrogate, which no text holds: no gram goes over it.
BORDER = "\udfff"
#: Signs of a token or run whose reading is remembered; longer ones are read each time.
KEPT_SIGNS = 64
#: The cost up to which a fragment is a common word.
COMMON = 8.0
# fixed values: what a sign may stand for
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¢": "c", "*": "aeiou", "#": "aeiou", "%": "", ".": "", "-": "", "_": "", "~": "", "^": "", "'": "", "`": "", ",": "", "/": "", "\\": "", ":": "", ";": "", "&": "", "=": "", "°": "o", "§": "s", "µ": "u", "ø": "o", "æ": "a"}
# fixed values: letters of other scripts that look like Latin ones
ALIKE = str.maketrans("авекмнорстухіјԁѕοαερτυνικ", "abekmhopctyxijdsoaeptuvik")
SUBSTITUTED, DROPPED, DOUBLED, REPEATED, KEPT, CLOSED = 1.0, 1.5, 4.0, 0.3, 6.0, 2.0
_LONG = re.compile(r"[^\W_]{4}")
_NUMBER = re.compile(r"[\W_]*\d[\d.,:/%+\-]*[\W_]*")
_SAME = re.compile(r"(.)\1*", re.DOTALL)
_RUNS = re.compile(b"\2{2,}")
_DOUBLE = re.compile(r"(.)\1")
_HIDDEN = re.compile("[­​-‏⁠﻿͏]")
_EDGE = ".,;:?\"'()[]{}<>…«»„“”‘’&%=-–—~^#*`/\\"


def _codes(limit: int = 0x250) -> np.ndarray:
    """Letter number of each code point: accents are dropped, all else is 0."""
    table = np.zeros(limit, np.uint8)
    for i in range(limit):
        base = unicodedata.normalize("NFKD", chr(i).lower())[:1]
        if "a" <= base <= "z":
            table[i] = ord(base) - 96
    return table


_CODES = _codes()
_CODE_OF = {chr(i): int(c) for i, c in enumerate(_CODES)}


def grams(texts: list[str]) -> np.ndarray:
    """Counts of 4-grams of letters inside each text, all between two words being one sign."""
    points = np.frombuffer(f" {BORDER} ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where(points == ord(BORDER), LETTERS, _CODES[np.minimum(points, len(_CODES) - 1)])
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])].astype(np.int32)
    if len(codes) < GRAM:
        return np.zeros(CELLS, np.int64)
    border = np.flatnonzero(codes == LETTERS)
    inside = np.ones(len(codes) - GRAM + 1, bool)
    for back in range(GRAM):
        at = border - back
        inside[at[(at >= 0) & (at < len(inside))]] = False
    index = ((codes[:-3] * LETTERS + codes[1:-2]) * LETTERS + codes[2:-1]) * LETTERS + codes[3:]
    return np.bincount(index[inside], minlength=CELLS)


def language_model(docs: DataFrame) -> np.ndarray:
    """4-gram counts over all documents: at most 27**4 numbers, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(CELLS, np.int64)
        for batch in batches:
            for part in sliced(iter([batch]), "text", 2 << 20):
                held += grams(part.column("text").to_pylist())
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at])], ["gram", "n"])

    found = docs.select(text_of().alias("text")).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS, np.float64)
    counts[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return counts


def log_model(counts: np.ndarray) -> list[np.ndarray]:
    """Negative log probabilities of a letter after 1, 2 and 3 others, each backed by the shorter context."""
    cube = counts.reshape([LETTERS] * GRAM)
    shorter, out = (cube.sum((0, 1, 2)) + 1) / (cube.sum() + LETTERS), []
    for order in (1, 2, 3):
        c = cube.sum(tuple(range(GRAM - 1 - order)))
        shorter = (c + 4 * shorter) / (c.sum(-1, keepdims=True) + 4)
        out.append((-np.log(shorter)).astype(np.float32))
    return out


class Decoder:
    """Restores words; `model` comes from log_model()."""

    def __init__(self, model: list[np.ndarray]):
        self.four = model[2].reshape(-1).tolist()
        self.first = model[0][0].tolist()  # after a word's edge
        self.second = model[1][0].reshape(-1).tolist()
        self.runs: dict[str, list] = {}

    def _options(self, word: str) -> list[list[tuple[str, float]]]:
        """What each sign may stand for, with its price; the empty string for nothing."""
        return [[(c, price) for c, price, _ in options] for options in self._coded(word)]

    def _coded(self, word: str) -> list[list[tuple[str, float, int]]]:
        """The same with the letter number of each; those of short runs of a sign are remembered."""
        out: list[list[tuple[str, float, int]]] = []
        runs = self.runs
        for m in _SAME.finditer(word):
            run = m[0]
            found = runs.get(run)
            if found is None:
                found = [[(c, price, _CODE_OF.get(c, 0)) for c, price in options] for options in self._run(run[0], len(run))]
                if len(run) < 8:
                    runs[run] = found
            out += found
        return out

    def _run(self, c: str, times: int) -> list[list[tuple[str, float]]]:
        repeated = DOUBLED if times == 2 else REPEATED
        if c == " ":
            first, more = [(" ", 0.0), ("", CLOSED)], [("", 0.0)]
        elif _CODE_OF.get(c, 0):
            first, more = [(c, 0.0)], [(c, 0.0), ("", repeated)]
        else:
            first = [*((x, SUBSTITUTED + 0.2 * k) for k, x in enumerate(SIGNS.get(c, ""))), (c, KEPT)]
            more = [*first, ("", REPEATED)]
            if not c.isalnum():
                first = [*first, ("", DROPPED)]
        return [first, *[more] * (times - 1)]

    def price(self, n: int, context: int, c: str) -> tuple[float, tuple[int, int]]:
        """The cost of a character after a state (letters so far up to 2, their code), and the state after it."""
        code = _CODE_OF.get(c, 0)
        if n == 0:
            return self.first[code], (1, code) if code else (0, 0)
        if n == 1:
            step, after = self.second[context * LETTERS + code], context * LETTERS + code
        else:
            step, after = self.four[context * LETTERS + code], (context * LETTERS + code) % CUBE
        return step, (2, after) if code else (0, 0)

    def word_cost(self, word: str) -> float:
        """The cost of a word as it stands, with both edges."""
        state, total = (0, 0), 0.0
        for c in [*word, " "]:
            step, state = self.price(*state, c)
            total += step
        return total

    def _best(self, word: str) -> tuple:
        first, second, four, edge = self.first, self.second, self.four, (0, 0)
        states: dict[tuple[int, int], tuple] = {edge: (0.0, None)}  # cost, and characters as links to those before
        for coded in [*self._coded(word), [(" ", 0.0, 0)]]:
            if len(states) == 1 and len(coded) == 1 and (only := coded[0])[0] != " ":  # one way only
                (((n, context), (cost, done)),) = states.items()
                c, price, code = only
                if n == 2:
                    at = context * LETTERS + code
                    total, key = cost + price + four[at], (2, at % CUBE) if code else edge
                elif n:
                    at = context * LETTERS + code
                    total, key = cost + price + second[at], (2, at) if code else edge
                else:
                    total, key = cost + price + first[code], (1, code) if code else edge
                states = {key: (total, (done, c))}
                continue
            following: dict[tuple[int, int], tuple] = {}
            get = following.get
            for state, (cost, done) in states.items():
                n, context = state
                for c, price, code in coded:
                    if not c or c == " " and not n:  # a second edge is none
                        key, total, link = state, cost + price, done
                    else:  # as price()
                        link = (done, c)
                        if n == 2:
                            at = context * LETTERS + code
                            total, key = cost + price + four[at], (2, at % CUBE) if code else edge
                        elif n:
                            at = context * LETTERS + code
                            total, key = cost + price + second[at], (2, at) if code else edge
                        else:
                            total, key = cost + price + first[code], (1, code) if code else edge
                    held = get(key)
                    if held is None or total < held[0]:
                        following[key] = (total, link)
            states = following
        return min(states.values(), key=lambda x: x[0])

    def cost(self, word: str) -> float:
        """The cost of the likeliest reading."""
        return self._best(word)[0]

    def restore(self, word: str) -> str:
        """The likeliest reading of a word or a run in lower case (Viterbi over the last three letters)."""
        link, out = self._best(word)[1], []
        while link:
            link, c = link
            out.append(c)
        return "".join(reversed(out)).strip()


def prepared(text: str) -> str:
    """A text in lower case, without invisible signs."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text)).translate(ALIKE) if not _latin(text) else _HIDDEN.sub("", text)
    return text.lower()


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return False


def core(token: str) -> str:
    """A token without marks at its edges, of which one that may be a letter stays."""
    token = token.strip(_EDGE)
    return token.rstrip("!") if token.endswith("!") else token


def marks_of(word: str) -> list[str]:
    """What a restored word is scored by: beginnings, inner 5-grams and the whole."""
    w = f"^{word}$"
    size = len(w)
    return [w, *[w[:n] for n in range(4, min(8, size))], *[w[i : i + 5] for i in range(1, size - 4)]]


class Reader:
    """Restored words of texts, and their toxicity; readings of tokens and runs are remembered."""

    def __init__(self, model: list[np.ndarray], weights: dict[str, float] | None = None, remembered: int = 400_000):
        self.decoder, self.weights, self.remembered = Decoder(model), weights, remembered
        reader = self

        class Known(dict):
            def __missing__(self, token: str):
                if len(self) > reader.remembered:
                    self.clear()
                words = reader.read(token)
                found = words if reader.weights is None else max((reader.weigh(w) for w in words), default=0.0)
                if len(token) <= KEPT_SIGNS:
                    self[token] = found
                return found

        class Short(dict):
            """0: no fragment, 1: a fragment of two or three letters that is a common word, 2: another, a single letter or a mark."""

            def __missing__(self, token: str) -> int:
                if len(self) > reader.remembered:
                    self.clear()
                word = core(token)
                if len(token) > 3 and _LONG.search(token):
                    found = 0
                elif len(word) > 1 and word.isalpha() and reader.decoder.word_cost(word) <= COMMON:
                    found = 1
                else:
                    found = 2
                self[token] = found
                return found

        self.known, self.short = Known(), Short()

    def units(self, text: str) -> set[str]:
        """A text's tokens; tokens of fragments that stand side by side are one."""
        return set(self.sequence(text))

    def sequence(self, text: str) -> list[str]:
        """The units in order."""
        tokens = prepared(text).split()
        kinds = bytes(map(self.short.__getitem__, tokens))
        if b"\2\2" not in kinds:
            return tokens
        out: list[str] = []
        at = 0
        for run in _RUNS.finditer(kinds):
            out += tokens[at : run.start()]
            out.append(" ".join(tokens[run.start() : run.end()]))
            at = run.end()
        return out + tokens[at:]

    def read(self, token: str) -> tuple[str, ...]:
        word = core(token)
        if not word or word.isalpha() and not _DOUBLE.search(word):
            return (word,) if word else ()
        if not any(c.isalpha() for c in word) and all(_NUMBER.fullmatch(x) for x in word.split()):
            return ()
        return tuple(x for x in re.split(r"[\W\d_]+", self.decoder.restore(word)) if x)

    def weigh(self, word: str) -> float:
        get = self.weights.get
        return max([get(m, 0.0) for m in marks_of(word)], default=0.0)

    def words(self, text: str) -> set[str]:
        known = self.known
        return {w for t in self.units(text) for w in known[t]}

    def top(self, text: str) -> list[float]:
        """A text's highest toxicities of different tokens, and the sum of the higher ones, as it is and against the text's length."""
        found = list(map(self.known.__getitem__, self.units(text)))
        high = sum(x for x in found if x > EVIDENCE)
        best = nlargest(TOP, found)
        return [*best, *[0.0] * (TOP - len(best)), math.log1p(high), high / math.sqrt(len(found) + 10)]


def restored(text: str, model: list[np.ndarray]) -> str:
    """A text's words as they are read."""
    reader = Reader(model)
    return " ".join(w for t in reader.sequence(text) for w in reader.known[t])


class Scorer:
    """All that a text's score needs."""

    def __init__(self, model: list[np.ndarray], weights: dict[str, float], coefficients: list[float]):
        self.model, self.weights, self.coefficients = model, weights, coefficients

    def score(self, top: list[float]) -> float:
        z = self.coefficients[0] + sum(a * b for a, b in zip(self.coefficients[1:], top, strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> list[float]:
    """Coefficients by Newton's method, the constant first."""
    a = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    b = np.zeros(a.shape[1])
    keep = penalty * np.eye(len(b))
    keep[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + keep, a.T @ (y - p) - keep @ b)
        b = b + step
        if np.abs(step).max() < 1e-6:
            break
    return b.tolist()


def fit(docs: DataFrame, labels: DataFrame, most: int = 30000) -> Scorer:
    """Fit on at most `most` labelled documents outside fold 0, those first by a hash of doc_id.

    Folds 1 to 3 count the toxicity of marks, fold 4 calibrates. Of several
    labels of a document the highest counts; null labels are left out. Without
    labels of both kinds all texts get the share of toxic labels (0 if none).
    """
    model = log_model(language_model(docs))
    graded = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    graded = graded.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold(F.col("doc_id")) != 0)
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "toxic", fold(F.col("doc_id")).cast("int").alias("fold"))
    rows = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select("toxic", "fold", "text"), "toxic-rows")
    sizes = {(r.calibrates, r.toxic): r.n for r in rows.groupBy((F.col("fold") == 4).alias("calibrates"), "toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = (sum(n for (c, t), n in sizes.items() if not c and (t > 0) == kind) for kind in (True, False))
    if not n1 or not n0:
        share = min(max(n1 / (n1 + n0), 1e-6), 1 - 1e-6) if n1 + n0 else 1e-6
        return Scorer(model, {}, [math.log(share / (1 - share)), *[0.0] * (TOP + 2)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        held: tuple[dict[str, int], dict[str, int]] = {}, {}

        def out() -> pa.RecordBatch:
            names = list(held[0].keys() | held[1].keys())
            found = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([h.get(m, 0) for m in names], pa.int64()) for h in (held[1], held[0]))], ["mark", "a", "b"])
            held[0].clear()
            held[1].clear()
            return found

        for batch in sliced(batches, "text", 8 << 20):
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                mine = held[1 if toxic > 0 else 0]
                for m in {m for w in reader.words(text) for m in marks_of(w)}:
                    mine[m] = mine.get(m, 0) + 1
            if len(held[0]) + len(held[1]) > 1_000_000:
                yield out()
        yield out()

    marks = rows.where("fold <> 4").select("toxic", "text").mapInArrow(count, "mark string, a long, b long").groupBy("mark").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    weight = F.log(a / (n1 + 1)) - F.log(b / (n0 + 1)) - F.sqrt(1 / a + 1 / b)
    weights = {r.mark: r.weight for r in marks.where("a >= 2").select("mark", weight.alias("weight")).where("weight > 0.5").toLocalIterator()}  # bounded by the sample

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model, weights)
        for batch in sliced(batches, "text", 8 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([reader.top(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))], ["toxic", "top"])

    table = rows.where("fold = 4").select("toxic", "text").mapInArrow(tops, "toxic int, top array<double>").toArrow()
    y = (table.column("toxic").to_numpy() > 0).astype(np.float64)
    if not 0 < y.sum() < len(y):
        return Scorer(model, weights, [math.log(n1 / n0) - 4.0, *[1.0] * TOP, 0.0, 0.0])
    return Scorer(model, weights, _logistic(np.array(table.column("top").to_pylist()), y))


SCORES = "doc_id long, held_out boolean, score double, predicted int"


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, held_out, score and predicted for every whole text.

    Null text counts as empty and gets the score of a text without toxic words;
    repeated rows get equal rows; a null doc_id stays null and is not held out;
    no rows give no rows; other columns are not read.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(scorer.model, scorer.weights)
        for batch in sliced(batches, "text", 8 << 20):
            ids = batch.column("doc_id").to_pylist()
            scores = [scorer.score(reader.top(t)) for t in batch.column("text").to_pylist()]
            held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(each, SCORES)
