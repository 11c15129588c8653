"""Languages of texts by the letters that follow each other, learned from texts whose language is known."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of the table of letter triples, and the most languages a model may have.
CELLS, MOST = 1 << 16, 256
# fixed values: letters and different words that a guess needs, the least probability of a guess
LETTERS, WORDS, SURE = 40, 4, 0.6


def triples(text: str) -> np.ndarray:
    """Cells of the triples of letters of a text; all between two words is one sign."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.frombuffer(np.array([c.isalpha() for c in text.lower()], bool), bool) if len(points) else np.zeros(0, bool)
    points = np.where(letters, points, 32)
    points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])] if len(points) else points
    points = np.concatenate([[32], points, [32]]).astype(np.uint64)
    mix = (points[:-2] * np.uint64(0x9E3779B1) + points[1:-1]) * np.uint64(0x85EBCA77) + points[2:]
    return ((mix * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


class Model:
    """Logarithms of the share of each cell in each language, with half a count added."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        self.logs = np.log((counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)).astype(np.float32)

    def probabilities(self, text: str | None) -> np.ndarray:
        """Of each language; all equal for a text without letters."""
        cells = np.bincount(triples(text or ""), minlength=CELLS)
        at = np.flatnonzero(cells)
        score = self.logs[:, at].astype(np.float64) @ cells[at]
        share = np.exp(score - score.max())
        return share / share.sum()


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model of all rows whose language is known; a row for each language and cell at most comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(name, np.zeros(CELLS, np.int64))
                held[name] += np.bincount(triples(t), minlength=CELLS)
        for name, cells in held.items():
            at = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(cells[at])], ["lang", "cell", "n"])

    known = docs.select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l")).where("t is not null and l is not null")
    names = [r.l for r in known.select("l").distinct().limit(MOST + 1).collect()]
    if len(names) > MOST:
        raise ValueError(f"more than {MOST} languages")
    names.sort()
    counts = np.zeros((len(names), CELLS))
    found = known.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    counts[found["lang"].map({n: i for i, n in enumerate(names)}), found["cell"]] = found["n"]
    return Model(names, counts)


def guess(model: Model, text: Column | str) -> Column:
    """lang and probability of a text's most likely language; null for texts of fewer than 40 letters or four different words."""
    kept = model.names, model.logs

    @F.pandas_udf("lang string, probability double")
    def one(texts: pd.Series) -> pd.DataFrame:
        own = Model.__new__(Model)
        own.names, own.logs = kept
        out = []
        for t in texts:
            if sum(map(str.isalpha, t or "")) < LETTERS or not own.names:
                out.append((None, None))
                continue
            p = own.probabilities(t)
            out.append((own.names[int(p.argmax())], float(p.max())))
        return pd.DataFrame(out, columns=["lang", "probability"]).astype({"lang": "object", "probability": "float64"})

    from tideline.functions import text as T

    t = F.col(text) if isinstance(text, str) else text
    enough = F.size(F.array_distinct(T.words(F.coalesce(t, F.lit(""))))) >= WORDS
    return one(F.when(enough, t))


def mismatch(found: Column, body: Column | str, language: str) -> Column:
    """Whether a text is in another language than a project's: by its guess where that is sure, else by its share of letters of the project's script."""
    from tideline.functions import text as T

    code = language.lower().split("-")[0]
    script = {"ru": "Cyrillic", "en": "Latin"}.get(code)
    fallback = T.other_script(body, script) if script else F.lit(False)
    return F.when(found["probability"] >= SURE, found["lang"] != code).otherwise(F.coalesce(fallback, F.lit(False)))
