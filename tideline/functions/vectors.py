"""Vectors as arrays, MinHash signatures and the hashing embedder."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, LongType

PRIME, PERMUTATIONS, BANDS = (1 << 31) - 1, 64, 16


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 if either is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def distance(a: Column | str, b: Column | str) -> Column:
    """Cosine distance."""
    return 1 - cosine(a, b)


def dimensions(a: Column | str) -> Column:
    return F.size(_c(a))


def unit(a: Column | str) -> Column:
    """Length one; zero stays zero. The norm is bound by a lambda, so that it is taken once and not once a place."""
    scaled = lambda n: F.transform(_c(a), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))
    return F.get(F.transform(F.array(norm(a)), scaled), F.lit(0))


def best_aspect(vector: Column | str, aspects: Column | str) -> Column:
    """The greatest cosine to any aspect, clipped to 0 and 1."""
    return F.array_max(F.transform(_c(aspects), lambda a: F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(vector, a)))))


def mean_vector(df: DataFrame, by: list[str], vector: str, name: str = "centroid") -> DataFrame:
    """The mean of vectors by group, one partial sum a place and task."""
    at = df.select(*by, F.posexplode(vector).alias("_at", "_x")).groupBy(*by, "_at").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    return at.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda s: s["_x"]).alias(name))


@cache
def coefficients() -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Multipliers and offsets of the permutations: a seeded generator's first numbers below the prime."""
    import numpy as np

    r = np.random.RandomState(42)
    a = r.randint(1, PRIME, PERMUTATIONS, dtype=np.int64)
    b = r.randint(0, PRIME, PERMUTATIONS, dtype=np.int64)
    return tuple(a.tolist()), tuple(b.tolist())


def shingle_signature(text: str, k: int = 4):
    """The least of each permutation over crc32 values of a text's distinct k-grams; zeros for an empty text."""
    import zlib

    import numpy as np

    if not text:
        return np.zeros(PERMUTATIONS, np.int64)
    grams = {text[i : i + k] for i in range(max(1, len(text) - k + 1))}
    values = np.fromiter((zlib.crc32(g.encode("utf-8", "surrogatepass")) for g in grams), np.int64, len(grams))
    a, b = (np.array(x, np.int64)[:, None] for x in coefficients())
    return np.min([((a * values[i : i + 4096] + b) % PRIME).min(axis=1) for i in range(0, len(values), 4096)], axis=0)


@F.pandas_udf(ArrayType(LongType()))
def minhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Signatures of whole normalized texts."""
    for batch in texts:
        yield batch.map(lambda t: shingle_signature(t or ""))


def signature(text: Column | str) -> Column:
    from tideline.functions.text import normalized

    return minhash(normalized(text))


def signature_likeness(a: Column | str, b: Column | str) -> Column:
    """The share of equal places; 0 for a signature of zeros."""
    same = F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / PERMUTATIONS
    empty = F.forall(_c(a), lambda x: x == 0) | F.forall(_c(b), lambda x: x == 0)
    return F.when(empty, F.lit(0.0)).otherwise(same)


def bands(sig: Column | str) -> Column:
    """Keys of the bands of a signature; none for zeros."""
    rows = PERMUTATIONS // BANDS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(F.slice(_c(sig), i * rows + 1, F.lit(rows))).alias("key")))
    return F.when(F.exists(_c(sig), lambda x: x != 0), keys).otherwise(F.slice(keys, 1, 0))


@F.pandas_udf(ArrayType(FloatType()))
def hash_embedding(texts: pd.Series) -> pd.Series:
    """The hashing-trick vector of 256 places over the first five letters of words of three or more."""
    import hashlib
    import re

    import numpy as np

    def one(text: str | None):
        v = np.zeros(256, np.float32)
        for w in re.findall(r"\w{3,}", (text or "").lower()):
            h = int.from_bytes(hashlib.blake2b(w[:5].encode(), digest_size=8).digest(), "big")
            v[h % 256] += 1.0 if h >> 63 else -1.0
        n = float(np.linalg.norm(v))
        return v / n if n else v

    return texts.map(one)


@F.pandas_udf(ArrayType(DoubleType()))
def sentence_likeness(sentences: pd.Series, centroids: pd.Series) -> pd.Series:
    """The cosine of each sentence's hash_embedding to the row's centroid; 0 without a centroid."""
    import numpy as np

    embed = hash_embedding.func

    def one(texts, centroid):
        if texts is None:
            return None
        if centroid is None or not len(texts):
            return [0.0] * len(texts)
        c = np.asarray(centroid, np.float64)
        return (np.stack(list(embed(pd.Series(list(texts))))).astype(np.float64) @ (c / (np.linalg.norm(c) or 1.0))).tolist()

    return pd.Series([one(t, c) for t, c in zip(sentences, centroids, strict=True)])
