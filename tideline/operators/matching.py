"""Which video was made of which post: captions that hold a post's title, each video for one post."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from tideline.operators import graphs
from tideline.tables import written

# fixed values: characters of a title that a caption must hold, the fewest of them, seconds a video may be older than its post
KEY, LEAST, EARLY = 40, 10, 60
#: Runs of a title that are looked for, and bits of the table that says which those of all titles are.
RUNS, BITS = 3, 1 << 27


def plain(text: Column) -> Column:
    """Lower-case letters, digits and underscores with single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def runs(text: str | None) -> np.ndarray:
    """Hashes of the runs of LEAST characters of a text, in order; none of a shorter one."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(points) - LEAST + 1
    if n < 1:
        return np.empty(0, np.int64)
    mix = np.zeros(n, np.uint64)
    for k in range(LEAST):
        mix = (mix ^ points[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(32)
    return mix.view(np.int64)


@F.pandas_udf(ArrayType(LongType()))
def grams(texts: pd.Series) -> pd.Series:
    """The distinct runs() of each text."""
    return texts.map(lambda text: np.unique(runs(text)))


def _bits(parts: DataFrame) -> np.ndarray:
    """Two bits of a table of BITS for each gram, as longs: no more than 32 MB reach the driver, at any size."""
    places = parts.select(F.explode(F.array(F.col("gram").bitwiseAND(BITS - 1), F.shiftrightunsigned("gram", 32).bitwiseAND(BITS - 1))).alias("place"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(63).cast("int"))
    found = places.groupBy(F.shiftright("place", 6).cast("int").alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    table = np.zeros(BITS >> 6, np.int64)
    table[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return table


def _known(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """text_id, gram of the runs of captions that are a gram of parts.

    A table of bits drops nearly all others where they are made, so that a
    text's runs are neither held for a batch nor shuffled; a join decides.
    """
    table = texts.sparkSession.sparkContext.broadcast(_bits(parts))

    def has(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
        return (bits[place >> 6] >> (place & 63)) & 1 == 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            ids, found, size = [], [], 0
            for number, caption in zip(batch.column("text_id").to_pylist(), batch.column("caption"), strict=True):
                own = runs(caption.as_py())
                own = own[has(bits, own & (BITS - 1))]
                own = np.unique(own[has(bits, own >> 32 & (BITS - 1))])
                ids.append(np.full(len(own), number, np.int64))
                found.append(own)
                size += len(own)
                if size > 1 << 17:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(found))], ["text_id", "gram"])
                    ids, found, size = [], [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(found))], ["text_id", "gram"])

    return texts.select(F.col("text_id").cast("long").alias("text_id"), "caption").where("text_id is not null").mapInArrow(each, "text_id long, gram long").join(parts.select("gram").distinct(), "gram", "left_semi")


def holders(posts: DataFrame, videos: DataFrame) -> DataFrame:
    """key, key_id, text_id: the distinct titles (their first 40 characters, of ten at least) and the distinct captions that hold them.

    posts: post_id, title; videos: video_id, text. key_id and text_id are the least post and
    video with them. Of the runs of ten characters of a title, the RUNS that the fewest titles have are
    looked for in all captions; titles and captions meet by that of them which the fewest captions
    have, and are then compared.
    """
    keys = posts.select("post_id", F.substring(plain(F.col("title")), 1, KEY).alias("key")).where(F.length("key") >= LEAST)
    keys = written(keys.groupBy("key").agg(F.min("post_id").alias("key_id")), "keys")
    texts = written(videos.select("video_id", plain(F.col("text")).alias("caption")).groupBy("caption").agg(F.min("video_id").alias("text_id")), "captions")
    every = written(keys.select("key_id", F.explode(grams(F.col("key"))).alias("gram")), "runs")
    seldom = every.join(every.groupBy("gram").agg(F.count("*").alias("n")), "gram").groupBy("key_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "gram"))), 1, RUNS).alias("own"))
    parts = written(seldom.select("key_id", F.explode("own.gram").alias("gram")), "parts")
    known = written(_known(texts, parts), "grams")
    rare = parts.join(known.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left")
    # a title with a run that no caption has is in none
    rare = rare.groupBy("key_id").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.bool_or(F.col("n").isNull()).alias("none")).where("not none")
    pairs = rare.select("key_id", "gram").join(known, "gram").select("key_id", "text_id")
    both = pairs.join(keys, "key_id").join(texts, "text_id")
    return both.where(F.contains("caption", "key")).select("key", "key_id", "text_id")


def _choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Posts wait by title; a video takes the post that waits longest of those whose titles it holds."""
    now, waiting = None, {}
    for batch in batches:
        out = []
        for component, at, kind, number, key, keys in batch[["component", "at", "kind", "id", "key_id", "keys"]].itertuples(index=False):
            if component != now:
                now, waiting = component, {}
            if not kind:
                waiting.setdefault(int(key), deque()).append((at, number))
                continue
            heads = [(waiting[k][0], k) for k in map(int, keys) if waiting.get(k)]
            if heads:
                (_, post), k = min(heads)
                waiting[k].popleft()
                out.append((post, number))
        yield pd.DataFrame(out, columns=["post_id", "video_id"]).astype("int64")


def matched(posts: DataFrame, videos: DataFrame) -> DataFrame:
    """post_id, video_id: each post, in order of uploaded_at and post_id, takes the earliest video that no post before it took.

    posts: post_id, uploaded_at (seconds), title; videos: video_id, created_at, text.
    A video must hold the title's first 40 characters and be no older than a minute
    before the upload. Taking videos in their order, each by the earliest post that waits for
    it, gives the same choice, so titles and captions that are connected stream through
    one task in order of time, and only posts that wait are held. Null times are 0.
    """
    pairs = written(holders(posts, videos), "holders")
    edges = pairs.select((F.col("key_id") * 2).alias("u"), (F.col("text_id") * 2 + 1).alias("v"))
    found = written(graphs.components(edges), "parts")
    keyed = posts.select("post_id", F.coalesce(F.col("uploaded_at").cast("double"), F.lit(0.0)).alias("at"), F.substring(plain(F.col("title")), 1, KEY).alias("key")).join(pairs.select("key", "key_id").distinct(), "key")
    waiting = keyed.join(found, keyed.key_id * 2 == found.node).select("component", (F.col("at") - EARLY).alias("at"), F.lit(0).alias("kind"), F.col("post_id").alias("id"), "key_id", F.array().cast("array<bigint>").alias("keys"))
    held = pairs.groupBy("text_id").agg(F.collect_list("key_id").alias("keys"))
    texts = videos.select("video_id", F.coalesce(F.col("created_at").cast("double"), F.lit(0.0)).alias("at"), plain(F.col("text")).alias("caption"))
    firsts = texts.groupBy("caption").agg(F.min("video_id").alias("text_id")).join(held, "text_id")
    shown = texts.join(firsts, "caption").join(found, F.col("text_id") * 2 + 1 == found.node)
    shown = shown.select("component", "at", F.lit(1).alias("kind"), F.col("video_id").alias("id"), F.lit(0).cast("long").alias("key_id"), "keys")
    rows = waiting.unionByName(shown).repartition("component").sortWithinPartitions("component", "at", "kind", "id")
    return rows.mapInPandas(_choose, "post_id long, video_id long")
