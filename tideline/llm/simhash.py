"""SimHash near-duplicates: pigeonhole blocks find pairs within three bits, verified by Hamming distance.

64 bits are split into six blocks. Two fingerprints that differ in at most
three bits agree in three whole blocks at least, so they share one of the 20
keys made of three blocks (about 32 bits). Distinct fingerprints meet by key; a
bucket that is too large for one task is dealt again by three of six parts of
its remaining bits, at most twice, after which 512 fingerprints at most can
share a bucket, as masks of different parents that are the same are one bucket
and a fingerprint stands in it once; such a bucket is always linked, and rows left
over are an error. Inside a bucket all distances are computed, and links go on as
a spanning forest of the bucket, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import saved, sliced, text_of
from tideline.llm.components import Union, components

SEED, WORDS, DISTANCE, BLOCKS, BUCKET = 42, 3, 3, 6, 512
FREE = 9  # bits that a mask of the last round leaves free at most


def hashes(text: str, width: int) -> list[int]:
    """64-bit hashes of a text's shingles of so many words, lower-cased in A-Z; words stand between ASCII white space."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxh64_intdigest(joined, SEED)]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: 1 - width].tolist()
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]


def majority(hashed: list[int] | np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero of none."""
    if not len(hashed):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashed), 1 << 16):
        part = np.array(hashed[at : at + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashed), bitorder="little").view("<u8")[0])


def fingerprint(text: str) -> int:
    """The SimHash of 3-word shingles."""
    return majority(hashes(text, WORDS))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint's 64 bits as a long, for every whole text (null: empty, so zero)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 4 << 20):
            found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(each, "doc_id long, fp long")


@cache
def finer(mask: int) -> tuple[int, ...]:
    """Masks of mask's bits and three of six parts of the others."""
    free = [i for i in range(64) if not mask >> i & 1]
    parts = [sum(1 << int(i) for i in p) for p in np.array_split(free, BLOCKS)]
    return tuple(mask + sum(p) for p in combinations(parts, BLOCKS - DISTANCE))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        masks = batch.column("mask").to_numpy().view(np.uint64)
        for mask in np.unique(masks):
            own = fps[masks == mask]
            for m in finer(int(mask)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), m, np.uint64).view(np.int64)), pa.array((own & np.uint64(m)).view(np.int64)), pa.array(own.view(np.int64))], ["mask", "part", "fp"])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each bucket as u, v; of a larger bucket its members, with v null and the mask, to be dealt again."""
    held: list[np.ndarray] = []  # of the bucket that may go on: its members so far
    key, large = None, False

    def out(u: list, v: list, mask: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(mask, pa.int64())], ["u", "v", "mask"])

    def linked(members: np.ndarray) -> tuple[list, list]:
        union, x = Union(), members.view(np.uint64)
        near = np.bitwise_count(x[:, None] ^ x[None, :]) <= DISTANCE
        for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            union.link(int(members[i]), int(members[j]))
        return union.stars()

    for batch in batches:
        m, p, f = (batch.column(c).to_numpy() for c in ("mask", "part", "fp"))
        cuts = [0, *(np.flatnonzero((m[1:] != m[:-1]) | (p[1:] != p[:-1])) + 1).tolist(), len(m)] if len(m) else [0, 0]
        us, vs, ms = [], [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if key != (m[a], p[a]):
                if not large and (members := np.concatenate(held) if held else np.empty(0, np.int64)).size > 1:
                    u, v = linked(members)
                    us, vs, ms = us + u, vs + v, ms + [None] * len(u)
                held, key, large = [], (m[a], p[a]), False
            held.append(f[a:b])
            if large or sum(map(len, held)) > BUCKET and 64 - (int(m[a]) % (1 << 64)).bit_count() > FREE:
                large = True
                again = np.concatenate(held).tolist()
                us, vs, ms = us + again, vs + [None] * len(again), ms + [int(m[a])] * len(again)
                held = []
        yield out(us, vs, ms)
    if not large and held and (members := np.concatenate(held)).size > 1:
        u, v = linked(members)
        yield out(u, v, [None] * len(u))


def links(distinct: DataFrame) -> DataFrame:
    """Edges u, v whose components are those of all pairs of distinct fingerprints (column fp) within three bits."""
    level, found = distinct.select(F.lit(0).cast("long").alias("mask"), "fp"), None
    for turn in range(3):
        keyed = level.mapInArrow(_keys, "mask long, part long, fp long")
        if turn:
            keyed = keyed.distinct()  # different masks have finer masks in common
        dealt = saved(keyed.repartition("mask", "part").sortWithinPartitions("mask", "part").mapInArrow(_buckets, "u long, v long, mask long"), "links")
        edges = dealt.where("v is not null").select("u", "v")
        found = edges if found is None else found.unionAll(edges)
        level = dealt.where("v is null").select("mask", F.col("u").alias("fp"))
        if level.isEmpty():
            return found
    raise ValueError("buckets are left over after three rounds")


def clustered(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long) and component_id (the smallest doc_id reachable over links) of every row.

    Null text counts as empty, and empty texts share the fingerprint zero;
    repeated rows get equal rows; a null doc_id is never the smallest unless its
    whole component is null; no rows give no rows; other columns are not read.
    """
    fps = saved(fingerprints(docs), "simhash")
    distinct = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(links(distinct)).withColumnRenamed("node", "fp")
    classes = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(classes.join(smallest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hexadecimal(column: str):
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def kept(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, of which each component keeps the smallest doc_id (null ids stay)."""
    later = clustered(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(docs.columns)
