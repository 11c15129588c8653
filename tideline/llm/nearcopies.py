"""Near copies: documents whose sets of 5-word shingles reach a Jaccard similarity of 0.8, as components.

Equal sets are one node. First, SimHash: each set has a fingerprint of 64 bits,
the blocks of simhash.py link fingerprints within three bits, and each such link
is decided on the whole sets. At similarity 0.8 two fingerprints differ in about
ten bits and often in more than fifteen, where blocks are too short to be keys. So
what the fingerprints leave in several components meets in 32 bands of four MinHash
values (a pair at 0.8 shares no band once in twenty million, a closer one still
less often), and is decided on the whole sets too. Of every band bucket a hub is compared with all others and leaves the
bucket; what still stands in several components after two hubs is compared in
cells of two parts of a bucket, inside tasks, so that only links go on. No bucket is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import let_go, saved, sliced, text_of
from tideline.llm.components import Union, components
from tideline.llm.simhash import SEED, hashes, majority
from tideline.llm.simhash import links as blocks

WORDS, BANDS, ROWS, HUBS, PART = 5, 32, 4, 2, 256
FIELDS = "doc_id long, at long, node long, n long, fp long, keys array<long>, grams array<long>"


def near(n, m, common):
    """Jaccard similarity of 0.8 or more, in whole numbers."""
    return 9 * common >= 4 * (n + m)


def band_keys(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each set; the sets stand one after the other in values, none is empty."""
    rng = np.random.RandomState(SEED)
    salts, factors = (rng.randint(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    least = np.array([np.minimum.reduceat((values ^ s) * f, starts) for s, f in zip(salts, factors, strict=True)])
    least = least.reshape(BANDS, ROWS, len(starts))
    keys = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(starts), axis=1)
    for r in range(ROWS):
        keys = (keys ^ least[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.T


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, at (a number of the row), node (a hash of the shingle set), n, fp (the set's SimHash), keys and grams (the sorted set) of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        let_go()
        at = TaskContext.get().partitionId() << 40
        for batch in sliced(batches, "text", 1 << 20):
            sets = [np.unique(np.array(hashes(t, WORDS), dtype=np.uint64)) for t in batch.column("text").to_pylist()]
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            values = np.concatenate(sets)
            nodes = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64)
            fps = np.array([majority(s) for s in sets], dtype=np.uint64)
            full = sizes > 0
            keys = band_keys(values, (np.cumsum(sizes) - sizes)[full]) if full.any() else np.empty((0, BANDS), np.uint64)
            rows = [batch.column("doc_id"), pa.array(np.arange(at, at + len(sets))), pa.array(nodes.view(np.int64)), pa.array(sizes), pa.array(fps.view(np.int64)), _lists(np.ascontiguousarray(keys).ravel(), full * BANDS), _lists(values, sizes)]
            at += len(sets)
            yield pa.RecordBatch.from_arrays(rows, ["doc_id", "at", "node", "n", "fp", "keys", "grams"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(each, FIELDS)


def near_pairs(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of sets that are near: counts of common values from products of blocks of columns."""
    sizes = np.array([len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, often = np.repeat(np.arange(len(sets)), sizes), counts > 1
    row, column = row[often[column]], (np.cumsum(often) - 1)[column[often[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.int64)
    for start in range(0, int(often.sum()), 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        block = np.zeros((len(sets), 4096), np.float32)
        block[row[a:b], column[a:b] - start] = 1
        common += (block @ block.T).astype(np.int64)
    return np.nonzero(np.triu(near(sizes[:, None], sizes[None, :], common), 1))


def _cell(rows: pa.Table) -> pa.Table:
    nodes = rows.column("node").to_pylist()
    union = Union()
    for i, j in zip(*near_pairs([np.asarray(s.values) for s in rows.column("grams")]), strict=True):
        union.link(nodes[i], nodes[j])
    u, v = union.stars()
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def alike(nodes: DataFrame) -> DataFrame:
    """Pairs u, v of nodes (node, fp): each with the first node of its fingerprint, and first nodes whose fingerprints are linked within three bits."""
    firsts = saved(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("nodes")), "near-fps")
    same = nodes.join(firsts.where("nodes > 1"), "fp").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    side = lambda c: firsts.select(F.col("fp").alias(f"{c}_fp"), F.col("first").alias(c))
    linked = blocks(firsts.select("fp")).select(F.col("u").alias("u_fp"), F.col("v").alias("v_fp")).distinct()
    return same.unionAll(linked.join(side("u"), "u_fp").join(side("v"), "v_fp").select("u", "v"))


def decided(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs u, v whose whole sets (node, grams) are near."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("grams").alias("x")), "u").join(sets.select(F.col("node").alias("v"), F.col("grams").alias("y")), "v")
    return both.where(near(F.size("x"), F.size("y"), F.size(F.array_intersect("x", "y")))).select("u", "v")


def _rooted(state: DataFrame, found: DataFrame) -> DataFrame:
    """key, node, n and root of rows, the least node that each reaches over the links found so far."""
    roots = components(found).withColumnRenamed("node", "of")
    return state.join(roots, F.col("node") == F.col("of"), "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))


def links(keyed: DataFrame, sets: DataFrame, known: DataFrame) -> DataFrame:
    """known and further edges u, v whose components are those of known and all near pairs that share a key (keyed: key, node, n; sets: node, grams)."""
    state, found = _rooted(keyed, known), known
    for turn in range(HUBS + 1):
        hub = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("x"), "node", "n", "root")).alias("hub")
        open_keys = state.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size"), hub).where("lo <> hi")
        state = saved(state.join(open_keys.select("key", "size", "hub"), "key"), "near-open")
        if state.isEmpty():
            break
        if turn < HUBS:
            pairs = state.where("root <> hub.root and 5 * least(n, hub.n) >= 4 * greatest(n, hub.n)").select(F.col("node").alias("u"), F.col("hub.node").alias("v")).distinct()
            edges = decided(pairs, sets)
        else:
            parts = state.select("key", "node", F.ceil(F.col("size") / PART).cast("int").alias("parts"))
            parts = parts.withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), "parts").cast("int"))
            cells = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            cells = cells.select("node", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("cell"))
            edges = cells.join(sets, "node").groupBy("cell").applyInArrow(_cell, "u long, v long")
        edges = saved(edges, "near-links")
        found = found.unionAll(edges)
        if turn < HUBS:
            state = _rooted(state.where("node <> hub.node").drop("hub", "size", "root"), found)
    return found


def clustered(docs: DataFrame) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable over near pairs) of every row.

    Words stand between ASCII white space and are lower-cased in A-Z; a text of
    fewer than five words is one shingle. Null text counts as empty, and empty
    texts are near each other; a null doc_id is never the smallest unless its
    whole component is null; no rows give no rows; other columns are not read.
    """
    texts = saved(described(docs), "near-texts")
    nodes = saved(texts.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("at").alias("at"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.any_value("keys").alias("keys")), "near-nodes")
    pairs = saved(alike(nodes.select("node", "fp")), "near-alike")
    keyed = nodes.select(F.explode("keys").alias("key"), "node", "n", "at")
    shared = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")
    keyed = saved(keyed.join(shared, "key"), "near-keys")
    paired = pairs.select(F.col("u").alias("node")).unionAll(pairs.select(F.col("v").alias("node"))).distinct()
    wanted = keyed.select("at", "node").unionAll(nodes.join(paired, "node").select("at", "node")).distinct()
    sets = saved(texts.select("at", "grams").join(wanted, "at").select("node", "grams"), "near-sets")
    known = saved(decided(pairs, sets), "near-links")
    roots = components(links(keyed.drop("at"), sets, known))
    classes = nodes.select("node", "first").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    return texts.select("doc_id", "node").join(classes.join(smallest, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def kept(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, of which each component keeps the smallest doc_id (null ids stay)."""
    later = clustered(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(docs.columns)
