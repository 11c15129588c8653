"""Phrase collocations: frequent words as ids, n-grams as fixed-width keys, counted as runs of a range-partitioned sort.

1. Tasks cut their texts into words and write each chunk of a language (about
   CHUNK bytes) as numbers of the chunk's own list of words, with the list and its
   counts beside it. Lists are summed into the corpus' counts; words that are
   frequent enough get an id of 48 bits, all others break pieces, as no frequent
   phrase can hold them. Each chunk's list is joined with the ids and goes back to its
   chunk, so no task needs the whole dictionary and nothing is broadcast.
2. Pairs of ids are packed into keys of 12 bytes; a task sorts its keys by radix
   passes of 16 bits, counts runs, and writes keys with counts. Keys are then
   range-partitioned and sorted, and runs of equal keys are summed as they stream by.
   A very common pair is one row for each task, so no range is hot.
3. Triples likewise in 18 bytes, where both pairs may be frequent: a table of bits
   of fixed size (SPOTS bits) says so for every pair. It may say yes too often,
   which only costs rows: counts stay exact.
4. Scores are decimals of 38 digits, divided as whole numbers.

Null texts are empty, a null language is `und`; repeated rows count as often as
they stand there; texts without words give nothing; an empty table gives no rows;
other columns are not read. Ties of the ranking are settled by the phrase's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tideline.llm.common import let_go, numbered, saved, sliced, text_of

LEAST, TOP, SHARE = 10, 2000, 50
CHUNK, HELD = 8 << 20, 4 << 20  # bytes of text in a chunk; keys that a task holds before it counts them
SPOTS = 1 << 27  # bits of the table of pairs
PARTS = 16  # of a language, ranked by themselves first
#: What a byte is: 0 part of a word, 1 between words, 2 between pieces.
KIND = np.zeros(256, np.uint8)
KIND[list(b" \t")] = 1
KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
FIRST = np.uint32(1 << 31)  # the mark of a piece's first word
WIDTHS = {2: 12, 3: 18}


def worded(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of a text, lower-cased in A-Z, and whether each is its piece's first."""
    data = LOWER[np.frombuffer(text, np.uint8)]
    kind = KIND[data]
    inside = kind == 0
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    return words, np.diff(piece, prepend=-1) > 0


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk a row with its codes, and a row for each of its words."""
    let_go()
    number, held, size = TaskContext.get().partitionId() << 32, {}, 0
    names = ["chunk", "lang", "codes", "at", "word", "n"]

    def flushed() -> Iterator[pa.RecordBatch]:
        nonlocal number, size
        for lang in sorted(held):
            words, first = worded(b"\n".join(held[lang]))
            if not len(words):
                continue
            coded = words.dictionary_encode()
            codes = coded.indices.to_numpy().astype(np.uint32)
            counts = np.bincount(codes, minlength=len(coded.dictionary))
            codes[first] |= FIRST
            k = len(counts)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([lang]), pa.array([codes.tobytes()], pa.binary()), pa.array([None], pa.int32()), pa.array([None], pa.string()), pa.array([len(codes)])], names)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, number)), pa.array([lang] * k, pa.string()), pa.nulls(k, pa.binary()), pa.array(np.arange(k, dtype=np.int32)), coded.dictionary.cast(pa.string()), pa.array(counts.astype(np.int64))], names)
            number += 1
        held.clear()
        size = 0

    for batch in sliced(batches, "text", CHUNK // 4):
        langs = batch.column("lang")
        for lang in pc.unique(langs).to_pylist():
            texts = batch.column("text").filter(pc.equal(langs, lang))
            whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts.cast(pa.binary())), b"\n")[0].as_py()
            held.setdefault(lang, []).append(whole)
            size += len(whole)
        if size >= CHUNK:
            yield from flushed()
    yield from flushed()


def _placed(chunk: pa.Table, words: pa.Table) -> pa.Table:
    """A chunk's codes beside the ids of its words (0: too rare)."""
    codes = chunk.column("codes")
    if not len(codes):
        return pa.table({"codes": pa.array([], pa.binary()), "ids": pa.array([], pa.binary())})
    most = int((np.frombuffer(codes[0].as_py(), np.uint32) & ~FIRST).max()) + 1
    ids = np.zeros(most, np.int64)
    ids[words.column("at").to_numpy()] = words.column("id").to_numpy()
    return pa.table({"codes": codes.combine_chunks().cast(pa.binary()), "ids": pa.array([ids.tobytes()], pa.binary())})


def spot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bit of a pair of ids."""
    mix = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mix ^= mix >> np.uint64(29)
    return (mix * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % SPOTS


def packed(ids: list[np.ndarray]) -> np.ndarray:
    """Ids as rows of digits of 16 bits, three for each id, highest first."""
    return np.stack([(x >> s & 0xFFFF).astype(np.uint16) for x in ids for s in (32, 16, 0)], axis=1)


def radix_order(digits: np.ndarray) -> np.ndarray:
    """The order of rows of 16-bit digits, by radix passes from the last digit to the first."""
    order = np.arange(len(digits))
    for j in range(digits.shape[1])[::-1]:
        column = digits[order, j]
        if len(column) and column.min() != column.max():
            order = order[np.argsort(column, kind="stable")]
    return order


def run_starts(rows: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    return np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])) if len(rows) else np.empty(0, np.int64)


def _keys(width: int, bits):
    """Keys of a task's n-grams with their counts; bits: the table of pairs, for triples."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        digits = np.concatenate(held)
        digits = digits[radix_order(digits)]
        starts = run_starts(digits)
        counts = np.diff(np.append(starts, len(digits)))
        keys = digits[starts].astype(">u2").tobytes()
        offsets = np.arange(len(starts) + 1, dtype=np.int32) * WIDTHS[width]
        return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(keys)]), pa.array(counts.astype(np.int64))], ["key", "n"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        table = np.frombuffer(bits.value, np.uint8) if bits is not None else None
        held, size = [], 0
        for batch in batches:
            for codes, ids in zip(batch.column("codes"), batch.column("ids"), strict=True):
                codes = np.frombuffer(codes.as_buffer(), np.uint32)
                first = codes >= FIRST
                own = np.frombuffer(ids.as_buffer(), np.int64)[codes & ~FIRST]
                good = (own[:-1] > 0) & (own[1:] > 0) & ~first[1:]
                if table is not None:
                    at = np.flatnonzero(good)
                    bit = spot(own[at], own[at + 1])
                    good[at] = table[bit >> 3] >> (bit & 7).astype(np.uint8) & 1
                    good = good[:-1] & good[1:]
                at = np.flatnonzero(good)
                for k in range(0, len(at), HELD):
                    part = at[k : k + HELD]
                    held.append(packed([own[part + j] for j in range(width)]))
                    size += len(part)
                    if size >= HELD:
                        yield counted(held)
                        held, size = [], 0
        if size:
            yield counted(held)

    return each


def _runs(width: int, least: int):
    """Ids, count (and for pairs the bit) of the keys of a sorted range that stand there often enough."""
    names = ["a", "b", "c"][:width]

    def out(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        kept = counts >= least
        digits = keys[kept].view(">u2").astype(np.int64)
        ids = [digits[:, 3 * j] << 32 | digits[:, 3 * j + 1] << 16 | digits[:, 3 * j + 2] for j in range(width)]
        return pa.RecordBatch.from_arrays([*map(pa.array, ids), pa.array(counts[kept]), pa.array(spot(ids[0], ids[1]))], [*names, "n", "spot"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count = None, 0
        for batch in batches:
            column = batch.column("key")
            if not len(column):
                continue
            offset = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
            keys = np.frombuffer(column.buffers()[2], np.uint8)[offset : offset + len(column) * WIDTHS[width]].reshape(-1, WIDTHS[width])
            starts = run_starts(keys)
            counts = np.add.reduceat(batch.column("n").to_numpy(), starts)
            keys = keys[starts]
            if key is not None:
                if (keys[0] == key).all():
                    counts[0] += count
                else:
                    keys, counts = np.concatenate([key[None], keys]), np.concatenate([[count], counts])
            key, count = keys[-1].copy(), int(counts[-1])
            yield out(np.ascontiguousarray(keys[:-1]), counts[:-1])
        if key is not None:
            yield out(key[None], np.array([count]))

    return each


def counted(chunks: DataFrame, width: int, least: int, bits=None) -> DataFrame:
    """a, b(, c), n, spot of the n-grams of `width` ids that stand in the chunks often enough."""
    keys = saved(chunks.mapInArrow(_keys(width, bits), "key binary, n long"), "phrase-keys")
    names = ["a", "b", "c"][:width]
    runs = keys.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_runs(width, least), ", ".join(f"{c} long" for c in [*names, "n", "spot"]))
    return saved(runs, "phrase-counts")


def bit_table(pairs: DataFrame):
    """The table of bits of the pairs, as a broadcast value of SPOTS / 8 bytes."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for spots in batch.column("spots").to_pylist():
                block = np.zeros(1 << 15, np.uint8)
                block[np.array(spots, np.int64)] = 1
                made.append(np.packbits(block, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(made, pa.binary())], ["block", "bits"])

    table = np.zeros(SPOTS // 8, np.uint8)
    sets = pairs.groupBy(F.shiftright("spot", 15).alias("block")).agg(F.collect_set(F.col("spot").bitwiseAND((1 << 15) - 1).cast("int")).alias("spots"))
    for row in sets.mapInArrow(blocks, "block long, bits binary").toLocalIterator():
        table[row.block << 12 : row.block + 1 << 12] = np.frombuffer(row.bits, np.uint8)
    return pairs.sparkSession.sparkContext.broadcast(table.tobytes())


def score(a: str, part: str, rest: str) -> Column:
    """floor(1000000 * a * a / (part * rest)), exactly."""
    return F.expr(f"(cast({a} as decimal(16,0)) * cast({a} as decimal(16,0)) * cast(1000000 as decimal(7,0))) div (cast({part} as decimal(16,0)) * cast({rest} as decimal(16,0)))")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases of two or three words.

    a, l, r: occurrences of the phrase, its first part and the rest at the cut with
    the least score (at equal scores the first cut); n: the language's words.
    Phrases with fewer than `least` occurrences, and those inside a longer phrase that
    has `share` per cent of their occurrences or more, are left out.
    """
    if least < 1:
        raise ValueError("least is 1 or more")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))
    table = saved(texts.mapInArrow(_chunks, "chunk long, lang string, codes binary, at int, word string, n long"), "phrase-chunks")
    listed = table.where("word is not null").select("chunk", "lang", "at", "word", "n")
    totals = table.where("word is null").groupBy("lang").agg(F.sum("n").alias("words"))
    frequent = saved(listed.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "phrase-words")
    book = saved(numbered(frequent, ["lang", "word"], "at").select("lang", "word", "f", (F.col("at") + 1).alias("id")), "phrase-ids")
    ids = listed.select("chunk", "lang", "at", "word").join(book.select("lang", "word", "id"), ["lang", "word"]).select(F.col("chunk").alias("own"), "at", "id")
    chunks = table.where("word is null").select("chunk", "codes").groupBy("chunk").cogroup(ids.groupBy("own")).applyInArrow(_placed, "codes binary, ids binary")
    chunks = saved(chunks, "phrase-encoded")
    pairs = counted(chunks, 2, least)
    triples = counted(chunks, 3, least, bit_table(pairs)).drop("spot")
    pairs = pairs.drop("spot")

    f = book.select(F.col("id"), F.col("f"))
    named = lambda df, key, name: df.join(f.select(F.col("id").alias(key), F.col("f").alias(name)), key)
    two = named(named(pairs, "a", "l"), "b", "r")
    covers = triples.select("a", "b", "n").unionAll(triples.select(F.col("b").alias("a"), F.col("c").alias("b"), "n")).groupBy("a", "b").agg(F.max("n").alias("longer"))
    two = two.join(covers, ["a", "b"], "left").where(f"longer is null or 100 * longer < {int(share)} * n")
    two = two.select("a", "b", F.lit(None).cast("long").alias("c"), "n", "l", "r", score("n", "l", "r").alias("score"))
    three = named(named(triples, "a", "fa"), "c", "fc")
    three = three.join(pairs.select("a", "b", F.col("n").alias("ab")), ["a", "b"]).join(pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("bc")), ["b", "c"])
    three = three.withColumns({"s1": score("n", "fa", "bc"), "s2": score("n", "ab", "fc")})
    early = F.col("s1") <= F.col("s2")
    three = three.select("a", "b", "c", "n", F.when(early, F.col("fa")).otherwise(F.col("ab")).alias("l"), F.when(early, F.col("bc")).otherwise(F.col("fc")).alias("r"), F.least("s1", "s2").alias("score"))

    word = lambda key, name: book.select(F.col("id").alias(key), F.col("word").alias(name))
    both = two.unionAll(three).join(book.select(F.col("id").alias("a"), "lang", F.col("word").alias("x")), "a")
    order = [F.desc("score"), F.desc("n")]
    # first inside parts of a language, so that no task reads the first rows of all tasks
    best = both.withColumn("salt", F.pmod(F.xxhash64("a", "b", "c"), F.lit(PARTS)))
    for by in (["lang", "salt"], ["lang"]):
        best = best.withColumn("place", F.rank().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= top)
    best = best.join(word("b", "y"), "b").join(word("c", "z"), "c", "left").withColumn("phrase", F.concat_ws(" ", "x", "y", "z"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("n").alias("a"), "l", "r", F.col("words").alias("n"), "score")
