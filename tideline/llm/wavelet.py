"""Token ids in wavelet matrices: one succinct file for each shard of documents in doc_id order.

A file holds the documents' ids and lengths and, from the highest bit down, a
bit-plane of all tokens for each bit of the largest id; after each plane the
tokens go on with its zeros first, then its ones. With a count of ones every
512 bits, rank and select on the planes give the token at a place, the number
of a token's occurrences before a place, and the place of its k-th occurrence,
without decoding anything else.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import new_path, saved, sliced, text_of
from tideline.llm.files import created, opened, own_name
from tideline.llm.tokens import encoder

MAGIC, HEAD, SAMPLE = b"TLWM0001", struct.Struct("<8sQQI"), 512
FILES = "part int, seq int, path string, n_docs long, n_tokens long, n_bytes long"


def build(tokens: np.ndarray) -> tuple[list[int], list[bytes], list[bytes]]:
    """Zeros, bit-plane and samples of each level."""
    bits = max(1, int(tokens.max()).bit_length()) if len(tokens) else 1
    zeros, planes, samples = [], [], []
    now = tokens.astype(np.uint16 if bits <= 16 else np.uint32)
    padded = -(-len(now) // SAMPLE) * SAMPLE
    for level in range(bits - 1, -1, -1):
        ones = (now & now.dtype.type(1 << level)) != 0
        plane = np.zeros(padded // 8, np.uint8)
        packed = np.packbits(ones, bitorder="little")
        plane[: len(packed)] = packed
        counts = np.bitwise_count(plane.view(np.uint64)).reshape(-1, SAMPLE // 64).sum(axis=1, dtype=np.uint32)
        samples.append(np.concatenate([[0], np.cumsum(counts)]).astype("<u4").tobytes())
        planes.append(plane.tobytes())
        low = np.compress(~ones, now)
        zeros.append(len(low))
        now = np.concatenate([low, np.compress(ones, now)])
    return zeros, planes, samples


def encoded(doc_ids: list[int | None], lengths: np.ndarray, tokens: np.ndarray) -> bytes:
    """The whole file."""
    zeros, planes, samples = build(tokens)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    ids = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([HEAD.pack(MAGIC, len(doc_ids), len(tokens), len(planes)), ids.tobytes(), known.tobytes(), lengths.astype("<i8").tobytes(), np.array(zeros, "<u8").tobytes(), *(x for pair in zip(planes, samples, strict=True) for x in pair)])


class WaveletMatrix:
    """A shard's file, read where it is asked; `data` may be bytes or a memory map."""

    def __init__(self, data):
        magic, docs, self.n, self.bits = HEAD.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        at = HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, count, at)
            at += found.nbytes
            return found

        ids, known, self.lengths = take("<i8", docs), take("u1", docs), take("<i8", docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known, strict=True)]
        self.zeros = take("<u8", self.bits).tolist()
        blocks = -(-self.n // SAMPLE)
        self.planes, self.samples = [], []
        for _ in range(self.bits):
            self.planes.append(take("u1", blocks * SAMPLE // 8))
            self.samples.append(take("<u4", blocks + 1))

    def _rank1(self, level: int, i: int) -> int:
        block = i // SAMPLE
        part = self.planes[level][block * SAMPLE // 8 : i // 8]
        found = int(self.samples[level][block]) + int(np.bitwise_count(part).sum())
        return found + ((int(self.planes[level][i // 8]) & ((1 << i % 8) - 1)).bit_count() if i % 8 else 0)

    def _select(self, level: int, k: int, bit: int) -> int:
        """The place of the k-th (from 0) bit of this kind."""
        sample = self.samples[level].astype(np.int64)
        before = sample if bit else np.arange(len(sample)) * SAMPLE - sample
        block = int(np.searchsorted(before, k, side="right")) - 1
        part = np.unpackbits(self.planes[level][block * SAMPLE // 8 : (block + 1) * SAMPLE // 8], bitorder="little")
        return block * SAMPLE + int(np.flatnonzero(part == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        token = 0
        for level in range(self.bits):
            bit = int(self.planes[level][i // 8]) >> i % 8 & 1
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            token = token << 1 | bit
        return token

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            ra, rb = self._rank1(level, a), self._rank1(level, b)
            a, b = (self.zeros[level] + ra, self.zeros[level] + rb) if token >> self.bits - 1 - level & 1 else (a - ra, b - rb)
        return a, b

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """Occurrences in tokens a to b."""
        a, b = self._range(token, a, self.n if b is None else b)
        return b - a

    def locate(self, token: int, k: int) -> int:
        """The place of the token's k-th occurrence, from 0."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> self.bits - 1 - level & 1
            i = self._select(level, i - self.zeros[level] if bit else i, bit)
        return i

    def decode(self) -> np.ndarray:
        """All tokens, from the lowest plane up."""
        now = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            back = np.empty_like(now)
            zeros = self.zeros[level]
            back[np.flatnonzero(~ones)] = now[:zeros]
            back[np.flatnonzero(ones)] = now[zeros:] | now.dtype.type(1 << self.bits - 1 - level)
            now = back
        return now


def written(docs: DataFrame, vocabulary: str, end_id: int = 1, shard_tokens: int = 1 << 21) -> DataFrame:
    """Tokenize whole texts in ascending doc_id order and write them: a row for each file.

    Files of a part follow each other by seq, and parts by their number. A
    document is in one file. Null text counts as empty, null doc_ids come
    first, equal doc_ids are ordered by text, other columns are not read.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "wavelet")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end, seq = encoder(vocabulary, False), end_id.to_bytes(4, "little"), 0
        ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal ids, held, size, seq
            path = own_name(folder, "shard", f"-{seq:05d}.wm")
            data = encoded(ids, np.array([len(x) // 4 for x in held], np.int64), np.frombuffer(b"".join(held), "<u4"))
            with created(path) as f:
                f.write(data)
            row = {"part": TaskContext.get().partitionId(), "seq": seq, "path": path, "n_docs": len(ids), "n_tokens": size, "n_bytes": len(data)}
            ids, held, size, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

        for batch in sliced(batches, "text", 4 << 20):
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), enc.encode_all(batch.column("text").to_pylist()), strict=True):
                ids.append(doc_id)
                held.append(raw + end)
                size += len(raw) // 4 + 1
                if size >= shard_tokens:
                    yield close()
        if ids:
            yield close()

    order = [F.col("doc_id").asc_nulls_first(), F.col("text")]
    return saved(rows.repartitionByRange(tasks, order[0]).sortWithinPartitions(*order).mapInArrow(write, FILES), "wavelet-files")


def documents(files: DataFrame) -> DataFrame:
    """A row for each document, read back from the files: doc_id, start over all files, n_tokens, ids_crc32."""
    spark = files.sparkSession
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one row a writing task
    before, rows = 0, []
    for r in parts:
        rows.append((r.part, before))
        before += r.n
    bases = spark.createDataFrame(rows, "part int, base long")
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    placed = files.withColumn("within", within).join(F.broadcast(bases), "part").select("path", (F.col("base") + F.col("within")).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with opened(path) as f:
                    shard = WaveletMatrix(f.read())
                tokens, ends = shard.decode(), np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                raw = memoryview(tokens.astype("<u4")).cast("B")
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(start + starts), pa.array(shard.lengths), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def occurrences(files: DataFrame, token: int) -> DataFrame:
    """path and number of occurrences of a token in each file, counted on the planes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                with opened(path) as f:
                    found.append(WaveletMatrix(f.read()).count(token))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.int64())], ["path", "n"])

    return files.select("path").mapInArrow(count, "path string, n long")
