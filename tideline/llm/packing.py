"""Best-fit packing: documents cut into pieces and packed into sequences of a fixed number of tokens.

Bounded-space online best-fit: a fixed number of bins is open. A bitset keyed
by free space finds the fullest open bin that still takes a piece; if none
does, a new bin opens, for which the fullest open one closes when all are in
use. Pieces, not token ids, are shuffled, and each task packs a bounded number.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import saved, sliced, text_of
from tideline.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


class OpenBins:
    """Free space of the open bins, as a bitset over free space and the bins of each."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.open, self.made = capacity, most, 0, 0
        self.bits, self.by_free = 0, [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        found = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def put(self, size: int) -> tuple[int, int]:
        """The bin and the offset in it."""
        if room := self.bits >> size:
            free = size + (room & -room).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.open == self.most and size < self.capacity:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, bin_id = self.capacity, self.made
            self.made += 1
        left = free - size
        if left:
            self.by_free[left].append(bin_id)
            self.bits |= 1 << left
            self.open += 1
        return bin_id, self.capacity - free


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but for the first."""
    first = n - capacity * (math.ceil(n / capacity) - 1)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """A row for each piece of each document.

    Null text counts as empty, so it is one piece with the end id alone; a null
    doc_id stays null; repeated rows are cut each; no rows give no rows; other
    columns are not read.
    """

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocabulary, True), end_id.to_bytes(4, "little")
        for batch in sliced(batches, "text", 4 << 20):
            rows = []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), enc.encode_all(batch.column("text").to_pylist()), strict=True):
                ids = raw + end
                rows += [(doc_id, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(tokenize, PIECES)


def pack(found: DataFrame, capacity: int = 2048, open_bins: int = 1024, a_task: int = 65536) -> DataFrame:
    """Place pieces (any columns with `length`, 1 to capacity) into sequences: adds sequence_id and offset.

    Tasks of about `a_task` pieces pack on their own, so that no task grows with
    the input. Columns with those two names are replaced; null lengths are
    refused by an error; repeated rows are placed each; no rows give no rows.
    """
    found = found.drop("sequence_id", "offset")
    tasks = max(1, math.ceil(found.count() / a_task))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, bins = TaskContext.get().partitionId() << 36, OpenBins(capacity, open_bins)
        for batch in batches:
            put = [bins.put(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([base + b for b, _ in put], pa.int64()), pa.array([o for _, o in put], pa.int64())], [*batch.schema.names, "sequence_id", "offset"])

    return found.repartition(tasks).mapInArrow(place, schema)


def packed(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048, open_bins: int = 1024) -> DataFrame:
    """Pack whole documents.

    Null text counts as empty; repeated rows are packed each; a null doc_id
    stays null; no rows give no rows; other columns are not read.
    """
    return pack(saved(pieces(docs, vocabulary, end_id, capacity), "pieces"), capacity, open_bins)
