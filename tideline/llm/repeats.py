"""Repeated byte strings over a whole corpus, by a parse of the texts at content-defined triggers.

A rolling hash of `GRAM` bytes is taken at every byte; the least one among the
grams of each string of `length` bytes is a trigger. Equal strings hold the same
trigger at the same place, so a phrase (the trigger with all bytes that any such
string around it can reach) settles most of a repetitive corpus: the dictionary
of distinct phrases keeps the first occurrence of each, and in every later one
all strings are repeated. Distinct phrases that share a trigger are the edges of
repeated passages. Their strings stand at four ranges of distance before the
trigger, and those of a range share the bytes in their middle; where a hash of
these bytes is found in another phrase of the trigger too, the range's strings
are compared by two 64-bit rolling hashes. Strings are put in order by hash
instead of a suffix array, so that one shuffle brings equal ones together.

Before each shuffle a task keeps only its own first occurrence of each phrase
or string, so that a passage in a third of all documents has a row a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import saved, sliced, text_of

GRAM, RANGES, BITS, CHUNK, HELD = 20, 4, 16, 1 << 19, 2_000_000
_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_TABLES = [np.random.default_rng(k).integers(0, 1 << 63, 256, np.uint64) * _U(2) + _U(1) for k in (1, 2)]


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        size, base = max(n, 1 << 16), int(_BASES[which])
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[which] = out[0], out[1]
    up, down = _POWERS[which]
    return up[:n], down[:n]


def _sums(data: np.ndarray, which: int) -> np.ndarray:
    up, _ = _powers(which, len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLES[which][data] * up, out=out[1:])
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xFF51AFD7ED558CCD)
    return x ^ (x >> _U(29))


def _hashes(sums: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice, which: int) -> np.ndarray:
    _, down = _powers(which, len(sums))
    return _mixed((sums[ends] - sums[starts]) * down[starts])


def _least(x: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """The least (or greatest) of each `width` neighbours, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def ranges(length: int) -> list[tuple[int, int]]:
    """Ranges of distances of a string's start before its trigger, from and to."""
    most = length - GRAM
    cuts = [most * k // RANGES for k in range(RANGES + 1)]
    return [(a + (k > 0), z) for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]


def phrases(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of each trigger of a text: its hash, its phrase's hash, its place, and BITS bits of each range's middle (0: no such strings)."""
    n, width, found = len(data), length - GRAM + 1, []
    for at in range(0, n - length + 1, CHUNK):
        a, e = max(0, at - width + 1), min(n, at + CHUNK + 2 * length)
        sums = _sums(data[a:e], 0)
        grams = _hashes(sums, slice(0, e - a - GRAM + 1), slice(GRAM, e - a + 1), 0)
        first, strings = at - a, min(CHUNK, n - length + 1 - at)  # the chunk's strings
        own = grams[first : first + strings + width - 1]
        least = _least(own, width)
        edge = np.zeros(width - 1, np.uint64)
        q = np.flatnonzero(own == _least(np.concatenate([edge, least, edge]), width, np.maximum)) + first
        lo, hi = np.maximum(0, q + a - width + 1), np.minimum(n, q + a + length)
        phrase = _hashes(sums, lo - a, hi - a, 0) + (q + a - lo).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F) + (hi - lo).astype(np.uint64) * _U(0x165667B19E3779F9)
        middles = np.zeros(len(q), np.uint64)
        for k, (near, far) in enumerate(ranges(length)):
            s, z = q + a - near, q + a + length - far
            fits = (s >= 0) & (z <= n)
            h = _hashes(sums, np.where(fits, s - a, 0), np.where(fits, z - a, 1), 0) >> _U(64 - BITS)
            middles |= np.where(fits, np.maximum(h, _U(1)), _U(0)) << _U(BITS * k)
        found.append((grams[q], phrase, q + a, middles))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.uint64))


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of documents, with those that touch made one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    group = np.cumsum(new) - 1
    # ends grow along a document; a document's offset keeps them apart from the one before
    base = np.concatenate([[0], np.cumsum(np.maximum.reduceat(end, np.flatnonzero(new)) + 2)])[group]
    reach = np.maximum.accumulate(end + base)
    cut = np.concatenate([[True], (start + base)[1:] > reach[:-1]]) | new
    at = np.flatnonzero(cut)
    return doc[at], start[at], np.maximum.reduceat(end, at)


ROWS = "a long, b long, doc_id long, pos long, more long"
_NAMES = ["a", "b", "doc_id", "pos", "more"]
#: Instead of a place: rows of settled spans and of asked strings, from b to more.
SPAN, ASKED = -1, -2


def _batch(*cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in cols], _NAMES)


def _spans(kind: int, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Spans as rows, dealt out by document."""
    doc, start, end = merged(doc, start, end)
    return _batch(_mixed(doc.astype(np.uint64)), start, doc, np.full(len(doc), kind), end)


class Firsts:
    """Keeps a task's first occurrence of each (a, b) and settles its later ones; `reach` gives what an occurrence covers."""

    def __init__(self, reach) -> None:
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size, self.reach = 0, reach

    def add(self, doc_id: int, found: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        a, b, pos, more = found
        if len(a):
            self.held.append((a, b, np.full(len(a), doc_id, np.int64), pos, more))
            self.size += len(a)
        if self.size >= HELD:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        a, b, doc, pos, more = (np.concatenate(c) for c in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        order = np.lexsort((pos, doc, b, a))
        a, b, doc, pos, more = (c[order] for c in (a, b, doc, pos, more))
        later = np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])])
        again = np.concatenate([[False], (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1])]) & later
        yield _batch(*(c[~later] for c in (a, b, doc, pos, more)))
        gone = later & ~again
        if gone.any():
            yield _spans(SPAN, doc[gone], *self.reach(pos[gone]))


def _blocks(batches: Iterator[pa.RecordBatch], least: int = 200_000, most: int = 1_000_000) -> Iterator[tuple[tuple[np.ndarray, ...], bool]]:
    """Columns of many rows, cut between values of a (True) unless one value has more than `most` rows."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy() for c in _NAMES))
        size += batch.num_rows
        if size < least:
            continue
        cols = tuple(np.concatenate(c) for c in zip(*held, strict=True))
        cut = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
        if cut:
            yield tuple(c[:cut] for c in cols), True
            cols = tuple(c[cut:] for c in cols)
        elif size >= most:
            yield cols, False
            cols = tuple(c[:0] for c in cols)
        held, size = [cols], len(cols[0])
    if size:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True)), True


def _settle(batches: Iterator[pa.RecordBatch], length: int, reach, expand: bool) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (a, b, doc_id, pos): spans of later occurrences, and with `expand` the strings of phrases that need to be compared."""
    before = None  # the last row: (a, b, doc, pos)
    lone = None  # the first phrase of the last trigger, while no other is known: (doc, pos, more)
    cuts = ranges(length)

    def asked(doc: np.ndarray, pos: np.ndarray, more: np.ndarray, shared: list[np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        parts = []
        for k, (near, far) in enumerate(cuts):
            has = (more.view(np.uint64) >> _U(BITS * k) & _U((1 << BITS) - 1)) != 0
            if shared is not None:
                has &= shared[k]
            parts.append((doc[has], np.maximum(0, pos[has] - far), pos[has] - near + 1))
        doc, start, end = (np.concatenate(c) for c in zip(*parts, strict=True))
        if len(doc):
            yield _spans(ASKED, doc, start, end)

    for cols, whole in _blocks(batches):
        done = cols[3] < 0
        if done.any():
            yield _batch(*(c[done] for c in cols))
            cols = tuple(c[~done] for c in cols)
        a, b, doc, pos, more = cols
        if not len(a):
            continue
        first = before if before is not None else (~a[0], b[0], doc[0], pos[0])
        pa_, pb, pd, pp = (np.concatenate([[f], c[:-1]]) for f, c in zip(first, (a, b, doc, pos), strict=True))
        same_a = a == pa_
        later = same_a & (b == pb)
        gone = later & ~((doc == pd) & (pos == pp))
        if gone.any():
            yield _spans(SPAN, doc[gone], *reach(pos[gone]))
        if expand:
            other = same_a & ~later  # a further phrase of the trigger
            heads = np.flatnonzero(~same_a)
            group = np.cumsum(~same_a)  # 0: goes on from the block before
            several = np.bincount(group[other], minlength=len(heads) + 1) > 0
            want = other.copy()
            want[heads[several[1:]]] = True
            shared = None
            if whole and not same_a[0] and want.any():
                shared, m = [], more[want].view(np.uint64)
                for k in range(RANGES):
                    key = (group[want].astype(np.uint64) << _U(BITS)) | (m >> _U(BITS * k) & _U((1 << BITS) - 1))
                    _, at, times = np.unique(key, return_inverse=True, return_counts=True)
                    shared.append(times[at] > 1)
            if want.any():
                yield from asked(doc[want], pos[want], more[want], shared)
            if lone is not None and several[0]:
                yield from asked(*(np.array([x]) for x in lone), None)
                lone = None
            if len(heads):
                h = heads[-1]
                lone = None if several[-1] else (doc[h], pos[h], more[h])
        before = a[-1], b[-1], doc[-1], pos[-1]


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text; a doc_id that is a long already keeps its name, so that Spark knows equal exchanges."""
    ids = "doc_id" if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    return docs.select(ids, text_of().alias("text"))


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id and spans (array of start, end in UTF-8 bytes) covered by strings of `length` bytes that also start earlier.

    A string starts earlier in a smaller doc_id or at a smaller place of the
    same document; strings never cross documents. A span may end beyond its
    text, and spans may overlap. Documents without such bytes have no row. Null
    and short texts have none; rows with a null doc_id are left out; rows that
    repeat a doc_id count as the same document, and spans of each hold for all;
    no rows give no rows; other columns are not read.
    """
    rows = _rows(docs).where("doc_id is not null")

    def around(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the strings around a trigger cover."""
        return np.maximum(0, pos - (length - GRAM)), pos + length

    def string(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return pos, pos + length

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = Firsts(around)
        for batch in sliced(batches, "text", 4 << 20):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                yield from firsts.add(doc_id, phrases(_bytes(text), length))
        yield from firsts.out()

    def dealt(found: DataFrame) -> DataFrame:
        return found.repartition("a").sortWithinPartitions("a", "b", "doc_id", "pos")

    settled = saved(dealt(rows.mapInArrow(parse, ROWS)).mapInArrow(lambda x: _settle(x, length, around, True), ROWS), "repeats")
    span = F.collect_list(F.struct(F.col("b").alias("start"), F.col("more").alias("end")))
    wanted = settled.where(F.col("pos") == ASKED).groupBy("doc_id").agg(span.alias("asked"))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = Firsts(string)
        for batch in sliced(batches, "text", 4 << 20):
            for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                data = _bytes(text)
                start, end = (np.array([s[k] for s in spans], np.int64) for k in ("start", "end"))
                _, start, end = merged(np.zeros(len(start), np.int64), start, np.minimum(end, len(data) - length + 1))
                for s, e in zip(start.tolist(), end.tolist(), strict=True):
                    for at in range(s, e, CHUNK):
                        z = min(e, at + CHUNK)
                        part, m = data[at : z + length - 1], z - at
                        h = [_hashes(_sums(part, k), slice(0, m), slice(length, m + length), k) for k in (0, 1)]
                        yield from firsts.add(doc_id, (h[0], h[1], np.arange(at, z), np.zeros(m, np.int64)))
        yield from firsts.out()

    opened = rows.join(wanted, "doc_id").select("doc_id", "text", "asked").mapInArrow(strings, ROWS)
    compared = dealt(opened).mapInArrow(lambda x: _settle(x, length, string, False), ROWS)
    spans = settled.where(F.col("pos") == SPAN).unionAll(compared)
    return spans.groupBy("doc_id").agg(span.alias("spans"))


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the bytes that remain, spans, for every row; see repeated_spans()."""
    rows = _rows(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 8 << 20):
            out = []
            for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                start, end = (np.array([s[k] for s in spans or ()], np.int64) for k in ("start", "end"))
                inside = start < len(data)
                _, start, end = merged(np.zeros(inside.sum(), np.int64), start[inside], np.minimum(end[inside], len(data)))
                kept, at = hashlib.sha256(), 0
                for s, e in zip(start.tolist(), end.tolist(), strict=True):
                    kept.update(data[at:s])
                    at = e
                kept.update(data[at:])
                out.append({"doc_id": doc_id, "n_bytes": len(data), "n_removed": int((end - start).sum()), "n_spans": len(start), "kept_sha256": kept.hexdigest(), "spans": [{"start": s, "end": e} for s, e in zip(start.tolist(), end.tolist(), strict=True)]})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    # the same exchange of texts by doc_id serves this join and the one in repeated_spans()
    joined = rows.where("doc_id is not null").join(repeated_spans(docs, length), "doc_id", "left").select("doc_id", "text", "spans")
    unknown = rows.where("doc_id is null").withColumn("spans", F.lit(None).cast("array<struct<start: long, end: long>>"))
    return joined.unionAll(unknown).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>")
