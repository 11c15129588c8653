"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters (lower case, white space as one space) may be
found with floor(rate * m) edits. It is split into that many pieces and one
more: wherever the item stands with so few edits, one piece stands unedited.
An item too short for an edit has to stand between word edges. An Aho-Corasick automaton finds all pieces in one pass over each whole
document, and Myers' bit-parallel distance verifies the item around each hit.
Test items go to the tasks in blocks of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tideline.llm.common import kept as remembered
from tideline.llm.common import sliced, text_of

RATE, BLOCK_CHARS = 0.08, 4 << 20
MATCHES = "doc_id long, item_id long, distance int, end long, item_chars int"


def normalized(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 of nearly equal length."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def best_match(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """The least distance of the item to any part of text, and the first end of such a part (Myers, 1999)."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    get = masks.get
    for i, c in enumerate(text):
        eq = get(c, 0)
        x = eq | minus
        d0 = (((x & plus) + plus) ^ plus) | x
        hp, hn = minus | ~(plus | d0) & full, plus & d0
        if hp & high:
            score += 1
        elif hn & high:
            score -= 1
        hp, hn = hp << 1 & full, hn << 1 & full
        plus, minus = hn | ~(d0 | hp) & full, hp & d0
        if score < best:
            best, end = score, i + 1
    return best, end


def _edge(text: str, at: int) -> bool:
    """Whether no word goes on at a place of a text."""
    return at <= 0 or at >= len(text) or not (text[at - 1].isalnum() and text[at].isalnum())


class Items:
    """A block of test items ready for search."""

    def __init__(self, rows: list[tuple[int, str]], rate: float):
        import ahocorasick

        by_text: dict[str, list[int]] = {}
        for item_id, text in rows:
            by_text.setdefault(normalized(text), []).append(item_id)
        by_text.pop("", None)
        self.texts, self.ids = list(by_text), list(by_text.values())
        self.budgets = [int(rate * len(t)) for t in self.texts]
        self.masks: dict[int, dict[str, int]] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (t, b) in enumerate(zip(self.texts, self.budgets, strict=True)):
            for offset, piece in pieces(t, b):
                found.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def _masks(self, k: int) -> dict[str, int]:
        if k not in self.masks:
            masks: dict[str, int] = {}
            for i, c in enumerate(self.texts[k]):
                masks[c] = masks.get(c, 0) | 1 << i
            self.masks[k] = masks
        return self.masks[k]

    def search(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, distance, end in the normalized text, item's characters) of each item within its budget."""
        if not self.texts:
            return
        text = normalized(text)
        starts: dict[int, set[int]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for k, offset in where:
                starts.setdefault(k, set()).add(last + 1 - size - offset)
        for k, found in starts.items():
            item, b = self.texts[k], self.budgets[k]
            m, best, end = len(item), b + 1, 0
            if not b:
                found = {s for s in found if _edge(text, s) and _edge(text, s + m)}
            windows: list[list[int]] = []
            for s in sorted(found):
                a, z = max(0, s - b), min(len(text), s + m + b)
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = z
                else:
                    windows.append([a, z])
            for a, z in windows:
                if z - a < m - b:
                    continue
                at = text.find(item, a, z)
                d, e = (0, at + m - a) if at >= 0 else best_match(self._masks(k), m, text[a:z])
                if d < best:
                    best, end = d, a + e
            if best <= b:
                for item_id in self.ids[k]:
                    yield item_id, best, end, m


def _block(rows: tuple[tuple[int, str], ...], rate: float) -> Items:
    """The automaton of a block, built once in each worker process."""
    return remembered(("items", hash(rows), len(rows), rate), lambda: Items(list(rows), rate))


def _blocks(rows: Iterator[Row], most: int) -> Iterator[tuple[tuple[int, str], ...]]:
    held, size = [], 0
    for r in rows:
        held.append((r.item_id, r.text))
        size += len(r.text)
        if size >= most:
            yield tuple(held)
            held, size = [], 0
    if held:
        yield tuple(held)


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document and test item found in it within the item's budget.

    Null or empty items match nothing and null texts count as empty; equal
    items each give a row; repeated documents give repeated rows; a null doc_id
    stays null; either table may be empty; other columns are not read.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).where("trim(text) <> ''")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    out = None
    for block in _blocks(items.toLocalIterator(), block_chars):

        def search(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            there = _block(block, rate)
            for batch in sliced(batches, "text", 8 << 20):
                found = [(d, *x) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for x in there.search(t)]
                cols = list(zip(*found, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)], ["doc_id", "item_id", "distance", "end", "item_chars"])

        part = rows.mapInArrow(search, MATCHES)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], MATCHES)


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents, with all their columns, in which no test item is found (a null doc_id: kept)."""
    return docs.join(matches(docs, benchmark, rate).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
