"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

Leaves are sentences with all that follows them up to the next one, so the
leaves of a text, one after another, are the text: equal roots mean equal
texts. A paragraph ends with its line; a section ends with an empty line,
before a heading, or after a paragraph whose own digest says so (one in four),
so that an edit moves no boundary beyond its own section.

Every node is a 128-bit digest of those below it. A fingerprint is the whole root
and, for the branches, the beginnings of their digests (64 bits of sections and
paragraphs, 32 of sentences) with the sentences' sizes. The likeness of two
fingerprints needs no more than their strings; it goes down only where branches
differ.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import saved, sliced, text_of

_SENTENCE = re.compile(r"(?<=[.!?;:…。！？])\s+")
NODE_BYTES = 16
#: Bytes of a digest that a fingerprint shows of sections, paragraphs and sentences.
SHOWN = (8, 8, 4)


class Node(NamedTuple):
    digest: bytes
    size: int  # characters
    below: tuple


def _digest(kind: bytes, parts: list[bytes]) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=NODE_BYTES, person=kind).digest()


def _paragraph(line: str) -> Node:
    cuts = [0, *(m.end() for m in _SENTENCE.finditer(line)), len(line)]
    leaves = tuple(Node(_digest(b"leaf", [line[a:b].encode("utf-8", "surrogatepass")]), b - a, ()) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)
    return Node(_digest(b"par", [x.digest for x in leaves]), len(line), leaves)


def tree(text: str) -> Node:
    """The tree of a text; the empty text has a root and nothing below."""
    sections, held = [], []

    def close() -> None:
        if held:
            sections.append(Node(_digest(b"sec", [p.digest for p in held]), sum(p.size for p in held), tuple(held)))
            held.clear()

    for line in text.splitlines(keepends=True):
        if line.startswith("#"):
            close()
        held.append(p := _paragraph(line))
        if not line.strip() or p.digest[0] % 4 == 0:
            close()
    close()
    return Node(_digest(b"root", [s.digest for s in sections]), len(text), tuple(sections))


def fingerprint(node: Node) -> str:
    """root/section:par-leaf.size-leaf.size,par-leaf.size/section:... with digests in hexadecimal."""
    section, par, leaf = SHOWN
    out = [node.digest.hex()]
    for s in node.below:
        pars = ("".join([p.digest[:par].hex(), *(f"-{x.digest[:leaf].hex()}.{x.size}" for x in p.below)]) for p in s.below)
        out.append(f"{s.digest[:section].hex()}:{','.join(pars)}")
    return "/".join(out)


def parsed(shown: str) -> Node:
    """The tree that a fingerprint shows."""

    def of(digest: str, below: list[Node]) -> Node:
        return Node(bytes.fromhex(digest), sum(x.size for x in below), tuple(below))

    def paragraph(text: str) -> Node:
        digest, *leaves = text.split("-")
        return of(digest, [Node(bytes.fromhex(d), int(n), ()) for d, n in (x.split(".") for x in leaves)])

    def section(text: str) -> Node:
        digest, pars = text.split(":")
        return of(digest, [paragraph(x) for x in pars.split(",")])

    root, *sections = shown.split("/")
    return of(root, [section(x) for x in sections])


def likeness(a: Node, b: Node) -> float:
    """The share of both texts' characters in branches that are equal, as their fingerprints show them; only differing branches are opened."""
    if a.digest == b.digest:
        return 1.0
    if not a.size + b.size:
        return 1.0
    left, right, same = list(a.below), list(b.below), 0
    for width in SHOWN:
        there = Counter(x.digest[:width] for x in right)
        both, rest = Counter(), []
        for x in left:
            if there[key := x.digest[:width]] > both[key]:
                both[key] += 1
                same += x.size
            else:
                rest.append(x)
        left = [y for x in rest for y in x.below]
        kept = []
        for x in right:
            if both[key := x.digest[:width]]:
                both[key] -= 1
            else:
                kept.append(x)
        right = [y for x in kept for y in x.below]
    return 2 * same / (a.size + b.size)


def differing(a: Node, b: Node) -> list[tuple[int, int]]:
    """Character spans of a that stand in branches b lacks, at the lowest level."""
    if a.digest == b.digest:
        return []
    theirs = {x.digest for s in b.below for p in (s, *s.below) for x in (p, *p.below)}
    out, at = [], 0

    def walk(node: Node) -> None:
        nonlocal at
        if node.digest in theirs:
            at += node.size
        elif node.below:
            for x in node.below:
                walk(x)
        else:
            out.append((at, at + node.size))
            at += node.size

    for s in a.below:
        walk(s)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, root, fingerprint and the number of nodes of every whole text.

    Null text counts as empty; a null doc_id stays null; repeated rows give
    equal rows; other columns are not read.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 8 << 20):
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            trees = [tree(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([t.digest.hex() for t in trees]), pa.array([fingerprint(t) for t in trees]), pa.array([1 + sum(1 + len(s.below) for s in t.below) for t in trees], pa.int64())],
                ["doc_id", "n_chars", "root", "fingerprint", "n_nodes"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(each, "doc_id long, n_chars long, root string, fingerprint string, n_nodes long")


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_DIGEST = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compared(doc_id: int | None, text: str, mine: Node, following: str, theirs: Node) -> tuple:
    changed = edited(text, following)
    other = tree(changed)
    return doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(mine), fingerprint(other), likeness(mine, other), likeness(mine, theirs)


def compared_with_next(docs: DataFrame) -> DataFrame:
    """Each document against its own edited text and the next document by descending doc_id.

    The edited text has its last half replaced by the first half as many
    characters of the next document; after the smallest doc_id comes the
    largest. Texts go through one range exchange by doc_id. A task compares its
    neighbours; the first and last document of each task are written aside,
    and ends are joined with the beginnings that follow, two rows a task.

    Null text counts as empty; null doc_ids come last; rows with equal doc_id
    are ordered by text; a single document follows itself; no rows give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    dealt = rows.repartitionByRange(tasks, order[0]).sortWithinPartitions(*order)
    schema = _DIGEST + ", part int, kind string, text string"

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip([*_NAMES, "part", "kind", "text"], r, strict=True)) for r in done], schema=_arrow)

        for batch in sliced(batches, "text", 4 << 20):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                mine = tree(text)
                if last is None:
                    out.append((doc_id, *[None] * 6, part, "begins", text))
                else:
                    out.append((*_compared(*last, text, mine), part, "done", None))
                last = doc_id, text, mine
            if out:
                yield batch_of(out)
        if last is not None:
            yield batch_of([(last[0], *[None] * 6, part, "ends", last[1])])

    found = saved(dealt.mapInArrow(neighbours, schema), "merkle")
    ends = found.where("kind = 'ends'").select("doc_id", "part", "text")
    begins = found.where("kind = 'begins'").select("part", F.col("text").alias("next_text"))
    parts = sorted(r.part for r in begins.select("part").collect())  # one row a task
    following = spark.createDataFrame([(p, q) for p, q in zip(parts, [*parts[1:], *parts[:1]], strict=True)], "part int, next_part int")
    pairs = ends.join(F.broadcast(following), "part").join(begins.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "text", "next_text")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_compared(d, t, tree(t), n, tree(n)) for d, t, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r, strict=True)) for r in done], schema=pa.schema([_arrow.field(n) for n in _NAMES]))

    return found.where("kind = 'done'").select(*_NAMES).unionByName(pairs.mapInArrow(across, _DIGEST))


_arrow = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("kind", pa.string()), ("text", pa.string())])
