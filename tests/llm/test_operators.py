"""The corpus operators against brute force, round trips and held-out accuracy, with nulls, empty tables and odd rows."""

from __future__ import annotations

import difflib
import hashlib
import itertools
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import common, decontaminate, linededup, merkle, nearcopies, packing, quality, queries, repeats, simhash, tokens, toxicity, warc, wavelet

TOKENIZERS = os.path.dirname(queries.vocabulary("word_bpe_49k.json"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


#: Names that operators use for columns of their own.
CLASHES = ["words", "gone", "lines", "line", "line_no", "word", "levels", "key", "offset", "sequence_id", "piece", "length", "start", "fp", "component_id", "item_id", "found", "grade", "score", "shingles", "u", "v", "a", "b"]


def docs_of(spark, texts, start=0):
    rows = [(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and a column whose name an operator uses itself."""
    word = "lorem ipsum dolor sit amet consectetur "
    texts = [None, "", "   ", "\n\n", "a", word * 3, word * 3, word * 4000, "ä ö\x00ü " * 20]
    df = docs_of(spark, texts)
    more = spark.createDataFrame([(None, "x y z", None, None, None), (5, word * 3, "en", "s", 9)], DOCS)
    return df.unionAll(more).withColumn("w", F.lit(1)).withColumns({c: F.lit("clash") for c in CLASHES})


def sentences(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(7)
    return ["".join(rng.choice("abcdefgilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(400)]


def test_myers_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(200):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 20)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
        masks = {}
        for i, c in enumerate(item):
            masks[c] = masks.get(c, 0) | 1 << i
        row = list(range(len(item) + 1))
        best = row[-1]
        for c in text:
            new = [0]
            for i, d in enumerate(item):
                new.append(min(row[i] + (d != c), row[i + 1] + 1, new[i] + 1))
            row, best = new, min(best, new[-1])
        assert decontaminate.best_match(masks, len(item), text)[0] == best


def test_decontamination_finds_edited_items(spark, vocabulary):
    rng = random.Random(2)
    items = [sentences(rng, 30, vocabulary) for _ in range(12)]
    texts, expected = [], set()
    for i, item in enumerate(items):
        chars = list(item)
        for _ in range(int(decontaminate.RATE * len(item)) // 2):
            chars[rng.randrange(len(chars))] = rng.choice("xyz")
        texts.append(sentences(rng, 50, vocabulary) + "\n " + "".join(chars).upper() + " " + sentences(rng, 20, vocabulary))
        expected.add((i, i))
    texts += [sentences(rng, 80, vocabulary) for _ in range(10)]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, " ")], "item_id long, text string")
    found = decontaminate.matches(docs_of(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected
    small = decontaminate.matches(docs_of(spark, texts), bench, block_chars=300).collect()
    assert sorted(found) == sorted(small)
    assert {r.doc_id for r in decontaminate.clean(docs_of(spark, texts), bench).collect()} == set(range(12, 22))
    short = spark.createDataFrame([(1, "the"), (2, "the")], "item_id long, text string")
    whole = decontaminate.matches(docs_of(spark, ["another father", "Over the hill", "the", "", None]), short).collect()
    assert {(r.doc_id, r.item_id) for r in whole} == {(d, i) for d in (1, 2) for i in (1, 2)}
    odd = decontaminate.clean(odd_docs(spark), bench)
    assert odd.count() == odd_docs(spark).count() and odd.columns == odd_docs(spark).columns
    assert decontaminate.matches(odd_docs(spark), bench.limit(0)).count() == 0


def least_distance(item, text):
    """The least number of edits between an item and any part of a text, row by row."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination_is_all_items_against_all_documents(spark, vocabulary):
    """Items at every number of edits up to beyond their budget, alone, twice and beside others."""
    rng = random.Random(21)
    few = vocabulary[:25]
    items = [sentences(rng, rng.choice((1, 3, 6, 9)), few) for _ in range(14)]
    texts = [None, "", "a"]
    for item in items:
        budget = int(decontaminate.RATE * len(item))
        for edits in range(budget + 3):
            chars = list(item)
            for _ in range(edits):
                at = rng.randrange(len(chars))
                chars[at : at + 1] = rng.choice(([], [chars[at], "q"], ["q"]))
            around = [sentences(rng, rng.randint(0, 8), few) for _ in range(2)]
            texts.append(rng.choice((" ", "\n ")).join([around[0], "".join(chars), around[1]]) + rng.choice(("", " " + rng.choice(items))))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.distance for r in decontaminate.matches(docs_of(spark, texts), bench).collect()}
    want = {}
    for d, t in enumerate(texts):
        text = decontaminate.normalized(t or "")
        for i, item in enumerate(map(decontaminate.normalized, items)):
            budget = int(decontaminate.RATE * len(item))
            edges = [k for k in range(len(text) - len(item) + 1) if text[k : k + len(item)] == item and decontaminate._edge(text, k) and decontaminate._edge(text, k + len(item))]
            least = least_distance(item, text)
            if least <= budget and (budget or edges):
                want[d, i] = least
    assert found == want and len({i for _, i in want}) == len(items) and max(want.values()) >= 3


def likeness_by_force(a, b):
    """The share of characters in sections, else paragraphs, else sentences that both have, each as often as both have it."""
    if a.digest == b.digest or not a.size + b.size:
        return 1.0
    same, left, right = 0, list(a.below), list(b.below)
    for _ in range(3):
        for x in list(left):
            for y in right:
                if x.digest == y.digest:
                    same += x.size
                    left.remove(x)
                    right.remove(y)
                    break
        left, right = [z for x in left for z in x.below], [z for y in right for z in y.below]
    return 2 * same / (a.size + b.size)


def test_merkle(spark, vocabulary):
    rng = random.Random(3)
    texts = ["\n".join(sentences(rng, 12, vocabulary).capitalize() + "." for _ in range(rng.randint(0, 30))) for _ in range(25)] + [None, "", "same", "same"]
    rows = {r.doc_id: r for r in merkle.compared_with_next(docs_of(spark, texts)).collect()}
    plain = [t or "" for t in texts]
    order = sorted(range(len(plain)), reverse=True)
    for i, doc in enumerate(order):
        following = plain[order[(i + 1) % len(order)]]
        changed = merkle.edited(plain[doc], following)
        assert rows[doc].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert rows[doc].n_chars == len(plain[doc])
        assert rows[doc].fingerprint == merkle.fingerprint(merkle.tree(plain[doc]))
        mine = merkle.parsed(rows[doc].fingerprint)
        assert rows[doc].near_edited == likeness_by_force(mine, merkle.parsed(rows[doc].edited_fingerprint))
        assert rows[doc].near_next == likeness_by_force(mine, merkle.parsed(rows[order[(i + 1) % len(order)]].fingerprint))
    assert rows[27].fingerprint == rows[28].fingerprint and rows[28].near_next == 1.0
    for t in plain:
        assert merkle.tree(t).size == len(t) and sum(s.size for s in merkle.tree(t).below) == len(t)
    a, b = merkle.tree("One line. Two.\nThree here.\n"), merkle.tree("One line. TWO.\nThree here.\n")
    assert merkle.differing(a, b) == [(10, 15)] and 0.5 < merkle.likeness(a, b) < 1
    assert merkle.compared_with_next(odd_docs(spark)).count() == odd_docs(spark).count()
    assert merkle.compared_with_next(odd_docs(spark).limit(0)).count() == 0
    assert merkle.fingerprints(odd_docs(spark)).count() == odd_docs(spark).count()


def removed_by_force(texts, length):
    seen, out = set(), {}
    for doc, text in texts:
        b = text.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\x01" * length
            seen.add(s)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[doc] = (len(b), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_strings(spark, vocabulary, seed):
    rng = random.Random(seed)
    shared = [sentences(rng, rng.randint(8, 40), vocabulary) for _ in range(6)]
    texts = []
    for _ in range(40):
        parts = [rng.choice(shared) if rng.random() < 0.5 else sentences(rng, rng.randint(1, 30), vocabulary) for _ in range(rng.randint(0, 6))]
        texts.append("\n".join(parts))
    texts += ["ab" * 400, "x" * 1000, "é" * 300, texts[3], None]
    df = docs_of(spark, texts)
    for length in (100, 64):
        found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(df, length).collect()}
        assert found == removed_by_force([(i, t or "") for i, t in enumerate(texts)], length)
    assert repeats.without_repeats(odd_docs(spark)).count() == odd_docs(spark).count()
    assert repeats.without_repeats(odd_docs(spark).limit(0)).count() == 0


def test_repeats_in_chunks_and_blocks(spark, vocabulary, monkeypatch):
    rng = random.Random(9)
    text = sentences(rng, 400, vocabulary)
    data = np.frombuffer((text + text[500:1500]).encode(), np.uint8)
    whole = repeats.phrases(data, 100)
    monkeypatch.setattr(repeats, "CHUNK", 150)
    parts = repeats.phrases(data, 100)
    assert {x for x in zip(*(c.tolist() for c in whole), strict=True)} == {x for x in zip(*(c.tolist() for c in parts), strict=True)}


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = rng.integers(0, 50000 if n % 2 else 7, n).astype(np.uint32)
        w = wavelet.WaveletMatrix(wavelet.encoded([1], np.array([n]), ids))
        assert w.decode().tolist() == ids.tolist()
        for i in rng.integers(0, n, 20).tolist() if n else []:
            t = int(ids[i])
            where = np.flatnonzero(ids == t)
            assert w.access(i) == t and w.count(t) == len(where) and w.count(t, 0, i) == int((where < i).sum())
            k = int(np.searchsorted(where, i))
            assert w.locate(t, k) == i
        assert w.count(60000) == 0


def test_wavelet_files(spark, vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/word_bpe_49k.json")
    rng = random.Random(4)
    texts = [sentences(rng, rng.randint(0, 200), vocabulary) for _ in range(30)] + [None, "", "<|endoftext|> Ünïcode 12,5%"]
    files = wavelet.written(docs_of(spark, texts), f"{TOKENIZERS}/word_bpe_49k.json", shard_tokens=500)
    rows, start = {r.doc_id: r for r in wavelet.documents(files).collect()}, 0
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert wavelet.occurrences(files, 1).agg(F.sum("n")).first()[0] == len(texts)
    assert wavelet.documents(wavelet.written(odd_docs(spark), f"{TOKENIZERS}/word_bpe_49k.json")).count() == odd_docs(spark).count()


@pytest.mark.parametrize(("name", "joins"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_tokens_equal_the_library(name, joins):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/{name}")
    rng = random.Random(5)
    texts = ["", " ", "a  b", "don't it's", "İstanbul ẞ", "naïve é", "<|endoftext|> x", "a<|startoftext|>b <|endoftext|>", "<|ENDOFTEXT|>", "\x1c a"] + ["".join(rng.choice("ab É\n\t .,'!1́日ß ") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    e = tokens.PieceEncoder(f"{TOKENIZERS}/{name}", joins, remembered=500)
    for a in range(0, len(texts), 300):
        for text, ids in zip(texts[a : a + 300], e.encode_all(texts[a : a + 300]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_warc_round_trip(spark):
    pages = [(i, f"http://h/{i}", f"<html>{'body ' * (i % 5)}</html>" if i % 7 else None) for i in range(60)] + [(None, None, "alone"), (100, None, "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    files = warc.written(df, archive_bytes=2000)
    rows = {r.page_id: r for r in warc.read_back(files).collect()}
    assert len(rows) == len(pages) and files.count() > 1
    first = {}
    for page_id, _, html in sorted((p for p in pages if p[0] is not None), key=lambda p: p[0]):
        payload = (html or "").encode()
        origin = first.setdefault(payload, page_id)
        r = rows[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), warc.sha1_base32(payload))
        assert (r.record_type, r.refers_to) == (("response", None) if origin == page_id else ("revisit", origin))
    assert rows[None].record_type == "response"
    assert warc.read_back(warc.written(df.limit(0))).count() == 0
    large = warc.read_back(warc.written(df, least_bytes=10**6))
    assert large.where("record_type = 'revisit'").count() == 0


def test_simhash_components(spark, vocabulary):
    rng = random.Random(6)
    texts = []
    for _ in range(30):
        base = sentences(rng, 120, vocabulary).split()
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "edited"
            texts.append(" ".join(copy))
    texts += [None, "", "  ", "one", "one", "ONE"]
    rows = {r.doc_id: r for r in simhash.clustered(docs_of(spark, texts)).collect()}
    fps = {i: simhash.fingerprint(t or "") for i, t in enumerate(texts)}
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in fps:
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    for i in fps:
        assert rows[i].fp % (1 << 64) == fps[i] and rows[i].component_id == find(i)
    assert simhash.kept(docs_of(spark, texts)).count() == len({find(i) for i in fps})
    assert simhash.clustered(odd_docs(spark)).count() == odd_docs(spark).count()
    assert simhash.clustered(odd_docs(spark).limit(0)).count() == 0


def test_simhash_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 4)
    rng = random.Random(8)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 120:
        x = rng.choice(sorted(fps))
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    union = simhash.Union()
    for r in simhash.links(df).collect():
        union.link(r.u, r.v)
    brute = simhash.Union()
    for i, x in enumerate(signed):
        for y in signed[:i]:
            if ((x ^ y) % (1 << 64)).bit_count() <= 3:
                brute.link(x, y)
    assert {x: union.root(x) for x in signed} == {x: brute.root(x) for x in signed}


@pytest.mark.parametrize("part", [256, 3])
def test_near_dedup_takes_near_copies(spark, vocabulary, monkeypatch, part):
    """The stage against all pairs; in parts of three, most buckets go through cells."""
    import corpus_pipeline

    monkeypatch.setattr(nearcopies, "PART", part)
    monkeypatch.setattr(nearcopies, "HUBS", 3 if part > 3 else 0)
    rng = random.Random(18)
    texts = []
    for _ in range(25):
        base = sentences(rng, 150, vocabulary).split()
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += [None, "", "one two", "ONE two", "one three"]
    sets = [set(simhash.hashes(t or "", 5)) for t in texts]
    union = simhash.Union()
    near = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for i, j in near:
        union.link(i, j)
    assert sum(sets[i] != sets[j] for i, j in near) > 30
    expected = {i for i in range(len(texts)) if union.root(i) == i}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs_of(spark, texts), "").collect()} == expected
    assert nearcopies.clustered(odd_docs(spark)).count() == odd_docs(spark).count()
    assert nearcopies.clustered(odd_docs(spark).limit(0)).count() == 0


def test_near_copies_are_linked_by_simhash(spark, vocabulary):
    """Without any band in common, copies within three bits are linked; a pair of like fingerprints whose sets differ is not."""
    rng = random.Random(7)
    base = sentences(rng, 600, vocabulary).split()
    texts = [" ".join(base), " ".join([*base[:-1], "edited"]), sentences(rng, 600, vocabulary)]
    rows = {r.doc_id: r for r in nearcopies.described(docs_of(spark, texts)).collect()}
    assert ((rows[0].fp ^ rows[1].fp) % (1 << 64)).bit_count() <= simhash.DISTANCE < ((rows[0].fp ^ rows[2].fp) % (1 << 64)).bit_count()
    nodes = spark.createDataFrame([(r.node, r.fp) for r in rows.values()] + [(5, rows[2].fp)], "node long, fp long")
    sets = spark.createDataFrame([(r.node, r.grams) for r in rows.values()] + [(5, [1, 2, 3])], "node long, grams array<long>")
    pairs = nearcopies.alike(nodes)
    assert {frozenset(p) for p in pairs.collect()} == {frozenset((rows[0].node, rows[1].node)), frozenset((rows[2].node, 5))}
    known = nearcopies.decided(pairs, sets)
    none = spark.createDataFrame([], "key long, node long, n long")
    assert {frozenset(p) for p in nearcopies.links(none, sets, known).collect()} == {frozenset((rows[0].node, rows[1].node))}


def test_simhash_links_last_buckets(spark, monkeypatch):
    """All fingerprints over three bits: their buckets are over BUCKET in the last round too and must be linked."""
    monkeypatch.setattr(simhash, "BUCKET", 4)
    fps = list(range(8))
    union = simhash.Union()
    for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect():
        union.link(r.u, r.v)
    assert {union.root(x) for x in fps} == {0}
    masks = {m for a in simhash.finer(0) for b in simhash.finer(a) for m in simhash.finer(b)}
    assert max(64 - m.bit_count() for m in masks) == simhash.FREE


def lines_by_force(texts):
    lines = [(d, n, frozenset(w for w in line.lower().translate(str.maketrans("\t\r\x0b\x0c", "    ")).split(" ") if w)) for d, t in enumerate(texts) if t is not None for n, line in enumerate(t.split("\n"))]
    out, seen = set(), []
    for d, n, words in lines:
        if not words:
            continue
        if any(words == w for w in seen):
            out.add((d, n))
        elif any(5 * len(words & w) >= 4 * len(words | w) for w in seen):
            out.add((d, n))
        seen.append(words)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, vocabulary, seed):
    rng = random.Random(seed)
    bases = [sentences(rng, rng.randint(1, 30), vocabulary) for _ in range(25)]
    texts = []
    for _ in range(40):
        lines = []
        for _ in range(rng.randint(0, 8)):
            words = rng.choice(bases).split()
            for _ in range(rng.choice((0, 0, 1, 2, 3))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            lines.append(rng.choice((" ".join, "\t".join))(words) if rng.random() < 0.9 else "  ")
        texts.append("\n".join(lines))
        short = rng.sample(vocabulary[:12], rng.randint(3, 6))  # short lines that differ in a word more or less
        texts += [" ".join(short), " ".join(rng.sample(short, len(short) - 1))]
    texts += [None, "", "\n", "A b\tc", "c B a", "p q r s t", "s q p r", "f1 f2 f3 f4", "f4 f5 f3 f2 f1"]
    df = docs_of(spark, texts)
    found = {(r.doc_id, r.line_no) for r in linededup.removed(df).collect()}
    expected = lines_by_force(texts)
    assert found == expected
    cleaned = {r.doc_id: r for r in linededup.clean(df).collect()}
    for d, t in enumerate(texts):
        want = None if t is None else "\n".join(line for n, line in enumerate(t.split("\n")) if (d, n) not in expected)
        assert cleaned[d].text == want and (want is None or cleaned[d].n_chars == len(want))
    if seed == 1:
        odd = linededup.clean(odd_docs(spark))
        assert odd.count() == odd_docs(spark).count() and odd.columns == odd_docs(spark).columns


def test_line_dedup_frequent_lines_and_words(spark, vocabulary, monkeypatch):
    """One line and one word stand in a third of all rows, and a group of near copies has a chain of edits."""
    rng = random.Random(5)
    base = sentences(rng, 30, vocabulary).split()
    texts = [sentences(rng, 12, vocabulary) + "\nthe same line stands in many of these texts" for _ in range(25)]
    texts += ["everywhere " + sentences(rng, 9, vocabulary) for _ in range(25)]
    for _ in range(30):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    for i in range(20):  # each near to the one before it only
        base = base[2:] + [f"new{i}", f"word{i}"]
        texts.append(" ".join(base) + "\n\u00c4\u00d6 " + " ".join(base[::-1]).upper())
    expected = lines_by_force(texts)
    assert {(r.doc_id, r.line_no) for r in linededup.removed(docs_of(spark, texts)).collect()} == expected
    monkeypatch.setattr(linededup, "SMALL", 0)  # shuffled joins instead of broadcasts
    assert {(r.doc_id, r.line_no) for r in linededup.removed(docs_of(spark, texts)).collect()} == expected


def test_long_lines_without_likeness_make_no_pairs(spark):
    """Bitmaps of 64 bits are full for long lines: those that only share rare words passed them, ever more as lines became more."""
    r = random.Random(12)
    words = [f"w{i}" for i in range(2000)]
    lines = [r.sample(words, 200) for _ in range(120)]
    lines.append([*lines[7][:190], *lines[8][:10]])
    docs = docs_of(spark, [" ".join(x) for x in lines])
    pairs = linededup._pairs(linededup._firsts(linededup._texts(docs)), spark.createDataFrame([], "doc_id long, line_no int"))
    ids = [row.doc_id for row in docs.orderBy("doc_id").collect()]
    assert [(row.doc_id, row.y_doc) for row in pairs.collect()] == [(ids[120], ids[7])]
    assert [(row.doc_id, row.line_no, row.exact) for row in linededup.removed(docs).collect()] == [(ids[120], 0, False)]


def test_line_dedup_does_once_a_line_what_needs_no_word(spark):
    """Spark takes a column that is named once into the lambda that names it, and interprets what stands there for every word."""
    docs = docs_of(spark, ["a\tb \x0bc\r\fd e", "e  d c\x0bb\ta", "b a c d f", "a b c d  e\r"])
    plan = linededup._firsts(linededup._texts(docs))._jdf.queryExecution().executedPlan().toString()
    lambdas = [line for line in plan.split("\n") if "lambdafunction(" in line]
    assert lambdas and not any("LOG2" in line or "POWER" in line or "array_distinct" in line.split("sort_array(array_distinct(")[-1] for line in lambdas)
    assert not any(" AS levels" in line for line in lambdas)
    ids = [row.doc_id for row in docs.orderBy("doc_id").collect()]
    assert {(row.doc_id, row.exact) for row in linededup.removed(docs).collect()} == {(ids[1], True), (ids[3], True)}


def test_line_dedup_runs_no_python(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(linededup, "saved", lambda df, name: seen.append(df) or common.saved(df, name))
    seen.append(linededup.clean(docs_of(spark, ["a b c d e f", "a b c d e f", "x"])))
    assert len(seen) > 8
    for df in seen:
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("MapInArrow", "MapInPandas", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"))


def test_quality_learns_grades(spark, vocabulary):
    rng = random.Random(11)
    texts, labels = [], []
    for i in range(400):
        words = sentences(rng, rng.randint(20, 80), vocabulary)
        kind = rng.choice((0, 1, 2))
        texts.append("!! ".join(words.upper().split()) if kind == 0 else words.replace(" ", " badword ", 3) if kind == 1 else words)
        labels.append((i, int(kind > 0), int(kind == 1)))
    docs = docs_of(spark, texts)
    table = spark.createDataFrame([*labels, (None, 1, 0), (1, None, None), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, table)
    assert (np.diff(model.thresholds) > 0).all()
    rows = {r.doc_id: r for r in quality.scored(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([rows[i].selected == bool(labels[i][1]) for i in held]) > 0.97
    means = [np.mean([rows[i].expected_grade for i in held if labels[i][1] + (labels[i][1] and not labels[i][2]) == g]) for g in (0, 1, 2)]
    assert means == sorted(means)
    assert all(0 <= r.p_best <= r.p_good <= 1 for r in rows.values())
    odd = quality.selected(odd_docs(spark), model)
    assert odd.columns == odd_docs(spark).columns and quality.scored(odd_docs(spark), model).count() == odd_docs(spark).count()
    none = quality.fit(docs, table.limit(0))
    assert quality.selected(docs, none).count() == 400


def test_ordinal_gradient_finds_planted_weights():
    rng = np.random.default_rng(0)
    n = 600
    x = rng.normal(size=n)
    grades = (x + 0.3 * rng.logistic(size=n) > -0.5).astype(int) + (x + 0.3 * rng.logistic(size=n) > 0.8)
    model = quality.fitted(np.arange(n), np.zeros(n, np.int64), x / 30, grades, 2)
    assert model.weights[0] > 1 and model.thresholds[0] < model.thresholds[1]


def test_ordinal_fit_is_a_maximum_of_the_likelihood():
    """The cumulative-link likelihood, written out row by row, falls in every direction from what is fitted."""
    rng = np.random.default_rng(6)
    n, d = 120, 6
    x = rng.normal(size=(n, d)) / 10
    grades = np.clip(np.floor(x @ rng.normal(size=d) * 12 + rng.normal(size=n) + 1), 0, 2).astype(np.int64)
    rows, at = np.divmod(np.arange(n * d), d)
    model = quality.fitted(rows, at, x.reshape(-1), grades, 2, penalty=1e-3, rounds=4000)
    w, t = model.weights[:d], model.thresholds

    def cost(w, t):
        total = 0.0
        for i in range(n):
            tails = [1.0, *(1 / (1 + np.exp(b - x[i] @ w)) for b in t), 0.0]
            total -= np.log(tails[grades[i]] - tails[grades[i] + 1])
        return total / n + 1e-3 / 2 * ((w / 30.0) ** 2).sum()

    best = cost(w, t)
    assert t[0] < t[1] and not model.weights[d:].any()
    for _ in range(40):
        dw, dt = rng.normal(size=d) * 0.3, rng.normal(size=2) * 0.02
        assert cost(w + dw, t + dt) > best - 1e-6


def test_toxicity_reads_disguises(spark, vocabulary):
    rng = random.Random(12)
    bad = ["wretched", "grumpling", "snivelor"]
    texts, labels = [], []
    for i in range(600):
        words = sentences(rng, rng.randint(10, 60), vocabulary).split()
        toxic = i % 6 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
        labels.append((i, 1, int(toxic)))
    docs = docs_of(spark, texts)
    scorer = toxicity.fit(docs, spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int"))
    rows = {r.doc_id: r for r in toxicity.scored(docs, scorer).collect()}
    held = [r for r in rows.values() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows.values())
    assert np.mean([r.predicted == labels[r.doc_id][2] for r in held]) > 0.97
    assert toxicity.restored("Wr3tch3d gruuuumpl1ng s.n.i.v.e.l.o.r w r e t c h e d", scorer.model) == "wretched grumpling snivelor wretched"
    disguised = [texts[1] + " Wr3tch3d gruuuumpling $n1velor", texts[1] + " w r e t c h e d s-n-i-v-e-l-o-r grumpl!ng"]
    assert all(r.predicted == 1 for r in toxicity.scored(docs_of(spark, disguised), scorer).collect())
    assert toxicity.scored(odd_docs(spark), scorer).count() == odd_docs(spark).count()
    nothing = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.predicted for r in toxicity.scored(docs, nothing).collect()} == {0}


def test_language_model_grows_with_the_corpus(spark):
    few, many = (toxicity.language_model(docs_of(spark, ["abc def", "Äbc", None] * n)) for n in (1, 7))
    assert few.sum() > 0 and (many == 7 * few).all()
    assert toxicity.language_model(docs_of(spark, []).limit(0)).sum() == 0
    texts = ["abc def", "", "a", None, "ghij", "ab", "cd", " Ünd b\n"] * 3
    one, *others = (toxicity.language_model(docs_of(spark, texts).repartition(n)) for n in (1, 3, 8, 21))
    assert (one == sum(toxicity.grams([t or ""]) for t in texts)).all() and all((x == one).all() for x in others)


def test_viterbi_equals_a_full_search(vocabulary):
    """Every path of short lattices, with its cost from the model's tables."""
    rng = random.Random(8)
    model = toxicity.log_model(toxicity.grams([sentences(rng, 3000, vocabulary)]).astype(float))
    decoder = toxicity.Decoder(model)
    code = lambda c: ord(c) - 96 if "a" <= c <= "z" else 0

    def cost(text):
        total, before = 0.0, []
        for c in text:
            at = tuple(before[-3:]) if before else (0,)
            total += model[len(at) - 1][(*at, code(c))] if len(at) == 3 else model[1][0, before[0], code(c)] if len(before) == 1 else model[0][0, code(c)] if not before else model[2][0, before[0], before[1], code(c)]
            before = [*before, code(c)] if code(c) else []
        return total

    for _ in range(150):
        word = "".join(rng.choice("abce 1@$.l") for _ in range(rng.randint(1, 6))).strip() or "a"
        word = " ".join(word.split())
        best = min(price + cost("".join(path)) for path, price in paths(decoder._options(word) + [[(" ", 0.0)]]))
        assert abs(decoder.cost(word) - best) < 1e-3, word


def paths(options):
    """All readings: characters and the prices of their choice; an edge after an edge is dropped."""
    for chosen in itertools.product(*options):
        out = []
        for c, _ in chosen:
            if c and not (c == " " and (not out or out[-1] in " .1@$")):
                out.append(c)
        yield out, sum(p for _, p in chosen)


def test_toxicity_reads_spaced_and_repeated_text(vocabulary):
    rng = random.Random(9)
    words = [w for w in vocabulary if len(w) > 4]
    model = toxicity.log_model(toxicity.grams([sentences(rng, 20000, words)]).astype(float))
    right = lambda text, want: toxicity.restored(text, model).replace(" ", "") == want
    for w in words[:40]:
        assert right(" ".join(w), w) and right("_".join(w), w) and right(w[:3] + " " + w[3:5], w[:5])
        assert right("".join(rng.choice((" ", "-", ".", " . ")) + c for c in w), w)
    tripled = [w for w in words if not toxicity._DOUBLE.search(w)][:40]
    assert sum(right("".join(c * 3 for c in w), w) for w in tripled) >= 36
    long = "".join(words)[:200]
    leet = long.replace("o", "0").replace("e", "3")
    assert difflib.SequenceMatcher(None, toxicity.restored(leet, model).replace(" ", ""), long, autojunk=False).ratio() > 0.9
    assert toxicity.restored("12.5 455 2024-01-01 ... ***", model) == ""


def test_open_bins_are_best_fit():
    rng = random.Random(13)
    for most in (1, 3, 50):
        bins = packing.OpenBins(32, most)

        def now(bins=bins):
            return {b: free for free, found in enumerate(bins.by_free) for b in found}

        for _ in range(500):
            size, before = rng.randint(1, 32), now()
            b, offset = bins.put(size)
            after = now()
            assert len(after) <= most and bins.bits == sum({1 << f for f in after.values()})
            fits = [f for f in before.values() if f >= size]
            if fits:
                assert before[b] == min(fits) == 32 - offset and after.get(b, 0) == min(fits) - size
                assert {k: v for k, v in after.items() if k != b} == {k: v for k, v in before.items() if k != b}
            else:
                assert b not in before and offset == 0
                closed = [before[k] for k in before if k not in after]
                assert closed == ([min(before.values())] if len(before) == most and size < 32 else [])


def test_workers_keep_one_thing_at_a_time():
    a = tokens.encoder(f"{TOKENIZERS}/byte_bpe_50k.json", True)
    assert tokens.encoder(f"{TOKENIZERS}/byte_bpe_50k.json", True) is a
    common.kept(("other",), list)
    assert tokens.encoder(f"{TOKENIZERS}/byte_bpe_50k.json", True) is not a
    common.let_go()
    assert not common._KEPT


def test_empty_tables_and_shared_folder(spark, vocabulary):
    none = docs_of(spark, ["x"]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(none, bench).count() == 0 and packing.packed(none, f"{TOKENIZERS}/byte_bpe_50k.json").count() == 0
    assert toxicity.scored(none, toxicity.fit(none, labels)).count() == 0 and quality.scored(none, quality.fit(none, labels)).count() == 0
    assert wavelet.documents(wavelet.written(none, f"{TOKENIZERS}/word_bpe_49k.json")).count() == 0
    assert repeats.without_repeats(none).count() == 0 and linededup.clean(none).count() == 0

    class Far:
        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(dict)

        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Far)


def test_packing(spark, vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    rng = random.Random(14)
    texts = [sentences(rng, rng.choice((0, 5, 50, 900)), vocabulary) for _ in range(60)] + [None]
    rows = packing.packed(docs_of(spark, texts), f"{TOKENIZERS}/byte_bpe_50k.json").collect()
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(texts):
        ids, at = [*t.encode(text or "", add_special_tokens=False).ids, 0], 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 2048)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for found in by_bin.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(by_bin) <= 1.1 * total / 2048 + 2
    assert packing.packed(odd_docs(spark), f"{TOKENIZERS}/byte_bpe_50k.json").count() >= odd_docs(spark).count()


def test_components(spark):
    from tideline.llm.components import components

    rng = random.Random(15)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(25)]
    union = simhash.Union()
    for a, b in edges:
        union.link(a, b)
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    assert found == {x: union.root(x) for x in found} and set(range(61)) <= set(found)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pipeline(spark, vocabulary, tmp_path):
    import corpus_pipeline

    rng = random.Random(16)
    texts, labels = [], []
    for i in range(150):
        words = "\n".join(sentences(rng, 15, vocabulary) for _ in range(4))
        texts.append(words if i % 3 else "!! ".join(words.upper().split(" ")))
        labels.append((i, int(i % 3 > 0), 0))
    item = sentences(rng, 40, vocabulary)
    texts[1] += "\n" + item
    texts[10] = texts[4]
    texts += [None, ""]
    docs_of(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r.doc_id for r in docs.collect()}
    good = {i for i in range(150) if i % 3}
    assert good <= kept["quality_classifier"] and not {i for i in range(150) if i % 3 == 0} & kept["quality_classifier"]
    assert kept["line_dedup"] == kept["quality_classifier"]
    assert 10 in kept["line_dedup"] and good - {10} <= kept["near_dedup"]
    assert kept["near_dedup"] - kept["decontamination"] == {1}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == kept["decontamination"]
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    docs_of(spark, [""]).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    (tmp_path / "more").mkdir()
    for name in ("labels", "benchmark"):
        os.symlink(tmp_path / f"{name}.parquet", tmp_path / "more" / f"{name}.parquet")
    odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "more" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "more")).count() > 0
