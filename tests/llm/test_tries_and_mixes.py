"""The prefix trie, the mix of sources and phrase collocations against brute force, with hot keys and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import mixing, phrases, prefixtrie

CONVS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def trie_by_force(convs):
    """Nodes of {conv_id: [(role, text), ...]}."""
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
        ends[tuple(convs[c])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1]) if p else 0
    return sorted((own[0], len(p), members[p[:-1]][0] if p else None, len(own), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, own in members.items())


def ordered(rows):
    """Conversations of rows without ties."""
    found = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        found[c].append((role or "", text or ""))
    return found


def nodes(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1]))


def conversations(rng):
    """Shared beginnings, a very common first turn, copies, chains of beginnings, one long conversation and a near copy of it."""
    turns = [("user", f"t{i}" * rng.randint(0, 5)) for i in range(6)]
    rows = []
    for c in range(120):
        own = [turns[0]] * (c % 3 == 0) + [rng.choice(turns) for _ in range(rng.randint(0, 5))]
        if c % 10 == 1:
            own = [turns[1], turns[2], turns[1]]  # copies
        if c % 10 == 2:
            own = [turns[3]] * (c // 10 + 1)  # each the beginning of the next
        if c in (7, 17):
            own = [("assistant", f"line {i}") for i in range(150)] + [("user", str(c))]
        rows += [(c * 5 - 40, i - 1 if i else None, *t) for i, t in enumerate(own)]
    rows += [(1000, 1, None, None), (1001, 1, "", ""), (1002, 3, "a", "ä\U0001f600"), (None, 1, "user", "lost")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("local", [1, 6, 60, prefixtrie.LOCAL])
def test_trie(spark, local):
    rows = conversations(random.Random(3))
    df = spark.createDataFrame(rows, CONVS).repartition(4).withColumns({c: F.lit("clash") for c in ("ids", "mark", "id", "bucket", "n")})
    assert nodes(prefixtrie.trie(prefixtrie.encoded(df), local)) == trie_by_force(ordered(rows))


def test_grafted_conversations(spark):
    rng = random.Random(4)
    rows = [(c, i, rng.choice(("user", "assistant")), f"c{c % 3} {i}") for c in [*range(-3, 12), 100, 101, *range(205, 215), 310] for i in range(rng.randint(1, 9)) if 0 < c < 200 or i < 2]
    own = ordered(rows)
    expected = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        expected[c] = own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + own[c][h:]
    assert any(not t for t in expected.values()) and any(len(t) != len(own[c]) for c, t in expected.items())
    convs = prefixtrie.grafted(prefixtrie.encoded(spark.createDataFrame(rows, CONVS)))
    assert nodes(prefixtrie.trie(convs, 20)) == trie_by_force(expected)


def test_trie_odd_rows(spark):
    empty = spark.createDataFrame([], CONVS)
    assert prefixtrie.trie(prefixtrie.grafted(prefixtrie.encoded(empty))).count() == 0
    one = nodes(prefixtrie.trie(prefixtrie.encoded(spark.createDataFrame([(5, None, None, None)], CONVS))))
    assert one == trie_by_force({5: [("", "")]})
    # turns of the same number stand in one order wherever they come from
    rows = [(c, 1, "user", t) for c in range(4) for t in ("x", "y", "z")]
    rng = random.Random(1)
    rng.shuffle(rows)
    assert len(nodes(prefixtrie.trie(prefixtrie.encoded(spark.createDataFrame(rows, CONVS).repartition(3))))) == 4
    assert prefixtrie.finished([(i, 1, "", [7] * i, [1] * i) for i in range(3000)], 0, None, 0)[0][3:6] == [3000, 1, 1]  # deeper than Python's stack


def test_digests_of_many_pieces(spark, monkeypatch):
    rows = [(c, 0, "user", "same") for c in range(3000)]
    monkeypatch.setattr(prefixtrie, "PIECE", 50)
    assert nodes(prefixtrie.trie(prefixtrie.encoded(spark.createDataFrame(rows, CONVS).repartition(5)))) == trie_by_force(ordered(rows))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def filled(sizes, weights, epochs, total):
    """Shares by clamping one source after another."""
    capped = set()
    while True:
        rest = total - sum(epochs * sizes[s] for s in capped)
        weight = sum(weights[s] for s in sizes if s not in capped)
        level = Fraction(rest, weight) if weight else 0
        over = {s for s in sizes if s not in capped and level * weights[s] > epochs * sizes[s]}
        if not over:
            return {s: float(epochs * sizes[s]) if s in capped else float(level * weights[s]) for s in sizes}
        capped |= over


def mixture(rng):
    rows = []
    for i in range(400):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "ä", None, "tiny", "Z"])
        text = None if source == "tiny" and i % 5 else " ".join(["w\x0bx"] * rng.choice((0, 1, 2, 3, 40 if source != "tiny" else 1)))
        rows.append((i if i % 50 else 7, text, "en", source, 0))
    return rows + [(None, "x y", "en", None, 0), (900, "", "en", "nothing", 0), (901, None, "en", "nothing", 0), (5, "a b c", "en", "Z", 0), (5, "a b c", "en", "Z", 0)]


@pytest.mark.parametrize(("epochs", "total"), [(3, None), (1, None), (2, 100), (5, 10**7)])
def test_mixing(spark, epochs, total):
    rows = mixture(random.Random(6))
    df = spark.createDataFrame(rows, DOCS).repartition(3).withColumns({c: F.lit("clash") for c in ("size", "place", "target", "own", "at", "last")})
    found = mixing.mixed(df, epochs=epochs, total=total).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, mixing.mixed(df.repartition(7), epochs=epochs, total=total).collect()))
    sizes = Counter({s: 0 for *_, s, _ in rows})
    for _, text, _, source, _ in rows:
        sizes[source] += len(words_of(text))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: i % 3 + 1 for i, s in enumerate(order)}
    targets = filled(sizes, weights, epochs, sum(sizes.values()) if total is None else total)
    assert sorted(map(repr, ((r.doc_id, r.source, r["size"]) for r in found))) == sorted(map(repr, ((d, s, len(words_of(t))) for d, t, _, s, _ in rows)))
    taken = Counter()
    for r in found:
        assert r.target == pytest.approx(targets[r.source], abs=1e-6) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= epochs * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 2 for s in sizes)


def test_mixed_texts(spark):
    rows = mixture(random.Random(8))
    df = spark.createDataFrame(rows, DOCS).repartition(3).withColumn("copy", F.lit("clash"))
    sizes = mixing.sized(df)
    plan = mixing.cuts(sizes, mixing.targets(mixing.cyclic(mixing.sources(sizes))))
    out = mixing.repeated(df, plan)
    assert out.columns == [*df.columns, "copy_"]
    words = out.groupBy("source").agg(F.sum(mixing.size_of()).alias("n"))
    wanted = mixing.mixed(df).groupBy("source").agg(F.sum("taken").alias("n")).where("n > 0")
    assert sorted(map(repr, words.collect())) == sorted(map(repr, wanted.collect()))
    assert mixing.mixed(df.limit(0)).count() == 0
    given = spark.createDataFrame([("a", 10, 0), ("b", 5, 7)], "source string, source_size long, weight long")
    assert {r.source: r.target for r in mixing.targets(given, 2, 12).collect()} == {"a": 0.0, "b": 10.0}
    with pytest.raises(ValueError, match="epochs"):
        mixing.targets(given, 0)


def phrases_by_force(rows, least, top):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {}
        for gram, a in f.items():
            if len(gram) > 1 and a >= least:
                found[gram] = (a, *min(((1000000 * a * a // (f[gram[:k]] * f[gram[k:]]), k, f[gram[:k]], f[gram[k:]]) for k in range(1, len(gram))), key=lambda x: x[:2]))
        kept = [g for g, x in found.items() if not any(g in (h[:2], h[1:]) and 100 * y[0] >= 50 * x[0] for h, y in found.items() if len(h) > len(g))]
        ranked = sorted(kept, key=lambda g: (-found[g][1], -found[g][0], " ".join(g).encode()))[:top]
        for i, g in enumerate(ranked):
            a, score, _, left, right = found[g]
            out.append((lang, i + 1, " ".join(g), a, left, right, total[lang], score))
    return sorted(out)


def test_phrases(spark, monkeypatch):
    rng = random.Random(9)
    words = ["The", "of", "ä", "New", "York\x01", "a-b", "city", "state", "x y", "É"] + [f"rare{i}" for i in range(60)]
    weights = [20] * 10 + [1] * 60
    rows = []
    for i in range(150):
        text = "".join(rng.choices(words, weights)[0] + rng.choice((" ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", " ! ")) for _ in range(rng.randint(0, 60)))
        rows.append((i, None if i % 40 == 0 else text, rng.choice(["en", "en", "de", None]), "s", 0))
    rows += [(200, "new york city " * 300, "en", "s", 0), (200, "new york city " * 300, "en", "s", 0), (None, ".,;", "fr", "s", 0), (201, "lone words here", "nl", "s", 0)]
    df = spark.createDataFrame(rows, DOCS).repartition(4).withColumns({c: F.lit("clash") for c in ("word", "n", "a", "chunk", "rank")})

    def found(top):
        return sorted(tuple(r) for r in phrases.collocations(df, 4, top).collect())

    expected = phrases_by_force(rows, 4, 2000)
    assert found(2000) == expected and len(expected) > 100
    assert found(7) == phrases_by_force(rows, 4, 7)
    monkeypatch.setattr(phrases, "CHUNK", 400)
    monkeypatch.setattr(phrases, "HELD", 50)
    assert found(2000) == expected
    assert phrases.collocations(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="least"):
        phrases.collocations(df, 0)


def test_radix_order_and_runs():
    rng = np.random.default_rng(2)
    digits = rng.integers(0, 3, (500, 6)).astype(np.uint16) * np.uint16(30000)
    order = phrases.radix_order(digits)
    assert [tuple(r) for r in digits[order].tolist()] == sorted(map(tuple, digits.tolist()))
    starts = phrases.run_starts(digits[order])
    assert len(starts) == len({tuple(r) for r in digits.tolist()})
    big = [np.array([0, 1, 1 << 16, (1 << 48) - 1], np.int64)]
    assert phrases.packed(big).tolist() == [[0, 0, 0], [0, 0, 1], [0, 1, 0], [65535, 65535, 65535]]
    assert phrases.radix_order(digits[:0]).tolist() == [] and phrases.run_starts(digits[:0]).tolist() == []


def test_scores_beyond_64_bits(spark):
    a, left, right = 3 * 10**12 + 7, 4 * 10**12 + 1, 5 * 10**12 + 3
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.select(phrases.score("a", "l", "r")).first()[0] == 10**6 * a * a // (left * right)
