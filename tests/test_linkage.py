"""Components, average linkage, threshold sweeps and matched videos against naive forms."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import clustering, dedup, evaluation, graphs, linkage, matching


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(900, 900), (None, 3), (500, 501), (501, 500), (500, 501)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v in edges:
        if u is not None:
            a, b = root(u), root(v)
            up[max(a, b)] = min(a, b)
    assert {r.node: r.component for r in graphs.components(spark.createDataFrame(edges, "u long, v long").repartition(4)).collect()} == {x: root(x) for x in list(up)}
    assert graphs.components(spark.createDataFrame([], "u long, v long")).count() == 0


def naive(vectors, threshold):
    """The best pair of clusters is joined each time, by the mean of all likenesses between them."""
    alike = vectors @ vectors.T
    clusters = [[i] for i in range(len(vectors))]
    while len(clusters) > 1:
        best, a, b = max((alike[np.ix_(x, y)].mean(), i, j) for i, x in enumerate(clusters) for j, y in enumerate(clusters) if i < j)
        if best < threshold:
            break
        clusters[a] += clusters[b]
        del clusters[b]
    return sorted(sorted(c) for c in clusters)


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9])
def test_average_linkage(spark, threshold, monkeypatch):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 8))
    vectors = centres[rng.integers(12, size=200)] + rng.normal(0, 0.35, (200, 8))
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [("g", i, v.tolist()) for i, v in enumerate(vectors)] + [("h", 1000, [0.0] * 8), ("h", 1001, [1.0] * 8), ("h", 1002, [2.0] * 8), ("h", 1003, None)]
    df = spark.createDataFrame(rows, "g string, k long, v array<double>").repartition(3)
    found = {}
    monkeypatch.setattr(linkage, "BLOCK", 64)
    for r in linkage.average_linkage(df, "g", "k", "v", threshold, most=10_000).collect():
        found.setdefault(r.cluster, []).append(r.k)
    assert sorted(map(sorted, found.values())) == sorted(naive(units, threshold) + [[1000], [1001, 1002]])
    assert all(min(keys) == c for c, keys in found.items())
    bounded = linkage.average_linkage(df, "g", "k", "v", threshold, most=2).collect()
    assert len(bounded) == 203 and all((r.cluster is None) == (r.component_size > 2) for r in bounded)


def test_sweep_equals_single_runs(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 6))
    labels = rng.integers(5, size=80)
    rows = [(i, (centres[c] + rng.normal(0, 0.4, 6)).tolist(), float(i), int(c)) for i, c in enumerate(labels)]
    df = spark.createDataFrame(rows, "k long, v array<double>, t double, gold int")
    found = {(r.threshold, r.part): r for r in linkage.sweep(df, "k", "v", "t", "gold", 50.0, [0.5, 0.65, 0.75, 0.9]).collect()}
    assert len(found) == 12
    half = F.when(F.substring(F.md5(F.col("k").cast("string")), 1, 1) < "8", "dev").otherwise("test")
    for (threshold, part), r in found.items():
        own = df if part == "all" else df.where(half == part)
        one = clustering.single_pass(own.withColumn("g", F.lit(1)), "g", "k", "v", "t", 50.0, threshold).join(df, "k")
        s = evaluation.scores(one, "cluster", "gold").first()
        assert (r.n, r.clusters) == (s.n, one.select("cluster").distinct().count())
        assert [getattr(r, c) for c in ("precision", "recall", "f1", "nmi", "ari")] == pytest.approx([getattr(s, c) for c in ("precision", "recall", "f1", "nmi", "ari")], abs=6e-5)
    best = max((found[t, "dev"].f1, -abs(t - 0.7), t) for t in (0.5, 0.65, 0.75, 0.9))[2]
    assert {t for (t, _), r in found.items() if r.chosen} == {best}


def by_hand(posts, videos):
    words = lambda s: " ".join("".join(c if c.isalnum() or c == "_" else " " for c in (s or "").lower()).split())
    taken, out = set(), {}
    for p, at, title in sorted(posts, key=lambda p: (p[1] or 0, p[0])):
        key = words(title)[:40]
        if len(key) < 10:
            continue
        for v, made, text in sorted(videos, key=lambda v: (v[1] or 0, v[0])):
            if v not in taken and (made or 0) >= (at or 0) - 60 and key in words(text):
                out[p] = v
                taken.add(v)
                break
    return out


def test_matched_videos(spark):
    rng = random.Random(5)
    titles = [f"{rng.choice(('New', 'Old', 'The'))} release number {i} of a_tool, with Notes & more text" for i in range(12)] + ["Short", None, "Ten chars!", "a very common title", "common title"]
    posts = [(i, rng.choice((None, *range(0, 2000, 50))), rng.choice(titles)) for i in range(150)]
    videos = [(1000 + i, rng.choice((None, *range(0, 2400, 50))), None if i % 40 == 0 else f"!!{rng.choice(titles)}\n{rng.choice(titles)} #tag") for i in range(160)]
    p, v = spark.createDataFrame(posts, "post_id long, uploaded_at long, title string"), spark.createDataFrame(videos, "video_id long, created_at long, text string")
    found = {r.post_id: r.video_id for r in matching.matched(p.repartition(3), v.repartition(4)).collect()}
    assert found == by_hand(posts, videos) and len(found) > 50
    assert matching.matched(p.limit(0), v).count() == 0


def test_alike_signatures_meet_without_meeting_others(spark):
    """Signatures that differ in 11 places at most share a key wherever these are; unlike ones of one band stay in their task."""
    rng = np.random.RandomState(3)
    base = rng.randint(0, 1 << 31, 64)
    rows = [(0, base.tolist())]
    for i in range(1, 200):
        sig = base.copy()
        sig[rng.choice(64, 11 if i % 2 else 12, replace=False)] += 1 << 32
        rows.append((i, sig.tolist()))
    sigs = spark.createDataFrame(rows, "k long, sig array<long>")
    found = {(r.later, r.earlier, r.likeness) for r in dedup.candidate_pairs(sigs, "k").collect()}
    same = lambda a, b: sum(x == y for x, y in zip(rows[a][1], rows[b][1], strict=True))
    assert found == {(a, b, same(a, b) / 64) for a in range(200) for b in range(a) if same(a, b) >= 53} and len(found) >= 100
    one_band = [(i, [7, 7, 7, 7, *rng.randint(0, 1 << 31, 60).tolist()]) for i in range(300)]
    keyed = spark.createDataFrame(one_band, "k long, sig array<long>").select("k", F.explode(dedup.part_keys(F.col("sig"), 11)).alias("key"))
    assert keyed.groupBy("key").count().where("count > 1").count() == 0


def test_few_runs_of_captions_leave_their_task(spark):
    """Only runs that some title looks for are written, three a title at most; holders are those of a plain search."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(30)] + ["", "short"]
    titles = [t[:60] for t in texts[:10]] + [texts[3][50:61], "no caption holds this title", "tiny"]
    posts = spark.createDataFrame(list(enumerate(titles)), "post_id long, title string")
    videos = spark.createDataFrame(list(enumerate(texts)), "video_id long, text string")
    found = {(r.key, r.text_id) for r in matching.holders(posts, videos).collect()}
    keys = {" ".join(t.split())[:40] for t in titles}
    assert found == {(k, i) for k in keys if len(k) >= 10 for i, t in enumerate(texts) if k in t}
    parts = spark.createDataFrame([(i, int(g)) for i in range(10) for g in matching.runs(titles[i])[:3]], "key_id long, gram long")
    known = matching._known(videos.selectExpr("video_id AS text_id", "text AS caption"), parts).collect()
    looked = {g for t in titles[:10] for g in matching.runs(t)[:3].tolist()}
    assert {(r.text_id, r.gram) for r in known} == {(i, g) for i, t in enumerate(texts) for g in set(matching.runs(t).tolist()) & looked}


def test_copies_have_the_links_of_their_signature(spark):
    """Every item by a plain loop; a copy of a duplicate is one too, of the most alike original before it."""
    by_hand = lambda rows: {later: -best[1] for later, best in _greedy(rows).items() if best}
    found = lambda rows: {r.later: r.earlier for r in dedup.resolved(dedup.candidate_pairs(spark.createDataFrame(rows, "k long, sig array<long>"), "k")).collect()}
    a = list(range(1, 65))
    b, c = [-x if i < 10 else x for i, x in enumerate(a)], [-x if i < 10 or i > 60 else x for i, x in enumerate(a)]
    assert found([(0, a), (1, b), (2, b)]) == {1: 0, 2: 0}
    few = [(0, a), (1, b), (2, b), (3, c), (4, b), (5, c), (6, a), (7, [0] * 64), (8, [0] * 64)]
    assert found(few) == by_hand(few) == {1: 0, 2: 0, 4: 3, 5: 3, 6: 0}
    rng = np.random.RandomState(5)
    rows = [rng.randint(1, 1 << 31, 64).tolist()]
    for _ in range(400):
        sig = np.array(rows[rng.randint(len(rows))])
        if rng.rand() < 0.6:
            sig[rng.choice(64, rng.randint(3, 12), replace=False)] = rng.randint(1, 1 << 31)
        rows.append(sig.tolist())
    many = list(enumerate(rows))
    assert found(many) == by_hand(many)


def _greedy(rows):
    originals, found = [], {}
    for k, sig in rows:
        near = [(sum(x == y for x, y in zip(sig, o, strict=True)) / 64, -j) for j, o in originals if any(sig)]
        found[k] = max((x for x in near if x[0] >= dedup.LIKENESS), default=None)
        if found[k] is None:
            originals.append((k, sig))
    return found


def test_pairs_that_share_no_band(spark):
    """At a lower likeness the places that differ may lie in all bands; such a pair counts like any other."""
    a = list(range(1, 65))
    b, c = [-x if i % 4 == 1 else x for i, x in enumerate(a)], [-x if i % 4 == 1 or i == 0 else x for i, x in enumerate(a)]
    sigs = spark.createDataFrame([(0, a), (1, b), (2, c)], "k long, sig array<long>")
    found = {(r.later, r.earlier, r.likeness) for r in dedup.candidate_pairs(sigs, "k", 0.75).collect()}
    assert found == {(1, 0, 48 / 64), (2, 1, 63 / 64)}
