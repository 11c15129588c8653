"""The processing step against a plain loop, and what the desk does with rows that are odd."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import numpy as np
from pyspark.sql import functions as F

from tideline.operators import clustering, desk, processing

ITEM = "item_id long, project long, mode string, source_id long, title string, published_at timestamp, embedding array<double>, status string, cluster_id long, dup_of long, searched boolean"
STORY = "cluster_id long, project long, mode string, state string, title string, centroid array<double>, item_count long, source_count long, first_seen timestamp, last_seen timestamp"
START, WINDOWS = datetime(2024, 1, 1, tzinfo=timezone.utc), {"news": 48, "curated": 336}


def unit(v):
    v = np.asarray(v, float)
    return v / (np.linalg.norm(v) or 1.0)


def made(rng):
    centres = rng.normal(size=(6, 8))
    at = lambda h: START + timedelta(hours=float(h))
    items, stories = [], []
    for i in range(90):
        old = i < 30
        c = int(rng.integers(6))
        v = centres[c] + rng.normal(0, 0.02 if i % 9 == 0 else 0.35, 8)
        mode = "curated" if c == 0 else "news"
        if i % 7 == 5 and i > 30:
            v, mode = np.array(items[i - 4][6]) * 2, items[i - 4][2]  # the direction of an item before
        story = (c + 1) * 10 + i % 2 * 100 if old else None  # of one project and mode
        items.append((i, i % 2, mode, i % 5, f"Item {i}" if i % 8 else " ", at(2 * i if not old else i), v.tolist(), "clustered" if old else "embedded", story, None, i % 10 == 3))
    items.append((500, 0, "news", 1, "late twin", at(1), None, "duplicate", None, 45, False))
    items.append((501, 1, "news", 1, "not ready", at(1), None, "new", None, None, False))
    for story in sorted({r[8] for r in items if r[8]}):
        own = [r for r in items if r[8] == story]
        for r in own:
            if r[2] != own[0][2] or r[1] != own[0][1]:
                raise AssertionError
        state = ["open", "drafted", "excluded", "closed", "published"][story // 10 % 5]
        stories.append((story, own[0][1], own[0][2], state, None, np.mean([unit(r[6]) for r in own], axis=0).tolist(), len(own), 1, min(r[5] for r in own), max(r[5] for r in own)))
    stories.append((900, 0, "news", "open", "without vectors", None, 3, 1, at(60), at(60)))
    return items, stories


def by_hand(items, stories, base):
    """status, cluster and dup_of of all items, and the new and touched stories' sums, by a loop over items in order."""
    out, sums = {r[0]: [r[7], r[8], r[9]] for r in items}, {}
    top = max(s[0] for s in stories) + 1
    for project in (0, 1):
        for mode, hours in WINDOWS.items():
            new = sorted((r for r in items if r[1] == project and r[2] == mode and r[7] == "embedded"), key=lambda r: (r[5], r[0]))
            if not new:
                continue
            since = new[0][5] - timedelta(hours=hours)
            live = [{"id": s[0], "sum": np.array(s[5]) * s[6], "n": s[6], "last": s[9]} for s in sorted(stories, key=lambda s: (s[9], s[0])) if s[1] == project and s[2] == mode and s[3] != "closed" and s[5] is not None and s[9] >= since]
            accepted = [(r[5], r[0], r[8], unit(r[6])) for r in sorted(items, key=lambda r: (r[5], r[0])) if r[1] == project and r[2] == mode and r[7] == "clustered" and r[5] >= since]
            for r in new:
                u, floor = unit(r[6]), r[5] - timedelta(hours=hours)
                near = max(((float(a[3] @ u), -i) for i, a in enumerate(accepted) if a[0] >= floor), default=(-2, 0))
                if near[0] >= clustering.SAME:
                    twin = accepted[-near[1]]
                    out[r[0]] = ["duplicate", twin[2], twin[1]]
                    continue
                least = max(base, clustering.CURATED) if mode == "curated" else base
                least = max(least, clustering.SEARCHED) if r[10] else least
                best = max(((float(unit(s["sum"]) @ u), -i) for i, s in enumerate(live) if s["last"] >= floor), default=(-2, 0))
                if best[0] >= least:
                    s = live[-best[1]]
                    s["sum"], s["n"], s["last"] = s["sum"] + u, s["n"] + 1, max(s["last"], r[5])
                else:
                    s = {"id": top + r[0], "sum": u, "n": 1, "last": r[5]}
                    live.append(s)
                out[r[0]] = ["clustered", s["id"], None]
                accepted.append((r[5], r[0], s["id"], u))
                sums[s["id"]] = (s["sum"] / s["n"], r[1], r[2])
    for r in items:
        if out[r[0]][1] is None and r[9] is not None and out[r[9]][0] == "clustered" and r[9] >= 30:
            out[r[0]][1] = out[r[9]][1]
    return out, sums


def test_step_is_the_plain_loop(spark):
    items, stories = made(np.random.default_rng(4))
    a, b = spark.createDataFrame(items, ITEM).repartition(4), spark.createDataFrame(stories, STORY)
    found, after = processing.step(a, b, 0.7)
    want, sums = by_hand(items, stories, 0.7)
    assert {r.item_id: [r.status, r.cluster_id, r.dup_of] for r in found.collect()} == want
    kinds = [w[0] for w in want.values()]
    assert kinds.count("duplicate") > 3 and want[500][1] is not None and len(sums) > 8
    rows = {r.cluster_id: r for r in after.collect()}
    assert set(rows) == {s[0] for s in stories} | set(sums)
    of = {r[0]: r for r in items}
    for story in stories:
        if story[0] not in sums:
            r = rows[story[0]]
            assert (r.state, r.item_count, r.title, r.source_count) == (story[3], story[6], story[4], 1)
    for story, (centroid, project, mode) in sums.items():
        r = rows[story]
        assert np.allclose(r.centroid, centroid) and (r.project, r.mode) == (project, mode)
        members = [i for i, (status, c, _) in want.items() if c == story and status in ("clustered", "duplicate")]
        assert (r.item_count, r.source_count) == (len(members), len({of[i][3] for i in members}))
        assert r.first_seen.replace(tzinfo=timezone.utc) == min(of[i][5] for i in members) and r.last_seen.replace(tzinfo=timezone.utc) == max(of[i][5] for i in members)
        named = [i for i in members if want[i][0] == "clustered" and of[i][4].strip()]
        if named:
            best = max(named, key=lambda i: (round(float(unit(of[i][6]) @ unit(centroid)), 9), -i))
            assert r.title == of[best][4]
    again, _ = processing.step(found, after, 0.7)  # nothing is new any more
    assert {r.item_id: [r.status, r.cluster_id, r.dup_of] for r in again.collect()} == want


def test_step_keeps_all_items_from_before(spark):
    """More old items than fit one window, before and after the new ones: each of these finds its twin."""
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(400, 8))
    at = lambda h: START + timedelta(hours=float(h))
    items = [(i, 0, "news", i % 5, f"Item {i}", at(3 * i), v.tolist(), "clustered", 7, None, False) for i, v in enumerate(vectors)]
    items += [(1000 + i, 0, "news", 1, "new", at(3 * i + 1), (vectors[(i + 150 * (i % 3)) % 400] * 2).tolist(), "embedded", None, None, False) for i in range(400)]
    items += [(2000 + i, 0, "news", 1, "again", at(3 * i + 2), items[400 + i][6], "embedded", None, None, False) for i in range(400)]
    stories = [(7, 0, "news", "open", None, [1.0] + [0.0] * 7, 400, 1, at(0), at(1197))]
    want, _ = by_hand(items, stories, 0.7)
    assert sum(w[0] == "duplicate" for i, w in want.items() if i >= 1000) > 600
    found, _ = processing.step(spark.createDataFrame(items, ITEM).repartition(4), spark.createDataFrame(stories, STORY), 0.7)
    assert {r.item_id: [r.status, r.cluster_id, r.dup_of] for r in found.collect()} == want


def test_twins_of_many_blocks_are_those_of_one(spark, monkeypatch):
    items, stories = made(np.random.default_rng(8))
    monkeypatch.setattr(clustering, "BLOCK", 3)
    monkeypatch.setattr(clustering, "ROWS", 2)
    found, _ = processing.step(spark.createDataFrame(items, ITEM), spark.createDataFrame(stories, STORY), 0.7)
    assert {r.item_id: [r.status, r.cluster_id, r.dup_of] for r in found.collect()} == by_hand(items, stories, 0.7)[0]


def test_new_space_and_backfill(spark):
    items, stories = made(np.random.default_rng(5))
    a, b = spark.createDataFrame(items, ITEM), spark.createDataFrame(stories, STORY)
    drafted = b.where("cluster_id % 20 = 0").select("cluster_id")
    left, right = processing.new_space(a, b, drafted, spark.createDataFrame([(0,)], "project long"))
    assert all((r.embedding is None and r.status == "new" and r.cluster_id is None) == (r.project == 0 or r.item_id == 501) for r in left.collect())
    kept = {r.cluster_id: r for r in right.collect()}
    assert set(kept) == {s[0] for s in stories if s[1] == 1 or s[0] % 20 == 0}
    assert all(r.centroid is None and r.state in ("closed", "published") for r in kept.values() if r.project == 0)
    rows = a.withColumn("title_embedding", F.when(F.col("item_id") % 2 == 0, F.col("embedding"))).withColumn("topic_score", F.when(F.col("item_id") % 4 == 0, 0.5))
    lack = [r.item_id for r in processing.backfill(rows, b, 3).orderBy("item_id").collect()]
    live = {s[0] for s in stories if s[3] in ("open", "published")}
    want = [i for p in (0, 1) for i in sorted((r[0] for r in items if r[8] in live and r[1] == p and r[0] % 4), reverse=True)[:3]]
    assert lack == sorted(want) and lack


def test_predicates_of_odd_values(spark):
    df = spark.createDataFrame([("https://news.google.com/rss/search?q=x",), ("https://news.google.com/rss",), (None,)], "u string")
    assert [r.s for r in df.select(processing.searched(F.col("u")).alias("s")).collect()] == [True, False, False]
    keys = spark.createDataFrame([('{"k": null}',), ('{"x": {"k": 1}}',), ("[1]",), ("broken",), (None,)], "p string")
    assert [r.h for r in keys.select(desk.has_key(F.col("p"), "k").alias("h")).collect()] == [True, False, False, False, False]
    kinds = spark.createDataFrame([("text-embedding-3", None), ("x", ["nomic-bert"]), ("playai-tts", []), (None, None), ("qwen2.5-embed", [])], "n string, f array<string>")
    assert [r.k for r in kinds.select(desk.model_kind(F.col("n"), F.col("f")).alias("k")).collect()] == ["embed", "embed", "other", "chat", "embed"]
