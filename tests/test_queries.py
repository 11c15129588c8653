"""Every query with SQL against DuckDB on the smallest tables; the others against plain Python."""

from __future__ import annotations

import hashlib
import hmac
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.functions import urls as U
from tideline.functions import vectors as V
from tideline.operators import clustering, dedup, evaluation, schedules, statistics, stories
from tideline.plans import cases, connectors, derived, desk, generation, publishing, tools  # noqa: F401  they add their queries
from tideline.plans import stories as story_plans  # noqa: F401
from tideline.plans.queries import CASE_SQL, CASES, QUERIES, SQL
from tideline.sources import feeds, sinks

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def shown(x):
    if x is None or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return "-"
    if isinstance(x, (float, np.floating)):
        return f"{x:.6g}"
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(shown, x)) + "]"
    return str(x)


@pytest.mark.parametrize("name", sorted([*SQL, *CASE_SQL]))
def test_same_as_sql(spark, duck, name):
    df = (QUERIES | CASES)[name](spark, SF)
    names = sorted(df.columns)
    left = sorted(tuple(shown(r[c]) for c in names) for r in df.collect())
    table = duck.sql((SQL | CASE_SQL)[name]).arrow()
    rows = (table.read_all() if hasattr(table, "read_all") else table).to_pylist()
    assert not rows or sorted(rows[0]) == names
    assert left == sorted(tuple(shown(r[c]) for c in names) for r in rows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).columns


def test_single_pass_is_the_plain_loop(spark):
    rows = QUERIES["single_pass_clusters"](spark, SF).collect()
    items = {r.vec_id: r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r.label, []).append(r)
    for label, found in groups.items():
        clusters, got = [], {r.vec_id: r.cluster for r in found}
        for i in sorted(got):
            v = np.array(items[i].embedding, float)
            v /= np.linalg.norm(v)
            best, at = -2.0, None
            for k, c in enumerate(clusters):
                s = c["sum"] / np.linalg.norm(c["sum"]) @ v
                if c["last"] >= i - 200.0 and s > best:
                    best, at = s, k
            if at is None or best < 0.35:
                clusters.append({"sum": v.copy(), "last": i})
                at = len(clusters) - 1
            else:
                clusters[at]["sum"] += v
                clusters[at]["last"] = i
            assert got[i] == at, (label, i)
    assert clustering.assign([[1, 0], [0.9, 0.1], [0, 1]], [0, 1, 2], 10, 0.7) == [0, 0, 1]


def test_minhash_greedy(spark):
    found = {r.later: r.earlier for r in QUERIES["minhash_duplicates"](spark, SF).collect()}
    docs = {r.doc_id: r.n for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", T.normalized("text").alias("n")).collect()}
    sigs, originals, expected = {d: V.shingle_signature(t) for d, t in docs.items()}, [], {}
    for d in sorted(docs):
        s = sigs[d]
        near = [((s == sigs[o]).mean(), -o) for o in originals if s.any() and any((s[i : i + 4] == sigs[o][i : i + 4]).all() for i in range(0, 64, 4))]
        near = [x for x in near if x[0] >= dedup.LIKENESS]
        if near:
            expected[d] = -max(near)[1]
        else:
            originals.append(d)
    assert found == expected


def test_duplicates_in_order(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "later long, earlier long, likeness double")
    found = lambda rows: {(r.later, r.earlier) for r in dedup.resolved(pairs(rows)).collect()}
    assert found([(1, 0, 0.9), (2, 1, 0.9), (3, 0, 0.85), (3, 2, 0.95)]) == {(1, 0), (3, 2)}
    assert found([(2, 0, 0.9), (2, 1, 0.9)]) == {(2, 0)}
    assert found([(i + 1, i, 0.9) for i in range(14)]) == {(i + 1, i) for i in range(0, 14, 2)}
    assert dedup.resolved(pairs([(1, 0, 0.9)]).limit(0)).count() == 0
    items = spark.createDataFrame([(0, 7), (1, None), (2, None)], "k long, cluster_id long")
    rows = {r.k: (r.dup_of, r.cluster_id) for r in dedup.attached(items, dedup.resolved(pairs([(1, 0, 0.9)])), "k").collect()}
    assert rows == {0: (None, 7), 1: (0, 7), 2: (None, None)}


def test_single_pass_with_stored_stories_and_duplicates(spark):
    """Every item by a plain loop: thresholds of its own, stories from before, and twins that take no part."""
    items = {r.vec_id: r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    groups = {}
    for r in QUERIES["semantic_duplicates"](spark, SF).collect():
        groups.setdefault(r.label, {})[r.vec_id] = (r.cluster, r.dup_of)
    unit = lambda v: np.array(v, float) / np.linalg.norm(v)
    for label, got in groups.items():
        stories = {i // 10: [np.array(items[i].embedding, float) * 2, i] for i in sorted(items) if items[i].label == label and i % 10 == 0}
        accepted, following = [], max([*stories, -1]) + 1
        for i in sorted(got):
            v, base = unit(items[i].embedding), 0.35 if label % 2 == 0 else 0.88
            least = max(base, 0.84) if i % 5 == 0 else base
            twins = [(u @ v, -n, j, k) for n, (j, k, u) in enumerate(accepted) if j >= i - 200]
            if twins and max(twins)[0] >= 0.6:
                assert got[i] == (max(twins)[3], max(twins)[2]), (label, i)
                continue
            near = [(unit(s) @ v, -n, k) for n, (k, (s, last)) in enumerate(stories.items()) if last >= i - 200]
            if near and max(near)[0] >= least:
                k = max(near)[2]
                stories[k] = [stories[k][0] + v, i]
            else:
                k, following = following, following + 1
                stories[k] = [v, i]
            accepted.append((i, k, v))
            assert got[i] == (k, None), (label, i)


def test_streamed_clusters_are_those_of_the_table(spark):
    found, table = ({(r.label, r.vec_id): r.cluster for r in QUERIES[q](spark, SF).collect()} for q in ("streamed_clusters", "single_pass_clusters"))
    assert found == table and len(found) > 0


def test_clusters_forget_what_left_the_window():
    c = clustering.Clusters(5.0)
    for t in range(1000):
        c.add([1.0 if t % 2 else -1.0, t % 7], t, 2.0)
    assert c.made == 1000 and len(c.numbers) <= 128 and len(c.last) <= 128


def test_duplicates_of_a_large_group(spark, monkeypatch):
    """All of a clique wait for its first item alone; a chain alternates."""
    from tideline import tables

    made = []
    monkeypatch.setattr(tables, "written", lambda df, name, write=tables.written: made.append(name) or write(df, name))
    clique = [(i, j, 0.9 if j else 0.95) for i in range(120) for j in range(i)]
    chain = [(i + 1, i, 0.9) for i in range(500, 508)]
    pairs = spark.createDataFrame(clique, "later long, earlier long, likeness double")
    assert {(r.later, r.earlier) for r in dedup.resolved(pairs).collect()} == {(i, 0) for i in range(1, 120)}
    assert len(made) <= 8
    both = spark.createDataFrame(clique + chain, "later long, earlier long, likeness double")
    assert {(r.later, r.earlier) for r in dedup.resolved(both).collect()} == {(i, 0) for i in range(1, 120)} | {(i + 1, i) for i in range(500, 508, 2)}


def test_medians_of_heavy_tails(spark):
    rng = np.random.default_rng(1)
    values = {"tail": np.exp(rng.normal(0, 6, 4001)), "few": np.array([3.0] * 3000 + [1e12]), "two": np.repeat([0.0, 1e9], 1000), "ints": rng.integers(0, 50, 1500).astype(float)}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v], "k string, v double").repartition(6)
    assert {r.k: r.m for r in statistics.medians(df, ["k"], "v", "m").collect()} == {k: float(np.median(v)) for k, v in values.items()}


def test_repeated_posts_of_one_hot_text(spark):
    rows = [(i, "c" if i % 3 else None, "hot" if i % 2 else f"t{i % 7}", i * 1800 % 400_000) for i in range(400)]
    df = spark.createDataFrame(rows, "post_id long, channel_id string, fingerprint string, s long").withColumn("sent_at", F.timestamp_seconds("s"))
    from tideline.operators import publishing as states

    again = {i for i, c, f, s in rows if c and any(d == c and g == f and s - 86400 <= t < s for _, d, g, t in rows)}
    assert {r.post_id for r in states.repeated(df).collect()} == again and again


def test_medians_of_odd_groups(spark):
    rows = [("a", 1.0), ("a", 1.0), ("a", 5.0), ("b", None), (None, 2.0), (None, 4.0), ("c", 1e9), ("c", -1e9), ("c", 0.5), ("c", 0.25)]
    df = spark.createDataFrame(rows, "k string, v double")
    assert {r.k: r.m for r in statistics.medians(df, ["k"], "v", "m").collect()} == {"a": 1.0, "b": None, None: 3.0, "c": 0.375}
    assert statistics.medians(df.limit(0), ["k"], "v").count() == 0


def test_schedules(spark):
    assert schedules.fields("*/20 8-10 1,15 * 7") == [[0, 20, 40], [8, 9, 10], [1, 15], None, [0]]
    for wrong in ("* * * *", "60 * * * *", "5-1 * * * *", "*/0 * * * *"):
        with pytest.raises(ValueError, match="schedule"):
            schedules.fields(wrong)
    at = F.lit("2024-03-01 12:00:00").cast("timestamp")
    one_of = lambda c: spark.range(1).select(F.date_format(c, "yyyy-MM-dd HH:mm").alias("t")).first().t
    assert one_of(schedules.upcoming(at, "0 9 13 * 5")) == "2024-03-08 09:00"  # a Friday, before the 13th
    assert one_of(schedules.upcoming(at, "0 9 30 2 *")) is None
    assert one_of(schedules.previous(at, "0 12 * * *")) == "2024-03-01 12:00"
    df = spark.createDataFrame([(1, 30), (2, 0)], "schedule_id long, lead_minutes int")
    fires = spark.createDataFrame([(9,)], "schedule_id long").withColumn("slot", at)
    now = F.lit("2024-03-01 11:35:00").cast("timestamp")
    assert [r.schedule_id for r in schedules.firing(df, fires, now, "0 12 * * *").collect()] == [1]
    done = df.where("schedule_id = 1").select("schedule_id", F.lit("2024-03-01 12:00:00").cast("timestamp").alias("slot"))
    assert schedules.firing(df, done, now, "0 12 * * *").count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id long, text string").coalesce(1)
    sinks.csv_with_mark(df, str(tmp_path / "csv"))
    raw = next((tmp_path / "csv").glob("part-*")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfid,text\n1,x\n")
    r = sinks.messages(df, "id", "secret").orderBy("payload").first()
    assert r.payload == '{"id":1,"text":"x"}' and r.signature == hmac.new(b"secret", r.payload.encode(), hashlib.sha256).hexdigest()
    sinks.appended(df, str(tmp_path / "log"))
    sinks.appended(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    sinks.report(evaluation.scores(spark.createDataFrame([(1, "a")], "p int, g string"), "p", "g"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().f1 == 1.0


def test_diversified_is_the_plain_fold(spark):
    pool = [(0, 10, ["a"]), (1, 11, ["a", "b"]), (2, 12, ["b"]), (3, 13, []), (4, 14, ["c", "a"]), (5, 15, ["c"])]
    df = spark.createDataFrame(pool, "pos long, cluster_id long, source_ids array<string>")
    used, kept = set(), set()
    for _, k, sources in pool:
        if sources and set(sources) <= used:
            continue
        used |= set(sources)
        kept.add(k)
    assert {r.cluster_id for r in stories.diversified(df).collect()} == kept == {10, 11, 13, 14}


def test_evaluation_extremes(spark):
    same = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "p int, g string")
    r = evaluation.scores(same, "p", "g").first()
    assert (r.precision, r.recall, round(r.nmi, 9), r.ari) == (1, 1, 1, 1)
    merged = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "p int, g string")
    r = evaluation.scores(merged, "p", "g").first()
    assert (round(r.precision, 9), r.recall) == (round(1 / 3, 9), 1)


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f("x").alias("y")).first().y


def test_sentences_keep_the_digits_at_their_ends(spark):
    assert one(spark, "Zero. 1 is first. 23 is 2. 3", T.sentences) == ["Zero.", "1 is first.", "23 is 2."]


def test_text_functions(spark):
    assert one(spark, "One here. Two there! three", T.sentences) == ["One here.", "Two there! three"]
    assert one(spark, "about 1 200 and 3,5 and 3.5", T.numbers) == ["1200", "3.5"]
    assert one(spark, "- a\n2) b\nc", T.list_items) == 2
    assert one(spark, "1.2K", T.count_of) == 1200 and one(spark, "3M", T.count_of) == 3000000 and one(spark, "x", T.count_of) is None
    assert one(spark, "abcde", T.shingles) == ["abcd", "bcde"] and one(spark, "ab", T.shingles) == ["ab"] and one(spark, "!", T.shingles) == []
    assert "openai" in one(spark, "We saw OpenAI and x", T.entities)
    assert one(spark, "a [noise] b", T.captions) == "a b."
    assert one(spark, "First one. " + "x" * 50, lambda c: T.truncated(c, 15)) == "First one."
    assert one(spark, "x" * 30, lambda c: T.truncated(c, 15)) == "x" * 15 + "…"
    assert set(one(spark, "Words of wording", T.stems)) == {"word"}


def test_url_functions(spark):
    assert one(spark, "HTTPS://Ex.COM/a/?utm_source=1&b=2&REF=3#f", U.normalized_url) == "https://ex.com/a?b=2"
    assert one(spark, "https://ex.com", U.normalized_url) == "https://ex.com/"
    assert one(spark, "https://a.b.ex.com/x", U.site) == "ex.com"
    assert one(spark, "https://youtu.be/abcdefghijk?t=1", U.video_id) == "abcdefghijk"
    assert one(spark, "https://t.me/s/name/12", U.channel_name) == "name" and one(spark, "r/spark", U.subreddit) == "spark"
    assert one(spark, "https://github.com/a/b", U.link_kind) == "repo" and one(spark, "https://arxiv.org/abs/1", U.link_kind) == "paper"
    assert one(spark, "https://x.com/p/pic-300x200.jpg?v=1", U.image_key) == "pic"
    assert one(spark, "https://m.bad.com/", lambda c: U.blocked(c, ["bad.com"])) is True


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (1, [0.0, 0.0]), (2, [1.0, 0.0])], "k int, v array<float>")
    assert df.select(V.unit("v").alias("u")).collect()[0].u == [0.6, 0.8]
    assert {r.k: r.centroid for r in V.mean_vector(df, ["k"], "v").collect()} == {1: [1.5, 2.0], 2: [1.0, 0.0]}
    assert df.select(V.cosine("v", "v").alias("c")).collect()[1].c == 0.0
    e = spark.createDataFrame([("some words here",), ("",), (None,)], "t string").select(V.hash_embedding("t").alias("e")).collect()
    assert abs(np.linalg.norm(e[0].e) - 1) < 1e-6 and not any(e[1].e) and not any(e[2].e)


def test_sources(spark, tmp_path):
    (tmp_path / "g.csv").write_bytes("\ufeffgold;title;hours_ago\ne1;x, z;3,5\n;y;1\n".encode())
    assert [(r.gold, r.title, r.hours_ago) for r in feeds.labelled(spark, str(tmp_path / "g.csv"), "csv", least=1).collect()] == [("e1", "x, z", 3.5)]
    with pytest.raises(ValueError, match="fewer than 10"):
        feeds.labelled(spark, str(tmp_path / "g.csv"), "csv")
    (tmp_path / "g.tsv").write_text("gold\ttitle\thours_ago\n" + "a\tb\t2\n" * 12)
    assert feeds.labelled(spark, str(tmp_path / "g.tsv"), "csv").count() == 12
    (tmp_path / "g.jsonl").write_text('{"gold": "a", "title": "t", "hours_ago": 4.5}\n' * 10)
    assert feeds.labelled(spark, str(tmp_path / "g.jsonl")).first().hours_ago == 4.5
    rows = spark.createDataFrame([(2, "s", 0.9), (1, "s", 0.7), (3, " ", None), (4, None, 0.1)], "pos long, source string, authority double")
    assert {(r.source, r.authority, r["items"]) for r in feeds.sources_of(rows).collect()} == {("s", 0.7, 2), ("manual", 0.5, 2)}
    assert feeds.imported(spark.createDataFrame([("t", 2.0)], "title string, hours_ago double"), "2024-01-01 12:00:00").select(F.date_format("published_at", "HH:mm")).first()[0] == "10:00"
