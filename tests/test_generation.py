"""Context, extractive posts and their review against plain loops."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.operators import context, generation


def spread_by_hand(sentences, budget, share):
    if sum(len(s) + 1 for s in sentences) <= budget:
        return sentences
    out, used = [], 0
    while used + len(sentences[len(out)]) + 1 <= budget * share:
        used += len(sentences[len(out)]) + 1
        out.append(sentences[len(out)])
    head, rest = len(out), sentences[len(out) :]
    n = max(1, int((budget - used) / (sum(len(s) + 1 for s in rest) / len(rest) + 2)))
    last = head - 1
    for j in sorted({i * len(rest) // n for i in range(n)}):
        s = rest[j] if head + j == last + 1 else "… " + rest[j]
        if used + len(s) + 1 > budget:
            break
        out.append(s)
        used += len(s) + 1
        last = head + j
    return out


@pytest.mark.parametrize("budget", [40, 200, 1000])
def test_spread(spark, budget):
    rng = random.Random(budget)
    rows = [(i, [rng.choice("abc") * rng.randint(1, 60) for _ in range(rng.randint(1, 60))]) for i in range(60)] + [(90, []), (91, ["x" * 5000]), (92, ["a", "x" * 5000, "b"])]
    df = spark.createDataFrame([*rows, (93, None)], "i int, s array<string>")
    found = {r.i: r.picked for r in context.spread(df, "s", budget=budget).collect()}
    assert found.pop(93) == []
    for i, s in rows:
        want = spread_by_hand(s, budget, context.HEAD_SHARE) if s else []
        assert found[i] == want
        assert sum(len(x) + 1 for x in found[i]) <= budget


def test_lead_and_nearest(spark):
    rng = random.Random(2)
    rows = [(i, [f"s{j}" for j in range(n)], [rng.choice((0.1, 0.5, 0.9)) for _ in range(n)], k) for i, (n, k) in enumerate((n, k) for n in (0, 1, 2, 5, 9) for k in (1, 2, 4, 20))]
    df = spark.createDataFrame(rows, "i int, s array<string>, l array<double>, k int")
    found = {r.i: r.p for r in df.select("i", context.lead_and_nearest(F.col("s"), F.col("l"), F.col("k")).alias("p")).collect()}
    for i, s, near, k in rows:
        best = sorted(range(1, len(s)), key=lambda j: (-near[j], -j))[: k - 1]
        assert found[i] == (s if len(s) <= k else [s[0], *(s[j] for j in sorted(best))])


def test_blocks(spark):
    rows = [(s, i, f"p{i % 3}", "Top 7 things" if s == "list" else "Item", None if s == "none" else f"Lead of {i}. " + " ".join(f"Word{j} is here." for j in range(60)), [0.1] * 256, 1 - i / 10, "news") for s in ("list", "few", "none") for i in range(5)]
    rows += [("long", 9, "p", "Long", "A sentence of some length stands here. " * 400, None, 1.0, "news"), ("one", 9, "p", "One", "A b c. " * 50, [0.0] * 256, 1.0, "news"), ("video", 9, "p", "V", "A b c. " * 200, [0.0] * 256, 1.0, "curated")]
    df = spark.createDataFrame(rows, "story string, item_id int, source string, title string, text string, centroid array<double>, relevance double, mode string")
    found = {}
    for r in context.blocks(df).collect():
        found.setdefault(r.story, []).append((r.n, r.item_id, r.picked, r.longread))
    assert {s: sorted(x[0] for x in b) for s, b in found.items()} == {"list": [1, 2, 3, 4, 5], "few": [1, 2, 3, 4, 5], "none": [1, 2, 3, 4, 5], "long": [1], "one": [1], "video": [1]}
    assert all(b[2] == ["Item"] for b in found["none"])
    assert all(len(b[2]) == 24 and b[2][0] == f"Lead of {b[1]}." for b in found["list"]) and all(len(b[2]) == 3 for b in found["few"])
    assert found["long"][0][3] and 11000 < sum(len(s) + 1 for s in found["long"][0][2]) <= 12000
    assert len(found["one"][0][2]) == 12 and len(found["video"][0][2]) == 24


def extract_by_hand(blocks, most=4):
    chosen = []
    for n, sentences in blocks:
        for s in sentences:
            w = set(re.findall(r"\w+", s.lower()))
            if not w:
                continue
            for c in chosen:
                if len(w & c[2]) / len(w | c[2]) >= 0.6:
                    if n not in c[1] and len(c[1]) < 3:
                        c[1].append(n)
                    break
            else:
                if len(chosen) < most:
                    chosen.append((s, [n], w))
    return " ".join(f"{s} {''.join(f'[{n}]' for n in nums)}" for s, nums, _ in chosen)


def test_extractive_posts(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "Omega", "x1"]
    rows = [(f"s{s}", n, [" ".join(rng.choice(words) for _ in range(rng.randint(0, 5))) + rng.choice((".", "!", "")) for _ in range(rng.randint(0, 6))]) for s in range(40) for n in range(1, rng.randint(2, 7))]
    df = spark.createDataFrame(rows, "story string, n int, picked array<string>").repartition(3)
    found = {r.story: r.body for r in generation.extractive(df, 10_000).collect()}
    assert found == {s: extract_by_hand([(n, p) for t, n, p in rows if t == s]) for s in {r[0] for r in rows}}
    assert all(len(r.body) <= 61 for r in generation.extractive(df, 60).collect())


def test_review_and_gate(spark):
    good = "This is a text that is long enough to be published by itself, as it says a lot [1]. And more of it [1]."
    kind = "title string, body string, citations array<struct<article_status:string,length:long>>, other boolean, fmt string, interest double, promised int, mode string"
    rows = [
        ("T", good, [("done", 900)], False, "news", 5.0, None, "auto", "", True),
        (None, None, None, False, "news", None, None, "full_auto", "no title; no text; no sources", False),
        ("T", "Short [2].", [("failed", 10)], True, "news", 2.0, 5, "full_auto", "short text; note without its article; other language; invalid citations; list mismatch; low interest", False),
        ("T", good.replace(" [1]", ""), [("failed", None), ("done", 1)], False, "news", 3.0, None, "full_auto", "low coverage", True),
        ("T", good.replace(" [1]", ""), [("failed", None)], False, "article", None, None, "review", "", True),
        ("T", good + "x" * 400, [("done", 5)], False, "article", None, None, "auto", "too long", False),
    ]
    df = spark.createDataFrame([r[:8] for r in rows], kind)
    valid = F.coalesce(F.transform("citations", lambda c, i: i + 1), F.array().cast("array<int>"))
    df = df.withColumn("checks", T.citation_check(F.coalesce("body", F.lit("")), valid))
    reasons = generation.review(F.col("title"), F.col("body"), F.col("citations"), F.col("checks"), F.lit(300), F.col("other"), F.lit("post"), F.col("fmt"), F.col("interest"), F.when(F.col("promised") > 0, F.struct("promised")))
    found = df.withColumn("reasons", reasons).select(F.array_join("reasons", "; ").alias("r"), generation.may_publish(F.col("reasons"), F.col("mode")).alias("p")).collect()
    assert [(x.r, x.p) for x in found] == [r[8:] for r in rows]


def test_formats_and_writers(spark):
    rows = [("news", ["video"], False, "news"), ("news", [], True, "article"), ("curated", ["post", "video"], False, "video"), ("curated", ["post", "article"], False, "article"), ("curated", ["post"], False, "post"), ("curated", [], False, "article")]
    df = spark.createDataFrame([r[:3] for r in rows], "mode string, kinds array<string>, long boolean")
    assert [x.f for x in df.select(generation.content_format(F.col("mode"), F.col("kinds"), F.col("long")).alias("f")).collect()] == [r[3] for r in rows]
    cases = [("llm", False, True, 5, "news", "extractive"), ("extractive", True, True, 1, "news", "llm"), ("extractive", True, False, 3, "video", "extractive"), ("llm", True, False, 1, "news", "llm"), ("auto", True, False, 1, "video", "llm"), ("auto", True, False, 2, "news", "llm"), ("auto", True, False, 1, "news", "extractive")]
    df = spark.createDataFrame([c[:5] for c in cases], "mode string, can boolean, translate boolean, n int, fmt string")
    assert [x.w for x in df.select(generation.writer(*map(F.col, ("mode", "can", "translate", "n", "fmt"))).alias("w")).collect()] == [c[5] for c in cases]
