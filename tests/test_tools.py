"""Deep pages, schedules in any session zone, salvage, slides, limits, languages, pictures, SQL functions."""

from __future__ import annotations

import html
import json
import random
import re
import tracemalloc
from datetime import datetime, timezone

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.functions import language, render, salvage
from tideline.functions import sql as registry
from tideline.operators import schedules
from tideline.plans import tools  # noqa: F401  it adds its queries
from tideline.plans.queries import QUERIES
from tideline.sources import connectors, markup, media

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("tag", ["<p>a ", "<li>a ", "<b>a ", "<div>a ", "<td>a", "<p><b>a "])
def test_deep_pages(tag):
    root = markup.tree(tag * 100_000 + "</i></p>")
    assert root.text().count("a") == 100_000 and sum(1 for _ in root.all(lambda n: True)) >= 100_000
    assert markup.stripped(tag * 50_000 + "end").endswith("end") and markup.own_text("<article>" + tag * 50_000).startswith("a")


def test_open_elements_end_where_the_next_begins():
    shown = lambda n: "".join(x if isinstance(x, str) else f"({x.tag} {shown(x)})" for x in n.below)
    assert shown(markup.tree("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>e")) == "(ul (li a(ul (li b)(li c)))(li d))e"
    assert shown(markup.tree("<p>a<b>b<p>c<div><p>d</div>e")) == "(p a(b b))(p c(div (p d))e)"
    assert shown(markup.tree("<table><tr><td>a<td>b<table><tr><th>x</table><tr><td>c</table>")) == "(table (tr (td a)(td b(table (tr (th x)))))(tr (td c)))"
    assert markup.stripped("<table><tr><td>a<td>b<tr><td>c</table>") == "a; b; c"


@pytest.mark.parametrize("zone", ["+03:00", "Europe/Berlin"])
def test_times_by_the_day_are_those_of_each_row(spark, zone):
    """Around a change of the clock, at midnights and for a null."""
    start = int(datetime(2024, 3, 29, tzinfo=timezone.utc).timestamp())
    rows = spark.range(0, 400).select("id", F.when(F.col("id") > 0, F.timestamp_seconds(F.lit(start) + F.col("id") * 3599)).alias("at"))
    one = rows.select("id", schedules.upcoming(F.col("at"), "*/20 0,2,23 * * 0,3", zone, 9).alias("a"), schedules.previous(F.col("at"), "*/20 0,2,23 * * 0,3", zone, 9).alias("b"))
    many = schedules.with_times(rows, F.col("at"), "*/20 0,2,23 * * 0,3", zone, 9, "a", "b").select("id", "a", "b")
    assert {r.id: (r.a, r.b) for r in many.collect()} == {r.id: (r.a, r.b) for r in one.collect()}
    assert "Broadcast" in many._jdf.queryExecution().executedPlan().toString()


def test_large_contents_are_parsed_in_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["x" * 600, "y" * 600, None, "", "z" * 5000, "w"])], ["k", "c"])
    parts = [b.column(0).to_pylist() for b in connectors.sliced(iter([batch]), 1000)]
    assert parts == [[0], [1, 2, 3], [4], [5]]


def test_references_without_a_semicolon_stay():
    assert markup.own_text("<article><h1>A&amp;&amp</h1><p>b&nbsp;c &lt;d &#39;e&#39 f &unknown; g&h</p></article>") == "A&&amp b c <d 'e&#39 f &unknown; g&h"


@pytest.fixture
def zoned(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    yield lambda zone: spark.conf.set("spark.sql.session.timeZone", zone)
    spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("session", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_schedules_in_any_session_zone(spark, zoned, session):
    zoned(session)
    instant = lambda *x: int(datetime(*x, tzinfo=timezone.utc).timestamp() * 1_000_000)
    at = lambda *x: F.timestamp_micros(F.lit(instant(*x)))
    cases = [
        (schedules.upcoming(at(2024, 5, 1), "0 8 * * *", "+03:00"), instant(2024, 5, 1, 5)),
        (schedules.upcoming(at(2024, 3, 30, 12), "30 7 * * *", "Europe/Berlin"), instant(2024, 3, 31, 5, 30)),  # clocks go forward that night
        (schedules.upcoming(at(2024, 3, 29, 12), "30 7 * * *", "Europe/Berlin"), instant(2024, 3, 30, 6, 30)),
        (schedules.previous(at(2024, 10, 27, 12), "0 9 * * SUN", "Europe/Berlin"), instant(2024, 10, 27, 8)),  # and back
        (schedules.upcoming(at(2024, 11, 3, 4), "0 0 * * mon-fri", "America/New_York"), instant(2024, 11, 4, 5)),
        (schedules.upcoming(at(2024, 2, 28, 23, 59), "0 0 29 FEB *"), instant(2024, 2, 29)),
    ]
    found = spark.range(1).select(*[F.unix_micros(c).alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert list(found) == [want for _, want in cases]
    for expression, zone in (("*/20 6-7 * * *", "Europe/Berlin"), ("0 12 1,15 * 2", "Asia/Kolkata"), ("* * * * *", "UTC")):
        first, last = (2024, 3, 29, 1), (2024, 4, 20, 13)
        walked = [int(t.timestamp() * 1_000_000) for t in schedules.walked(expression, zone, datetime(*first, tzinfo=timezone.utc), datetime(*last, tzinfo=timezone.utc), 70)]
        slots = schedules.slots(spark.range(1), at(*first), at(*last), expression, zone, 31, 70).select(F.unix_micros("slot").alias("m"))
        assert [r.m for r in slots.collect()] == walked and len(walked) >= 5


def test_plan_leaves_out_what_was_before_its_schedule(spark):
    t = lambda h, m=0: F.lit(f"2024-01-15 {h:02}:{m:02}:00").cast("timestamp")
    one = spark.createDataFrame([(1,)], "schedule_id long")
    plans = one.select("schedule_id", F.lit("0 * * * *").alias("cron"), F.lit("UTC").alias("zone"), t(9, 5).alias("created_at"), F.lit(15).alias("lead_minutes"), F.array(F.lit("a"), F.lit("b")).alias("content_kinds"))
    fires = one.select("schedule_id", t(10).alias("slot"), F.lit("skipped").alias("outcome"))
    drafts = one.select(F.lit(7).cast("long").alias("draft_id"), "schedule_id", t(9).alias("scheduled_for"), F.lit("approved").alias("status"))
    kinds = spark.createDataFrame([("a", 2), ("b", 3), ("c", 9)], "kind string, candidates long")

    def plan(drafts):
        return [(r.slot.hour, r.prepare_at.minute, r.outcome, [d.draft_id for d in r.drafts], r.candidates) for r in schedules.content_plan(plans, fires, drafts, kinds, t(11, 30), 0).orderBy("slot").collect()]

    assert plan(drafts) == [(9, 45, None, [7], 5), (10, 45, "skipped", [], 5), (11, 45, None, [], 5)]
    assert [r[0] for r in plan(drafts.limit(0))] == [10, 11]


def test_repaired_json_is_what_was_complete():
    rng = random.Random(2)

    def value(depth):
        kind = rng.randrange(6 if depth else 4)
        if kind == 4:
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        if kind == 5:
            return {f"k{rng.randrange(9)}": value(depth - 1) for _ in range(rng.randint(0, 3))}
        return [rng.randint(-5, 500), 'a "b" [c] {d}, \\ é', None, rng.random() < 0.5][kind]

    def inside(part, whole):
        if isinstance(part, dict):
            return isinstance(whole, dict) and all(k in whole and inside(v, whole[k]) for k, v in part.items())
        if isinstance(part, list):
            return isinstance(whole, list) and len(part) <= len(whole) and all(map(inside, part, whole))
        return part == whole

    for _ in range(300):
        whole = [value(3) for _ in range(4)] if rng.random() < 0.5 else {str(i): value(3) for i in range(4)}
        text = json.dumps(whole, ensure_ascii=rng.random() < 0.5)
        opening, last = text[0], -1
        for cut in range(len(text) + 1):
            got = salvage.repaired("So: " + text[:cut], opening)
            if got is not None:
                found = json.loads(got)
                assert inside(found, whole)
                assert len(found) >= last  # more text never gives less
                last = len(found)
        assert json.loads(salvage.repaired(text + " thanks ]}", opening)) == whole
    assert salvage.repaired("nothing", "[") is None and salvage.repaired(None, "[") is None and salvage.repaired("[1, 2}", "[") == "[1, 2]"


def test_salvaged_lists_and_ratings(spark):
    rows = [(1, 'Here: ["One  thing.", "one thing", "ab", "Two", "thr'), (2, None), (3, "no list"), (4, '{"score": 12.5, "reason": " r "} x'), (5, 'I give it 7,5 of 10'), (6, '{"reason": "none"}'), (7, '{"1": {"score": 3, "reason": "x \\" y"}, "b": 2, "2": "9", "3": {"reas')]
    df = spark.createDataFrame(rows, "i int, t string")
    found = {r.i: r for r in df.select("i", salvage.phrases(F.col("t"), 5, " .;,").alias("p"), salvage.rating(F.col("t")).alias("r"), salvage.ratings(F.col("t")).alias("m")).collect()}
    assert found[1].p == ["One thing", "Two"] and found[2].p == found[3].p == []
    assert tuple(found[4].r) == (10.0, "r") and tuple(found[5].r) == (7.0, "") and found[6].r is None and found[2].r is None and found[3].r is None
    assert {k: tuple(v) for k, v in found[7].m.items()} == {1: (3.0, 'x " y'), 2: (9.0, "")} and found[2].m == {}


def packed_by_hand(paragraph, limit):
    if len(paragraph) <= limit:
        return [paragraph]
    out, cur = [], ""
    for s in re.split(r"(?<=[.!?…])\s+", paragraph):
        units = [s] if len(s) <= limit else [w[i : i + limit] for w in s.split() for i in range(0, len(w), limit)]
        for u in units:
            if cur and len(cur) + 1 + len(u) > limit:
                out.append(cur)
                cur = u
            else:
                cur = f"{cur} {u}".strip()
    return [*out, cur] if cur else out


def test_chunks(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("x" * rng.choice((1, 3, 8, 70 if i % 5 == 0 else 9)) + rng.choice(("", "", ".", "!")) for _ in range(rng.randint(1, 60)))) for i in range(80)]
    found = {r.i: r.c for r in spark.createDataFrame(rows, "i int, t string").select("i", render.chunks(F.col("t"), 60).alias("c")).collect()}
    assert found == {i: packed_by_hand(t, 60) for i, t in rows}


def test_script(spark):
    text = "\n Title [1]  \n\nFirst one. And\U0001f600 more [2].\n• a\n• b\nRepo 👉 x.org\n@channel\nSources: y\n\nLast."
    df = spark.createDataFrame([(text,), (None,), ("Only",)], "t string")
    full, none, only = (r.s for r in render.scripts(df, "t", "s", "@me", "#tag").collect())
    assert full.title == "Title" and full.slides == ["First one. And more.\n• a\n• b", "Last."] and full.links == ["Repo x.org"]
    assert full.caption == "Title\n\nFirst one.\n\nMore and links on Telegram @me\n\n#tag"
    assert (none.title, none.slides) == ("", []) and (only.title, only.slides) == ("Only", [])


def balanced(text):
    stack = []
    for end, name in re.findall(r"<(/?)(\w+)[^>]*>", text):
        if not end:
            stack.append(name)
        elif not stack or stack.pop() != name:
            return False
    return not stack and "<" not in re.sub(r"<[^>]*>", "", text)


def test_shortened():
    rng = random.Random(4)
    for _ in range(300):
        parts = [rng.choice(("word & more", "**bold words here**", "[a linked text](https://e.org/?a=1&b=2)", "x" * 40, "<tag>", "[no link]", "*", "line\n\nline")) for _ in range(rng.randint(0, 12))]
        text = " ".join(parts)
        whole = render.shortened(text, 10**6, True)
        for room in (1, 20, 60, 200):
            for tags in (True, False):
                got = render.shortened(text, room, tags)
                seen = html.unescape(re.sub(r"<[^>]*>", "", got))
                assert balanced(got) and (len(got) if tags else len(seen)) <= room
                assert got == whole or got.endswith("…") and html.unescape(re.sub(r"<[^>]*>", "", whole)).startswith(seen[:-1])


def test_shortening_holds_no_more_than_its_room():
    text = "word & more " * 200_000
    tracemalloc.start()
    assert len(render.shortened(text, 100, True)) <= 100
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 20


def test_posts_keep_their_limits(spark):
    for r in QUERIES["shortened_posts"](spark, SF).collect():
        assert len(r.html) <= render.POST and balanced(r.html.replace("\n\nfoot", "")) and r.html.endswith("foot")
        assert len(html.unescape(re.sub(r"<[^>]*>", "", r.caption))) <= render.PICTURE and balanced(r.caption)


def test_pages_are_parsed_once_for_all_lists(spark, capsys):
    pages = [(1, "http://e.org/a/b?x", '<img src="/x.png"><img src="/y.gif"><video src="/f.mp4" poster="/p.jpg"></video><div data-v="/g.mp4"></div><img src="../z.png"><img src="/x.png">')]
    found = media.media(media.parsed(spark.createDataFrame(pages, "i int, url string, html string"), "i", "html", "url"), "i")
    found.explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    rows = {(r.kind, r.url, r.poster, r.at) for r in found.collect()}
    assert rows == {
        ("image", "http://e.org/x.png", None, 0), ("animation", "http://e.org/y.gif", None, 0), ("image", "http://e.org/p.jpg", None, 1), ("image", "http://e.org/z.png", None, 2),
        ("video", "http://e.org/f.mp4", "http://e.org/p.jpg", 1), ("video", "http://e.org/g.mp4", None, 2),
    }


def test_languages(spark):
    rows = QUERIES["text_languages"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out and r.guess]
    right = sum(r.guess == r.lang for r in held)
    assert len(rows) == 1000 and len(held) > 120 and right / len(held) > 0.95
    model = language.fit(spark.createDataFrame([("the cat and the dog " * 9, "en"), ("кошка и собака там " * 9, "ru"), (None, "fr"), ("x", None)], "text string, lang string"))
    assert model.names == ["en", "ru"]
    texts = spark.createDataFrame([(0, "the dog and a cat are there, says the other dog " * 2), (1, "собака и кошка, там ещё одна собака была " * 2), (2, "short"), (3, None), (4, "да нет вот так и всё тут было")], "i int, t string")
    got = {r.i: r for r in texts.select("i", language.guess(model, "t").alias("g"), language.mismatch(language.guess(model, "t"), F.col("t"), "en").alias("m")).collect()}
    assert (got[0].g.lang, got[1].g.lang, got[2].g.lang, got[3].g.lang) == ("en", "ru", None, None)
    assert [got[i].m for i in range(5)] == [False, True, False, False, True]


PAGE = """<html><head><title>Scale a million sandboxes at Modal</title><meta property="og:image" content="/card.jpg"><meta property="og:video" content="/film.mp4?x=1"></head><body><article>
<img src="/a.png"><img src="/a.png"><img src="data:x" srcset="/b.jpg 1x, /c.jpg 2x"><img src="/small.png" width="99"><img src="/x.png" class="avatar"><img src="https://shields.io/x.png">
<a href="/other"><img src="/related.png"></a><a href="/full.png"><img src="/thumb.png"></a><a href="https://ads.org/?utm_source=x"><img src="/ad1.png"></a><img src="/anim.gif?v=1"><img src="/v.svg">
<video src="/film.mp4" poster="/poster.jpg"><source src="/other.webm" type="video/webm"></video><uni-x or-mp4-video-url="/own.mp4"></uni-x>
<a href="https://modal.com/blog/scaling-sandboxes">x</a> source: <a href="https://github.com/a/b">code</a> <a href="https://site.org/blog/million-sandboxes">own</a><a href="https://docs.other.org/x">docs</a>
</article></body></html>"""


def test_page_media(spark):
    pages = spark.createDataFrame([(1, "https://site.org/news/1", PAGE), (2, "https://site.org/", None), (3, None, ""), (4, "https://s.org/", "<img src='/i.png'>" + "".join(f"<img src='/p{i}.png'>" for i in range(9)))], "id long, url string, html string")
    found = media.parsed(pages, "id", "html", "url")
    rows = media.media(found, "id").orderBy("id", "kind", "at").collect()
    images = [r.url.removeprefix("https://site.org") for r in rows if r.id == 1 and r.kind == "image"]
    assert images == ["/a.png", "/b.jpg", "/thumb.png", "/poster.jpg", "/card.jpg"]
    films = {(r.kind, r.url.removeprefix("https://site.org")) for r in rows if r.id == 1 and r.kind != "image"}
    assert films == {("animation", "/anim.gif?v=1"), ("video", "/film.mp4"), ("video", "/other.webm")}  # three at most
    assert [r.url for r in rows if r.id == 4] == ["https://s.org/i.png", *(f"https://s.org/p{i}.png" for i in range(6))] and {r.id for r in rows} == {1, 4}
    assert [tuple(r) for r in media.origins(found, "id", ["github.com"]).collect()] == [(1, "https://modal.com/blog/scaling-sandboxes", 5)]
    cover = spark.range(1).select(media.cover(F.array(*map(F.lit, "abcaed")), F.array(F.lit("b"))).alias("c"), media.cover(F.array(F.lit(""), F.lit("x")), F.lit(None).cast("array<string>")).alias("d")).first()
    assert (cover.c, cover.d) == (["a", "c", "e"], ["x"])


def test_archived_and_status(spark):
    df = spark.createDataFrame([(200,), (403,), (None,)], "status int")
    assert [r.a for r in df.select(connectors.needs_archive(F.col("status")).alias("a")).collect()] == [False, True, None]


def test_sql_functions(spark):
    assert set(registry.register(spark)) == {"minhash_sig", "hash_embed", "strip_html", "vec_avg", "page_links", "cron_slots"}
    assert spark.sql("SELECT strip_html('<p>a<p>b') AS s, size(minhash_sig('abc')) AS m, size(hash_embed('some words')) AS e").first().asDict() == {"s": "a b", "m": 64, "e": 256}
    slots = spark.sql("SELECT at FROM cron_slots('0 0 * * *', 'UTC', 0, 200000)").collect()
    assert [r["at"] for r in slots] == [86400, 172800]
    spark.createDataFrame([(1, "<a href='x'>One  two</a><a>no</a><a href='y'>z</a>", 9), (2, None, 8)], "id int, html string, more int").createOrReplaceTempView("some_pages")
    links = spark.sql("SELECT * FROM page_links(TABLE(some_pages)) ORDER BY place")
    assert links.columns == ["id", "more", "place", "href", "anchor"] and [tuple(r) for r in links.collect()] == [(1, 9, 0, "x", "One two"), (1, 9, 1, "y", "z")]
    spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("a", None), ("b", None)], "k string, v array<double>").createOrReplaceTempView("some_vectors")
    assert {r.k: r.m for r in spark.sql("SELECT k, vec_avg(v) AS m FROM some_vectors GROUP BY k").collect()} == {"a": [2.0, 4.0], "b": None}
