"""Plans of slots, pictures and origins of pages, salvaged answers, slides, captions, languages and SQL functions as queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import language, render, salvage
from tideline.functions import sql as registry
from tideline.operators import linkage, matching, schedules
from tideline.plans.queries import query, read
from tideline.sources import media


@query("""WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id % 4 AS m FROM events)
SELECT event_id, CASE WHEN m = 2 THEN 1 WHEN m = 1 THEN 2 ELSE 3 END AS n,
  round(k / 10.0 + CASE WHEN m = 2 THEN 0 ELSE least(10, k) + CASE WHEN m = 1 THEN 0 ELSE 10 END END, 6) AS total,
  CASE WHEN m = 2 THEN '' ELSE 'because of ' || k END AS reason, round(k / 10.0, 6) AS one FROM e""")
def salvaged_ratings(spark, sf_dir):
    """Answers with ratings made of each event's properties, then cut off at different places or followed by prose."""
    k, m = F.get_json_object("props", "$.k").cast("int"), F.col("event_id") % 4
    rows = read(spark, sf_dir, "events").select("event_id", k.alias("k"), m.alias("m"))
    head = F.concat(F.lit('Sure: {"1": {"score": '), (F.col("k") / 10).cast("string"), F.lit(', "reason": " because of '), F.col("k"))
    two = F.concat(head, F.lit(' "}, "2": '), F.col("k"))
    three = F.concat(two, F.lit(', "x": 5, "3": {"score": 20, "reason": "more'))
    raw = F.when(F.col("m") == 0, F.concat(three, F.lit('"}} as you wished {'))).when(F.col("m") == 1, F.concat(two, F.lit(', "3": {"sco'))).when(F.col("m") == 2, head).otherwise(three)
    rows = rows.withColumn("raw", raw).withColumn("r", salvage.ratings(F.col("raw")))
    total = F.aggregate(F.map_values("r"), F.lit(0.0), lambda a, x: a + x["score"])
    one = salvage.rating(F.replace(F.replace("raw", F.lit('{"1": '), F.lit("")), F.lit('"2"'), F.lit('{"2"')))
    return rows.select("event_id", F.size("r").alias("n"), F.round(total, 6).alias("total"), F.col("r")[1]["reason"].alias("reason"), F.round(one["score"], 6).alias("one"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(rtrim(regexp_replace(x, '\r$', ''), ' ' || chr(9)), '\s*\[\d+\]', '', 'g')), lambda x: NOT regexp_matches(x, '^\s*@\w{4,}\s*$') AND NOT regexp_matches(x, '(?i)^\s*(?:источники|sources)\s*:')) AS l FROM documents),
t AS (SELECT doc_id, l, list_position(list_transform(l, lambda x: trim(x) <> ''), true) AS pos FROM l),
s AS (SELECT doc_id, CASE WHEN pos IS NULL THEN [] ELSE l[CAST(pos + 1 AS INT):] END AS rest FROM t)
SELECT doc_id, true AS within, md5(regexp_replace(array_to_string(rest, ''), '[\s\x0B\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}☀-➿⬀-⯿\x{fe0f}\x{200d}\x{20e3}\x{1f000}-\x{1faff}]+', '', 'g')) AS kept FROM s""")
def slides(spark, sf_dir):
    """Whether every slide of a document holds 230 characters at most, and what all slides and links together hold, but for white space."""
    rows = render.scripts(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", "s", "tideline")
    held = F.concat(F.array_join("s.slides", ""), F.array_join("s.links", ""))
    return rows.select("doc_id", F.forall("s.slides", lambda x: F.length(x) <= render.SLIDE).alias("within"), F.md5(F.regexp_replace(held, r"(?U)[\s\x{2028}\x{2029}]+", "").cast("binary")).alias("kept"))


@query("""SELECT doc_id, 'Title <' || doc_id || '>' || chr(10) || chr(10) || 'In ' || lang || ': see site (https://e.org/' || doc_id || ').' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || 'Sources:' || chr(10) || '• ' || source || ': https://s.org' ELSE '' END || chr(10) || chr(10) || 'sig' AS post,
  '<b>Title &lt;' || doc_id || '&gt;</b>' || chr(10) || chr(10) || 'In <b>' || lang || '</b>: see <a href="https://e.org/' || doc_id || '">site</a>.' AS html FROM documents""")
def rendered_posts(spark, sf_dir):
    """The same short post for a wall without format and as HTML."""
    docs = read(spark, sf_dir, "documents")
    body = F.concat(F.lit("In **"), "lang", F.lit("**: see [site](https://e.org/"), F.col("doc_id"), F.lit(") [1]."))
    title = F.concat(F.lit("Title <"), F.col("doc_id"), F.lit("> [1]"))
    cited = F.when(F.col("doc_id") % 2 == 0, "https://s.org").otherwise("")
    post = render.wall_post(F.regexp_replace(title, r" \[1\]", ""), body, F.array("source", F.lit("")), F.array(cited, F.lit("https://t.org")), F.lit(" **sig** "))
    return docs.select("doc_id", post.alias("post"), render.post_html(title, body, F.lit("")).alias("html"))


@query()
def shortened_posts(spark, sf_dir):
    """Documents as HTML posts and captions within their limits, with bold words and links made of some of theirs; tested by properties and on small texts."""
    docs = read(spark, sf_dir, "documents")
    body = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"(\w{4}) (\w{3})", "**$1 $2**"), r"(\w{6})\.", "[$1](https://e.org/?a=1&b=2).")
    return docs.select("doc_id", render.post_html(F.lit("A title"), body, F.lit("\n\nfoot")).alias("html"), render.picture_caption(F.lit("A title"), body, F.lit("\n\nfoot")).alias("caption"))


@query()
def text_languages(spark, sf_dir):
    """The most likely language of every document; learned from four fifths, by a hash of doc_id."""
    docs = read(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    model = language.fit(docs.where("not held_out"))
    found = docs.select("doc_id", "lang", "held_out", "text", language.guess(model, "text").alias("g"))
    return found.select("doc_id", "lang", "held_out", F.col("g.lang").alias("guess"), F.round("g.probability", 4).alias("probability"), language.mismatch(F.col("g"), F.col("text"), "en").alias("not_english"))


@query("""WITH k AS (SELECT substr(k, 1, 40) AS key, min(doc_id) AS key_id FROM (SELECT doc_id, trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[^\\pL\\pN_]+', ' ', 'g')) AS k FROM documents WHERE text IS NOT NULL) WHERE length(substr(k, 1, 40)) >= 10 GROUP BY 1),
t AS (SELECT c, min(doc_id) AS text_id FROM (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^\\pL\\pN_]+', ' ', 'g')) AS c FROM documents) GROUP BY c)
SELECT key_id, text_id FROM k JOIN t ON contains(c, key)""".replace("\\\\", "\\"))
def caption_candidates(spark, sf_dir):
    """Which distinct texts hold which distinct first lines."""
    posts, videos = _titles_and_texts(spark, sf_dir)
    return matching.holders(posts, videos).select("key_id", "text_id")


def _titles_and_texts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    posts = docs.select(F.col("doc_id").alias("post_id"), F.substring_index("text", "\n", 1).alias("title"), (F.col("doc_id") * 600).alias("uploaded_at"))
    return posts, docs.select(F.col("doc_id").alias("video_id"), "text", (F.col("doc_id") * 7919 % 100_000 * 60).alias("created_at"))


@query()
def caption_matches(spark, sf_dir):
    """First lines and the texts that they are matched with, each once and in order of time; tested against a plain loop."""
    return matching.matched(*_titles_and_texts(spark, sf_dir))


@query()
def linked_clusters(spark, sf_dir):
    """Average linkage of each label's vectors; tested against the naive form."""
    return linkage.average_linkage(read(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.35)


@query()
def threshold_sweep(spark, sf_dir):
    """Single-pass clusters of all vectors under a grid of thresholds, judged by their labels; tested against single runs."""
    return linkage.sweep(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", "vec_id", "label", 200.0, [0.25, 0.35, 0.45, 0.6])


@query("""WITH u AS (SELECT user_id AS schedule_id, min(ts) AS created_at, user_id % 24 AS h FROM events GROUP BY user_id),
s AS (SELECT schedule_id, created_at, t AS slot FROM u, LATERAL (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-02-15 00:00:00', INTERVAL 1 DAY)) + INTERVAL 1 HOUR * CAST(h AS INT) AS t) g
  WHERE t > greatest(TIMESTAMP '2024-01-14 12:00:00', created_at - INTERVAL 10 MINUTE) AND t <= TIMESTAMP '2024-01-22 12:00:00'),
f AS (SELECT user_id AS schedule_id, date_trunc('hour', ts) AS slot, max(event_type) AS outcome FROM events WHERE event_type <> 'purchase' GROUP BY ALL),
d AS (SELECT user_id AS schedule_id, date_trunc('hour', ts) AS slot, list(event_id ORDER BY event_id) AS drafts FROM events WHERE event_type = 'purchase' GROUP BY ALL),
c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)
SELECT s.schedule_id, s.slot, s.slot - INTERVAL 30 MINUTE AS prepare_at, f.outcome, coalesce(d.drafts, []) AS drafts, (SELECT n FROM c WHERE event_type = CASE WHEN s.schedule_id % 2 = 0 THEN 'click' ELSE 'view' END) AS candidates
FROM s LEFT JOIN f USING (schedule_id, slot) LEFT JOIN d USING (schedule_id, slot) WHERE s.slot > s.created_at OR f.slot IS NOT NULL OR d.slot IS NOT NULL""")
def content_plan(spark, sf_dir):
    """A daily schedule for each user: its slots, what fired there, drafts and how many stories of its kind there are."""
    e = read(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    kinds = F.array(F.when(F.col("schedule_id") % 2 == 0, "click").otherwise("view"))
    plans = e.groupBy(F.col("user_id").alias("schedule_id")).agg(F.min("at").alias("created_at"))
    plans = plans.select("*", F.concat(F.lit("0 "), F.col("schedule_id") % 24, F.lit(" * * *")).alias("cron"), F.lit("UTC").alias("zone"), F.lit(30).alias("lead_minutes"), kinds.alias("content_kinds"))
    hour = F.date_trunc("hour", "at")
    fires = e.where("event_type <> 'purchase'").groupBy(F.col("user_id").alias("schedule_id"), hour.alias("slot")).agg(F.max("event_type").alias("outcome"))
    drafts = e.where("event_type = 'purchase'").select(F.col("event_id").alias("draft_id"), F.col("user_id").alias("schedule_id"), hour.alias("scheduled_for"), F.lit("approved").alias("status"))
    stories = e.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("candidates"))
    found = schedules.content_plan(plans, fires, drafts, stories, F.lit("2024-01-15 12:00:00+00:00").cast("timestamp"), 7)
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return found.select("schedule_id", ntz("slot"), ntz("prepare_at"), "outcome", F.transform("drafts", lambda d: d["draft_id"]).alias("drafts"), "candidates")


_WITH_MEDIA = r"""regexp_replace(html, '<a href="/([^"]*)">', '<img src="/\1.png" alt="\1"><img src="/\1.jpg" width="20px"><a href="/\1"><img src="/card-\1.png"></a><a href="/\1">', 'g')"""


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS base, regexp_extract_all(html, '<a href="/([^"]*)">', 1) AS words FROM pages),
w AS (SELECT page_id, base || '/' || words[CAST(i AS INT)] || '.png' AS url, min(i) AS i FROM p, LATERAL (SELECT unnest(range(1, len(words) + 1)) AS i) r GROUP BY ALL),
g AS (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos FROM w WHERE NOT regexp_matches(url, '(?i)(pixel|spacer|blank\.|1x1|/favicon|/logo|/icon|/avatar|/emoji|/smil|gravatar|doubleclick|/ads?/|counter|dummy|placeholder|no-?image|stub|sprite|opengraph|badge|author|profile|logo|icon|avatar|emoji)'))
SELECT page_id, url, pos FROM g WHERE pos <= 6""")
def page_pictures(spark, sf_dir):
    """Pictures beside the links of pages: each link gets one, one that is too small and one inside a link to another page."""
    html = F.regexp_replace("html", '<a href="/([^"]*)">', '<img src="/$1.png" alt="$1"><img src="/$1.jpg" width="20px"><a href="/$1"><img src="/card-$1.png"></a><a href="/$1">')
    body = F.concat(F.lit("<article>"), F.replace(F.replace(html, F.lit("<article>"), F.lit("<div>")), F.lit("</article>"), F.lit("</div>")), F.lit("</article>"))
    found = media.media(media.parsed(read(spark, sf_dir, "pages").select("page_id", "url", body.alias("body")), "page_id", "body", "url"), "page_id")
    return found.where("kind = 'image'").select("page_id", "url", F.col("at").cast("long").alias("pos"))


@query(r"""WITH p AS (SELECT page_id, lower(regexp_extract(html, '<h1>([A-Za-z]{4,})', 1)) AS w FROM pages WHERE contains(html, '</article>'))
SELECT page_id, 'https://retold.example/blog/' || w AS url, 4 + CASE WHEN length(w) >= 4 AND w NOT IN ('with', 'from', 'that', 'this', 'your', 'have', 'what', 'about', 'into', 'more', 'than', 'como', 'para') THEN 1 ELSE 0 END AS score FROM p""")
def page_origins(spark, sf_dir):
    """The page that each page retells: a link at its end that says so, among links to other sites and to documents."""
    word = F.lower(F.regexp_extract("html", "<h1>([A-Za-z]{4,})", 1))
    more = F.concat(F.lit('<p>Source: <a href="https://retold.example/blog/'), word, F.lit('">here</a>, <a href="https://other.example/x">there</a>, via <a href="https://github.com/a/b">code</a></p></article>'))
    pages = read(spark, sf_dir, "pages").where(F.contains("html", F.lit("</article>")))
    found = media.parsed(pages.select("page_id", "url", F.replace("html", F.lit("</article>"), more).alias("html")), "page_id", "html", "url")
    return media.origins(found, "page_id", ["github.com", "gitlab.com"]).select("page_id", "url", F.col("score").cast("int").alias("score"))


@query(r"""WITH v AS (SELECT label, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS first FROM embeddings GROUP BY label),
l AS (SELECT page_id % 10 AS k, sum(len(regexp_extract_all(html, '<a href="'))) AS links FROM pages GROUP BY 1)
SELECT v.label, v.first, CAST(coalesce(l.links, 0) AS BIGINT) AS links FROM v LEFT JOIN l ON v.label = l.k""")
def sql_functions(spark, sf_dir):
    """The table function page_links and the aggregate vec_avg, called from SQL."""
    registry.register(spark)
    return spark.sql(
        """SELECT v.label, round(v.c[0], 6) AS first, coalesce(l.links, 0) AS links
        FROM (SELECT label, vec_avg(embedding) AS c FROM {embeddings} GROUP BY label) v
        LEFT JOIN (SELECT page_id % 10 AS k, count(*) AS links FROM page_links(TABLE(SELECT page_id, html FROM {pages})) GROUP BY 1) l ON v.label = l.k""",
        embeddings=read(spark, sf_dir, "embeddings"), pages=read(spark, sf_dir, "pages"),
    )
