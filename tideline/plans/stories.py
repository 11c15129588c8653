"""Queries of the story operators: documents are items, dealt to sixty stories; the SQL is written apart from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import stories as S
from tideline.plans.queries import query, read


def now() -> Column:
    return F.lit("2024-01-31 00:00:00").cast("timestamp")

TOPIC = [((p * 7) % 5 - 2) / 2 for p in range(64)]

_BASE = """WITH i AS (SELECT d.doc_id AS item_id, CASE WHEN d.doc_id % 17 <> 0 THEN d.source END AS source_id, d.doc_id % 60 AS cluster_id,
  CASE d.doc_id % 10 WHEN 0 THEN 'duplicate' WHEN 1 THEN 'new' ELSE 'clustered' END AS status, CASE d.doc_id % 3 WHEN 0 THEN 'post' WHEN 1 THEN 'video' ELSE 'article' END AS kind,
  TIMESTAMP '2024-01-31 00:00:00' - (d.doc_id * 37 % 400) * INTERVAL 1 HOUR AS published_at, d.text, CASE WHEN d.doc_id % 60 % 7 <> 0 THEN l.quality * 0.8 + 0.1 END AS topic_score,
  e.embedding AS title_embedding, CASE WHEN d.doc_id % 3 = 1 THEN d.n_chars * 10 END AS views, CASE WHEN d.doc_id % 5 = 1 THEN d.n_chars END AS likes
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
m AS (SELECT * FROM i WHERE status <> 'new'),
s AS (SELECT DISTINCT source AS source_id, 0.5 + (length(source) % 5) / 10.0 AS authority, CASE WHEN length(source) % 2 = 0 THEN 1.3 END AS performance FROM documents WHERE source IS NOT NULL),
c AS (SELECT cluster_id, CASE WHEN cluster_id % 4 = 0 THEN 'curated' ELSE 'news' END AS mode, CASE cluster_id % 6 WHEN 0 THEN 'published' WHEN 1 THEN 'closed' ELSE 'open' END AS state,
  max(published_at) AS last_seen, count(*) AS item_count, greatest(count(DISTINCT source_id), 1) AS source_count, count(*) // 2 AS item_count_at_publish,
  CASE WHEN cluster_id % 3 <> 0 THEN CAST(cluster_id * 7 % 11 AS DOUBLE) END AS interest, CASE WHEN cluster_id % 5 = 0 THEN 1 ELSE count(*) END AS interest_items, 'Story ' || cluster_id AS title FROM m GROUP BY cluster_id),
f AS (SELECT c.*, age / 1.0 AS age, (SELECT count(*) FROM m WHERE m.cluster_id = c.cluster_id AND m.published_at >= TIMESTAMP '2024-01-30 18:00:00') AS recent,
  (SELECT coalesce(max(length(trim(text, ' '))), 0) FROM m WHERE m.cluster_id = c.cluster_id) AS content_length,
  (SELECT max(greatest(CASE WHEN views >= 0 THEN least(1.0, ln(1 + views) / ln(1000001.0)) END, CASE WHEN likes >= 0 THEN least(1.0, ln(1 + likes) / ln(50001.0)) END)) FROM m WHERE m.cluster_id = c.cluster_id) AS engagement,
  coalesce((SELECT avg(a) FROM (SELECT DISTINCT m.cluster_id AS k, s.source_id, least(1.0, authority * coalesce(performance, 1.0)) AS a FROM m JOIN s ON m.source_id = s.source_id) x WHERE x.k = c.cluster_id), 0.5) AS authority,
  (SELECT avg(topic_score) FROM i WHERE i.cluster_id = c.cluster_id AND i.status = 'clustered') AS topic_score
  FROM (SELECT *, date_diff('second', last_seen, TIMESTAMP '2024-01-31 00:00:00') / 3600.0 AS age FROM c) c WHERE state <> 'closed' AND age <= CASE WHEN mode = 'curated' THEN 336 ELSE 48 END),
v AS (SELECT cluster_id, list(x ORDER BY p) AS title FROM (SELECT cluster_id, p, avg(CAST(title_embedding[p] AS DOUBLE)) AS x FROM (SELECT cluster_id, title_embedding, unnest(range(1, 65)) AS p FROM i WHERE status = 'clustered' AND title_embedding IS NOT NULL) GROUP BY cluster_id, p) GROUP BY cluster_id),
t AS (SELECT f.*, CASE WHEN topic_score IS NOT NULL THEN topic_score WHEN v.title IS NULL THEN 0.5 ELSE greatest(0.0, list_cosine_similarity(v.title, [((p * 7) % 5 - 2) / 2.0 FOR p IN range(0, 64)])) END AS fit, topic_score IS NULL AND v.title IS NULL AS neutral FROM f LEFT JOIN v USING (cluster_id)),
r AS (SELECT *, round(fit, 4) AS topic, round(CASE WHEN mode = 'curated' THEN 0.55 * fit + 0.15 * coalesce(engagement, 0.5) + 0.10 * authority + 0.10 * pow(0.5, age / 84.0) + 0.10 * least(1.0, content_length / 4000.0)
  ELSE 0.15 * least(1.0, ln(1 + source_count) / ln(9.0)) + 0.075 * authority + 0.10 * pow(0.5, age / 12.0) + 0.075 * least(1.0, recent / 5.0) + 0.60 * fit END, 4) AS score FROM t),
k AS (SELECT cluster_id, arg_min(kind, {'p': CASE kind WHEN 'video' THEN 1 WHEN 'article' THEN 2 ELSE 3 END, 'i': item_id}) AS first FROM i WHERE status = 'clustered' GROUP BY cluster_id),
u AS (SELECT DISTINCT source_id FROM i WHERE item_id % 23 = 7 AND source_id IS NOT NULL),
w AS (SELECT r.*, CASE WHEN mode = 'news' THEN 'news' ELSE coalesce(k.first, 'article') END AS kind, row_number() OVER (ORDER BY topic DESC, score DESC, r.cluster_id) - 1 AS pos FROM r LEFT JOIN k ON k.cluster_id = r.cluster_id WHERE
  ((mode = 'curated' AND state = 'open') OR (mode = 'news' AND state = 'open' AND (item_count >= 14 OR coalesce(interest >= 6, false))) OR (mode = 'news' AND state = 'published' AND item_count >= item_count_at_publish * 1.5 AND item_count - item_count_at_publish >= 3))
  AND (neutral OR topic >= 0.3) AND EXISTS (SELECT 1 FROM m WHERE m.cluster_id = r.cluster_id AND (m.source_id IS NULL OR m.source_id NOT IN (SELECT source_id FROM u)))
  ORDER BY pos LIMIT 40)
"""


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """items, clusters, sources made from the test tables."""
    docs = read(spark, sf_dir, "documents")
    d = F.col("doc_id")
    items = docs.join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    items = items.join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("title_embedding")), "doc_id", "left")
    items = items.select(
        d.alias("item_id"), F.when(d % 17 != 0, F.col("source")).alias("source_id"), (d % 60).alias("cluster_id"),
        F.when(d % 10 == 0, "duplicate").when(d % 10 == 1, "new").otherwise("clustered").alias("status"),
        F.when(d % 3 == 0, "post").when(d % 3 == 1, "video").otherwise("article").alias("kind"),
        (now() - F.make_dt_interval(F.lit(0), (d * 37 % 400).cast("int"))).alias("published_at"), "text",
        F.when(d % 60 % 7 != 0, F.col("quality") * 0.8 + 0.1).alias("topic_score"), "title_embedding",
        F.create_map(F.lit("views"), F.when(d % 3 == 1, F.col("n_chars") * 10).cast("double"), F.lit("likes"), F.when(d % 5 == 1, F.col("n_chars")).cast("double")).alias("meta"),
    )
    sources = docs.where("source is not null").select(F.col("source").alias("source_id")).distinct()
    sources = sources.withColumns({"authority": 0.5 + (F.length("source_id") % 5) / 10, "performance": F.when(F.length("source_id") % 2 == 0, 1.3)})
    k = F.col("cluster_id")
    clusters = S.members(items).groupBy("cluster_id").agg(F.max("published_at").alias("last_seen"), F.count("*").alias("item_count"), F.greatest(F.countDistinct("source_id"), F.lit(1)).alias("source_count"))
    clusters = clusters.withColumns(
        {
            "mode": F.when(k % 4 == 0, "curated").otherwise("news"), "state": F.when(k % 6 == 0, "published").when(k % 6 == 1, "closed").otherwise("open"),
            "item_count_at_publish": F.floor(F.col("item_count") / 2), "interest": F.when(k % 3 != 0, (k * 7 % 11).cast("double")),
            "interest_items": F.when(k % 5 == 0, 1).otherwise(F.col("item_count")), "title": F.concat(F.lit("Story "), k.cast("string")), "centroid": F.array(F.lit(1.0)),
        }
    )
    return items, clusters, sources


def _features(spark, sf_dir):
    items, clusters, sources = tables(spark, sf_dir)
    return S.features(clusters, items, sources, now()), items


def _scored(spark, sf_dir):
    found, items = _features(spark, sf_dir)
    return S.scores(found, now(), TOPIC), items


def _selected(spark, sf_dir):
    scored, items = _scored(spark, sf_dir)
    recent = items.where("item_id % 23 = 7 and source_id is not null").select("source_id")
    return S.selected(scored, items, now(), 40, min_items=14, topic_threshold=0.3, single=6.0, recent=recent), items


@query(_BASE + "SELECT cluster_id, recent, content_length, round(engagement, 6) AS engagement, round(authority, 6) AS authority, round(topic_score, 6) AS topic_score FROM f")
def story_features(spark, sf_dir):
    found, _ = _features(spark, sf_dir)
    return found.select("cluster_id", "recent", F.col("content_length").cast("long").alias("content_length"), *[F.round(c, 6).alias(c) for c in ("engagement", "authority", "topic_score")])


@query(_BASE + "SELECT cluster_id, score, topic, neutral FROM r")
def story_scores(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    return scored.select("cluster_id", "score", F.col("breakdown")["topic_fit"]["value"].alias("topic"), F.col("breakdown")["topic_fit"]["neutral"].alias("neutral"))


@query(_BASE + "SELECT cluster_id, pos, kind FROM w")
def select_stories(spark, sf_dir):
    found, _ = _selected(spark, sf_dir)
    return found.select("cluster_id", F.col("pos").cast("long").alias("pos"), "kind")


@query(_BASE + "SELECT w.cluster_id, len(list_distinct(list(m.source_id))) AS n FROM w JOIN m ON m.cluster_id = w.cluster_id AND m.source_id IS NOT NULL GROUP BY w.cluster_id")
def story_sources(spark, sf_dir):
    found, items = _selected(spark, sf_dir)
    return S.sources_of(found, items).where(F.size("source_ids") > 0).select("cluster_id", F.size("source_ids").cast("long").alias("n"))


@query(_BASE + """, e AS (SELECT DISTINCT w.cluster_id, w.pos, m.source_id FROM w JOIN m ON m.cluster_id = w.cluster_id AND m.source_id IS NOT NULL)
SELECT cluster_id, pos FROM w WHERE cluster_id NOT IN (SELECT cluster_id FROM e) OR EXISTS (SELECT 1 FROM e x WHERE x.cluster_id = w.cluster_id AND NOT EXISTS (SELECT 1 FROM e y WHERE y.source_id = x.source_id AND y.pos < x.pos))""")
def diversified_stories(spark, sf_dir):
    """Stories with a source that none before them has; tested against a plain fold too."""
    found, items = _selected(spark, sf_dir)
    return S.diversified(S.sources_of(found, items)).select("cluster_id", "pos")


@query(_BASE + """, n AS (SELECT *, interest IS NULL OR item_count >= interest_items * 1.5 AS needs FROM w), o AS (SELECT *, sum(CASE WHEN needs THEN 1 ELSE 0 END) OVER (ORDER BY pos) AS turn FROM n),
p AS (SELECT cluster_id, pos, CASE WHEN needs AND turn <= 12 THEN CASE WHEN cluster_id % 2 = 0 THEN CAST(cluster_id % 10 AS DOUBLE) END ELSE interest END AS interest FROM o)
SELECT cluster_id, interest FROM p ORDER BY coalesce(interest, 5.0) DESC, pos LIMIT 15""")
def stories_by_interest(spark, sf_dir):
    found, _ = _selected(spark, sf_dir)
    ratings = spark.range(0, 60, 2).select(F.col("id").alias("cluster_id"), (F.col("id") % 10).alias("rating"))
    return S.by_interest(found, ratings, 15).select("cluster_id", "interest")


@query(_BASE + "SELECT cluster_id FROM w WHERE state = 'open' AND coalesce(interest, 0) >= 4 ORDER BY interest DESC, pos LIMIT (SELECT greatest(0, 20 - count(*) FILTER (WHERE event_type <> 'error' AND user_id % 40 = 0 AND ts > TIMESTAMP '2024-01-30 00:00:00')) FROM events)")
def instant_stories(spark, sf_dir):
    found, _ = _selected(spark, sf_dir)
    events = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("created_at"), (F.col("user_id") % 40 == 0).alias("instant"), F.when(F.col("event_type") == "error", "failed").otherwise("sent").alias("status"))
    return S.instant(found, 4.0, S.remaining(events, now(), 20)).select("cluster_id")


@query(_BASE + ", n AS (SELECT *, interest IS NULL OR interest < 3 AS low FROM w), o AS (SELECT *, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (ORDER BY pos) AS rank FROM n) SELECT cluster_id, CASE WHEN low THEN 'below_interest_floor' WHEN rank <= 5 THEN 'chosen' ELSE 'spare' END AS status FROM o")
def slot_stories(spark, sf_dir):
    found, _ = _selected(spark, sf_dir)
    return S.slot(found, 5, 3.0).select("cluster_id", "status")


@query(_BASE + "SELECT cluster_id, title, score FROM r WHERE title ILIKE '%story 1%' AND score >= 0.2 ORDER BY state = 'open' DESC, topic DESC, score DESC NULLS LAST, cluster_id DESC LIMIT 5 OFFSET 1")
def story_page(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    return S.story_list(scored, contains="STORY 1", score=0.2, most=5, skip=1).select("cluster_id", "title", "score")


@query(_BASE + "SELECT cluster_id, count(*) AS n, list(date_diff('hour', published_at, TIMESTAMP '2024-01-31 00:00:00') ORDER BY published_at) AS hours FROM m GROUP BY cluster_id")
def story_arrivals(spark, sf_dir):
    items, _, _ = tables(spark, sf_dir)
    found = S.arrivals(items)
    return found.select("cluster_id", F.size("arrivals").cast("long").alias("n"), F.transform("arrivals", lambda t: F.round(S.age_hours(t, now())).cast("long")).alias("hours"))


def _drafts(spark: SparkSession) -> DataFrame:
    return spark.range(20).select(F.col("id").alias("draft_id"), F.array(F.col("id") * 3, F.col("id") * 2 + 1).alias("cluster_ids"))


_DRAFTS = ", d AS (SELECT draft_id, unnest([draft_id * 3, draft_id * 2 + 1]) AS cluster_id FROM (SELECT unnest(range(20)) AS draft_id))"


@query(_BASE + _DRAFTS + " SELECT draft_id, string_agg(title, ' · ' ORDER BY score DESC NULLS LAST, d.cluster_id) AS titles FROM d JOIN r USING (cluster_id) GROUP BY draft_id")
def draft_titles(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    return S.titles_of(_drafts(spark), scored)


@query(_BASE + _DRAFTS + " SELECT draft_id, item_id FROM d JOIN i USING (cluster_id)")
def draft_items(spark, sf_dir):
    items, _, _ = tables(spark, sf_dir)
    return S.of_drafts(_drafts(spark), items).select("draft_id", "item_id")


@query(_BASE + ", q AS (SELECT DISTINCT cluster_id FROM w WHERE pos < 10) SELECT c.cluster_id, CASE WHEN q.cluster_id IS NOT NULL AND state = 'open' THEN 'drafted' WHEN state = 'open' AND date_diff('second', last_seen, TIMESTAMP '2024-01-31 00:00:00') / 3600.0 > CASE WHEN mode = 'curated' THEN 336 ELSE 48 END THEN 'closed' ELSE state END AS state FROM c LEFT JOIN q USING (cluster_id)")
def claimed_stories(spark, sf_dir):
    found, _ = _selected(spark, sf_dir)
    _, clusters, _ = tables(spark, sf_dir)
    return S.claimed(S.closed(clusters, now()), found.where("pos < 10")).select("cluster_id", "state")


@query(_BASE + _DRAFTS + ", g AS (SELECT cluster_id FROM c WHERE state <> 'published' AND cluster_id NOT IN (SELECT cluster_id FROM d)) SELECT item_id, CASE WHEN g.cluster_id IS NULL THEN i.cluster_id END AS cluster_id, CASE WHEN g.cluster_id IS NULL THEN status ELSE 'ignored' END AS status FROM i LEFT JOIN g ON g.cluster_id = i.cluster_id")
def cleared_items(spark, sf_dir):
    items, clusters, _ = tables(spark, sf_dir)
    return S.cleared(clusters.withColumn("published_at", F.lit(None).cast("timestamp")), items, _drafts(spark))[1].select("item_id", "cluster_id", "status")


@query("""WITH h AS (SELECT lang AS type, source AS value, doc_id % 5 AS query, left(text, 12) AS title, doc_id AS pos, CASE WHEN doc_id % 3 = 0 THEN doc_id % 11 END AS rating FROM documents WHERE source IS NOT NULL),
f AS (SELECT type, value, count(DISTINCT query) AS hits, max(rating) AS rating FROM h WHERE value NOT LIKE '%1' GROUP BY type, value),
g AS (SELECT *, round(CASE WHEN rating IS NULL THEN least(1.0, hits / 3.0) ELSE 0.4 * least(1.0, hits / 3.0) + 0.6 * rating / 10.0 END, 4) AS score FROM f),
r AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY type ORDER BY score DESC, hits DESC, value) <= 10 ORDER BY score DESC, hits DESC, value, type LIMIT 30)
SELECT r.type, r.value, r.hits, r.score, (SELECT list(title ORDER BY p, title)[:3] FROM (SELECT title, min(pos) AS p FROM h WHERE h.type = r.type AND h.value = r.value AND title <> '' GROUP BY title)) AS samples FROM r""")
def source_suggestions(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("source is not null")
    d = F.col("doc_id")
    hits = docs.select(F.col("lang").alias("type"), F.col("source").alias("value"), (d % 5).alias("query"), F.substring("text", 1, 12).alias("title"), d.alias("pos"), F.when(d % 3 == 0, d % 11).alias("rating"))
    return S.suggestions(hits, hits.where(F.col("value").endswith("1")).select("type", "value")).select("type", "value", "hits", "score", "samples")


@query("SELECT count(*) AS n FROM documents WHERE doc_id % 7 <> 0 AND (doc_id % 2 = 0 OR doc_id * 37 % 400 <= 48)")
def new_item_count(spark, sf_dir):
    d = F.col("doc_id")
    items = read(spark, sf_dir, "documents").select(F.md5(d.cast("string")).alias("url_hash"), d, F.when(d % 2 == 0, "curated").otherwise("news").alias("mode"), (now() - F.make_dt_interval(F.lit(0), (d * 37 % 400).cast("int"))).alias("published_at"))
    return S.new_items(items, items.where(d % 7 == 0), now()).agg(F.count("*").alias("n"))


@query(_BASE + "SELECT cluster_id FROM r WHERE state = 'open' AND (item_count >= 15 OR interest >= 5) AND (neutral OR topic >= 0.3) ORDER BY topic DESC, score DESC NULLS LAST, cluster_id LIMIT 6")
def story_dashboard(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    return S.dashboard(scored, 15, 5.0, 0.3).select("cluster_id")


@query(_BASE + ", g AS (SELECT cluster_id, arg_max(item_id, {'p': published_at, 'i': item_id}) AS image_item_id FROM m WHERE item_id % 3 = 1 GROUP BY cluster_id) SELECT r.cluster_id, image_item_id FROM r JOIN g USING (cluster_id) WHERE (mode = 'curated' OR item_count >= 12) AND (state = 'published' OR neutral OR topic >= 0.3) AND interest >= 6 AND title ILIKE '%story%'")
def story_view(spark, sf_dir):
    scored, items = _scored(spark, sf_dir)
    pictured = items.withColumn("image_url", F.when(F.col("item_id") % 3 == 1, "x"))
    rows = scored.join(S.image_items(pictured), "cluster_id", "left")
    return S.view(rows, min_items=12, threshold=0.3, contains=" STORY", interest="high", images=True, by="date").select("cluster_id", "image_item_id")


@query("""WITH c AS (SELECT label, list(m ORDER BY p) AS centroid FROM (SELECT label, p, avg(CAST(embedding[p] AS DOUBLE)) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings) GROUP BY label, p) GROUP BY label)
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid) + 0.15 * (label / 10.0), 6) AS relevance, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid), 6) AS distance, len(embedding) AS dims, greatest(300, 7000 // greatest(vec_id % 30, 1)) AS cap FROM embeddings JOIN c USING (label)""")
def item_relevance(spark, sf_dir):
    from tideline.functions import vectors as V

    items = read(spark, sf_dir, "embeddings").withColumnRenamed("label", "cluster_id").withColumn("authority", F.col("cluster_id") / 10)
    centroids = V.mean_vector(items, ["cluster_id"], "embedding")
    rows = S.relevance(items, centroids).join(centroids, "cluster_id")
    return rows.select("vec_id", F.round("relevance", 6).alias("relevance"), F.round(V.distance("embedding", "centroid"), 6).alias("distance"), V.dimensions("embedding").cast("long").alias("dims"), S.context_cap(F.col("vec_id") % 30).alias("cap"))


_CRON = "SELECT t FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-01 00:00:00', TIMESTAMP '2025-02-01 00:00:00', INTERVAL 1 MINUTE)) AS t) WHERE minute(t + INTERVAL 3 HOURS) IN (0, 15, 30, 45) AND hour(t + INTERVAL 3 HOURS) IN (8, 9, 10) AND dayofweek(t + INTERVAL 3 HOURS) IN (1, 3)"


@query(f"WITH f AS ({_CRON}), a AS (SELECT event_id, t AS next FROM events ASOF JOIN f ON ts < t), b AS (SELECT event_id, t AS last FROM events ASOF JOIN f ON ts >= t) SELECT event_id, a.next, b.last FROM a JOIN b USING (event_id)")
def schedule_times(spark, sf_dir):
    """Mondays and Wednesdays, each quarter of the hours from 8 to 10, three hours east."""
    from tideline.operators import schedules as C

    e = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    found = C.with_times(e, F.col("at"), "*/15 8-10 * * 1,3", "+03:00", 40)
    return found.select("event_id", *[F.col(n).cast("timestamp_ntz").alias(n) for n in ("next", "last")])


@query(f"WITH f AS ({_CRON}), n AS (SELECT t, row_number() OVER (ORDER BY t) AS n FROM f), e AS (SELECT event_id, ts, n FROM events ASOF JOIN n ON ts < t) SELECT event_id, t AS slot FROM e JOIN n ON n.n >= e.n AND n.n < e.n + 5 WHERE t <= ts + INTERVAL 20 DAYS")
def schedule_slots(spark, sf_dir):
    from tideline.operators import schedules as C

    e = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    return C.slots(e, F.col("at"), F.col("at") + F.make_dt_interval(F.lit(20)), "*/15 8-10 * * 1,3", "+03:00", 21, 5).select("event_id", F.col("slot").cast("timestamp_ntz").alias("slot"))
