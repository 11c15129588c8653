"""The editor's desk and the processing step as queries: documents are drafts, events posts, embeddings items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import vectors as V
from tideline.operators import desk, processing, statistics
from tideline.plans.queries import query, read

NOW = "2024-01-20 12:00:00"
_STATES = ["pending_review", "generating", "approved", "rejected", "failed"]
_STORY = ["drafted", "excluded", "open", "published"]


def _now():
    return F.lit(NOW + "+00:00").cast("timestamp")


def _drafts(spark, sf_dir):
    d = F.col("doc_id")
    at = F.timestamp_seconds(F.lit(1705752000) - 60 * (d % 60))
    rows = read(spark, sf_dir, "documents").select(d.alias("draft_id"), F.col("lang").alias("project"), F.lit("T").alias("title"), F.col("text").alias("body"), F.get(F.array(*map(F.lit, _STATES)), (d % 5).cast("int")).alias("status"), F.array(F.expr("doc_id div 3")).alias("cluster_ids"), at.alias("created_at"), F.when(d % 2 == 0, F.timestamp_seconds(F.lit(1705752000) + 60 * (d % 100 - 50))).alias("scheduled_for"))
    c = F.col("cluster_id")
    stories = rows.select(F.explode("cluster_ids").alias("cluster_id")).distinct().select("cluster_id", F.get(F.array(*map(F.lit, _STORY)), (c % 4).cast("int")).alias("state"), F.when(c % 3 == 0, _now()).alias("published_at"))
    return rows, stories


_D = f"""d AS (SELECT doc_id, lang, text, {_STATES}[doc_id % 5 + 1] AS status, doc_id // 3 AS c, TIMESTAMP '{NOW}' - INTERVAL 1 MINUTE * CAST(doc_id % 60 AS INT) AS made, CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '{NOW}' + INTERVAL 1 MINUTE * CAST(doc_id % 100 - 50 AS INT) END AS slot FROM documents),
s AS (SELECT DISTINCT c, {_STORY}[c % 4 + 1] AS state, c % 3 = 0 AS published FROM d)"""


@query(f"""WITH {_D},
r AS (SELECT *, status IN ('pending_review', 'failed') AND doc_id % 2 = 0 AS hit FROM d),
g AS (SELECT DISTINCT c FROM d WHERE status IN ('pending_review', 'rejected', 'failed') AND lang = 'en' AND c NOT IN (SELECT c FROM d WHERE status IN ('generating', 'approved') OR status = 'pending_review' AND lang <> 'en')),
b AS (SELECT *, status = 'generating' AND made < TIMESTAMP '{NOW}' - INTERVAL 15 MINUTE AS stuck FROM d)
SELECT 'rejected draft' AS kind, doc_id AS id, CASE WHEN hit THEN 'rejected' ELSE status END AS state FROM r
UNION ALL SELECT 'rejected story', c, CASE WHEN c IN (SELECT c FROM r WHERE hit) AND state IN ('drafted', 'excluded') THEN CASE WHEN published THEN 'published' ELSE 'excluded' END ELSE state END FROM s
UNION ALL SELECT 'cleared draft', doc_id, status FROM d WHERE NOT (status IN ('pending_review', 'rejected', 'failed') AND lang = 'en')
UNION ALL SELECT 'cleared story', c, CASE WHEN c IN (SELECT c FROM g) AND state = 'drafted' THEN CASE WHEN published THEN 'published' ELSE 'open' END ELSE state END FROM s
UNION ALL SELECT 'recovered draft', doc_id, CASE WHEN stuck THEN 'failed' ELSE status END FROM b
UNION ALL SELECT 'recovered story', c, CASE WHEN c IN (SELECT c FROM b WHERE stuck) AND state = 'drafted' THEN 'open' ELSE state END FROM s
UNION ALL SELECT 'set aside', c, CASE WHEN c % 2 = 0 AND state IN ('open', 'closed', 'published') THEN 'excluded' WHEN c % 2 = 1 AND state = 'excluded' THEN 'open' END FROM s""")
def draft_changes(spark, sf_dir):
    """Drafts and stories after rejections, after a project was cleared, and after stuck drafts were given up; stories that are excluded or opened again."""
    drafts, stories = _drafts(spark, sf_dir)
    parts = {"rejected": desk.rejected(drafts, stories, drafts.where("draft_id % 2 = 0")), "cleared": desk.cleared(drafts, stories, drafts.where("project = 'en'")), "recovered": desk.recovered(drafts, stories, _now())}
    c = F.col("cluster_id")
    out = stories.select(F.lit("set aside").alias("kind"), c.alias("id"), desk.set_aside(F.col("state"), F.when(c % 2 == 0, "exclude").otherwise("reopen")).alias("state"))
    for kind, (left, right) in parts.items():
        out = out.unionAll(left.select(F.lit(f"{kind} draft"), "draft_id", "status")).unionAll(right.select(F.lit(f"{kind} story"), "cluster_id", "state"))
    return out


@query(rf"""WITH {_D},
h AS (SELECT *, md5(lower(trim(regexp_replace('T' || chr(10) || text, '\s+', ' ', 'g')))) AS f, TIMESTAMP '{NOW}' - INTERVAL 1 HOUR * CAST(doc_id % 48 AS INT) AS sent FROM d),
n AS (SELECT DISTINCT lang, f FROM h WHERE status = 'approved' AND doc_id % 48 <= 24)
SELECT doc_id AS draft_id, 'ch-' || lang AS channel_id, CASE WHEN n.f IS NOT NULL THEN 'cancelled' ELSE 'pending' END AS status, CASE WHEN n.f IS NULL THEN greatest(TIMESTAMP '{NOW}', coalesce(slot, TIMESTAMP '{NOW}')) END AS due_at
FROM h LEFT JOIN n USING (lang, f) WHERE status = 'pending_review' AND lang <> 'fr'""")
def approvals(spark, sf_dir):
    """The publications of all drafts that wait: a repeated text of the last day is cancelled, and a project without an enabled channel gets none."""
    drafts, _ = _drafts(spark, sf_dir)
    channels = drafts.select("project").distinct().select("project", F.concat(F.lit("ch-"), "project").alias("channel_id"), (F.col("project") != "fr").alias("enabled"))
    sent = drafts.where("status = 'approved'").select("draft_id", F.concat(F.lit("ch-"), "project").alias("channel_id"), F.lit("sent").alias("status"), (_now() - F.make_dt_interval(F.lit(0), (F.col("draft_id") % 48).cast("int"))).alias("created_at"))
    _, made = desk.approved(drafts, drafts.select("draft_id"), channels, sent, _now())
    return made.select("draft_id", "channel_id", "status", F.col("due_at").cast("timestamp_ntz").alias("due_at"))


_PLACE = f"1 - epoch_us(TIMESTAMP '{NOW}' - ts) / (48 * 3.6e9)"


@query(f"""SELECT event_id, CASE WHEN {_PLACE} >= -0.02 THEN round(greatest(0, least(1, {_PLACE})) * 150, 6) END AS place,
  event_type = 'purchase' AND event_id % 3 <> 0 AND ts > TIMESTAMP '{NOW}' - INTERVAL 30 DAY AS tracked,
  CASE WHEN event_id % 2 = 0 AND event_id % 5 <> 0 AND ts >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY THEN 'pending' WHEN event_id % 5 = 0 AND (event_id % 10 = 0 OR ts >= TIMESTAMP '{NOW}' - INTERVAL 1104 HOUR) THEN 'tracked' END AS phase,
  round(least(1.0, 0.9 * coalesce(CASE WHEN event_id % 4 <> 0 THEN value / 10 END, 1.0)), 6) AS authority,
  ['embed', 'chat', 'other', 'embed', 'chat'][event_id % 5 + 1] AS model, event_id % 2 = 0 AS has_k FROM events""")
def event_states(spark, sf_dir):
    """Places in a window, tracked posts and videos, authorities, kinds of models and keys of payloads, an event each."""
    e, i = read(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp")), F.col("event_id")
    posts = e.select(F.col("event_id").alias("post"), F.when(F.col("event_type") == "purchase", "sent").otherwise("pending").alias("status"), F.when(i % 3 == 0, F.concat(F.lit("x"), i)).otherwise(i.cast("string")).alias("external_id"), F.col("at").alias("sent_at"))
    tracked = desk.tracked_posts(posts, _now()).select(F.col("post").alias("event_id"), F.lit(True).alias("tracked"))
    seconds = F.unix_micros("at") / 1e6
    rows = e.withColumns({"publish_id": F.when(i % 2 == 0, i), "video_id": F.when(i % 5 == 0, i), "uploaded_at": seconds, "created_at": F.when(i % 10 != 0, seconds)})
    rows = desk.videos_at_work(rows, F.unix_micros(_now()) / 1e6).join(tracked, "event_id", "left")
    name = F.get(F.array(*map(F.lit, ("org/bge-m3:latest", "llama3", "whisper-large", "mine", "my-llm"))), (i % 5).cast("int"))
    families = F.when(i % 5 == 3, F.array(F.lit("BERT"), F.lit(None))).otherwise(F.array(F.lit("llama")))
    payload = F.when(i % 2 == 0, F.lit('{"k": null}')).otherwise(F.lit('{"x": "k"}'))
    return rows.select(
        "event_id", F.round(desk.arrivals(F.col("at"), _now(), 48, 150.0), 6).alias("place"), F.coalesce("tracked", F.lit(False)).alias("tracked"), "phase",
        F.round(desk.effective_authority(F.lit(0.9), F.when(i % 4 != 0, F.col("value") / 10)), 6).alias("authority"), desk.model_kind(name, families).alias("model"), desk.has_key(payload, "k").alias("has_k"),
    )


@query(f"""SELECT user_id AS channel_id FROM events WHERE user_id % 7 <> 0 AND (user_id % 2 = 0 OR user_id % 6 > 3) GROUP BY user_id HAVING count(*) FILTER (event_type = 'purchase' AND ts > TIMESTAMP '{NOW}' - INTERVAL 30 DAY) > 0""")
def due_statistics(spark, sf_dir):
    """Channels (users) whose numbers are to be collected."""
    e = read(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    u = F.col("user_id")
    channels = e.groupBy("user_id").agg(F.lit(1)).select(u.alias("channel_id"), (u % 7 != 0).alias("enabled"))
    marks = e.where("user_id % 2 = 1").select("user_id").distinct().select(F.concat(F.lit("stats_at:"), u.cast("string")).alias("key"), (_now() - F.make_dt_interval(F.lit(0), (u % 6).cast("int"))).alias("updated_at"))
    posts = e.where("event_type = 'purchase'").select(u.alias("channel_id"), F.lit("sent").alias("status"), F.col("at").alias("sent_at"))
    return desk.due_channels(channels, marks, posts, _now())


@query("""WITH p AS (SELECT source, count(*) AS n, min(doc_id) AS m FROM documents GROUP BY source)
SELECT source AS project, CASE WHEN n % 2 = 0 THEN 'given' WHEN m % 3 <> 0 THEN 'made' ELSE 'none' END AS aspects, n % 2 = 1 AND m % 5 <> 0 AS needed FROM p""")
def aspects_of_projects(spark, sf_dir):
    """Projects (sources) for whose topics aspects are sought, and those that keep what was found: not where an editor was faster or changed the topic."""
    p = read(spark, sf_dir, "documents").groupBy(F.col("source").alias("project")).agg(F.count("*").alias("n"), F.min("doc_id").alias("m"))
    projects = p.select("project", F.lit(" topic ").alias("topic"), F.when(F.col("n") % 2 == 0, F.array(F.lit("given"))).otherwise(F.array().cast("array<string>")).alias("aspects"))
    marks = p.select(F.concat(F.lit("aspects_topic:"), "project").alias("key"), F.when(F.col("m") % 5 == 0, "topic").otherwise("older topic").alias("topic"))
    found = p.select("project", F.when(F.col("m") % 3 == 0, "changed").otherwise(" topic ").alias("topic"), F.array(F.lit("made")).alias("aspects"))
    needed = desk.needs_aspects(projects, marks).withColumn("needed", F.lit(True))
    rows = desk.with_aspects(projects, found).join(needed, "project", "left")
    return rows.select("project", F.coalesce(F.get("aspects", F.lit(0)), F.lit("none")).alias("aspects"), F.coalesce("needed", F.lit(False)).alias("needed"))


@query("""SELECT source AS cluster_id, md5(string_agg('{"k":"' || doc_id || '"}', ',' ORDER BY doc_id)) AS metas FROM documents WHERE doc_id % 4 <> 0 GROUP BY source""")
def story_metas(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("cluster_id"), F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 4 != 0, F.create_map(F.lit("k"), F.col("doc_id").cast("string"))).alias("meta"))
    return desk.metas(docs).select("cluster_id", F.md5(F.array_join(F.transform("metas", lambda x: F.to_json(x)), ",").cast("binary")).alias("metas"))


@query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id % 5 = 0 DESC, doc_id DESC) AS n FROM documents) WHERE n <= 50""")
def drafts_in_order(spark, sf_dir):
    drafts, _ = _drafts(spark, sf_dir)
    return desk.ordered_drafts(drafts).limit(50).select(F.col("draft_id").alias("doc_id"))


def _space(spark, sf_dir):
    """Embeddings as items of two projects; every third was clustered before, by its label."""
    i = F.col("vec_id")
    old = i % 3 == 0
    items = read(spark, sf_dir, "embeddings").select(i.alias("item_id"), (i % 2).alias("project"), F.when(F.col("label") % 4 == 0, "curated").otherwise("news").alias("mode"), (i % 7).alias("source_id"), F.concat(F.lit("Item "), i).alias("title"),
        F.timestamp_seconds(F.lit(1705752000) + 600 * i).alias("published_at"), "embedding", F.when(old, "clustered").otherwise("embedded").alias("status"), F.when(old, F.col("label") * 10 + i % 2).cast("long").alias("cluster_id"), F.lit(None).cast("long").alias("dup_of"), (i % 11 == 0).alias("searched"))
    known = items.where("cluster_id is not null")
    stories = known.groupBy("cluster_id", "project", "mode").agg(F.lit("open").alias("state"), F.lit(None).cast("string").alias("title"), F.count("*").alias("item_count"), F.countDistinct("source_id").alias("source_count"), F.min("published_at").alias("first_seen"), F.max("published_at").alias("last_seen"))
    means = V.mean_vector(known.select("cluster_id", V.unit("embedding").alias("u")), ["cluster_id"], "u")
    return items, stories.join(means, "cluster_id")


@query()
def processed_stories(spark, sf_dir):
    """Stories after the items that are new have joined them; tested against a plain loop."""
    items, stories = _space(spark, sf_dir)
    _, after = processing.step(items, stories, 0.3)
    return after.select("cluster_id", "project", "mode", "state", "title", "item_count", "source_count", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen"))


@query("""SELECT vec_id AS item_id, CASE WHEN vec_id % 2 = 0 THEN 'new' WHEN vec_id % 3 = 0 THEN 'clustered' ELSE 'embedded' END AS status, vec_id % 2 = 1 AS has_vector, CASE WHEN vec_id % 2 = 1 AND vec_id % 3 = 0 THEN label * 10 + 1 END AS cluster_id FROM embeddings""")
def changed_space(spark, sf_dir):
    """Items after the model of one project's vectors was changed."""
    items, stories = _space(spark, sf_dir)
    after, _ = processing.new_space(items, stories, stories.where("cluster_id % 4 = 0"), spark.range(1).select(F.lit(0).cast("long").alias("project")))
    return after.select("item_id", "status", F.col("embedding").isNotNull().alias("has_vector"), F.col("cluster_id").cast("int").alias("cluster_id"))


@query("""SELECT user_id, count(*) AS posts, CAST(coalesce(sum(CASE WHEN event_id % 9 <> 0 THEN event_id % 1000 END), 0) AS BIGINT) AS views, CAST(sum(event_id % 7) AS BIGINT) AS reactions,
  coalesce(median(CASE WHEN event_id % 9 <> 0 THEN event_id % 1000 END), 0) AS median_views FROM events GROUP BY user_id""")
def post_totals(spark, sf_dir):
    """Posts, views, reactions and the median of views of each channel (user)."""
    e = read(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 9 != 0, F.col("event_id") % 1000).alias("views"), (F.col("event_id") % 7).alias("reactions"))
    return statistics.summary(e, ["user_id"], "views", "reactions")
