"""Queries of state changes, related posts, statistics of posts, streams and exports; the SQL is written apart from the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.operators import clustering, publishing, related, statistics
from tideline.plans.queries import query, read
from tideline.sources import sinks
from tideline.streaming import windows as W


def now() -> Column:
    return F.lit("2024-01-31 00:00:00").cast("timestamp")

_NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def doc_id() -> Column:
    return F.col("doc_id")


def _events(spark, sf_dir):
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_POSTS = """WITH p AS (SELECT label AS project, vec_id AS post_id, TIMESTAMP '2024-01-01 00:00:00' + vec_id * INTERVAL 1 HOUR AS sent_at, [vec_id % 97, vec_id % 89 + 100] AS cluster_ids, ['n' || (vec_id % 13), 'm' || (vec_id % 29), 'k' || (vec_id % 3)] AS names,
  CASE WHEN vec_id % 41 = 0 THEN 'l' || (vec_id % 2) ELSE '' END AS link, CASE WHEN vec_id % 37 = 0 THEN 'o' END AS origin, embedding AS vector FROM embeddings),
c AS (SELECT a.post_id, b.post_id AS other, b.sent_at AS other_at, len(list_intersect(a.cluster_ids, b.cluster_ids)) > 0 AS story, coalesce(a.link <> '' AND a.link = b.link, false) AS link, coalesce(a.origin = b.origin, false) AS origin, list_intersect(a.names, b.names) AS shared, list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[]) AS sim
  FROM p a JOIN p b ON a.project = b.project AND b.sent_at < a.sent_at AND b.sent_at >= a.sent_at - INTERVAL 14 DAYS),
n AS (SELECT post_id, count(*) AS n FROM c GROUP BY post_id),
f AS (SELECT post_id, name, count(*) AS f FROM (SELECT post_id, unnest(shared) AS name FROM c) GROUP BY post_id, name),
s AS (SELECT c.post_id, c.other, count(*) AS shared, count(*) FILTER (WHERE f.f < greatest(3, 0.05 * n.n)) AS rare FROM (SELECT post_id, other, unnest(shared) AS name FROM c) c JOIN f USING (post_id, name) JOIN n USING (post_id) GROUP BY c.post_id, c.other),
g AS (SELECT c.*, CASE WHEN story THEN 'update' WHEN c.link THEN 'link' WHEN origin THEN 'origin' WHEN (rare >= 2 AND sim >= 0.62) OR (rare >= 1 AND sim >= 0.66) OR (s.shared >= 1 AND sim >= 0.70) THEN 'similar' END AS reason FROM c LEFT JOIN s USING (post_id, other))
SELECT post_id, other AS related_id, reason, round(CASE WHEN reason = 'similar' THEN sim ELSE 1.0 END, 3) AS similarity FROM g WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY story DESC, CASE WHEN reason = 'similar' THEN sim ELSE 1.0 END DESC, other_at DESC, other DESC) = 1"""


@query(_POSTS)
def related_posts(spark, sf_dir):
    v = F.col("vec_id")
    name = lambda head, n: F.concat(F.lit(head), (v % n).cast("string"))
    posts = read(spark, sf_dir, "embeddings").select(
        F.col("label").alias("project"), v.alias("post_id"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), v.cast("int"))).alias("sent_at"), F.array(v % 97, v % 89 + 100).alias("cluster_ids"),
        F.array(name("n", 13), name("m", 29), name("k", 3)).alias("names"), F.when(v % 41 == 0, name("l", 2)).otherwise("").alias("link"), F.when(v % 37 == 0, "o").alias("origin"), F.col("embedding").alias("vector"),
    )
    return related.related(posts)


@query(f"SELECT event_id FROM events WHERE event_type = 'click' OR (event_type = 'error' AND ts < {_NOW} - INTERVAL 1 DAY) OR (event_type = 'view' AND ts < {_NOW} - INTERVAL 10 MINUTE)")
def enrichment_due(spark, sf_dir):
    state = F.when(F.col("event_type") == "click", "pending").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "running").otherwise("done")
    return publishing.to_enrich(_events(spark, sf_dir).withColumns({"article_status": state, "article_at": F.col("ts")}), now()).select("event_id")


@query(f"SELECT event_id, CASE WHEN event_type = 'click' THEN 'click' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS original, CASE WHEN event_type = 'click' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE '2024-01-31 00:00:00' END AS at FROM events WHERE event_type <> 'click' OR ts >= {_NOW} - INTERVAL 48 HOURS")
def inserted_items(spark, sf_dir):
    news = F.col("event_type") == "click"
    items = _events(spark, sf_dir).select("event_id", F.when(news, "news").otherwise("curated").alias("mode"), F.date_trunc("second", "ts").alias("published_at"), F.create_map(F.lit("kind"), F.col("event_type")).alias("meta"))
    rows = publishing.curated_now(publishing.kept_on_insert(items, now()), now())
    return rows.select("event_id", F.coalesce(F.col("meta")["published_original"], F.col("meta")["kind"]).alias("original"), F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 0 OR NOT (doc_id % 3 = 0 AND doc_id % 5 <> 0)")
def unseen_items(spark, sf_dir):
    items = read(spark, sf_dir, "documents").select("doc_id", F.md5(doc_id().cast("string")).alias("url_hash"), F.when(doc_id() % 2 == 0, "news").otherwise("curated").alias("mode"))
    return publishing.unseen(items, items.where(doc_id() % 3 == 0), items.where(doc_id() % 5 == 0)).select("doc_id")


@query(f"SELECT source, max(ts) <= {_NOW} AS due, strftime(CASE WHEN max(ts) <= {_NOW} THEN {_NOW} + 45 * INTERVAL 1 MINUTE ELSE max(ts) END, '%Y-%m-%d %H:%M') AS next FROM (SELECT event_type AS source, ts + user_id % 7 * INTERVAL 12 HOUR AS ts FROM events) GROUP BY source")
def polled_sources(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("event_type").alias("source"), (F.col("ts") + F.make_dt_interval(F.lit(0), (F.col("user_id") % 7 * 12).cast("int"))).alias("t"))
    rows = publishing.polled(e.groupBy("source").agg(F.max("t").alias("next_poll_at")).withColumn("poll_minutes", F.lit(45)), now())
    return rows.select("source", "due", F.date_format("next_poll_at", "yyyy-MM-dd HH:mm").alias("next"))


_CODES = "CASE event_id % 7 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 429 WHEN 3 THEN 503 WHEN 4 THEN 204 END"


@query(f"""WITH e AS (SELECT event_id, {_CODES} AS code, event_id % 7 = 5 AS sent, event_id % 9 AS attempts FROM events),
o AS (SELECT *, CASE WHEN code BETWEEN 200 AND 299 THEN 'sent' WHEN code = 429 OR code >= 500 THEN 'retry' WHEN code IS NOT NULL THEN 'failed' WHEN sent THEN 'unknown' ELSE 'retry' END AS outcome FROM e)
SELECT event_id, CASE WHEN outcome = 'retry' AND attempts < 6 THEN 'pending' WHEN outcome = 'retry' THEN 'failed' ELSE outcome END AS status, CASE WHEN outcome = 'retry' AND attempts < 6 THEN least(300, 5 * CAST(power(2, attempts) AS BIGINT)) END AS delay FROM o""")
def delivery_states(spark, sf_dir):
    e = F.col("event_id")
    code = F.when(e % 7 == 0, 200).when(e % 7 == 1, 404).when(e % 7 == 2, 429).when(e % 7 == 3, 503).when(e % 7 == 4, 204)
    rows = _events(spark, sf_dir).select("event_id", F.lit("sending").alias("status"), (e % 9).cast("int").alias("attempts"), publishing.outcome(code, e % 7 == 5).alias("outcome"), F.lit(None).cast("timestamp").alias("due_at"))
    found = publishing.advanced(rows, now())
    return found.select("event_id", "status", (F.unix_seconds("due_at") - F.unix_seconds(now())).alias("delay"))


@query("SELECT event_id FROM (SELECT event_id, CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id END AS k FROM events WHERE event_id % 2 = 1) WHERE k IS NULL UNION ALL SELECT min(event_id) FROM events WHERE event_id % 2 = 1 AND user_id % 4 <> 0 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 2 = 0 AND value > 90) GROUP BY user_id")
def enqueued_jobs(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.when(F.col("user_id") % 4 != 0, F.col("user_id")).alias("dedupe_key"), F.when(F.col("value") > 90, "queued").otherwise("done").alias("status"))
    return publishing.enqueued(e.where("job_id % 2 = 0"), e.where("job_id % 2 = 1")).select(F.col("job_id").alias("event_id"))


@query("SELECT c_custkey AS project_id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS topic, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 1 END AS embedded, c_custkey % 3 = 0 OR c_custkey % 5 = 0 AS changed, 1 + CASE WHEN c_custkey % 3 = 0 OR c_custkey % 5 = 0 THEN 1 ELSE 0 END AS version FROM customer")
def edited_projects(spark, sf_dir):
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer")
    projects = c.select(k.alias("project_id"), F.col("c_mktsegment").alias("topic"), F.lit("old").alias("criteria"), F.array(F.lit(1.0)).alias("topic_embedding"), F.lit(1).alias("version"))
    changes = c.where(k % 2 < 2).select(k.alias("project_id"), F.when(k % 3 == 0, "new").alias("new_topic"), F.when(k % 5 == 0, "other").otherwise("old").alias("new_criteria"))
    rows = publishing.edited(projects, changes)
    return rows.select("project_id", "topic", F.when(F.col("topic_embedding").isNotNull(), 1).alias("embedded"), "changed", "version")


@query("SELECT user_id, arg_max(event_type, {'a': ts, 's': event_id}) AS value FROM events GROUP BY user_id")
def key_values(spark, sf_dir):
    log = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return publishing.latest(log).select(F.col("key").alias("user_id"), "value")


@query("SELECT DISTINCT a.event_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL 24 HOURS")
def repeated_posts(spark, sf_dir):
    posts = _events(spark, sf_dir).select(F.col("event_id").alias("post_id"), F.col("user_id").alias("channel_id"), F.col("event_type").alias("fingerprint"), F.col("ts").alias("sent_at"))
    return publishing.repeated(posts).select(F.col("post_id").alias("event_id"))


_AGE = "date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) / 3600.0"


def _aged(spark, sf_dir):
    return _events(spark, sf_dir).withColumn("age", (F.unix_seconds("ts") - F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3600.0)


@query(f"""WITH s AS (SELECT user_id, max({_AGE}) AS oldest FROM events WHERE event_id % 50 = 0 GROUP BY user_id), p AS (SELECT DISTINCT user_id, user_id * 3.0 AS age FROM events)
SELECT p.user_id, list_filter([24, 72, 168], lambda h: h <= age AND NOT coalesce(oldest >= h, false)) AS due FROM p LEFT JOIN s USING (user_id) WHERE len(list_filter([24, 72, 168], lambda h: h <= age AND NOT coalesce(oldest >= h, false))) > 0""")
def horizons_due(spark, sf_dir):
    e = _aged(spark, sf_dir)
    snapshots = e.where("event_id % 50 = 0").select(F.col("user_id").alias("post_id"), F.col("age").alias("age_hours"))
    found = publishing.horizon_due(snapshots, e.select(F.col("user_id").alias("post_id")).distinct(), F.col("post_id") * 3.0, [24, 72, 168])
    return found.select(F.col("post_id").alias("user_id"), "due")


@query(f"WITH s AS (SELECT *, {_AGE} AS age, event_id * 2 AS likes FROM events) SELECT user_id, " + ", ".join(f"arg_min({m}, event_id) FILTER (WHERE age >= {h} AND age <= 1.5 * {h}) AS {n}_h{h}" for m, n in (("value", "value"), ("likes", "likes")) for h in (24, 168)) + ", arg_max(value, event_id) AS value_last, arg_max(likes, event_id) AS likes_last FROM s GROUP BY user_id")
def metric_horizons(spark, sf_dir):
    return statistics.at_horizons(_aged(spark, sf_dir).withColumn("likes", F.col("event_id") * 2), "user_id", "age", "event_id", ["value", "likes"], [24, 168])


@query(f"""WITH p AS (SELECT user_id % 40 AS channel, event_id, value FROM events WHERE event_type <> 'error' AND value IS NOT NULL AND ts < {_NOW} - INTERVAL 48 HOURS AND ts > {_NOW} - INTERVAL 30 DAYS),
m AS (SELECT channel, median(value) AS med, count(*) AS n FROM p GROUP BY channel), r AS (SELECT p.*, value / greatest(med, 1.0) AS relative FROM p JOIN m USING (channel) WHERE n >= 6 AND med >= 30)
SELECT channel, event_id, 'best' AS kind FROM r QUALIFY row_number() OVER (PARTITION BY channel ORDER BY relative DESC, event_id) <= 3 UNION ALL SELECT channel, event_id, 'worst' FROM r QUALIFY row_number() OVER (PARTITION BY channel ORDER BY relative, event_id) <= 3""")
def audience_hints(spark, sf_dir):
    posts = _events(spark, sf_dir).select((F.col("user_id") % 40).alias("channel"), "event_id", F.col("value").alias("views"), F.col("ts").alias("sent_at"), F.when(F.col("event_type") == "error", "failed").otherwise("sent").alias("status"))
    rated = statistics.relative(statistics.settled(posts, now()), "channel", "views")
    return statistics.hints(rated, "channel", "event_id", "views").select("channel", "event_id", "kind")


@query("SELECT kind, value, n FROM (SELECT 'split' AS kind, source AS value, count(DISTINCT lang) AS n FROM documents GROUP BY source UNION ALL SELECT 'merged', lang, count(DISTINCT source) FROM documents GROUP BY lang) WHERE n > 1")
def split_and_merged(spark, sf_dir):
    return publishing.split_and_merged(read(spark, sf_dir, "documents"), "lang", "source")


@query("SELECT s AS start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 6 HOURS, ts) - k * INTERVAL 6 HOURS AS s, event_type FROM events, (VALUES (0), (1)) t(k)) GROUP BY ALL")
def sliding_windows(spark, sf_dir):
    """Overlapping windows, run as a stream."""
    found = W.drained(W.sliding(W.stream(spark, f"{sf_dir}/events.parquet", "ts"), "ts", ["event_type"]), ["start", "event_type"])
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT a.event_id AS view_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOURS")
def views_then_purchases(spark, sf_dir):
    """A join of two streams within six hours."""
    rows = lambda kind: W.stream(spark, f"{sf_dir}/events.parquet", "ts").where(F.col("event_type") == kind).select("event_id", "user_id", "ts")
    both = W.followed(rows("view"), rows("purchase"), "user_id", "ts", "6 HOURS")
    return W.drained(both.select(F.col("event_id").alias("view_id"), F.col("r_event_id").alias("purchase_id")))


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 3 HOURS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, list(event_id ORDER BY ts, event_id) AS parts, arg_min(event_type, ts) AS text FROM s GROUP BY user_id, k""")
def albums(spark, sf_dir):
    return W.albums(_events(spark, sf_dir), "ts", "user_id", "event_id", "event_type", quiet="3 hours").select("user_id", "parts", "text")


@query(f"SELECT '' AS gold, lang AS title, left(text, 1200) AS text, source, round(date_diff('second', ({_NOW} - doc_id * INTERVAL 7 MINUTE), {_NOW}) / 3600.0, 1) AS hours_ago, CASE WHEN doc_id % 20 < 15 THEN 'Story ' || (doc_id % 20) END AS current_cluster, doc_id AS id FROM documents")
def labelling_export(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("text", "source", F.col("lang").alias("title"), (doc_id() % 20).alias("cluster_id"), doc_id().alias("id"), (now() - F.make_dt_interval(F.lit(0), F.lit(0), (doc_id() * 7).cast("int"))).alias("published_at"))
    clusters = spark.range(15).select(F.col("id").alias("cluster_id"), F.concat(F.lit("Story "), F.col("id").cast("string")).alias("title"))
    return sinks.labelling(docs, clusters, now())


@query("SELECT vec_id, label, CAST(NULL AS FLOAT[]) AS embedding FROM embeddings")
def stripped_dump(spark, sf_dir):
    return sinks.without_vectors(read(spark, sf_dir, "embeddings"))


@query()
def semantic_duplicates(spark, sf_dir):
    """Clusters with own thresholds, stories from before and semantic duplicates; tested against a plain loop."""
    v = read(spark, sf_dir, "embeddings").withColumn("x", clustering.threshold(F.when(F.col("label") % 2 == 0, "news").otherwise("curated"), F.col("vec_id") % 5 == 0, 0.35))
    stored = v.where("vec_id % 10 = 0").select("label", (F.col("vec_id") / 10).cast("int").alias("cluster"), F.col("embedding").alias("centroid"), F.lit(2).alias("n"), F.col("vec_id").alias("last"))
    return clustering.single_pass(v.where("vec_id % 10 <> 0"), "label", "vec_id", "embedding", "vec_id", 200.0, "x", stored=stored, same=0.6)


@query()
def streamed_clusters(spark, sf_dir):
    """Single-pass clusters over a stream; tested against those over the table."""
    clustering.keyed_state(spark)
    found = clustering.streamed(W.stream(spark, f"{sf_dir}/embeddings.parquet"), "label", "vec_id", "embedding", "vec_id", 200.0, 0.35)
    return W.drained(found)
