"""The library's operators as queries over the test tables, each with DuckDB SQL where SQL can express it.

Documents stand for items, their sources for feeds, labels for ratings,
embeddings' labels for stories, events and orders for what is published.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.functions import urls as U
from tideline.functions import vectors as V
from tideline.operators import clustering, dedup, evaluation, rollup, scoring, statistics
from tideline.streaming import windows as W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Queries over small tables written by hand, with their expected rows as SQL: tests run them, nothing else.
CASES: dict[str, Query] = {}
CASE_SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def case(sql: str):
    """A query over constants."""

    def add(f: Query) -> Query:
        CASES[f.__name__], CASE_SQL[f.__name__] = f, sql
        return f

    return add


def shared(name: str, tables: str, sql: str, duck: str | None = None) -> None:
    """A query whose plan is the same SQL for both engines."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql.format(**{t: "{" + t + "}" for t in tables.split()}), **{t: read(spark, sf_dir, t) for t in tables.split()})

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = (duck or sql).format(**{t: t for t in tables.split()})


# scans, filters, joins
shared("items_list", "documents labels", "SELECT d.doc_id, d.lang, coalesce(nullif(d.source, ''), 'unknown') AS label, l.quality FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id WHERE d.lang IN ('en', 'de')")
shared("needs_content", "documents", "SELECT doc_id FROM {documents} WHERE length(trim(text)) < 800")
shared("semi_join_rated_sources", "documents labels", "SELECT doc_id, source FROM {documents} d WHERE EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
shared("anti_join_unlabelled", "documents labels", "SELECT doc_id FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id)")
shared("cooldown", "documents labels", "WITH recent AS (SELECT DISTINCT d.source FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id WHERE l.toxic = 1) SELECT lang, source FROM (SELECT DISTINCT lang, source FROM {documents}) x WHERE source IS NULL OR source NOT IN (SELECT source FROM recent WHERE source IS NOT NULL)")
shared("stable_top_k", "orders", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus IN ('O', 'F') ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
shared("priority_order", "orders", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS rank FROM {orders} ORDER BY rank, o_orderdate, o_orderkey LIMIT 20")
shared("known_hashes", "documents pages", "SELECT md5(text) AS h FROM {documents} UNION SELECT md5(url) FROM {pages}")
shared("supplier_revenue", "lineitem supplier nation region", "SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name, n_name")
shared("update_from", "customer nation", "SELECT c_custkey, coalesce(n_name, 'none') AS nation, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS balance FROM {customer} LEFT JOIN {nation} ON c_nationkey = n_nationkey")
shared("as_of_previous_order", "orders", "SELECT o_orderkey, max(prev) AS prev_date FROM (SELECT o_orderkey, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM {orders}) x GROUP BY o_orderkey")
# aggregations and windows
shared("filtered_counts", "events", "SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, avg(value) FILTER (WHERE value IS NOT NULL) AS mean, count(DISTINCT user_id) AS users FROM {events} GROUP BY event_type")
shared("sources_with_many", "documents", "SELECT source, count(*) AS n FROM {documents} GROUP BY source HAVING count(*) >= 4")
shared("two_periods", "events", "SELECT event_type, count(CASE WHEN ts >= TIMESTAMP '2024-01-16 00:00:00' THEN 1 END) AS now_n, count(CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 1 END) AS before_n FROM {events} GROUP BY event_type")
shared("latest_key", "events", "SELECT user_id, max(ts) AS last_at, count(*) AS n FROM {events} GROUP BY user_id")
shared("latest_value", "events", "SELECT user_id, max_by(event_type, event_id) AS last_type FROM {events} GROUP BY user_id")
shared("first_kind", "documents", "SELECT source, coalesce(min_by(lang, CASE lang WHEN 'fr' THEN 1 WHEN 'de' THEN 2 WHEN 'en' THEN 3 ELSE 4 END * CAST(1000000000 AS BIGINT) + doc_id), 'article') AS kind FROM {documents} GROUP BY source")
shared("title_list", "nation region", "SELECT r_name, listagg(n_name, ' · ') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name", "SELECT r_name, string_agg(n_name, ' · ' ORDER BY n_name) AS names FROM {nation} JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name")
shared("source_leaderboard", "documents labels", "SELECT source, sum(quality) AS good, count(*) AS posts, avg(quality) AS share FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY source ORDER BY share DESC NULLS LAST, posts DESC")
shared("retention", "events", "SELECT event_id FROM {events} WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAYS AND event_type <> 'error'")
shared("daily_cap", "events", "SELECT user_id, greatest(0, 8 - count(CASE WHEN ts >= TIMESTAMP '2024-01-29 00:00:00' AND event_type <> 'error' THEN 1 END)) AS left_today FROM {events} GROUP BY user_id")
shared("delivery_outcome", "events", "SELECT event_id, CASE WHEN event_type = 'error' AND value > 50 THEN 'retry' WHEN event_type = 'error' THEN 'failed' ELSE 'sent' END AS outcome, least(300, 5 * power(2, event_id % 8)) AS backoff FROM {events}")
shared("json_path", "events", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {events} WHERE CAST(get_json_object(props, '$.k') AS INT) >= 3", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM {events} WHERE CAST(json_extract_string(props, '$.k') AS INT) >= 3")


@query("SELECT source, count(*) AS item_count, greatest(count(DISTINCT lang), 1) AS source_count, min(doc_id) AS first_seen, max(doc_id) AS last_seen FROM documents GROUP BY source")
def cluster_rollup(spark, sf_dir):
    return rollup.rollup(read(spark, sf_dir, "documents"), "source", "lang", "doc_id")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 4")
def latest_per_group(spark, sf_dir):
    return rollup.top_per_group(read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["source"], [F.col("n_chars").desc(), F.col("doc_id")], 4).select("doc_id", "source")


@query("SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS s FROM documents) WHERE s <= 2) WHERE r <= 6")
def capped_per_source(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return rollup.capped(docs, "lang", "source", [F.col("n_chars").desc(), F.col("doc_id")], 2, 6).select("doc_id")


@query("SELECT CAST(d AS DATE) AS day, count(e.event_id) AS n FROM (SELECT unnest(generate_series(DATE '2023-12-30', DATE '2024-02-02', INTERVAL 1 DAY)) AS d) LEFT JOIN events e ON CAST(e.ts AS DATE) = CAST(d AS DATE) GROUP BY d")
def daily_histogram(spark, sf_dir):
    return rollup.daily(read(spark, sf_dir, "events"), "ts", "2023-12-30", "2024-02-02")


@query("""WITH a AS (SELECT source AS k, doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS lang, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS fresh FROM documents)
SELECT k, arg_min(doc_id, {'n': fresh, 'o': doc_id}) AS doc_id, arg_min(lang, {'n': fresh, 'o': doc_id}) FILTER (WHERE lang IS NOT NULL) AS lang FROM a GROUP BY k""")
def upsert(spark, sf_dir):
    a = read(spark, sf_dir, "documents").select(F.col("source").alias("k"), "doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"))
    return rollup.upserted(a.where("doc_id % 2 = 0"), a.where("doc_id % 2 = 1"), "k", ["lang"], "doc_id")


@query("SELECT label, list(m ORDER BY p) AS centroid FROM (SELECT label, p, round(avg(CAST(embedding[p] AS DOUBLE)), 4) + 0.0 AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings) GROUP BY label, p) GROUP BY label")
def vector_average(spark, sf_dir):
    means = V.mean_vector(read(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return means.select("label", F.transform("centroid", lambda x: F.round(x, 4) + 0.0).alias("centroid"))


@query("""WITH c AS (SELECT label, list(m ORDER BY p) AS centroid FROM (SELECT label, p, avg(CAST(embedding[p] AS DOUBLE)) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings) GROUP BY label, p) GROUP BY label)
SELECT label, arg_max(vec_id, {'s': round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid), 9), 'i': -vec_id}) AS medoid FROM embeddings JOIN c USING (label) GROUP BY label""")
def medoid(spark, sf_dir):
    items = read(spark, sf_dir, "embeddings")
    near = items.join(V.mean_vector(items, ["label"], "embedding"), "label").withColumn("s", F.round(V.cosine("embedding", "centroid"), 9))
    return near.groupBy("label").agg(F.max_by("vec_id", F.struct("s", -F.col("vec_id"))).alias("medoid"))


@query("""WITH f AS (SELECT source, least(1.0, ln(1 + count(DISTINCT lang)) / ln(9.0)) AS coverage, avg(CASE WHEN n_chars % 7 < 4 THEN 0.9 ELSE 0.4 END) AS authority, pow(0.5, CAST(min(doc_id) % 48 AS DOUBLE) / 12.0) AS freshness, least(1.0, count(*) FILTER (WHERE n_chars < 500) / 5.0) AS velocity, coalesce(avg(CAST(l.quality AS DOUBLE)), 0.5) AS topic_fit FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source)
SELECT source, round(0.15 * coverage + 0.075 * authority + 0.10 * freshness + 0.075 * velocity + 0.60 * topic_fit, 4) AS score FROM f""".replace("min(doc_id)", "min(d.doc_id)"))
def news_score(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    f = docs.groupBy("source").agg(F.countDistinct("lang").alias("langs"), F.avg(F.when(F.col("n_chars") % 7 < 4, 0.9).otherwise(0.4)).alias("authority"), (F.min("doc_id") % 48).cast("double").alias("age"), F.count_if(F.col("n_chars") < 500).alias("recent"), F.coalesce(F.avg(F.col("quality").cast("double")), F.lit(0.5)).alias("topic_fit"))
    f = f.withColumns({"coverage": scoring.coverage(F.col("langs")), "freshness": scoring.freshness(F.col("age"), F.lit(12.0)), "velocity": scoring.velocity(F.col("recent"))})
    return scoring.weighted(f, scoring.NEWS).select("source", "score")


@query("SELECT p_partkey, CASE WHEN p_size < 0 AND p_retailprice < 0 THEN NULL ELSE greatest(least(1.0, ln(1 + CAST(p_size AS DOUBLE)) / ln(1 + 50000.0)), least(1.0, ln(1 + p_retailprice) / ln(1 + 1000000.0))) END AS engagement, least(1.0, p_retailprice / 4000.0) AS depth FROM part")
def engagement(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", scoring.engagement({"likes": F.col("p_size"), "views": F.col("p_retailprice")}).alias("engagement"), scoring.depth(F.col("p_retailprice")).alias("depth"))


@query("SELECT event_type, median(value) AS med FROM events GROUP BY event_type")
def exact_median(spark, sf_dir):
    return statistics.medians(read(spark, sf_dir, "events"), ["event_type"], "value", "med")


_RATED = "WITH m AS (SELECT event_type, median(value) AS med FROM events WHERE value IS NOT NULL GROUP BY event_type), r AS (SELECT e.*, value / greatest(med, 1.0) AS relative FROM events e JOIN m USING (event_type) WHERE value IS NOT NULL) "


def _rated(spark, sf_dir):
    return statistics.relative(read(spark, sf_dir, "events").where("value is not null"), "event_type", "value")


@query(_RATED + "SELECT user_id, count(*) AS posts, CASE WHEN count(*) >= 3 THEN greatest(0.5, least(1.5, median(relative))) END AS performance FROM r GROUP BY user_id")
def source_performance(spark, sf_dir):
    return statistics.performance(_rated(spark, sf_dir), "user_id")


@query(_RATED + "SELECT event_type, event_id, 'best' AS kind FROM r QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY relative DESC, event_id) <= 3 UNION ALL SELECT event_type, event_id, 'worst' FROM r QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY relative, event_id) <= 3")
def best_and_worst(spark, sf_dir):
    return statistics.best_and_worst(_rated(spark, sf_dir), "event_type", "event_id").select("event_type", "event_id", "kind")


_H = [24, 72, 168]


@query("WITH s AS (SELECT *, date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) / 3600.0 AS age FROM events) SELECT user_id, " + ", ".join(f"arg_min(value, event_id) FILTER (WHERE age >= {h} AND age <= 1.5 * {h}) AS h{h}" for h in _H) + ", arg_max(value, event_id) AS last FROM s GROUP BY user_id")
def horizons(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("age", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)") / 3600.0)
    return statistics.at_horizons(e, "user_id", "age", "event_id", "value", _H)


_EVAL = """WITH d AS (SELECT lang AS p, source AS g FROM documents), c AS (SELECT p, g, CAST(count(*) AS DOUBLE) AS c FROM d GROUP BY p, g), a AS (SELECT p, sum(c) AS np FROM c GROUP BY p), b AS (SELECT g, sum(c) AS ng FROM c GROUP BY g),
t AS (SELECT sum(c) AS n, sum(c * c / np) / sum(c) AS precision, sum(c * c / ng) / sum(c) AS recall, sum(c * ln(c / (np * ng))) AS mi, sum(c * (c - 1) / 2) AS together FROM c JOIN a USING (p) JOIN b USING (g)),
x AS (SELECT sum(np * ln(np)) AS hp, sum(np * (np - 1) / 2) AS pp FROM a), y AS (SELECT sum(ng * ln(ng)) AS hg, sum(ng * (ng - 1) / 2) AS pg FROM b)
SELECT n, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1, round((mi / n + ln(n)) / ((2 * ln(n) - hp / n - hg / n) / 2), 6) AS nmi, round((together - pp * pg / (n * (n - 1) / 2)) / ((pp + pg) / 2 - pp * pg / (n * (n - 1) / 2)), 6) AS ari FROM t, x, y"""


@query(_EVAL)
def cluster_quality(spark, sf_dir):
    r = evaluation.scores(read(spark, sf_dir, "documents"), "lang", "source")
    return r.select("n", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "nmi", "ari")])


@query("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages")
def url_parts(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", U.host("url").alias("host"), U.path("url").alias("path"))


@query("""WITH u AS (SELECT page_id, regexp_extract(url, '^([A-Za-z]+)://', 1) AS s, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS h, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS p,
list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT list_contains(['utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', 'yclid', 'ref'], lower(split_part(x, '=', 1)))) AS q FROM pages)
SELECT page_id, lower(s) || '://' || h || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url FROM u""")
def url_normalized(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", U.normalized_url("url").alias("url"))


@query(r"SELECT doc_id, md5(lower(trim(regexp_replace(source || chr(10) || text, '\s+', ' ', 'g')))) AS h FROM documents")
def content_fingerprint(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.content_hash("source", "text").alias("h"))


@query(r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS n_words, len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS n_distinct FROM documents")
def word_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.words("text").alias("w")).select("doc_id", F.size("w").alias("n_words").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query("SELECT a.vec_id AS vec_id, arg_max(b.vec_id, {'s': round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9), 'i': -b.vec_id}) AS nearest FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY a.vec_id")
def nearest_vector(spark, sf_dir):
    """The exact nearest vector of the same story for the stated query set, every 50th vector; partial maxima before the shuffle."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", "label", V.unit("embedding").alias("u"))
    a = v.where("vec_id % 50 = 0").select("vec_id", "label", F.col("u").alias("x"))
    b = v.select(F.col("vec_id").alias("other"), "label", F.col("u").alias("y"))
    near = a.join(b, "label").where("vec_id <> other").withColumn("s", F.round(V.dot("x", "y"), 9))
    return near.groupBy("vec_id").agg(F.max_by("other", F.struct("s", -F.col("other"))).alias("nearest"))


@query()
def minhash_duplicates(spark, sf_dir):
    """Lexical duplicates in order of doc_id; approximate signatures, tested against a brute-force version."""
    return dedup.duplicates(read(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def single_pass_clusters(spark, sf_dir):
    """Order-dependent clustering of each story's vectors; tested against a plain loop."""
    return clustering.single_pass(read(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", "vec_id", 200.0, 0.35)


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) AS base, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<a href="[^"]*">[^<]*</a>') AS l FROM pages),
a AS (SELECT page_id, base, i, regexp_extract(l[i], 'href="/([^"]*)"', 1) AS h, regexp_extract(l[i], '>([^<]*)<', 1) AS t FROM (SELECT page_id, base, l, unnest(range(1, len(l) + 1)) AS i FROM p))
SELECT page_id, base || '/s-1/' || h AS url, arg_min(t, i) AS title FROM a WHERE length(t) >= 6 GROUP BY page_id, base || '/s-1/' || h QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY min(i)) <= 40""")
def page_articles(spark, sf_dir):
    """Article links of pages; the test pages have links in their navigation only, which is made part of the page here."""
    from tideline.sources import connectors

    html = F.replace(F.replace(F.replace("html", F.lit("<nav>"), F.lit("<div>")), F.lit("</nav>"), F.lit("</div>")), F.lit('href="/'), F.lit('href="/s-1/'))
    pages = read(spark, sf_dir, "pages").withColumn("html", html)
    return connectors.articles(pages, "page_id", "html", "url", least_chars=6, least_words=1).select("page_id", "url", "title")


@query("SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """Watermarked six-hour counts, run as a stream over what is there."""
    counts = W.counted(W.stream(spark, f"{sf_dir}/events.parquet", "ts"), "ts", ["event_type"])
    return W.drained(counts, ["start", "event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOURS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM s GROUP BY user_id, k""")
def quiet_sessions(spark, sf_dir):
    return W.sessions(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["user_id"], "12 hours").select("user_id", "n", F.col("first_at").cast("timestamp_ntz").alias("first_at"), F.col("last_at").cast("timestamp_ntz").alias("last_at"))
