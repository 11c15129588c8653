"""State changes of items, sources, jobs and posts as functions of rows, and what is due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hours(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(n))


def to_enrich(items: DataFrame, now: Column) -> DataFrame:
    """Items (article_status, article_at) whose text is to be fetched: waiting, failed for a day, or running for ten minutes."""
    s, at = F.col("article_status"), F.col("article_at")
    return items.where((s == "pending") | ((s == "failed") & (at < now - hours(24))) | ((s == "running") & (at < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(10)))))


def kept_on_insert(items: DataFrame, now: Column, window: int = 48) -> DataFrame:
    """Incoming items without news older than the window."""
    return items.where((F.col("mode") != "news") | (F.col("published_at") >= now - hours(window)))


def curated_now(items: DataFrame, now: Column) -> DataFrame:
    """Curated items count as published now; their own time goes to meta.published_original."""
    curated = F.col("mode") == "curated"
    own = F.map_from_entries(F.array(F.struct(F.lit("published_original"), F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))))
    kept = F.map_filter("meta", lambda k, v: k != "published_original")
    return items.withColumns({"meta": F.when(curated, F.map_concat(kept, own)).otherwise(F.col("meta")), "published_at": F.when(curated, now).otherwise(F.col("published_at"))})


def unseen(items: DataFrame, seen: DataFrame, stored: DataFrame) -> DataFrame:
    """Items without curated ones that were seen once and are stored no more (by url_hash)."""
    gone = seen.select("url_hash").join(stored.select("url_hash"), "url_hash", "left_anti").distinct()
    return items.where("mode <> 'curated'").unionByName(items.where("mode = 'curated'").join(gone, "url_hash", "left_anti"))


def polled(sources: DataFrame, now: Column) -> DataFrame:
    """Sources with due, and the next poll after now for those that are."""
    due = F.coalesce(F.col("next_poll_at") <= now, F.lit(True))
    return sources.withColumns({"due": due, "next_poll_at": F.when(due, now + F.make_dt_interval(F.lit(0), F.lit(0), F.col("poll_minutes"))).otherwise(F.col("next_poll_at"))})


def backoff(attempts: Column) -> Column:
    """Seconds until the next try."""
    return F.least(F.lit(300), 5 * F.pow(F.lit(2), attempts).cast("long"))


def outcome(code: Column, sent: Column) -> Column:
    """sent, retry, failed or unknown for an answer: code (null: none came) and whether the request went out."""
    return F.when(code.between(200, 299), "sent").when((code == 429) | (code >= 500), "retry").when(code.isNotNull(), "failed").when(sent, "unknown").otherwise("retry")


def advanced(posts: DataFrame, now: Column, most: int = 6) -> DataFrame:
    """Posts (status sending, attempts, outcome) after their outcome: sent, pending again with a delay, failed after `most` tries, unknown."""
    again = (F.col("outcome") == "retry") & (F.col("attempts") < most)
    state = F.when(F.col("outcome").isin("sent", "unknown"), F.col("outcome")).when(again, "pending").otherwise("failed")
    at = F.when(again, now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), backoff(F.col("attempts"))))
    return posts.withColumns({"status": F.when(F.col("status") == "sending", state).otherwise(F.col("status")), "due_at": F.when(F.col("status") == "sending", at).otherwise(F.col("due_at"))})


def enqueued(queue: DataFrame, jobs: DataFrame) -> DataFrame:
    """jobs that join the queue: of a dedupe_key the first, if none like it is queued; jobs without a key all do."""
    free = jobs.where("dedupe_key is null")
    keyed = jobs.where("dedupe_key is not null").join(queue.where("status = 'queued'").select("dedupe_key").distinct(), "dedupe_key", "left_anti")
    first = keyed.groupBy("dedupe_key").agg(F.min_by(F.struct(*[c for c in jobs.columns if c != "dedupe_key"]), "job_id").alias("j")).select("dedupe_key", "j.*")
    return free.unionByName(first.select(*jobs.columns))


def edited(projects: DataFrame, changes: DataFrame) -> DataFrame:
    """Projects with a new topic or criteria (project_id, new_topic, new_criteria): embeddings go with the topic, interest with the criteria, and the version counts up with each."""
    rows = projects.join(changes, "project_id", "left")
    topic = F.col("new_topic").isNotNull() & (F.col("new_topic") != F.col("topic"))
    criteria = F.col("new_criteria").isNotNull() & (F.col("new_criteria") != F.col("criteria"))
    return rows.select("project_id", F.when(topic, F.col("new_topic")).otherwise(F.col("topic")).alias("topic"), F.when(criteria, F.col("new_criteria")).otherwise(F.col("criteria")).alias("criteria"), F.when(~topic, F.col("topic_embedding")).alias("topic_embedding"), (topic | criteria).alias("changed"), (F.col("version") + F.when(topic | criteria, 1).otherwise(0)).alias("version"))


def latest(log: DataFrame) -> DataFrame:
    """The last value of each key of an append log (key, value, at, seq)."""
    return log.groupBy("key").agg(F.max_by("value", F.struct("at", "seq")).alias("value"))


def repeated(posts: DataFrame, window: int = 24) -> DataFrame:
    """post_id of posts whose text (fingerprint) went to the same channel within the hours before.

    The last post before tells: if it is too old, all are. Posts of the same time
    don't count for each other. A channel's posts of one text are first kept as
    their distinct times, so copies at one time are one row of the window.
    """
    key = ["channel_id", "fingerprint"]
    times = posts.select(*key, "sent_at").distinct()
    before = F.lag("sent_at").over(Window.partitionBy(*key).orderBy("sent_at"))
    again = times.withColumn("_before", before).where(F.col("_before") >= F.col("sent_at") - hours(window))
    return posts.join(again.select(*key, "sent_at"), [*key, "sent_at"], "left_semi").select("post_id").distinct()


def horizon_due(snapshots: DataFrame, posts: DataFrame, age: Column, horizons: list[int]) -> DataFrame:
    """post_id and the horizons that a post has passed without a snapshot of that age."""
    taken = snapshots.groupBy("post_id").agg(F.max("age_hours").alias("oldest"))
    due = F.filter(F.array(*map(F.lit, horizons)), lambda h: (h <= age) & ~F.coalesce(F.col("oldest") >= h, F.lit(False)))
    return posts.join(taken, "post_id", "left").select("post_id", due.alias("due")).where(F.size("due") > 0)


def split_and_merged(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    """kind, value, n: events in several clusters, and clusters of several events."""
    split = df.groupBy(gold).agg(F.countDistinct(predicted).alias("n")).where("n > 1").select(F.lit("split").alias("kind"), F.col(gold).cast("string").alias("value"), "n")
    merged = df.groupBy(predicted).agg(F.countDistinct(gold).alias("n")).where("n > 1").select(F.lit("merged").alias("kind"), F.col(predicted).cast("string").alias("value"), "n")
    return split.unionByName(merged)
