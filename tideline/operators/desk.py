"""The editor's desk: drafts and stories change their states, statistics of posts, guards and small predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.operators.publishing import hours

# fixed values: minutes after which a draft is stuck, hours between two collections, days that posts are tracked, days a video is waited for
STUCK, COLLECT, TRACK, WAIT = 15, 3, 30, 14
# fixed values: hours of a video's life at which it is measured, how late a measure may be
HORIZONS, TOLERANCE = [1, 6, 24, 72, 168, 720], 1.5
# fixed values: names of models for vectors and for other things than text, families of models for vectors
EMBEDS = r"(?i)(?:^|[:/\-_.])(?:bge|e5|gte|jina[-_]?embed|nomic[-_]?embed|mxbai[-_]?embed|snowflake[-_]?arctic[-_]?embed|all[-_]?minilm|multilingual[-_]?e5|text[-_]?embedding|embed(?:ding)?s?|qwen\d*(?:\.\d+)?[-_]?embed)"
NO_TEXT = r"(?i)whisper|orpheus|(?:^|[-_/])tts(?:[-_/]|$)|playai|distil-whisper|prompt[-_]?guard|safeguard|llama[-_]?guard"
FAMILIES = ["bert", "nomic-bert", "nomic-bert-moe", "jina-bert-v2", "gemma-embedding"]


def ordered_drafts(drafts: DataFrame) -> DataFrame:
    """Drafts that wait for a review first, then the newest."""
    return drafts.orderBy((F.col("status") == "pending_review").desc(), F.col("draft_id").desc())


def approved(drafts: DataFrame, chosen: DataFrame, channels: DataFrame, publications: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """drafts with the chosen ones (draft_id) approved that wait for a review and have a channel, and their new publications.

    A publication goes to each enabled channel of the project: due at its slot or
    now, or cancelled where the same text (fingerprint) waits or went out in the 24 hours
    before. Pairs of draft and channel that exist already aren't made again.
    """
    ready = drafts.where("status = 'pending_review'").join(chosen.select("draft_id").distinct(), "draft_id", "left_semi")
    pairs = ready.select("draft_id", "project", "scheduled_for", T.content_hash("title", "body").alias("fingerprint")).join(channels.where("enabled").select("project", "channel_id"), "project")
    told = publications.where(F.col("status").isin("pending", "sending", "sent") & (F.col("created_at") >= now - hours(24)))
    texts = drafts.select("draft_id", T.content_hash("title", "body").alias("fingerprint"))
    same = told.join(texts, "draft_id").select("channel_id", "fingerprint").distinct().withColumn("again", F.lit(True))
    fresh = pairs.join(publications.select("draft_id", "channel_id"), ["draft_id", "channel_id"], "left_anti").join(same, ["channel_id", "fingerprint"], "left")
    made = fresh.select("draft_id", "channel_id", F.when(F.col("again"), "cancelled").otherwise("pending").alias("status"), F.when(F.col("again").isNull(), F.greatest(now, F.coalesce("scheduled_for", now))).alias("due_at"), now.alias("created_at"))
    going = pairs.select("draft_id").distinct().withColumn("_go", F.lit(True))
    return drafts.join(going, "draft_id", "left").withColumn("status", F.when(F.col("_go"), "approved").otherwise(F.col("status"))).select(drafts.columns), made


def _stories_of(drafts: DataFrame) -> DataFrame:
    return drafts.select(F.explode("cluster_ids").alias("cluster_id")).distinct()


def _changed(stories: DataFrame, of: DataFrame, state: Column) -> DataFrame:
    return stories.join(of.withColumn("_hit", F.lit(True)), "cluster_id", "left").withColumn("state", F.when(F.col("_hit"), state).otherwise(F.col("state"))).select(stories.columns)


def rejected(drafts: DataFrame, stories: DataFrame, chosen: DataFrame, reopen: bool = False) -> tuple[DataFrame, DataFrame]:
    """drafts and stories after a rejection: of what waits or failed (and, to reopen, was rejected); stories go back to published, else are excluded, or open again."""
    states = ["pending_review", "failed", *(["rejected"] if reopen else [])]
    hit = drafts.where(F.col("status").isin(states)).join(chosen.select("draft_id").distinct(), "draft_id", "left_semi")
    back = F.when(~F.col("state").isin("drafted", "excluded"), F.col("state")).when(F.col("published_at").isNotNull(), "published").otherwise("open" if reopen else "excluded")
    done = drafts.join(hit.select("draft_id").withColumn("_hit", F.lit(True)), "draft_id", "left").withColumn("status", F.when(F.col("_hit"), "rejected").otherwise(F.col("status"))).select(drafts.columns)
    return done, _changed(stories, _stories_of(hit), back)


def cleared(drafts: DataFrame, stories: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of projects' drafts: those at work and approved; drafted stories without such a draft are published or open again."""
    gone = F.col("status").isin("pending_review", "rejected", "failed")
    hit = drafts.where(gone).join(projects.select("project").distinct(), "project", "left_semi")
    rest = drafts.join(hit.select("draft_id"), "draft_id", "left_anti")
    free = _stories_of(hit).join(_stories_of(rest.where(F.col("status").isin("generating", "pending_review", "approved"))), "cluster_id", "left_anti")
    back = F.when(F.col("state") != "drafted", F.col("state")).when(F.col("published_at").isNotNull(), "published").otherwise("open")
    return rest, _changed(stories, free, back)


def recovered(drafts: DataFrame, stories: DataFrame, now: Column, minutes: int = STUCK) -> tuple[DataFrame, DataFrame]:
    """Drafts that were being written for too long failed; their drafted stories are open again."""
    stuck = (F.col("status") == "generating") & (F.col("created_at") < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))
    return drafts.withColumn("status", F.when(stuck, "failed").otherwise(F.col("status"))), _changed(stories, _stories_of(drafts.where(stuck)), F.when(F.col("state") == "drafted", "open").otherwise(F.col("state")))


def set_aside(state: Column, wish: Column) -> Column:
    """A story's state after a wish to exclude or to reopen it; null where its state doesn't allow that."""
    return F.when((wish == "exclude") & state.isin("open", "closed", "published"), "excluded").when((wish == "reopen") & (state == "excluded"), "open")


def due_channels(channels: DataFrame, marks: DataFrame, posts: DataFrame, now: Column) -> DataFrame:
    """channel_id of enabled channels with a sent post of thirty days whose numbers were not collected in three hours.

    marks: key ('stats_at:' and the channel's id) and updated_at, as stored by others.
    """
    rows = channels.where("enabled").withColumn("_key", F.concat(F.lit("stats_at:"), F.col("channel_id").cast("string")))
    rows = rows.join(marks.select(F.col("key").alias("_key"), "updated_at"), "_key", "left").where(F.col("updated_at").isNull() | (F.col("updated_at") < now - hours(COLLECT)))
    live = posts.where((F.col("status") == "sent") & (F.col("sent_at") > now - F.make_dt_interval(F.lit(TRACK)))).select("channel_id")
    return rows.join(live, "channel_id", "left_semi").select("channel_id")


def tracked_posts(posts: DataFrame, now: Column) -> DataFrame:
    """Sent posts of thirty days with a number of their own on their channel."""
    return posts.where((F.col("status") == "sent") & F.col("external_id").rlike("^[0-9]+$") & (F.col("sent_at") > now - F.make_dt_interval(F.lit(TRACK))))


def effective_authority(authority: Column, performance: Column) -> Column:
    """A source's authority times what its posts achieve, 1 at most."""
    return F.least(F.lit(1.0), authority * F.coalesce(performance, F.lit(1.0)))


def videos_at_work(videos: DataFrame, now: Column) -> DataFrame:
    """videos with phase: pending (uploaded in fourteen days, without a video), tracked (with one that is young enough or of unknown age), else null. Times are seconds."""
    since = now - (max(HORIZONS) * TOLERANCE + 24) * 3600
    pending = F.col("publish_id").isNotNull() & F.col("video_id").isNull() & (F.col("uploaded_at") >= now - WAIT * 86400)
    tracked = F.col("video_id").isNotNull() & (F.col("created_at").isNull() | (F.col("created_at") >= since))
    return videos.withColumn("phase", F.when(pending, "pending").when(tracked, "tracked"))


def arrivals(at: Column, now: Column, window: int, width: float = 1.0) -> Column:
    """Where a time lies in the window of hours before now, from 0 to width; null for what is more than a fiftieth before it."""
    place = 1 - (F.unix_micros(now) - F.unix_micros(at)) / (window * 3.6e9)
    return F.when(place >= -0.02, F.greatest(F.lit(0.0), F.least(F.lit(1.0), place)) * width)


def model_kind(name: Column, families: Column) -> Column:
    """embed, chat or other: what a model is for, by its name and families."""
    known = F.transform(F.filter(F.coalesce(families, F.array().cast("array<string>")), lambda f: f.isNotNull()), F.lower)
    n = F.trim(F.coalesce(name, F.lit("")))
    return F.when(F.arrays_overlap(known, F.array(*map(F.lit, FAMILIES))) | n.rlike(EMBEDS), "embed").when(n.rlike(NO_TEXT), "other").otherwise("chat")


def needs_aspects(projects: DataFrame, marks: DataFrame) -> DataFrame:
    """project of those with a topic, without aspects, for whose topic none were sought yet (marks: key 'aspects_topic:' and the project, topic)."""
    rows = projects.where((F.size(F.coalesce("aspects", F.array().cast("array<string>"))) == 0) & (F.trim(F.coalesce("topic", F.lit(""))) != ""))
    rows = rows.withColumn("_key", F.concat(F.lit("aspects_topic:"), F.col("project").cast("string"))).join(marks.select(F.col("key").alias("_key"), F.col("topic").alias("_sought")), "_key", "left")
    return rows.where(~F.col("_sought").eqNullSafe(F.trim("topic"))).select("project")


def with_aspects(projects: DataFrame, found: DataFrame) -> DataFrame:
    """projects with found aspects (project, topic, aspects), where the topic is still the same and there are none yet."""
    new = found.select("project", F.col("topic").alias("_topic"), F.col("aspects").alias("_aspects")).where(F.size("_aspects") > 0)
    rows = projects.join(new, "project", "left")
    take = (F.col("topic") == F.col("_topic")) & (F.size(F.coalesce("aspects", F.array().cast("array<string>"))) == 0)
    return rows.withColumn("aspects", F.when(take, F.col("_aspects")).otherwise(F.col("aspects"))).select(projects.columns)


def metas(items: DataFrame) -> DataFrame:
    """cluster_id and the metas of its items, as a list in their order."""
    by_item = lambda a, b: F.when(a["item_id"] < b["item_id"], -1).when(a["item_id"] > b["item_id"], 1).otherwise(0)
    return items.where("meta is not null").groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "meta")), by_item), lambda x: x["meta"]).alias("metas"))


def has_key(payload: Column, key: str) -> Column:
    """Whether a JSON object has a key, with whatever value."""
    return F.coalesce(F.array_contains(F.json_object_keys(payload), key), F.lit(False))
