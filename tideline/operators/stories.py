"""Stories (clusters of items): features, scores, and which of them are published.

Expected columns. items: item_id, cluster_id, source_id, status, kind,
published_at, text, topic_score, title_embedding, meta (map of counts).
clusters: cluster_id, mode (news or curated), state, centroid, first_seen,
last_seen, item_count, source_count, item_count_at_publish, interest.
sources: source_id, authority, performance. `now` is a timestamp column, so that
results can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import vectors as V
from tideline.operators import scoring

#: Hours that a story of each mode stays.
HOURS = {"news": 48, "curated": 336}
# fixed values: kinds by precedence
KINDS = ["video", "article", "post"]
#: Ratings that a run may ask for.
RATINGS = 12


def members(items: DataFrame) -> DataFrame:
    return items.where(F.col("status").isin("clustered", "duplicate"))


def fresh(at: Column, mode: Column, now: Column, hours: dict[str, int] | None = None) -> Column:
    """Whether a time lies in the window of its mode."""
    h = HOURS | (hours or {})
    return at >= now - F.make_dt_interval(F.lit(0), F.when(mode == "curated", h["curated"]).otherwise(h["news"]))


def age_hours(at: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(at)) / 3.6e9


def closed(clusters: DataFrame, now: Column, hours: dict[str, int] | None = None) -> DataFrame:
    """Open stories that have left their window become closed."""
    gone = (F.col("state") == "open") & ~fresh(F.col("last_seen"), F.col("mode"), now, hours)
    return clusters.withColumn("state", F.when(gone, "closed").otherwise(F.col("state")))


def features(clusters: DataFrame, items: DataFrame, sources: DataFrame, now: Column, hours: dict[str, int] | None = None) -> DataFrame:
    """Open and published stories in their window with what their items say: one pre-aggregate a join.

    authority counts each source once (0.5 without any), recent the items of six
    hours, content_length the longest text, engagement the best of all items
    (null if none is measured), topic_score and title_centroid clustered items only.
    """
    live = clusters.where(F.col("state").isin("open", "published") & F.col("centroid").isNotNull() & fresh(F.col("last_seen"), F.col("mode"), now, hours))
    mine, clustered = members(items), items.where("status = 'clustered'")
    counts = {k: F.col("meta")[k] for k in scoring.FULL}
    totals = mine.groupBy("cluster_id").agg(
        F.count_if(F.col("published_at") >= now - F.make_dt_interval(F.lit(0), F.lit(6))).alias("recent"),
        F.coalesce(F.max(F.length(F.trim("text"))), F.lit(0)).alias("content_length"),
        F.max(scoring.engagement(counts)).alias("engagement"),
    )
    own = sources.select("source_id", scoring.authority(F.col("authority"), F.col("performance")).alias("a"))
    authority = mine.select("cluster_id", "source_id").distinct().join(own, "source_id").groupBy("cluster_id").agg(F.avg("a").alias("authority"))
    topic = clustered.groupBy("cluster_id").agg(F.avg("topic_score").alias("topic_score"))
    title = V.mean_vector(clustered.where("title_embedding is not null"), ["cluster_id"], "title_embedding", "title_centroid")
    out = live
    for part in (totals, authority, topic, title):
        out = out.join(part, "cluster_id", "left")
    return out.withColumns({"authority": F.coalesce("authority", F.lit(0.5)), "recent": F.coalesce("recent", F.lit(0)), "content_length": F.coalesce("content_length", F.lit(0))})


def scores(found: DataFrame, now: Column, topic: list[float] | None = None, weights: dict[str, float] | None = None, hours: dict[str, int] | None = None) -> DataFrame:
    """Adds score and breakdown to features(); both modes are scored in one pass.

    Topic fit is the mean topic score of the items, else the likeness of their
    titles to the topic, else neutral. Own weights are for news only.
    """
    h = HOURS | (hours or {})
    vector = F.array(*[F.lit(float(x)) for x in topic]) if topic else None
    likeness = F.lit(0.5) if vector is None else F.when(F.col("title_centroid").isNotNull(), F.greatest(F.lit(0.0), V.cosine("title_centroid", vector))).otherwise(0.5)
    unmeasured = F.col("topic_score").isNull() & (F.lit(True) if vector is None else F.col("title_centroid").isNull())
    fit = F.when(F.col("topic_score").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("topic_score")))).otherwise(likeness)
    age = age_hours(F.col("last_seen"), now)
    curated = F.col("mode") == "curated"
    rows = found.withColumns(
        {
            "topic_fit": fit, "coverage": scoring.coverage(F.col("source_count")), "velocity": scoring.velocity(F.col("recent")),
            "freshness": scoring.freshness(age, F.when(curated, h["curated"]).otherwise(h["news"]) / 4),
            "authority": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("authority"))),
            "depth": scoring.depth(F.col("content_length")), "measured": F.col("engagement").isNotNull(), "engagement": F.coalesce("engagement", F.lit(0.5)),
        }
    )
    neutral = {"topic_fit": unmeasured, "engagement": ~F.col("measured")}
    news, other = (scoring.parts(w, own, neutral) for w, own in ((scoring.NEWS, weights), (scoring.CURATED, None)))
    score, breakdown = (F.when(curated, b).otherwise(a) for a, b in zip(news, other, strict=True))
    return rows.withColumns({"score": score, "breakdown": breakdown})


def topic_value(breakdown: str = "breakdown") -> Column:
    return F.coalesce(F.col(breakdown)["topic_fit"]["value"], F.lit(0.5))


def passes_topic(threshold: float, breakdown: str = "breakdown") -> Column:
    return scoring.passes_topic(topic_value(breakdown), F.coalesce(F.col(breakdown)["topic_fit"]["neutral"], F.lit(False)), threshold)


def kinds(clusters: DataFrame, items: DataFrame) -> DataFrame:
    """cluster_id, kind: news, or the first kind by precedence and item_id of a curated story's clustered items (article without any)."""
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    first = items.where("status = 'clustered'").groupBy("cluster_id").agg(F.min_by("kind", F.struct(F.when(place == 0, len(KINDS) + 1).otherwise(place), "item_id")).alias("_kind"))
    return clusters.select("cluster_id", "mode").join(first, "cluster_id", "left").select("cluster_id", F.when(F.col("mode") == "news", "news").otherwise(F.coalesce("_kind", F.lit("article"))).alias("kind"))


def rested(items: DataFrame, recent: DataFrame) -> DataFrame:
    """cluster_id of stories with an item of no source, or of one that is not among the recent ones (source_id)."""
    flagged = members(items).select("cluster_id", "source_id").distinct().join(recent.select("source_id").distinct().withColumn("_used", F.lit(True)), "source_id", "left")
    return flagged.where(F.col("source_id").isNull() | F.col("_used").isNull()).select("cluster_id").distinct()


def selected(
    scored: DataFrame, items: DataFrame, now: Column, most: int, *, min_items: int = 2, topic_threshold: float = 0.4, single: float | None = None,
    for_rating: bool = False, only: list[str] | None = None, recent: DataFrame | None = None, hours: dict[str, int] | None = None,
) -> DataFrame:
    """The best `most` candidates (a top-k) with kind and position pos from 0.

    Candidates are open curated stories; open news of min_items items, or of
    fewer that are rated `single` or more (any, for_rating); and published news
    that has grown by half and by three items. `only` keeps kinds, `recent`
    (source_id) rests stories whose sources were all used lately.
    """
    count, before = F.col("item_count"), F.coalesce("item_count_at_publish", F.lit(0))
    alone = F.lit(False) if single is None else F.lit(for_rating) | (F.col("interest") >= single)
    news, state = F.col("mode") == "news", F.col("state")
    ready = (~news & (state == "open")) | (news & (state == "open") & ((count >= min_items) | F.coalesce(alone, F.lit(False)))) | (news & (state == "published") & (count >= before * 1.5) & (count - before >= 3))
    rows = scored.where(F.col("score").isNotNull() & fresh(F.col("last_seen"), F.col("mode"), now, hours) & ready & passes_topic(topic_threshold))
    rows = rows.join(kinds(rows, items), "cluster_id")
    if only:
        rows = rows.where(F.col("kind").isin(*only))
    if recent is not None:
        rows = rows.join(rested(items, recent), "cluster_id", "left_semi")
    best = rows.orderBy(topic_value().desc(), F.col("score").desc(), "cluster_id").limit(most)
    order = Window.orderBy(topic_value().desc(), F.col("score").desc(), "cluster_id")  # over `most` rows
    return best.withColumn("pos", F.row_number().over(order) - 1)


def sources_of(stories: DataFrame, items: DataFrame) -> DataFrame:
    """Adds source_ids, the distinct sources of each story's items, sorted."""
    found = members(items).where("source_id is not null").join(stories.select("cluster_id"), "cluster_id", "left_semi").groupBy("cluster_id").agg(F.array_sort(F.collect_set("source_id")).alias("source_ids"))
    return stories.join(found, "cluster_id", "left").withColumn("source_ids", F.coalesce("source_ids", F.array().cast(dict(found.dtypes)["source_ids"])))


def diversified(candidates: DataFrame) -> DataFrame:
    """Candidates (cluster_id, source_ids, pos) without those whose sources earlier ones have used up; stories without sources stay.

    A story that goes adds no source that was not used before, so what is used is
    simply all sources of the earlier candidates: a story stays if it is the first with
    one of its sources. That holds for any number of candidates. Of equal places the
    smaller cluster_id comes first.
    """
    each = candidates.select("cluster_id", "pos", F.explode("source_ids").alias("source"))
    first = each.groupBy("source").agg(F.min(F.struct("pos", "cluster_id")).alias("f")).select("f.cluster_id")
    kept = first.unionAll(candidates.where(F.size("source_ids") == 0).select("cluster_id")).distinct()
    return candidates.join(kept, "cluster_id", "left_semi")


def by_interest(candidates: DataFrame, ratings: DataFrame, most: int, budget: int = RATINGS) -> DataFrame:
    """The `most` most interesting candidates (pos, interest, interest_items, item_count), with interest as it is now.

    Stories without a rating, or half as large again as when they were rated,
    take a new one from ratings (cluster_id, rating), the first `budget` by pos;
    the others keep theirs. Without a rating a story counts as 5.
    """
    needs = F.col("interest").isNull() | (F.col("item_count") >= F.coalesce("interest_items", F.lit(0)) * 1.5)
    turn = F.sum(F.when(needs, 1).otherwise(0)).over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))  # over a pool
    rows = candidates.withColumns({"_needs": needs, "_turn": turn}).join(ratings.select("cluster_id", "rating"), "cluster_id", "left")
    rows = rows.withColumn("interest", F.when(F.col("_needs") & (F.col("_turn") <= budget), F.col("rating").cast("double")).otherwise(F.col("interest").cast("double")))
    return rows.drop("_needs", "_turn", "rating").orderBy(F.coalesce("interest", F.lit(5.0)).desc(), "pos").limit(most)


def remaining(drafts: DataFrame, now: Column, limit: int) -> DataFrame:
    """One row, n: what is left today of instant drafts (created_at, instant, status)."""
    used = F.count_if(F.col("instant") & (F.col("status") != "failed") & (F.col("created_at") > now - F.make_dt_interval(F.lit(1))))
    return drafts.agg(F.greatest(F.lit(0), F.lit(limit) - used).alias("n"))


def instant(candidates: DataFrame, threshold: float, left: DataFrame) -> DataFrame:
    """Open candidates rated threshold or more, best first, as many as remaining() leaves."""
    hot = candidates.where((F.col("state") == "open") & (F.coalesce("interest", F.lit(0)) >= threshold))
    ranked = hot.withColumn("_r", F.row_number().over(Window.orderBy(F.col("interest").desc(), "pos")))  # over a pool
    return ranked.join(F.broadcast(left), F.col("_r") <= F.col("n")).drop("_r", "n")


def slot(candidates: DataFrame, most: int, floor: float | None = None) -> DataFrame:
    """Candidates with status: chosen, spare, or below_interest_floor for those unrated or under the floor."""
    below = F.lit(False) if floor is None else F.col("interest").isNull() | (F.col("interest") < floor)
    rank = F.sum(F.when(~below, 1).otherwise(0)).over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))  # over a pool
    return candidates.withColumn("status", F.when(below, "below_interest_floor").when(rank <= most, "chosen").otherwise("spare"))


def story_list(scored: DataFrame, *, state: str | None = None, contains: str | None = None, score: float | None = None, interest: float | None = None, most: int = 50, skip: int = 0) -> DataFrame:
    """A page of stories: open ones first, then by topic fit, score (none last) and the newest."""
    rows = scored
    if state:
        rows = rows.where(F.col("state") == state)
    if contains:
        rows = rows.where(F.contains(F.lower("title"), F.lower(F.lit(contains))))
    if score is not None:
        rows = rows.where(F.col("score") >= score)
    if interest is not None:
        rows = rows.where(F.col("interest") >= interest)
    return rows.orderBy((F.col("state") == "open").desc(), topic_value().desc(), F.col("score").desc_nulls_last(), F.col("cluster_id").desc()).offset(skip).limit(most)


def arrivals(items: DataFrame) -> DataFrame:
    """cluster_id and the times of its items in order; a story lives no longer than its window, which bounds the list."""
    return members(items).groupBy("cluster_id").agg(F.array_sort(F.collect_list("published_at")).alias("arrivals"))


def of_drafts(drafts: DataFrame, items: DataFrame) -> DataFrame:
    """draft_id and items of its cluster_ids: the array is exploded, so the join is by equality."""
    return drafts.select("draft_id", F.explode("cluster_ids").alias("cluster_id")).join(items, "cluster_id")


def titles_of(drafts: DataFrame, scored: DataFrame) -> DataFrame:
    """draft_id and the titles of its stories by score (none last) and id, joined by a middle dot."""
    found = drafts.select("draft_id", F.explode("cluster_ids").alias("cluster_id")).join(scored.select("cluster_id", "title", "score"), "cluster_id")
    listed = F.array_sort(F.collect_list(F.struct(F.col("score").isNull().alias("none"), (-F.col("score")).alias("s"), "cluster_id", "title")))
    return found.groupBy("draft_id").agg(F.array_join(F.transform(listed, lambda x: x["title"]), " · ").alias("titles"))


def claimed(clusters: DataFrame, chosen: DataFrame) -> DataFrame:
    """Stories that are chosen (cluster_id) go from open to drafted."""
    took = chosen.select("cluster_id").distinct().withColumn("_took", F.lit(True))
    return clusters.join(took, "cluster_id", "left").withColumn("state", F.when(F.col("_took") & (F.col("state") == "open"), "drafted").otherwise(F.col("state"))).drop("_took")


def cleared(clusters: DataFrame, items: DataFrame, drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stories without those never published and without draft, and items of the ones that go as ignored, without story."""
    used = drafts.select(F.explode("cluster_ids").alias("cluster_id")).distinct()
    gone = clusters.where((F.col("state") != "published") & F.col("published_at").isNull()).join(used, "cluster_id", "left_anti").select("cluster_id")
    flagged = items.join(gone.withColumn("_gone", F.lit(True)), "cluster_id", "left")
    freed = flagged.withColumns({"status": F.when(F.col("_gone"), "ignored").otherwise(F.col("status")), "cluster_id": F.when(F.col("_gone").isNull(), F.col("cluster_id"))}).drop("_gone")
    return clusters.join(gone, "cluster_id", "left_anti"), freed


def suggestions(hits: DataFrame, known: DataFrame, samples: int = 3, each: int = 10, most: int = 30) -> DataFrame:
    """type, value, hits, score and sample titles of new sources, at most `each` a type and `most` in all.

    hits: type, value, query, title, pos, rating; hits count distinct queries,
    the score blends them (full at three) with the best rating where there is one.
    """
    new = hits.join(known.select("type", "value").distinct(), ["type", "value"], "left_anti")
    shown = new.where("title is not null and title <> ''").groupBy("type", "value", "title").agg(F.min("pos").alias("pos"))
    shown = shown.withColumn("_r", F.row_number().over(Window.partitionBy("type", "value").orderBy("pos", "title"))).where(F.col("_r") <= samples)
    shown = shown.groupBy("type", "value").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "title"))), lambda x: x["title"]).alias("samples"))
    found = new.groupBy("type", "value").agg(F.countDistinct("query").alias("hits"), F.max("rating").alias("rating"))
    found = found.withColumn("score", scoring.suggested(F.col("hits"), F.col("rating")))
    order = [F.col("score").desc(), F.col("hits").desc(), F.col("value")]
    capped = found.withColumn("_r", F.row_number().over(Window.partitionBy("type").orderBy(*order))).where(F.col("_r") <= each).drop("_r", "rating")
    return capped.orderBy(*order, "type").limit(most).join(shown, ["type", "value"], "left")


def new_items(items: DataFrame, known: DataFrame, now: Column, hours: dict[str, int] | None = None) -> DataFrame:
    """Items of an unknown url_hash that are curated or in the news window."""
    rows = items.join(known.select("url_hash").distinct(), "url_hash", "left_anti")
    return rows.where((F.col("mode") == "curated") | fresh(F.col("published_at"), F.lit("news"), now, hours))


def dashboard(scored: DataFrame, min_items: int, single: float, threshold: float, most: int = 6) -> DataFrame:
    """The best open stories of enough items or interest that pass the topic gate."""
    rows = scored.where((F.col("state") == "open") & ((F.col("item_count") >= min_items) | (F.col("interest") >= single)) & passes_topic(threshold))
    return rows.orderBy(topic_value().desc(), F.col("score").desc_nulls_last(), "cluster_id").limit(most)


def view(scored: DataFrame, *, min_items: int = 2, threshold: float = 0.4, singles: bool = False, off_topic: bool = False, contains: str = "", interest: str = "all", images: bool = False, by: str = "interest") -> DataFrame:
    """Stories as an editor filters and orders them.

    Small news and stories off topic are hidden unless asked for (published ones
    are never off topic); interest is all, rated, high (6 or more) or low (under
    3); by is interest, date, items, sources or topic_fit, ties by cluster_id.
    """
    rows = scored
    if not singles:
        rows = rows.where((F.col("mode") == "curated") | (F.col("item_count") >= min_items))
    if not off_topic:
        rows = rows.where((F.col("state") == "published") | passes_topic(threshold))
    if contains.strip():
        rows = rows.where(F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lower(F.lit(contains.strip()))))
    rated = {"all": F.lit(True), "rated": F.col("interest").isNotNull(), "high": F.col("interest") >= 6, "low": F.col("interest") < 3}
    rows = rows.where(rated[interest])
    if images:
        rows = rows.where("image_item_id is not null")
    orders = {"interest": [F.coalesce("interest", F.lit(-1.0)).desc(), F.col("last_seen").desc()], "date": [F.col("last_seen").desc()], "items": [F.col("item_count").desc()], "sources": [F.col("source_count").desc()], "topic_fit": [F.coalesce(F.col("breakdown")["topic_fit"]["value"], F.lit(0.0)).desc()]}
    return rows.orderBy(*orders[by], "cluster_id")


def image_items(items: DataFrame) -> DataFrame:
    """cluster_id, image_item_id: the newest item with a picture."""
    return members(items).where("image_url is not null").groupBy("cluster_id").agg(F.max_by("item_id", F.struct("published_at", "item_id")).alias("image_item_id"))


def relevance(items: DataFrame, clusters: DataFrame, authority: str = "authority") -> DataFrame:
    """Items with relevance: likeness to their story's centroid and 0.15 of their source's authority."""
    rows = items.join(clusters.select("cluster_id", "centroid"), "cluster_id")
    return rows.withColumn("relevance", V.cosine("embedding", "centroid") + 0.15 * F.col(authority)).drop("centroid")


def context_cap(chosen: Column) -> Column:
    """Characters of each of so many items in a context."""
    return F.greatest(F.lit(300), F.floor(F.lit(7000) / F.greatest(chosen, F.lit(1))))
