"""The processing step: new items join stories or make new ones, duplicates follow their originals, and what was touched is rolled up again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import vectors as V
from tideline.operators import clustering
from tideline.operators.stories import HOURS
from tideline.tables import written

#: Where results of searches for news come from.
NEWS_SEARCH = "https://news.google.com/rss/search?"
#: Items that one run of a backfill takes.
BATCH = 128


def hours_of(at: Column) -> Column:
    """Hours since 1970."""
    return F.unix_micros(at) / 3.6e9


def searched(source_url: Column) -> Column:
    """Whether a source is a search for news."""
    return F.coalesce(F.startswith(source_url, F.lit(NEWS_SEARCH)), F.lit(False))


def eligible(stories: DataFrame, items: DataFrame, hours: dict[str, int] | None = None) -> DataFrame:
    """Stories that may take the new items of their project and mode: with a centroid, not closed, and seen since a window before the first of them. Drafted and excluded ones do."""
    h = HOURS | (hours or {})
    first = items.groupBy("project", "mode").agg(F.min("published_at").alias("_first"))
    window = F.make_dt_interval(F.lit(0), F.when(F.col("mode") == "curated", h["curated"]).otherwise(h["news"]))
    rows = stories.where("state <> 'closed' and centroid is not null").join(first, ["project", "mode"])
    return rows.where(F.col("last_seen") >= F.col("_first") - window).drop("_first")


def rolled_up(stories: DataFrame, items: DataFrame) -> DataFrame:
    """Stories with item_count, source_count, first_seen, last_seen of their members, and the title of the member nearest to the centroid.

    A member without a title or vector doesn't name its story; one that no member
    names keeps its title, and takes the first member's where it has none.
    """
    members = items.where(F.col("status").isin("clustered", "duplicate") & F.col("cluster_id").isNotNull()).join(stories.select("cluster_id", "centroid"), "cluster_id")
    near = F.round(V.cosine("embedding", "centroid"), 9)
    named = (F.coalesce(F.trim("title"), F.lit("")) != "") & F.col("embedding").isNotNull() & (F.col("status") == "clustered")
    found = members.groupBy("cluster_id").agg(
        F.count("*").alias("_items"), F.greatest(F.countDistinct("source_id"), F.lit(1)).alias("_sources"), F.min("published_at").alias("_first"), F.max("published_at").alias("_last"),
        F.max_by("title", F.when(named, F.struct(near, -F.col("item_id")))).alias("_title"), F.min_by("title", F.when(F.col("title").isNotNull(), F.struct("published_at", "item_id"))).alias("_any"),
    )
    rows = stories.join(found, "cluster_id", "left")
    now = {"item_count": F.coalesce("_items", "item_count"), "source_count": F.coalesce("_sources", "source_count"), "first_seen": F.coalesce("_first", "first_seen"), "last_seen": F.coalesce("_last", "last_seen"), "title": F.coalesce("_title", "title", "_any")}
    return rows.withColumns(now).select(stories.columns)


def step(items: DataFrame, stories: DataFrame, base: float = 0.72, hours: dict[str, int] | None = None, same: float = clustering.SAME) -> tuple[DataFrame, DataFrame]:
    """items and stories after the new items (status embedded) of all projects were clustered, news and then curated ones.

    items: item_id, project, mode, source_id, title, published_at, embedding, status,
    cluster_id, dup_of, searched; stories: cluster_id, project, mode, state, title, centroid,
    item_count, source_count, first_seen, last_seen. A new item that is alike to an accepted item of
    the window is its duplicate; duplicates from before follow an original that gets
    a story now. A new story's id is that of its first item beyond all ids that are taken. Only
    touched stories get a new centroid (of all unit vectors that made it) and are rolled up.
    """
    h = HOURS | (hours or {})
    stories = written(stories, "stories-before")  # they are read six times
    group = F.concat_ws("|", F.col("project").cast("string"), "mode")
    new = items.where("status = 'embedded' and embedding is not null")
    taken = (stories.agg(F.max("cluster_id")).first()[0] or 0) + 1
    open_stories = eligible(stories, new, hours)
    old = items.where("status = 'clustered' and embedding is not null and cluster_id is not null")
    found = None
    for mode in ("news", "curated"):
        own = new.where(F.col("mode") == mode).select(group.alias("group"), "item_id", "embedding", hours_of(F.col("published_at")).alias("at"), clustering.threshold(F.col("mode"), F.coalesce("searched", F.lit(False)), base).alias("threshold"))
        stored = open_stories.where(F.col("mode") == mode).select(group.alias("group"), F.col("cluster_id").alias("cluster"), "centroid", F.col("item_count").alias("n"), hours_of(F.col("last_seen")).alias("last"))
        first = own.groupBy("group").agg(F.min("at").alias("_first"))
        known = old.where(F.col("mode") == mode).select(group.alias("group"), "item_id", "embedding", hours_of(F.col("published_at")).alias("at"), F.col("cluster_id").alias("cluster")).join(first, "group").where(F.col("at") >= F.col("_first") - h[mode]).drop("_first")
        part = clustering.single_pass(own, "group", "item_id", "embedding", "at", float(h[mode]), "threshold", stored, same, known)
        found = part if found is None else found.unionByName(part)
    found = written(found, "clustered")
    ids = open_stories.select(group.alias("group"), F.col("cluster_id").alias("cluster"), F.lit(True).alias("stored"))
    kept = old.select(group.alias("group"), F.col("cluster_id").alias("cluster"), F.lit(True).alias("stored"))  # a duplicate's story may be closed
    numbers = found.groupBy("group", "cluster").agg(F.min("item_id").alias("first")).join(ids.unionByName(kept).distinct(), ["group", "cluster"], "left")
    numbers = numbers.select("group", "cluster", F.when(F.col("stored"), F.col("cluster")).otherwise(F.col("first") + taken).alias("now"), F.col("stored").isNull().alias("new"))
    placed = written(found.join(numbers, ["group", "cluster"]).select("item_id", F.col("now").alias("_cluster"), F.col("dup_of").alias("_dup"), "new"), "placed")

    moved = items.join(placed.drop("new"), "item_id", "left")
    moved = moved.withColumns({"status": F.when(F.col("_cluster").isNull(), F.col("status")).when(F.col("_dup").isNotNull(), "duplicate").otherwise("clustered"), "dup_of": F.coalesce("_dup", "dup_of"), "cluster_id": F.coalesce("_cluster", "cluster_id")}).select(items.columns)
    late = placed.where("_dup is null").select(F.col("item_id").alias("dup_of"), F.col("_cluster").alias("_late"))
    moved = written(moved.join(late, "dup_of", "left").withColumn("cluster_id", F.coalesce("cluster_id", "_late")).select(items.columns), "items")

    joined = placed.where("_dup is null").join(new.select("item_id", "project", "mode", V.unit("embedding").alias("u"), "published_at"), "item_id")
    touched = joined.groupBy(F.col("_cluster").alias("cluster_id")).agg(F.count("*").alias("_n"), F.max("new").alias("_new"), F.first("project").alias("_project"), F.first("mode").alias("_mode"), F.min("published_at").alias("_at"))
    means = V.mean_vector(joined.select(F.col("_cluster").alias("cluster_id"), "u"), ["cluster_id"], "u", "_mean")
    touched = touched.join(means, "cluster_id")
    both = stories.join(touched, "cluster_id", "full")
    before = F.coalesce("item_count", F.lit(0))
    sums = F.zip_with(F.coalesce(F.col("centroid").cast("array<double>"), F.transform("_mean", lambda x: F.lit(0.0))), "_mean", lambda a, b: (a * before + b * F.col("_n")) / (before + F.col("_n")))
    new_values = {"project": F.coalesce("project", "_project"), "mode": F.coalesce("mode", "_mode"), "state": F.coalesce("state", F.lit("open")), "centroid": F.when(F.col("_n").isNull(), F.col("centroid").cast("array<double>")).otherwise(sums), "first_seen": F.coalesce("first_seen", "_at"), "last_seen": F.coalesce("last_seen", "_at"), "item_count": F.coalesce("item_count", F.lit(0)), "source_count": F.coalesce("source_count", F.lit(1))}
    both = written(both.withColumns(new_values).select(*stories.columns, F.col("_n").isNotNull().alias("_touched")), "stories")
    again = rolled_up(both.where("_touched").drop("_touched"), moved)
    return moved, both.where("not _touched").drop("_touched").unionByName(again)


def new_space(items: DataFrame, stories: DataFrame, drafted: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items and stories of projects (changed: project) whose vectors are of no more use: items start anew, stories without a draft go, others lose what came of vectors and are closed unless published.

    drafted: cluster_id of all drafts. Vectors of other projects stay.
    """
    mark = changed.select("project").distinct().withColumn("_changed", F.lit(True))
    rows = items.join(mark, "project", "left")
    reset = {"status": F.when(F.col("_changed"), "new").otherwise(F.col("status"))} | {c: F.when(F.col("_changed").isNull(), F.col(c)) for c in ("embedding", "title_embedding", "topic_score", "cluster_id", "dup_of", "minhash") if c in items.columns}
    held = stories.join(mark, "project", "left").join(drafted.select("cluster_id").distinct().withColumn("_drafted", F.lit(True)), "cluster_id", "left").where("_changed is null or _drafted")
    cleared = {"state": F.when(F.col("_changed") & (F.col("state") != "published"), "closed").otherwise(F.col("state"))} | {c: F.when(F.col("_changed").isNull(), F.col(c)) for c in ("centroid", "published_centroid", "score", "score_breakdown") if c in stories.columns}
    return rows.withColumns(reset).select(items.columns), held.withColumns(cleared).select(stories.columns)


def backfill(items: DataFrame, stories: DataFrame, most: int = BATCH) -> DataFrame:
    """The clustered items of open or published stories that lack a title's vector or a topic score, the newest first, so many a project."""
    from tideline.operators.rollup import top_per_group

    live = stories.where(F.col("state").isin("open", "published")).select("cluster_id")
    lack = items.where("status = 'clustered' and embedding is not null and (title_embedding is null or topic_score is null)").join(live, "cluster_id", "left_semi")
    return top_per_group(lack, ["project"], [F.col("published_at").desc(), F.col("item_id")], most).select(items.columns)
