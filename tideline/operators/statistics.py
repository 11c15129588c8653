"""Audience statistics: medians, relative performance, horizon snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.rollup import top_per_group


#: Accuracy of the sketch that brackets a median, and the share of a group on either side that the bracket holds: ten times the sketch's error.
ACCURACY, MARGIN = 10_000, 0.001


def medians(df: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """The exact median (mean of the two middle values) of each group; null for groups without values.

    A sketch gives two values that the middle lies between, whatever the
    distribution. A group's values below them are counted, equal values between them
    too, and only the latter are put in order: some thousandth of a group, and no
    more than its distinct values there. Keys may be null. A bracket that missed the middle is an error.
    """
    v = F.col(value).cast("double")
    on = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]
    bracket = F.percentile_approx(v, [0.5 - MARGIN, 0.5 + MARGIN], ACCURACY)
    ends = df.groupBy(*by).agg(F.count(v).alias("_n"), bracket.alias("_p"))
    rows = df.select(*by, v.alias("_v")).where("_v is not null").alias("a").join(ends.where("_n > 0").alias("e"), on("a", "e"))
    rows = rows.where(F.col("_v") <= F.col("_p")[1]).select("a.*", "_n", F.when(F.col("_v") >= F.col("_p")[0], F.col("_v")).alias("_x"))
    counts = rows.groupBy(*by, "_x").agg(F.count("*").alias("_c"), F.max("_n").alias("_n"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy(F.asc_nulls_first("_x")))
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)  # places of the two middle values
    held = counts.withColumn("_u", upto).where((F.col("_u") > low) & (F.col("_u") - F.col("_c") <= high))
    missed = F.bool_or(F.col("_x").isNull()) | (F.max("_u") <= F.max(high))
    middle = held.groupBy(*by).agg(F.when(missed, F.raise_error(F.lit("a median lies outside its bracket")).cast("double")).otherwise((F.min("_x") + F.max("_x")) / 2).alias(name))
    return ends.select(*by).alias("a").join(middle.alias("m"), on("a", "m"), "left").select(*[f"a.{c}" for c in by], name)


def summary(posts: DataFrame, by: list[str], views: str, reactions: str) -> DataFrame:
    """posts, views and reactions (sums) and median_views of each group; null numbers count as 0 in sums and not in medians, a group without any has a median of 0."""
    sums = posts.groupBy(*by).agg(F.count("*").alias("posts"), F.coalesce(F.sum(views), F.lit(0)).alias("views"), F.coalesce(F.sum(reactions), F.lit(0)).alias("reactions"))
    found = medians(posts, by, views, "_median").select(*[F.col(c).alias("_" + c) for c in by], "_median")
    same = [F.col(c).eqNullSafe(F.col("_" + c)) for c in by]
    return sums.join(found, same).select(*by, "posts", "views", "reactions", F.coalesce("_median", F.lit(0.0)).alias("median_views"))


def relative(posts: DataFrame, channel: str, views: str) -> DataFrame:
    """Adds relative: views against the channel's median (a median of 0 counts as 1)."""
    return posts.join(medians(posts, [channel], views, "_median"), channel).withColumn("relative", F.col(views) / F.greatest("_median", F.lit(1.0))).drop("_median")


def performance(rated: DataFrame, source: str, least: int = 3) -> DataFrame:
    """posts and performance of each source: the median relative, within 0.5 and 1.5; null below `least` posts."""
    found = rated.groupBy(source).agg(F.count("*").alias("posts")).join(medians(rated, [source], "relative", "_m"), source)
    return found.select(source, "posts", F.when(F.col("posts") >= least, F.greatest(F.lit(0.5), F.least(F.lit(1.5), "_m"))).alias("performance"))


def settled(posts: DataFrame, now, least_hours: int = 48, most_days: int = 30) -> DataFrame:
    """Sent posts with views that are older than two days and younger than thirty."""
    age = (F.unix_micros(now) - F.unix_micros("sent_at")) / 3.6e9
    return posts.where((F.col("status") == "sent") & F.col("views").isNotNull() & (age > least_hours) & (age < 24 * most_days))


def hints(rated: DataFrame, channel: str, key: str, views: str, posts: int = 6, median: float = 30, k: int = 3) -> DataFrame:
    """best_and_worst() of channels with enough posts and a median of enough views."""
    enough = rated.groupBy(channel).agg(F.count("*").alias("_posts")).where(F.col("_posts") >= posts).join(medians(rated, [channel], views, "_m").where(F.col("_m") >= median), channel).select(channel)
    return best_and_worst(rated.join(enough, channel, "left_semi"), channel, key, k)


def best_and_worst(rated: DataFrame, channel: str, key: str, k: int = 3) -> DataFrame:
    """kind, and the k best and worst posts of each channel."""
    best = top_per_group(rated, [channel], [F.col("relative").desc(), F.col(key)], k).withColumn("kind", F.lit("best"))
    worst = top_per_group(rated, [channel], [F.col("relative"), F.col(key)], k).withColumn("kind", F.lit("worst"))
    return best.unionByName(worst)


def at_horizons(snapshots: DataFrame, key: str, age: str, order: str, metrics: str | list[str], horizons: list[int]) -> DataFrame:
    """A column for each metric and horizon h: that of the first snapshot aged h to 1.5 h, and of the last one; one pass, no join.

    Columns are h24 and last for one metric by its name, views_h24 and views_last for a list.
    """
    many = isinstance(metrics, list)
    picked = []
    for m in metrics if many else [metrics]:
        head = f"{m}_" if many else ""
        picked += [F.min_by(m, F.when((F.col(age) >= h) & (F.col(age) <= 1.5 * h), F.col(order))).alias(f"{head}h{h}") for h in horizons]
        picked.append(F.max_by(m, order).alias(f"{head}last"))
    return snapshots.groupBy(key).agg(*picked)
