"""Rollups of stories and sources: pre-aggregates that joins then read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rollup(items: DataFrame, by: str, label: str, at: str) -> DataFrame:
    """Items, distinct labels (1 at least), first and last time of each group; one shuffle, combined map-side."""
    return items.groupBy(by).agg(F.count("*").alias("item_count"), F.greatest(F.countDistinct(label), F.lit(1)).alias("source_count"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark keeps k rows a group and task before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def capped(df: DataFrame, group: str, source: str, order: list[Column], each: int, most: int) -> DataFrame:
    """At most `each` rows a source and `most` a group, best first."""
    return top_per_group(top_per_group(df, [group, source], order, each), [group], order, most)


def daily(df: DataFrame, at: str, first: str, last: str) -> DataFrame:
    """Rows a day from first to last, with days that have none."""
    days = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    counts = df.groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("n"))
    return days.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def upserted(old: DataFrame, new: DataFrame, key: str, fill: list[str], order: str) -> DataFrame:
    """Rows by key: the stored one or else the first to arrive, with nulls in `fill` taken from later rows in order of arrival."""
    both = old.select("*", F.lit(0).alias("_new")).unionByName(new.select("*", F.lit(1).alias("_new")))
    at = F.struct("_new", order)
    rest = [c for c in old.columns if c != key]
    picked = [F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) if c in fill else F.min_by(c, at).alias(c) for c in rest]
    return both.groupBy(key).agg(*picked).select(old.columns)
