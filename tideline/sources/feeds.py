"""Labelled and bulk files as item rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fewest labelled rows that an evaluation takes.
LEAST_ROWS = 10


def separator(spark: SparkSession, path: str) -> str:
    """The separator that the first line has most of, a comma if it has none."""
    head = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    line = head[0].value if head else ""
    return max(",;\t|", key=line.count)


def labelled(spark: SparkSession, path: str, kind: str = "json", sep: str | None = None, least: int = LEAST_ROWS) -> DataFrame:
    """Labelled rows of JSON lines or separated values; hours may have a decimal comma, rows without label are left out.

    Without sep the first line tells it; a byte order mark is no part of the
    first name; fewer than `least` labelled rows are an error.
    """
    if kind == "json":
        raw = spark.read.json(path)
    else:
        raw = spark.read.option("header", True).option("sep", sep or separator(spark, path)).option("multiLine", True).option("escape", '"').csv(path)
        raw = raw.toDF(*[c.removeprefix("\ufeff") for c in raw.columns])
    hours = F.regexp_replace(F.col("hours_ago").cast("string"), ",", ".").try_cast("double")
    rows = raw.where(F.coalesce(F.trim("gold"), F.lit("")) != "").withColumn("hours_ago", hours)
    if least and rows.limit(least).count() < least:
        raise ValueError(f"fewer than {least} labelled rows in {path}")
    return rows


def sources_of(rows: DataFrame) -> DataFrame:
    """source, authority (of its first row, by `pos`; 0.5 without one) and items of bulk rows; rows without a source are one."""
    name = F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("manual"))
    return rows.groupBy(name.alias("source")).agg(F.coalesce(F.min_by("authority", "pos"), F.lit(0.5)).alias("authority"), F.count("*").alias("items"))


def imported(rows: DataFrame, now: str) -> DataFrame:
    """Bulk rows with published_at filled from hours_ago."""
    at = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("hours_ago") * 3600)
    return rows.withColumn("published_at", F.coalesce(F.col("published_at").cast("timestamp"), at)) if "published_at" in rows.columns else rows.withColumn("published_at", at)
