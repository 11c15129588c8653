"""Exports: tables of values for people, labelling files, messages for receivers, dumps without vectors."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType


def csv_with_mark(df: DataFrame, path: str) -> None:
    """CSV files with a header that starts with a byte order mark, for spreadsheets; a file for each partition."""
    first, *rest = df.columns
    df.withColumnRenamed(first, "\ufeff" + first).write.option("header", True).mode("overwrite").csv(path)


def labelling(items: DataFrame, clusters: DataFrame, now, chars: int = 1200) -> DataFrame:
    """gold (empty), title, text, source, hours_ago, current_cluster, id of the items to label."""
    ago = F.round((F.unix_micros(now) - F.unix_micros("published_at")) / 3.6e9, 1)
    rows = items.join(clusters.select("cluster_id", F.col("title").alias("current_cluster")), "cluster_id", "left")
    return rows.select(F.lit("").alias("gold"), "title", F.substring("text", 1, chars).alias("text"), "source", ago.alias("hours_ago"), "current_cluster", "id")


def messages(posts: DataFrame, key: str, secret: str) -> DataFrame:
    """payload (JSON of all columns), idempotency_key and signature (HMAC-SHA256 of the payload) of each post."""

    @F.pandas_udf("string")
    def signed(payload: pd.Series) -> pd.Series:
        return payload.map(lambda p: hmac.new(secret.encode(), p.encode(), hashlib.sha256).hexdigest())

    rows = posts.select(F.sha2(F.concat_ws(":", F.lit("post"), F.col(key).cast("string")), 256).alias("idempotency_key"), F.to_json(F.struct(*posts.columns)).alias("payload"))
    return rows.withColumn("signature", signed("payload"))


def without_vectors(df: DataFrame) -> DataFrame:
    """A table whose vectors are null, as dumps keep it."""
    vectors = [f.name for f in df.schema if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, (FloatType, DoubleType))]
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in vectors}) if vectors else df


def appended(df: DataFrame, path: str) -> None:
    """Rows added to an audit log, a folder of Parquet files."""
    df.write.mode("append").parquet(path)


def report(scores: DataFrame, path: str) -> None:
    """Scores as JSON lines."""
    scores.write.mode("overwrite").json(path)
