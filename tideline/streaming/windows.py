"""Watermarked windows, sessions and deduplication; each works on batch and streaming DataFrames alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def stream(spark: SparkSession, path: str, at: str | None = None, files: int = 4) -> DataFrame:
    """A file stream of a Parquet folder or file, with event times (if it has some) that watermarks accept."""
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    folder, _, name = path.rstrip("/").rpartition("/")
    rows = source.option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn(at, F.col(at).cast("timestamp")) if at else rows


def counted(df: DataFrame, at: str, by: list[str], width: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Rows by window and group."""
    return df.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(df: DataFrame, at: str, by: list[str], gap: str, late: str = "1 day") -> DataFrame:
    """Runs of rows with no gap of that length: closed by silence."""
    return df.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at")).drop("w")


def once(df: DataFrame, at: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def sliding(df: DataFrame, at: str, by: list[str], width: str = "12 hours", step: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Rows by overlapping windows and group."""
    return df.withWatermark(at, late).groupBy(F.window(at, width, step).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def followed(left: DataFrame, right: DataFrame, key: str, at: str, within: str, late: str = "1 day") -> DataFrame:
    """Rows of two streams (or tables) with the same key, the right one at most `within` after the left one; right columns get r_ before their names."""
    r = right.select(*[F.col(c).alias("r_" + c) for c in right.columns]).withWatermark("r_" + at, late)
    return left.withWatermark(at, late).join(r, (F.col(key) == F.col("r_" + key)) & (F.col("r_" + at) > F.col(at)) & (F.col("r_" + at) <= F.col(at) + F.expr(f"INTERVAL {within}")))


def albums(df: DataFrame, at: str, group: str, part: str, text: str, quiet: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """Messages of one album (group) that come without a longer pause: its parts in order, its first text."""
    rows = df.withWatermark(at, late).groupBy(F.session_window(at, quiet).alias("w"), group)
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct(at, part))), lambda x: x[part]).alias("parts"), F.min_by(text, F.when(F.col(text) != "", F.col(at))).alias("text")).drop("w")


def drained(df: DataFrame, keys: list[str] | None = None, base: str | None = None) -> DataFrame:
    """All that is available now, run as a stream and read back from Parquet in the shared folder.

    With keys (an aggregation) each batch writes the rows that it changes, and
    the last state of a key is read; without, the rows of all batches. A batch
    writes a folder of its own number, so one that runs again after a failure
    replaces what it wrote. With `base`, a folder, a stream goes on where it ended.
    """
    import uuid

    from tideline.tables import folder

    spark, base = df.sparkSession, base or f"{folder(df.sparkSession)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/_batch={number}")

    put(spark.createDataFrame([], df.schema), -1)
    out = df.writeStream.outputMode("update" if keys else "append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    out.foreachBatch(put).start().awaitTermination()
    rows = spark.read.schema(StructType([*df.schema, StructField("_batch", IntegerType())])).parquet(f"{base}/rows")
    if not keys:
        return rows.drop("_batch")
    rest = [c for c in df.columns if c not in keys]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "_batch").alias(c) for c in rest]).select(df.columns)
