"""What the corpus operators share: the shared scratch folder, text columns and Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a new local one if Spark runs in this process alone, else an error."""
    found = spark.sparkContext.getConf().get(CHECKPOINT_DIR) or spark.conf.get(CHECKPOINT_DIR, None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set(CHECKPOINT_DIR, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage is cut and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table that saved() wrote and nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with a further long column `name`: 0, 1, 2 ... in the order of the given columns (nulls first; equal rows in any order).

    Rows are dealt by ranges and numbered inside each; ranges are moved by the
    counts of those before, a row for each partition. df is evaluated twice (ranges
    are sampled), so it should be cheap to read.
    """
    placed = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(name, 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    before = sizes.select(F.col("part").alias(name + "_part"), (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias(name + "_base"))
    moved = placed.withColumn(name + "_part", part).join(F.broadcast(before), name + "_part")
    return moved.select(*df.columns, (F.col(name).bitwiseAND((1 << 33) - 1) + F.col(name + "_base")).alias(name))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: What a worker process keeps from task to task: one thing at a time, as workers are shared by operators.
_KEPT: dict = {}


def kept(key: tuple, make: Callable):
    """make(), kept in this worker until another key is asked for."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """Forget what this worker keeps: tasks that hold memory of their own begin with it."""
    _KEPT.clear()


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of a slice hold about `most` bytes (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype("int64"))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, base + most, side="right")))
            yield batch.slice(at, end - at)
            at = end
