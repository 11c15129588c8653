"""Connected components by large-star and small-star rounds over a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import removed, saved


class Union:
    """Union-find with the smallest member as root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = p
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def stars(self) -> tuple[list[int], list[int]]:
        pairs = [(x, r) for x in self.up if (r := self.root(x)) != x]
        return [x for x, _ in pairs], [r for _, r in pairs]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars of what they connect: the same components with fewer edges."""
    for batch in batches:
        union = Union()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            union.link(a, b)
        u, v = union.stars()
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node that it reaches) for every node of an edge (u, v: long).

    Edges of a node with itself, and with a null, are left out; repeated and
    turned edges change nothing; other columns are not read; no edges give no rows.
    """
    spark = edges.sparkSession
    now = saved(edges.select("u", "v").where("u <> v").mapInArrow(_contracted, "u long, v long").distinct(), "edges")
    mark = None
    while True:
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        floor = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(floor, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(floor.select("u", F.col("m").alias("v"))).distinct()
        after = saved(small, "edges")
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        removed(spark, now)
        now = after
        if seen == mark:
            break
        mark = seen
    roots = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
