"""The library's functions by name in SQL."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tideline.functions import vectors as V


@F.pandas_udf(StringType())
def strip_html(texts: pd.Series) -> pd.Series:
    """Marked-up text as plain text."""
    from tideline.sources import markup

    return texts.map(lambda t: None if t is None else markup.stripped(t))


@F.arrow_udf(ArrayType(DoubleType()))
def vec_avg(vectors: pa.Array) -> list:
    """The mean of vectors of one length, null ones left out; a group is one call, so for large groups mean_vector() is the way."""
    import numpy as np

    found = [v for v in vectors.to_pylist() if v is not None]
    return np.mean(np.array(found, np.float64), axis=0).tolist() if found else None


class PageLinks:
    """page_links(TABLE(pages)): the columns of a table but for html, with place, href and anchor of each link of html, in order."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or "html" not in table.dataType.fieldNames():
            raise ValueError("page_links takes a table with a column html")
        out = StructType([f for f in table.dataType.fields if f.name != "html"])
        return AnalyzeResult(out.add("place", IntegerType()).add("href", StringType()).add("anchor", StringType()))

    def eval(self, row: Row) -> Iterator[tuple]:
        from tideline.sources import markup

        kept = [row[c] for c in row.__fields__ if c != "html"]
        for i, a in enumerate(markup.tree(row["html"]).all(lambda n: n.tag == "a" and "href" in n.attrs)):
            yield (*kept, i, a.attrs["href"], markup.squeezed(a.text()))


class CronSlots:
    """cron_slots(expression, zone, start, end): the fires of a schedule after start and until end, as seconds since 1970."""

    def eval(self, expression: str, zone: str, start: int, end: int) -> Iterator[tuple[int]]:
        from tideline.operators.schedules import walked

        for at in walked(expression, zone, datetime.fromtimestamp(start, timezone.utc), datetime.fromtimestamp(end, timezone.utc)):
            yield (int(at.timestamp()),)


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to a session's SQL: minhash_sig, hash_embed and strip_html of texts, the aggregate vec_avg, and the table functions page_links and cron_slots."""
    for name, f in (("minhash_sig", V.minhash), ("hash_embed", V.hash_embedding), ("strip_html", strip_html), ("vec_avg", vec_avg)):
        spark.udf.register(name, f)
    spark.udtf.register("page_links", F.udtf(PageLinks))
    spark.udtf.register("cron_slots", F.udtf(CronSlots, returnType="at bigint"))
    return ["minhash_sig", "hash_embed", "strip_html", "vec_avg", "page_links", "cron_slots"]
