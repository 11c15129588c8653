"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.tables import dropped, written


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node that it reaches) of all nodes of links (u, v: long); a link to oneself gives a node without others.

    In each round a node takes the least label of its neighbours, and then the
    label of that label, so labels travel twice as far each time. Rounds are
    written; what a round replaces is deleted. Links with a null are left out.
    """
    rows = links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u is not null and v is not null")
    both = written(rows.unionAll(rows.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    now = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("component")), "labels")
    while True:
        near = both.join(now, both.v == now.node).groupBy("u").agg(F.min("component").alias("near"))
        hooked = now.join(near, now.node == near.u).select("node", "component", F.least("component", "near").alias("next"))
        far = now.select(F.col("node").alias("next"), F.col("component").alias("beyond"))
        after = written(hooked.join(far, "next").select("node", F.least("next", "beyond").alias("component"), F.col("component").alias("before")), "labels")
        dropped(now)
        now = after.select("node", "component")
        if after.where("component <> before").isEmpty():
            break
    return now
