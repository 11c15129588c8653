"""Average-linkage clusters, the baseline that online clusters are compared with, and the choice of a threshold."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import vectors as V
from tideline.operators import clustering, evaluation, graphs
from tideline.tables import written

#: Vectors of a block (two blocks meet in a task), and vectors of a component that one task clusters.
BLOCK, MOST = 1024, 1500


def merges(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """The number of each unit vector's cluster: the two most alike clusters (by their mean likeness) become one, as long as that is `threshold` or more.

    Clusters are joined along a chain of nearest neighbours, which gives the same
    tree as joining the best pair each time; means follow from the sizes of both parts.
    """
    n = len(vectors)
    alike = vectors @ vectors.T
    np.fill_diagonal(alike, -np.inf)
    size, up, live, chain = np.ones(n), np.arange(n), np.ones(n, bool), []
    for _ in range(n - 1):
        if not chain:
            chain = [int(live.argmax())]
        while True:
            a = chain[-1]
            b = int(alike[a].argmax())
            if len(chain) > 1 and alike[a, chain[-2]] >= alike[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        best = alike[a, b]
        chain = chain[:-2]
        a, b = min(a, b), max(a, b)
        if best >= threshold:
            up[b] = a
        mean = (size[a] * alike[a] + size[b] * alike[b]) / (size[a] + size[b])
        alike[a], alike[:, a] = mean, mean
        alike[b], alike[:, b], alike[a, a] = -np.inf, -np.inf, -np.inf
        size[a] += size[b]
        live[b] = False  # a join below the threshold only serves the chains of others
    for i in range(n):
        up[i] = up[up[i]]
    return up


def links(units: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """u, v of vectors (group, key, unit) of the same group that are connected by likenesses of `threshold` or more.

    A group's vectors are dealt to blocks, and a task has two blocks at a time; of
    what it finds it gives a star for each connected part, never all pairs.
    """
    counts = units.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = units.join(counts, "group").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    dealt = rows.select("group", "key", "unit", F.explode(pair).alias("cell"))

    def stars(cell: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(cell["unit"].to_list())
        near = x @ x.T >= threshold
        label = np.arange(len(x))
        while True:
            low = np.where(near, label[None, :], len(x)).min(axis=1)
            low = np.minimum(low, label)
            low = low[low]
            if (low == label).all():
                break
            label = low
        keys = cell["key"].to_numpy()
        return pd.DataFrame({"u": keys, "v": keys[label]})

    return dealt.groupBy("group", "cell").applyInPandas(stars, "u long, v long").distinct()


def average_linkage(items: DataFrame, group: str, key: str, vector: str, threshold: float, most: int = MOST) -> DataFrame:
    """group, key (long), cluster (its least key), component_size of every item.

    Clusters that are joined hold a pair of that likeness, so each lies inside a
    component of the graph of such pairs, and components are clustered by themselves. Those of
    more than `most` items aren't cut or left out: their cluster is null. Zero
    vectors are alike to nothing; items without a vector are left out.
    """
    size = F.sqrt(V.dot(vector, vector))
    units = items.where(F.col(vector).isNotNull()).select(F.col(group).alias("group"), F.col(key).cast("long").alias("key"), F.transform(vector, lambda x: x.cast("double") / F.greatest(size, F.lit(1e-12))).alias("unit"))
    units = written(units, "units")
    found = graphs.components(written(links(units, threshold), "linked"))
    rows = units.join(found.withColumnRenamed("node", "key"), "key")
    sizes = found.groupBy("component").agg(F.count("*").alias("component_size"))
    rows = written(rows.join(sizes, "component"), "components")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key")
        up = merges(np.stack(part["unit"].to_list()), threshold)
        keys = part["key"].to_numpy()
        return pd.DataFrame({"group": part["group"], "key": keys, "cluster": keys[up], "component_size": part["component_size"]})

    kind = dict(rows.dtypes)["group"]
    small = rows.where(F.col("component_size") <= most).groupBy("component").applyInPandas(run, f"group {kind}, key long, cluster long, component_size long")
    large = rows.where(F.col("component_size") > most).select("group", "key", F.lit(None).cast("long").alias("cluster"), "component_size")
    return small.unionByName(large).select(F.col("group").alias(group), F.col("key").alias(key), "cluster", "component_size")


def sweep(items: DataFrame, key: str, vector: str, at: str, gold: str, window: float, thresholds: list[float], nearest: float = 0.7) -> DataFrame:
    """threshold, part (dev, test, all), n, clusters, precision, recall, f1, nmi, ari, chosen: single-pass clusters under each threshold against given groups.

    Items are halved by a hash of their key. The chosen threshold has the best f1
    (of four digits) on dev, of equals the one nearest to `nearest`. All runs are
    one pass: a threshold and part is the group of the clustering.
    """
    half = F.when(F.substring(F.md5(F.col(key).cast("string")), 1, 1) < "8", "dev").otherwise("test")
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("x")
    rows = items.select(F.col(key).alias("k"), F.col(vector).alias("v"), F.col(at).alias("t"), F.col(gold).alias("gold"), F.explode(F.array(half, F.lit("all"))).alias("part"))
    rows = written(rows.select("*", grid).withColumn("run", F.concat_ws("|", F.col("x").cast("string"), "part")), "sweep")
    found = clustering.single_pass(rows, "run", "k", "v", "t", window, "x").join(rows.select("run", "k", "gold", "x", "part"), ["run", "k"])
    scored = evaluation.scores_by(found.withColumnRenamed("x", "threshold"), ["threshold", "part"], "cluster", "gold")
    scored = written(scored.select("threshold", "part", "n", "clusters", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1", "nmi", "ari")]), "scores")
    best = scored.where("part = 'dev'").agg(F.max_by("threshold", F.struct("f1", -F.abs(F.col("threshold") - nearest))).alias("best"))
    return scored.join(best).withColumn("chosen", F.coalesce(F.col("threshold") == F.col("best"), F.lit(False))).drop("best")
