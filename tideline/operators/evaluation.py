"""How well predicted groups match given ones, from the contingency table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scores(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    """One row: n, B-cubed precision, recall and f1, nmi, ari. Only counts of groups are shuffled."""
    cells = df.groupBy(F.col(predicted).alias("p"), F.col(gold).alias("g")).agg(F.count("*").cast("double").alias("c"))
    p = cells.groupBy("p").agg(F.sum("c").alias("np"))
    g = cells.groupBy("g").agg(F.sum("c").alias("ng"))
    full = cells.join(p, "p").join(g, "g")
    n = F.sum("c")
    pairs = lambda x: x * (x - 1) / 2
    over = full.agg(n.alias("n"), (F.sum(F.col("c") ** 2 / F.col("np")) / n).alias("precision"), (F.sum(F.col("c") ** 2 / F.col("ng")) / n).alias("recall"), F.sum(F.col("c") * F.log(F.col("c") / (F.col("np") * F.col("ng")))).alias("mi"), F.sum(pairs(F.col("c"))).alias("together"))
    of_p = p.agg(F.sum(F.col("np") * F.log("np")).alias("hp"), F.sum(pairs(F.col("np"))).alias("pp"))
    of_g = g.agg(F.sum(F.col("ng") * F.log("ng")).alias("hg"), F.sum(pairs(F.col("ng"))).alias("pg"))
    one = over.join(of_p, F.lit(True)).join(of_g, F.lit(True))  # three single rows
    total = pairs(F.col("n"))
    mi = F.col("mi") / F.col("n") + F.log("n")
    entropy = (F.log("n") - F.col("hp") / F.col("n") + F.log("n") - F.col("hg") / F.col("n")) / 2
    chance = F.coalesce(F.try_divide(F.col("pp") * F.col("pg"), total), F.lit(0.0))
    spread = (F.col("pp") + F.col("pg")) / 2 - chance
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
    return one.select("n", "precision", "recall", f1.alias("f1"), F.when(entropy > 1e-12, mi / entropy).otherwise(1.0).alias("nmi"), F.when(F.abs(spread) > 1e-12, (F.col("together") - chance) / spread).otherwise(1.0).alias("ari"))


def scores_by(df: DataFrame, by: list[str], predicted: str, gold: str) -> DataFrame:
    """scores() of each group, with the number of predicted clusters."""
    cells = df.groupBy(*by, F.col(predicted).alias("p"), F.col(gold).alias("g")).agg(F.count("*").cast("double").alias("c"))
    p, g = (cells.groupBy(*by, k).agg(F.sum("c").alias("n" + k)) for k in "pg")
    full = cells.join(p, [*by, "p"]).join(g, [*by, "g"])
    pairs = lambda x: x * (x - 1) / 2
    c, n = F.col("c"), F.sum("c")
    over = full.groupBy(*by).agg(n.alias("n"), (F.sum(c**2 / F.col("np")) / n).alias("precision"), (F.sum(c**2 / F.col("ng")) / n).alias("recall"), F.sum(c * F.log(c / (F.col("np") * F.col("ng")))).alias("mi"), F.sum(pairs(c)).alias("together"))
    of_p = p.groupBy(*by).agg(F.sum(F.col("np") * F.log("np")).alias("hp"), F.sum(pairs(F.col("np"))).alias("pp"), F.count("*").alias("clusters"))
    of_g = g.groupBy(*by).agg(F.sum(F.col("ng") * F.log("ng")).alias("hg"), F.sum(pairs(F.col("ng"))).alias("pg"))
    one = over.join(of_p, by).join(of_g, by)
    mi = F.col("mi") / F.col("n") + F.log("n")
    entropy = (2 * F.log("n") - (F.col("hp") + F.col("hg")) / F.col("n")) / 2
    chance = F.coalesce(F.try_divide(F.col("pp") * F.col("pg"), pairs(F.col("n"))), F.lit(0.0))
    spread = (F.col("pp") + F.col("pg")) / 2 - chance
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
    nmi = F.when(entropy > 1e-12, mi / entropy).otherwise(1.0)
    return one.select(*by, F.col("n").cast("long").alias("n"), "clusters", "precision", "recall", f1.alias("f1"), nmi.alias("nmi"), F.when(F.abs(spread) > 1e-12, (F.col("together") - chance) / spread).otherwise(1.0).alias("ari"))
