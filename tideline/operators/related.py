"""Earlier posts that a new post continues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import vectors as V

# fixed values: likeness with two rare names, with one, with any; names of so many posts (share and number) are common
TWO, ONE, ANY, SHARE, LEAST = 0.62, 0.66, 0.70, 0.05, 3


def related(posts: DataFrame, days: int = 14) -> DataFrame:
    """post_id, related_id, reason, similarity: the earlier post of the same project that a post continues.

    posts: project, post_id, sent_at, cluster_ids, names, link, origin, vector.
    A shared story makes an update (the newest such post); else the same link or
    origin counts as 1, and likeness with shared names by itself, of which the
    best and then the newest is taken. Names are rare by the posts of the same
    `days` before. Candidates meet by equality of story, link, origin or name.
    """
    at = F.unix_seconds(F.col("sent_at"))
    before = Window.partitionBy("project").orderBy("_at").rangeBetween(-86400 * days, -1)
    mine = posts.withColumn("_at", at).withColumn("_n", F.count("*").over(before))
    new = mine.select("project", "post_id", "_at", "_n", "cluster_ids", "names", "link", "origin", "vector")
    old = new.select("project", *[F.col(c).alias("o_" + c) for c in ("post_id", "_at", "cluster_ids", "names", "link", "origin", "vector")])
    time = (F.col("o__at") < F.col("_at")) & (F.col("o__at") >= F.col("_at") - 86400 * days)

    def meet(a: DataFrame, b: DataFrame) -> DataFrame:
        """Pairs of a key and time; posts meet in their own bucket of `days` and in the next, so that no pair of other times is made."""
        bucket = lambda c: F.floor(F.col(c) / (86400 * days))
        later, earlier = a.withColumn("_b", bucket("_at")), b.withColumn("_b", F.explode(F.array(bucket("o__at"), bucket("o__at") + 1)))
        return later.join(earlier, ["project", "k", "_b"]).where(time).select("project", "post_id", "o_post_id", "k")

    keyed = lambda kind: (new.select("project", "post_id", "_at", F.explode(kind).alias("k")), old.select("project", "o_post_id", "o__at", F.explode("o_" + kind).alias("k")))
    same = lambda kind: (new.where(f"{kind} <> ''").select("project", "post_id", "_at", F.col(kind).alias("k")), old.where(f"o_{kind} <> ''").select("project", "o_post_id", "o__at", F.col("o_" + kind).alias("k")))
    named = meet(*keyed("names"))
    shared = named.groupBy("project", "post_id", "k").agg(F.count("*").alias("f"))
    counts = named.join(shared, ["project", "post_id", "k"]).join(new.select("project", "post_id", "_n"), ["project", "post_id"])
    by_name = counts.groupBy("project", "post_id", "o_post_id").agg(F.count("*").alias("shared"), F.count_if(F.col("f") < F.greatest(F.lit(LEAST), F.lit(SHARE) * F.col("_n"))).alias("rare"))
    pairs = by_name.select("project", "post_id", "o_post_id", "shared", "rare", F.lit(0).alias("rank"))
    for kind, rank in ((keyed("cluster_ids"), 3), (same("link"), 2), (same("origin"), 1)):
        pairs = pairs.unionByName(meet(*kind).select("project", "post_id", "o_post_id", F.lit(0).cast("long").alias("shared"), F.lit(0).cast("long").alias("rare"), F.lit(rank).alias("rank")))
    best = pairs.groupBy("project", "post_id", "o_post_id").agg(F.max("rank").alias("rank"), F.max("shared").alias("shared"), F.max("rare").alias("rare"))
    best = best.join(new.select("project", "post_id", "vector"), ["project", "post_id"]).join(old.select("project", "o_post_id", "o__at", "o_vector"), ["project", "o_post_id"])
    s = V.cosine("vector", "o_vector")
    best = best.withColumn("s", F.when(F.col("rank") > 0, 1.0).otherwise(s))
    linked = (F.col("rank") > 0) | ((F.col("rare") >= 2) & (F.col("s") >= TWO)) | ((F.col("rare") >= 1) & (F.col("s") >= ONE)) | ((F.col("shared") >= 1) & (F.col("s") >= ANY))
    reason = F.when(F.col("rank") == 3, "update").when(F.col("rank") == 2, "link").when(F.col("rank") == 1, "origin").otherwise("similar")
    first = F.struct((F.col("rank") == 3).alias("u"), F.when(F.col("rank") == 3, 1.0).otherwise(F.col("s")).alias("s"), "o__at", "o_post_id")
    found = best.where(linked).groupBy("post_id").agg(F.max_by(F.struct(F.col("o_post_id").alias("related_id"), reason.alias("reason"), F.round("s", 3).alias("similarity")), first).alias("r"))
    return found.select("post_id", "r.*")
