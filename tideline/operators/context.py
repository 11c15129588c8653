"""What of a story's items is shown to a writer: sentences chosen within a budget of characters, in the order of the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.functions import vectors as V
from tideline.operators.rollup import capped
from tideline.operators.stories import context_cap

# fixed values: sentences kept and looked at for items read like an article, for one news item, for several; sizes of long reads
ARTICLE, SINGLE, SEVERAL_SCAN = (24, 120), (12, 40), 14
LONG, LONG_BUDGET, HEAD_SHARE = 6000, 12000, 0.25
SKIPPED = "… "


def sizes(sentences: Column) -> Column:
    """Characters that each sentence takes, with the space behind it."""
    return F.transform(sentences, lambda s: F.length(s) + 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def fitting(values: Column, room: Column) -> Column:
    """How many values from the start sum up to `room` at most."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("double").alias("sum"), F.lit(True).alias("open"))
    step = lambda a, x: F.struct((a["n"] + (a["open"] & (a["sum"] + x <= room)).cast("int")).alias("n"), (a["sum"] + x).cast("double").alias("sum"), (a["open"] & (a["sum"] + x <= room)).alias("open"))
    return F.aggregate(values, start, step, lambda a: a["n"])


def spread(rows: DataFrame, sentences: str, out: str = "picked", budget: int = LONG_BUDGET, share: float = HEAD_SHARE) -> DataFrame:
    """rows with the sentences of a long text within a budget of characters, in an array column `out`.

    All of them if they fit; else those from the start that take a share of the
    budget at most, and sentences at even distances from the rest, each after a gap
    marked as such, up to the first that is too long for what is left. No
    sentences (or null) give an empty array.
    """
    s = F.coalesce(F.col(sentences), F.array().cast("array<string>"))
    rows = rows.withColumn("_s", s).withColumn("_size", sizes(F.col("_s"))).withColumn("_all", total(F.col("_size")))
    rows = rows.withColumn("_head", fitting(F.col("_size"), F.lit(budget * share)))
    rows = rows.withColumn("_used", total(F.slice("_size", F.lit(1), F.col("_head")))).withColumn("_rest", F.size("_s") - F.col("_head"))
    mean = (F.col("_all") - F.col("_used")) / F.greatest(F.col("_rest"), F.lit(1))
    rows = rows.withColumn("_n", F.greatest(F.lit(1), F.floor((F.lit(budget) - F.col("_used")) / (mean + len(SKIPPED))).cast("int")))
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.floor(i.cast("long") * F.col("_rest") / F.col("_n")).cast("int")))
    rows = rows.withColumn("_at", F.when(F.col("_rest") > 0, places).otherwise(F.array().cast("array<int>")))
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get("_at", i - 1))
    sampled = F.transform("_at", lambda at, i: F.concat(F.when(at == before(i) + 1, F.lit("")).otherwise(F.lit(SKIPPED)), F.get("_s", F.col("_head") + at)))
    rows = rows.withColumn("_more", sampled)
    kept = F.slice("_more", F.lit(1), fitting(sizes(F.col("_more")), (F.lit(budget) - F.col("_used")).cast("double")))
    picked = F.when(F.col("_all") <= budget, F.col("_s")).otherwise(F.concat(F.slice("_s", F.lit(1), F.col("_head")), kept))
    return rows.withColumn(out, picked).drop("_s", "_size", "_all", "_head", "_used", "_rest", "_n", "_at", "_more")


def lead_and_nearest(sentences: Column, likeness: Column, k: Column) -> Column:
    """The first sentence and the k - 1 of the others that are most alike (of equals the later), in their order; all if there are k at most.

    likeness is an array with a number for each sentence.
    """
    others = F.transform(F.sequence(F.lit(1), F.greatest(F.size(sentences) - 1, F.lit(1))), lambda i: F.struct((-F.get(likeness, i)).alias("far"), (-i).alias("at")))
    best = F.transform(F.slice(F.array_sort(others), F.lit(1), F.greatest(k - 1, F.lit(0))), lambda x: -x["at"])
    chosen = F.concat(F.slice(sentences, 1, 1), F.transform(F.array_sort(best), lambda i: F.get(sentences, i)))
    return F.when(F.size(sentences) <= k, sentences).otherwise(chosen)


def hashed_likeness(sentences: Column, centroid: Column) -> Column:
    """The cosine of each sentence's hashed words to a centroid of 256 places."""
    return V.sentence_likeness(sentences, centroid)


def blocks(items: DataFrame, most: int = 6, sentences: int = 3, each: int = 2, likeness=hashed_likeness) -> DataFrame:
    """story, n (from 1), item_id, source, title, picked (sentences), longread of the items that a writer gets.

    items: story, item_id, source, title, text, centroid, relevance, mode. At most
    `most` items a story, two of a source, by relevance and then item_id. A story of
    one item of 6000 characters is read as a whole (spread()). Of others the lead and the
    sentences nearest to the centroid are kept: of the first 120 24 where items are curated or the title
    promises a list, of the first 40 12 at least for a single item, else `sentences` of
    14; an item's text has 7000 characters, shared by the items, but 300 at least. A text
    without sentences is replaced by its title; a null centroid counts all sentences
    as equally alike.
    """
    chosen = capped(items, "story", "source", [F.col("relevance").desc(), F.col("item_id")], each, most)
    number = chosen.groupBy("story").agg(F.array_sort(F.collect_list(F.struct((-F.col("relevance")).alias("r"), "item_id"))).alias("_order"))
    rows = chosen.join(number, "story").withColumns({"_items": F.size("_order"), "n": F.array_position(F.transform("_order", lambda x: x["item_id"]), F.col("item_id")).cast("int")})
    text = F.coalesce(F.col("text"), F.lit(""))
    single = F.col("_items") == 1
    rows = rows.withColumn("longread", single & (F.length(text) >= LONG))
    curated = (F.col("mode") == "curated") | T.promised_count("title").isNotNull()
    k = F.when(curated, ARTICLE[0]).when(single, max(sentences, SINGLE[0])).otherwise(max(1, sentences))
    scan = F.when(curated, ARTICLE[1]).when(single, SINGLE[1]).otherwise(SEVERAL_SCAN)
    rows = rows.withColumn("_whole", T.sentences(text)).withColumn("_whole", F.when(F.size("_whole") == 0, F.array("title")).otherwise(F.col("_whole")))
    rows = rows.withColumns({"_k": k, "_seen": F.when(F.col("longread"), F.slice("_whole", 1, 0)).otherwise(F.slice("_whole", F.lit(1), scan))})
    rows = rows.withColumn("_near", likeness(F.col("_seen"), F.col("centroid")))
    joined = F.array_join(lead_and_nearest(F.col("_seen"), F.col("_near"), F.col("_k")), " ")
    rows = rows.withColumn("_short", T.truncated(joined, context_cap(F.col("_items")).cast("int")))
    rows = spread(rows.withColumn("_long", F.when(F.col("longread"), F.col("_whole"))), "_long", "_spread")
    again = T.sentences("_short")
    picked = F.when(F.col("longread"), F.col("_spread")).when(F.size(again) > 0, again).otherwise(F.array("_short"))
    return rows.select("story", "n", "item_id", "source", "title", picked.alias("picked"), "longread")
