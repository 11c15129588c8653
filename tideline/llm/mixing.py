"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

The mix has a given number of words (that of all documents, if none is given).
Each source's share is proportional to its weight, but no source is taken more
often than `epochs` times: water-filling clamps the sources whose share is above
that, deals what they can't take among the others by weight, and goes on until no
share is above. A round is one aggregation over the table of sources; the driver
sees its sums alone, never the sources. Levels are exact fractions.

A source with target t and size s is repeated t div s times as a whole. What is
left of t goes to documents in the order of a seeded hash, until it is used up;
the document at the cut is taken in part, so that every source's words are its
target to the nearest word. The cut is found on sums of 1024 ranges of the hash, then
twice of 1024 ranges inside the range found, then on the few rows that are left: no
task sorts or holds a source.

Words are maximal runs of other than ASCII white space. Null texts are empty and
have size 0; documents without words, and sources without, take nothing. The null
source is a source like others. Rows that repeat a doc_id are documents of their
own; rows with the same hash and size at the cut take equal parts, rounded down
(so a source may miss its target by as many words as there are such rows). An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tideline.llm.common import fresh, numbered, saved, text_of

EPOCHS, SEED, CYCLE = 3, 17, 3
WORD = r"[^\x20\x09-\x0D]+"
#: A hash has 60 bits; ranges of it at each level are what is left after so many are shifted out.
LEVELS = (50, 40, 30)


def size_of(text: str = "text") -> Column:
    """The number of words of a text."""
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def order_of(seed: int, doc_id: str = "doc_id") -> Column:
    """A document's place in its source's order: 60 bits of a hash of seed and doc_id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size and place of every document."""
    return docs.select("doc_id", "source", size_of().alias("size"), order_of(seed).alias("place"))


def sources(sizes: DataFrame) -> DataFrame:
    """source, source_size (its words)."""
    return sizes.groupBy("source").agg(F.sum("size").alias("source_size"))


def cyclic(found: DataFrame, cycle: int = CYCLE) -> DataFrame:
    """Sources with the weights 1, 2 ... cycle, again and again, by code point, null last."""
    named = numbered(found.withColumn("last", F.col("source").isNull()), ["last", "source"], "at")
    return named.select("source", "source_size", (F.col("at") % cycle + 1).alias("weight"))


def targets(weighted: DataFrame, epochs: int = EPOCHS, total: int | None = None) -> DataFrame:
    """source, source_size, weight, target (double) of sources with whole weights of at least 0.

    A mix that is larger than all sources may give takes all of them `epochs` times;
    a source of weight 0 gives nothing.
    """
    if epochs < 1 or epochs != int(epochs):
        raise ValueError("epochs is a whole number of at least 1")
    cap, big = F.col("source_size") * int(epochs), "decimal(38,0)"
    table = saved(weighted.select("source", "source_size", F.col("weight").cast("long").alias("weight")), "sources")
    all_words = table.agg(F.sum("source_size")).first()[0] or 0
    left, weights, clamped = Decimal(all_words if total is None else total), None, -1

    def above() -> Column:
        """Whether a source's share at the present level is more than it may give."""
        if weights is None:
            return F.lit(False)
        if not weights:
            return F.col("weight") > 0
        return cap.cast("decimal(19,0)") * F.lit(weights).cast("decimal(19,0)") < F.col("weight").cast("decimal(19,0)") * F.lit(left).cast("decimal(19,0)")

    while True:
        over = above()
        row = table.agg(F.count_if(over), F.sum(F.when(over, cap)).cast(big), F.sum(F.when(~over, F.col("weight"))).cast(big)).first()
        if row[0] == clamped:
            break
        clamped = row[0]
        left = max(Decimal(all_words if total is None else total) - (row[1] or 0), Decimal(0))
        weights = row[2] or Decimal(0)
    level = F.col("weight").cast("decimal(19,0)") * F.lit(left).cast("decimal(19,0)")
    share = level.cast("double") / F.lit(float(weights) or 1.0)
    return table.withColumn("target", F.when(above(), cap.cast("double")).otherwise(share))


def cuts(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted with whole (repetitions of all its documents) and of what is left: cut_place, cut_size, part.

    Documents before (cut_place, cut_size) are taken once more, those there with `part` words.
    """
    aim = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(0)
    plan = saved(wanted.withColumn("whole", whole.cast("long")).withColumn("left", aim - F.col("whole") * F.col("source_size")), "mix-plan")
    open_ = plan.where("left > 0").select(F.col("source").alias("own"), F.col("left").alias("rest"), F.lit(0).cast("long").alias("range"))
    upper = 60
    for shift in LEVELS:
        inside = sizes.join(open_, sizes.source.eqNullSafe(F.col("own")) & (F.shiftright("place", upper) == F.col("range"))) if upper < 60 else sizes.join(open_, sizes.source.eqNullSafe(F.col("own")))
        sums = inside.groupBy("own", F.shiftright("place", shift).alias("next")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
        upto = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("own").orderBy("next")))
        open_ = saved(upto.where("upto - words <= rest and upto > rest").select("own", (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"), F.col("next").alias("range")), "mix-range")
        upper = shift
    inside = sizes.join(open_, sizes.source.eqNullSafe(F.col("own")) & (F.shiftright("place", upper) == F.col("range"))).where("size > 0")
    rows = inside.groupBy("own", "place", "size").agg(F.count("*").alias("rows"), F.first("rest").alias("rest"))
    upto = rows.withColumn("words", F.col("rows") * F.col("size")).withColumn("upto", F.sum("words").over(Window.partitionBy("own").orderBy("place", "size")))
    last = upto.where("upto - words <= rest and upto > rest").select("own", F.col("place").alias("cut_place"), F.col("size").alias("cut_size"), F.expr("(rest - upto + words) div rows").alias("part"))
    return plan.join(last, plan.source.eqNullSafe(F.col("own")), "left").drop("own", "left")


def taken(size: Column, place: Column) -> Column:
    """The words of a document that the mix takes, beside its source's cut."""
    more = F.when((place < F.col("cut_place")) | (place == F.col("cut_place")) & (size < F.col("cut_size")), size)
    more = more.when((place == F.col("cut_place")) & (size == F.col("cut_size")), F.col("part")).otherwise(0)
    return F.col("whole") * size + F.when(F.col("cut_place").isNull(), 0).otherwise(more)


def mixed(docs: DataFrame, weighted: DataFrame | None = None, epochs: int = EPOCHS, total: int | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target (of its source) and taken (words that the mix takes, repeats counted) of every document.

    `weighted` has source, source_size and weight; without it weights go round by code point.
    """
    sizes = saved(sized(docs, seed), "mix-sizes")
    wanted = targets(cyclic(sources(sizes)) if weighted is None else weighted, epochs, total)
    plan = saved(cuts(sizes, wanted).withColumnRenamed("source", "own"), "mix-cuts")
    found = sizes.join(plan, sizes.source.eqNullSafe(F.col("own")))
    return found.select("doc_id", "source", "size", "source_size", "target", taken(F.col("size"), F.col("place")).cast("long").alias("taken"))


def repeated(docs: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: rows of docs as often as they are taken, with a column for the number of the copy from 0.

    `plan` is cuts()' result. A copy in part holds the document's first words, joined by spaces.
    """
    copy, size, place, words = (fresh(docs, c) for c in ("copy", "mix_size", "mix_place", "mix_words"))
    own = plan.select([F.col(c).alias(c if c in ("whole", "cut_place", "cut_size", "part") else f"mix_{c}") for c in plan.columns])
    clash = [c for c in ("whole", "cut_place", "cut_size", "part") if fresh(docs, c) != c]
    if clash:
        raise ValueError(f"rename the columns {clash} first")
    placed = docs.withColumns({size: size_of(), place: order_of(seed)})
    found = placed.join(own, docs["source"].eqNullSafe(own["mix_source"])).withColumn(words, taken(F.col(size), F.col(place)))
    copies = found.where(F.col(words) > 0).withColumn(copy, F.explode(F.expr(f"sequence(0, cast(ceil({words} / {size}) as int) - 1)")))
    rest = F.col(words) - F.col(copy) * F.col(size)
    short = F.array_join(F.slice(F.regexp_extract_all(text_of(), F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.greatest(rest, F.lit(0)).cast("int")), " ")
    return copies.withColumn("text", F.when(rest < F.col(size), short).otherwise(F.col("text"))).select(*docs.columns, copy)
