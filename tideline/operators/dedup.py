"""Lexical duplicates by MinHash: candidates that share a key, verified, resolved greedily in order."""

from __future__ import annotations

from itertools import combinations, pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.vectors import PERMUTATIONS, signature, signature_likeness

LIKENESS = 0.82
#: Groups of the places of a signature, and parts of a group that make a key.
GROUPS, MORE = 4, 3
#: Parts in which the copies of one signature look for their originals.
PARTS = 16


def signatures(items: DataFrame, key: str, text: str) -> DataFrame:
    """key, sig of whole texts."""
    return items.select(F.col(key), signature(text).alias("sig"))


def part_keys(sig: Column, apart: int) -> Column:
    """Keys of a signature of which two that differ in `apart` places at most always share one.

    Of GROUPS groups of places one has no more than its share of the differing places,
    so of its parts, MORE than those places, MORE at least are equal: a key is MORE parts of one group.
    """
    n, parts = PERMUTATIONS // GROUPS, apart // GROUPS + MORE
    cuts = [n * i // parts for i in range(parts + 1)]
    made = F.array(*[F.xxhash64(F.slice(sig, g * n + a + 1, b - a)) for g in range(GROUPS) for a, b in pairwise(cuts)])
    chosen = [(g, c) for g in range(GROUPS) for c in combinations(range(parts), MORE)]
    return F.transform(F.array(made), lambda m: F.array(*[F.xxhash64(F.lit(i), *[F.get(m, F.lit(g * parts + j)) for j in c]) for i, (g, c) in enumerate(chosen)]))[0]


def _bits(sig: Column, at: int) -> Column:
    """One bit of each place of a signature as a number."""
    return F.aggregate(sig, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.shiftright(x, at).bitwiseAND(F.lit(1).cast("long"))))


def candidate_pairs(sigs: DataFrame, key: str, least: float = LIKENESS) -> DataFrame:
    """later, earlier, likeness of all pairs that reach `least`, between the first items of equal signatures.

    Other items of a signature are copies: each has one row of likeness 1 to the first of them, whose links
    are its links too; resolved() sees to that, so copies aren't expanded into pairs.

    Pairs meet in keys that are longer than a band and that none of them can miss. Where they meet two bits of
    each place are compared, so of pairs that are not alike hardly any leaves its task.
    """
    apart = int(PERMUTATIONS * (1 - least) + 1e-9)
    if apart // GROUPS + MORE > PERMUTATIONS // GROUPS:
        raise ValueError(f"no keys for a likeness of {least}")
    sig = F.col("sig")
    classes = sigs.where(F.exists("sig", lambda x: x != 0)).groupBy("sig").agg(F.min(key).alias("first"))
    members = sigs.join(classes, "sig").select(F.col(key), "first")
    equal = members.where(F.col(key) != F.col("first")).select(F.col(key).alias("later"), F.col("first").alias("earlier"), F.lit(1.0).alias("likeness"))
    keyed = classes.select("first", F.explode(part_keys(sig, apart)).alias("key"), _bits(sig, 0).alias("x"), _bits(sig, 1).alias("y"))
    a, b = keyed.withColumnRenamed("first", "later").alias("a"), keyed.withColumnRenamed("first", "earlier").alias("b")
    other = F.bit_count(F.col("a.x").bitwiseXOR(F.col("b.x")).bitwiseOR(F.col("a.y").bitwiseXOR(F.col("b.y"))))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("later") > F.col("earlier")) & (other <= apart)).select("later", "earlier").distinct()
    sa, sb = classes.select(F.col("first").alias("later"), F.col("sig").alias("sa")), classes.select(F.col("first").alias("earlier"), F.col("sig").alias("sb"))
    near = pairs.join(sa, "later").join(sb, "earlier").withColumn("likeness", signature_likeness("sa", "sb")).where(F.col("likeness") >= least)
    return equal.unionByName(near.select("later", "earlier", "likeness"))


def resolved(pairs: DataFrame) -> DataFrame:
    """later, earlier: duplicates and their originals, as if items were taken in order. A duplicate makes no duplicates.

    Which items are duplicates comes first: an item is one as soon as one of its
    earlier partners is known to be an original, and an original once all of them are known to be
    duplicates. So a round settles a whole group of near copies, however large; only
    chains, in which each is near to the one before it alone, take a round a link. When all are known, one join gives each duplicate the most alike
    original among its partners (of equally alike ones the first). A round writes
    what is still open and deletes what it replaces.

    A pair of likeness 1 joins a copy to the first item of its kind. Copies have the links of that item, so they are
    duplicates in any case and take no part in the rounds: duplicates of it where it is an original, else of the
    most alike original before them, which may come after that item.
    """
    from tideline.tables import dropped, written

    pairs = pairs if pairs.inputFiles() else written(pairs, "pairs")
    copies, alike = pairs.where("likeness <=> 1"), pairs.where("not likeness <=> 1")
    links = alike.select("later", "earlier")
    items = links.select(F.col("later").alias("item"), F.lit(True).alias("has")).unionAll(links.select(F.col("earlier").alias("item"), F.lit(False)))
    # who is later than nobody is an original
    known = written(items.groupBy("item").agg(F.bool_or("has").alias("has")).where("not has").select("item", F.lit(True).alias("original")), "known")
    found, rest = known, written(links, "open")
    tables = [known]
    while not rest.isEmpty():
        near = rest.join(found.select(F.col("item").alias("earlier"), "original"), "earlier", "left")
        state = near.groupBy("later").agg(F.bool_or("original").alias("any"), F.bool_and(F.coalesce(~F.col("original"), F.lit(False))).alias("none"))
        found = written(state.where("any or none").select(F.col("later").alias("item"), F.col("none").alias("original")), "known")
        tables.append(found)
        # links to a known duplicate are done with, as are all links of a settled item
        gone = found.select(F.col("item").alias("later"))
        now = rest.join(gone, "later", "left_anti").join(near.where("not original").select("later", "earlier"), ["later", "earlier"], "left_anti")
        after = written(now, "open")
        dropped(rest)
        rest = after
    status = tables[0]
    for table in tables[1:]:
        status = status.unionByName(table)
    status = written(status, "status")
    for table in tables:
        dropped(table)
    originals = status.where("original").select(F.col("item").alias("other"))
    # an item near an original is a duplicate; of the originals near it only the first of each likeness can be chosen, by it or by a copy
    sides = alike.select(F.col("later").alias("first"), F.col("earlier").alias("other"), "likeness").unionAll(alike.select("earlier", "later", "likeness"))
    firsts = sides.join(originals, "other").groupBy("first", "likeness").agg(F.max(-F.col("other")).alias("back"))
    choices = written(firsts.groupBy("first").agg(F.collect_list(F.struct("likeness", "back")).alias("choices")), "choices")
    copied = choices.join(copies.select(F.col("earlier").alias("first")).distinct(), "first", "left_semi").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    members = copies.select("later", F.col("earlier").alias("first"), F.pmod(F.xxhash64("later"), F.lit(PARTS)).cast("int").alias("part"))
    waiting = choices.select(F.col("first").alias("later"), "first", "choices").unionAll(members.join(copied, ["first", "part"], "left").select("later", "first", "choices"))
    chosen = F.array_max(F.filter("choices", lambda c: c["back"] > -F.col("later")))
    own = F.struct(F.lit(1.0).alias("likeness"), (-F.col("first")).alias("back"))
    return waiting.groupBy("later").agg(F.max(F.coalesce(chosen, own)).alias("best")).select("later", (-F.col("best.back")).alias("earlier"))


def duplicates(items: DataFrame, key: str, text: str, least: float = LIKENESS) -> DataFrame:
    """later, earlier of lexical duplicates; signatures and pairs are computed once and written."""
    from tideline.tables import written

    sigs = written(signatures(items, key, text), "signatures")
    return resolved(written(candidate_pairs(sigs, key, least), "pairs"))


def attached(items: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """items with dup_of, and the cluster_id of their originals where they are duplicates without one."""
    of = found.select(F.col("later").alias(key), F.col("earlier").alias("dup_of"))
    parents = items.select(F.col(key).alias("dup_of"), F.col("cluster_id").alias("_cluster"))
    return items.drop("dup_of").join(of, key, "left").join(parents, "dup_of", "left").withColumn("cluster_id", F.coalesce("cluster_id", "_cluster")).drop("_cluster")
