"""Line dedup by an exact set-similarity join, on DataFrame functions alone.

A line is the set of its lower-case words between white space. A line goes if
an earlier one (smaller doc_id, or same document and smaller line number) has a
Jaccard likeness of 4/5 or more with it; likenesses are judged on the input.

Words are ordered by rarity: all words of all lines are counted in BUCKETS
buckets of their hashes, and a word's number starts with the level of its bucket.
The first line of each set of words stands for its equals. Of the others, a
similar pair shares a word of both prefixes, and the first such word leaves
enough words behind it in both (positional filter, which holds the shorter one
to its index prefix); sizes must fit; and the words that only one of the lines
has must show in the exclusive or of their bitmaps. What is left is verified on
64-bit hashes of the words, cut from the lines again.

Pairs inside a group of similar lines are not all made: a line is first held
against the earliest line that has two neighbours of its chosen words, and only lines without a match there look for one by their prefixes, among all
earlier lines. A very frequent prefix word is a skewed join key, which Spark
splits; equal lines never meet in one key, as they are told apart from first
lines by their place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import fresh, saved
from tideline.llm.common import removed as deleted

#: Buckets of word counts, as rows of ROW; a table of eight bytes each at any size of input.
BUCKETS, ROW = 1 << 20, 1 << 10
#: Bits of a word's number below its level.
LEVEL = 57
#: Sets of fewer words reach 4/5 only when they are equal; four words inside five reach it.
LEAST_WORDS = 4
#: Sets of so many words have a bitmap for each quarter of them: one of 64 bits is full and tells nothing.
LONG = 64
#: Lines (document and number) that may be broadcast; more of them are joined by a shuffle.
SMALL = 1 << 19
SPACE = " \t\r\x0b\f"


def _trimmed(line: Column) -> Column:
    """line without white space at its ends; few lines have some."""
    ends = [test(line, F.lit(c)) for c in SPACE for test in (F.startswith, F.endswith)]
    return F.when(reduce(Column.__or__, ends), F.trim(line, F.lit(SPACE))).otherwise(line)


def _words(line: Column) -> Column:
    """The words of a trimmed line; most lines have single blanks only, which are found without a pattern."""
    odd = [F.contains(line, F.lit(c)) for c in (*SPACE.replace(" ", ""), "  ")]
    return F.split(F.when(reduce(Column.__or__, odd), F.regexp_replace(line, f"[{SPACE}]+", " ")).otherwise(line), " ")


def _bucket(h: Column) -> Column:
    """The first bits of a hash."""
    return F.shiftrightunsigned(h, 65 - BUCKETS.bit_length()).cast("int")


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id and text of the rows that have both."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.where("doc_id is not null and text is not null")


def _lines(texts: DataFrame, lower: bool = True) -> DataFrame:
    """doc_id, line_no and line (trimmed) of lines with words."""
    text = F.lower("text") if lower else F.col("text")
    cut = texts.select("doc_id", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return cut.select("doc_id", "line_no", _trimmed(F.col("line")).alias("line")).where("line <> ''")


def _levels(texts: DataFrame) -> DataFrame:
    """One row: for each bucket what turns the first seven bits of its hashes into its level, which rises by three while the count doubles twice."""
    text, odd = F.col("text"), reduce(Column.__or__, [F.contains("text", F.lit(c)) for c in SPACE.replace(" ", "")])
    flat = F.when(odd, F.regexp_replace(text, f"[\n{SPACE}]+", " ")).otherwise(F.replace(text, F.lit("\n"), F.lit(" ")))
    words = texts.select(F.lower("text").alias("text")).select(F.explode(F.split(flat, " ")).alias("word"))
    counted = words.select(_bucket(F.xxhash64("word")).alias("bucket"), F.lit(1).cast("long").alias("times"))
    every = texts.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("times"))
    total = counted.unionAll(every).groupBy("bucket").agg(F.greatest(F.sum("times"), F.lit(1)).alias("times"))
    level = F.least(F.floor(1.5 * F.log2("times")), F.lit(62)).bitwiseXOR(F.shiftright("bucket", BUCKETS.bit_length() - 1 - (64 - LEVEL)))
    level = total.select("bucket", F.shiftleft(level, LEVEL).alias("level"))
    rows = level.groupBy(F.floor(F.col("bucket") / ROW).alias("row")).agg(F.sort_array(F.collect_list(F.struct("bucket", "level"))).alias("found"))
    rows = rows.select("row", F.col("found.level").alias("levels"))
    return rows.groupBy().agg(F.sort_array(F.collect_list(F.struct("row", "levels"))).alias("rows")).select(F.flatten("rows.levels").alias("levels"))


def _sets(texts: DataFrame) -> DataFrame:
    """doc_id, line_no and the words' numbers w, rarest first, of lines with words."""
    # levels are named once, so that Spark takes them into the lambda: as a column each row would have a copy
    lines = _lines(texts).select("doc_id", "line_no", _words(F.col("line")).alias("words")).withColumn("levels", _levels(texts).scalar())

    def number(h: Column) -> Column:
        return h.bitwiseXOR(F.coalesce(F.get("levels", _bucket(h)), F.lit(0).cast("long")))  # never null, so that plain longs are sorted

    # numbers, not hashes, are made distinct: what stands inside transform() is interpreted
    numbers = F.transform(F.transform("words", lambda x: F.xxhash64(x)), number)
    return lines.select("doc_id", "line_no", F.sort_array(F.array_distinct(numbers)).alias("w"))


def _needed(n: Column, m: Column) -> Column:
    """Common words of sets of n and m words that reach 4/5."""
    return F.ceil(4 * (n + m) / 9)


def _firsts(texts: DataFrame) -> DataFrame:
    """doc_id, line_no of the first line with each set of words, its size n, bitmap (and of three quarters, if it is long), prefix and keys."""
    sets = _sets(texts).select("doc_id", "line_no", "w", F.size("w").alias("n"))
    bit = lambda seen, x: seen.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int")))
    n, large = F.col("n"), F.col("n") >= LEAST_WORDS
    quarter = lambda q: F.aggregate(F.filter("w", lambda x: x.bitwiseAND(F.lit(192)) == 64 * q), F.lit(0).cast("long"), bit)
    # of n words about four to eight are chosen by their own hashes; neighbours among them are keys
    sets = sets.withColumn("mask", F.shiftright(F.pow(F.lit(2), F.floor(F.log2("n"))).cast("long"), 2) - 1)
    # named twice, the mask stays a column; named in the filter alone, Spark takes the logarithm there for every word
    sets = sets.withColumn("chosen", F.when(F.col("mask") >= 0, F.filter("w", lambda x: x.bitwiseAND(F.col("mask")) == 0)))
    places = F.when(F.size("chosen") > 1, F.sequence(F.lit(0), F.size("chosen") - 2))
    sets = sets.select(
        "doc_id", "line_no", "n", F.xxhash64("w").alias("a"), F.xxhash64(F.lit(1), "w").alias("b"),
        F.when(large, F.aggregate("w", F.lit(0).cast("long"), bit)).alias("bits"),
        F.when(n >= LONG, F.array(*[quarter(q) for q in range(3)])).alias("quarters"),
        F.when(large, F.slice("w", F.lit(1), n - F.ceil(4 * n / 5).cast("int") + 1)).alias("prefix"),
        F.transform(places, lambda i: F.xxhash64(F.get("chosen", i), F.get("chosen", i + 1))).alias("keys"),
    )
    found = sets.groupBy("a", "b").agg(F.min(F.struct("doc_id", "line_no")).alias("at"), F.first(F.struct("n", "bits", "quarters", "prefix", "keys")).alias("of"))
    return found.select("at.*", "of.*")


def _fits(x: str, y: str) -> Column:
    """Sizes and bitmaps of x and y allow for 4/5; sizes may be negative (see _pairs)."""
    n, m = F.abs(F.col(f"{x}.n")), F.abs(F.col(f"{y}.n"))
    differ = F.bit_count(F.col(f"{x}.bits").bitwiseXOR(F.col(f"{y}.bits")))
    return (5 * n >= 4 * m) & (5 * m >= 4 * n) & (9 * differ <= n + m)


def _fits_long(x: str, y: str) -> Column:
    """The bitmaps of all quarters allow for 4/5; the last one is what the others leave of the whole."""
    parts = [F.col(f"{x}.{q}").bitwiseXOR(F.col(f"{y}.{q}")) for q in ("q0", "q1", "q2")]
    parts.append(reduce(Column.bitwiseXOR, parts, F.col(f"{x}.bits").bitwiseXOR(F.col(f"{y}.bits"))))
    return F.coalesce(9 * sum(map(F.bit_count, parts)) <= F.abs(F.col(f"{x}.n")) + F.abs(F.col(f"{y}.n")), F.lit(True))


def _later(x: str, y: str) -> Column:
    return (F.col(f"{x}.doc_id") > F.col(f"{y}.doc_id")) | ((F.col(f"{x}.doc_id") == F.col(f"{y}.doc_id")) & (F.col(f"{x}.line_no") > F.col(f"{y}.line_no")))


def _ids(x: str, y: str) -> list[Column]:
    return [F.col(f"{x}.doc_id").alias("doc_id"), F.col(f"{x}.line_no").alias("line_no"), F.col(f"{y}.doc_id").alias("y_doc"), F.col(f"{y}.line_no").alias("y_line")]


def _leading(firsts: DataFrame) -> DataFrame:
    """Pairs of a line and the earliest line with one of its keys."""
    keyed = firsts.select("doc_id", "line_no", "n", "bits", F.explode("keys").alias("key"))
    leads = keyed.groupBy("key").agg(F.min(F.struct("doc_id", "line_no", "n", "bits")).alias("y"), F.count("*").alias("times"))
    both = keyed.alias("x").join(leads.where("times > 1").select("key", "y.*").alias("y"), "key")
    return both.where(_later("x", "y") & _fits("x", "y")).select(*_ids("x", "y")).distinct()


def _pairs(firsts: DataFrame, settled: DataFrame) -> DataFrame:
    """Pairs of a line that is not settled and an earlier line that pass all filters.

    Sizes of settled lines are negative: the conditions then speak of both
    sides, and one exchange of the rows serves both.
    """
    marked = firsts.where(F.size("prefix") > 0).join(settled.withColumn("settled", F.lit(True)), ["doc_id", "line_no"], "left")
    n = F.when(F.col("settled"), -F.col("n")).otherwise(F.col("n"))
    quarters = [F.get("quarters", F.lit(q)).alias(f"q{q}") for q in range(3)]
    posts = marked.select("doc_id", "line_no", n.alias("n"), "bits", *quarters, F.posexplode("prefix").alias("pos", "word"))
    x, y = posts.alias("x"), posts.alias("y")
    n, m = F.col("x.n"), F.abs(F.col("y.n"))
    enough = F.least(n - F.col("x.pos"), m - F.col("y.pos")) >= _needed(n, m)
    both = x.join(y, (F.col("x.word") == F.col("y.word")) & _later("x", "y") & (5 * n >= 4 * m) & enough & _fits("x", "y") & _fits_long("x", "y"))
    return both.select(*_ids("x", "y")).distinct()


def _few(rows: DataFrame) -> DataFrame:
    """rows (a written table of document and line number), to be broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def _sketch(words: str) -> Column:
    """Four bitmaps, each of a quarter of the words: as bits of _firsts, for long lines."""

    def quarter(q: int) -> Column:
        bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(x, 2).bitwiseAND(F.lit(63)).cast("int"))
        return F.aggregate(F.filter(words, lambda x: x.bitwiseAND(F.lit(3)) == q), F.lit(0).cast("long"), lambda seen, x: seen.bitwiseXOR(bit(x)))

    return F.struct(F.size(words).alias("n"), *[quarter(q).alias(f"q{q}") for q in range(4)])


def _matched(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, line_no of the later lines of pairs (written) that reach 4/5."""
    line, other = ["doc_id", "line_no"], ["y_doc", "y_line"]
    wanted = saved(pairs.select(*line).unionAll(pairs.select(*other)).distinct(), "line-wanted")
    cut = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).join(_few(wanted), line, "left_semi")
    trimmed = cut.select(*line, _trimmed(F.lower("line")).alias("line"))
    words = trimmed.select(*line, F.array_distinct(F.transform(_words(F.col("line")), lambda x: F.xxhash64(x))).alias("x"))
    held = saved(words.withColumn("s", _sketch("x")), "line-words")
    # most pairs of long lines end at their sketches; words are shuffled for the others only
    x, y = held.select(*line, "s"), held.select(F.col("doc_id").alias("y_doc"), F.col("line_no").alias("y_line"), F.col("s").alias("t"))
    differ = sum(F.bit_count(F.col(f"s.q{q}").bitwiseXOR(F.col(f"t.q{q}"))) for q in range(4))
    close = saved(pairs.join(x, line).join(y, other).where(9 * differ <= F.col("s.n") + F.col("t.n")).select(*line, *other), "line-close")
    rest = saved(close.select(*line).unionAll(close.select(*other)).distinct(), "line-wanted")
    x = held.join(_few(rest), line, "left_semi").select(*line, "x")
    y = x.select(F.col("doc_id").alias("y_doc"), F.col("line_no").alias("y_line"), F.col("x").alias("y"))
    both = close.join(x, line).join(y, other)
    found = saved(both.where(F.size(F.array_intersect("x", "y")) >= _needed(F.size("x"), F.size("y"))).select(*line).distinct(), "line-settled")
    for table in (wanted, held, close, rest):
        deleted(texts.sparkSession, table)
    return found


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, exact (whether an earlier line has the same words) of the lines to remove.

    Empty lines and lines of white space stay; null texts have no lines; rows
    with a null doc_id are left alone; an empty table gives no rows; other columns
    are not read. Of rows that repeat a doc_id, lines of one number count as one:
    they are listed unless one of them is the first of its words and without match.
    """
    texts, line = _texts(docs), ["doc_id", "line_no"]
    spark = docs.sparkSession
    firsts = saved(_firsts(texts), "line-firsts")
    leading = saved(_leading(firsts), "line-pairs")
    soon = _matched(leading, texts)
    deleted(spark, leading)
    pairs = saved(_pairs(firsts, _few(soon)), "line-pairs")
    near = soon.unionAll(_matched(pairs, texts)).distinct().withColumn("exact", F.lit(False))
    deleted(spark, pairs)
    exact = _lines(texts, lower=False).select(*line).join(firsts.select(*line), line, "left_anti").distinct().withColumn("exact", F.lit(True))
    return exact.unionAll(near)


def clean(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, without the lines to remove.

    Documents without lines left stay, empty; a null text or doc_id stays as it is,
    rows that repeat a doc_id lose the same line numbers, an empty table stays
    empty; n_chars, if there, follows the text; other columns may have any names.
    """
    gone, lines = fresh(docs, "gone"), fresh(docs, "lines")
    found = removed(docs).groupBy("doc_id").agg(F.collect_set("line_no").alias(gone))
    cut = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.split(F.col("text").cast("string"), "\n").alias(lines))
    joined = cut.join(found, "doc_id", "left")
    # the lines are split below the join, so that one is found by its number at once
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i))
    text = F.array_join(F.when(F.col(gone).isNull() | F.col(lines).isNull(), F.col(lines)).otherwise(kept), "\n")
    out = {"text": text} | ({"n_chars": F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length(text))} if "n_chars" in docs.columns else {})
    return joined.select(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
