"""Posts made of sentences that are there, their review, and what may be published by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import text as T

# fixed values: likeness of sentences that say the same, marks a sentence may carry, sentences of a post
SAME, MARKS, SENTENCES = 0.6, 3, 4
# fixed values: limits of the review
LEAST_CHARS, LEAST_COVERAGE, LEAST_INTEREST, SHORT_NOTE = 80, 0.5, 3.0, 800
#: Reasons that stop a post even where everything is published.
BLOCKING = ["no title", "no text", "short text", "no sources", "note without its article", "other language", "low interest", "list mismatch"]


def merged(sentences: Column, most: int = SENTENCES, same: float = SAME, marks: int = MARKS) -> Column:
    """Of (n, sentence) in order the first `most` that differ, as an array of (text, nums, words).

    A sentence whose words are `same` or more alike to one that is kept adds its
    number to the first such (`marks` numbers at most, each once) and is not kept
    itself; later ones too, when no more are kept. Sentences without words are
    passed over. Not more than `most` sentences are held at any time.
    """
    kind = "array<struct<text:string,nums:array<int>,words:array<string>>>"

    def step(kept: Column, x: Column) -> Column:
        words = F.array_distinct(T.words(x["sentence"]))
        hit = F.array_position(F.transform(kept, lambda k: T.jaccard(k["words"], words) >= same), True)
        number = x["n"].cast("int")
        marked = lambda k: F.when(F.array_contains(k["nums"], number) | (F.size(k["nums"]) >= marks), k["nums"]).otherwise(F.concat(k["nums"], F.array(number)))
        added = F.transform(kept, lambda k, i: F.struct(k["text"].alias("text"), F.when(i + 1 == hit, marked(k)).otherwise(k["nums"]).alias("nums"), k["words"].alias("words")))
        more = F.concat(kept, F.array(F.struct(x["sentence"].alias("text"), F.array(number).alias("nums"), words.alias("words"))))
        out = F.when(F.size(words) == 0, kept).when(hit > 0, added).when(F.size(kept) < most, more).otherwise(kept)
        return out.cast(kind)

    return F.aggregate(sentences, F.array().cast(kind), step)


def extractive(blocks: DataFrame, limit: int, most: int = SENTENCES) -> DataFrame:
    """story, body: leading sentences of a story's blocks with the marks of all that say the same, cut to `limit` characters.

    blocks: story, n, picked (sentences). Stories have a few blocks of a few
    sentences, so a story is one row.
    """
    gathered = blocks.groupBy("story").agg(F.array_sort(F.collect_list(F.struct("n", "picked"))).alias("b"))
    flat = F.flatten(F.transform("b", lambda b: F.transform(b["picked"], lambda s: F.struct(b["n"].alias("n"), s.alias("sentence")))))
    line = lambda k: F.concat(k["text"], F.lit(" "), F.array_join(F.transform(k["nums"], lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), ""))
    return gathered.select("story", T.truncated(F.array_join(F.transform(merged(flat, most), line), " "), limit).alias("body"))


def content_format(mode: Column, kinds: Column, longread: Column | None = None) -> Column:
    """What a post is about: news; of curated stories video, article or post by the first of these kinds that they have; a single long read is an article."""
    found = F.when(mode != "curated", "news")
    for kind in ("video", "article", "post"):
        found = found.when(F.array_contains(kinds, kind), kind)
    found = found.otherwise("article")
    return found if longread is None else F.when((found == "news") & longread, "article").otherwise(found)


def writer(mode: Column, can_write: Column, translate: Column, sources: Column, fmt: Column) -> Column:
    """llm or extractive: who writes a post. Without a model nobody can; a text in another language must be written anew; else the mode decides, in auto
    mode for all that is no news and for stories of two sources and more."""
    by_mode = F.when(mode == "extractive", "extractive").when((mode == "llm") | (fmt != "news") | (sources >= 2), "llm").otherwise("extractive")
    return F.when(~can_write, "extractive").when(translate, "llm").otherwise(by_mode)


def review(title: Column, body: Column, citations: Column, checks: Column, limit: Column, other_language: Column, kind: Column, fmt: Column, interest: Column, mismatch: Column) -> Column:
    """The reasons against publishing a post by itself, in a fixed order; none if it passes.

    citations: array of (article_status, length); checks: invalid_citations,
    citation_coverage, length (citation_check()). Null texts are empty; a null
    interest is none, a null mismatch none.
    """
    text = T.stripped(F.coalesce(body, F.lit("")))
    none = F.coalesce(F.size(citations), F.lit(0)) <= 0
    failed = F.exists(citations, lambda c: (c["article_status"] == "failed") & (F.coalesce(c["length"], F.lit(SHORT_NOTE)) < SHORT_NOTE))
    found = [
        (T.stripped(F.coalesce(title, F.lit(""))) == "", "no title"),
        (text == "", "no text"),
        ((text != "") & (F.length(text) < LEAST_CHARS), "short text"),
        (none, "no sources"),
        ((F.size(citations) == 1) & failed, "note without its article"),
        ((text != "") & other_language, "other language"),
        (F.size(checks["invalid_citations"]) > 0, "invalid citations"),
        ((fmt == "news") & (F.coalesce(checks["citation_coverage"], F.lit(0.0)) < LEAST_COVERAGE), "low coverage"),
        ((kind == "post") & (F.coalesce(checks["length"], F.lit(0)) > limit), "too long"),
        (mismatch.isNotNull(), "list mismatch"),
        (interest < LEAST_INTEREST, "low interest"),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in found]))


def may_publish(reasons: Column, mode: Column) -> Column:
    """Whether a post goes out by itself: without reasons always, else only where everything is published and no reason is a blocking one."""
    stops = F.exists(reasons, lambda r: r.isin(BLOCKING))
    return (F.size(reasons) == 0) | ((mode == "full_auto") & ~stops)
