"""Posts for places with a limit of characters: marked-up text that is shortened whole, and slides."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import text as T

# fixed values: characters of a slide, slides of a video, characters of its caption, of a post and of a picture's caption
SLIDE, SLIDES, CAPTION, POST, PICTURE = 230, 5, 2200, 3900, 1024
# fixed values: marks of sources, signatures, lines of sources, pictographs, sentence ends
MARK, SIGNATURE, SOURCES = r"\s*\[\d+\]", r"^\s*@\w{4,}\s*$", r"(?iu)^\s*(?:источники|sources)\s*:"
PICTOGRAPHS = "[\U0001f000-\U0001faff☀-➿⬀-⯿️‍⃣\U000e0000-\U000e007f]"
END = r"(?<=[.!?…])\s+"
_PARTS = re.compile(r"\[([^\[\]\n]{1,200})\]\((https?://[^\s()<>]+)\)|\*\*(?=\S)([^*\n]{1,300}?)(?<=\S)\*\*|(\s+)|([^\s\[*]+|.)")


def shortened(text: str, room: int, tags: bool) -> str:
    """A marked-up text as HTML of at most `room` characters (with its tags, or as a reader counts), cut between words.

    What is left of a link or of bold words when they are cut stands inside tags that are
    closed: every opened tag is on a stack, and its end is counted before anything is
    put inside. A cut text ends with an ellipsis.
    """
    pieces: list[tuple[str, str, str]] = []  # opening tag, words, closing tag
    size = lambda start, words, end: len(html.escape(words)) + len(start) + len(end) if tags else len(words)
    whole = 0
    for m in _PARTS.finditer(text):
        if m[1]:
            pieces.append((f'<a href="{html.escape(m[2])}">', m[1], "</a>"))
        elif m[3]:
            pieces.append(("<b>", m[3], "</b>"))
        else:
            pieces.append(("", m[0], ""))
        whole += size(*pieces[-1])
        if whole > room:  # what follows has no room
            break
    if whole <= room:
        return "".join(a + html.escape(w) + b for a, w, b in pieces)
    out, used, room = [], 0, room - 1  # the ellipsis
    for start, words, end in pieces:
        if used + size(start, words, end) <= room:
            out.append(start + html.escape(words) + end)
            used += size(start, words, end)
            continue
        kept = ""
        if start:
            for word in re.findall(r"\S+\s*", words):
                if used + size(start, (kept + word).rstrip(), end) > room:
                    break
                kept += word
        if kept.strip():
            out.append(start + html.escape(kept.rstrip()) + end)
        break
    return "".join(out).rstrip() + "…"


def _fit(tags: bool):
    @F.arrow_udf("string")
    def fit(texts: pa.Array, rooms: pa.Array) -> pa.Array:
        # one text at a time leaves the batch, and what is made of them is short
        return pa.array((shortened(t.as_py() or "", r.as_py(), tags) for t, r in zip(texts, rooms, strict=True)), pa.string())

    return fit


def post_html(title: Column, body: Column, footer: Column, limit: int = POST) -> Column:
    """A post as HTML within a limit that tags count for: bold title, body without marks and its own list of sources, footer (HTML)."""
    head, text, foot = _parts(title, body, footer)
    room = F.greatest(F.lit(limit) - F.length(head) - F.length(foot), F.lit(200))
    return F.concat(head, _fit(True)(text, room), foot)


def picture_caption(title: Column, body: Column, footer: Column, limit: int = PICTURE) -> Column:
    """The same below a picture, within a limit of characters that a reader sees."""
    head, text, foot = _parts(title, body, footer)
    seen = F.length(F.regexp_replace(F.concat(head, foot), "<[^>]*>", ""))
    return F.concat(head, _fit(False)(text, F.greatest(F.lit(limit) - seen, F.lit(100))), foot)


def _parts(title: Column, body: Column, footer: Column) -> tuple[Column, Column, Column]:
    clean = T.without_citations(F.coalesce(title, F.lit("")))
    return F.when(clean == "", "").otherwise(F.concat(F.lit("<b>"), T.escaped(clean), F.lit("</b>\n\n"))), T.without_citations(T.without_footer(body)), F.coalesce(footer, F.lit(""))


def wall_post(title: Column, body: Column, names: Column, urls: Column, signature: Column) -> Column:
    """A post without any format: title, body, sources (arrays of names and addresses; those that have both) and signature, with an empty line between."""
    cited = F.filter(F.arrays_zip(names.alias("n"), urls.alias("u")), lambda x: (F.coalesce(x["n"], F.lit("")) != "") & (F.coalesce(x["u"], F.lit("")) != ""))
    lines = F.array_join(F.transform(cited, lambda x: F.concat(F.lit("• "), x["n"], F.lit(": "), x["u"])), "\n")
    sources = F.when(F.size(cited) > 0, F.concat(F.lit("Sources:\n"), lines))
    some = lambda x: F.when(T.stripped(x) != "", T.stripped(x))
    return F.concat_ws("\n\n", some(F.coalesce(title, F.lit(""))), T.stripped(T.plain(T.without_citations(T.without_footer(body)))), sources, some(T.plain(F.coalesce(signature, F.lit("")))))


def _bare(text: Column) -> Column:
    return T.stripped(F.regexp_replace(F.regexp_replace(text, PICTOGRAPHS, ""), "[ \t]{2,}", " "))


def chunks(paragraph: Column, limit: int = SLIDE) -> Column:
    """A paragraph in parts of at most `limit` characters, cut at sentence ends; a longer sentence is cut between words, a longer word as it is."""
    words = lambda s: F.split(F.regexp_replace(s, rf"(\S{{{limit}}})(?=\S)", "$1 "), r"\s+")
    units = F.flatten(F.transform(F.split(paragraph, END), lambda s: F.when(F.length(s) > limit, words(s)).otherwise(F.array(s))))
    kind = "struct<done:array<string>,now:string>"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now")).cast(kind)

    def step(a: Column, unit: Column) -> Column:
        full = (a["now"] != "") & (F.length(a["now"]) + 1 + F.length(unit) > limit)
        now = F.when(full, unit).otherwise(F.trim(F.concat(a["now"], F.lit(" "), unit)))
        return F.struct(F.when(full, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]).alias("done"), now.alias("now")).cast(kind)

    packed = F.aggregate(units, start, step, lambda a: F.when(a["now"] != "", F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]))
    return F.when(F.length(paragraph) <= limit, F.array(paragraph)).otherwise(packed)


def scripts(df: DataFrame, text: str, out: str, channel: str, hashtags: str = "", label: str = "More and links on Telegram") -> DataFrame:
    """df with title, slides (all of them), links and caption of a video made of each post, in a column `out`.

    The first line is the title; marks, signatures and lines of sources go, lines with a
    pointing hand are links. Lists stay together where they fit a slide. A video shows the first SLIDES of the slides.
    """
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n"), lambda x: F.regexp_replace(F.regexp_replace(x, MARK, ""), r"(?U)\s+$", ""))
    rows = df.withColumn("_lines", F.filter(lines, lambda x: ~x.rlike(SIGNATURE) & ~x.rlike(SOURCES)))
    rows = rows.withColumn("_begin", F.array_position(F.transform("_lines", lambda x: F.trim(x) != ""), True).cast("int"))
    begin = F.col("_begin")
    rows = rows.withColumn("_rest", F.when(begin > 0, F.slice("_lines", begin + 1, F.size("_lines"))).otherwise(F.slice("_lines", 1, 0)))
    rows = rows.withColumn("_body", F.array_join(F.filter("_rest", lambda x: ~F.contains(x, F.lit("👉"))), "\n"))
    rows = rows.withColumn("_paragraphs", F.filter(F.transform(F.split("_body", r"\n\s*\n"), _bare), lambda p: p != ""))
    rows = rows.withColumn("_first", F.when(F.size("_paragraphs") > 0, F.get(F.split(F.get("_paragraphs", F.lit(0)), END), F.lit(0))).otherwise(""))
    rows = rows.withColumn("_title", F.when(begin > 0, _bare(F.get("_lines", begin - 1))).otherwise(""))
    slides = F.flatten(F.transform("_paragraphs", lambda p: F.when(F.length(p) <= SLIDE, F.array(p)).otherwise(chunks(F.replace(p, F.lit("\n"), F.lit(" "))))))
    links = F.transform(F.filter("_rest", lambda x: F.contains(x, F.lit("👉"))), _bare)
    handle = "@" + channel.removeprefix("@") if channel else ""
    parts = F.filter(F.array("_title", "_first", F.lit(f"{label} {handle}".strip()), F.lit(hashtags.strip())), lambda x: x != "")
    made = F.struct(F.col("_title").alias("title"), slides.alias("slides"), links.alias("links"), F.substring(F.array_join(parts, "\n\n"), 1, CAPTION).alias("caption"))
    return rows.withColumn(out, made).drop("_lines", "_begin", "_rest", "_body", "_paragraphs", "_first", "_title")
