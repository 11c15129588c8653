"""Text, number and hash expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
# fixed values: patterns of the published formats
SENTENCE_END = r"(?<=[.!?…])\s+(?=[«\"(\[]?[А-ЯЁA-Z0-9])"
LIST_ITEM = r"(?m)^[ \t]*(?:[•\-–—*▪]|\d{1,2}[.)])[ \t]+\S"
SOURCE_FOOTER = r"^[ \t]*(?:#{1,6}[ \t]*)?(?:источники(?: и материалы)?|список источников|sources|references)[ \t]*:?[^\n]*$"
READ_MORE = r"\b(?:читать\s+(?:далее|дальше|полностью)|read\s+more|continue\s+reading)\b.*$"
LATIN, CYRILLIC = r"[A-Za-z][A-Za-z0-9+#\-]*", r"(?<=[ «\"(\-])[А-ЯЁ][а-яё]{2,}"
LINK, BOLD = r"\[([^\[\]\n]{1,200})\]\((https?://[^\s()<>]+)\)", r"\*\*(?=\S)([^*\n]{1,300}?)(?<=\S)\*\*"
# fixed values: what announces a list of so many things, after "top", before a word of praise, and at the start
PRAISED = "лучш|главн|полезн|важн|интересн|бесплатн|способ|причин|совет|best|ways|tips|reasons|things|must"
COUNTED = "инструмент|сервис|скилл|навык|плагин|расширени|приложени|игр|фильм|книг|модел|репозитори|tools|skills|plugins|apps|games|repos|models"
# fixed values: words that are no names
NO_NAMES = (
    "the and for with from new how why what you your now its are has can best top all more into will get gets out this that who big first "
    "ai ии it api app apps pc vs ceo via news critical vulnerability vulnerabilities release released update launch launches says game games "
    "model models tool tools agent agents open source data free year week guide review report video after over about just could would should "
    "make makes steam fps 4k 8k hdr dlc pve pvp mmo mmorpg rpg beta gpu cpu ssd ram usb ultrawide deck remaster remake edition complete"
).split()


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeezed(text: Column | str) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(text), r"(?U)\s+", " "))


def words(text: Column | str) -> Column:
    """Lower-case words of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD), F.lit(0))


def normalized(text: Column | str) -> Column:
    """Lower case, other signs as spaces, squeezed: what shingles are taken from."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_c(text)), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def sentences(text: Column | str) -> Column:
    """Sentences of at least two characters: cut after an end mark before a capital, digit or opening sign."""
    cut = F.split(squeezed(text), SENTENCE_END)
    # a lambda: transform would pass trim the place of a sentence as the signs to cut off
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: F.length(s) > 1)


def numbers(text: Column | str) -> Column:
    """Distinct numbers: white space before three digits that end a word dropped, a decimal comma as a point."""
    joined = F.regexp_replace(_c(text), r"(?U)(?<=\d)\s(?=\d{3}\b)", "")
    return F.array_distinct(F.transform(F.regexp_extract_all(joined, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("."))))


def list_items(text: Column | str) -> Column:
    """The number of bulleted or numbered lines."""
    return F.size(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(LIST_ITEM), F.lit(0)))


def promised_count(title: Column | str) -> Column:
    """How many things a title promises to list; null if none or fewer than three."""
    t = _c(title)
    whole = rf"(?iuU)\b(?:топ|top)[-\s]?(\d{{1,2}})\b|\b(\d{{1,2}})\s+(?:сам\w+\s+)?(?:{PRAISED})|^\W*(\d{{1,2}})\s+(?:\w+\s+)?(?:{COUNTED})"
    n = F.coalesce(*[F.regexp_extract(t, whole, g).try_cast("int") for g in (1, 2, 3)])
    return F.when(n >= 3, n)


def truncated(text: Column | str, most: int | Column) -> Column:
    """A text of at most `most` characters: cut after its last sentence end if beyond half, else with an ellipsis."""
    t = _c(text)
    head = F.substring(t, 1, most) if isinstance(most, int) else F.substr(t, F.lit(1), most)
    whole = F.regexp_extract(head, r"(?s)^(.*[.!?]) ", 1)
    return F.when(F.length(t) <= most, t).when(F.length(whole) - 1 > most / 2, whole).otherwise(F.concat(F.regexp_replace(head, r"(?U)\s+$", ""), F.lit("…")))


def without_citations(text: Column | str, valid: list[int] | None = None) -> Column:
    """A text without its [n] marks; those joined to a word go only if n is in valid."""
    glued = rf"|\[0*(?:{'|'.join(map(str, sorted(valid)))})\]" if valid else ""
    t = F.regexp_replace(F.coalesce(_c(text), F.lit("")), rf"[ \t]+\[\d+\]|(?<![\p{{L}}\p{{N}}_])\[\d+\]{glued}", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]{2,}", " "), r"[ \t]+([.,;:!?…])", "$1")
    return stripped(F.regexp_replace(t, r"(?m)^[ \t]+|[ \t]+$", ""))


def without_footer(text: Column | str) -> Column:
    """A text up to the last heading of a list of sources."""
    t = F.coalesce(_c(text), F.lit(""))
    return stripped(F.when(t.rlike(f"(?imu){SOURCE_FOOTER}"), F.regexp_extract(t, rf"(?s)\A(.*)(?imu:{SOURCE_FOOTER})", 1)).otherwise(t))


def stripped(text: Column | str) -> Column:
    """A text without white space at its ends."""
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+$(?!\n)", "")


def without_teaser(text: Column | str) -> Column:
    """A text without a closing invitation to read on."""
    return stripped(F.regexp_replace(_c(text), f"(?iuU){READ_MORE}", ""))


def aspects(topic: Column | str) -> Column:
    """The parts of a topic between commas, semicolons, points and colons, each once whatever its case, of 120 characters at most."""
    kept = F.filter(F.transform(F.split(F.coalesce(_c(topic), F.lit("")), "[,;.:]"), stripped), lambda x: x != "")
    lower = F.transform(kept, F.lower)
    first = F.filter(kept, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)
    return F.transform(first, lambda x: F.substring(x, 1, 120))


def plain(text: Column | str) -> Column:
    """Marked-up text for places without format: bold marks dropped, links as text (address)."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(_c(text), F.lit("")), LINK, "$1 ($2)"), BOLD, "$1")


def visible(text: Column | str) -> Column:
    """Marked-up text as a reader sees it."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(_c(text), F.lit("")), LINK, "$1"), BOLD, "$1")


def escaped(text: Column | str) -> Column:
    out = F.replace(_c(text), F.lit("&"), F.lit("&amp;"))
    for sign, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def html(text: Column | str) -> Column:
    """Marked-up text as HTML with bold and links."""
    linked = F.regexp_replace(escaped(F.coalesce(_c(text), F.lit(""))), LINK, '<a href="$2">$1</a>')
    return F.regexp_replace(linked, BOLD, "<b>$1</b>")


def keep_links(text: Column | str, allowed: list[str]) -> Column:
    """Links to other addresses than the allowed ones lose their address."""
    other = "".join(f"(?!\\Q{u}\\E\\))" for u in allowed)
    return F.regexp_replace(F.coalesce(_c(text), F.lit("")), rf"\[([^\[\]\n]{{1,200}})\]\({other}(https?://[^\s()<>]+)\)", "$1")


_QUOTES = r'[*_ "«»]'


def _bare(text: Column) -> Column:
    return F.regexp_replace(stripped(text), f"^{_QUOTES}+|{_QUOTES}+$", "")


def written_post(raw: Column | str) -> Column:
    """title and body of a generated text: code fences, heading marks and a list of sources dropped."""
    t = F.regexp_replace(stripped(_c(raw)), r"(?U)^```\w*\n?|\n?```$", "")
    t = F.regexp_replace(t, r"(?U)^(?:[^\S\n]*\n)+", "")
    head = F.regexp_replace(stripped(F.regexp_extract(t, r"^([^\n]*)", 1)), r"^#+\s*", "")
    title = F.regexp_replace(F.regexp_replace(head, r"(?iuU)^\W*заголовок:\s*", ""), f"^{_QUOTES}+|{_QUOTES}+$", "")
    return F.struct(title.alias("title"), without_footer(F.regexp_extract(t, r"(?s)^[^\n]*\n(.*)$", 1)).alias("body"))


def headline(title: Column | str, body: Column | str, most: int = 120) -> Column:
    """title and body with one sentence as title, of about `most` characters; what is over goes to the body."""
    found = sentences(_bare(_c(title)))
    first = F.get(found, F.lit(0))
    line = _bare(without_citations(first))
    line = F.when(line.rlike(r"(?<!\.)\.$"), F.substr(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    cut = F.substring(line, 1, most)
    pause = F.regexp_extract(cut, r"(?s)^(.*)(?:, |: |; | — | – )", 1)
    short = F.when(F.length(pause) >= most // 2, pause).otherwise(F.regexp_extract(cut, r"(?s)^(.*) [^ ]*$|^(.*)$", 1))
    short = F.when(short == "", cut).otherwise(short)
    long = F.length(line) > most
    out = F.when(long, F.concat(F.regexp_replace(short, r"[ ,:;—–-]+$", ""), F.lit("…"))).otherwise(line)
    rest = F.concat(F.when(long, F.slice(found, 1, 1)).otherwise(F.slice(found, 1, 0)), F.slice(found, F.lit(2), F.size(found)))
    parts = F.filter(F.array(stripped(F.array_join(rest, " ")), stripped(_c(body))), lambda x: x != "")
    none = F.size(found) == 0
    return F.struct(F.when(none, _bare(without_citations(title))).otherwise(out).alias("title"), F.when(none, stripped(_c(body))).otherwise(F.array_join(parts, "\n\n")).alias("body"))


def citation_check(body: Column | str, valid: Column) -> Column:
    """invalid_citations (sorted), citation_coverage of sentences of four words or more, length."""
    t = _c(body)
    used = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int")))
    long = F.filter(sentences(t), lambda s: F.size(words(without_citations(s))) >= 4)
    cited = F.size(F.filter(long, lambda s: s.rlike(r"\[\d+\]")))
    return F.struct(F.array_sort(F.array_except(used, valid)).alias("invalid_citations"), F.when(F.size(long) > 0, F.round(cited / F.size(long), 2)).otherwise(1.0).alias("citation_coverage"), F.length(t).alias("length"))


def source_dump(body: Column | str, sources: Column | str) -> Column:
    """Whether a text lists its sources instead of joining them: two paragraphs that start with a mark, or seven tenths of three and more sentences of five words taken over."""
    t = _c(body)
    marked = F.filter(F.transform(F.split(t, r"\n\s*\n"), stripped), lambda p: p.rlike(r"^\[\d+\]"))
    flat = F.array_join(words(sources), " ")
    own = F.filter(F.transform(sentences(t), lambda s: F.array_join(words(without_citations(s)), " ")), lambda s: F.size(F.split(s, " ")) >= 5)
    taken = F.filter(own, lambda s: F.contains(flat, s))
    return (F.size(marked) >= 2) | ((F.size(own) >= 3) & (F.size(taken) / F.greatest(F.size(own), F.lit(1)) >= 0.7))


def list_mismatch(title: Column | str, body: Column | str) -> Column:
    """promised and listed, where a title promises more things than the text lists; else null."""
    promised, listed = promised_count(title), list_items(body)
    return F.when(listed < promised, F.struct(promised.alias("promised"), listed.alias("listed")))


def answer_tokens(limit: Column) -> Column:
    """Tokens that an answer of so many characters may take."""
    return F.greatest(F.lit(700), F.floor(limit / 2) + 300)


def used_citations(numbers: Column, *texts: Column) -> Column:
    """The numbers that the texts cite, in order; all if they cite none."""
    marks = F.concat(*[F.transform(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int")) for t in texts])
    used = F.filter(numbers, lambda n: F.array_contains(marks, n))
    return F.when(F.size(used) > 0, used).otherwise(numbers)


def matching(text: Column | str) -> Column:
    """Lower-case text of letters and digits with single spaces: what captions and posts are matched by."""
    return F.trim(F.regexp_replace(F.lower(_c(text)), r"[^\p{L}\p{N}]+", " "))


def other_script(body: Column | str, script: str) -> Column:
    """Whether a text of twenty letters and four different words has fewer than two fifths of them in a script (Latin or Cyrillic)."""
    t = _c(body)
    letters, own = (F.length(F.regexp_replace(t, f"[^{c}]", "")) for c in (r"\p{L}", rf"\p{{Is{script}}}"))
    return (letters >= 20) & (F.size(F.array_distinct(words(t))) >= 4) & (own / letters < 0.4)


def footer(urls: Column, names: Column, label: str) -> Column:
    """A line of linked sources, each address once under its first name; empty without any. urls, names: arrays."""
    pairs = F.filter(F.arrays_zip(urls.alias("u"), names.alias("n")), lambda x: F.coalesce(F.trim(x["u"]), F.lit("")) != "")
    known = F.transform(pairs, lambda x: F.trim(x["u"]))
    first = F.filter(pairs, lambda x, i: F.array_position(known, F.trim(x["u"])) == i + 1)
    name = lambda x: F.when(F.coalesce(F.trim(x["n"]), F.lit("")) != "", F.trim(x["n"])).otherwise(F.trim(x["u"]))
    links = F.transform(first, lambda x: F.concat(F.lit('<a href="'), escaped(F.trim(x["u"])), F.lit('">'), escaped(name(x)), F.lit("</a>")))
    return F.when(F.size(links) > 0, F.concat(F.lit(f"\n\n{label}: "), F.array_join(links, ", "))).otherwise("")


def whole_number(text: Column | str) -> Column:
    """An integer with commas between thousands; null if it is none."""
    return F.trim(F.replace(_c(text).cast("string"), F.lit(","), F.lit(""))).try_cast("long")


def shingles(text: Column | str, k: int = 4) -> Column:
    """Distinct character k-grams of the normalized text; a shorter text is its own, an empty one has none."""
    t = normalized(text)
    n = F.length(t)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substr(t, i, F.lit(k)))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def entities(text: Column | str) -> Column:
    """Names in a title, sorted: Latin words of three letters or in capitals, and capitalised Cyrillic words not at the start by their first four letters."""
    t = F.coalesce(_c(text), F.lit(""))
    latin = F.filter(F.regexp_extract_all(t, F.lit(LATIN), F.lit(0)), lambda w: (F.length(w) >= 3) | (w == F.upper(w)))
    latin = F.transform(latin, lambda w: F.regexp_replace(F.lower(w), "-+$", ""))
    other = F.transform(F.regexp_extract_all(t, F.lit(CYRILLIC), F.lit(0)), lambda w: F.lower(F.substring(w, 1, 4)))
    named = F.filter(F.concat(latin, other), lambda w: F.length(w) >= 2)
    return F.array_sort(F.array_except(F.array_distinct(named), F.array(*map(F.lit, NO_NAMES))))


def stems(text: Column | str) -> Column:
    return F.array_distinct(F.transform(F.filter(words(text), lambda w: F.length(w) >= 4), lambda w: F.substring(w, 1, 4)))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(_c(a), _c(b)))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(_c(a), _c(b))) / union)


def content_hash(title: Column | str, body: Column | str) -> Column:
    """md5 of the squeezed lower-case title and body."""
    return F.md5(F.lower(squeezed(F.concat_ws("\n", _c(title), _c(body)))))


def item_hash(url: Column | str, title: Column | str, text: Column | str) -> Column:
    """sha1 of the normalized URL, or of title and text where there is none."""
    from tideline.functions.urls import normalized_url

    return F.when(F.coalesce(_c(url), F.lit("")) != "", F.sha1(normalized_url(url))).otherwise(F.sha1(F.lower(F.concat(_c(title), F.lit("\n"), F.substring(_c(text), 1, 2000)))))


def count_of(text: Column | str) -> Column:
    """A shortened count such as 1.2K or 3M as a number; null if it is none."""
    t = F.replace(F.upper(F.trim(_c(text))), F.lit(","), F.lit("."))
    value = F.regexp_extract(t, r"^([\d.]+)\s*[KM]?$", 1).try_cast("decimal(20,6)")
    return (value * F.when(t.endswith("K"), 1000).when(t.endswith("M"), 1000000).otherwise(1)).cast("long")


def captions(text: Column | str, every: int = 30) -> Column:
    """Spoken words without [noise] of at most 30 signs; where sentence ends are rare, one after every `every` words."""
    t = squeezed(F.regexp_replace(_c(text), r"\[[^\]]{1,30}\]", " "))
    w = F.split(t, " ")
    marks = F.length(F.regexp_replace(t, r"[^.!?]", ""))
    chunk = lambda i: F.array_join(F.slice(w, i * every + 1, F.lit(every)), " ")
    chunks = F.transform(F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / every).cast("int")), chunk), lambda c: F.when(c.rlike(r"[.!?…]$"), c).otherwise(F.concat(c, F.lit("."))))
    return F.when((t != "") & (marks < F.size(w) / 40), F.array_join(chunks, " ")).otherwise(t)
