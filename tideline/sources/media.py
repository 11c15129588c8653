"""Pictures and videos of pages, and the page that a page retells."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import urls as U
from tideline.sources import markup as M

# fixed values: pictures and videos of a page, the least side of a picture, the longest address
IMAGES, VIDEOS, LEAST_SIDE, LONGEST = 6, 3, 300, 1000
# fixed values: what is no illustration, badges, junk and tracking pictures, words before a source, paths of posts
NO_PICTURE = r"(?i)avatar|author|profile|headshot|userpic|logo|icon|badge|emoji|sprite|gravatar"
BADGE = r"(?i)shields\.io|badgen\.net|badge\.fury\.io|codecov\.io|circleci\.com|travis-ci|/badge|/workflows/|star-history\.com|deepwiki\.com"
JUNK = (
    r"(?i)(pixel|spacer|blank\.|1x1|/favicon|/logo|/icon|/avatar|/emoji|/smil|gravatar|doubleclick|/ads?/|counter|dummy|placeholder|no-?image|default-?(image|thumb|cover)|stub"
    r"|(?:^|[/_.-])logo(?:[/_.-]|$)|(?:^|[/_.-])social(?:[/_.-]|$)|opengraph|twitter[-_.]?card|sprite)"
)
ORIGIN = r"(?iu)(?<![\w-])(?:оригинал\w*|первоисточник\w*|источник\w*|original|source|via)(?![\w-])"
BLOG = r"(?i)/(?:blog|news|post|posts|article|articles|announc\w*|press|research|stories|updates?|engineering)(?:/|$)"
FILES, FILMS = r"(?i)\.(jpg|jpeg|png|gif|webp|svg|pdf|zip|mp4|mp3)$", r"(?i)\.(mp4|m4v|mov)$"
STOP = ["with", "from", "that", "this", "your", "have", "what", "about", "into", "more", "than", "будет", "этот", "como", "para"]
ORIGIN_LEAST = 3

NODE = "place int, tag string, src string, hint string, canonical string, poster string, width string, height string, away string, label string, before string"


#: A page's site, and addresses that are joined with it as they stand.
_SITE, _PLAIN = re.compile(r"https?://[a-z0-9.-]+(?=/|\Z)"), re.compile(r"/[A-Za-z0-9_-][A-Za-z0-9_.,-]*\Z")


def nodes(page: str, base: str) -> Iterator[dict]:
    """Pictures, videos, links and cards of a page with what their surroundings say, in document order; addresses are made whole."""

    site = _SITE.match(base)

    def whole(address: str | None) -> str | None:
        try:
            if site and address and _PLAIN.match(address):
                return site[0] + address
            return urljoin(base, address.strip()) if address and not address.startswith(("data:", "blob:")) else None
        except ValueError:
            return None

    root = M.tree(page)
    place = 0
    todo: list[tuple] = [(M.content(root), None, "")]
    while todo:
        x, link, before = todo.pop()
        row = None
        if x.tag == "img":
            src = x.attrs.get("data-src") or x.attrs.get("src") or ""
            if (not src or src.startswith("data:")) and x.attrs.get("srcset"):
                src = x.attrs["srcset"].split(",")[0].strip().split(" ")[0]
            canonical = x.attrs.get("data-canonical-src") or src
            hint = " ".join([x.attrs.get("alt", ""), x.attrs.get("class", ""), x.attrs.get("src", ""), canonical])
            row = {"src": whole(src), "hint": hint, "canonical": canonical, "away": link}
        elif x.tag == "video":
            own = [x.attrs.get("src"), *(s.attrs.get("src") for s in x.all(lambda n: n.tag == "source") if (s.attrs.get("type") or "video/mp4") in ("video/mp4", "video/quicktime"))]
            films = [u for u in map(whole, own) if u and (re.search(FILMS, path := re.sub(r"[?#].*", "", u)) or "." not in path.rsplit("/", 1)[-1])]
            row = {"src": films[0] if films else None, "poster": whole(x.attrs.get("poster"))}
        elif x.tag == "a" and x.attrs.get("href"):
            link = whole(x.attrs["href"])
            row = {"src": link, "label": M.squeezed(x.text()), "before": before[-40:]}
        elif film := next((u for v in x.attrs.values() if re.search(r"(?i)\.(mp4|m4v|mov|webm)$", re.sub(r"[?#].*", "", v)) and (u := whole(v))), None):
            row = {"src": film}
        if row:
            yield {"place": place, "tag": x.tag if x.tag in ("img", "video", "a") else "film", "width": x.attrs.get("width"), "height": x.attrs.get("height")} | row
            place += 1
        below, last = [], ""
        for y in x.below:
            if isinstance(y, M.Node):
                below.append((y, link, last))
                last = ""
            else:
                last = y
        todo += reversed(below)
    head = root.first(lambda n: n.tag == "head")
    for names, tag in (({"og:video", "og:video:url", "og:video:secure_url"}, "film"), ({"og:image", "twitter:image"}, "card")):
        card = head.first(lambda n, names=names: n.tag == "meta" and (n.attrs.get("property") or n.attrs.get("name")) in names) if head else None
        if card and (u := whole(card.attrs.get("content"))) and (tag == "card" or re.search(FILMS, re.sub(r"[?#].*", "", u))):
            yield {"place": place, "tag": tag, "src": u}
            place += 1
    title, h1 = (root.first(lambda n, t=t: n.tag == t) for t in ("title", "h1"))
    yield {"place": place, "tag": "title", "label": M.squeezed(" ".join(n.text() for n in (title, h1) if n))}


def parsed(df: DataFrame, key: str, content: str, url: str) -> DataFrame:
    """The nodes of each page; pages are parsed once. Null pages have none."""
    rows = df.select(key, F.col(content).alias("_content"), F.coalesce(F.col(url), F.lit("")).alias("base")).where("_content is not null")
    kind, names = dict(df.dtypes)[key], [f.split()[0] for f in NODE.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, page, base in zip(batch.column(0), batch.column("_content").to_pylist(), batch.column("base").to_pylist(), strict=True):
                found = list(nodes(page, base))
                columns = [pa.array([n.get(c) for n in found], pa.int32() if c == "place" else pa.string()) for c in names]
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(found), k.type), pa.array([base] * len(found), pa.string()), *columns], [key, "base", *names])

    return rows.mapInArrow(each, f"`{key}` {kind}, base string, {NODE}")


def is_picture_url(url: Column) -> Column:
    """Whether an address may be a picture's: of the web, not too long, no vector or icon file, no junk."""
    return url.rlike("^(?i)https?://[^/?#]") & (F.length(url) <= LONGEST) & ~U.path(url).rlike(r"(?i)\.(svg|ico)$") & ~url.rlike(JUNK)


def media(found: DataFrame, key: str) -> DataFrame:
    """kind (image, video, animation), url, poster, at (from 0 in each kind of list) of the pictures and films of parsed() pages.

    Pictures that are too small, named like avatars or badges, or linked to another page of
    the site or to an advertisement are left out, and so is what is there already. A
    film's poster is a picture too, the page's card the last one. Seven pictures and three films at most.
    """
    src, away = F.col("src"), F.col("away")
    side = lambda c: F.regexp_replace(F.coalesce(F.trim(c), F.lit("")), "px$", "").try_cast("int") < LEAST_SIDE
    small = F.coalesce(side("width"), F.lit(False)) | F.coalesce(side("height"), F.lit(False))
    host = lambda c: F.coalesce(U.host(c), F.lit(""))
    trimmed = lambda c: F.regexp_replace(F.coalesce(U.path(c), F.lit("")), "/+$", "")
    card = away.rlike(r"\?[^#]*utm_") | (host(away) == host("base")) & ~U.path(away).rlike(FILES) & (trimmed(away) != trimmed("base"))
    good = ~small & ~F.col("hint").rlike(NO_PICTURE) & ~F.col("hint").rlike(BADGE) & ~F.coalesce(card, F.lit(False))
    tag, still = F.col("tag"), F.lit("image")
    row = lambda url, kind, poster: F.struct(F.when(kind == "image", 0).otherwise(1).alias("list"), kind.alias("kind"), url.alias("url"), poster.alias("poster"))
    moving = F.when(F.regexp_replace("canonical", "[?#].*", "").rlike(r"(?i)\.gif$"), "animation").otherwise(still)
    picture = F.when(((tag == "img") & good | (tag == "card")) & is_picture_url(src), row(src, moving, F.col("poster")))
    poster = F.when((tag == "video") & is_picture_url(F.col("poster")), row(F.col("poster"), still, F.lit(None).cast("string")))
    film = F.when(tag.isin("video", "film") & src.rlike("^(?i)https?://"), row(src, F.lit("video"), F.col("poster")))
    # one pass over the nodes: a union of lists would parse the pages once for each
    rows = found.select(key, "place", F.explode(F.array_compact(F.array(picture, poster, film))).alias("r")).select(key, "place", "r.*")
    once = rows.groupBy(key, "list", "url").agg(F.min(F.struct("place", "kind", "poster")).alias("f"))
    ranked = once.withColumn("at", F.row_number().over(Window.partitionBy(key, "list").orderBy("f.place", "url")) - 1)
    return ranked.where((F.col("list") == 0) & (F.col("at") <= IMAGES) | (F.col("list") == 1) & (F.col("at") < VIDEOS)).select(key, "f.kind", "url", "f.poster", "at")


def stems(text: Column) -> Column:
    """First four letters of words of four letters and more, but for some common ones."""
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\p{L}{4,}"), F.lit(0)), F.lower)
    return F.array_distinct(F.transform(F.filter(words, lambda w: ~w.isin(STOP)), lambda w: F.substring(w, 1, 4)))


def origins(found: DataFrame, key: str, not_official: list[str]) -> DataFrame:
    """url and score of the external link of each page that it most likely retells; none below three points.

    A point for each stem that its path shares with the page's titles, two for the site's
    name in them, one for a path of posts, three for a word such as source in or before the link. Of equal
    links the first.
    """
    heads = found.where("tag = 'title'").select(key, F.col("label").alias("heading"))
    rows = found.where("tag = 'a' and src rlike '^https?://'").join(heads, key)
    path, name = U.path("src"), U.brand("src")
    ends = [(U.host("src") == d) | U.host("src").endswith("." + d) for d in not_official]
    other = (U.site("src") != F.coalesce(U.site("base"), F.lit(""))) & ~path.rlike(FILES)
    for end in ends:
        other = other & ~end
    shared = F.size(F.array_intersect(stems(F.translate(path, "-_", "  ")), stems(F.col("heading"))))
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower("heading"), r"[^\p{L}\p{N}_]+", " "), F.lit(" "))
    named = (F.length(name) >= 3) & F.contains(padded, F.concat(F.lit(" "), name, F.lit(" ")))
    said = F.concat_ws(" ", F.coalesce("before", F.lit("")), "label").rlike(ORIGIN)
    score = shared + F.when(named, 2).otherwise(0) + F.when(path.rlike(BLOG), 1).otherwise(0) + F.when(said, 3).otherwise(0)
    best = rows.where(other).withColumn("score", score).groupBy(key).agg(F.max_by(F.struct(F.col("src").alias("url"), "score"), F.struct("score", -F.col("place"))).alias("f"))
    return best.where(F.col("f.score") >= ORIGIN_LEAST).select(key, "f.url", "f.score")


def cover(pictures: Column, defaults: Column, most: int = 3) -> Column:
    """The first pictures that are no default of their site: those to try as a cover."""
    return F.slice(F.array_distinct(F.array_except(F.filter(pictures, lambda u: F.coalesce(u, F.lit("")) != ""), F.coalesce(defaults, F.array().cast("array<string>")))), 1, most)
