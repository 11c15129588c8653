"""Connectors and functions of text and addresses over feeds, searches, channels and addresses that are made of the documents; the SQL takes their parts as they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.functions import urls as U
from tideline.plans.generation import _SPACE, _sentences
from tideline.plans.queries import query, read
from tideline.sources import connectors as C

NOW, MANY = "2024-02-01 00:00:00", 20
#: Texts without signs that markup gives a meaning; what is left of them when white space is squeezed.
_CLEAN = "regexp_replace(coalesce(text, ''), '[^\\n !-%''-;=?-~\\x{a1}-\\x{fffd}]', ' ', 'g')"
_FLAT = f"trim(regexp_replace(regexp_replace({_CLEAN}, '\\s*;\\s*;+', ';', 'g'), '{_SPACE}', ' ', 'g'))"


def _docs(spark, sf_dir):
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\n !-%'-;=?-~\x{a1}-\x{fffd}]", " ")
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "source", clean.alias("c"))


def _gathered(docs, part, before: str, after: str, between: str = ""):
    """One content for each MANY documents, in their order."""
    rows = docs.groupBy(F.expr(f"doc_id div {MANY}").alias("page")).agg(F.array_sort(F.collect_list(F.struct("doc_id", part.alias("x")))).alias("parts"))
    return rows.select("page", F.lit("name").alias("name"), F.concat(F.lit(before), F.array_join("parts.x", between), F.lit(after)).alias("content"))


def _number(column, pattern: str = r"(\d+)$"):
    return F.regexp_extract(column, pattern, 1).cast("long").alias("doc_id")


def _c(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


_AT = "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * CAST(doc_id AS INT)"


@query(rf"""WITH t AS (SELECT doc_id, substr(trim(trim({_FLAT} || ' Read more here', ';')), 1, 20000) AS t FROM documents)
SELECT doc_id, 'Doc & ' || doc_id AS title, md5(trim(regexp_replace(t, '(?i)\bread\s+more\b.*$', ''))) AS text, CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '{NOW}' ELSE {_AT} END AS published, CASE WHEN doc_id % 2 = 0 THEN 'https://e.org/' || doc_id || '.jpg' END AS image_url FROM t""")
def feeds_of_documents(spark, sf_dir):
    """Documents as entries of feeds and back: texts as marked-up descriptions with an invitation to read on, times in the format of mail."""
    d = F.col("doc_id")
    at = F.timestamp_seconds(F.lit(1704067200) + 60 * d)
    time = F.when(d % 3 == 0, "").when(d % 3 == 1, _c("<pubDate>", F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), " +0000</pubDate>")).otherwise(_c("<updated>", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), "Z</updated>"))
    image = F.when(d % 2 == 0, _c('<enclosure type="image/jpeg" url="https://e.org/', d, '.jpg"/>')).otherwise("")
    item = _c("<item><title> Doc &amp;amp; ", d, "</title><link>https://e.org/", d, "</link>", time, image, "<description>&lt;p&gt;", F.col("c"), "&lt;/p&gt; Read more here</description></item>")
    feeds = _gathered(_docs(spark, sf_dir), item, "<rss><channel>", "</channel></rss>")
    found = C.feed(feeds, "page", "content", NOW)
    return found.select(_number("url"), "title", F.md5(F.col("text").cast("binary")).alias("text"), F.col("published_at").cast("timestamp_ntz").alias("published"), "image_url")


@query("""SELECT doc_id, 'https://www.youtube.com/watch?v=' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 11) AS url, source AS publisher, CAST(doc_id * 1234 AS VARCHAR) AS views, CAST(doc_id % 50 AS VARCHAR) AS likes FROM documents WHERE doc_id % 4 <> 3""")
def video_feeds_of_documents(spark, sf_dir):
    d = F.col("doc_id")
    video = F.substring(F.md5(d.cast("string").cast("binary")), 1, 11)
    named = F.when(d % 4 == 3, "").when(d % 4 == 2, _c('<link href="https://youtu.be/', video, '"/>')).otherwise(_c("<yt:videoId>", video, "</yt:videoId>"))
    numbers = _c('<media:community><media:starRating count="', d % 50, '"/><media:statistics views="', d * 1234, '"/></media:community>')
    entry = _c("<entry>", named, "<title>Film ", d, "</title><author><name>", F.col("source"), "</name></author><media:group>", numbers, "</media:group></entry>")
    feeds = _gathered(_docs(spark, sf_dir), entry, '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:yt="http://v/" xmlns:media="http://m/">', "</feed>")
    found = C.videos(feeds, "page", "content", NOW)
    return found.select(_number("title"), "url", "publisher", F.col("meta")["views"].alias("views"), F.col("meta")["likes"].alias("likes"))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'https://www.reddit.com/r/name/' || doc_id WHEN doc_id % 3 = 1 THEN 'https://e.org/' || doc_id ELSE 'https://www.youtube.com/watch?v=' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 11) END AS url,
  ['post', 'article', 'video'][doc_id % 3 + 1] AS kind, md5(CASE WHEN doc_id % 3 = 0 THEN substr(trim(regexp_replace({_CLEAN}, '{_SPACE}', ' ', 'g')), 1, 20000) ELSE '' END) AS text FROM documents""")
def forums_of_documents(spark, sf_dir):
    d = F.col("doc_id")
    away = F.when(d % 3 == 0, _c("https://www.reddit.com/r/name/", d)).when(d % 3 == 1, _c("https://e.org/", d)).otherwise(_c("https://youtu.be/", F.substring(F.md5(d.cast("string").cast("binary")), 1, 11)))
    own = F.when(d % 3 == 0, _c('&lt;div class="md"&gt;', F.col("c"), "&lt;/div&gt;")).otherwise("")
    entry = _c("<entry><title>Post ", d, '</title><link href="https://www.reddit.com/r/name/', d, '"/><content type="html">', own, '&lt;a href="', away, '"&gt;[link]&lt;/a&gt;</content></entry>')
    found = C.discussions(_gathered(_docs(spark, sf_dir), entry, '<feed xmlns="http://www.w3.org/2005/Atom">', "</feed>"), "page", "content", "name", NOW)
    return found.select(_number("title"), "url", "kind", F.md5(F.col("text").cast("binary")).alias("text"))


@query(f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY doc_id // {MANY}, doc_id // 2 ORDER BY doc_id) AS n FROM documents)
SELECT doc_id, CASE WHEN doc_id % 6 < 2 THEN 'https://youtu.be/' || substr(md5(CAST(doc_id // 2 AS VARCHAR)), 1, 11) ELSE 'https://www.e.org/' || doc_id // 2 END AS url, CASE WHEN doc_id % 6 < 2 THEN 'youtu.be' ELSE 'e.org' END AS publisher, source AS author, CAST(doc_id AS VARCHAR) AS views,
  md5(trim(regexp_replace({_CLEAN}, '{_SPACE}', ' ', 'g'))) AS text, {_AT} AS published, CASE WHEN doc_id % 6 < 2 THEN 'https://www.youtube.com/watch?v=' || substr(md5(CAST(doc_id // 2 AS VARCHAR)), 1, 11) END AS film FROM t WHERE n = 1""")
def searches_of_documents(spark, sf_dir):
    """Results of searches, two of each address, of which the first counts; and the videos among them."""
    d = F.col("doc_id")
    half = F.expr("doc_id div 2")
    url = F.when(d % 6 < 2, _c("https://youtu.be/", F.substring(F.md5(half.cast("string").cast("binary")), 1, 11))).otherwise(_c("https://www.e.org/", half))
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + 60 * d), "yyyy-MM-dd'T'HH:mm:ss")
    result = F.to_json(F.struct(url.alias("url"), _c("<b>Result</b>  ", d).alias("title"), F.col("c").alias("content"), at.alias("publishedDate"), F.col("source").alias("author"), d.alias("views")))
    found = C.searched(_gathered(_docs(spark, sf_dir), result, '{"results":[', "]}", ","), "page", "content", NOW)
    films = C.found_videos(found).select("page", "at", F.col("url").alias("film"))
    rows = found.join(films, ["page", "at"], "left")
    return rows.select(_number("title"), "url", "publisher", F.col("meta")["author"].alias("author"), F.col("meta")["views"].alias("views"), F.md5(F.col("text").cast("binary")).alias("text"), F.col("published_at").cast("timestamp_ntz").alias("published"), "film")


@query(f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split({_CLEAN}, chr(10)), lambda x: trim(regexp_replace(x, '^{_SPACE}|{_SPACE}$', '', 'g'))), lambda x: true) AS l FROM documents),
t AS (SELECT doc_id, regexp_replace(array_to_string(l, chr(10)), '^\\s+|\\s+$', '', 'g') AS t, coalesce(list_filter(l, lambda x: x <> '')[1], '') AS first FROM l)
SELECT doc_id, md5(substr(t, 1, 20000)) AS text, length(first) <= 140 AS whole, (doc_id % 90 + 10) * 100 AS views, doc_id % 70 + 1500 AS reactions FROM t WHERE first <> ''""".replace("\\\\", "\\"))
def channels_of_documents(spark, sf_dir):
    """Documents as messages of a channel's page: text, shortened counts of views, reactions."""
    d = F.col("doc_id")
    views = _c(F.format_string("%d.%d", F.expr("(doc_id % 90 + 10) div 10"), d % 10), "K")
    message = _c('<div class="tgme_widget_message" data-post="name/', d, '"><div class="tgme_widget_message_text">', F.replace("c", F.lit("\n"), F.lit("<br>")), '</div><span class="tgme_widget_message_views">', views, '</span><span class="tgme_reaction"><i>x</i>', d % 70, '</span><span class="tgme_reaction"><i>y</i>1.5K</span></div>')
    pages = _gathered(_docs(spark, sf_dir), message, "<html><body>", "</body></html>")
    items, numbers = C.channel(pages, "page", "content", "name", NOW), C.channel_stats(pages, "page", "content")
    rows = items.select(_number("url"), "title", F.md5(F.col("text").cast("binary")).alias("text")).join(numbers.withColumnRenamed("message_id", "doc_id"), "doc_id")
    return rows.select("doc_id", "text", (~F.col("title").endswith("…")).alias("whole"), "views", "reactions")


@query("""SELECT lang, 'https://f.org/' || source AS url, 'Feed ' || source AS name FROM documents WHERE source <> 'src3' GROUP BY lang, source""")
def reading_lists_of_documents(spark, sf_dir):
    """The sources of each language as a reading list, each of them twice and one with an address that is none."""
    rows = read(spark, sf_dir, "documents").select("lang", "source").distinct()
    scheme = F.when(F.col("source") == "src3", "ftp").otherwise("https")
    outline = _c('<outline title="Feed ', F.col("source"), '" xmlUrl="', scheme, "://f.org/", F.col("source"), '"/><outline text="Again" xmlUrl="', scheme, "://f.org/", F.col("source"), '"/>')
    lists = rows.groupBy("lang").agg(_c("<opml><body><outline text='All'>", F.array_join(F.collect_list(outline), ""), "</outline></body></opml>").alias("content"))
    return C.subscriptions(lists, "lang", "content").select("lang", "url", "name")


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS base, contains(html, '</article>') AS own FROM pages)
SELECT page_id, 'feed' AS kind, base || '/feed' || page_id || '.xml' AS url, '' AS label FROM p UNION ALL
SELECT page_id, 'repo', 'https://github.com/o' || page_id || '/code', 'code' FROM p WHERE own UNION ALL SELECT page_id, 'official', 'https://tool' || page_id || '.dev/', 'tool' || page_id || '.dev' FROM p WHERE own""")
def links_of_pages(spark, sf_dir):
    """The feeds that pages name in their heads, and the links that readers have use for, put among the others of their texts."""
    p = F.col("page_id")
    head = _c('<head><link rel="alternate" type="application/rss+xml" href="/feed', p, '.xml"><link rel="stylesheet" href="/s.css">')
    more = _c('<p><a href="https://github.com/o', p, '/code/tree/main">source</a> <a href="https://tool', p, '.dev/">Official website</a> <a href="https://github.com/o', p, '/code">again</a></p></article>')
    pages = read(spark, sf_dir, "pages").select("page_id", "url", F.replace(F.replace("html", F.lit("<head>"), head), F.lit("</article>"), more).alias("html"))
    feeds = C.feeds_of(pages, "page_id", "html", "url").select("page_id", F.lit("feed").alias("kind"), F.col("href").alias("url"), F.lit("").alias("label"))
    useful = C.useful_links(pages, "page_id", "html", "url").where("kind in ('repo', 'official')").select("page_id", "kind", "url", "label")
    return feeds.unionByName(useful)


@query("""WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS d, substr(md5(CAST(doc_id AS VARCHAR)), 1, 11) AS h FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN h ELSE '' END AS video, ['handle:@name', 'playlist:PL', 'handle:@n', 'search:cats '][doc_id % 4 + 1] || d AS source, 's' || d AS forum, 'ch' || d AS channel, 'b' || d || '.co.uk' AS site, 'b' || d AS brand,
  CASE doc_id % 5 WHEN 0 THEN 'repo https://github.com/o' || d || '/r r' WHEN 1 THEN 'paper https://arxiv.org/abs/' || d || ' arXiv' WHEN 2 THEN 'model https://huggingface.co/o/m' || d || ' m' || d WHEN 3 THEN 'store https://store.steampowered.com/app/' || d || ' Steam' END AS link,
  'https://n.org/' || d AS news, 'pic' || d AS picture, doc_id % 3 < 2 AS blocked, 'https://github.com/o/' || d AS best, 3 AS merged, 'https://news.google.com/rss/search?q=a+%26+' || d || '&hl=' AS search, (doc_id % 900 + 100) * 100 AS number, 1000 + doc_id % 1000 AS whole FROM d""")
def addresses_of_documents(spark, sf_dir):
    """Addresses made of ids, and what the functions find in them."""
    d = F.col("doc_id")
    h = F.substring(F.md5(d.cast("string").cast("binary")), 1, 11)
    pick = lambda n, *made: F.get(F.array(*made), (d % n).cast("int"))
    video = pick(4, _c("https://www.youtube.com/watch?t=1&v=", h), _c("https://youtu.be/", h, "?x"), _c("https://youtube.com/shorts/", h), _c("https://vimeo.com/", h))
    source = U.video_source(pick(4, _c("@name", d), _c("https://www.youtube.com/playlist?list=PL", d), _c("youtube.com/@n", d), _c("cats ", d)))
    link = U.link(pick(5, _c("https://github.com/o", d, "/r.git/tree"), _c("https://www.arxiv.org/pdf/", d, ".pdf"), _c("https://huggingface.co/o/m", d, "/tree/main"), _c("https://store.steampowered.com/app/", d, "/x/"), _c("https://e.org/", d)))
    repo, store, paper = U.link(_c("https://github.com/o/", d)), U.link(_c("https://store.steampowered.com/app/", d)), U.link(F.lit("https://arxiv.org/abs/1"))
    return read(spark, sf_dir, "documents").select(
        "doc_id", U.video_id(video).alias("video"), F.concat_ws(":", source["kind"], source["value"]).alias("source"), U.subreddit(_c("https://old.reddit.com/r/s", d, "/")).alias("forum"), U.channel_name(_c("https://t.me/s/ch", d, "/12?x=1")).alias("channel"),
        U.site(_c("https://a.b", d, ".co.uk/x")).alias("site"), U.brand(_c("https://a.b", d, ".co.uk/x")).alias("brand"), F.when(link.isNotNull(), F.concat_ws(" ", link["kind"], link["url"], link["label"])).alias("link"),
        U.news_address(F.regexp_replace(F.base64(_c("\u0008\u0013", "https://n.org/", d).cast("binary")), "=+$", "")).alias("news"), U.image_key(_c("https://i.org/a/Pic", d, "-300x200.jpg?x")).alias("picture"),
        U.blocked(pick(3, F.lit("https://bad.org/x"), F.lit("https://www.bad.org"), F.lit("https://notbad.org")), ["bad.org"]).alias("blocked"), U.best_link(F.array(paper, store, repo))["url"].alias("best"), F.size(U.merged_links(repo, F.array(store, repo, paper, store))).alias("merged"),
        F.regexp_extract(U.news_search(_c(" a & ", d), F.lit("en")), "^.*&hl=", 0).alias("search"), T.count_of(_c(F.format_string("%d.%d", F.expr("(doc_id % 900 + 100) div 10"), d % 10), "k")).alias("number"), T.whole_number(_c("1,", F.lpad((d % 1000).cast("string"), 3, "0"))).alias("whole"),
    )


_HEAD = "substr(t, 1, 300)"


@query(rf"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
e AS (SELECT *, {_sentences("t")} AS s, regexp_replace(regexp_replace(t, '([0-9])[\s]([0-9]{{3}})\b', '\1\2', 'g'), '([0-9])[\s]([0-9]{{3}})\b', '\1\2', 'g') AS joined, regexp_extract({_HEAD}, '^((?s).*[.!?]) ', 1) AS whole FROM d)
SELECT doc_id, len(s) AS n_sentences, len(list_distinct(list_transform(regexp_extract_all(joined, '[0-9]+(?:[.,][0-9]+)?'), lambda x: replace(x, ',', '.')))) AS n_numbers, len(regexp_extract_all(t, '(?m)^[ \t]*(?:[•\-–—*▪]|[0-9]{{1,2}}[.)])[ \t]+[^\s]')) AS n_items,
  md5(CASE WHEN length(t) <= 300 THEN t WHEN length(whole) - 1 > 150 THEN whole ELSE regexp_replace({_HEAD}, '{_SPACE}$', '') || '…' END) AS short, md5(trim(regexp_replace(lower(t), '[^\pL\pN]+', ' ', 'g'))) AS matching,
  len(list_distinct(list_transform(list_filter(regexp_extract_all(lower(t), '[\pL\pN_]+'), lambda w: length(w) >= 4), lambda w: substr(w, 1, 4)))) AS n_stems,
  md5('x ' || doc_id || ' y.') AS unmarked, md5('Body of ' || source) AS unlisted, lang || '|' || source AS aspects, 'Title ' || doc_id || '|Body [1]' AS post, 'First of ' || doc_id || '|Second.' || chr(10) || chr(10) || 'Rest' AS headed,
  doc_id % 2 = 1 AS dump, greatest(700, doc_id * 5 // 1 + 300) AS tokens, [2] AS used, '[a](https://x.org) b' AS links, 'bold ' || doc_id || ' at s (https://s.org)' AS plain, ['meet', 'qx', 'zorg' || doc_id % 7] AS names FROM e""")
def texts_of_documents(spark, sf_dir):
    """What the functions of text find in documents, and in short texts made of them."""
    d, t = F.col("doc_id"), F.coalesce("text", F.lit(""))
    post = T.written_post(_c("```\n# Title ", d, "\n\nBody [1]\n\nSources:\n- x\n```"))
    head = T.headline(_c("**First of ", d, ". Second.**"), F.lit("Rest"))
    dump = F.when(d % 2 == 1, "[1] One part of it.\n\n[2] Other part.").otherwise("One text [1] of its own.")
    return read(spark, sf_dir, "documents").select(
        "doc_id", F.size(T.sentences(t)).cast("long").alias("n_sentences"), F.size(T.numbers(t)).cast("long").alias("n_numbers"), T.list_items(t).cast("long").alias("n_items"), F.md5(T.truncated(t, 300).cast("binary")).alias("short"), F.md5(T.matching(t).cast("binary")).alias("matching"), F.size(T.stems(t)).cast("long").alias("n_stems"),
        F.md5(T.without_citations(_c("x [1] ", d, " [2] y [3].")).cast("binary")).alias("unmarked"), F.md5(T.without_footer(_c("Body of ", F.col("source"), "\n\n## Sources\n- a\n- b")).cast("binary")).alias("unlisted"), F.array_join(T.aspects(_c(F.col("lang"), ", ", F.col("source"), "; ", F.upper("lang"))), "|").alias("aspects"),
        F.concat_ws("|", post["title"], post["body"]).alias("post"), F.concat_ws("|", head["title"], head["body"]).alias("headed"), T.source_dump(dump, F.lit("nothing")).alias("dump"), T.answer_tokens(d * 10).alias("tokens"), T.used_citations(F.array(*map(F.lit, (1, 2, 3))), F.lit("see [2]")).alias("used"),
        T.keep_links(F.lit("[a](https://x.org) [b](https://y.org)"), ["https://x.org"]).alias("links"), T.plain(_c("**bold ", d, "** at [s](https://s.org)")).alias("plain"), T.entities(_c("Meet Zorg", d % 7, " in QX")).alias("names"),
    )
