"""Queries of the connectors over small documents; the expected rows are written by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.sources import connectors as C
from tideline.sources import markup as M
from tideline.plans.queries import case, query, read

NOW = "2024-02-01 00:00:00"

RSS = """<rss xmlns:media="http://search.yahoo.com/mrss/"><channel><title>Feed</title>
<item><title> A &amp; B </title><link>http://x.org/1</link><description>&lt;p&gt;Hi &lt;b&gt;you&lt;/b&gt;&lt;/p&gt; Read more here</description><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate><media:content url="http://x.org/1.jpg" medium="image"/></item>
<item><title></title><link>http://x.org/none</link></item>
<item><title>C</title><link>http://x.org/2</link><description>&lt;img src="http://x.org/s.png" width="20"&gt;&lt;img src="http://x.org/l.png" width="300"&gt;text</description></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>D</title><link rel="self" href="http://x.org/self"/><link rel="alternate" href="http://x.org/3"/><updated>2024-01-03T08:00:00Z</updated><content type="html">&lt;table&gt;&lt;tr&gt;&lt;td&gt;1&lt;/td&gt;&lt;td&gt;2&lt;/td&gt;&lt;/tr&gt;&lt;/table&gt;</content><summary>short</summary></entry></feed>"""
VIDEOS = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:yt="http://v/" xmlns:media="http://m/"><entry><yt:videoId>abcdefghijk</yt:videoId><title>V</title><link rel="alternate" href="https://www.youtube.com/watch?v=abcdefghijk"/><author><name>Me</name></author><published>2024-01-02T03:04:05+00:00</published>
<media:group><media:thumbnail url="http://t/1.jpg"/><media:description>About it</media:description><media:community><media:starRating count="12"/><media:statistics views="3456"/></media:community></media:group></entry><entry><title>No id</title><link href="http://x.org/v"/></entry></feed>"""
FORUM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Own</title><link href="https://www.reddit.com/r/s/1"/><content type="html">&lt;div class="md"&gt;&lt;p&gt;My text&lt;/p&gt;&lt;/div&gt;&lt;a href="https://www.reddit.com/r/s/1"&gt;[link]&lt;/a&gt;</content></entry>
<entry><title>Away</title><link href="https://www.reddit.com/r/s/2"/><content type="html">&lt;a href="http://x.org/story"&gt;[link]&lt;/a&gt;</content></entry><entry><title>Film</title><link href="https://www.reddit.com/r/s/3"/><content type="html">&lt;a href="https://youtu.be/abcdefghijk"&gt;[link]&lt;/a&gt;</content></entry></feed>"""
SEARCH = '{"results":[{"url":"http://www.x.org/a","title":"<b>One</b> two","content":"c  d","publishedDate":"2024-01-05T00:00:00","engine":"e","views":7},{"url":"http://www.x.org/a","title":"again"},{"url":"ftp://x","title":"no"},{"url":"https://y.org/b","title":""},{"url":"https://youtu.be/abcdefghijk","title":"Film"}]}'
OPML = '<opml><body><outline text="Group"><outline title="One" xmlUrl="http://a.org/f"/><outline text="Two" xmlUrl="http://b.org/f"/><outline text="Again" xmlUrl="http://a.org/f"/><outline xmlUrl="ftp://c"/></outline></body></opml>'
PAGE = """<html><head><link rel="alternate" type="application/rss+xml" href="/feed"><link rel="alternate" type="application/atom+xml" href="http://o.org/atom"><link rel="alternate" type="application/rss+xml" href="/feed"><link rel="stylesheet" href="/s.css"></head>
<body><nav><a href="/nav-item-here">Navigation with many long words</a></nav><header>Head</header><main><p>Own text &amp; more</p><a href="/2024/a-long-story#top">A headline of <b>several</b> words</a><a href="/2024/a-long-story">A headline of several words again</a><a href="/news">A headline of several words</a><a href="/tag/x-y">A headline of several words</a><a href="http://other.org/a-b-c">A headline of several words</a>
<a href="/a-b-c">short one</a><a href="/big-story-9">Another headline with words</a><a href="https://github.com/a/b">the code</a><a href="https://acme.dev">Official website</a><form>Form</form><script>var a="</p>"</script></main><footer><a href="https://github.com/c/d">footer code</a>Foot</footer></body></html>"""
CHANNEL = """<div class="tgme_widget_message" data-post="name/11"><a class="tgme_widget_message_photo_wrap" style="background-image:url('http://p/1.jpg')"></a><div class="tgme_widget_message_text">First line<br>second <b>line</b></div><span class="tgme_widget_message_views">1.2K</span><time datetime="2024-01-04T05:06:07+00:00"></time><span class="tgme_reaction"><i>x</i>12</span><span class="tgme_reaction"><i>y</i>1.5K</span></div>
<div class="tgme_widget_message" data-post="name/12"><span class="tgme_widget_message_views">30</span></div>"""


def documents(spark):
    rows = [("rss", "http://x.org/", RSS), ("atom", "http://x.org/", ATOM), ("videos", "", VIDEOS), ("forum", "s", FORUM), ("search", "", SEARCH), ("opml", "", OPML), ("page", "http://www.x.org/", PAGE), ("channel", "name", CHANNEL), ("none", "", None), ("broken", "http://x.org", "<a <b")]
    return spark.createDataFrame(rows, "kind string, url string, content string")


def _values(columns: str, rows: list[tuple]) -> str:
    def one(x) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") t({columns})"


def _shown(items):
    return items.select("title", "url", "text", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"), "image_url", "publisher", F.col("items.kind").alias("kind"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries("meta")))).alias("meta"))


_ITEM = "title, url, text, published, image_url, publisher, kind, meta"


def _of(spark, kind: str):
    return documents(spark).where(F.col("kind") == kind).withColumnRenamed("kind", "source")


def _plain(items):
    return _shown(items.alias("items"))


@case(_values(_ITEM, [("A & B", "http://x.org/1", "Hi you", "2024-01-01 10:00:00", "http://x.org/1.jpg", None, "article", "{}"), ("C", "http://x.org/2", "text", "2024-02-01 00:00:00", "http://x.org/l.png", None, "article", "{}"), ("D", "http://x.org/3", "1; 2", "2024-01-03 08:00:00", None, None, "article", "{}")]))
def feed_items(spark, sf_dir):
    docs = documents(spark).where("kind in ('rss', 'atom', 'none', 'broken')").withColumnRenamed("kind", "source")
    return _plain(C.feed(docs, "source", "content", NOW))


@case(_values(_ITEM, [("V", "https://www.youtube.com/watch?v=abcdefghijk", "About it", "2024-01-02 03:04:05", "http://t/1.jpg", "Me", "video", '{"author":"Me","likes":"12","video_id":"abcdefghijk","views":"3456"}')]))
def video_items(spark, sf_dir):
    return _plain(C.videos(_of(spark, "videos"), "source", "content", NOW))


@case(_values(_ITEM, [
    ("Own", "https://www.reddit.com/r/s/1", "My text", "2024-02-01 00:00:00", None, "r/s", "post", '{"permalink":"https://www.reddit.com/r/s/1"}'),
    ("Away", "http://x.org/story", "", "2024-02-01 00:00:00", None, "r/s", "article", '{"permalink":"https://www.reddit.com/r/s/2"}'),
    ("Film", "https://www.youtube.com/watch?v=abcdefghijk", "", "2024-02-01 00:00:00", None, "r/s", "video", '{"permalink":"https://www.reddit.com/r/s/3"}'),
]))
def forum_items(spark, sf_dir):
    return _plain(C.discussions(_of(spark, "forum"), "source", "content", "url", NOW))


@case(_values(_ITEM, [("One two", "http://www.x.org/a", "c d", "2024-01-05 00:00:00", None, "x.org", "article", '{"engine":"e","views":"7"}'), ("Film", "https://youtu.be/abcdefghijk", "", "2024-02-01 00:00:00", None, "youtu.be", "article", "{}")]))
def search_items(spark, sf_dir):
    return _plain(C.searched(_of(spark, "search"), "source", "content", NOW))


@case(_values(_ITEM, [("Film", "https://www.youtube.com/watch?v=abcdefghijk", "", "2024-02-01 00:00:00", "https://i.ytimg.com/vi/abcdefghijk/hqdefault.jpg", "youtu.be", "video", '{"video_id":"abcdefghijk"}')]))
def search_videos(spark, sf_dir):
    return _plain(C.found_videos(C.searched(_of(spark, "search"), "source", "content", NOW)))


@case(_values("url, name", [("http://a.org/f", "One"), ("http://b.org/f", "Two")]))
def reading_list(spark, sf_dir):
    return C.subscriptions(_of(spark, "opml"), "source", "content").select("url", "name")


@case(_values("href", [("http://www.x.org/feed",), ("http://o.org/atom",)]))
def feed_addresses(spark, sf_dir):
    return C.feeds_of(_of(spark, "page"), "source", "content", "url").select("href")


@case(_values("url, title", [("http://www.x.org/2024/a-long-story", "A headline of several words"), ("http://www.x.org/big-story-9", "Another headline with words")]))
def listing_articles(spark, sf_dir):
    return C.articles(_of(spark, "page"), "source", "content", "url").select("url", "title")


@case(_values("url, kind, label", [("https://github.com/a/b", "repo", "b"), ("https://acme.dev", "official", "acme.dev")]))
def useful_links(spark, sf_dir):
    return C.useful_links(_of(spark, "page"), "source", "content", "url").select("url", "kind", "label")


@case(_values(_ITEM, [("First line", "https://t.me/name/11", "First line\nsecond line", "2024-01-04 05:06:07", "http://p/1.jpg", "@name", "post", '{"channel":"name","views":"1200"}')]))
def channel_items(spark, sf_dir):
    return _plain(C.channel(_of(spark, "channel"), "source", "content", "url", NOW))


@case("SELECT CAST(m AS BIGINT) AS message_id, CAST(v AS BIGINT) AS views, CAST(r AS BIGINT) AS reactions FROM (VALUES (11, 1200, 1512), (12, 30, 0)) t(m, v, r)")
def channel_numbers(spark, sf_dir):
    return C.channel_stats(_of(spark, "channel"), "source", "content").select("message_id", "views", "reactions")


@query(r"""WITH a AS (SELECT page_id, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '</?(p|div|li|tr|h[1-6]|blockquote|br|td|th)[ >][^<]*?>|<(br|/p|/div|/li|/h[1-6]|/tr|/blockquote|/td|/th)>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM a)
SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS h FROM b""")
def page_texts(spark, sf_dir):
    return C.own_texts(read(spark, sf_dir, "pages"), "page_id", "html").select("page_id", F.md5("text").alias("h"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN ['news', 'curated'][doc_id % 3 + 1] WHEN doc_id % 5 < 2 THEN ['news', 'curated'][doc_id % 5 + 1] WHEN lang IN ('en', 'de') THEN 'news' ELSE 'curated' END AS mode FROM documents")
def item_modes(spark, sf_dir):
    d = F.col("doc_id")
    pick = lambda n: F.when(d % n == 0, "news").when(d % n == 1, "curated").otherwise("mixed")
    return read(spark, sf_dir, "documents").select("doc_id", C.mode(pick(3), F.when(F.col("lang").isin("en", "de"), "rss").otherwise("site"), pick(5)).alias("mode"))


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '\\s*;\\s*;+', ';', 'g'), '\\s+', ' ', 'g'), ' ;')) AS h FROM documents WHERE text NOT LIKE '%<%' AND text NOT LIKE '%&%'")
def stripped_texts(spark, sf_dir):
    """Plain texts pass the markup filter as they are."""
    docs = read(spark, sf_dir, "documents").where("text not like '%<%' and text not like '%&%'")
    rows = C.parsed(docs, "doc_id", "text", lambda raw: [{"text": M.stripped(raw)}], "text string").select("doc_id", "text")
    return docs.select("doc_id").join(rows, "doc_id", "left").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
