"""Tables of cases for functions of text and addresses: inputs here, the expected results written by hand as the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.functions import urls as U
from tideline.plans.queries import CASE_SQL, CASES

Case = tuple[str, str | None, str | None]


def _sql(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def cases(name: str, functions: dict[str, Callable[[Column], Column]], rows: list[Case]) -> None:
    """A query of (function, n, result) with results as text, JSON where they are not simple."""
    numbered = [(f, n, x) for n, (f, x, _) in enumerate(rows)]

    def run(spark, sf_dir):
        df = spark.createDataFrame(numbered, "function string, n long, x string")
        shown = None
        for f, make in functions.items():
            c = make(F.col("x"))
            kind = df.select(c.alias("c")).dtypes[0][1]
            c = F.to_json(c) if kind.startswith(("array", "struct", "map")) else c.cast("string")
            shown = F.when(F.col("function") == f, c) if shown is None else shown.when(F.col("function") == f, c)
        return df.select("function", "n", shown.alias("result"))

    run.__name__ = name
    CASES[name] = run
    CASE_SQL[name] = "SELECT * FROM (VALUES " + ", ".join(f"({_sql(f)}, CAST({n} AS BIGINT), {_sql(want)})" for n, (f, _, want) in enumerate(rows)) + ") t(function, n, result)"


cases(
    "text_cases",
    {
        "sentences": T.sentences, "numbers": T.numbers, "list_items": T.list_items, "promised": T.promised_count, "truncated": lambda x: T.truncated(x, 20),
        "entities": T.entities, "citations": lambda x: T.without_citations(x, [1, 3]), "footer": T.without_footer, "teaser": T.without_teaser, "aspects": T.aspects,
        "captions": T.captions, "views": T.count_of, "integer": T.whole_number, "matching": T.matching, "shingles": T.shingles, "stems": T.stems,
        "jaccard": lambda x: T.jaccard(T.words(F.substring_index(x, "|", 1)), T.words(F.substring_index(x, "|", -1))),
        "latin_asked": lambda x: T.other_script(x, "Latin"), "fingerprint": lambda x: T.content_hash(F.substring_index(x, "|", 1), F.substring_index(x, "|", -1)),
    },
    [
        ("sentences", "One here. Two there!  Three? yes. 4 more", '["One here.","Two there!","Three? yes.","4 more"]'),
        ("sentences", 'He said so. "Quoted" text. (In brackets) too. [1] last', '["He said so.","\\"Quoted\\" text.","(In brackets) too.","[1] last"]'),
        ("sentences", "a", "[]"),
        ("sentences", "Первое… Второе. третье", '["Первое…","Второе. третье"]'),
        ("numbers", "1 200 rubles, 3,5 percent and 3.5 or 12", '["1200","3.5","12"]'),
        ("list_items", "- one\n* two\n▪ three\n— four\n1. five\n12) six\nseven\n-eight", "6"),
        ("list_items", "", "0"),
        ("promised", "Top-10 services", "10"),
        ("promised", "14 лучших скиллов", "14"),
        ("promised", "7 инструментов для работы", "7"),
        ("promised", "Вышли 3 игры", None),
        ("promised", "2 best tools", None),
        ("truncated", "Short enough.", "Short enough."),
        ("truncated", "It is a one. And then more of it", "It is a one."),
        ("truncated", "A. and then much more of it", "A. and then much mor…"),
        ("entities", "The new iPhone AI from php team uses C++ and Steam", '["c++","iphone","php","team","uses"]'),
        ("entities", "Киев встречает Москву и «Газпром»", '["газп","моск"]'),
        ("entities", "RTX5090 and E-Day on 4K", '["e-day","rtx5090"]'),
        ("entities", None, "[]"),
        ("citations", "It grew [1][2] fast [3]. a[0] and b[1] stay", "It grew fast. a[0] and b stay"),
        ("footer", "Text here\n\nSources:\n1. a", "Text here"),
        ("footer", "Text of sources stays", "Text of sources stays"),
        ("footer", "One\nReferences\nTwo\n## Источники и материалы: x\nThree", "One\nReferences\nTwo"),
        ("teaser", "Some text. Read more at the site", "Some text."),
        ("teaser", "Текст. Читать далее...", "Текст."),
        ("aspects", "ML, data; ML: ml. Games ", '["ML","data","Games"]'),
        ("captions", "[Music] hello [applause] world.", "hello world."),
        ("captions", " ".join(["word"] * 45), " ".join(["word"] * 30) + ". " + " ".join(["word"] * 15) + "."),
        ("views", "1.2K", "1200"),
        ("views", "3,45m", "3450000"),
        ("views", "17", "17"),
        ("views", "many", None),
        ("integer", "1,234,567", "1234567"),
        ("integer", "12a", None),
        ("matching", "Hello, World!  #Tag", "hello world tag"),
        ("shingles", "ab", '["ab"]'),
        ("shingles", "Abcde!", '["abcd","bcde"]'),
        ("shingles", "", "[]"),
        ("stems", "Running runs fast fastest", '["runn","runs","fast"]'),
        ("jaccard", "a b c|b c d", "0.5"),
        ("jaccard", "|", "0.0"),
        ("latin_asked", "Это русский текст, в нём много разных слов", "true"),
        ("latin_asked", "This is a plain English text with words", "false"),
        ("latin_asked", "коротко", "false"),
        ("fingerprint", "Hello  World|some\ttext", "419c29ed9cb0ef2334f1a324b7b361a3"),
    ],
)

cases(
    "url_cases",
    {
        "normalized": U.normalized_url, "video": U.video_id, "video_source": U.video_source, "site": U.site, "brand": U.brand, "link": lambda x: U.link(F.substring_index(x, "|", 1), F.regexp_extract(x, r"\|(.*)$", 1)),
        "best": lambda x: U.best_link(F.filter(F.transform(F.split(x, " "), lambda y: U.link(y)), lambda s: s.isNotNull()))["url"],
        "merged": lambda x: F.transform(U.merged_links(U.link(F.substring_index(x, " ", 1)), F.filter(F.transform(F.split(x, " "), lambda y: U.link(y)), lambda s: s.isNotNull()), 3), lambda s: s["url"]),
        "image": U.image_key, "channel": U.channel_name, "subreddit": U.subreddit, "search": lambda x: U.news_search(F.substring_index(x, "|", 1), F.substring_index(x, "|", -1)), "news": U.news_address, "blocked": lambda x: U.blocked(x, ["bad.com", "worse.org"]),
    },
    [
        ("normalized", "HTTPS://Example.COM/Path/?utm_source=x&q=a b&flag&UTM_Medium=y#top", "https://example.com/Path?q=a+b&flag="),
        ("normalized", "http://example.com", "http://example.com/"),
        ("normalized", "http://example.com/a//?ref=1", "http://example.com/a"),
        ("normalized", "http://example.com/?x=1&x=%D0%B0~*", "http://example.com/?x=1&x=%D0%B0~%2A"),
        ("normalized", " example.com/a/ ", "example.com/a"),
        ("normalized", "", "/"),
        ("video", "https://www.youtube.com/watch?v=abcdefghijk&t=3", "abcdefghijk"),
        ("video", "https://youtu.be/abcdefghijk?si=1", "abcdefghijk"),
        ("video", "https://m.youtube.com/shorts/abc_efg-ijk", "abc_efg-ijk"),
        ("video", "https://example.com/watch?v=abcdefghijk", ""),
        ("video", "https://www.youtube.com/watch?v=short", ""),
        ("video_source", "UCabcdefghijklmnopqrstuv", '{"kind":"channel","value":"UCabcdefghijklmnopqrstuv"}'),
        ("video_source", "@handle.name", '{"kind":"handle","value":"@handle.name"}'),
        ("video_source", "youtube.com/@handle/videos", '{"kind":"handle","value":"@handle"}'),
        ("video_source", "https://youtube.com/c/Some/about", '{"kind":"handle","value":"c/Some"}'),
        ("video_source", "https://www.youtube.com/playlist?list=PL1", '{"kind":"playlist","value":"PL1"}'),
        ("video_source", "how to cook", '{"kind":"search","value":"how to cook"}'),
        ("video_source", "https://youtube.com/feed", None),
        ("site", "https://blog.modal.com/x", "modal.com"),
        ("site", "https://news.bbc.co.uk", "bbc.co.uk"),
        ("brand", "https://deepmind.google/x", "deepmind"),
        ("link", "https://github.com/features/actions|", None),
        ("link", "https://www.github.com/apache/spark.git/tree|", '{"url":"https://github.com/apache/spark","kind":"repo","label":"spark"}'),
        ("link", "https://huggingface.co/datasets/a/b/c|", '{"url":"https://huggingface.co/datasets/a/b","kind":"dataset","label":"b"}'),
        ("link", "https://huggingface.co/a/b|", '{"url":"https://huggingface.co/a/b","kind":"model","label":"b"}'),
        ("link", "https://huggingface.co/docs/b|official site", None),
        ("link", "https://arxiv.org/pdf/1234.5678.pdf|", '{"url":"https://arxiv.org/abs/1234.5678","kind":"paper","label":"arXiv"}'),
        ("link", "https://play.google.com/store/apps/details?id=1|", '{"url":"https://play.google.com/store/apps/details?id=1","kind":"store","label":"Google Play"}'),
        ("link", "https://acme.dev/|the Official site", '{"url":"https://acme.dev/","kind":"official","label":"acme.dev"}'),
        ("link", "https://www.reddit.com/r/x|official page", None),
        ("link", "https://acme.dev/|read this", None),
        ("best", "https://arxiv.org/abs/1 https://example.com https://github.com/a/b https://github.com/c/d", "https://github.com/a/b"),
        ("merged", "https://github.com/a/b https://arxiv.org/abs/1 https://github.com/a/b https://arxiv.org/abs/2 https://arxiv.org/abs/3", '["https://github.com/a/b","https://arxiv.org/abs/1","https://arxiv.org/abs/2"]'),
        ("image", "https://h/THUMB.width-1300.png", "thumb"),
        ("image", "https://h/a/photo-1024x768.jpg?x=1", "photo"),
        ("channel", "https://t.me/s/Some_name?before=1", "Some_name"),
        ("channel", "@Some_name", "Some_name"),
        ("subreddit", "https://www.reddit.com/r/python/", "python"),
        ("search", "ai & data|de", "https://news.google.com/rss/search?q=ai+%26+data&hl=de&gl=DE&ceid=DE%3Ade"),
        ("search", "x|en-GB", "https://news.google.com/rss/search?q=x&hl=en&gl=US&ceid=US%3Aen"),
        ("news", "CBMiFWh0dHBzOi8vZXhhbXBsZS5jb20vYQ", "https://example.com/a"),
        ("blocked", "https://a.bad.com/x", "true"),
        ("blocked", "https://notbad.com/x", "false"),
    ],
)

cases(
    "markup_cases",
    {
        "plain": T.plain, "visible": T.visible, "html": T.html, "keep": lambda x: T.keep_links(x, ["https://a.b/c"]), "post": T.written_post, "headline": lambda x: T.headline(F.substring_index(x, "|", 1), F.substring_index(x, "|", -1), 40),
        "dump": lambda x: T.source_dump(F.substring_index(x, "|", 1), F.substring_index(x, "|", -1)), "mismatch": lambda x: T.list_mismatch(F.substring_index(x, "|", 1), F.substring_index(x, "|", -1)), "tokens": lambda x: T.answer_tokens(x.try_cast("int")), "used": lambda x: T.used_citations(F.array(F.lit(1), F.lit(2), F.lit(3)), x),
        "check": lambda x: T.citation_check(x, F.array(F.lit(1), F.lit(2))), "footer": lambda x: T.footer(F.split(F.substring_index(x, "|", 1), ","), F.split(F.substring_index(x, "|", -1), ","), "Sources"),
    },
    [
        ("plain", "**Bold** and [text](https://a.b/c)", "Bold and text (https://a.b/c)"),
        ("visible", "**Bold** and [text](https://a.b/c) ** not **", "Bold and text ** not **"),
        ("html", "**A<b** [x & y](https://a.b/?q=1&r=2)", '<b>A&lt;b</b> <a href="https://a.b/?q=1&amp;r=2">x &amp; y</a>'),
        ("keep", "[one](https://a.b/c) [two](https://a.b/cd)", "[one](https://a.b/c) two"),
        ("post", "```\n\n# Title here\nBody [1]\n\nSources:\nx\n```", '{"title":"Title here","body":"Body [1]"}'),
        ("post", "Заголовок: «Имя»\nтекст", '{"title":"Имя","body":"текст"}'),
        ("headline", "Short title.|Body", '{"title":"Short title","body":"Body"}'),
        ("headline", "One [1]. Two follows|Body", '{"title":"One","body":"Two follows\\n\\nBody"}'),
        ("headline", "A rather long headline, with a pause in it and more|", '{"title":"A rather long headline…","body":"A rather long headline, with a pause in it and more"}'),
        ("headline", "A headline without any pause that is long|B", '{"title":"A headline without any pause that is…","body":"A headline without any pause that is long\\n\\nB"}'),
        ("check", "This is a cited sentence [1]. This one has no such mark. Short one. And this has a wrong one [7].", '{"invalid_citations":[7],"citation_coverage":0.67,"length":97}'),
        ("footer", "https://a,https://b,https://a|A,,C", '\n\nSources: <a href="https://a">A</a>, <a href="https://b">https://b</a>'),
        ("footer", "|", ""),
        ("dump", "[1] one text\n\n[2] other text|x", "true"),
        ("dump", "The first has five words here. The second has five words too. The third is of my own making.|the first has five words here the second has five words too", "false"),
        ("dump", "The first has five words here [1]. The second has five words too. And the third has them.|The first has five words here. The second has five words too; and the third has them", "true"),
        ("mismatch", "Top 5 tools|- a\n- b", '{"promised":5,"listed":2}'),
        ("mismatch", "Top 3 tools|- a\n- b\n- c", None),
        ("tokens", "600", "700"),
        ("tokens", "1501", "1050"),
        ("used", "text [3] and [1] and [9]", "[1,3]"),
        ("used", "no marks", "[1,2,3]"),
    ],
)
