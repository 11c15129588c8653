"""What a writer gets and what is published of it, as queries over documents (items; sources are stories, languages publishers) and conversations (posts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.functions import vectors as V
from tideline.operators import context, generation
from tideline.plans.queries import query, read

LETTERS = ["e", "a", "n", "o"]
#: White space as Java's Unicode class has it, squeezed; sentences of a squeezed text, cut before a capital, digit or opening sign.
_SPACE = r"[\s\x0B\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _sentences(text: str) -> str:
    squeezed = f"trim(regexp_replace({text}, '{_SPACE}', ' ', 'g'))"
    cut = rf"""regexp_replace({squeezed}, '([.!?…]) ([«"(\[]?[А-ЯЁA-Z0-9])', '\1' || chr(1) || '\2', 'g')"""
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda x: trim(x)), lambda x: length(x) > 1)"


def _letters(text):
    return F.array(*[F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in LETTERS])


def _near(sentences, centroid):
    return F.transform(sentences, lambda s: F.round(V.cosine(_letters(s), centroid), 6))


@query(f"""WITH x AS (SELECT doc_id, {_sentences("text")} AS s FROM documents WHERE length(text) >= 6000),
c AS (SELECT *, sum(z) OVER (PARTITION BY doc_id ORDER BY i) AS upto, sum(z) OVER (PARTITION BY doc_id) AS total
  FROM (SELECT doc_id, i, s[CAST(i AS INT)] AS t, length(s[CAST(i AS INT)]) + 1 AS z, len(s) AS n FROM x, LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i) r)),
h AS (SELECT doc_id, any_value(n) AS n, any_value(total) AS total, count(*) FILTER (upto <= 3000) AS head, coalesce(max(upto) FILTER (upto <= 3000), 0) AS used FROM c GROUP BY doc_id),
k AS (SELECT *, CAST(greatest(1, floor((12000 - used) / ((total - used) / CAST(n - head AS DOUBLE) + 2))) AS BIGINT) AS cnt FROM h WHERE total > 12000),
p AS (SELECT DISTINCT doc_id, head, used, head + (j * (n - head)) // cnt + 1 AS i FROM k, LATERAL (SELECT unnest(range(0, cnt)) AS j) r),
g AS (SELECT p.doc_id, p.i, p.used, CASE WHEN p.i = coalesce(lag(p.i) OVER (PARTITION BY p.doc_id ORDER BY p.i), p.head) + 1 THEN '' ELSE '… ' END || c.t AS t FROM p JOIN c ON c.doc_id = p.doc_id AND c.i = p.i),
m AS (SELECT doc_id, i, t, used + sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM g),
kept AS (SELECT doc_id, i, t FROM m WHERE upto <= 12000 UNION ALL SELECT c.doc_id, c.i, c.t FROM c JOIN h USING (doc_id) WHERE h.total <= 12000 OR c.i <= h.head)
SELECT x.doc_id, count(t) AS n_sentences, CAST(coalesce(sum(length(t) + 1), 0) AS BIGINT) AS n_chars, md5(coalesce(string_agg(t, chr(10) ORDER BY i), '')) AS picked FROM x LEFT JOIN kept USING (doc_id) GROUP BY x.doc_id""")
def longread_context(spark, sf_dir):
    """Long documents within 12 000 characters: the first quarter of them as it stands, the rest sampled evenly."""
    long = read(spark, sf_dir, "documents").where(F.length("text") >= context.LONG).select("doc_id", T.sentences("text").alias("s"))
    found = context.spread(long, "s")
    return found.select("doc_id", F.size("picked").cast("long").alias("n_sentences"), context.total(context.sizes(F.col("picked"))).alias("n_chars"), F.md5(F.array_join("picked", "\n").cast("binary")).alias("picked"))


_V = "[" + ", ".join(f"CAST(length({{0}}) - length(replace({{0}}, '{c}', '')) AS DOUBLE)" for c in LETTERS) + "]"
_COS = "CASE WHEN list_sum(list_transform({0}, lambda q: q * q)) = 0 OR list_sum(list_transform({1}, lambda q: q * q)) = 0 THEN 0 ELSE list_cosine_similarity({0}, {1}) END"
_BLOCKS = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, lang, coalesce(text, '') AS text, {_V.format("coalesce(text, '')")} AS v FROM documents),
c AS (SELECT source, [{", ".join(f"avg(v[{i}])" for i in range(1, len(LETTERS) + 1))}] AS c FROM d GROUP BY source),
r AS (SELECT d.*, c.c, round({_COS.format("v", "c.c")}, 6) AS relevance FROM d JOIN c USING (source)),
a AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY relevance DESC, doc_id) <= 2),
b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY relevance DESC, doc_id) AS n FROM a QUALIFY n <= 6),
e AS (SELECT *, count(*) OVER (PARTITION BY source) AS items FROM b),
k AS (SELECT *, CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN 24 WHEN items = 1 THEN 12 ELSE 3 END AS k, CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN 120 WHEN items = 1 THEN 40 ELSE 14 END AS scan, {_sentences("text")} AS own FROM e),
s AS (SELECT * EXCLUDE (own), CASE WHEN len(own) = 0 THEN [CASE WHEN doc_id % 5 = 0 THEN 'Top 10 things' ELSE 'Item' END] ELSE own[1:scan] END AS s FROM k),
u AS (SELECT s.doc_id, s.source, s.n, s.items, s.k, len(s.s) AS m, i, s.s[CAST(i AS INT)] AS t, s.c AS c FROM s, LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i) x),
w AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id, i = 1 ORDER BY round({_COS.format(_V.format("t"), "c")}, 6) DESC, i DESC) AS place FROM u),
j AS (SELECT source, n, doc_id, any_value(greatest(300, 7000 // items)) AS cap, string_agg(t, ' ' ORDER BY i) AS t FROM w WHERE m <= k OR i = 1 OR place <= k - 1 GROUP BY source, n, doc_id),
x AS (SELECT *, regexp_extract(substr(t, 1, CAST(cap AS INT)), '^((?s).*[.!?]) ', 1) AS whole FROM j),
y AS (SELECT source, n, doc_id, CASE WHEN length(t) <= cap THEN t WHEN length(whole) - 1 > cap / 2 THEN whole ELSE rtrim(substr(t, 1, CAST(cap AS INT))) || '…' END AS t FROM x),
z AS (SELECT source, n, doc_id, CASE WHEN len({_sentences("t")}) > 0 THEN {_sentences("t")} ELSE [t] END AS picked FROM y)
"""


def _blocks(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text")).withColumn("v", _letters(F.col("text")))
    centroids = docs.groupBy("source").agg(F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(len(LETTERS))]).alias("centroid"))
    rows = docs.join(centroids, "source").withColumn("relevance", F.round(V.cosine("v", "centroid"), 6))
    title, mode = F.when(F.col("doc_id") % 5 == 0, "Top 10 things").otherwise("Item"), F.when(F.col("doc_id") % 7 == 0, "curated").otherwise("news")
    items = rows.select(F.col("source").alias("story"), F.col("doc_id").alias("item_id"), F.col("lang").alias("source"), title.alias("title"), "text", "centroid", "relevance", mode.alias("mode"))
    return context.blocks(items, likeness=_near)


@query(_BLOCKS + "SELECT source AS story, n, doc_id, len(picked) AS n_sentences, md5(array_to_string(picked, chr(10))) AS picked FROM z")
def context_blocks(spark, sf_dir):
    """The items that a writer gets for each source, and their sentences."""
    return _blocks(spark, sf_dir).select("story", F.col("n").cast("long").alias("n"), F.col("item_id").alias("doc_id"), F.size("picked").cast("long").alias("n_sentences"), F.md5(F.array_join("picked", "\n").cast("binary")).alias("picked"))


@query(_BLOCKS + r""", l AS (SELECT source, n, t, row_number() OVER (PARTITION BY source ORDER BY n, i) AS i, list_distinct(regexp_extract_all(lower(t), '[\p{L}\p{N}_]+')) AS w FROM (SELECT source, n, i, picked[CAST(i AS INT)] AS t FROM z, LATERAL (SELECT unnest(range(1, len(picked) + 1)) AS i) q)),
f(source, i, kept) AS (
  SELECT DISTINCT source, CAST(0 AS BIGINT), CAST([] AS STRUCT(t VARCHAR, nums BIGINT[], w VARCHAR[])[]) FROM l
  UNION ALL
  SELECT source, i, CASE WHEN len(w) = 0 THEN kept
    WHEN hit IS NOT NULL THEN list_transform(kept, lambda k, pos: CASE WHEN pos = hit AND len(k.nums) < 3 AND NOT list_contains(k.nums, n) THEN {'t': k.t, 'nums': list_append(k.nums, n), 'w': k.w} ELSE k END)
    WHEN len(kept) < 4 THEN list_append(kept, {'t': t, 'nums': [n], 'w': w}) ELSE kept END
  FROM (SELECT l.source, l.i, l.n, l.t, l.w, f.kept, list_min(list_filter(list_transform(f.kept, lambda k, pos: CASE WHEN len(list_intersect(k.w, l.w)) / len(list_distinct(list_concat(k.w, l.w))) >= 0.6 THEN pos END), lambda pos: pos IS NOT NULL)) AS hit
    FROM f JOIN l ON l.source = f.source AND l.i = f.i + 1) q),
o AS (SELECT source, array_to_string(list_transform(kept, lambda k: k.t || ' ' || array_to_string(list_transform(k.nums, lambda q: '[' || q || ']'), '')), ' ') AS t FROM f QUALIFY row_number() OVER (PARTITION BY source ORDER BY i DESC) = 1),
v AS (SELECT *, regexp_extract(substr(t, 1, 900), '^((?s).*[.!?]) ', 1) AS whole FROM o)
SELECT source AS story, CASE WHEN length(t) <= 900 THEN t WHEN length(whole) - 1 > 450 THEN whole ELSE rtrim(substr(t, 1, 900)) || '…' END AS body FROM v""")
def extractive_posts(spark, sf_dir):
    """A post for each source of the sentences that lead its items, the same ones merged."""
    return generation.extractive(_blocks(spark, sf_dir), 900)


@query(rf"""WITH c AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS asked, arg_min(text, turn) FILTER (role = 'assistant') AS said FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, CASE WHEN conv_id % 11 = 0 THEN ' ' WHEN conv_id % 17 = 0 THEN 'Top 5 things' ELSE 'About: ' || substr(coalesce(asked, ''), 1, 20) END AS title, CASE WHEN conv_id % 2 = 0 THEN replace(coalesce(said, ''), '. ', ' [' || (conv_id % 5 + 1) || ']. ') ELSE coalesce(said, '') END AS body,
    conv_id % 4 AS n, CASE WHEN conv_id % 4 = 3 THEN 'article' ELSE 'news' END AS fmt, CASE WHEN conv_id % 7 <> 0 THEN conv_id % 10 END AS interest, conv_id % 13 = 0 AS ru FROM c),
q AS (SELECT *, length(regexp_replace(body, '[^\pL]', '', 'g')) AS letters, length(regexp_replace(body, '[^\p{{Latin}}]', '', 'g')) AS latin, length(regexp_replace(body, '[^\p{{Cyrillic}}]', '', 'g')) AS cyrillic,
    len(list_distinct(regexp_extract_all(lower(body), '[\pL\pN_]+'))) AS words, {_sentences("body")} AS s, trim(body, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM p),
x AS (SELECT *, letters >= 20 AND words >= 4 AND (CASE WHEN ru THEN cyrillic ELSE latin END) / letters < 0.4 AS other,
    list_filter(s, lambda a: len(regexp_extract_all(regexp_replace(a, ' \[\d+\]', '', 'g'), '[\pL\pN_]+')) >= 4) AS long,
    list_filter(list_distinct(list_transform(regexp_extract_all(body, '\[(\d+)\]', 1), lambda a: CAST(a AS INT))), lambda a: a < 1 OR a > n) AS invalid FROM q),
y AS (SELECT *, CASE WHEN len(long) = 0 THEN 1.0 ELSE round(len(list_filter(long, lambda a: regexp_matches(a, '\[\d+\]'))) / len(long), 2) END AS coverage FROM x),
z AS (SELECT conv_id, fmt, other, n, list_filter([CASE WHEN trim(title) = '' THEN 'no title' END, CASE WHEN t = '' THEN 'no text' END, CASE WHEN t <> '' AND length(t) < 80 THEN 'short text' END, CASE WHEN n = 0 THEN 'no sources' END,
    CASE WHEN n = 1 AND conv_id % 3 = 0 AND conv_id * 37 % 1600 < 800 THEN 'note without its article' END, CASE WHEN t <> '' AND other THEN 'other language' END, CASE WHEN len(invalid) > 0 THEN 'invalid citations' END,
    CASE WHEN fmt = 'news' AND coverage < 0.5 THEN 'low coverage' END, CASE WHEN length(body) > 400 THEN 'too long' END,
    CASE WHEN conv_id % 17 = 0 AND conv_id % 11 <> 0 AND len(regexp_extract_all(body, '(?m)^[ \t]*(?:[•\-–—*▪]|\d{{1,2}}[.)])[ \t]+[^\s]')) < 5 THEN 'list mismatch' END, CASE WHEN interest < 3 THEN 'low interest' END], lambda a: a IS NOT NULL) AS reasons FROM y)
SELECT conv_id, fmt, array_to_string(reasons, '; ') AS reasons,
  len(reasons) = 0 OR conv_id % 3 = 1 AND len(list_intersect(reasons, ['no title', 'no text', 'short text', 'no sources', 'note without its article', 'other language', 'low interest', 'list mismatch'])) = 0 AS published,
  CASE WHEN conv_id % 9 = 0 THEN 'extractive' WHEN other THEN 'llm' WHEN conv_id % 3 = 0 THEN 'extractive' WHEN conv_id % 3 = 1 OR fmt <> 'news' OR n >= 2 THEN 'llm' ELSE 'extractive' END AS writer FROM z""")
def reviewed_posts(spark, sf_dir):
    """First answers of conversations as posts: their format, the reasons against them, whether they go out, who would have written them."""
    first = lambda role: F.min_by("text", F.when(F.col("role") == role, F.col("turn")))
    convs = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(first("user").alias("asked"), first("assistant").alias("said"))
    c = F.col("conv_id")
    said = F.coalesce("said", F.lit(""))
    title = F.when(c % 11 == 0, " ").when(c % 17 == 0, "Top 5 things").otherwise(F.concat(F.lit("About: "), F.substring(F.coalesce("asked", F.lit("")), 1, 20)))
    body = F.when(c % 2 == 0, F.replace(said, F.lit(". "), F.concat(F.lit(" ["), c % 5 + 1, F.lit("]. ")))).otherwise(said)
    posts = convs.select("conv_id", title.alias("title"), body.alias("body"), (c % 4).cast("int").alias("n"), F.when(c % 7 != 0, c % 10).alias("interest"))
    fmt = generation.content_format(F.when(c % 4 == 3, "curated").otherwise("news"), F.array(F.lit("article")))
    other = F.when(c % 13 == 0, T.other_script("body", "Cyrillic")).otherwise(T.other_script("body", "Latin"))
    source = F.struct(F.when(c % 3 == 0, "failed").otherwise("done").alias("article_status"), (c * 37 % 1600).alias("length"))
    valid = F.when(F.col("n") > 0, F.sequence(F.lit(1), F.greatest("n", F.lit(1)))).otherwise(F.array().cast("array<int>"))
    posts = posts.withColumns({"fmt": fmt, "other": other, "citations": F.array_repeat(source, F.col("n")), "checks": T.citation_check("body", valid)})
    reasons = generation.review(F.col("title"), F.col("body"), F.col("citations"), F.col("checks"), F.lit(400), F.col("other"), F.lit("post"), F.col("fmt"), F.col("interest"), T.list_mismatch("title", "body"))
    posts = posts.withColumn("reasons", reasons)
    published = generation.may_publish(F.col("reasons"), F.when(c % 3 == 1, "full_auto").otherwise("auto"))
    by = generation.writer(F.when(c % 3 == 0, "extractive").when(c % 3 == 1, "llm").otherwise("auto"), c % 9 != 0, F.col("other"), F.col("n"), F.col("fmt"))
    return posts.select("conv_id", "fmt", F.array_join("reasons", "; ").alias("reasons"), published.alias("published"), by.alias("writer"))
