"""The queries op1 to op13 with production parameters, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import decontaminate, linededup, merkle, mixing, packing, phrases, prefixtrie, quality, repeats, simhash, toxicity, warc, wavelet
from tideline.llm.common import read, saved


def vocabulary(name: str) -> str:
    """Where the public_tokenizers package has a file; it is installed on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).withColumnRenamed("end", "end_at")


def op2_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compared_with_next(read(spark, sf_dir, "documents"))


def op3_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(read(spark, sf_dir, "documents")).drop("spans")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op5_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.documents(wavelet.written(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op6_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read_back(warc.written(read(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.clustered(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.removed(read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = prefixtrie.encoded(read(spark, sf_dir, "conversations"))
    return prefixtrie.trie(prefixtrie.grafted(saved(convs, "trie-encoded")))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_merkle_fingerprints, op3_repeated_strings, op4_toxicity, op5_wavelet_tokens, op6_warc_dictionary, op7_simhash, op8_line_dedup, op9_quality, op10_best_fit_packing, op11_prefix_trie, op12_source_mixing, op13_phrase_collocations)}


_WARC_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hexa
  FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hexa) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: right('000' || CAST(bin(strpos('0123456789abcdef', substr(hexa, CAST(i AS INT), 1)) - 1) AS VARCHAR), 4)), '') AS bits FROM f)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(1, 6), lambda j: CAST(substr(bits, CAST(5 * i + j AS INT), 1) AS INT) * (1 << CAST(5 - j AS INT)))) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""


_LINES_SQL = r"""
WITH l AS (
  SELECT d.doc_id, CAST(i AS INT) AS line_no,
    list_sort(list_distinct(list_filter(string_split(lower(translate(s.lines[i + 1], chr(9) || chr(13) || chr(11) || chr(12), '    ')), ' '), lambda w: w <> ''))) AS words
  FROM documents d, LATERAL (SELECT string_split(d.text, chr(10)) AS lines) s, LATERAL (SELECT unnest(range(0, len(s.lines))) AS i) r
  WHERE d.doc_id IS NOT NULL AND d.text IS NOT NULL),
s AS (SELECT words, min({'d': doc_id, 'l': line_no}) AS f, len(words) AS n FROM l WHERE len(words) > 0 GROUP BY words),
t AS (SELECT f, n, unnest(words) AS w FROM s WHERE n >= 4),
p AS (
  SELECT a.f AS f, b.f AS g, a.n AS n, b.n AS m, count(*) AS c
  FROM t a JOIN t b ON a.w = b.w AND a.f > b.f AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
  GROUP BY ALL)
SELECT DISTINCT f.d AS doc_id, f.l AS line_no, false AS exact FROM p WHERE 9 * c >= 4 * (n + m)
UNION ALL
SELECT DISTINCT l.doc_id, l.line_no, true FROM l JOIN s USING (words) WHERE {'d': l.doc_id, 'l': l.line_no} > s.f
"""


#: The crc32 of a text of digits: its bytes, each followed by eight shifts, folded from all ones.
_TRIE_SQL = """
WITH c AS (
  SELECT conv_id, list([coalesce(role, ''), coalesce(text, '')] ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
k AS (
  SELECT conv_id, turns, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 6 AS h
  FROM c),
r AS (
  SELECT k.conv_id, list_concat(coalesce(b.turns, [])[1:CAST(k.h AS INT)], k.turns[CAST(k.h AS INT) + 1:]) AS turns
  FROM k LEFT JOIN c b ON b.conv_id = k.conv_id - k.conv_id % 100),
p AS (SELECT conv_id, d, len(turns) = d AS ends, turns[1:CAST(d AS INT)] AS prefix FROM r, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d) u),
n AS (
  SELECT prefix, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE length(prefix[CAST(d AS INT)][2]) END AS own
  FROM p GROUP BY prefix, d),
kids AS (SELECT prefix[1:CAST(depth - 1 AS INT)] AS prefix, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(kids.n, 0) AS n_children FROM n LEFT JOIN kids USING (prefix)),
s AS (
  SELECT prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved
  FROM (SELECT n_children, own, prefix[1:CAST(d AS INT)] AS prefix FROM m, LATERAL (SELECT unnest(range(0, depth + 1)) AS d) u) GROUP BY prefix)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, o.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN s USING (prefix) LEFT JOIN m o ON m.depth > 0 AND o.prefix = m.prefix[1:CAST(m.depth - 1 AS INT)]
"""


#: A share is at its cap where the words that sources can take at that source's ratio of cap to weight are below the total.
_MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
t AS (SELECT sum(ss) AS total FROM s),
c AS (
  SELECT a.source, a.ss, a.w, a.ss = 0 OR sum(least(CAST(3 * b.ss * a.w AS HUGEINT), CAST(3 * a.ss * b.w AS HUGEINT))) < any_value(t.total) * a.w AS clamped
  FROM s a, s b, t GROUP BY a.source, a.ss, a.w),
l AS (SELECT (SELECT total FROM t) - coalesce(sum(3 * ss) FILTER (clamped), 0) AS rest, coalesce(sum(w) FILTER (NOT clamped), 1) AS weights FROM c),
g AS (SELECT source, ss, CASE WHEN clamped THEN CAST(3 * ss AS DOUBLE) ELSE CAST(w * rest AS DOUBLE) / CAST(weights AS DOUBLE) END AS target FROM c, l),
p AS (SELECT *, CASE WHEN ss = 0 THEN 0 ELSE CAST(round(target) AS BIGINT) // ss END AS whole FROM g),
q AS (SELECT *, CAST(round(target) AS BIGINT) - whole * ss AS rest FROM p),
m AS (SELECT source, place, size, count(*) AS n FROM d WHERE size > 0 GROUP BY source, place, size),
r AS (SELECT *, sum(n * size) OVER (PARTITION BY source ORDER BY place, size) - n * size AS before FROM m)
SELECT d.doc_id, d.size, q.ss AS source_size, q.target, CAST(q.whole * d.size + CASE WHEN d.size = 0 OR r.before >= q.rest THEN 0 WHEN r.before + d.size * r.n <= q.rest THEN d.size ELSE (q.rest - r.before) // r.n END AS BIGINT) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN r ON r.source IS NOT DISTINCT FROM d.source AND r.place = d.place AND r.size = d.size
"""


_PHRASES_SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM t),
g AS (
  SELECT lang, k, words[CAST(i AS INT):CAST(i + k - 1 AS INT)] AS gram
  FROM w, LATERAL (SELECT unnest([1, 2, 3]) AS k) ks, LATERAL (SELECT unnest(range(1, len(words) - k + 2)) AS i) r),
f AS (SELECT lang, k, gram, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
h AS (SELECT lang, k, gram, f AS a, unnest(range(1, k)) AS cut FROM f WHERE k > 1 AND f >= 10),
s AS (
  SELECT h.lang, h.k, h.gram, h.a, h.cut, x.f AS l, y.f AS r, CAST(CAST(h.a AS HUGEINT) * h.a * 1000000 // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM h JOIN f x ON x.lang = h.lang AND x.gram = h.gram[1:CAST(h.cut AS INT)] JOIN f y ON y.lang = h.lang AND y.gram = h.gram[CAST(h.cut + 1 AS INT):]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, cut) = 1),
inside AS (SELECT lang, gram[1:2] AS gram, a FROM b WHERE k = 3 UNION ALL SELECT lang, gram[2:3], a FROM b WHERE k = 3),
longer AS (SELECT lang, gram, max(a) AS longer FROM inside GROUP BY ALL),
kept AS (SELECT b.*, array_to_string(b.gram, ' ') AS phrase FROM b LEFT JOIN longer o ON o.lang = b.lang AND o.gram = b.gram WHERE o.longer IS NULL OR 100 * o.longer < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n.n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_prefix_trie": _TRIE_SQL, "op12_source_mixing": _MIX_SQL, "op13_phrase_collocations": _PHRASES_SQL, "op8_line_dedup": _LINES_SQL, "op6_warc_dictionary": _WARC_SQL}
