"""The queries of this subpackage's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, byte_bpe, fingerprints, language_id, lexical_search, mixing, near_dup, passages, permutation_index, quality, suffix_dedup, token_output, url_filters
from .shared import table


def op1_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.passages(table(spark, sf_dir, "documents")).drop("text_hash")
    return found.withColumn("n_words", found["end"] - found["start"])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_with_edits(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filters.RULES, "action string, host string, path string")
    return url_filters.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return permutation_index.search(vectors, vectors.filter("vec_id % 20 = 0"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.read_documents(spark, token_output.write_files(table(spark, sf_dir, "documents")))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_shared_passages": op1_shared_passages,
    "op2_mixing": op2_mixing,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_url_filters": op5_url_filters,
    "op6_language_id": op6_language_id,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_token_output": op10_token_output,
    "op11_quality": op11_quality,
    "op12_alignment": op12_alignment,
    "op13_lexical_search": op13_lexical_search,
}

_MIX_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), d AS (
  SELECT *, coalesce('s' || source, 'n') AS key, length(bin(size)) AS level,
    (('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM sized
), s0 AS (
  SELECT key, source, sum(size)::DOUBLE AS source_size FROM d GROUP BY ALL
), s1 AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w, 2 * source_size AS cap,
    1.5 * (SELECT sum(source_size) FROM s0) AS amount FROM s0
), s2 AS (
  SELECT *, coalesce((SELECT sum(b.cap) FROM s1 b WHERE (b.cap / b.w, coalesce(b.key, '')) < (a.cap / a.w, a.key)), 0) AS caps_before,
    (SELECT sum(b.w) FROM s1 b WHERE (b.cap / b.w, b.key) >= (a.cap / a.w, a.key)) AS weights_from FROM s1 a
), s3 AS (
  SELECT *, cap * weights_from <= (amount - caps_before) * w AS capped FROM s2
), s4 AS (
  SELECT key, source_size, CASE WHEN capped THEN cap ELSE
    ((amount - coalesce((SELECT sum(cap) FROM s3 WHERE capped), 0)) / (SELECT sum(w) FROM s3 WHERE NOT capped)) * w END AS target FROM s3
), c0 AS (
  SELECT key, level, sum(size)::DOUBLE AS class_size FROM d GROUP BY ALL
), c1 AS (
  SELECT c0.*, source_size, target, (level + 4)::DOUBLE AS lw, 2 * class_size AS cap, (level + 4) * class_size AS w FROM c0 JOIN s4 USING (key)
), c2 AS (
  SELECT *, coalesce((SELECT sum(b.cap) FROM c1 b WHERE b.key = a.key AND b.lw > a.lw), 0) AS caps_before,
    (SELECT sum(b.w) FROM c1 b WHERE b.key = a.key AND b.lw <= a.lw) AS weights_from FROM c1 a
), c3 AS (
  SELECT *, w = 0 OR cap * weights_from <= (target - caps_before) * w AS capped FROM c2
), c4 AS (
  SELECT *, CASE WHEN capped THEN 2.0 ELSE
    ((target - coalesce((SELECT sum(cap) FROM c3 b WHERE b.key = a.key AND b.capped), 0)) / (SELECT sum(w) FROM c3 b WHERE b.key = a.key AND NOT b.capped)) * lw END AS copies FROM c3 a
), c5 AS (
  SELECT key, level, source_size, target, floor(copies) AS whole, copies - floor(copies) AS p,
    target - sum(floor(copies) * class_size) OVER (PARTITION BY key) AS rest FROM c4
), r0 AS (
  SELECT d.*, source_size, target, whole, p, rest, (u / (1 - u)) * ((1 - p) / nullif(p, 0)) AS odds FROM d JOIN c5 USING (key, level)
), r1 AS (
  SELECT *, odds / (1 + odds) AS position FROM r0
), r2 AS (
  SELECT *, p > 0 AND size > 0 AS may,
    sum(CASE WHEN p > 0 AND size > 0 THEN size ELSE 0 END) OVER (PARTITION BY key ORDER BY position, doc_id NULLS FIRST, size) AS upto,
    sum(CASE WHEN p > 0 AND size > 0 THEN size ELSE 0 END) OVER (PARTITION BY key, position, doc_id, size) AS own FROM r1
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
  (size * CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN may AND rest > 0 AND upto - own < rest AND upto + (upto - own) <= 2 * rest THEN 1 ELSE 0 END END)::BIGINT AS taken,
  (CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN may AND rest > 0 AND upto - own < rest AND upto + (upto - own) <= 2 * rest THEN 1 ELSE 0 END END)::BIGINT AS copies
FROM r2
"""

_URL_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, url LIKE '%://%' AS ok,
    CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 2) ELSE '' END AS path,
    regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS site
  FROM pages
), found AS (
  SELECT url, host, path, site, unnest([
    regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0), '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1),
    regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0), '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1)]) AS link
  FROM p WHERE ok
), links AS (
  SELECT url AS a, CASE
      WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN l
      WHEN l LIKE '//%' THEN 'http:' || l
      WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
      WHEN l LIKE '/%' THEN site || l
      WHEN l LIKE '#%' THEN url
      WHEN l LIKE '?%' THEN site || path || l
      ELSE site || CASE WHEN regexp_extract(path, '(?s)^(.*/)', 1) = '' THEN '/' ELSE regexp_extract(path, '(?s)^(.*/)', 1) END || l END AS b
  FROM (SELECT *, replace(link, '&amp;', '&') AS l FROM found WHERE link <> '')
), nodes AS (
  SELECT DISTINCT host || path || coalesce(query, '') AS node, host, path FROM (
    SELECT translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 2) AS path, regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 3) AS query
    FROM (SELECT a AS url FROM links WHERE b IS NOT NULL UNION SELECT b FROM links WHERE b IS NOT NULL))
), node_of AS (
  SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 2) || regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 3) AS node
  FROM (SELECT a AS url FROM links UNION SELECT b FROM links UNION SELECT url FROM p WHERE ok)
), edges AS (
  SELECT DISTINCT x.node AS a, y.node AS b FROM links JOIN node_of x ON x.url = links.a JOIN node_of y ON y.url = links.b
), sym AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reach AS (
  SELECT node AS a, node AS b FROM nodes UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a
), rules(action, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), places AS (SELECT host, path FROM p UNION SELECT host, path FROM nodes
), judged AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM places JOIN rules ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath) GROUP BY host, path
), aliases AS (
  SELECT reach.a AS node, CASE WHEN bool_or(action = 'allow') THEN 'allow' ELSE 'block' END AS alias_action
  FROM reach JOIN nodes ON nodes.node = reach.b JOIN judged USING (host, path) GROUP BY reach.a
)
SELECT page_id, p.host, p.path, rule, coalesce(action, alias_action, 'allow') AS verdict
FROM p LEFT JOIN judged ON judged.host = p.host AND judged.path = p.path
LEFT JOIN node_of ON p.ok AND node_of.url = p.url
LEFT JOIN aliases ON aliases.node = node_of.node
"""

_SEARCH_SQL = r"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS terms FROM documents
), d AS (SELECT doc_id, r, terms, len(terms)::BIGINT AS n FROM t WHERE len(terms) > 0
), facts AS (SELECT count(*)::HUGEINT AS docs, sum(n) AS total FROM d
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark
), p AS (SELECT doc_id, r, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, r, n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), facts
), scored AS (
  SELECT item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * docs) // total)))))::BIGINT AS score
  FROM p JOIN w USING (term) JOIN q USING (term), facts GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0 AND doc_id IS NOT NULL)
WHERE rank <= 50
"""

ORACLES: dict[str, str] = {"op2_mixing": _MIX_SQL, "op5_url_filters": _URL_SQL, "op13_lexical_search": _SEARCH_SQL}
