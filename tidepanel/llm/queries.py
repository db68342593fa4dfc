"""The contract queries of this subpackage, one an operator, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bloom_lm, decontaminate, exact_dedup, ngram_join, packing, pii, quality, suffix_dedup, toxicity, warc

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7_SQL = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all({LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all({LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), n AS (
  SELECT item_id, w, least(10, len(w)) AS k FROM i WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, k, w[p : p + k - 1] AS g FROM n, unnest(generate_series(1, len(w) - k + 1)) AS u(p)
), ks AS (SELECT DISTINCT k FROM win), firsts AS (SELECT DISTINCT g[1] AS f, k FROM win),
occ AS (
  SELECT doc_id, k, p, w[p : p + k - 1] AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM w) JOIN firsts ON w[p] = f
  WHERE p + k - 1 <= len(w)
), m AS (
  SELECT doc_id, p, occ.k, item_id FROM occ JOIN win ON occ.g = win.g AND occ.k = win.k
), hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + k - 1)) AS q FROM m) GROUP BY 1
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY 1
)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query("op7_decontamination", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = f"""
WITH d AS (SELECT doc_id, sha256({LOWER.format('text')}) AS s FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256
FROM d
"""


@query("op6_exact_dedup", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(table(spark, sf_dir, "documents"))


OP3_SQL = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all({LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 2), lambda p: concat_ws(' ', w[p], w[p + 1], w[p + 2])) END) AS s
  FROM w
), x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY 1, 2
), link AS (SELECT a, b FROM pair WHERE 100 * i >= 90 * (na + nb - i)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  WITH RECURSIVE r(node, seen) AS (
    SELECT doc_id, doc_id FROM s UNION SELECT edge.b, r.seen FROM r JOIN edge ON edge.a = r.node AND r.seen < edge.b
  ) SELECT node, min(seen) AS least FROM r GROUP BY 1
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, reach.least AS component_id
FROM s JOIN reach ON reach.node = s.doc_id
"""


@query("op3_ngram_join", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components_of(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(encode(coalesce(html, ''))) AS d FROM pages
), k AS (SELECT d, n, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY 1, 2)
SELECT page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM p LEFT JOIN k ON p.d = k.d AND p.n = k.n
"""


@query("op10_warc", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(table(spark, sf_dir, "documents"), TOKENIZER)


@query("op5_bloom_lm")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score(table(spark, sf_dir, "documents"))


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP1_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (
  SELECT doc_id, p, sha256(array_slice(b, p + 1, p + 100)) AS s
  FROM (SELECT doc_id, b, unnest(generate_series(0, octet_length(b) - 100)) AS p FROM d WHERE octet_length(b) >= 100)
), r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1 AS again FROM w),
g AS (
  SELECT doc_id, p, p > coalesce(max(p) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000) + 100 AS fresh
  FROM r WHERE again
), n AS (SELECT doc_id, p, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g),
span AS (SELECT doc_id, k, min(p) AS a, max(p) + 100 AS z FROM n GROUP BY 1, 2),
gap AS (
  SELECT span.doc_id, k, z, coalesce(lead(a) OVER (PARTITION BY span.doc_id ORDER BY a), octet_length(b)) AS next_a FROM span JOIN d USING (doc_id)
), kept AS (
  SELECT d.doc_id, CASE WHEN count(gap.k) = 0 THEN any_value(hex(b))
    ELSE any_value(hex(b)[1 : 2 * f.a]) || string_agg(hex(b)[2 * z + 1 : 2 * next_a], '' ORDER BY gap.k) END AS h
  FROM d LEFT JOIN gap ON gap.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(a) AS a FROM span GROUP BY 1) f ON f.doc_id = d.doc_id GROUP BY 1
), s AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY 1)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN s USING (doc_id)
"""


@query("op1_suffix_dedup", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


@query("op2_pii_surrogates")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a key for test tables; real corpora bring their own, kept secret
    return pii.report(table(spark, sf_dir, "documents"), key=b"key of the test tables")
