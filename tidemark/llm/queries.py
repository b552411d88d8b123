"""The numbered queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import table

from . import decontaminate, fill_in_middle, hard_negatives, license_scan, lm_scoring, media_chunks, minhash_dedup, pii, quality_classifier, sentencepieces, substring_dedup, url_filters, warc
from .common import crc_text

# The host and path rules of the URL query.
RULES = [
    url_filters.Rule("allow", "com", "/"),
    url_filters.Rule("block", "example.com", "/en/"),
    url_filters.Rule("allow", "www.example.com", "/en/"),
    url_filters.Rule("block", "net", "/es/"),
    url_filters.Rule("block", "net", "/fr/"),
]
# The listed URLs are host/language/number for each number under LISTED_PAGES.
LISTED_HOSTS = ["spam-farm.example.org", "cheap-pills.example.com"]
LISTED_LANGS = ["de", "en", "es", "fr"]
LISTED_PAGES = 1000


def model_path() -> str:
    """The SentencePiece model file."""
    return os.environ.get("TIDEMARK_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = lm_scoring.held_out(F.col("doc_id"))
    found = lm_scoring.score(docs, docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts, langs = (F.explode(F.array(*map(F.lit, v))) for v in (LISTED_HOSTS, LISTED_LANGS))
    listed = spark.range(LISTED_PAGES).select("id", hosts.alias("host")).select("id", "host", langs.alias("lang"))
    listed = listed.select(F.concat_ws("/", F.concat(F.lit("http://"), F.col("host")), "lang", "id").alias("url"))
    return url_filters.judge(table(spark, sf_dir, "pages"), RULES, listed).select("page_id", "host", "path", "rule", "verdict")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text as the digest of their decimal numbers, joined by one space."""
    found = sentencepieces.encode(table(spark, sf_dir, "documents"), sentencepieces.read_model(model_path()))
    digest = F.sha2(F.array_join("ids", " ").cast("binary"), 256)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_ids"), digest.alias("ids_sha256"), "parity", "round_trip")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op5_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.stored(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.col("kept").cast("binary"), 256)
    return substring_dedup.dedup(table(spark, sf_dir, "documents"), kept=digest).withColumnRenamed("kept", "kept_sha256")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup.dedup(table(spark, sf_dir, "documents"), size=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(docs, model, "doc_id")
    return scored.select("doc_id", (crc_text(F.col("doc_id")) % 3 == 1).alias("held_out"), "score", "predicted")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle.transform(table(spark, sf_dir, "documents"), digests=True)
    return found.withColumnRenamed("output", "output_sha256").withColumnRenamed("restored", "restored_sha256")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


OP2_SQL = r"""
WITH listed AS (
  SELECT h || '/' || l || '/' || n AS key
  FROM unnest(['spam-farm.example.org', 'cheap-pills.example.com']) a(h),
       unnest(['de', 'en', 'es', 'fr']) b(l), range(1000) c(n)
), r AS (
  SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|\z)'))) AS args
  FROM r
), k AS (
  SELECT *, CASE WHEN host = '' THEN '' ELSE regexp_replace(regexp_replace(host, ':(80|443)\z', ''), '^www\.', '')
      || regexp_replace(regexp_replace(path, '/+\z', ''), '\.html\z', '')
      || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS key,
    CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM k
"""


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, p, array_to_string(words[p:p+34], ' ') AS seq
  FROM d, LATERAL (SELECT unnest(range(1, len(words) - 33)) AS p)
), again AS (
  SELECT doc_id, p FROM w WHERE seq IN (SELECT seq FROM w GROUP BY seq HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT doc_id, p + k AS i FROM again, range(35) r(k)
), g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN words
    ELSE list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(gone, i)), lambda i: words[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""


OP7_SQL = r"""
WITH t AS (
  SELECT 0 AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark
), s AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) < 5 THEN [] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM t
), n AS (SELECT id, count(*) AS n FROM s WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, any_value(n.n)::BIGINT AS n_shingles, count(*)::BIGINT AS n_shared
FROM s d JOIN s i ON d.g = i.g AND d.kind = 0 AND i.kind = 1 JOIN n ON n.id = i.id
GROUP BY d.id, i.id HAVING 100 * count(*) >= 80 * any_value(n.n)
"""


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g
  FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT u, v FROM pair JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)
), edge AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link
), reach AS (
  SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, edge.v FROM reach JOIN edge ON edge.u = reach.r
)
SELECT doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(text, '') AS t, doc_id, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
), l AS (
  SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, list_transform(range(4), lambda i: CAST('0x' || substr(x, 8 * i + 1, 8) AS BIGINT)) AS h FROM d
), c AS (
  SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM l
), o AS (
  SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a+1:b], '') AS mid, array_to_string(u[b+1:], '') AS suf FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(pre || mid || suf) AS restored_sha256
FROM o
"""


OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, CAST(strlen(coalesce(html, '')) AS BIGINT) AS size FROM pages
), m AS (SELECT *, CASE WHEN size >= 1000 THEN max(page_id) OVER (PARTITION BY t) ELSE page_id END AS top FROM p)
SELECT page_id, size AS payload_bytes, sha1(t) AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM m
"""


def queries() -> dict:
    found = (
        op1_lm_scoring,
        op2_url_filters,
        op3_sentencepiece,
        op4_pii,
        op5_media_chunks,
        op6_substring_dedup,
        op7_decontamination,
        op8_license_scan,
        op9_minhash_dedup,
        op10_quality,
        op11_hard_negatives,
        op12_fill_in_middle,
        op13_warc,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filters": OP2_SQL,
        "op6_substring_dedup": OP6_SQL,
        "op7_decontamination": OP7_SQL,
        "op9_minhash_dedup": OP9_SQL,
        "op11_hard_negatives": OP11_SQL,
        "op12_fill_in_middle": OP12_SQL,
        "op13_warc": OP13_SQL,
    }
