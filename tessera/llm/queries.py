"""The subpackage's queries, by name; each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, jaccard_join, label_sharding, language_id, pattern_packing, pitman_yor, quality_rules, substring_dedup, token_rows, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows.token_rows(_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages"))


#: SHA-1 in base32: eight groups of five hexadecimal digits, each four characters.
OP2_SQL = """
WITH hashed AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), coded AS (
  SELECT page_id, strlen(html) AS payload_bytes,
         array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0],
           lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (g * 5 + 1)::INT, 5))::INT >> b) & 31) + 1, 1)), '')), '') AS payload_digest
  FROM hashed
), firsts AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM coded
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predictions(_table(spark, sf_dir, "documents"))


def op4_label_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(_table(spark, sf_dir, "documents")).drop("spans")


#: All windows of all documents by one window function.
OP5_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') AS phrase
  FROM (SELECT doc_id, w, unnest(range(len(w) - 12)) AS i FROM words WHERE len(w) >= 13)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p
  FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY phrase) AS least FROM windows) WHERE least < doc_id
), each AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM words
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
), removed AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scores(_table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("hit_spans")


#: Words, windows and coverage by plain joins.
OP8_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), item_at AS (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(len(w) - least(len(w), 10) + 1)) AS i FROM item_words WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS phrase FROM item_at
), doc_at AS (
  SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
), found AS (
  SELECT d.doc_id, d.i, d.n, x.item_id FROM (SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS phrase FROM doc_at) d JOIN windows x USING (n, phrase)
), hit AS (
  SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id
)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op9_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_packing.pack(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_token_rows": op1_token_rows, "op2_warc": op2_warc, "op3_language_id": op3_language_id, "op4_label_sharding": op4_label_sharding, "op5_substring_dedup": op5_substring_dedup, "op6_pitman_yor": op6_pitman_yor, "op7_jaccard_join": op7_jaccard_join, "op8_decontamination": op8_decontamination, "op9_pattern_packing": op9_pattern_packing, "op10_quality_rules": op10_quality_rules}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op5_substring_dedup": OP5_SQL, "op8_decontamination": OP8_SQL}
