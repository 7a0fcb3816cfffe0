"""The operators' production queries over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shards import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quotes import conversations_without_quotes

    return conversations_without_quotes(_table(spark, sf_dir, "conversations"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import report

    return report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import report

    return report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lmscore import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op7_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sketch import fingerprint_pairs

    return fingerprint_pairs(_table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import extract

    return extract(_table(spark, sf_dir, "pages"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_ALL = (
    op1_sharding, op2_simhash_near_dedup, op3_quotation_linking, op4_toxicity, op5_decontamination, op6_lm_scoring,
    op7_scaled_sketch, op8_html_extraction, op9_warc, op10_best_fit_packing, pipeline,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The others cannot be put in SQL (hashes, models, parsers, packing); tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
pos AS (SELECT d.doc_id, p AS i, n, array_to_string(d.w[p : p + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM d) d, (SELECT DISTINCT n FROM win) s WHERE p + n - 1 <= len(d.w)),
hit AS (SELECT pos.doc_id, pos.i, pos.n, win.item_id FROM pos JOIN win USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op9_warc": """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS g FROM pages),
k AS (SELECT g, max(page_id) AS kept FROM p WHERE n >= 1000 GROUP BY g),
r AS (SELECT p.*, CASE WHEN page_id < kept THEN kept END AS refers_to FROM p LEFT JOIN k ON k.g = p.g AND p.n >= 1000)
SELECT page_id, n AS payload_bytes, g AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r""",
}
