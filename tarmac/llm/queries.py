"""Registered queries of this subpackage: ``QUERIES`` (name -> callable) and ``SQL`` (name -> DuckDB text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarmac.llm import bm25_leaks, jaccard_tiles, license_dice, line_crf, lsh_forest, pii_crf, piece_fst, prefix_trie, pu_toxicity, resample, url_rules, warc, wavelet
from tarmac.llm.common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_bm25_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_digest(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_crf.judge(docs, line_crf.train(docs, table(spark, sf_dir, "labels")))


def op6_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_dice.scan(table(spark, sf_dir, "documents"))


def op7_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii_crf.detect(docs, pii_crf.train(docs))


def op8_piece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_fst.encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op9_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_jaccard_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_tiles.jaccard_components(table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_copies(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.forked_trie(table(spark, sf_dir, "conversations"))


SQL_OP5 = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
t AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d) END AS top FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN top IS NOT NULL AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM t
"""

def jaccard_sql(k: int, percent: int, more: str = "") -> str:
    """The components of all documents by joining on every shingle (``k`` words, ``percent`` of a hundred)."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
sh AS (
  SELECT r, doc_id, list_sort(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {k} THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - {k} + 2), lambda i: array_to_string(ws[i:i + {k} - 1], ' '))) END) AS s
  FROM w),
keyed AS (SELECT r, doc_id, s, md5(array_to_string(s, chr(10))) AS k FROM sh),
class AS (SELECT k, min(doc_id) AS id, any_value(s) AS s, any_value(len(s)) AS n FROM keyed WHERE len(s) > 0 GROUP BY k),
gram AS (SELECT id, n, unnest(s) AS g FROM class),
pair AS (SELECT a.id AS u, b.id AS v, any_value(a.n) AS nu, any_value(b.n) AS nv, count(*) AS c
         FROM gram a JOIN gram b ON a.g = b.g AND a.id < b.id AND 100 * a.n >= {percent} * b.n AND 100 * b.n >= {percent} * a.n GROUP BY a.id, b.id),
link AS (SELECT u, v FROM pair WHERE 100 * c >= {percent} * (nu + nv - c)),
both_ways AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach(a, b) AS (SELECT id, id FROM class UNION SELECT reach.a, l.v FROM reach JOIN both_ways l ON reach.b = l.u),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, CAST(len(keyed.s) AS BIGINT) AS n_shingles, coalesce(comp.c, doc_id) AS component_id{more}
FROM keyed LEFT JOIN class ON class.k = keyed.k AND len(keyed.s) > 0 LEFT JOIN comp ON comp.a = class.id
"""

QUERIES = {
    "op1_bm25_leaks": op1_bm25_leaks,
    "op2_wavelet_tokens": op2_wavelet_tokens,
    "op3_url_rules": op3_url_rules,
    "op4_line_crf": op4_line_crf,
    "op5_warc": op5_warc,
    "op6_license_dice": op6_license_dice,
    "op7_skip_chain_pii": op7_skip_chain_pii,
    "op8_piece_fst": op8_piece_fst,
    "op9_nnpu_toxicity": op9_nnpu_toxicity,
    "op10_jaccard_tiles": op10_jaccard_tiles,
    "op11_importance": op11_importance,
    "op12_lsh_forest": op12_lsh_forest,
    "op13_prefix_trie": op13_prefix_trie,
}

SQL = {
    "op5_warc": SQL_OP5,
    "op6_license_dice": license_dice.duckdb_sql(),
    "op10_jaccard_tiles": jaccard_sql(5, 80),
    "op11_importance": resample.SQL,
    "op12_lsh_forest": jaccard_sql(3, 85, ", doc_id = coalesce(comp.c, doc_id) AS kept"),
    "op13_prefix_trie": prefix_trie.SQL,
}
