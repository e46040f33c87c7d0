"""The queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


#: Setting that names the folder where token counts are kept from run to run; unset, a run has a cache of its own.
TOKEN_CACHE = "spark.lexgrain.tokenCache"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """A file of the installed tokenizers; LEXGRAIN_TOKENIZERS names another folder."""
    if folder := os.environ.get("LEXGRAIN_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexgrain.llm.language_id import predict_languages

    return predict_languages(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexgrain.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), spark.conf.get(TOKEN_CACHE, None))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexgrain.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op4_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexgrain.llm.pieces import digests

    return digests(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexgrain.llm.substrings import kept_words

    return kept_words(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexgrain.llm.quality import judge

    return judge(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexgrain.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexgrain.llm.html_text import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexgrain.llm.pitman_yor import score

    return score(_table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexgrain.llm.embeddings import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_token_counts, op3_mixing, op4_piece_lattice, op5_substring_dedup, op6_quality_rules, op7_simhash, op8_html_text, op9_lm_scores, op10_embedding_dedup)}

#: Where SQL can say it. The others are tested against brute-force versions in tests/llm: SQL has neither
#: the tokenizers' merges, the lattice, XXH64 nor the trained models.
ORACLE_SQL: dict[str, str] = {
    "op5_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(generate_series(1, len(ws) - 19)) AS i, ws FROM w WHERE len(ws) >= 20),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS win FROM p),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS rn FROM k),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS j FROM r WHERE rn > 1),
g AS (SELECT doc_id, list(j) AS js FROM c GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
 sha256(CASE WHEN js IS NULL THEN array_to_string(ws, ' ') ELSE array_to_string(list_filter(ws, lambda x, j: NOT list_contains(js, j)), ' ') END) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)""",
    "op10_embedding_dedup": r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.98 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, min(r.b) AS component_id, v.vec_id = min(r.b) AS kept FROM v JOIN r ON r.a = v.vec_id GROUP BY v.vec_id""",
}
