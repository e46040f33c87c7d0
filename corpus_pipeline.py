"""A training corpus from raw documents: five stages, each of which works on all that the one before kept."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrain.llm import language_id, mixing, pieces, simhash, substrings
from lexgrain.llm.queries import tokenizer_file
from lexgrain.llm.scratch import Scratch, replaced

#: Below this calibrated probability no language is accepted; four guesses in the dark have 0.25.
LEAST_SCORE = 0.3


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with two columns by which a row is known: its doc_id, the highest number without one, and a digest of all its columns."""
    key, mark = _fresh(docs, "__key"), _fresh(docs, "__mark")
    return docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), mark: F.xxhash64(*docs.columns)}), key, mark


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that language ID rejects: no letter, no language learned, or no probability to speak of.

    Null and empty texts go; null and repeated ids and repeated rows pass like any other. All columns stay
    as they are, whatever their names. An empty table gives one, and so do all stages.
    """
    found = language_id.predict_languages(docs.select("doc_id", "text", "lang", F.struct(*docs.columns).alias("__row")), keep=("__row",))
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("__row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (op7's links): that of the smallest doc_id, of several such the one with the least digest.

    Rows that share an id and whose texts do not resemble each other all stay; a row without an id comes
    after all that have one. Empty texts are near copies of each other.
    """
    rows, key, mark = _keyed(docs)
    named = simhash.grouped(rows, doc_id=key, keep=(mark,))
    heads = named.groupBy("group").agg(F.min(F.struct(F.col("doc_id").alias("i"), F.col(mark).alias("m"))).alias("h")).select(F.col("h.i").alias(key), F.col("h.m").alias(mark))
    return rows.join(heads, [key, mark], "left_semi").dropDuplicates([key, mark]).select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that start earlier too; documents of which nothing stays go, null and empty texts with them.

    Rows that repeat an id are one document, as in op5; a row without an id comes last.
    """
    scratch = Scratch(spark, "repeats")
    rows, key, _ = _keyed(docs)
    mark, starts = _fresh(rows, "__text_mark"), _fresh(rows, "__starts")
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = rows.select(*docs.columns, key, F.xxhash64(body).alias(mark))
    found = substrings.repeated_windows(rows.select(F.col(key).alias("doc_id"), F.col(mark).alias("mark"), body.alias("text")), scratch)
    marked = rows.join(found.select(F.col("doc_id").alias(key), F.col("mark").alias(mark), F.col("starts").alias(starts)), [key, mark], "left").select(*docs.columns, starts)
    shape = docs.schema

    def cut(batches):
        for batch in batches:
            both = zip(batch.column("text").to_pylist(), batch.column(starts).to_pylist(), strict=True)
            text = pa.array([substrings.cut_text(t, s) if t is not None else None for t, s in both], pa.string())
            yield replaced(batch, (starts,), {"text": text})

    out = marked.mapInArrow(cut, shape)
    out = out.withColumn("n_chars", F.length("text").cast(shape["n_chars"].dataType)) if "n_chars" in shape.names else out
    return out.where("text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics have the target shares of the tokens.

    Equal rows are kept or left together; each row without an id has its own draw, by its text.
    """
    rows, key, mark = _keyed(docs)
    kept = mixing.mix(rows, keep=(key, mark)).where("kept").select(key, mark).distinct()
    return rows.join(kept, [key, mark], "left_semi").select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the best segmentation, its score and the number of alternatives; a row for each row, whatever its id or text."""
    found = pieces.encoded(docs, tokenizer_file("piece_bpe_32k.model"))
    return found.select("doc_id", "piece_ids", "best_score", F.size("alternatives").alias("n_alternatives"))


STAGES = [("language ID", language), ("SimHash near-dedup", near_copies), ("substring dedup", repeats), ("mixing sources", mixed), ("SentencePiece encoding", encoded)]

#: Raking, raked sampling and the lattice search have no SQL form; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what a stage gives is written to the shared folder before the next one reads it."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}", shuffles=True)
    return STAGES[-1][1](spark, docs, sf_dir)
