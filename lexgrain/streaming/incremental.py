"""Indexing a stream of documents: each micro-batch's postings appended once, counters kept by term."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrain.operators import index as I


def append_postings(docs: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """docs: a stream of (doc_id, path, lang, text). Writes documents and postings by batch; a repeated batch overwrites its own folder, so that each counts once."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        I.documents(batch).write.mode("overwrite").parquet(f"{path}/documents/batch={epoch}")
        I.postings(batch).write.mode("overwrite").parquet(f"{path}/postings/batch={epoch}")
        batch.unpersist()

    out = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def term_counts(docs: DataFrame) -> DataFrame:
    """Running document frequency and count of each term of a stream (complete or update mode)."""
    tokens = I.T.tokens(F.col("text"))
    pairs = docs.select(F.explode(F.array_distinct(tokens)).alias("term"), tokens.alias("all"))
    return pairs.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size(F.filter("all", lambda x: x == F.col("term")))).alias("tf"))
