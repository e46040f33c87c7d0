"""Token counts behind a cache keyed by content digest and tokenizer digest."""

from __future__ import annotations

import hashlib
import os
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrain.llm.scratch import Scratch, full

CACHE = "tokenizer binary, digest binary, n_bytes long, n_tokens long"
LIMIT = 1024
#: Scripts whose letter, digit and space classes no Unicode version has changed; others go to the file's own library.
SETTLED = re.compile("[^\x00-ɏ]")
LONG_RUN = re.compile(r"\S{2000}|\s{2000}")


def counter(path: str):
    """texts -> token counts as the library of that file gives them, without added special tokens.

    A byte-level BPE whose ranks also lie beside it as .tiktoken is counted by the faster library
    where both are the same by construction: settled scripts, no special string, no very long run.
    """
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)] if texts else []

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    special = [t.content for t in own.get_added_tokens_decoder().values()]
    ranks = path.removesuffix(".json") + ".tiktoken"
    quick = None
    if os.path.exists(ranks):
        import base64

        import tiktoken
        from public_tokenizers import PATTERN

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        quick = tiktoken.Encoding(os.path.basename(ranks), pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})

    def count(texts: list[str]) -> list[int]:
        out, rest = [0] * len(texts), []
        for i, t in enumerate(texts):
            if quick and not SETTLED.search(t) and not any(s in t for s in special) and not LONG_RUN.search(t):
                out[i] = len(quick.encode_ordinary(t))
            else:
                rest.append(i)
        for k in range(0, len(rest), 64):
            part = rest[k : k + 64]
            for i, e in zip(part, own.encode_batch_fast([texts[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = len(e.ids)
        return out

    return count


def tokenizer_digest(path: str) -> bytes:
    """Of the file and of this counter's version: another tokenizer never meets these counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(b"1\0" + f.read()).digest()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = LIMIT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit.

    Normalised content is the whole text as UTF-8, null as empty: anything further could change a
    count. Equal texts are encoded once, in whichever row has the smallest doc_id, and never again
    while the cache at that path lives (default: one of this run's own). tokenizer is a path that is
    good on every machine. Repeated rows and null ids each get their row; an empty table gives none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    cache = cache or f"{scratch.root}/cache"
    kind = tokenizer_digest(tokenizer)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    digest = F.unhex(F.sha2("text", 256))
    keyed = scratch.save(source.select("doc_id", digest.alias("digest")), "keyed")

    def known() -> DataFrame:
        rows = spark.read.schema(CACHE).parquet(cache) if _exists(spark, cache) else spark.createDataFrame([], CACHE)
        return rows.where(F.col("tokenizer") == F.lit(kind)).select("digest", "n_bytes", "n_tokens").dropDuplicates(["digest"])

    row = F.coalesce("doc_id", F.lit(-(2**63)))
    misses = keyed.groupBy("digest").agg(F.min(row).alias("row")).join(known().select("digest"), "digest", "left_anti")
    first = source.withColumn("row", row).join(misses.withColumnRenamed("digest", "want"), "row").where(digest == F.col("want"))

    def encode(batches):
        count = counter(tokenizer)
        for pdf in full(batches):
            texts = pdf["text"].tolist()
            yield pd.DataFrame({"tokenizer": [kind] * len(texts), "digest": pdf["digest"], "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": count(texts)})

    first.select(F.col("want").alias("digest"), "text").mapInPandas(encode, CACHE).write.mode("append").parquet(cache)
    # Written, so that both sides of the join are plain exchanges and a digest that many rows share can be split.
    counts = scratch.save(known(), "counts")
    return keyed.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
