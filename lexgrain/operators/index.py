"""The inverted index as tables: documents, postings and their statistics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrain.functions import text as T
from lexgrain.operators import regions as R
from lexgrain.sources import shared

META = "source_root string, k1 double, b double, n long, avg double, fingerprint string"
K1, B = 1.2, 0.75
DOCUMENT = ["doc_id", "path", "lang", "size_bytes", "line_count", "doc_length", "content_hash", "block_regions", "symbol_regions"]


def prepared(raw: DataFrame) -> DataFrame:
    """Rows (path, content, lang[, doc_id]) -> (doc_id, path, lang, text). Without a doc_id, ids follow the order of paths."""
    out = raw.withColumn("text", F.coalesce(F.col("content"), F.lit("")))
    if "doc_id" not in raw.columns:
        out = numbered(out)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "path", "lang", "text")


def in_order(rows: DataFrame, by: list, order: list, name: str) -> tuple[DataFrame, int]:
    """Ordinals from 0 and their number, without one task that holds all rows: range partitions, their sizes, then places within."""
    from pyspark.sql import Window

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written: range borders are drawn by sampling, so a second run of the plan could deal rows otherwise.
    dealt = shared.save(rows.repartitionByRange(n, *by).withColumn("__part", F.spark_partition_id()), "numbered")
    before, sizes = 0, {}
    for part, many in sorted((r["__part"], r["count"]) for r in dealt.groupBy("__part").count().collect()):  # a row for each partition
        sizes[part], before = before, before + many
    start = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("__part")) if sizes else F.lit(0)
    return dealt.withColumn(name, (start + F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1).cast("long")).drop("__part"), before


def numbered(rows: DataFrame) -> DataFrame:
    """Ordinals from 0 by path."""
    return in_order(rows, ["path"], ["path", "text"], "doc_id")[0]


def measured(docs: DataFrame) -> DataFrame:
    """What needs no exchange: lines, line_count, size_bytes, doc_length, content_hash."""
    out = docs.withColumn("lines", T.lines(F.col("text")))
    return out.withColumns({"line_count": F.size("lines"), "size_bytes": F.octet_length("text").cast("long"), "doc_length": F.size(T.raw_tokens(F.col("text"))).cast("long"), "content_hash": T.content_hash(F.col("text"))})


def documents(docs: DataFrame, parse: bool = True) -> DataFrame:
    return R.with_regions(measured(docs), parse).select(*DOCUMENT)


def occurrences(docs: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """(doc_id, term, line) of each token, or of the given terms only: those reach an exchange, the rest never do."""
    split = docs.select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("line", "__line"))
    found = T.tokens(F.col("__line"))
    if terms is not None:
        wanted = list(terms)
        found = F.filter(found, lambda x: x.isin(wanted))  # before the row of each token is made
    return split.select("doc_id", F.explode(found).alias("term"), (F.col("line") + 1).alias("line"))


def postings(docs: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """(term, doc_id, tf, lines): counts, and unique sorted 1-based lines."""
    return occurrences(docs, terms).groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_set("line")).alias("lines"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """total_docs, total_terms, avg_doc_length of rows with doc_length; documents without a token count."""
    total = F.coalesce(F.sum("doc_length"), F.lit(0))
    return docs.agg(F.count("*").alias("total_docs"), total.alias("total_terms"), F.when(F.count("*") > 0, total / F.count("*")).otherwise(F.lit(0.0)).cast("double").alias("avg_doc_length"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """sha1 prefix of all documents' lines id|path|hash|bytes|lines|length in order of id.

    The reference's value hashes one string of the whole corpus, which one task has to hold: some 100
    bytes a document. Larger corpora use fingerprint_tree.
    """
    line = F.concat_ws("|", "doc_id", "path", "content_hash", "size_bytes", "line_count", "doc_length")
    ordered = F.array_sort(F.collect_list(F.struct("doc_id", line.alias("s"))))
    return docs.agg(F.substring(F.sha1(F.array_join(F.transform(ordered, lambda x: x["s"]), "\n")), 1, 20).alias("fingerprint"))


def fingerprint_tree(docs: DataFrame, leaves: int = 4096) -> DataFrame:
    """A fingerprint of the same lines by leaves of id ranges: no task holds more than a leaf."""
    line = F.sha1(F.concat_ws("|", "doc_id", "path", "content_hash", "size_bytes", "line_count", "doc_length"))
    leaf = docs.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(leaves)).alias("leaf")).agg(F.sha1(F.array_join(F.array_sort(F.collect_list(line)), "")).alias("h"))
    return leaf.agg(F.substring(F.sha1(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "leaf", "h"))), "")), 1, 20).alias("fingerprint"))


@dataclass
class Index:
    """Documents and postings; statistics are of the whole corpus, whatever a query filters."""

    documents: DataFrame
    postings: DataFrame
    source_root: str = ""
    k1: float = K1
    b: float = B
    known: dict = field(default_factory=dict)  # totals and fingerprint, once they are known

    @classmethod
    def build(cls, raw: DataFrame, source_root: str = "", parse: bool = True, k1: float = K1, b: float = B) -> Index:
        docs = prepared(raw)
        return cls(documents(docs, parse), postings(docs), source_root, k1, b)

    def stats(self) -> DataFrame:
        return corpus_stats(self.documents)

    def totals(self) -> tuple[int, float]:
        """Documents, and the mean of their lengths."""
        if "n" not in self.known:
            row = self.documents.agg(F.count("*").alias("n"), F.avg(F.col("doc_length").cast("double")).alias("avg")).first()
            self.known |= {"n": row["n"], "avg": row["avg"] or 0.0}
        return self.known["n"], self.known["avg"]

    def fingerprint(self) -> str:
        if "fingerprint" not in self.known:
            self.known["fingerprint"] = fingerprint(self.documents).first()["fingerprint"]
        return self.known["fingerprint"]

    def save(self, path: str) -> None:
        """Parquet: postings in order of term within files, so that row-group statistics skip other terms; totals and fingerprint beside them."""
        self.documents.write.mode("overwrite").parquet(f"{path}/documents")
        n = int(self.postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.postings.repartitionByRange(n, "term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        done = Index(self.documents.sparkSession.read.parquet(f"{path}/documents"), self.postings)
        meta = self.documents.sparkSession.createDataFrame([(self.source_root, self.k1, self.b, *done.totals(), done.fingerprint())], META)
        meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        meta = spark.read.schema(META).json(f"{path}/meta").first()
        known = {k: meta[k] for k in ("n", "avg", "fingerprint") if meta[k] is not None}
        return cls(spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/postings"), meta["source_root"] or "", meta["k1"], meta["b"], known)

    def updated(self, raw: DataFrame, parse: bool = True) -> Index:
        """Only added and changed paths are read again; removed ones go. Kept documents keep their ids, new ones follow."""
        incoming = prepared(raw.drop("doc_id")) if "doc_id" in raw.columns else prepared(raw)
        state = diff(self.documents, measured(incoming))
        kept = self.documents.join(state.where("state = 'same'"), "path", "left_semi")
        last = self.documents.agg(F.coalesce(F.max("doc_id"), F.lit(-1))).first()[0]
        changed = numbered(incoming.drop("doc_id").join(state.where("state in ('added', 'changed')"), "path", "left_semi")).withColumn("doc_id", F.col("doc_id") + last + 1)
        return Index(kept.unionByName(documents(changed, parse)), self.postings.join(kept.select("doc_id"), "doc_id", "left_semi").unionByName(postings(changed)), self.source_root, self.k1, self.b)


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, state): added, changed, removed or same, by path and content hash."""
    a = old.select("path", F.col("content_hash").alias("a"))
    b = new.select("path", F.col("content_hash").alias("b"))
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", state.alias("state"))
