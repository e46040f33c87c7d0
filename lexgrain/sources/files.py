"""Source trees, manifests, task sets and index files as tables, and back."""

from __future__ import annotations

import json
import re
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrain.functions import text as T
from lexgrain.operators import regions as R
from lexgrain.operators.contracts import TASK
from lexgrain.operators.index import B, K1, Index
from lexgrain.sources import shared

# Folders that hold no sources of their own.
SKIPPED = (".git", ".hg", ".svn", ".idea", ".vscode", "__pycache__", "node_modules", "target", "dist", "build", ".venv", "venv")
MANIFEST = "corpora array<struct<id:string,url:string,commit:string,tag:string,license:string,primary_language:string,notes:string>>"
REGION = "array<struct<start:int,end:int>>"
INDEX = f"version string, source_root string, documents array<struct<doc_id:bigint,path:string,lang:string,size_bytes:bigint,line_count:int,doc_length:bigint,content_hash:string,block_regions:{REGION},symbol_regions:{REGION}>>, index map<string,struct<df:bigint,postings:array<struct<doc_id:bigint,tf:bigint,lines:array<int>>>>>, stats struct<total_docs:bigint,total_terms:bigint,avg_doc_length:double,corpus_fingerprint:string>, bm25 struct<k1:double,b:double>"


def default_patterns() -> list[str]:
    return [f"*{s}" for s in T.LANGUAGE_OF_SUFFIX]


def _listing(spark: SparkSession, root: str, patterns: list[str] | None) -> DataFrame:
    names = ",".join(p.removeprefix("**/") for p in patterns or default_patterns())
    # A file that goes or breaks while it is read is left out, and does not fail the job.
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    files = _with_empty(reader.option("pathGlobFilter", "{" + names + "}").load(root))
    scheme = "^[a-z0-9+.-]+:/+"
    start = len(re.sub(scheme, "/", root).rstrip("/")) + 2
    return files.withColumn("rel", F.substring(F.regexp_replace("path", scheme, "/"), start, 1 << 16))


def _with_empty(files: DataFrame) -> DataFrame:
    """The files with the empty ones, which Spark's readers pass over: of what was listed and not read, those of no length."""
    spark = files.sparkSession
    rows = files.select("path", "length", "content")
    listed = spark.createDataFrame([(x, re.sub("^[a-z0-9+.-]+:/+", "/", unquote(x))) for x in files.inputFiles()], "name string, plain string")
    missed = listed.join(rows.select(F.regexp_replace("path", "^[a-z0-9+.-]+:/+", "/").alias("plain")), "plain", "left_anti").collect()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(r["name"])) for r in missed]
    empty = [(p.toString(), 0, b"") for p in at if p.getFileSystem(conf).getFileStatus(p).getLen() == 0]
    return rows.unionByName(spark.createDataFrame(empty, "path string, length long, content binary")) if empty else rows


def read_tree(spark: SparkSession, root: str, patterns: list[str] | None = None, skip: bool = False) -> DataFrame:
    """(path, content, lang) of the files that match; bytes that are no UTF-8 are left out, as are unreadable files.

    Valid content is taken as it is, a U+FFFD of its own too; only broken content is repaired. skip=True leaves out vendored folders and documentation, as corpus balancing does.
    """
    files = _listing(spark, root, patterns)
    if skip:
        files = files.where(~F.col("rel").rlike(_skipped())).where(T.language_of(T.suffix(F.col("rel")), T.CODE_LANGUAGE_OF_SUFFIX).isNotNull())
    raw = F.col("content").cast("string")
    broken = ~F.is_valid_utf8(raw)
    text = F.when(broken, F.pandas_udf(_repair_batch, "string")(F.when(broken, F.col("content")))).otherwise(raw)
    return files.select(F.col("rel").alias("path"), text.alias("content"), T.language_of(T.suffix(F.col("rel"))).alias("lang"))


def _repair_batch(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def _skipped() -> str:
    return "(^|/)(" + "|".join(s.replace(".", "\\.") for s in SKIPPED) + ")/"


def scan_code_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, lang, size, suffix, depth) from file metadata: contents are pruned from the scan."""
    files = _listing(spark, root, [f"*{s}" for s in T.CODE_LANGUAGE_OF_SUFFIX]).where(~F.col("rel").rlike(_skipped()))
    end = T.suffix(F.col("rel"))
    return files.select(F.col("rel").alias("path"), T.language_of(end, T.CODE_LANGUAGE_OF_SUFFIX).alias("lang"), F.col("length").alias("size"), end.alias("suffix"), (F.size(F.split("rel", "/")) - 1).alias("depth"))


def scan_counts(spark: SparkSession, root: str) -> DataFrame:
    """(status, n): how many files an index of the tree takes, leaves by name, or cannot read."""
    listed = _with_empty(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)).select("path")
    skipped = F.col("path").rlike(_skipped()) | T.language_of(T.suffix(F.col("path")), T.CODE_LANGUAGE_OF_SUFFIX).isNull()
    taken = listed.where(~skipped)
    whole = _with_empty(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(root))
    read = whole.where(F.octet_length("content") == F.col("length")).select("path")
    errors = taken.join(read, "path", "left_anti").select(F.lit("errors").alias("status"))
    rows = listed.where(skipped).select(F.lit("skipped").alias("status")).unionByName(taken.join(read, "path", "left_semi").select(F.lit("indexed").alias("status"))).unionByName(errors)
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def read_manifest(spark: SparkSession, *paths: str) -> DataFrame:
    """The corpora of the first manifest that can be read."""
    for path in paths:
        try:
            return spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.explode("corpora").alias("c")).select("c.*")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) or path == paths[-1]:
                raise
    raise ValueError("no manifest given")


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks from JSON lines; blank lines are left out."""
    return spark.read.schema(TASK).json(path).where("id is not null")


def select_corpora(corpora: DataFrame, tasks: DataFrame | None = None, repos: list[str] | None = None) -> DataFrame:
    """Named repositories, else those that tasks use, else all."""
    if repos:
        return corpora.where(F.col("id").isin(list(repos)))
    return corpora if tasks is None else corpora.join(tasks.select(F.col("repo").alias("id")).distinct(), "id", "left_semi")


def export_index(index: Index, path: str) -> None:
    """The documented JSON layout in one file, for exchange of small indices: the driver holds it. Tables are the format to work with."""
    docs = [r.asDict(True) for r in index.documents.orderBy("doc_id").toLocalIterator()]
    terms = {r["term"]: {"df": len(r["p"]), "postings": [{"doc_id": p["doc_id"], "tf": p["tf"], "lines": list(p["lines"])} for p in r["p"]]} for r in index.postings.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("doc_id", "tf", "lines"))).alias("p")).orderBy("term").toLocalIterator()}
    s = index.stats().first()
    data = {"version": "inverted.v2", "source_root": index.source_root, "documents": docs, "index": terms, "stats": {**s.asDict(), "corpus_fingerprint": index.fingerprint()}, "bm25": {"k1": index.k1, "b": index.b}}
    shared.put(index.documents.sparkSession, path, json.dumps(data, indent=2).encode())


def import_index(spark: SparkSession, path: str) -> Index:
    """From that layout. Regions are clamped and bad ones dropped, lines sorted and unique from 1, a missing length summed from counts."""
    raw = spark.read.schema(INDEX).json(path, multiLine=True)
    entries = raw.select(F.explode("index").alias("term", "e")).select("term", F.explode("e.postings").alias("p"))
    posts = entries.select("term", "p.doc_id", "p.tf", F.array_sort(F.array_distinct(F.filter("p.lines", lambda x: x >= 1))).alias("lines"))
    sums = posts.groupBy("doc_id").agg(F.sum("tf").alias("__sum"))
    docs = raw.select(F.explode("documents").alias("d")).select("d.*").join(sums, "doc_id", "left")
    n = F.greatest(F.coalesce("line_count", F.lit(1)), F.lit(1))
    docs = docs.withColumn("doc_length", F.when(F.coalesce("doc_length", F.lit(0)) > 0, F.col("doc_length")).otherwise(F.coalesce("__sum", F.lit(0)))).withColumn("line_count", n).drop("__sum")
    block = R.first_of(R.normalized(F.col("block_regions"), n), R.whole(n))
    docs = docs.withColumn("block_regions", block).withColumn("symbol_regions", R.first_of(R.normalized(F.col("symbol_regions"), n), F.col("block_regions")))
    meta = raw.select("source_root", "bm25.k1", "bm25.b").first()
    return Index(docs, posts, meta["source_root"] or "", K1 if meta["k1"] is None else meta["k1"], B if meta["b"] is None else meta["b"])


def write_summary(summary: DataFrame, path: str) -> None:
    """A small result table as JSON lines in one file."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def markdown_report(title: str, tables: dict[str, DataFrame], most: int = 50) -> str:
    """A report from small summaries; the first rows of each."""
    out = [f"# {title}", ""]
    for name, df in tables.items():
        rows = df.limit(most).collect()
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]
        out.append("")
    return "\n".join(out)


def with_sources(repositories: DataFrame, root: str, balanced: bool) -> DataFrame:
    """Repository rows with their source under the balanced or the raw tree."""
    return repositories.withColumn("source", F.concat(F.lit(f"{root.rstrip('/')}/{'balanced' if balanced else 'raw'}/"), F.col("id")))


def select_files(files: DataFrame, sample: DataFrame) -> DataFrame:
    """The files of a balanced sample: the selection is a table, nothing is copied."""
    return files.join(sample.select("repo", "path"), ["repo", "path"], "left_semi")
