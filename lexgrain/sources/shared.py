"""Tables that one step of a session writes for the next, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset a local one, if all of Spark is on this machine."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexgrain-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Written and read back: no lineage, the same rows for every reader, and safe from lost executors."""
    at = path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def versions(spark: SparkSession, table: str) -> str:
    """Names, sizes and times of a table's files: what tells whether it is still the same."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return "|".join(sorted(f"{x.getPath()} {x.getLen()} {x.getModificationTime()}" for x in found))


def put(spark: SparkSession, at: str, data: bytes) -> None:
    """A small file, through Spark's own file systems."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def get(spark: SparkSession, at: str) -> bytes:
    """A small file, of what a driver may hold."""
    return bytes(spark.read.format("binaryFile").load(at).select("content").first()["content"])
