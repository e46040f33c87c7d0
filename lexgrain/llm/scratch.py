"""Tables kept between jobs, in the folder the cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 1000


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset a local one, if all of Spark is on this machine, as in tests."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexgrain-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


class Scratch:
    """Parquet tables of one run. Losing an executor loses none of them, and reading one has no lineage.

    A result that is still to be read may rest on them: clear() removes those of a session when its
    results have been read. The session keeps the smaller Arrow batches set here, as results are lazy.
    """

    roots: dict[int, list[str]] = {}

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.roots.setdefault(id(spark.sparkContext), []).append(self.root)
        # Long texts would make batches of the default 10,000 rows too large for a worker.
        if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str, shuffles: bool = False) -> None:
        """Delete tables that no later plan reads; with shuffles, let Spark drop the shuffle files behind them too."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if shuffles:
            gc.collect()
            jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Remove all scratch tables that this session has written so far."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for root in Scratch.roots.pop(id(spark.sparkContext), []):
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(conf).delete(path, True)


def full(batches):
    """Batches with rows: a column made of no values has no type that a string column could take."""
    return (b for b in batches if len(b))


def replaced(batch: pa.RecordBatch, drop: tuple[str, ...], new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch without some columns and with new ones; the others pass as they are, whatever their types and nulls."""
    kept = {name: batch.column(k) for k, name in enumerate(batch.schema.names) if name not in drop} | new
    return pa.RecordBatch.from_arrays(list(kept.values()), names=list(kept))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
