"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrain.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """edges(a, b) -> (node, component), the smallest reachable node, for nodes that have an edge.

    The minimum of each node is aggregated map-side and written first, so that both sides of the
    join that follows are plain exchanges whose hot keys adaptive execution can split. Loops and
    repeated edges change nothing; no edges give no rows.
    """

    def star(e: DataFrame, k: str) -> tuple[DataFrame, DataFrame]:
        least = scratch.save(e.groupBy("a").agg(F.min("b").alias("m")), f"{name}-{k}-min")
        return e.join(least, "a"), least

    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    seen, kept = None, f"{name}-0"
    for k in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        joined, _ = star(both, f"{k}-l")
        large = scratch.save(joined.where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct(), f"{name}-{k}-large")
        joined, _ = star(large, f"{k}-s")
        small = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        now = scratch.save(small.select("e.a", "e.b").where("a <> b").distinct(), f"{name}-{k + 1}")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(kept, f"{name}-{k}-l-min", f"{name}-{k}-large", f"{name}-{k}-s-min")
        kept = f"{name}-{k + 1}"
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()
