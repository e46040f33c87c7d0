"""Embedding near-duplicates: sorted projection passes, bounded windows, verified links, exact counts.

Each pass orders the vectors of a label by the concatenated signs of random projections and compares
every vector with those near it in that order. Verified pairs of all passes are united. The window
bounds what a pass compares, not what is counted: the links of a vector all lie in its component, and
there every pair is compared, in blocks that give counts and no pairs.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrain.llm.components import connected_components
from lexgrain.llm.scratch import Scratch, full, partitions, replaced
from lexgrain.llm.simhash import _union

THRESHOLD = 0.98
PASSES = 12
BITS = 48
WINDOW = 64
SEED = 29


def packed(x: np.ndarray) -> bytes:
    """A vector's bytes: of its numbers in single precision where they are the same numbers, else in double."""
    single = x.astype(np.float32)
    return b"4" + single.tobytes() if (single == x).all() else b"8" + x.tobytes()


def matrix(blobs) -> np.ndarray:
    """The packed vectors of one dimension, in double precision, one row for each."""
    if all(b[:1] == b"4" for b in blobs):
        return np.frombuffer(b"".join(b[1:] for b in blobs), np.float32).reshape(len(blobs), -1).astype(np.float64)
    return np.array([np.frombuffer(b, np.float32 if b[:1] == b"4" else np.float64, offset=1) for b in blobs], np.float64)


def units(blobs) -> np.ndarray:
    """Unit vectors in double precision, one row for each packed vector."""
    x = matrix(blobs)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def prepared(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, key (null: links with nothing), space and blob: equal keys are equal vectors of one label.

    A space holds the vectors of one label and dimension.
    """

    def run(batches):
        for batch in batches:
            keys, spaces, blobs = [], [], []
            for i, e, name in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "embedding", "label")), strict=True):
                key = space = blob = None
                if e is not None and name is not None and i is not None and len(e):
                    x = np.array([np.nan if v is None else v for v in e], np.float64) + 0.0  # no negative zeros
                    if np.isfinite(x).all() and np.isfinite(norm := float(x @ x)) and norm > 0:
                        space, blob = f"{len(x)} {name}", packed(x)
                        key = hashlib.sha256(space.encode() + b"\0" + blob).digest()
                keys.append(key)
                spaces.append(space)
                blobs.append(blob)
            yield replaced(batch, ("embedding", "label"), {"key": pa.array(keys, pa.binary()), "space": pa.array(spaces, pa.string()), "blob": pa.array(blobs, pa.binary())})

    source = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), F.col(label).cast("string").alias("label"))
    return source.mapInArrow(run, "vec_id long, key binary, space string, blob binary")


def signs(blobs, turn: int, bits: int = BITS) -> np.ndarray:
    """The concatenated projection signs of one pass, first projection highest."""
    x = matrix(blobs)
    planes = np.random.default_rng([SEED, turn, x.shape[1]]).standard_normal((x.shape[1], bits))
    return ((x @ planes > 0) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))).astype(np.int64)


def near_in_order(pdf: pd.DataFrame, window: int, threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows of one turn and space that are within a window of each other."""
    a, b = [], []
    for _, part in pdf.groupby(["turn", "space"], sort=False):
        x, rep = units(part["blob"].tolist()), part["rep"].to_numpy()
        for k in range(0, len(x), window):
            rows, columns = np.nonzero(np.triu(x[k : k + window] @ x[k : k + 2 * window].T >= threshold, 1))
            a += rep[rows + k].tolist()
            b += rep[columns + k].tolist()
    return _union(a, b)


ORDERED = "turn int, space string, code long, rep long, blob binary"
FOUND = f"a long, b long, part int, tail boolean, place int, {ORDERED}"


def window_links(classes: DataFrame, scratch: Scratch, passes: int = PASSES, window: int = WINDOW, threshold: float = THRESHOLD) -> DataFrame:
    """classes(rep, space, blob) -> links (a, b) of pairs within a window of any pass, a spanning forest of each task's.

    A pass is one order over all tasks: where a task's rows end and the next one's begin, a window goes on.
    """
    n = partitions(scratch.spark)

    def project(batches):
        for pdf in full(batches):
            for space, part in pdf.groupby("space", sort=False):
                blobs = part["blob"].tolist()
                for turn in range(passes):
                    yield pd.DataFrame({"turn": turn, "space": space, "code": signs(blobs, turn), "rep": part["rep"].to_numpy(), "blob": blobs})

    shape = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("part", pa.int32()), ("tail", pa.bool_()), ("place", pa.int32()), ("turn", pa.int32()), ("space", pa.string()), ("code", pa.int64()), ("rep", pa.int64()), ("blob", pa.binary())])

    def rows_of(many: int, **known) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(known[f.name], f.type) if f.name in known else pa.nulls(many, f.type) for f in shape], schema=shape)

    def compare(batches):
        part, held, first, rows = TaskContext.get().partitionId(), None, None, 0
        for batch in full(batches):
            pdf = batch.to_pandas()
            first = pdf.iloc[:window] if first is None else first if len(first) >= window else pd.concat([first, pdf.iloc[: window - len(first)]])
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            found = near_in_order(pdf, window, threshold)
            yield rows_of(len(found), a=[x for x, _ in found], b=[y for _, y in found])
            held = pdf.iloc[-window:]
        for tail, ends in ((False, first), (True, held)):
            if ends is not None:
                many = len(ends)
                yield rows_of(many, part=[part] * many, tail=[tail] * many, place=range(many), **{c: ends[c].tolist() for c in ("turn", "space", "code", "rep", "blob")})

    def across(batches):
        held = None
        for pdf in full(batches):
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            groups = [g for _, g in pdf.groupby("border", sort=False)]
            held = groups.pop()  # it may go on
            for g in groups:
                yield pd.DataFrame(near_in_order(g, window, threshold), columns=["a", "b"], dtype="int64")
        if held is not None:
            yield pd.DataFrame(near_in_order(held, window, threshold), columns=["a", "b"], dtype="int64")

    # Written first: range borders are drawn from a sample of the rows, which would make all projections a second time.
    rows = scratch.save(classes.select("rep", "space", "blob").mapInPandas(project, ORDERED), "projected")
    dealt = rows.repartitionByRange(n, "turn", "space", "code", "rep").sortWithinPartitions("turn", "space", "code", "rep")
    found = scratch.save(dealt.mapInArrow(compare, FOUND), "windows")
    scratch.drop("projected", shuffles=True)
    inside, ends = found.where("a is not null").select("a", "b"), found.where("part is not null")
    full_parts = sorted(r["part"] for r in ends.select("part").distinct().collect())  # tasks that had rows
    after = {p: q for p, q in itertools.pairwise(full_parts)}
    if not after:
        return inside
    border = F.when(F.col("tail"), F.element_at(F.create_map(*[F.lit(x) for kv in after.items() for x in kv]), F.col("part"))).otherwise(F.col("part"))
    met = ends.withColumn("border", border).where("border is not null")
    met = met.repartition(n, "border").sortWithinPartitions("border", F.desc("tail"), "place")
    return inside.unionByName(met.select("border", "turn", "space", "rep", "blob").mapInPandas(across, "a long, b long"))


def counted(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """members(component, rep, many, blob) -> (rep, links): how many vectors of other classes in its component link with each.

    A component of m classes falls into about sqrt(m) chunks; each two of them meet in one block, so
    that no task holds a large component.
    """
    sizes = members.groupBy("component").agg(F.ceil(F.sqrt(F.count("*"))).cast("int").alias("chunks"))
    sized = members.join(sizes, "component").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    met = sized.select("component", "rep", "many", "blob", "chunk", other.alias("other")).select("component", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), "chunk", "rep", "many", "blob")

    def block(part: pd.DataFrame) -> pd.DataFrame:
        u, many, chunk = units(part["blob"].tolist()), part["many"].to_numpy(), part["chunk"].to_numpy()
        near = u @ u.T >= threshold
        if part["x"].iloc[0] != part["y"].iloc[0]:
            near &= chunk[:, None] != chunk[None, :]
        np.fill_diagonal(near, False)
        return pd.DataFrame({"rep": part["rep"], "links": near @ many})

    def run(batches):
        held = None
        for pdf in full(batches):
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            groups = [g for _, g in pdf.groupby(["component", "x", "y"], sort=False)]
            held = groups.pop()  # it may go on
            if groups:
                yield pd.concat(map(block, groups), ignore_index=True)
        if held is not None:
            yield block(held)

    dealt = met.repartition(partitions(members.sparkSession), "component", "x", "y").sortWithinPartitions("component", "x", "y", "rep")
    return dealt.mapInPandas(run, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Only vectors of equal, non-null label (and dimension) are compared. Vectors that are null, empty,
    zero, or hold a null or a non-finite component link with nothing, nor does a row without an id; such
    a row's component_id is its own vec_id. Equal vectors are one class, never paired; each row counts as
    a vector. Links that only chains of unseen pairs would show can be missed: recall is measured in the
    tests. Within a component every pair is compared, so ties at the threshold count wherever they are;
    that work grows with the square of the component. An empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "embeddings")
    rows = scratch.save(prepared(vectors, vec_id, embedding, label), "rows")
    groups = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many"))
    heads = rows.select(F.col("vec_id").alias("rep"), F.col("key").alias("own"), "space", "blob").dropDuplicates(["rep", "own"])
    classes = scratch.save(groups.join(heads, "rep").where("own = key").select("key", "rep", "many", "space", "blob"), "classes")
    edges = scratch.save(window_links(classes, scratch, passes, window, threshold), "edges")
    found = scratch.save(connected_components(edges, scratch), "found")
    members = scratch.save(classes.join(found, classes["rep"] == found["node"]).select("component", "rep", "many", "blob"), "members")
    links = scratch.save(counted(members, threshold), "links")
    named = classes.select("key", "rep", "many").join(found, F.col("rep") == found["node"], "left").join(links.withColumnRenamed("rep", "linked"), F.col("rep") == F.col("linked"), "left")
    named = scratch.save(named.select("key", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "named")
    out = rows.select("vec_id", "key").join(named, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
