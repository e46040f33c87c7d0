"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming links, components."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrain.llm.components import connected_components
from lexgrain.llm.scratch import Scratch, full, partitions, replaced

SHINGLE = 4
DISTANCE = 4
BLOCKS = 6
SEED = 42
BUCKET = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text; a bit is set if it is in over half the shingle hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate(([0], ends[:-1] + 1))
    n = max(len(words) - shingle + 1, 1)
    starts, stops = first[:n].tolist(), (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, 1 << 16):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[k : k + (1 << 16)], stops[k : k + (1 << 16)], strict=True)], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep, fp) for each row; a null text counts as empty and gets zero."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t) for t in batch.column("__text").to_pylist()], np.uint64)
            yield replaced(batch, ("__text",), {"fp": pa.array(fp.view(np.int64))})

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *keep, F.col(text).cast("string").alias("__text"))
    return source.mapInArrow(run, source.drop("__text").schema.add("fp", "long"))


def blocks_for(many: int, distance: int = DISTANCE) -> int:
    """Into how many blocks fingerprints are cut: the fewest whose keys leave some sixteen random fingerprints a bucket."""
    blocks = distance + 2
    while blocks < distance + 5 and 64 * (blocks - distance) / blocks < np.log2(max(many, 1)) - 4:
        blocks += 1
    return blocks


def _parts(free: int, many: int) -> list[int]:
    """The set bits of a mask, dealt into as many masks of neighbouring bits, even in size."""
    bits = [b for b in range(64) if free >> b & 1]
    cuts = [round(len(bits) * k / many) for k in range(many + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in itertools.pairwise(cuts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Each choice of blocks - distance blocks, as the mask of their bits: a pair within distance is equal under one at least."""
    part = _parts((1 << 64) - 1, blocks)
    return [sum(chosen) for chosen in itertools.combinations(part, blocks - distance)]


def _union(pairs_a: list[int], pairs_b: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of the given links."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    out = []
    for a, b in zip(pairs_a, pairs_b, strict=True):
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _links(fp: np.ndarray, rep: np.ndarray, bounds: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning links of each bucket [bounds[k], bounds[k+1]) of distinct fingerprints.

    Small buckets compare by offset, all buckets at once. In a large one each reached fingerprint is
    compared with those not reached yet only, so that a dense group costs about its size.
    """
    size = np.diff(bounds)
    small = np.repeat(size <= 64, size)
    bucket = np.repeat(np.arange(len(size)), size)
    a, b = [], []
    for d in range(1, int(size[size <= 64].max(initial=1))):
        i = np.flatnonzero((bucket[:-d] == bucket[d:]) & small[:-d])
        if not len(i):
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= distance]
        a += rep[i].tolist()
        b += rep[i + d].tolist()
    for k in np.flatnonzero(size > 64):
        f, r = fp[bounds[k] : bounds[k + 1]], rep[bounds[k] : bounds[k + 1]]
        left = np.arange(len(f))
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                near = np.bitwise_count(f[left] ^ f[x]) <= distance
                if near.any():
                    found, left = left[near], left[~near]
                    a += [int(r[x])] * len(found)
                    b += r[found].tolist()
                    queue += found.tolist()
    return _union(a, b)


def _compare(keyed: DataFrame, distance: int, limit: int) -> DataFrame:
    """keyed(mask, part, fp): links (mask null, a, b) of each bucket of up to limit fingerprints; of larger ones the rows, keyed anew.

    Fingerprints of a bucket agree in the bits of its mask. The other bits of a large bucket's mask fall
    into distance + 1 parts, one of which any linked pair shares, so it splits into buckets of longer masks.
    With log2(limit) free bits left no bucket is larger, so that this ends. A task holds limit rows or so.
    """

    def run(batches):
        held: list[pd.DataFrame] = []
        rows, large = 0, None

        def links(pdf: pd.DataFrame):
            new = (pdf["mask"].to_numpy()[1:] != pdf["mask"].to_numpy()[:-1]) | (pdf["part"].to_numpy()[1:] != pdf["part"].to_numpy()[:-1])
            fp = pdf["fp"].to_numpy()
            bounds = np.concatenate(([0], np.flatnonzero(new) + 1, [len(fp)]))
            found = pd.DataFrame(_links(fp.view(np.uint64), fp, bounds, distance), columns=["a", "b"], dtype="int64")
            return found.assign(mask=pd.array([pd.NA] * len(found), dtype="Int64"))[["mask", "a", "b"]]

        def anew(pdf: pd.DataFrame):
            mask = int(pdf["mask"].iloc[0]) & (1 << 64) - 1
            for more in _parts(~mask & (1 << 64) - 1, distance + 1):
                longer = _signed(mask | more)
                yield pd.DataFrame({"mask": pd.array([longer] * len(pdf), dtype="Int64"), "a": pdf["fp"].to_numpy() & longer, "b": pdf["fp"].to_numpy()})

        def bucket(pdf, at):
            return pdf["mask"].iloc[at], pdf["part"].iloc[at]

        for pdf in full(batches):
            if large is not None:  # the bucket that was too large goes on
                own = ((pdf["mask"] == large[0]) & (pdf["part"] == large[1])).to_numpy()
                if own.any():
                    yield from anew(pdf[own])
                if own.all():
                    continue
                large, pdf = None, pdf[~own]
            held.append(pdf)
            rows += len(pdf)
            if rows > limit:
                one = pd.concat(held, ignore_index=True)
                tail = ((one["mask"] == bucket(one, -1)[0]) & (one["part"] == bucket(one, -1)[1])).to_numpy()  # it may go on
                cut = len(one) - int(tail.sum())
                if cut:
                    yield links(one.iloc[:cut])
                one = one.iloc[cut:]
                held, rows = [one], len(one)
                if rows > limit:
                    large, held, rows = bucket(one, 0), [], 0
                    yield from anew(one)
        if rows:
            yield links(pd.concat(held, ignore_index=True))

    dealt = keyed.repartition(partitions(keyed.sparkSession), "mask", "part").sortWithinPartitions("mask", "part", "fp")
    return dealt.mapInPandas(run, "mask long, a long, b long")


def near_edges(classes: DataFrame, scratch: Scratch, blocks: int = BLOCKS, distance: int = DISTANCE, limit: int = BUCKET) -> DataFrame:
    """classes(fp), distinct -> links (a, b) between fingerprints whose transitive closure is that of all links."""
    keys = F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for m in block_masks(blocks, distance)])
    keyed, edges = classes.select("fp", F.explode(keys).alias("k")).select("k.mask", "k.part", "fp"), []
    for level in itertools.count():
        found = scratch.save(_compare(keyed, distance, limit), f"edges-{level}")
        edges.append(found.where("mask is null").select("a", "b"))
        again = found.where("mask is not null")
        if not again.limit(1).count():
            break
        keyed = again.select("mask", F.col("a").alias("part"), F.col("b").alias("fp")).distinct()
    out = edges[0]
    for more in edges[1:]:
        out = out.unionByName(more)
    return out


def grouped(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", blocks: int | None = None, distance: int = DISTANCE, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, keep, fp, group (equal for the rows that links connect) and component_id."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(fingerprints(docs, text, doc_id, keep), "prints")
    classes = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    edges = near_edges(classes.select("fp"), scratch, blocks or blocks_for(classes.count(), distance), distance)
    found = connected_components(edges, scratch)
    of_class = scratch.save(classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("group")), "groups")
    least = scratch.save(of_class.groupBy("group").agg(F.min("least").alias("component_id")), "least")
    named = scratch.save(of_class.join(least, "group").select("fp", "group", "component_id"), "named")
    return prints.join(named, "fp", "left").select("doc_id", *keep, "fp", "group", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", blocks: int | None = None, distance: int = DISTANCE) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Equal fingerprints form a class of one key first, so copies are never paired. The number of blocks
    follows from the number of fingerprints unless given; it changes the work and not the rows. Texts
    without a word have fingerprint zero and link like any other. Repeated rows give repeated rows; rows
    that share a doc_id and nothing else stay apart; a null doc_id keeps a null and never is a component's
    name unless all its members have none. Very long texts are read whole. An empty table gives no rows.
    Other columns of docs are not read.
    """
    out = grouped(docs, text, doc_id, blocks, distance)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
