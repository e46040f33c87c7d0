"""Mixing sources to target weights, in DataFrame functions only: raking, then calibrated sampling."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrain.llm.quality import words_column
from lexgrain.llm.scratch import Scratch

DIMENSIONS = ("source", "lang", "topic")
TEMPERATURE = {"source": 0.5, "lang": 0.5, "topic": 1.0}
SEED = 17


#: Bins of hashed words that a document's vector has, one character for each, and the number of topics.
BINS = "ABCDEFGHIJKLMNOP"
TOPICS = 5
SHRINK = 20.0


def binned(text: Column) -> Column:
    """A character for each word of the whole text: the bin of the word, lower-cased."""
    names = F.lit(list(BINS))
    return F.array_join(F.transform(words_column(F.lower(text)), lambda w: F.get(names, F.pmod(F.xxhash64(w), F.lit(len(BINS))).cast("int"))), "")


def weigh(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, mark (what its draw goes by), source, lang, n_tokens, bins: the weight of each row is the words of its whole text. Nulls are a class of their own."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    mark = F.when(F.col(doc_id).isNull(), F.xxhash64(body)).otherwise(F.xxhash64(doc_id))
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")]
    rows = docs.select(F.struct(*keep, F.lit(0).alias("__none")).alias("__keep"), F.col(doc_id).alias("doc_id"), mark.alias("mark"), *named, binned(body).alias("bins"))
    return rows.withColumn("n_tokens", F.length("bins").cast("long"))


def vectors(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows(bins, n_tokens, lang, ...), a written table, with z: how far each bin's share of a document is from its language's mean share, in standard deviations.

    A share is drawn toward that mean by SHRINK words. What a language uses much or little of says nothing
    of a topic, so that topics and languages can be weighed apart; the deviations, wide for bins that
    documents differ in, stand in for inverse document frequencies.
    """
    counts = F.transform(F.lit(list(BINS)), lambda b: F.length("bins") - F.length(F.replace("bins", b, F.lit(""))))
    counted = scratch.save(rows.withColumn("counts", counts.cast("array<int>")).drop("bins"), "counts")
    full = counted.where("n_tokens > 0")
    sums = full.select("lang", F.posexplode("counts").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").cast("double").alias("x"))
    many = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("xs"), F.sum("x").alias("all"))
    means = scratch.save(many.select("lang", F.transform("xs", lambda e: e["x"] / F.col("all")).alias("mean")), "means")
    share = F.zip_with("counts", "mean", lambda c, m: (c + F.lit(SHRINK) * m) / (F.col("n_tokens") + F.lit(SHRINK)) - m)
    # Left, as a language may have no row with a word; then there is no share and nothing to place.
    apart = scratch.save(counted.join(means, "lang", "left").withColumn("share", F.when(F.col("n_tokens") > 0, share)).drop("counts", "mean"), "shares")
    wide = apart.where("n_tokens > 0").select(F.posexplode("share").alias("at", "x")).groupBy("at").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("w")).collect()  # a row for each bin
    width = {r["at"]: r["w"] for r in wide}
    scale = [1.0 / (width.get(i) or 1.0) for i in range(len(BINS))]
    return apart.withColumn("z", F.zip_with("share", F.lit(scale), lambda x, w: F.round(x * w, 4)).cast("array<float>")).drop("share")


def dot(z: Column | str, by: list[float]) -> Column:
    return F.aggregate(F.zip_with(z, F.lit(by), lambda a, b: a * b), F.lit(0.0), lambda total, x: total + x)


def nearest(z: str, centres: list[list[float]]) -> Column:
    """The centre at the least distance: that of squares, less the vector's own length, which all centres share."""
    far = F.array(*[F.named_struct(F.lit("far"), F.lit(sum(c * c for c in centre)) - F.lit(2.0) * dot(z, centre), F.lit("k"), F.lit(k)) for k, centre in enumerate(centres)])
    return F.array_min(far)["k"]


def centres_of(rows: DataFrame, many: int = TOPICS, rounds: int = 8, seed: int = SEED) -> list[list[float]]:
    """k-means over all rows with a word; each round is one aggregation, and many centres reach the driver.

    The first centres are the documents that lie farthest along fixed directions; a centre that loses all
    its documents stays where it is. Ends when no coordinate moves by a hundredth.
    """
    rng = random.Random(seed)
    full = rows.where("n_tokens > 0").select("n_tokens", "z")
    along = [[rng.gauss(0, 1) for _ in BINS] for _ in range(many)]
    first = full.agg(*[F.max(F.named_struct(F.lit("a"), dot("z", a), F.lit("z"), F.col("z"))).alias(f"c{k}") for k, a in enumerate(along)]).first()
    if first["c0"] is None:
        return [[0.0] * len(BINS)]
    centres = [[0.5 * x for x in first[f"c{k}"]["z"]] for k in range(many)]
    for _ in range(rounds):
        placed = full.select(nearest("z", centres).alias("k"), "z").select("k", F.posexplode("z").alias("at", "x"))  # in two steps: once for each row
        new = [list(c) for c in centres]
        for r in placed.groupBy("k", "at").agg(F.round(F.avg(F.col("x").cast("double")), 3).alias("m")).collect():  # a row for each coordinate of a centre
            new[r["k"]][r["at"]] = r["m"]
        moved = max(abs(a - b) for x, y in zip(centres, new, strict=True) for a, b in zip(x, y, strict=True))
        centres = new
        if moved < 0.01:
            break
    return centres


def with_topics(rows: DataFrame, many: int = TOPICS, seed: int = SEED) -> DataFrame:
    """rows(z, n_tokens) with topic: t0, t1 and so on by the nearest centre, empty without a word."""
    topic = F.concat(F.lit("t"), nearest("z", centres_of(rows, many, seed=seed)).cast("string"))
    return rows.withColumn("topic", F.when(F.col("n_tokens") == 0, "empty").otherwise(topic))


def tempered(cells: DataFrame, by: str, power: float) -> DataFrame:
    """Target shares by, share: each class's token share to that power, made to add up to one."""
    one = cells.groupBy(by).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0")
    total = one.agg(F.sum(F.pow("t", F.lit(power)))).first()[0] or 1.0
    return one.select(by, (F.pow("t", F.lit(power)) / F.lit(total)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], scratch: Scratch, rounds: int = 30, tolerance: float = 1e-6) -> DataFrame:
    """Iterative proportional fitting of cells(source, lang, topic, tokens): adds weight, with sum 1.

    One round scales to each marginal in turn; a class without tokens has no cell and its target
    share goes to the others. Ends when no marginal is off by more than the tolerance.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    now = cells.where("tokens > 0").withColumn("weight", F.col("tokens") / F.lit(float(total)))
    for by, target in targets.items():
        now = now.join(target.select(by, F.col("share").alias(f"share_{by}")), by)
    now = scratch.save(now, "rake-0")
    kept = "rake-0"
    for k in range(1, rounds + 1):
        step = now.withColumn("off", F.lit(0.0))
        for by in targets:  # cells only: a row for each class of all three, however many documents
            scale = F.col(f"share_{by}") / F.sum("weight").over(Window.partitionBy(by))
            step = step.withColumn("scale", scale).withColumn("off", F.greatest("off", F.abs(F.col("scale") - 1))).withColumn("weight", F.col("weight") * F.col("scale"))
        now = scratch.save(step.drop("scale"), f"rake-{k}")
        scratch.drop(kept)
        kept = f"rake-{k}"
        if (now.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
    return now.select(*DIMENSIONS, "tokens", "weight")


def rate(cells: DataFrame, budget: float) -> float:
    """The factor f for which the tokens kept with probability min(1, f * weight / share) are that part of all, by filling up.

    A few rounds: each counts the cells that are full, and spreads the rest of the budget over the others.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return 0.0
    ratio = F.col("weight") * F.lit(total) / F.col("tokens")
    f = budget
    for _ in range(100):
        full = ratio * F.lit(f) >= 1
        row = cells.agg(F.sum(F.when(full, F.col("tokens"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            return f
        new = (budget * total - (row["full"] or 0)) / (row["open"] * total)
        if abs(new - f) <= 1e-12 * f:
            return f
        f = new
    return f


def mix(docs: DataFrame, budget: float = 0.5, powers: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, seed: int = SEED, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: keep, doc_id, source, lang, topic, n_tokens, probability, weight, kept.

    topic is a cluster of hashed TF-IDF vectors of the whole texts, apart from their languages' means, by
    k-means over all rows. Target shares of the tokens of each source, language and topic are given as targets (column of
    that name, share), or are the present shares to the given powers. budget is the part of all
    tokens that is expected to be kept. A cell that cannot give its part is kept whole; weight says by
    how much each kept row then counts for the targets to hold. kept compares the probability with a
    hash of doc_id and seed, or of the text where there is no doc_id: the same for repeated rows, on each
    machine and in each run. Null sources and languages are classes of their own, shown as ''. Rows without a token have no part in it and
    are not kept. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    placed = scratch.save(vectors(scratch.save(weigh(docs, text, doc_id, keep), "weighed"), scratch), "vectors")
    rows = scratch.save(with_topics(placed).drop("z"), "rows")
    scratch.drop("weighed", "counts", "means", "shares", "vectors")
    cells = scratch.save(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    aims = targets or {by: scratch.save(tempered(cells, by, (powers or TEMPERATURE)[by]), f"aim-{by}") for by in DIMENSIONS}
    raked = rake(cells, aims, scratch)
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    wanted = F.lit(rate(raked, budget)) * F.col("weight") * F.lit(total) / F.col("tokens")
    rates = scratch.save(raked.select(*DIMENSIONS, F.least(F.lit(1.0), wanted).alias("probability"), F.greatest(F.lit(1.0), wanted).alias("weight")), "rates")
    draw = F.shiftrightunsigned(F.xxhash64("mark", F.lit(seed)), 11) / F.lit(float(1 << 53))
    out = rows.join(rates, list(DIMENSIONS), "left").withColumn("probability", F.when(F.col("n_tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(0.0))
    return out.select(*[F.col("__keep")[k].alias(k) for k in keep], "doc_id", *DIMENSIONS, "n_tokens", "probability", F.coalesce("weight", F.lit(0.0)).alias("weight"), (draw < F.col("probability")).alias("kept"))
