"""Retrieval evaluation over tables of results: ranks, recall and MRR roll-ups, comparisons, ablation, grids."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrain.functions import text as T
from lexgrain.operators.index import K1, B, Index
from lexgrain.operators.search import SHOULD_BOOST, Query, Search, SymbolWeights

# What a task of each difficulty weighs.
DIFFICULTY_WEIGHT = {"easy": 1.0, "medium": 1.5, "hard": 2.0}


# Query relaxation.


def harness_terms(must: list[str]) -> list[str]:
    return [x for t in must for x in re.findall("[a-z]+|[0-9]+", t.lower())]


def relax(must: list[str], min_match_ratio: float = 0.5, max_terms: int = 3) -> Query:
    """First max_terms terms; the head stays required, the tail becomes optional with one match needed."""
    terms = harness_terms(must)[:max_terms]
    if len(terms) < 2:
        return Query.of(must=terms)
    split = max(1, int(len(terms) * (1 - min_match_ratio)))
    return Query.of(must=terms[:split], should=terms[split:], min_match=1 if terms[split:] else 0)


def relax_search_variant(must: list[str], min_match_ratio: float, max_terms: int) -> Query:
    """The parameter search's variant: a ratio of 0 keeps all required; the optional tail needs no match."""
    terms = harness_terms(must)[:max_terms]
    if not min_match_ratio or len(terms) < 2:
        return Query.of(must=terms)
    split = max(1, int(len(terms) * (1 - min_match_ratio)))
    return Query.of(must=terms[:split], should=terms[split:])


def relaxed_columns(terms: Column, ratio: float, max_terms: int) -> tuple[Column, Column, Column]:
    """relax() on data: (must, should, min_match) of an array of terms."""
    few = F.slice(terms, 1, max_terms)
    n = F.size(few)
    split = F.when(n < 2, n).otherwise(F.greatest(F.lit(1), F.floor(n * F.lit(1 - ratio)).cast("int")))
    should = F.when(n > split, F.slice(few, split + 1, F.greatest(n - split, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return F.slice(few, 1, F.greatest(split, F.lit(0))), should, F.when(n > split, 1).otherwise(0)


def variant_columns(terms: Column, ratio: float, max_terms: int) -> tuple[Column, Column]:
    """relax_search_variant() on data: (must, should) of an array of terms."""
    must, should, _ = relaxed_columns(terms, ratio, max_terms)
    return (must, should) if ratio else (F.slice(terms, 1, max_terms), F.array().cast("array<string>"))


def ablation_columns(terms: Column, symbols: Column) -> Column:
    """ablation_variants() on data: an array of (variant, must, should, symbol, near_terms)."""
    none = F.array().cast("array<string>")
    head, tail = F.slice(terms, 1, 2), F.slice(terms, 3, F.greatest(F.size(terms), F.lit(1)))
    near = F.when(F.size(terms) >= 2, head).otherwise(none)
    row = lambda name, should, symbol, by: F.struct(F.lit(name).alias("variant"), terms.alias("must"), should.alias("should"), symbol.alias("symbol"), by.alias("near_terms"))
    return F.array(row("bm25_only", none, none, none), row("plus_symbol", none, symbols, none), row("plus_near", none, symbols, near), row("plus_prior", F.when(F.size(tail) > 0, tail).otherwise(head), symbols, near))


def ablation_variants(terms: list[str], symbols: list[str]) -> dict[str, Query]:
    head, tail = terms[:2], terms[2:]
    near = [{"terms": terms[:2], "scope": "line_window", "window": 20}] if len(terms) >= 2 else []
    return {"bm25_only": Query.of(must=terms), "plus_symbol": Query.of(must=terms, symbol=symbols), "plus_near": Query.of(must=terms, symbol=symbols, near=near), "plus_prior": Query.of(must=terms, should=tail or head, symbol=symbols, near=near)}


# All queries of a task set at once.


def batch_search(documents: DataFrame, postings: DataFrame, tasks: DataFrame, top: int = 50, k1: float = K1, b: float = B) -> DataFrame:
    """tasks(task_id, must, should, min_match) -> (task_id, rank, doc_id, path, score), top results of each.

    One plan for any number of tasks: postings meet the tasks' terms, documents their lengths, and each
    task keeps its best before the exchange that ranks them. Scores are summed in order of the query.
    """
    stats = documents.agg(F.count("*").cast("double").alias("n"), F.avg(F.col("doc_length").cast("double")).alias("avg")).first()  # two numbers
    slot = lambda kind: F.transform(kind, lambda t, i: F.struct(t.alias("term"), i.alias("at"), F.lit(kind == "must").alias("must")))
    asked = tasks.select("task_id", F.size("must").alias("n_must"), "min_match", F.explode(F.concat(slot("must"), slot("should"))).alias("q")).select("task_id", "n_must", "min_match", "q.*")
    needed = postings.join(asked.select("term").distinct(), "term", "left_semi").select("term", "doc_id", "tf")
    df = needed.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    rows = needed.join(df, "term").join(documents.select("doc_id", "doc_length"), "doc_id")
    tf, n, avg = F.col("tf").cast("double"), F.lit(stats["n"]), F.lit(stats["avg"] or 1.0)
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    score = idf * (tf * F.lit(k1 + 1.0) / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * (F.col("doc_length").cast("double") / avg))))
    hits = rows.withColumn("s", score).join(asked, "term")
    part = F.struct((~F.col("must")).alias("late"), "at", F.when(F.col("must"), F.col("s")).otherwise(F.col("s") * SHOULD_BOOST).alias("s"))
    found = hits.groupBy("task_id", "doc_id", "n_must", "min_match").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.sum(F.col("must").cast("int")).alias("musts"), F.sum((~F.col("must")).cast("int")).alias("shoulds"))
    found = found.where((F.col("musts") == F.col("n_must")) & (F.col("shoulds") >= F.col("min_match")))
    total = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["s"])
    points = F.greatest(F.lit(0), F.least(F.lit(1000), (F.least(total, F.lit(100.0)) * 100).cast("int")))
    ranked = found.select("task_id", "doc_id", points.alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= top)
    return ranked.join(documents.select("doc_id", "path"), "doc_id").select("task_id", "rank", "doc_id", "path", "score")


def relaxed_tasks(tasks: DataFrame, ratio: float = 0.5, max_terms: int = 3) -> DataFrame:
    """tasks(task_id, must) -> (task_id, must, should, min_match) by relaxation."""
    must, should, need = relaxed_columns(T.plain_terms(F.col("must")), ratio, max_terms)
    return tasks.select("task_id", must.alias("must"), should.alias("should"), need.alias("min_match"))


def evaluate_tasks(documents: DataFrame, postings: DataFrame, tasks: DataFrame, ratio: float = 0.5, max_terms: int = 3, k: int = 10) -> DataFrame:
    """tasks(task_id, must, gold_file, ...) -> each with its rank among k results of its relaxed query."""
    return gold_rank(batch_search(documents, postings, relaxed_tasks(tasks, ratio, max_terms), k), tasks)


def run_ablation(index: Index, tasks: list[dict], k: int = 10, weights: SymbolWeights | None = None) -> DataFrame:
    """tasks(id, must, symbols, gold_file) under each variant: (variant, recall, mrr) and the differences to plain BM25."""
    parts, gold = [], []
    for t in tasks:
        for name, q in ablation_variants(harness_terms(t["must"]), t["symbols"]).items():
            found = Search.indexed(index, q, weights=weights).ranked(k)
            order = Window.orderBy(F.desc("score"), "doc_id")  # k rows
            parts.append(found.select(F.lit(f"{name}/{t['id']}").alias("task_id"), F.row_number().over(order).alias("rank"), "path"))
            gold.append((f"{name}/{t['id']}", name, t["gold_file"]))
    results = parts[0]
    for p in parts[1:]:
        results = results.unionByName(p)
    every = index.documents.sparkSession.createDataFrame(gold, "task_id string, variant string, gold_file string")
    return deltas(summary(gold_rank(results, every), "variant").select("variant", "recall", "mrr"))


# From ranked results to ranks.


def gold_rank(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """results(task_id, rank, path), tasks(task_id, gold_file, ...) -> tasks with rank, found and rr.

    The first result whose path contains the gold file; an empty one matches nothing.
    """
    hit = F.col("path").contains(F.col("gold_file")) & (F.col("gold_file") != "")
    first = results.join(tasks.select("task_id", "gold_file"), "task_id").where(hit).groupBy("task_id").agg(F.min("rank").alias("rank"))
    out = tasks.join(first, "task_id", "left")
    return out.withColumn("found", F.col("rank").isNotNull()).withColumn("rr", F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0)))


def recall() -> Column:
    return F.avg(F.col("found").cast("int").cast("double")).alias("recall")


def mrr() -> Column:
    return F.avg("rr").alias("mrr")


def summary(ranks: DataFrame, *by: str) -> DataFrame:
    return ranks.groupBy(*by).agg(F.count("*").alias("total"), F.sum(F.col("found").cast("int")).alias("found"), recall(), mrr())


def rollup_by(ranks: DataFrame, *by: str) -> DataFrame:
    """All levels in one pass; a null stands for all."""
    return ranks.rollup(*by).agg(F.count("*").alias("total"), F.sum(F.col("found").cast("int")).alias("found"), recall(), mrr())


def overall(ranks: DataFrame, group: str = "repo") -> DataFrame:
    """Pooled recall; macro means of the groups' MRR and latency; micro MRR weighted by tasks."""
    per = ranks.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.col("found").cast("int")).alias("found"), F.avg("rr").alias("mrr"), F.avg("latency_ms").alias("latency"))
    return per.agg(F.sum("n").alias("total"), F.sum("found").alias("found"), (F.sum("found") / F.sum("n")).alias("recall"), F.avg("mrr").alias("macro_mrr"), (F.sum(F.col("mrr") * F.col("n")) / F.sum("n")).alias("micro_mrr"), F.avg("latency").alias("macro_latency"))


def compare_tools(runs: DataFrame) -> DataFrame:
    """runs(tool, found, rr, latency_ms, stdout_bytes) -> a row for each tool."""
    return runs.groupBy("tool").agg(F.count("*").alias("total"), recall(), mrr(), F.avg("latency_ms").alias("avg_latency_ms"), F.sum("stdout_bytes").alias("stdout_bytes"))


def own_metrics(runs: DataFrame, tool: str) -> DataFrame:
    """One tool's figures over all comparisons, those without a row of it too."""
    own = F.col("tool") == tool
    n = F.count_distinct("task_id")
    return runs.agg((F.sum(F.when(own & F.col("found"), 1).otherwise(0)) / n).alias("recall"), (F.sum(F.when(own, F.col("rr")).otherwise(0.0)) / n).alias("mrr"), (F.sum(F.when(own, F.col("latency_ms")).otherwise(0.0)) / n).alias("mean_latency_ms"), (F.sum(F.when(own, F.col("stdout_bytes")).otherwise(0)) / n).alias("mean_stdout_bytes"))


# Distributions.


def quantiles(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, p50, p95, p99 by linear interpolation; zeros for an empty table."""
    x = F.col(value).cast("double")
    p = F.percentile(x, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = rows.groupBy(*by).agg(F.count(x).alias("n"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), p.alias("p"))
    return out.select(*by, "n", "mean", *[F.coalesce(F.get("p", F.lit(i)), F.lit(0.0)).alias(f"p{k}") for i, k in enumerate((50, 95, 99))])


def confidence(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, sample standard deviation and half width of the 95 % interval; 0 for one row."""
    x = F.col(value).cast("double")
    std = F.coalesce(F.stddev_samp(x), F.lit(0.0))
    std = F.when(F.count(x) > 1, std).otherwise(F.lit(0.0))
    return rows.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), std.alias("std"), (F.lit(1.96) * std / F.sqrt(F.greatest(F.count(x), F.lit(1)).cast("double"))).alias("ci95"))


def share_of(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, share, dominant): dominant is a share over 0.6."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total")).select("total", F.lit(1).alias("__one"))  # one row
    shares = counts.withColumn("__one", F.lit(1)).join(F.broadcast(total), "__one")
    return shares.select(key, "n", (F.col("n") / F.col("total")).alias("share")).withColumn("dominant", F.col("share") > 0.6)


def tool_calls(ranks: DataFrame, inspect_limit: int = 5) -> DataFrame:
    """Mean calls of search-then-inspect against one call, and the reduction."""
    calls = F.lit(1) + F.least(F.coalesce("rank", F.lit(inspect_limit)), F.lit(inspect_limit))
    return ranks.agg(F.avg(calls.cast("double")).alias("grep_calls"), F.lit(1.0).alias("own_calls"), (F.lit(1.0) - F.lit(1.0) / F.avg(calls.cast("double"))).alias("reduction"))


def deltas(by_variant: DataFrame, base: str = "bm25_only") -> DataFrame:
    """by_variant(variant, recall, mrr) with the differences to the base variant."""
    b = by_variant.where(F.col("variant") == base).select(F.col("recall").alias("r0"), F.col("mrr").alias("m0"), F.lit(1).alias("one"))
    out = by_variant.withColumn("one", F.lit(1)).join(b, "one", "left")
    return out.select("variant", "recall", "mrr", (F.col("recall") - F.col("r0")).alias("recall_delta"), (F.col("mrr") - F.col("m0")).alias("mrr_delta"))


def within_tolerance(a: DataFrame, b: DataFrame, absolute: dict[str, float], relative: dict[str, float]) -> DataFrame:
    """(metric, value) tables -> passed where either difference is within its tolerance."""
    both = a.select("metric", F.col("value").alias("x")).join(b.select("metric", F.col("value").alias("y")), "metric")
    gap = F.abs(F.col("x") - F.col("y"))
    table = lambda d: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in d.items() for v in kv]), F.col("metric")), F.lit(0.0)) if d else F.lit(0.0)
    rel = F.when(F.col("x") != 0, gap / F.abs(F.col("x"))).otherwise(F.when(gap == 0, 0.0).otherwise(F.lit(float("inf"))))
    return both.select("metric", "x", "y", gap.alias("abs_diff"), rel.alias("rel_diff"), ((gap <= table(absolute)) | (rel <= table(relative))).alias("passed"))


def merged_summary(summaries: DataFrame) -> DataFrame:
    """Of older per-repository summaries (repo, found, total, mrr): pooled recall, unweighted MRR, no latency."""
    return summaries.agg(F.sum("found").alias("found"), F.sum("total").alias("total"), (F.sum("found") / F.sum("total")).alias("recall"), F.avg("mrr").alias("macro_mrr"), F.lit(None).cast("double").alias("macro_latency"))


# Grids.


# The grids.
def grid(k1=(0.8, 1.0, 1.2, 1.5, 2.0), b=(0.3, 0.5, 0.75, 0.9, 1.0), min_match_ratio=(0.0, 0.25, 0.5, 0.75), max_terms=(2, 3, 4)) -> list[dict]:
    """300 configurations in a fixed order, which also breaks ties."""
    return [dict(zip(("cfg", "k1", "b", "min_match_ratio", "max_terms"), (i, *c), strict=True)) for i, c in enumerate(itertools.product(k1, b, min_match_ratio, max_terms))]


def search_grid() -> list[dict]:
    """27 configurations: the baseline, 16 of k1 and b, 4 ratios, 4 term counts, 2 combinations."""
    base = {"k1": 1.2, "b": 0.75, "min_match_ratio": 0.0, "max_terms": 5}
    out = [base, *[base | {"k1": k, "b": b} for k in (0.8, 1.2, 1.5, 2.0) for b in (0.3, 0.5, 0.75, 0.9)], *[base | {"min_match_ratio": r} for r in (0.25, 0.5, 0.75, 1.0)], *[base | {"max_terms": t} for t in (2, 3, 4, 6)], base | {"min_match_ratio": 0.5, "max_terms": 3}, base | {"b": 0.9, "min_match_ratio": 0.5}]
    return [{"cfg": i} | c for i, c in enumerate(out)]


def each_config(rows: DataFrame, configs: DataFrame) -> DataFrame:
    """A row for each of a few hundred configurations, made from a literal list in place of a join."""
    some = [F.struct(*[F.lit(r[c]).cast(t).alias(c) for c, t in configs.dtypes]) for r in configs.collect()]
    return rows.withColumn("__c", F.explode(F.array(*some))).select(*rows.columns, "__c.*")


def _by_document(features: DataFrame, last: int) -> DataFrame:
    """A row for each document of a task, the first terms as columns; there has a bit for each term present."""
    at = [F.col("term_no") == i for i in range(1, last + 1)]
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    there = F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("term_no") - 1).cast("int"))).alias("there")
    columns = [c for i, x in enumerate(at, 1) for c in (F.max(F.when(x, F.col("tf").cast("double"))).alias(f"tf_{i}"), F.max(F.when(x, idf.cast("double"))).alias(f"idf_{i}"))]
    alike = [F.max(F.col(c).cast(t)).alias(c) for c, t in (("doc_length", "double"), ("avg", "double"), ("n_terms", "int"))]
    out = features.where(F.col("term_no").between(1, last)).groupBy("task_id", "doc_id").agg(there, *columns, *alike)
    return out.where((F.col("there").bitwiseAND(1) == 1) | (F.col("n_terms") < 1))  # the first term is always required


def _kept_points(batch, configs: list[dict], last: int):
    """For each length and ratio of the configurations: their places in the list, the rows of the batch that they keep, and these rows' points under each.

    As in SQL a term without a number adds nothing, and a sum of none or of no number counts as 1000 points.
    """
    column = lambda k: batch.column(k).to_numpy(zero_copy_only=False)
    known = lambda k: batch.column(k).is_valid().to_numpy(zero_copy_only=False)
    models = list(dict.fromkeys((c["k1"], c["b"]) for c in configs))
    k1, b = (np.array(x)[None, :] for x in zip(*models, strict=True))
    there, n_terms = column("there").astype(np.int64), column("n_terms").astype(np.int64)
    with np.errstate(all="ignore"):
        norm = 1.0 - b + b * column("doc_length").astype(float)[:, None] / column("avg").astype(float)[:, None]
        parts, valid = [], []
        for i in range(1, last + 1):
            tf, idf = (column(f"{k}_{i}").astype(float)[:, None] for k in ("tf", "idf"))
            parts.append(idf * (tf * (k1 + 1.0) / (tf + k1 * norm)))
            valid.append(known(f"tf_{i}") & known(f"idf_{i}") & known("doc_length") & known("avg"))
        for max_terms, ratio in dict.fromkeys((c["max_terms"], c["min_match_ratio"]) for c in configs):
            places = [i for i, c in enumerate(configs) if (c["max_terms"], c["min_match_ratio"]) == (max_terms, ratio)]
            of = [models.index((configs[i]["k1"], configs[i]["b"])) for i in places]
            terms = np.minimum(n_terms, max_terms)
            head = np.where(terms < 2, terms, np.maximum(1, np.floor(terms * (1.0 - ratio)))).astype(np.int64)
            must, within = (1 << head) - 1, there & ((1 << max_terms) - 1)
            rows = np.flatnonzero((within != 0) & (within & must == must) & ((terms <= head) | (within & ~must != 0)))
            yield np.array(places), rows, lambda some, n=max_terms, head=head, of=of: _summed(some, parts[:n], valid, head, of)


def _summed(rows, parts, valid, head, of):
    total, any_valid = np.zeros((len(rows), len(of))), np.zeros(len(rows), bool)
    for t, part in enumerate(parts):  # in the query's order: the same sum in each run
        ok = valid[t][rows]
        total += np.where(ok[:, None], part[np.ix_(rows, of)] * np.where(t < head[rows], 1.0, 0.5)[:, None], 0.0)
        any_valid |= ok
    total[~any_valid] = np.nan
    return np.fmax(NOT_KEPT + 1, np.fmin(1000.0, np.floor(total * 100))).astype(np.int32)


# Fixed value: the points of a document that a configuration does not keep.
NOT_KEPT = -(2**31)


def grid_scores(features: DataFrame, tasks: DataFrame, configs: DataFrame, top: int = 10) -> DataFrame:
    """Ranks of the gold document of each task under each configuration, all at once.

    features(task_id, doc_id, term_no, tf, df, doc_length, n, avg, n_terms): the postings of the tasks' terms,
    so a row for each term of a task in a document; terms are numbered from 1. tasks(task_id, gold_doc).
    No row is made for a configuration: a document's terms become columns, and Arrow batches score it under
    all. The rank of the gold document is one more than the documents ahead of it: a count, not a sort. To the
    driver come the configurations and, for each task whose gold document is found, its points under each.
    """
    spark, kind = features.sparkSession, {f.name: f.dataType.simpleString() for f in features.schema}
    some = [r.asDict() for r in configs.collect()]
    last = max((c["max_terms"] for c in some), default=0)
    if last < 1:
        return spark.createDataFrame([], f"cfg {dict(configs.dtypes).get('cfg', 'int')}, task_id {kind['task_id']}, rank long")

    def gold_points(batches):
        for batch in batches:
            points = np.full((batch.num_rows, len(some)), NOT_KEPT, np.int32)
            for places, rows, of in _kept_points(batch, some, last):
                points[np.ix_(rows, places)] = of(rows)
            found = (points > NOT_KEPT).any(axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(some), pa.int32()), pa.array(points.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("task_id"), batch.column("doc_id"), lists], ["task_id", "gold_doc", "points"]).filter(pa.array(found))

    pairs = tasks.select("task_id", F.col("gold_doc").alias("doc_id"))
    gold = _by_document(features.join(F.broadcast(pairs), ["task_id", "doc_id"], "left_semi"), last)
    gold = gold.mapInArrow(gold_points, f"task_id {kind['task_id']}, gold_doc {kind['doc_id']}, points array<int>").collect()
    goals = np.array([r["points"] for r in gold], np.int32).reshape(len(gold), len(some))
    known = spark.createDataFrame([(r["task_id"], r["gold_doc"], i) for i, r in enumerate(gold)], f"task_id {kind['task_id']}, gold_doc {kind['doc_id']}, at int")

    def count_ahead(batches):
        ahead, met = np.zeros(goals.shape, np.int64), np.zeros(len(goals), bool)
        for batch in batches:
            batch = batch.take(pa.array(np.argsort(batch.column("at").to_numpy(), kind="stable")))
            at, before = batch.column("at").to_numpy(), batch.column("before").to_numpy(zero_copy_only=False)
            met[at] = True
            for places, rows, of in _kept_points(batch, some, last):
                rows = rows[goals[at[rows], places[0]] > NOT_KEPT]  # which documents are kept hangs on the length and the ratio only
                if not len(rows):
                    continue
                points, goal = of(rows), goals[np.ix_(at[rows], places)]
                first = np.flatnonzero(np.diff(at[rows], prepend=-1))
                ahead[np.ix_(at[rows][first], places)] += np.add.reduceat((points > goal) | ((points == goal) & before[rows][:, None]), first, axis=0, dtype=np.int64)
        task, cfg = np.nonzero(met[:, None] & (goals > NOT_KEPT))
        yield pa.RecordBatch.from_arrays([pa.array(task.astype(np.int32)), pa.array(cfg.astype(np.int32)), pa.array(ahead[task, cfg])], ["at", "place", "ahead"])

    docs = _by_document(features.join(F.broadcast(known.select("task_id")), "task_id", "left_semi"), last).join(F.broadcast(known), "task_id")
    docs = docs.withColumn("before", F.coalesce(F.col("doc_id") < F.col("gold_doc"), F.lit(False))).drop("task_id", "doc_id", "gold_doc")
    ranks = docs.mapInArrow(count_ahead, "at int, place int, ahead long").groupBy("at", "place").agg((F.sum("ahead") + 1).alias("rank")).where(F.col("rank") <= top)
    names = spark.createDataFrame([(i, c["cfg"]) for i, c in enumerate(some)], f"place int, cfg {dict(configs.dtypes)['cfg']}")
    return ranks.join(F.broadcast(names), "place").join(F.broadcast(known), "at").select("cfg", "task_id", "rank")


def best_config(ranks: DataFrame, tasks: DataFrame, configs: DataFrame) -> DataFrame:
    """Per configuration the weighted sum of the difficulties' MRR; the first best comes first."""
    every = each_config(tasks.select("task_id", "difficulty"), configs.select("cfg"))
    rr = every.join(ranks, ["cfg", "task_id"], "left").groupBy("cfg", "difficulty").agg(F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))).alias("mrr"))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in DIFFICULTY_WEIGHT.items() for x in kv]), F.col("difficulty"))
    return rr.groupBy("cfg").agg(F.sum(F.col("mrr") * weight).alias("score")).orderBy(F.desc("score"), "cfg")


def best_by_difficulty(ranks: DataFrame, tasks: DataFrame, configs: DataFrame) -> DataFrame:
    """(difficulty, cfg, mrr): the first best configuration of each difficulty."""
    every = each_config(tasks.select("task_id", "difficulty"), configs.select("cfg"))
    rr = every.join(ranks, ["cfg", "task_id"], "left").groupBy("difficulty", "cfg").agg(F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))).alias("mrr"))
    return rr.groupBy("difficulty").agg(F.max_by(F.struct("cfg", "mrr"), F.struct("mrr", -F.col("cfg"))).alias("x")).select("difficulty", "x.cfg", "x.mrr")


def end_to_end(runs: DataFrame) -> DataFrame:
    """runs(stdout_bytes, first_ms) -> mean and total output, quantiles of the time to the first candidate."""
    p = F.percentile(F.col("first_ms").cast("double"), F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = runs.agg(F.count("*").alias("n"), F.avg("stdout_bytes").alias("mean_bytes"), F.sum("stdout_bytes").alias("total_bytes"), p.alias("p"))
    return out.select("n", "mean_bytes", "total_bytes", *[F.get("p", F.lit(i)).alias(f"first_p{k}") for i, k in enumerate((50, 95, 99))])


def timed(actions: dict, repeats: int = 3) -> list[dict]:
    """name -> a function that runs an action; a row for each run, for quantiles() and confidence()."""
    import time

    out = []
    for name, action in actions.items():
        for k in range(repeats):
            began = time.perf_counter()
            action()
            out.append({"metric": name, "repeat": k, "value": (time.perf_counter() - began) * 1000})
    return out


# Plain scans and checks of data sets.


def grep(docs: DataFrame, patterns: list[str], fixed: bool = False, path_filter: str | None = None, max_count: int | None = None) -> DataFrame:
    """Lines of docs(path, text) that match any pattern, without regard to case: (path, line, text)."""
    rows = docs if path_filter is None else docs.where(F.col("path").rlike(path_filter))
    rows = rows.select("path", F.posexplode(T.lines(F.col("text"))).alias("line", "text")).withColumn("line", F.col("line") + 1)
    if fixed:
        test = F.lit(False)
        for p in patterns:
            test = test | F.contains(F.lower("text"), F.lit(p.lower()))
    else:
        test = F.col("text").rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))
    found = rows.where(test)
    if max_count is not None:
        found = found.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("line"))).where(F.col("k") <= max_count).drop("k")
    return found


def gold_coverage(tasks: DataFrame, documents: DataFrame) -> DataFrame:
    """tasks(repo, gold_file), documents(repo, path) -> per repository: tasks, gold files that no document has exactly."""
    have = documents.select("repo", F.col("path").alias("gold_file")).distinct().withColumn("there", F.lit(True))
    repos = documents.select("repo").distinct().withColumn("indexed", F.lit(True))
    out = tasks.join(have, ["repo", "gold_file"], "left").join(repos, "repo", "left")
    return out.groupBy("repo").agg(F.count("*").alias("tasks"), F.sum(F.when(F.col("there").isNull(), 1).otherwise(0)).alias("missing"), F.coalesce(F.first("indexed"), F.lit(False)).alias("indexed"))


def anchor_check(tasks: DataFrame, documents: DataFrame) -> DataFrame:
    """tasks(task_id, gold_file, anchor), documents(path, text) -> task_id, file_found, anchor_found, partial.

    The file by its name in any case; partial: the anchor's first five words are there.
    """
    docs = documents.select(F.lower("path").alias("key"), "text")
    joined = tasks.withColumn("key", F.lower("gold_file")).join(docs, "key", "left")
    start = F.array_join(F.slice(F.split(F.trim("anchor"), r"\s+"), 1, 5), " ")
    has = lambda x: F.coalesce(F.contains("text", x), F.lit(False))
    return joined.groupBy("task_id").agg(F.max(F.col("text").isNotNull()).alias("file_found"), F.max(has(F.col("anchor"))).alias("anchor_found"), F.max(has(start)).alias("partial"))
