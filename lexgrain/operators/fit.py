"""Fitting symbol weights: logistic regression with language interactions, held-out folds, shrinkage."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrain.operators.evaluate import harness_terms
from lexgrain.operators.index import Index
from lexgrain.operators.search import Query, Search, SymbolWeights

# The regularisations tried, and the descent's steps.
L2_CHOICES = (0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0)
STEPS, RATE, DECAY, LEAST_UPDATE = 2000, 0.4, 0.01, 1e-7
#: Distinct samples that the driver's descent takes at most; fit_optimum runs on the executors and has no such limit.
MOST_SAMPLES = 1_000_000


def collect_samples(index: Index, tasks: list[dict], top: int = 50) -> DataFrame:
    """Samples from tasks(id, repo, must, symbol, gold_file) of an index: the top results without the symbol, its evidence in each.

    One plan for each task, joined to one: task sets are a few dozen.
    """
    out = None
    for t in tasks:
        terms = harness_terms(t["must"])
        plain, whole = Query.of(must=terms), Query.of(must=terms, symbol=t["symbol"])
        if not whole.symbol:
            continue
        found = Search.indexed(index, whole)
        found.query = plain
        best = F.greatest(F.lit(0.0), *[found.evidence(s) for s in whole.symbol])
        rows = found.ranked(top, evidence=best).select(F.lit(t["id"]).alias("task_id"), F.lit(t["repo"]).alias("repo"), "lang", "path", "score", "evidence", F.lit(t["gold_file"]).alias("gold_file"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no task has a symbol")
    return samples(out)


def samples(ranked: DataFrame, gold: str = "gold_file") -> DataFrame:
    """ranked(task_id, repo, lang, path, score, evidence, gold_file) -> samples of the tasks that found their gold file."""
    hit = F.col("path").contains(F.col(gold)) & (F.col(gold) != "")
    marked = ranked.withColumn("label", hit.cast("int"))
    found = marked.where("label = 1").select("task_id").distinct()
    return marked.join(found, "task_id", "left_semi").select("repo", "lang", (F.col("score") / F.lit(1000.0)).alias("base"), "evidence", "label")


def feature_rows(rows: DataFrame, langs: list[str]) -> DataFrame:
    """features: 1, base, evidence, evidence in each language."""
    columns = [F.lit(1.0), F.col("base").cast("double"), F.col("evidence").cast("double"), *[F.when(F.col("lang") == x, F.col("evidence").cast("double")).otherwise(F.lit(0.0)) for x in langs]]
    return rows.withColumn("features", F.array(*columns))


def fit_gradient(rows: DataFrame, width: int, l2: float, steps: int = STEPS, label: str = "label") -> list[float]:
    """Full-batch descent with the reference's step sizes, which end before it has converged.

    Equal rows count once with their number; a step is one aggregation over them: width sums.
    """
    few = rows.groupBy("features", label).agg(F.count("*").cast("double").alias("n")).persist()
    total = few.agg(F.sum("n")).first()[0] or 1.0
    # The distinct rows of tasks' top results are a few thousand, a count that grows with tasks, not with documents.
    data = [(r["features"], r[label], r["n"]) for r in few.orderBy("features", label).limit(MOST_SAMPLES + 1).toLocalIterator()]
    few.unpersist()
    if len(data) > MOST_SAMPLES:
        raise ValueError("too many distinct samples for the driver: use fit_optimum")
    import numpy as np

    x, y, n = (np.array([d[k] for d in data], float) for k in range(3))
    w = np.zeros(width)
    for step in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        g = x.T @ ((p - y) * n) / total
        g[1:] += l2 * w[1:] / total
        update = RATE / (1 + DECAY * step) * g
        w -= update
        if np.abs(update).max() < LEAST_UPDATE:
            break
    return w.tolist()


def fit_optimum(rows: DataFrame, width: int, l2: float, label: str = "label") -> list[float]:
    """The same loss at its minimum, by Spark's solver on all executors."""
    n = max(rows.count(), 1)
    vectors = rows.select(F.col(label).cast("double").alias("label"), array_to_vector(F.slice("features", 2, width - 1)).alias("features"))
    model = LogisticRegression(regParam=l2 / n, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-10).fit(vectors)
    return [model.intercept, *model.coefficients.toArray().tolist()]


def probability(weights: list[float]):
    z = F.lit(0.0)
    for i, w in enumerate(weights):
        z = z + F.get("features", F.lit(i)) * F.lit(w)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def log_loss(p, label: str = "label"):
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))
    y = F.col(label).cast("double")
    return -F.avg(y * F.log(p) + (1 - y) * F.log(1 - p))


def choose_l2(rows: DataFrame, width: int, choices: tuple[float, ...] = L2_CHOICES, fit=fit_gradient) -> tuple[float, dict[float, float]]:
    """Leave one repository out; a fold whose training or held rows have no positive is left out. The first least loss wins."""
    repos = [r["repo"] for r in rows.groupBy("repo").agg(F.sum("label").alias("n")).where("n > 0").orderBy("repo").collect()]
    out: dict[float, float] = {}
    for l2 in choices:
        losses = []
        for repo in repos:
            learn = rows.where(F.col("repo") != repo)
            if learn.where("label = 1").limit(1).count():
                losses.append(rows.where(F.col("repo") == repo).agg(log_loss(probability(fit(learn, width, l2)))).first()[0])
        if losses:
            out[l2] = sum(losses) / len(losses)
    best = min(out, key=lambda k: (out[k], choices.index(k))) if out else choices[-1]
    return best, out


def shrunk(per_lang: DataFrame) -> DataFrame:
    """per_lang(lang, n_positive, raw, global_weight) -> weight: raw toward global by n / (n + median n)."""
    kappa = per_lang.agg(F.percentile(F.col("n_positive").cast("double"), F.lit(0.5)).alias("kappa")).withColumn("one", F.lit(1))
    alpha = F.when(F.col("n_positive") + F.col("kappa") > 0, F.col("n_positive") / (F.col("n_positive") + F.col("kappa"))).otherwise(F.lit(0.0))
    out = per_lang.withColumn("one", F.lit(1)).join(kappa, "one").withColumn("alpha", alpha)
    return out.select("lang", "n_positive", "alpha", (F.col("alpha") * F.col("raw") + (1 - F.col("alpha")) * F.col("global_weight")).alias("weight"))


def fit_weights(rows: DataFrame, l2: float | None = None) -> SymbolWeights:
    """From samples to symbol weights by language."""
    langs = [r["lang"] for r in rows.select("lang").distinct().orderBy("lang").collect()]
    table = feature_rows(rows, langs).persist()
    width = 3 + len(langs)
    l2 = choose_l2(table, width)[0] if l2 is None else l2
    w = fit_gradient(table, width, l2)
    spark = rows.sparkSession
    raw = spark.createDataFrame([(x, w[2] + w[3 + i], w[2]) for i, x in enumerate(langs)], "lang string, raw double, global_weight double")
    counts = rows.groupBy("lang").agg(F.sum("label").alias("n_positive"))
    out = {r["lang"]: r["weight"] for r in shrunk(raw.join(counts, "lang")).collect()}
    table.unpersist()
    return SymbolWeights(out, w[2])
