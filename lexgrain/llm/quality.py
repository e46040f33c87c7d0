"""Quality by weak supervision, in DataFrame functions only: rules vote or abstain, EM weighs them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrain.llm.scratch import Scratch

WHITE = r"[\x20\x09-\x0D]+"
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Frequent function words of the languages at hand.
FUNCTION_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au avec ce dans de des du elle en est et il la le les ne par pas pour qui que sur un une "
    "am auf aus bei das dem den der die ein eine er es für im ist mit nicht sich sie und von zu "
    "al como con del el ella las lo los más no para por se su una y"
).split()


def words_column(text: Column) -> Column:
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def _without(text: Column, strings) -> Column:
    for s in strings:
        text = F.replace(text, F.lit(s), F.lit(""))
    return text


def measures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the rules need besides."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), words_column(body).alias("words"))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.length(_without(x, SPACES)) > 0))
    many = F.size("words") >= WINDOW
    rows = rows.withColumn("hashes", F.when(many, F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))))
    again = F.size(F.array_distinct("hashes")) < F.size("hashes")
    rows = rows.withColumn("sorted", F.when(again, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("sorted")
    twice = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
    rows = rows.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["i"])))
    new = F.zip_with("starts", F.slice("starts", 2, F.greatest(F.size("starts"), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    symbols = F.length("text") - F.length(_without(F.col("text"), SYMBOLS))
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(_without(F.col("text"), SPACES)).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(new, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(FUNCTION_WORDS))).cast("long").alias("n_function"),
        F.regexp_count(F.col("text"), F.lit(r"[.!?](?=[\x20\x09-\x0D]|$)")).cast("long").alias("n_stops"),
        F.regexp_count(F.col("text"), F.lit("[A-Z]")).cast("long").alias("n_capitals"),
    )


def rules() -> dict[str, tuple[Column, Column]]:
    """Each rule's (votes for good, votes for bad) over the measures; neither: it abstains."""
    n, c = F.col("n_words"), F.col
    mean = F.when(n > 0, c("word_chars") / n)
    return {
        "length": (n >= 50, n < 20),
        "word_length": (mean.between(3.0, 9.0), (mean < 2.0) | (mean > 14.0)),
        "symbols": (c("n_symbols") <= 0.01 * n, c("n_symbols") > 0.1 * n),
        "lines": ((c("n_dup_lines") == 0) & (c("n_lines") >= 3), c("n_dup_lines") > 0.3 * c("n_lines")),
        "repeats": ((c("n_repeat_words") <= 0.02 * n) & (n >= 50), c("n_repeat_words") > 0.15 * n),
        # Without any of them a text may be in a language that the list does not have: no vote.
        "function_words": (c("n_function") >= 0.1 * n, (c("n_function") > 0) & (c("n_function") < 0.02 * n) & (n >= 20)),
        "sentences": ((c("n_stops") >= 0.01 * n) & (c("n_stops") <= 0.34 * n), ((c("n_stops") == 0) & (n >= 30)) | (c("n_stops") > 0.5 * n)),
        "capitals": (c("n_capitals") <= 0.15 * c("word_chars"), c("n_capitals") > 0.4 * c("word_chars")),
    }


def posterior(names: list[str], prior: float, good: dict[str, float], bad: dict[str, float]) -> Column:
    """Probability of good. good and bad: how often a rule that does not abstain is right about good and about bad rows."""
    from math import log

    odds = F.lit(log(prior / (1 - prior)))
    for r in names:
        vote = F.col(f"v_{r}")
        odds = odds + F.when(vote == 1, F.lit(log(good[r] / (1 - bad[r])))).when(vote == 0, F.lit(log((1 - good[r]) / bad[r]))).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def fit(patterns: DataFrame, names: list[str], rounds: int = 100, tolerance: float = 1e-4):
    """EM over patterns(v_*, n), of which there are 3 to the power of the rules at most, until neither the
    prior nor any accuracy moves. A rule may turn out blind to bad rows, but never worse than chance about good ones."""
    prior, good, bad = 0.8, dict.fromkeys(names, 0.8), dict.fromkeys(names, 0.8)
    for _ in range(rounds):
        q = posterior(names, prior, good, bad)
        n = F.col("n").cast("double")
        sums = [F.sum(n).alias("n"), F.sum(n * q).alias("q")]
        for r in names:
            vote = F.col(f"v_{r}")
            sums += [F.sum(F.when(vote.isNotNull(), n * q)).alias(f"g_{r}"), F.sum(F.when(vote == 1, n * q)).alias(f"gr_{r}"), F.sum(F.when(vote.isNotNull(), n * (1 - q))).alias(f"b_{r}"), F.sum(F.when(vote == 0, n * (1 - q))).alias(f"br_{r}")]
        row = patterns.agg(*sums).first()
        if not row["n"]:
            break
        share = lambda a, b, least: min(max(((row[a] or 0.0) + 8.0) / ((row[b] or 0.0) + 10.0), least), 0.99)
        old = [prior, *good.values(), *bad.values()]
        prior = min(max(row["q"] / row["n"], 0.05), 0.95)
        good, bad = {r: share(f"gr_{r}", f"g_{r}", 0.5) for r in names}, {r: share(f"br_{r}", f"b_{r}", 0.02) for r in names}
        if max(abs(a - b) for a, b in zip(old, [prior, *good.values(), *bad.values()], strict=True)) < tolerance:
            break
    return prior, good, bad


def judge(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality.

    A null or blank text has zeros, fails the base and is not kept. Repeated rows and null ids are rows
    like any other; an empty table gives none. Other columns of docs are not read.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    names = list(rules())
    votes = [F.when(F.coalesce(bad, F.lit(False)), 0).when(F.coalesce(good, F.lit(False)), 1).cast("int").alias(f"v_{r}") for r, (good, bad) in rules().items()]
    rows = scratch.save(measures(docs, text, doc_id).select("*", *votes), "measures")
    patterns = scratch.save(rows.where("n_words > 0").groupBy(*[f"v_{r}" for r in names]).agg(F.count("*").alias("n")), "patterns")
    quality = posterior(names, *fit(patterns, names))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (quality >= threshold)).alias("kept"), F.when(F.col("n_words") > 0, quality).otherwise(0.0).alias("quality"))
