import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def table(spark):
    """table(rows): documents from (doc_id, text[, lang[, source]])."""

    def make(rows, extra=()):
        full = [(i, t, *(rest + ["en", "s"][len(rest) :]), len(t or "")) for i, t, *rest in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for name in extra:  # columns with names that an operator might use itself
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("clash"))
        return df

    return make


def words(seed, n, vocabulary=50):
    rng = random.Random(seed)
    return [f"w{rng.randint(0, vocabulary)}" for _ in range(n)]


HARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id at all"), (5, "x " * 30_000), (6, "Ünï çödé ▁ \x00   end"), (7, "a b c"), (7, "other text, same id"), (2**60, "far")]
CLASH = ("digest", "mark", "fp", "key", "row", "component_id", "words", "lines", "score", "starts", "blob", "batch", "kept", "weight", "topic", "held")
