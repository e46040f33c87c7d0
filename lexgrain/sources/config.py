"""Experiment configurations: repositories, grids, weights."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from lexgrain.sources import shared

# The defaults.
DEFAULT = {"version": "1.0", "repositories": [], "grid": {"k1": [0.8, 1.0, 1.2, 1.5, 2.0], "b": [0.3, 0.5, 0.75, 0.9, 1.0], "min_match_ratio": [0.0, 0.25, 0.5, 0.75], "max_terms": [2, 3, 4]}, "difficulty_weights": {"easy": 1.0, "medium": 1.5, "hard": 2.0}}


def read_config(spark: SparkSession, path: str) -> dict:
    """A configuration over the defaults: JSON, or YAML where a YAML reader is installed."""
    text = shared.get(spark, path).decode()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("no YAML reader is installed; give the configuration as JSON") from e
        data = yaml.safe_load(text)
    else:
        data = json.loads(text)
    return DEFAULT | (data or {})


def repositories(spark: SparkSession, config: dict) -> DataFrame:
    rows = [(r["id"], r.get("language"), r.get("index"), r.get("source")) for r in config["repositories"]]
    return spark.createDataFrame(rows, "id string, language string, index string, source string")


def derived(config: dict, root: str, balanced: bool) -> dict:
    """The configuration with each repository's source under the balanced or the raw tree."""
    kind = "balanced" if balanced else "raw"
    return config | {"repositories": [r | {"source": f"{root.rstrip('/')}/{kind}/{r['id']}"} for r in config["repositories"]]}
