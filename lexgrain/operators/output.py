"""Result pages as compact JSON within a byte budget; on the driver, for the rows of one page."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexgrain.operators.index import Index
from lexgrain.operators.search import Query, SymbolWeights, search_page

# The contract's version, keys and limits.
VERSION = "result.v1"
BUDGET = {"max_bytes": 8192, "max_results": 20, "max_hits": 10, "max_excerpt": 256}


def to_dict(rows: list, truncated: bool, cursor: str | None, budget: dict) -> dict:
    """The contract's object. emitted_bytes is measured with a zero in its own place."""
    paths = list(dict.fromkeys(r["path"] for r in rows))
    at = {p: i for i, p in enumerate(paths)}
    out = {
        "v": VERSION,
        "ok": True,
        "p": paths,
        "r": [
            {
                "pi": at[r["path"]],
                "s": r["score"],
                "h": [{"ln": h["line"], "txt": h["text"][: budget["max_excerpt"]], "sc": h["score"]} for h in r["hits"][: budget["max_hits"]]],
                "rng": {"from": r["from_line"], "to": r["to_line"]},
                "next": list(r["next_spans"]),
                "doc_id": r["doc_handle"],
                "span_id": r["span_handle"],
                "digest": r["digest"],
                "bounds": {"start": r["bound_start"], "end": r["bound_end"]},
            }
            for r in rows
        ],
        "t": truncated,
        "cur": cursor,
        "lim": {**{k: budget[k] for k in BUDGET}, "emitted_bytes": 0},
    }
    out["lim"]["emitted_bytes"] = len(json.dumps(out, ensure_ascii=False).encode())
    return out


def format_results(rows: list, budget: dict | None = None, cursor: str | None = None, more: bool = False) -> tuple[dict, int]:
    """(object, rows in it): rows while the object, probed without cursor, keeps within max_bytes."""
    budget = BUDGET | (budget or {})
    most = rows[: budget["max_results"]]
    fit = 0
    while fit < len(most) and to_dict(most[: fit + 1], False, None, budget)["lim"]["emitted_bytes"] <= budget["max_bytes"]:
        fit += 1
    cut = more or len(rows) > budget["max_results"] or fit < len(most) or any(len(r["hits"]) > budget["max_hits"] for r in most[: fit + 1])
    return to_dict(most[:fit], cut, cursor, budget), fit


def run_query(index: Index, data: dict, weights: SymbolWeights | None = None, strict: bool = False) -> dict:
    """A query of the contract, with its budget and cursor, to a result of the contract."""
    budget = BUDGET | data.get("budget", {})
    page = search_page(index, Query.from_dsl(data, strict), budget["max_results"], budget["max_hits"], data.get("options", {}).get("cursor"), weights)
    _, fit = format_results(page.results, budget)
    if not fit and page.total > page.start:
        raise ValueError("the budget is too small for any result")
    cursor = page.cursor_after(fit)
    return format_results(page.results, budget, cursor, cursor is not None)[0]


def path_numbers(rows: DataFrame, path: str = "path", place: str = "rank") -> DataFrame:
    """(path, pi): the path dictionary, numbered by each path's first place. One row for each path is ranked, those of a result."""
    first = rows.groupBy(path).agg(F.min(place).alias("__first"))
    return first.select(path, (F.row_number().over(Window.orderBy("__first")) - 1).cast("long").alias("pi"))


def entry_bytes(rows: DataFrame, max_excerpt: int = 256) -> DataFrame:
    """rows(rank, doc_id, path, score, line_count, content_hash) -> adds n_bytes, what a result adds to the object.

    JSON lengths add up: the entry, two for its comma and space, and its path where that comes first.
    """
    q = lambda c: F.octet_length(c) + 2  # noqa: E731  with its quotes
    number = lambda c: F.length(F.col(c).cast("string"))
    first = F.row_number().over(Window.partitionBy("path").orderBy("rank")) == 1
    index = F.dense_rank().over(Window.orderBy("first_rank")) - 1
    fixed = len('{"pi": , "s": , "h": [{"ln": 1, "txt": , "sc": }], "rng": {"from": 1, "to": }, "next": [], "doc_id": "doc_00000000", "span_id": "span_00000000_001", "digest": "0123456789abcdef", "bounds": {"start": 1, "end": }}')
    out = rows.withColumn("is_first", first).withColumn("first_rank", F.min("rank").over(Window.partitionBy("path"))).withColumn("pi", index)
    size = F.lit(fixed) + number("pi") + 2 * number("score") + q(F.substring("path", 1, max_excerpt)) + F.length(F.least(F.lit(50), "line_count").cast("string")) + number("line_count")
    path = F.when(F.col("is_first"), q(F.col("path")) + F.when(F.col("rank") > 1, 2).otherwise(0)).otherwise(0)
    return out.withColumn("n_bytes", size + path + F.when(F.col("rank") > 1, 2).otherwise(0)).drop("first_rank")


def within_budget(rows: DataFrame, max_bytes: int, budget: dict | None = None) -> DataFrame:
    """The rows of a page that the byte budget admits, and the bytes up to each: a running sum, as the sizes never fall.

    For the rows of one page, max_results of them. Paths without characters that JSON escapes.
    """
    budget = BUDGET | (budget or {}) | {"max_bytes": max_bytes}
    base = to_dict([], False, None, budget)["lim"]["emitted_bytes"]
    sized = entry_bytes(rows, budget["max_excerpt"]).withColumn("emitted", F.lit(base) + F.sum("n_bytes").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    return sized.where(F.col("emitted") <= max_bytes)
