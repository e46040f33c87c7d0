"""Line regions of documents: blocks and symbols.

Blank-line blocks and declarations stay in the JVM, as array functions of the row itself, so that they
need no exchange. Braces and Python syntax trees need a stack or a parser: one Arrow-batched function.
"""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexgrain.functions import text as T

BRACED = ("c", "cpp", "cxx", "cc", "rust", "go", "java", "javascript", "typescript")
BRACES = re.compile("[{}]|\n+")
REGIONS = "array<struct<start:int,end:int>>"


def whole(line_count: Column) -> Column:
    return F.array(F.struct(F.lit(1).alias("start"), line_count.cast("int").alias("end")))


def pair(starts: Column, ends: Column) -> Column:
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end")))


def _places(flags: Column, test=lambda x, i: x) -> Column:
    """1-based places of the elements that pass test(element, index)."""
    marked = F.transform(flags, lambda x, i: F.when(test(x, i), i + 1))
    return F.filter(marked, lambda i: i.isNotNull())


def full_lines(lines: Column) -> Column:
    """Which lines are not blank."""
    return F.transform(lines, lambda x: ~T.is_blank(x))


def blank_line_blocks(full: Column) -> Column:
    """Maximal runs of full lines; the whole file where there is none. full: full_lines() as a column by name."""
    near = lambda i: F.coalesce(F.get(full, i), F.lit(False))
    starts = _places(full, lambda x, i: x & ~near(i - 1))
    ends = _places(full, lambda x, i: x & ~near(i + 1))
    return F.when(F.size(starts) > 0, pair(starts, ends)).otherwise(whole(F.size(full)))


def declared_symbols(lines: Column) -> Column:
    """From each declaration to the line before the next, the last to the end; empty where there is none."""
    starts = _places(F.transform(lines, lambda x: T.is_declaration(x)))
    ends = F.concat(F.transform(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), lambda s: s - 1), F.array(F.size(lines)))
    return F.when(F.size(starts) > 0, pair(starts, ends)).otherwise(F.array().cast(REGIONS))


def brace_regions(source: str) -> list[dict]:
    """Lines of matched braces, nested ones too; an unmatched closing brace counts for nothing."""
    out, stack, line = [], [], 1
    for mark in BRACES.findall(source):  # the braces and the newlines between them, nothing else
        if mark == "{":
            stack.append(line)
        elif mark != "}":
            line += len(mark)
        elif stack:
            out.append((stack.pop(), line))
    return [{"start": a, "end": b} for a, b in sorted(out)]


def python_regions(source: str) -> tuple[list[dict], list[dict]] | None:
    """(statements with a body, functions and classes); None for a syntax error."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    blocks, names = set(), set()
    for node in ast.walk(tree):
        span = getattr(node, "lineno", None), getattr(node, "end_lineno", None)
        if None not in span:
            if isinstance(getattr(node, "body", None), list):
                blocks.add(span)
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                names.add(span)
    as_rows = lambda spans: [{"start": a, "end": b} for a, b in sorted(spans)]
    return as_rows(blocks), as_rows(names)


def _parse_batch(source: pd.Series, lang: pd.Series) -> pd.DataFrame:
    rows = []
    for text, name in zip(source, lang, strict=True):
        if name == "python" and (found := python_regions(text or "")) is not None:
            rows.append((*found, True))
        elif name in BRACED:
            rows.append((brace_regions(text or ""), [], True))
        else:
            rows.append(([], [], False))
    return pd.DataFrame(rows, columns=["block", "symbol", "parsed"])


def parsed_regions(source: Column, lang: Column) -> Column:
    """Struct of block, symbol and parsed, for Python and braced languages."""
    return F.pandas_udf(_parse_batch, f"struct<block:{REGIONS},symbol:{REGIONS},parsed:boolean>")(source, lang)


def normalized(regions: Column, line_count: Column) -> Column:
    """Clamped to the file; reversed ones dropped."""
    n = line_count.cast("int")
    clamp = lambda x: F.greatest(F.lit(1), F.least(x.cast("int"), n))
    return F.filter(F.transform(regions, lambda r: F.struct(clamp(r["start"]).alias("start"), clamp(r["end"]).alias("end"))), lambda r: r["end"] >= r["start"])


def first_of(*choices: Column) -> Column:
    """The first array that is not empty."""
    return F.coalesce(*[F.when(F.size(c) > 0, c) for c in choices])


def with_regions(docs, parse: bool = True):
    """Adds block_regions and symbol_regions to rows with text, lines, lang and line_count.

    By language: Python by its syntax tree, else (also after a syntax error) blank-line blocks; braced
    languages by braces, else blank-line blocks; others blank-line blocks. Symbols: Python's functions and
    classes, or its blocks; others by declaration, or their blocks. parse=False leaves Python out.
    """
    out = docs.withColumn("__full", full_lines(F.col("lines"))).withColumn("__blank", blank_line_blocks(F.col("__full"))).withColumn("__named", declared_symbols(F.col("lines")))
    n = F.col("line_count")
    if not parse:
        return out.withColumn("block_regions", F.col("__blank")).withColumn("symbol_regions", first_of(F.col("__named"), F.col("__blank"))).drop("__full", "__blank", "__named")
    lang = F.coalesce("lang", F.lit(""))
    code = lang.isin("python", *BRACED)
    out = out.withColumn("__parsed", F.when(code, parsed_regions(F.when(code, F.col("text")), F.when(code, lang))))
    block = first_of(normalized(F.col("__parsed.block"), n), F.col("__blank"))
    named = F.when(lang == "python", normalized(F.col("__parsed.symbol"), n)).otherwise(F.col("__named"))
    out = out.withColumn("block_regions", block).withColumn("symbol_regions", first_of(named, F.col("block_regions")))
    return out.drop("__full", "__blank", "__named", "__parsed")


def scope_regions(scope: str, block: Column, symbol: Column, line_count: Column) -> Column:
    if scope == "block":
        return first_of(block, whole(line_count))
    if scope == "symbol":
        return first_of(symbol, block, whole(line_count))
    return whole(line_count)
