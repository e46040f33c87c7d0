"""Queries: normalisation, candidates by boolean algebra, BM25 scores, symbols, proximity, pages."""

from __future__ import annotations

import contextlib
import hashlib
import json
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrain.functions import text as T
from lexgrain.operators import index as I
from lexgrain.operators import regions as R
from lexgrain.sources import shared

SHOULD_BOOST = 0.5
CURSOR = re.compile(r"cur_(\d+)_([a-f0-9]+)\Z")

# The shipped symbol weights. They are negative: a symbol match lowers a score.
SHIPPED_WEIGHTS = {"c": -0.8376665114080666, "cpp": -0.7123949932005774, "go": -0.7644066126824933, "python": -0.7594797780134085, "ruby": -0.7123949932005774, "rust": -0.6576655446911599}
SHIPPED_GLOBAL_WEIGHT = -0.7123949932005774


@dataclass(frozen=True)
class SymbolWeights:
    """Weight of symbol evidence by language."""

    by_lang: dict[str, float] = field(default_factory=dict)
    default: float = 0.0

    @classmethod
    def shipped(cls) -> SymbolWeights:
        return cls(SHIPPED_WEIGHTS, SHIPPED_GLOBAL_WEIGHT)

    @classmethod
    def disabled(cls) -> SymbolWeights:
        return cls()

    @classmethod
    def from_dict(cls, data: dict) -> SymbolWeights:
        """Of a weights file; languages whose weight is no number are left out."""
        given = data.get("by_lang")
        weights = {}
        for lang, value in given.items() if isinstance(given, dict) else ():
            with contextlib.suppress(TypeError, ValueError):
                weights[str(lang).lower()] = float(value)
        return cls(weights, float(data.get("global_weight", 0.0)))

    def to_dict(self) -> dict:
        return {"version": "symbol_language_weights.v1", "global_weight": self.default, "by_lang": dict(sorted(self.by_lang.items())), "metadata": {}}

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SymbolWeights:
        data = json.loads(shared.get(spark, path))
        if not isinstance(data, dict):
            raise ValueError("a weights file holds an object")
        return cls.from_dict(data)

    def save(self, spark: SparkSession, path: str) -> None:
        shared.put(spark, path, json.dumps(self.to_dict(), ensure_ascii=False, indent=2).encode())

    def column(self, lang: Column) -> Column:
        if not self.by_lang:
            return F.lit(self.default)
        table = F.create_map(*[F.lit(x) for kv in self.by_lang.items() for x in kv])
        return F.coalesce(F.element_at(table, F.lower(F.trim(lang))), F.lit(self.default))

    def signature(self) -> str:
        raw = json.dumps({"global": self.default, "by_lang": self.by_lang}, sort_keys=True)
        return hashlib.sha1(raw.encode()).hexdigest()[:12]


@dataclass(frozen=True)
class Near:
    terms: tuple[str, ...]
    scope: str = "line_window"
    window: int = 0


@dataclass(frozen=True)
class Query:
    """A normalised query. Terms are lower-cased, never split: an index of identifiers holds their parts."""

    must: tuple[str, ...] = ()
    should: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    near: tuple[Near, ...] = ()
    lang: frozenset[str] = frozenset()
    ext: frozenset[str] = frozenset()
    path_prefix: tuple[str, ...] = ()
    symbol: tuple[tuple[str, ...], ...] = ()
    min_match: int = 0

    @classmethod
    def of(cls, must=(), should=(), exclude=(), near=(), lang=(), ext=(), path_prefix=(), symbol=(), min_match=0) -> Query:
        words = lambda xs: tuple(T.normalize_term(x) for x in xs or ())
        clean = lambda xs, f: [y for x in xs or () if (y := f(x))]
        sets = [tuple(t) for s in symbol or () if (t := T.identifier_terms(s))]
        return cls(
            words(must), words(should), words(exclude), tuple(filter(None, map(_near, near or ()))),
            frozenset(clean(lang, lambda x: x.strip().lower())), frozenset(clean(ext, T.normalize_ext)),
            tuple(clean(path_prefix, T.normalize_path_prefix)), tuple(sets), max(0, int(min_match)),
        )

    @classmethod
    def from_dsl(cls, data: dict, strict: bool = False) -> Query:
        if strict and (wrong := dsl_faults(data)):
            raise ValueError("; ".join(wrong))
        return cls.of(data.get("must"), data.get("should"), data.get("not"), data.get("near"), data.get("lang"), data.get("ext"), data.get("path_prefix"), data.get("symbol"))

    def terms(self) -> list[str]:
        every = [*self.must, *self.should, *self.exclude, *[t for s in self.symbol for t in s], *[t for n in self.near for t in n.terms]]
        return list(dict.fromkeys(every))

    def signature(self, max_hits: int, k1: float, b: float, fingerprint: str, weights: SymbolWeights) -> str:
        """What a cursor belongs to: the query, the model and the corpus; not the page size."""
        state = {
            "must": self.must, "should": self.should, "not": self.exclude, "near": [(n.terms, n.scope, n.window) for n in self.near], "lang": sorted(self.lang), "ext": sorted(self.ext),
            "path_prefix": self.path_prefix, "symbol": self.symbol, "min_match": self.min_match, "max_hits": max_hits, "k1": k1, "b": b, "corpus": fingerprint, "weights": weights.signature(),
        }
        return hashlib.sha1(json.dumps(state, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


def _near(clause) -> Near | None:
    """None for a malformed clause, which is dropped."""
    if isinstance(clause, Near):
        return clause
    if not isinstance(clause, dict):
        return None
    terms, scope, window = (clause.get(k) for k in ("terms", "scope", "window"))
    if not (isinstance(terms, list | tuple) and isinstance(scope, str) and isinstance(window, int)):
        return None
    named = tuple(T.normalize_term(t) for t in terms if isinstance(t, str) and t.strip())
    return Near(named, scope, max(0, window)) if len(named) > 1 else None


def dsl_faults(data: dict) -> list[str]:
    """Limits of the query contract that a query breaks."""
    known = {"version", "must", "should", "not", "near", "lang", "ext", "path_prefix", "symbol", "budget", "options"}
    out = [f"unknown key {k}" for k in data if k not in known]
    for key in ("must", "should", "not", "lang", "ext", "path_prefix", "symbol"):
        value = data.get(key, [])
        if not isinstance(value, list) or not all(isinstance(x, str) and x for x in value):
            out.append(f"{key} is not a list of strings")
        elif len(value) > 64:
            out.append(f"{key} has over 64 entries")
    for clause in data.get("near", []):
        terms, window = clause.get("terms", []), clause.get("window", 0)
        if not 2 <= len(terms) <= 4:
            out.append("near takes 2 to 4 terms")
        if clause.get("scope") not in ("line_window", "block", "symbol"):
            out.append("near has an unknown scope")
        if not isinstance(window, int) or not 0 <= window <= 200:
            out.append("near takes a window of 0 to 200")
    for key, least in (("max_bytes", 256), ("max_results", 1), ("max_hits", 1), ("max_excerpt", 1)):
        value = data.get("budget", {}).get(key, least)
        if not isinstance(value, int) or value < least:
            out.append(f"budget.{key} is under {least}")
    return out


def count_of(tokens: str, term: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == term))


def places_of(by_line: str, term: str) -> Column:
    """1-based lines whose tokens hold the term."""
    marked = F.transform(by_line, lambda ts, k: F.when(F.array_contains(ts, term), k + 1))
    return F.filter(marked, lambda k: k.isNotNull())


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def all_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


class Search:
    """One query over features: a row for each document with tf_i, and lines_i and regions where the query needs them."""

    def __init__(self, query: Query, features: DataFrame, terms: list[str], stats: dict, k1: float = I.K1, b: float = I.B, weights: SymbolWeights | None = None):
        self.query, self.features, self.terms, self.stats, self.k1, self.b = query, features, terms, stats, k1, b
        self.weights = SymbolWeights.shipped() if weights is None else weights

    # Where features come from.

    @classmethod
    def scan(cls, docs: DataFrame, query: Query, **kw) -> Search:
        """Without an index, over docs(doc_id, path, lang, text): term counts are array functions of the row, no exchange.

        The small projection is kept, as it is read for the statistics and for the ranking; close() lets it go.
        """
        terms = query.terms()
        rows = I.measured(docs).withColumn("__tokens", T.tokens(F.col("text"))).withColumn("doc_length", F.size("__tokens").cast("long"))
        places = bool(query.near or query.symbol)
        rows = rows.withColumns({f"tf_{i}": count_of("__tokens", t) for i, t in enumerate(terms)})
        if places:
            hit = any_of([F.col(f"tf_{i}") > 0 for i in range(len(terms))])
            rows = R.with_regions(rows)
            rows = rows.withColumn("__byline", F.when(hit, F.transform("lines", lambda x: T.tokens(x))))
            rows = rows.withColumns({f"lines_{i}": F.when(F.col(f"tf_{i}") > 0, places_of("__byline", t)) for i, t in enumerate(terms)})
        keep = ["doc_id", "path", "lang", "line_count", "content_hash", "doc_length", *[f"tf_{i}" for i in range(len(terms))]]
        keep += [*[f"lines_{i}" for i in range(len(terms))], "block_regions", "symbol_regions"] if places else []
        features = rows.select(*keep).persist()
        return cls(query, features, terms, cls._stats(features, terms), **kw)

    @classmethod
    def indexed(cls, index: I.Index, query: Query, **kw) -> Search:
        """Over an index: the postings of the query's terms only, pivoted by document; N and the lengths' mean are the index's own."""
        terms = query.terms()
        found = index.postings.where(F.col("term").isin(terms)) if terms else index.postings.where(F.lit(False))
        columns = [c for i, t in enumerate(terms) for c in (F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"tf_{i}"), F.max(F.when(F.col("term") == t, F.col("lines"))).alias(f"lines_{i}"))]
        features = index.documents
        if terms:
            features = features.join(found.groupBy("doc_id").agg(*columns), "doc_id", "left")
            features = features.withColumns({f"tf_{i}": F.coalesce(f"tf_{i}", F.lit(0)) for i in range(len(terms))})
        df = {r["term"]: r["n"] for r in found.groupBy("term").agg(F.count("*").alias("n")).collect()} if terms else {}  # a row for each term
        n, avg = index.totals()
        return cls(query, features, terms, {"n": n, "avg": avg, "df": {t: df.get(t, 0) for t in terms}}, **({"k1": index.k1, "b": index.b} | kw))

    def close(self) -> None:
        self.features.unpersist()

    @staticmethod
    def _stats(features: DataFrame, terms: list[str]) -> dict:
        """One row: N, average length, the document frequency of each term."""
        row = features.agg(F.count("*").alias("n"), F.avg(F.col("doc_length").cast("double")).alias("avg"), *[F.sum((F.col(f"tf_{i}") > 0).cast("long")).alias(f"df_{i}") for i in range(len(terms))]).first()
        return {"n": row["n"], "avg": row["avg"] or 0.0, "df": {t: row[f"df_{i}"] or 0 for i, t in enumerate(terms)}}

    # Parts of a query.

    def tf(self, term: str) -> Column:
        return F.col(f"tf_{self.terms.index(term)}")

    def lines(self, term: str) -> Column:
        return F.col(f"lines_{self.terms.index(term)}")

    def has(self, term: str) -> Column:
        return self.tf(term) > 0

    def bm25(self, term: str) -> Column:
        n, df, avg = float(self.stats["n"]), float(self.stats["df"][term]), float(self.stats["avg"])
        tf = self.tf(term).cast("double")
        idf = F.log((F.lit(n) - F.lit(df) + F.lit(0.5)) / (F.lit(df) + F.lit(0.5)) + F.lit(1.0))
        if avg <= 0:
            return tf
        norm = F.lit(1.0 - self.b) + F.lit(self.b) * (F.col("doc_length").cast("double") / F.lit(avg))
        return idf * (tf * F.lit(self.k1 + 1.0) / (tf + F.lit(self.k1) * norm))

    def lexical(self) -> tuple[Column, Column, Column]:
        """(is a candidate, score summed in query order, should terms matched; a repeated term counts again)."""
        q, score = self.query, None
        for t in q.must:
            score = self.bm25(t) if score is None else score + self.bm25(t)
        score = F.lit(0.0) if score is None else score
        matched = F.lit(0)
        for t in q.should:
            score = score + F.when(self.has(t), self.bm25(t) * F.lit(SHOULD_BOOST)).otherwise(F.lit(0.0))
            matched = matched + self.has(t).cast("int")
        is_in = all_of([self.has(t) for t in q.must]) if q.must else matched > 0 if q.should else F.lit(False)
        return is_in, score, matched

    def evidence(self, terms: tuple[str, ...]) -> Column:
        """Mean over the terms of the part of their lines that lie in a symbol; 0 unless all are there."""
        inside = lambda t: F.size(F.filter(self.lines(t), lambda x: F.exists("symbol_regions", lambda r: x.between(r["start"], r["end"])))).cast("double") / F.size(self.lines(t))
        total = reduce(lambda a, b: a + b, map(inside, terms))
        return F.when(all_of([self.has(t) for t in terms]), total / F.lit(float(len(terms)))).otherwise(F.lit(0.0))

    def is_near(self, clause: Near) -> Column:
        """Some line L that holds a term, such that each term has a line in [L - window, L], within one region of the scope."""
        w = clause.window
        held = all_of([self.has(t) for t in clause.terms])
        every = F.concat(*[self.lines(t) for t in clause.terms])
        if clause.scope == "line_window":
            fits = F.exists(every, lambda at: all_of([F.exists(self.lines(t), lambda x: x.between(at - w, at)) for t in clause.terms]))
        elif clause.scope in ("block", "symbol"):
            scope = R.scope_regions(clause.scope, F.col("block_regions"), F.col("symbol_regions"), F.col("line_count"))
            fits = F.exists(scope, lambda r: F.exists(every, lambda at: at.between(r["start"], r["end"]) & all_of([F.exists(self.lines(t), lambda x: x.between(F.greatest(at - w, r["start"]), at)) for t in clause.terms])))
        else:
            return F.lit(False)
        return F.when(held, fits).otherwise(F.lit(False))

    def metadata(self) -> Column:
        q, tests = self.query, []
        if q.lang:
            tests.append(F.lower(F.coalesce("lang", F.lit(""))).isin(sorted(q.lang)))
        if q.ext:
            tests.append(T.suffix(F.col("path")).isin(sorted(q.ext)))
        if q.path_prefix:
            tests.append(any_of([F.replace("path", F.lit("\\"), F.lit("/")).startswith(p) for p in q.path_prefix]))
        return all_of(tests)

    def scored(self, **more: Column) -> DataFrame:
        """doc_id, path, raw, score, line_count, content_hash of all matches, not yet ranked, and more columns of the features.

        Score is 100 times the sum, cut toward zero and kept within 0 to 1000.
        """
        q = self.query
        is_in, score, matched = self.lexical()
        if q.symbol:
            sets = [all_of([self.has(t) for t in s]) for s in q.symbol]
            best = self.evidence(q.symbol[0]) if len(q.symbol) == 1 else F.greatest(*map(self.evidence, q.symbol))
            if (q.must or q.should) and self.features.where(is_in).limit(1).count():
                is_in = is_in & any_of(sets)
            else:  # documents with the symbol stand in for the candidates that there are none of
                is_in, score = any_of(sets), F.lit(0.0)
            score = score + self.weights.column(F.col("lang")) * best
        elif not q.must and not q.should and (q.lang or q.ext or q.path_prefix or q.near):
            is_in, score = F.lit(True), F.lit(0.0)
        if q.should and q.min_match:
            is_in = is_in & (matched >= q.min_match)
        is_in = is_in & ~any_of([self.has(t) for t in q.exclude]) & self.metadata()
        for clause in q.near:
            is_in = is_in & self.is_near(clause)
        cut = F.greatest(F.lit(0), F.least(F.lit(1000), F.least(F.greatest(score * 100, F.lit(-1.0)), F.lit(1001.0)).cast("int")))
        return self.features.where(is_in).select("doc_id", "path", "lang", score.alias("raw"), cut.alias("score"), "line_count", "content_hash", *[c.alias(k) for k, c in more.items()])

    def ranked(self, limit: int | None = None, offset: int = 0, **more: Column) -> DataFrame:
        out = self.scored(**more).orderBy(F.desc("score"), "doc_id")
        return out if limit is None else out.offset(offset).limit(limit) if offset else out.limit(limit)


def result_rows(found: DataFrame, max_hits: int = 10) -> DataFrame:
    """Columns of a result: one made-up hit on line 1 with the path, a range of 50 lines, handles."""
    hits = F.slice(F.array(F.struct(F.lit(1).alias("line"), F.col("path").alias("text"), F.col("score").alias("score"))), 1, max_hits)
    return found.select(
        "doc_id", "path", "score", hits.alias("hits"), F.lit(1).alias("from_line"), F.least(F.lit(50), "line_count").alias("to_line"), F.lit(1).alias("bound_start"), F.col("line_count").alias("bound_end"),
        T.doc_handle(F.col("doc_id")).alias("doc_handle"), T.span_handle(F.col("doc_id")).alias("span_handle"), F.col("content_hash").alias("digest"), F.array().cast("array<string>").alias("next_spans"),
    )


@dataclass
class Page:
    """One page of results, on the driver: max_results rows at most."""

    results: list
    start: int
    total: int
    signature: str

    def cursor_after(self, emitted: int) -> str | None:
        at = self.start + max(0, emitted)
        return f"cur_{at}_{self.signature}" if at < self.total else None


def search_page(index: I.Index, query: Query, max_results: int = 20, max_hits: int = 10, cursor: str | None = None, weights: SymbolWeights | None = None) -> Page:
    weights = SymbolWeights.shipped() if weights is None else weights
    signature = query.signature(max_hits, index.k1, index.b, index.fingerprint(), weights)
    start = 0
    if cursor is not None:
        m = CURSOR.match(cursor)
        if m is None:
            raise ValueError("Invalid cursor format")
        if m[2] != signature:
            raise ValueError("Cursor does not match query")
        start = int(m[1])
    found = Search.indexed(index, query, weights=weights)
    total = found.scored().count()
    if total and start >= total:
        raise ValueError("Cursor offset is out of range")
    rows = result_rows(found.ranked(max_results, start), max_hits).collect() if total else []
    return Page(rows, start, total, signature)


def all_pages(index: I.Index, query: Query, max_results: int = 20, max_hits: int = 10, weights: SymbolWeights | None = None) -> DataFrame:
    """(page, place, doc_id, path, score, cursor) of all results: the pages that search_page gives from cursor to cursor, of one ranking.

    A walk ranks everything anew for each page, so its work grows with the square of the results.
    """
    weights = SymbolWeights.shipped() if weights is None else weights
    signature = query.signature(max_hits, index.k1, index.b, index.fingerprint(), weights)
    order = [F.desc("score"), F.col("doc_id")]
    found, total = I.in_order(Search.indexed(index, query, weights=weights).scored().select("doc_id", "path", "score"), order, order, "at")
    page = F.floor(F.col("at") / max_results) + 1
    cursor = F.when(page * max_results < total, F.concat(F.lit("cur_"), (page * max_results).cast("string"), F.lit(f"_{signature}")))
    return found.select(page.cast("int").alias("page"), (F.col("at") + 1).cast("int").alias("place"), "doc_id", "path", "score", cursor.alias("cursor"))


def search(index: I.Index, query: Query, max_results: int = 20, max_hits: int = 10, weights: SymbolWeights | None = None) -> list:
    """The first page's results."""
    return search_page(index, query, max_results, max_hits, None, weights).results
