"""Named queries over the driver's tables and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgrain.functions import text as T
from lexgrain.operators import balance, contracts, evaluate, fit
from lexgrain.operators import index as I
from lexgrain.operators import regions as R
from lexgrain.operators.output import format_results, path_numbers, run_query, within_budget
from lexgrain.operators.search import Query, Search, SymbolWeights, result_rows
from lexgrain.sources import shared

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a corpus of files: path is source/doc_id.lang."""
    path = F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "lang", F.coalesce("text", F.lit("")).alias("text"))


_SAVED: dict[tuple[str, str], tuple[str, str]] = {}


def saved_index(spark: SparkSession, sf_dir: str) -> I.Index:
    """The index of that corpus, built and written once in a session, and again when the table's files change."""
    key, files = (spark.sparkContext.applicationId, sf_dir), shared.versions(spark, f"{sf_dir}/documents.parquet")
    if _SAVED.get(key, ("", ""))[0] != files:
        at = shared.path(spark, "index")
        I.Index.build(corpus(spark, sf_dir).withColumnRenamed("text", "content"), parse=False).save(at)
        _SAVED[key] = files, at
    return I.Index.load(spark, _SAVED[key][1])


# SQL parts. Lists of tokens without look-around: camel-case parts are set apart by spaces first.
def _parts(w: str) -> str:
    return f"regexp_extract_all(regexp_replace({w}, '([A-Z][a-z]+)', ' \\1 ', 'g') || ' ', '[A-Z][a-z]+|[a-z]+|[A-Z]+ ')"


def _tokens(s: str) -> str:
    return f"flatten(list_transform(regexp_extract_all({s}, '[a-zA-Z0-9]+'), lambda w: CASE WHEN regexp_matches(w, '^[a-zA-Z]') AND len({_parts('w')}) > 0 THEN list_transform({_parts('w')}, lambda p: lower(trim(p))) ELSE [lower(w)] END))"


DOCS = "d AS (SELECT doc_id, concat(source, '/doc_', doc_id, '.', lang) AS path, lang, coalesce(text, '') AS text FROM documents)"
WHITE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
DECLARED = rf"(?i)^[{WHITE}]*(def|class|fn|func|function|interface|struct|enum|impl|type)\b"
LINES = f"""ln AS (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS s FROM d),
bl AS (SELECT *, regexp_matches(s, '[^{WHITE}]') AS ok, sum((NOT regexp_matches(s, '[^{WHITE}]'))::INT) OVER (PARTITION BY doc_id ORDER BY line) AS g FROM ln),
blocks0 AS (SELECT doc_id, min(line) AS s, max(line) AS e FROM bl WHERE ok GROUP BY doc_id, g),
n AS (SELECT doc_id, max(line) AS n_lines FROM ln GROUP BY doc_id),
blocks AS (SELECT * FROM blocks0 UNION ALL SELECT doc_id, 1, n_lines FROM n WHERE doc_id NOT IN (SELECT doc_id FROM blocks0)),
sym0 AS (SELECT doc_id, line AS s, coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY line) - 1, n_lines) AS e FROM ln JOIN n USING (doc_id) WHERE regexp_matches(s, '{DECLARED}')),
symbols AS (SELECT * FROM sym0 UNION ALL SELECT * FROM blocks WHERE doc_id NOT IN (SELECT doc_id FROM sym0))"""


def _search_sql(must=(), should=(), exclude=(), min_match=0, where="TRUE", everything=False, near=None, symbol=None, weight=None, columns="doc_id, path, score", tail="") -> str:
    """A search as SQL, written apart from the plan: counts, statistics, scores, conditions."""
    terms = list(dict.fromkeys([*must, *should, *exclude, *(symbol or ()), *((near or {}).get("terms", ()))]))
    at = {t: i for i, t in enumerate(terms)}
    tf = "".join(f", len(list_filter(toks, lambda x: x = '{t}')) AS tf{i}" for t, i in at.items())
    df = "".join(f", sum((tf{i} > 0)::INT) AS df{i}" for i in at.values())
    bm = lambda t: f"(ln((n - df{at[t]} + 0.5::DOUBLE) / (df{at[t]} + 0.5::DOUBLE) + 1.0::DOUBLE) * (tf{at[t]} * 2.2::DOUBLE / (tf{at[t]} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (dl / avgdl)))))"
    score = " + ".join([*map(bm, must), *[f"CASE WHEN tf{at[t]} > 0 THEN {bm(t)} * 0.5::DOUBLE ELSE 0.0::DOUBLE END" for t in should]]) or "0.0::DOUBLE"
    match = " + ".join(f"(tf{at[t]} > 0)::INT" for t in should) or "0"
    tests = [where, *[f"tf{at[t]} > 0" for t in must], *[f"tf{at[t]} = 0" for t in exclude], *[f"tf{at[t]} > 0" for t in symbol or ()]]
    if should and not must:
        tests.append(f"({match}) > 0")
    if min_match:
        tests.append(f"({match}) >= {min_match}")
    more, extra = "", ""
    if near or symbol:
        of = near["terms"] if near else symbol
        more = "," + LINES + ", ll AS (SELECT doc_id, " + ", ".join(f"list(line ORDER BY line) FILTER (list_contains({_tokens('s')}, '{t}')) AS l{at[t]}" for t in of) + " FROM ln GROUP BY doc_id), bb AS (SELECT doc_id, list({'s': s, 'e': e}) AS blk FROM blocks GROUP BY doc_id), ss AS (SELECT doc_id, list({'s': s, 'e': e}) AS sym FROM symbols GROUP BY doc_id)"
        extra = " JOIN ll USING (doc_id) JOIN bb USING (doc_id) JOIN ss USING (doc_id)"
    if near:
        w, ls = near["window"], [f"l{at[t]}" for t in near["terms"]]
        every = f"list_concat({', '.join(ls)})" if len(ls) == 2 else f"flatten([{', '.join(ls)}])"
        tests += [f"tf{at[t]} > 0" for t in near["terms"]]
        if near["scope"] == "line_window":
            tests.append(f"len(list_filter({every}, lambda a: " + " AND ".join(f"len(list_filter({x}, lambda y: y BETWEEN a - {w} AND a)) > 0" for x in ls) + ")) > 0")
        else:
            region = "blk" if near["scope"] == "block" else "sym"
            tests.append(f"len(list_filter({region}, lambda r: len(list_filter({every}, lambda a: a BETWEEN r.s AND r.e AND " + " AND ".join(f"len(list_filter({x}, lambda y: y BETWEEN greatest(a - {w}, r.s) AND a)) > 0" for x in ls) + ")) > 0)) > 0")
    if symbol:
        ev = "(" + " + ".join(f"len(list_filter(l{at[t]}, lambda y: len(list_filter(sym, lambda r: y BETWEEN r.s AND r.e)) > 0))::DOUBLE / len(l{at[t]})" for t in symbol) + f") / {len(symbol)}.0::DOUBLE"
        score = f"{score} + ({weight}) * ({ev})"
    return f"""WITH {DOCS}, t AS (SELECT *, {_tokens("text")} AS toks FROM d), f AS (SELECT doc_id, path, lang, text, len(toks)::DOUBLE AS dl{tf} FROM t),
st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl{df} FROM f){more}
SELECT {columns} FROM (SELECT doc_id, path, lang, text, least(1000, greatest(0, trunc(({score}) * 100)))::INT AS score FROM f CROSS JOIN st{extra} WHERE {" AND ".join(tests)}) {tail}"""


def _search(f_name: str, sql: str, **q):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Search.indexed(saved_index(spark, sf_dir), Query.of(**q)).scored().select("doc_id", "path", "score")

    run.__name__ = f_name
    query(sql)(run)


FR = "lower(coalesce(lang, '')) IN ('fr', 'es')"
_search("must_and", _search_sql(must=("the", "that")), must=["the", "that"])
_search("should_or", _search_sql(should=("the", "que")), should=["the", "que"])
_search("must_should", _search_sql(must=("the",), should=("that", "this", "with")), must=["the"], should=["that", "this", "with"])
_search("min_match", _search_sql(should=("the", "que", "und", "that"), min_match=2), should=["the", "que", "und", "that"], min_match=2)
_search("not_exclude", _search_sql(must=("the", "that"), exclude=("with",)), must=["the", "that"], exclude=["with"])
_search("lang_filter", _search_sql(must=("que",), where=FR), must=["que"], lang=["FR", "es"])
_search("ext_filter", _search_sql(must=("que",), where="lang = 'fr'"), must=["que"], ext=["fr"])
_search("path_prefix", _search_sql(must=("the",), where="(starts_with(path, 'src1/') OR starts_with(path, 'src2/'))"), must=["the"], path_prefix=["./src1/", "src2/"])
_search("metadata_only", _search_sql(where=FR), lang=["fr", "es"])
_search("near_line_window", _search_sql(near={"terms": ("the", "that"), "scope": "line_window", "window": 1}), near=[{"terms": ["the", "that"], "scope": "line_window", "window": 1}])
_search("near_block", _search_sql(near={"terms": ("the", "with"), "scope": "block", "window": 1}), near=[{"terms": ["the", "with"], "scope": "block", "window": 1}])
_search("near_symbol", _search_sql(must=("and",), near={"terms": ("the", "with"), "scope": "symbol", "window": 0}), must=["and"], near=[{"terms": ["the", "with"], "scope": "symbol", "window": 0}])
_search("symbol_filter", _search_sql(symbol=("the", "that"), weight="-0.7123949932005774::DOUBLE"), symbol=["the_that"])


@query(_search_sql(must=("this",), symbol=("the", "that"), weight="CASE lang WHEN 'en' THEN 2.5::DOUBLE WHEN 'fr' THEN -1.0::DOUBLE ELSE 0.25::DOUBLE END"))
def symbol_weighted(spark, sf_dir):
    weights = SymbolWeights({"en": 2.5, "fr": -1.0}, 0.25)
    return Search.indexed(saved_index(spark, sf_dir), Query.of(must=["this"], symbol=["the_that"]), weights=weights).scored().select("doc_id", "path", "score")


@query(_search_sql(must=("the", "that"), columns="doc_id, path, score", tail="ORDER BY score DESC, doc_id LIMIT 10 OFFSET 20"))
def topk_page(spark, sf_dir):
    return Search.indexed(saved_index(spark, sf_dir), Query.of(must=["the", "that"])).ranked(10, 20).select("doc_id", "path", "score")


@query(_search_sql(must=("the", "that"), columns="doc_id, path, score, 1 AS from_line, least(50, len(string_split(text, chr(10))))::INT AS to_line, len(string_split(text, chr(10)))::INT AS bound_end, printf('doc_%08x', doc_id) AS doc_handle, printf('span_%08x_001', doc_id) AS span_handle, substr(sha256(text), 1, 16) AS digest, 1 AS n_hits", tail="ORDER BY score DESC, doc_id LIMIT 20"))
def result_columns(spark, sf_dir):
    rows = result_rows(Search.indexed(saved_index(spark, sf_dir), Query.of(must=["the", "that"])).ranked(20))
    return rows.select("doc_id", "path", "score", "from_line", "to_line", "bound_end", "doc_handle", "span_handle", "digest", F.size("hits").alias("n_hits"))


@query(f"WITH s AS ({_search_sql(must=('the', 'that'), columns='doc_id, path, score, len(string_split(text, chr(10))) AS line_count', tail='ORDER BY score DESC, doc_id LIMIT 20')}), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s), z AS (SELECT *, 211 + length((rank - 1)::VARCHAR) + 2 * length(score::VARCHAR) + strlen(path) + 2 + length(least(50, line_count)::VARCHAR) + length(line_count::VARCHAR) + strlen(path) + 2 + CASE WHEN rank > 1 THEN 4 ELSE 0 END AS n_bytes FROM r), e AS (SELECT *, 176 + sum(n_bytes) OVER (ORDER BY rank) AS emitted FROM z) SELECT doc_id, rank, emitted::BIGINT AS emitted FROM e WHERE emitted <= 4000")
def byte_budget(spark, sf_dir):
    top = Search.indexed(saved_index(spark, sf_dir), Query.of(must=["the", "that"])).ranked(20).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("long"))
    return within_budget(top, 4000, {"max_bytes": 8192}).select("doc_id", "rank", F.col("emitted").cast("long").alias("emitted"))


@query(f"WITH r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({_search_sql(must=('the', 'that'))})), p AS (SELECT split_part(path, '/', 1) AS folder, min(rank) AS first_rank FROM r GROUP BY 1) SELECT folder, row_number() OVER (ORDER BY first_rank) - 1 AS pi FROM p")
def path_dictionary(spark, sf_dir):
    top = Search.indexed(saved_index(spark, sf_dir), Query.of(must=["the", "that"])).scored()
    place = F.struct((-F.col("score")).alias("s"), "doc_id")
    return path_numbers(top.select(F.substring_index("path", "/", 1).alias("folder"), place.alias("place")), "folder", "place")


@query()
def minijson(spark, sf_dir):
    found = Search.indexed(saved_index(spark, sf_dir), Query.of(must=["the", "that"]))
    total = found.scored().count()
    out, fit = format_results(result_rows(found.ranked(20)).collect(), {"max_bytes": 4000}, f"cur_20_{Query.of(must=['the']).signature(10, 1.2, 0.75, '', SymbolWeights())}", True)
    import json

    return spark.createDataFrame([(json.dumps(out, ensure_ascii=False), fit, total)], "result string, emitted int, total long")


@query(f"WITH r AS ({_search_sql(must=('the', 'that'), exclude=('with',), columns='doc_id, score')}) SELECT doc_id, score, ((row_number() OVER (ORDER BY score DESC, doc_id) - 1) // 7)::INT AS page FROM r QUALIFY page < 3")
def cursor_walk(spark, sf_dir):
    found = Search.indexed(saved_index(spark, sf_dir), Query.of(must=["the", "that"], exclude=["with"]))
    pages = [found.ranked(7, 7 * k).select("doc_id", "score", F.lit(k).alias("page")) for k in range(3)]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


@query()
def index_query(spark, sf_dir):
    """The index plan: built, then asked through the contract's own object."""
    import json

    out = run_query(saved_index(spark, sf_dir), {"must": ["the"], "should": ["that"], "budget": {"max_results": 5}}, SymbolWeights.disabled())
    return spark.createDataFrame([(json.dumps(out),)], "result string")


# Tokens, documents, postings.


@query(f"WITH {DOCS}, t AS (SELECT doc_id, unnest({_tokens('text')}) AS term FROM d) SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM t GROUP BY term")
def tokenize_terms(spark, sf_dir):
    t = corpus(spark, sf_dir).select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    # A count by document first: distinct documents then are rows, and the common terms never form one group.
    return t.groupBy("term", "doc_id").agg(F.count("*").alias("n")).groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("df"))


IDENTIFIERS = ("CamelCase", "HTTPRequest", "parseJSON", "URL", "snake_case", "foo__bar", "HTTPResponseWriter", "base64", "sha256sum", "MAX1", "HTTP2Server", "2nd", "0xFF", "FOOb", "ABc", "A", "getX2Y", "print_errorCode")


@query(f"WITH v AS (SELECT unnest({list(IDENTIFIERS)!r}) AS s) SELECT s, array_to_string({_tokens('s')}, ' ') AS parts, array_to_string(list_transform(regexp_extract_all(s, '[a-zA-Z0-9]+'), lambda x: lower(x)), ' ') AS snake FROM v")
def camel_snake_values(spark, sf_dir):
    rows = spark.createDataFrame([(s,) for s in IDENTIFIERS], "s string")
    return rows.select("s", F.array_join(T.tokens(F.col("s")), " ").alias("parts"), F.array_join(T.split_snake(F.col("s")), " ").alias("snake"))


@query(f"WITH {DOCS} SELECT doc_id, len(string_split(text, chr(10)))::INT AS line_count, strlen(text) AS size_bytes, len({_tokens('text')})::BIGINT AS doc_length, substr(sha256(text), 1, 16) AS content_hash FROM d")
def doc_stats(spark, sf_dir):
    return I.measured(corpus(spark, sf_dir)).select("doc_id", "line_count", "size_bytes", "doc_length", "content_hash")


@query(f"WITH {DOCS}, t AS (SELECT len({_tokens('text')}) AS dl FROM d) SELECT count(*) AS total_docs, sum(dl)::BIGINT AS total_terms, round(avg(dl), 6) AS avg_doc_length FROM t")
def corpus_stats(spark, sf_dir):
    return I.corpus_stats(I.measured(corpus(spark, sf_dir)).select("doc_length")).withColumn("avg_doc_length", F.round("avg_doc_length", 6))


@query(f"WITH {DOCS}, t AS (SELECT doc_id, concat_ws('|', doc_id, path, substr(sha256(text), 1, 16), strlen(text), len(string_split(text, chr(10))), len({_tokens('text')})) AS s FROM d) SELECT substr(sha1(string_agg(s, chr(10) ORDER BY doc_id)), 1, 20) AS fingerprint FROM t")
def fingerprint(spark, sf_dir):
    return I.fingerprint(I.measured(corpus(spark, sf_dir)))


@query(f"WITH {DOCS}, ln AS (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS s FROM d), t AS (SELECT doc_id, line, unnest({_tokens('s')}) AS term FROM ln), p AS (SELECT term, doc_id, count(*) AS tf, count(DISTINCT line) AS n_lines, min(line) AS first_line FROM t WHERE term IN ('the', 'que', 'und', 'that') GROUP BY term, doc_id) SELECT term, doc_id, tf, n_lines::INT AS n_lines, first_line::INT AS first_line FROM p")
def postings_of_terms(spark, sf_dir):
    p = I.postings(corpus(spark, sf_dir), ["the", "que", "und", "that"])
    return p.select("term", "doc_id", "tf", F.size("lines").alias("n_lines"), F.get("lines", F.lit(0)).alias("first_line"))


@query(f"WITH {DOCS}, t AS (SELECT doc_id, unnest({_tokens('text')}) AS term FROM d), p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS n FROM p GROUP BY term ORDER BY df DESC, term LIMIT 50")
def postings_topterms(spark, sf_dir):
    p = corpus(spark, sf_dir).select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n")).orderBy(F.desc("df"), "term").limit(50)


@query(_search_sql(must=("that",), columns="doc_id, score"))
def bm25_term(spark, sf_dir):
    return Search.indexed(saved_index(spark, sf_dir), Query.of(must=["that"])).scored().select("doc_id", "score")


@query("WITH v AS (SELECT url, lower(regexp_extract(url, '[^/](\\.[^./]+)$', 1)) AS ext FROM pages) SELECT url, ext, CASE ext WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.c' THEN 'c' WHEN '.md' THEN 'markdown' WHEN '.go' THEN 'go' WHEN '.json' THEN 'json' END AS lang FROM v")
def lang_detect(spark, sf_dir):
    ext = T.suffix(F.col("url"))
    return table(spark, sf_dir, "pages").select("url", ext.alias("ext"), T.language_of(ext).alias("lang"))


# Regions.


def _regions(spark, sf_dir, which: str) -> DataFrame:
    rows = I.measured(corpus(spark, sf_dir)).select("doc_id", "text", "lines", "lang", "line_count")
    return R.with_regions(rows, parse=False).select("doc_id", F.explode(which).alias("r")).select("doc_id", "r.start", "r.end")


@query(f'WITH {DOCS}, {LINES} SELECT doc_id, s::INT AS start, e::INT AS "end" FROM blocks')
def blank_blocks(spark, sf_dir):
    return _regions(spark, sf_dir, "block_regions")


@query(f'WITH {DOCS}, {LINES} SELECT doc_id, s::INT AS start, e::INT AS "end" FROM symbols')
def regex_symbols(spark, sf_dir):
    return _regions(spark, sf_dir, "symbol_regions")


@query(r"""WITH c AS (SELECT page_id, unnest(generate_series(1, length(html))) AS pos, unnest(string_split(html, '')) AS ch FROM pages), l AS (SELECT *, 1 + sum((ch = chr(10))::INT) OVER (PARTITION BY page_id ORDER BY pos) AS line FROM c),
b AS (SELECT *, sum(CASE ch WHEN '{' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY pos) AS raw FROM l WHERE ch IN ('{', '}')), m AS (SELECT *, least(0, min(raw) OVER (PARTITION BY page_id ORDER BY pos)) AS mn FROM b),
k AS (SELECT *, raw - mn AS depth, mn < coalesce(lag(mn) OVER (PARTITION BY page_id ORDER BY pos), 0) AS stray FROM m), o AS (SELECT *, CASE ch WHEN '{' THEN depth ELSE depth + 1 END AS d FROM k WHERE NOT stray),
z AS (SELECT *, last_value(CASE WHEN ch = '{' THEN line END IGNORE NULLS) OVER (PARTITION BY page_id, d ORDER BY pos) AS s FROM o) SELECT page_id, s::INT AS start, line::INT AS "end", count(*) AS n FROM z WHERE ch = '}' GROUP BY ALL""")
def brace_regions(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", R.parsed_regions(F.coalesce("html", F.lit("")), F.lit("javascript")).alias("r"))
    return pages.select("page_id", F.explode("r.block").alias("b")).groupBy("page_id", F.col("b.start").alias("start"), F.col("b.end").alias("end")).agg(F.count("*").alias("n"))


@query(f"WITH {DOCS}, n AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{WHITE}]')))::INT AS m FROM d) SELECT doc_id, m + 2 AS n_blocks, m + 1 AS n_symbols, TRUE AS parsed FROM n")
def python_regions(spark, sf_dir):
    """The whole text of each document as Python source: a class with a method for each line that is not blank, which returns the line."""
    quoted = lambda x: F.replace(F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\r"), F.lit("\\r")), F.lit("\0"), F.lit("\\0"))
    method = lambda x: F.when(~T.is_blank(x), F.concat(F.lit("    def f(self):\n        return '"), quoted(x), F.lit("'\n"))).otherwise("\n")
    body = F.concat(F.lit("class A:\n    pass\n"), F.array_join(F.transform(T.lines(F.col("text")), method), ""), F.lit("\nif A:\n    pass\n"))
    rows = corpus(spark, sf_dir).select("doc_id", R.parsed_regions(body, F.lit("python")).alias("r"))
    return rows.select("doc_id", F.size("r.block").alias("n_blocks"), F.size("r.symbol").alias("n_symbols"), "r.parsed")


@query('SELECT doc_id, greatest(1, least(n, (doc_id % 9)::INT - 2)) AS start, greatest(1, least(n, (doc_id % 14)::INT - 1)) AS "end" FROM (SELECT doc_id, len(string_split(text, chr(10)))::INT AS n FROM documents) WHERE greatest(1, least(n, (doc_id % 14)::INT - 1)) >= greatest(1, least(n, (doc_id % 9)::INT - 2))')
def region_normalize(spark, sf_dir):
    raw = F.array(F.struct((F.col("doc_id") % 9 - 2).cast("int").alias("start"), (F.col("doc_id") % 14 - 1).cast("int").alias("end")))
    rows = corpus(spark, sf_dir).select("doc_id", F.explode(R.normalized(raw, F.size(T.lines(F.col("text"))))).alias("r"))
    return rows.select("doc_id", "r.start", "r.end")


@query(f"WITH {DOCS}, {LINES}, s AS (SELECT ln.doc_id, line, list_contains({_tokens('s')}, 'the') AS has FROM ln), e AS (SELECT s.doc_id, s.line, bool_or(y.doc_id IS NOT NULL) AS inside FROM s LEFT JOIN symbols y ON y.doc_id = s.doc_id AND s.line BETWEEN y.s AND y.e WHERE has GROUP BY ALL) SELECT doc_id, round(avg(inside::INT), 9) AS evidence FROM e GROUP BY doc_id")
def symbol_evidence(spark, sf_dir):
    found = Search.indexed(saved_index(spark, sf_dir), Query.of(symbol=["the"]))
    return found.features.where(found.has("the")).select("doc_id", F.round(found.evidence(("the",)), 9).alias("evidence"))


@query(f"SELECT path, line::INT AS line FROM (WITH {DOCS} SELECT path, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS s FROM d) WHERE regexp_matches(s, '(?i)(license|rights reserved|password)')")
def grep_scan(spark, sf_dir):
    return evaluate.grep(corpus(spark, sf_dir), ["license", "rights reserved", "password"]).select("path", "line")


@query("SELECT state, count(*) AS n FROM (SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS state FROM (SELECT doc_id AS k, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0) a FULL JOIN (SELECT doc_id AS k, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 3 <> 0) b ON a.k = b.k) GROUP BY state")
def index_diff(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    old = docs.where("doc_id % 5 <> 0").select("path", T.content_hash(F.col("text")).alias("content_hash"))
    new = docs.where("doc_id % 3 <> 0").select("path", T.content_hash(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_hash"))
    return I.diff(old, new).groupBy("state").agg(F.count("*").alias("n"))


# Evaluation. Results of tasks: the line items of an order, in order of their number.

RESULTS = "r AS (SELECT l_orderkey AS task_id, l_linenumber AS rank, concat('part_', l_partkey, '.rs') AS path FROM lineitem), t AS (SELECT o_orderkey AS task_id, concat('part_', o_orderkey % 90 + 10) AS gold_file, ['easy', 'medium', 'hard'][o_orderkey % 3 + 1] AS difficulty, concat('repo', o_orderkey % 7) AS repo, o_orderkey % 11 AS ms FROM orders), g AS (SELECT t.task_id, t.gold_file, t.difficulty, t.repo, t.ms::DOUBLE AS latency_ms, min(r.rank) AS rank FROM t LEFT JOIN r ON r.task_id = t.task_id AND contains(r.path, t.gold_file) GROUP BY ALL), k AS (SELECT *, rank IS NOT NULL AS found, coalesce(1.0::DOUBLE / rank, 0.0) AS rr FROM g)"


def ranks(spark, sf_dir) -> DataFrame:
    results = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("rank"), F.concat(F.lit("part_"), F.col("l_partkey").cast("string"), F.lit(".rs")).alias("path"))
    o = F.col("o_orderkey")
    tasks = table(spark, sf_dir, "orders").select(o.alias("task_id"), F.concat(F.lit("part_"), (o % 90 + 10).cast("string")).alias("gold_file"), F.element_at(F.array(*map(F.lit, ("easy", "medium", "hard"))), (o % 3 + 1).cast("int")).alias("difficulty"), F.concat(F.lit("repo"), (o % 7).cast("string")).alias("repo"), (o % 11).cast("double").alias("latency_ms"))
    return evaluate.gold_rank(results, tasks)


@query(f"WITH {RESULTS} SELECT task_id, rank, found, round(rr, 9) AS rr FROM k")
def gold_rank(spark, sf_dir):
    return ranks(spark, sf_dir).select("task_id", "rank", "found", F.round("rr", 9).alias("rr"))


@query(f"WITH {RESULTS} SELECT repo, count(*) AS total, sum(found::INT)::BIGINT AS found, round(avg(found::INT), 9) AS recall, round(avg(rr), 9) AS mrr FROM k GROUP BY repo")
def recall_mrr(spark, sf_dir):
    return evaluate.summary(ranks(spark, sf_dir), "repo").withColumns({c: F.round(c, 9) for c in ("recall", "mrr")})


@query(f"WITH {RESULTS} SELECT repo, difficulty, count(*) AS total, sum(found::INT)::BIGINT AS found, round(avg(found::INT), 9) AS recall, round(avg(rr), 9) AS mrr FROM k GROUP BY ROLLUP (repo, difficulty)")
def eval_rollup(spark, sf_dir):
    return evaluate.rollup_by(ranks(spark, sf_dir), "repo", "difficulty").withColumns({c: F.round(c, 9) for c in ("recall", "mrr")})


@query(f"WITH {RESULTS}, p AS (SELECT repo, count(*) AS n, sum(found::INT) AS f, avg(rr) AS m, avg(latency_ms) AS l FROM k GROUP BY repo) SELECT sum(n)::BIGINT AS total, sum(f)::BIGINT AS found, round(sum(f) / sum(n)::DOUBLE, 9) AS recall, round(avg(m), 9) AS macro_mrr, round(sum(m * n) / sum(n), 9) AS micro_mrr, round(avg(l), 9) AS macro_latency FROM p")
def overall_summary(spark, sf_dir):
    return evaluate.overall(ranks(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("recall", "macro_mrr", "micro_mrr", "macro_latency")})


@query(f"WITH {RESULTS} SELECT round(avg(1 + least(coalesce(rank, 5), 5)), 9) AS grep_calls, 1.0::DOUBLE AS own_calls, round(1 - 1 / avg(1 + least(coalesce(rank, 5), 5)), 9) AS reduction FROM k")
def toolcall(spark, sf_dir):
    return evaluate.tool_calls(ranks(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("grep_calls", "reduction")})


@query(f"WITH {RESULTS}, c AS (SELECT gold_file, count(*) AS n FROM k GROUP BY 1) SELECT gold_file, n, round(n / sum(n) OVER ()::DOUBLE, 9) AS share, n / sum(n) OVER () > 0.6 AS dominant FROM c")
def gold_distribution(spark, sf_dir):
    return evaluate.share_of(ranks(spark, sf_dir), "gold_file").withColumn("share", F.round("share", 9))


VARIANTS = "v AS (SELECT unnest(['bm25_only', 'plus_symbol', 'plus_near', 'plus_prior']) AS variant, unnest([0, 1, 2, 3]) AS x), b AS (SELECT variant, avg((found AND task_id % 5 >= x)::INT) AS recall, avg(CASE WHEN task_id % 5 >= x THEN rr ELSE 0 END) AS mrr FROM k CROSS JOIN v GROUP BY variant)"


@query(f"WITH {RESULTS}, {VARIANTS} SELECT variant, round(recall, 9) AS recall, round(mrr, 9) AS mrr, round(recall - (SELECT recall FROM b WHERE variant = 'bm25_only'), 9) AS recall_delta, round(mrr - (SELECT mrr FROM b WHERE variant = 'bm25_only'), 9) AS mrr_delta FROM b")
def ablation_delta(spark, sf_dir):
    names = ("bm25_only", "plus_symbol", "plus_near", "plus_prior")
    kept = ranks(spark, sf_dir).select("task_id", "found", "rr", F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(i).alias("x")) for i, n in enumerate(names)])).alias("v")).select("task_id", "v.*", "found", "rr")
    on = F.col("task_id") % 5 >= F.col("x")
    by = evaluate.summary(kept.withColumn("found", F.col("found") & on).withColumn("rr", F.when(on, F.col("rr")).otherwise(0.0)), "variant").select("variant", "recall", "mrr")
    return evaluate.deltas(by).select("variant", *[F.round(c, 9).alias(c) for c in ("recall", "mrr", "recall_delta", "mrr_delta")])


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(value::DOUBLE, 0.95), 6) AS p95, round(quantile_cont(value::DOUBLE, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def latency_quantiles(spark, sf_dir):
    out = evaluate.quantiles(table(spark, sf_dir, "events"), "value", "event_type")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "p50", "p95", "p99")})


@query("WITH s AS (SELECT event_type, list(value ORDER BY value) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_type, v[round_even(0.9 * (len(v) - 1), 0)::INT + 1] AS value FROM s")
def nearest_rank_pct(spark, sf_dir):
    return balance.nearest_rank(table(spark, sf_dir, "events"), "value", 0.9, "event_type")


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS ci95 FROM events GROUP BY event_type")
def mean_ci(spark, sf_dir):
    return evaluate.confidence(table(spark, sf_dir, "events"), "value", "event_type").withColumns({c: F.round(c, 6) for c in ("mean", "std", "ci95")})


@query("SELECT user_id % 13 AS repeat, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM events WHERE event_type IN (SELECT min(event_type) FROM events) GROUP BY 1")
def repeats_summary(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    first = events.agg(F.min("event_type").alias("event_type"))
    rows = events.join(first, "event_type", "left_semi").withColumn("repeat", F.col("user_id") % 13)
    return evaluate.confidence(rows, "value", "repeat").select("repeat", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(stddev_pop(value) / avg(value), 6) AS cv FROM events GROUP BY event_type")
def coefficient_of_variation(spark, sf_dir):
    return balance.variation(table(spark, sf_dir, "events"), "value", "event_type").withColumns({c: F.round(c, 6) for c in ("mean", "std", "cv")})


@query("SELECT s_suppkey, round((s_acctbal - avg(s_acctbal) OVER (PARTITION BY s_nationkey)) / nullif(stddev_pop(s_acctbal) OVER (PARTITION BY s_nationkey), 0), 6) AS z FROM supplier")
def zscore(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumn("z", balance.zscore("s_acctbal", "s_nationkey"))
    alone = F.count("*").over(Window.partitionBy("s_nationkey")) == 1
    return rows.select("s_suppkey", F.when(~alone, F.round("z", 6)).alias("z"))


@query("WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), p AS (SELECT p_brand, n / sum(n) OVER (PARTITION BY p_brand)::DOUBLE AS p FROM c) SELECT p_brand, round(-sum(p * log2(p)), 9) AS entropy FROM p GROUP BY p_brand")
def entropy(spark, sf_dir):
    return balance.entropy(table(spark, sf_dir, "part"), "p_type", "p_brand").withColumn("entropy", F.round("entropy", 9))


# Balancing. Files: parts, a brand is a repository.

FILES = "f AS (SELECT p_brand AS repo, concat(p_name, '_', p_partkey, '.', substr(p_type, 1, 2)) AS path, (p_retailprice * 10)::BIGINT + p_size AS size, split_part(p_type, ' ', 1) AS lang, substr(p_type, 1, 2) AS suffix, p_size % 7 AS depth FROM part)"
PROFILE = "pr AS (SELECT f.repo, count(*) AS file_count, sum(size)::BIGINT AS bytes, count(DISTINCT lang) AS language_diversity, count(DISTINCT suffix) AS extension_diversity, stddev_pop(size) / avg(size) AS file_size_cv, list(depth ORDER BY depth)[round_even(0.9 * (count(*) - 1), 0)::INT + 1] AS path_depth_p90 FROM f GROUP BY f.repo), le AS (SELECT repo, -sum(p * log2(p)) AS language_entropy FROM (SELECT repo, n / sum(n) OVER (PARTITION BY repo)::DOUBLE AS p FROM (SELECT repo, lang, count(*) AS n FROM f GROUP BY ALL)) GROUP BY repo)"


def files(spark, sf_dir) -> DataFrame:
    kind = F.col("p_type")
    size = F.round(F.col("p_retailprice") * 10).cast("long") + F.col("p_size")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("repo"), F.concat("p_name", F.lit("_"), F.col("p_partkey").cast("string"), F.lit("."), F.substring(kind, 1, 2)).alias("path"), size.alias("size"), F.substring_index(kind, " ", 1).alias("lang"), F.substring(kind, 1, 2).alias("suffix"), (F.col("p_size") % 7).alias("depth"))


@query(f"WITH {FILES}, {PROFILE} SELECT repo, file_count, bytes, language_diversity, extension_diversity, round(file_size_cv, 9) AS file_size_cv, path_depth_p90, round(language_entropy, 9) AS language_entropy FROM pr JOIN le USING (repo)")
def repo_profile(spark, sf_dir):
    return balance.profile(files(spark, sf_dir)).select("repo", "file_count", "bytes", "language_diversity", "extension_diversity", F.round("file_size_cv", 9).alias("file_size_cv"), "path_depth_p90", F.round("language_entropy", 9).alias("language_entropy"))


Z = " + ".join(f"coalesce(({x} - avg({x}) OVER ()) / nullif(stddev_pop({x}) OVER (), 0), 0)" for x in ("lf", "lb", "language_diversity", "extension_diversity", "language_entropy", "path_depth_p90", "file_size_cv"))


@query(f"WITH {FILES}, {PROFILE}, q AS (SELECT *, ln(1 + file_count) AS lf, ln(1 + bytes) AS lb FROM pr JOIN le USING (repo)) SELECT repo, round({Z}, 6) AS score FROM q")
def complexity_scores(spark, sf_dir):
    return balance.complexity(balance.profile(files(spark, sf_dir))).select("repo", F.round("score", 6).alias("score"))


@query(f"WITH {FILES}, {PROFILE}, q AS (SELECT *, ln(1 + file_count) AS lf, ln(1 + bytes) AS lb FROM pr JOIN le USING (repo)), s AS (SELECT repo, {Z} AS score FROM q) SELECT repo, round(score, 6) AS score FROM s ORDER BY s.score DESC, repo DESC LIMIT 1")
def complexity_argmax(spark, sf_dir):
    return balance.most_complex(balance.profile(files(spark, sf_dir))).select("repo", F.round("score", 6).alias("score"))


BALANCED = """m AS (SELECT min(c) AS tf FROM (SELECT count(*) AS c FROM f GROUP BY repo)), tg AS (SELECT any_value(tf) AS tf, round_even(quantile_cont(b, 0.5), 0)::BIGINT AS tb FROM (SELECT sum(size)::DOUBLE / count(*) * any_value(tf) AS b, any_value(tf) AS tf FROM f CROSS JOIN m GROUP BY repo)),
rk AS (SELECT f.*, row_number() OVER (PARTITION BY repo ORDER BY abs(size - tb::DOUBLE / tf), sha256(path)) AS place, count(*) OVER (PARTITION BY repo) AS n, tf, tb FROM f CROSS JOIN tg), ch AS (SELECT *, place <= tf AS chosen, sum(CASE WHEN place <= tf THEN size END) OVER (PARTITION BY repo) AS now FROM rk),
sw AS (SELECT a.repo, arg_min({'o': a.path, 'i': b.path}, (abs(a.now - a.size + b.size - a.tb), a.place, b.size, b.path)) AS s FROM ch a JOIN ch b ON a.repo = b.repo AND a.chosen AND NOT b.chosen WHERE abs(a.now - a.size + b.size - a.tb) < abs(a.now - a.tb) GROUP BY a.repo),
bs AS (SELECT ch.repo, ch.path, ch.size, ch.tb FROM ch LEFT JOIN sw ON sw.repo = ch.repo WHERE n <= tf OR (chosen AND coalesce(ch.path <> s.o, TRUE)) OR coalesce(ch.path = s.i, FALSE))"""


@query(f"WITH {FILES}, {BALANCED} SELECT repo, count(*) AS n, sum(size)::BIGINT AS bytes FROM bs GROUP BY repo")
def balanced_sample(spark, sf_dir):
    return balance.prepare(files(spark, sf_dir))[1].groupBy("repo").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query(f"WITH {FILES}, {BALANCED}, p AS (SELECT repo, count(*)::DOUBLE AS files, sum(size)::DOUBLE AS bytes, any_value(tb) AS tb FROM bs GROUP BY repo) SELECT min(bytes) AS bytes_min, max(bytes) AS bytes_max, round(stddev_pop(bytes) / avg(bytes), 9) AS bytes_cv, round(max(abs(bytes - tb) / tb), 9) AS max_deviation FROM p")
def fairness(spark, sf_dir):
    return balance.prepare(files(spark, sf_dir))[2].select("bytes_min", "bytes_max", F.round("bytes_cv", 9).alias("bytes_cv"), F.round("max_deviation", 9).alias("max_deviation"))


BATCH = f"""WITH {DOCS}, t AS (SELECT doc_id, path, {_tokens("text")} AS toks FROM d), st AS (SELECT count(*)::DOUBLE AS n, avg(len(toks)) AS avgdl FROM t), x AS (SELECT doc_id, unnest(toks) AS term FROM t), p AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM x GROUP BY ALL), f AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY 1),
w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+|[0-9]+')[1:3] AS q FROM benchmark), h AS (SELECT item_id, q, CASE WHEN len(q) < 2 THEN len(q) ELSE greatest(1, floor(len(q) * 0.5)::INT) END AS k FROM w), a AS (SELECT item_id, k, len(q) AS nq, unnest(q) AS term, unnest(generate_series(1, len(q))) AS pos FROM h),
s AS (SELECT a.item_id, p.doc_id, k, nq, pos, ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(toks) / avgdl))) * CASE WHEN pos <= k THEN 1 ELSE 0.5::DOUBLE END AS s FROM a JOIN p USING (term) JOIN f USING (term) JOIN t ON t.doc_id = p.doc_id CROSS JOIN st),
g AS (SELECT item_id, doc_id, trunc(least(1000, sum(s ORDER BY pos) * 100))::INT AS score FROM s GROUP BY item_id, doc_id, k, nq HAVING sum((pos <= k)::INT) = k AND sum((pos > k)::INT) >= (nq > k)::INT),
rk AS (SELECT item_id AS task_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, path, score FROM g JOIN t USING (doc_id))"""


def _batch(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    tasks = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("task_id"), F.array("text").alias("must"))
    lengths = I.measured(docs).select("doc_id", "path", "doc_length")
    posts = docs.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    return lengths, posts, tasks


@query(f"{BATCH} SELECT task_id, rank, doc_id, path, score FROM rk WHERE rank <= 10")
def batch_search(spark, sf_dir):
    lengths, posts, tasks = _batch(spark, sf_dir)
    return evaluate.batch_search(lengths, posts, evaluate.relaxed_tasks(tasks), 10).withColumn("rank", F.col("rank").cast("long"))


@query(f"{BATCH}, e AS (SELECT item_id, min(rank) AS rank FROM (SELECT item_id, concat('doc_', item_id % 10) AS gold FROM benchmark) b LEFT JOIN rk ON rk.task_id = b.item_id AND rank <= 10 AND contains(path, gold) GROUP BY item_id) SELECT count(*) AS total, sum((rank IS NOT NULL)::INT)::BIGINT AS found, round(avg((rank IS NOT NULL)::INT), 9) AS recall, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 9) AS mrr FROM e")
def evaluate_taskset(spark, sf_dir):
    lengths, posts, tasks = _batch(spark, sf_dir)
    gold = tasks.withColumn("gold_file", F.concat(F.lit("doc_"), (F.col("task_id") % 10).cast("string")))
    out = evaluate.summary(evaluate.evaluate_tasks(lengths, posts, gold))
    return out.withColumns({c: F.round(c, 9) for c in ("recall", "mrr")})


# Comparisons, relaxation, grids, fits.

RUNS = "r AS (SELECT event_id AS task_id, event_type AS tool, user_id % 3 <> 0 AS found, CASE WHEN user_id % 3 <> 0 THEN 1.0::DOUBLE / (user_id % 5 + 1) ELSE 0.0 END AS rr, value AS latency_ms, user_id % 1000 AS stdout_bytes FROM events)"


def runs(spark, sf_dir) -> DataFrame:
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("task_id"), F.col("event_type").alias("tool"), (u % 3 != 0).alias("found"), F.when(u % 3 != 0, F.lit(1.0) / (u % 5 + 1)).otherwise(0.0).alias("rr"), F.col("value").alias("latency_ms"), (u % 1000).alias("stdout_bytes"))


@query(f"WITH {RUNS} SELECT tool, count(*) AS total, round(avg(found::INT), 9) AS recall, round(avg(rr), 9) AS mrr, round(avg(latency_ms), 6) AS avg_latency_ms, sum(stdout_bytes)::BIGINT AS stdout_bytes FROM r GROUP BY tool")
def compare_tools(spark, sf_dir):
    return evaluate.compare_tools(runs(spark, sf_dir)).withColumns({"recall": F.round("recall", 9), "mrr": F.round("mrr", 9), "avg_latency_ms": F.round("avg_latency_ms", 6)})


@query(f"WITH {RUNS} SELECT round(sum((tool = 'click' AND found)::INT) / count(DISTINCT task_id)::DOUBLE, 9) AS recall, round(sum(CASE WHEN tool = 'click' THEN rr ELSE 0 END) / count(DISTINCT task_id), 9) AS mrr, round(sum(CASE WHEN tool = 'click' THEN latency_ms ELSE 0 END) / count(DISTINCT task_id), 6) AS mean_latency_ms, round(sum(CASE WHEN tool = 'click' THEN stdout_bytes ELSE 0 END) / count(DISTINCT task_id)::DOUBLE, 6) AS mean_stdout_bytes FROM r")
def own_tool_metrics(spark, sf_dir):
    return evaluate.own_metrics(runs(spark, sf_dir), "click").select(F.round("recall", 9).alias("recall"), F.round("mrr", 9).alias("mrr"), F.round("mean_latency_ms", 6).alias("mean_latency_ms"), F.round("mean_stdout_bytes", 6).alias("mean_stdout_bytes"))


@query(f"WITH {RUNS}, a AS (SELECT tool AS metric, avg(latency_ms) AS x FROM r GROUP BY 1), b AS (SELECT tool AS metric, avg(latency_ms) AS y FROM r WHERE found GROUP BY 1) SELECT metric, round(abs(x - y), 6) AS abs_diff, round(abs(x - y) / abs(x), 6) AS rel_diff, abs(x - y) <= 0.01 OR abs(x - y) / abs(x) <= 0.3 AS passed FROM a JOIN b USING (metric)")
def tolerance_check(spark, sf_dir):
    mean = lambda d: d.groupBy(F.col("tool").alias("metric")).agg(F.avg("latency_ms").alias("value"))
    rows, tools = runs(spark, sf_dir), ("click", "view", "purchase", "signup", "search", "login", "logout", "error", "scroll", "cart")
    out = evaluate.within_tolerance(mean(rows), mean(rows.where("found")), dict.fromkeys(tools, 0.01), dict.fromkeys(tools, 0.3))
    return out.select("metric", F.round("abs_diff", 6).alias("abs_diff"), F.round("rel_diff", 6).alias("rel_diff"), "passed")


@query("WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+|[0-9]+')[1:4] AS t FROM benchmark), s AS (SELECT *, CASE WHEN len(t) < 2 THEN len(t) ELSE greatest(1, floor(len(t) * 0.5)::INT) END AS k FROM w) SELECT item_id, array_to_string(t[1:k], ' ') AS must, array_to_string(t[k + 1:], ' ') AS should, (len(t) > k)::INT AS min_match FROM s")
def relaxation(spark, sf_dir):
    must, should, need = evaluate.relaxed_columns(T.plain_terms(F.array("text")), 0.5, 4)
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(must, " ").alias("must"), F.array_join(should, " ").alias("should"), need.alias("min_match"))


GRID = ((0, 0.8, 0.3, 0.5, 3), (1, 1.2, 0.75, 0.5, 3), (2, 1.2, 0.9, 0.0, 2), (3, 2.0, 0.75, 0.75, 4))


@query(f"""WITH fe AS (SELECT l_orderkey % 400 AS task_id, l_suppkey AS doc_id, l_linenumber AS term_no, sum(l_quantity)::DOUBLE AS tf, 30.0::DOUBLE AS df FROM lineitem GROUP BY ALL), c AS (SELECT unnest({[g[0] for g in GRID]}) AS cfg, unnest({[g[1] for g in GRID]})::DOUBLE AS k1, unnest({[g[2] for g in GRID]})::DOUBLE AS b, unnest({[g[3] for g in GRID]})::DOUBLE AS r, unnest({[g[4] for g in GRID]}) AS mt),
p AS (SELECT cfg, task_id, doc_id, term_no, least(7, mt) AS nt, CASE WHEN least(7, mt) < 2 THEN least(7, mt) ELSE greatest(1, floor(least(7, mt) * (1 - r))::INT) END AS h, ln((500 - df + 0.5) / (df + 0.5) + 1) * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * (100 + doc_id % 50) / 120.0::DOUBLE))) AS s FROM fe CROSS JOIN c WHERE term_no <= mt),
k AS (SELECT cfg, task_id, doc_id, least(1000, floor(100 * sum(CASE WHEN term_no <= h THEN s ELSE s * 0.5::DOUBLE END)))::INT AS points FROM p GROUP BY cfg, task_id, doc_id, h, nt HAVING sum((term_no <= h)::INT) = h AND sum((term_no > h)::INT) >= (nt > h)::INT),
g AS (SELECT cfg, task_id, doc_id AS gd, points AS gp FROM k WHERE doc_id = task_id % 20 + 1), a AS (SELECT k.cfg, k.task_id, sum((points > gp OR (points = gp AND doc_id < gd))::INT) + 1 AS rank FROM k JOIN g ON k.cfg = g.cfg AND k.task_id = g.task_id GROUP BY ALL)
SELECT cfg, count(*) AS found, sum(rank)::BIGINT AS ranks FROM a WHERE rank <= 10 GROUP BY cfg""")
def grid_search(spark, sf_dir):
    fe = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 400).alias("task_id"), F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("term_no")).agg(F.sum("l_quantity").cast("double").alias("tf"))
    fe = fe.withColumns({"df": F.lit(30.0), "doc_length": (100 + F.col("doc_id") % 50).cast("double"), "n": F.lit(500.0), "avg": F.lit(120.0), "n_terms": F.lit(7)})
    tasks = fe.select("task_id").distinct().withColumn("gold_doc", F.col("task_id") % 20 + 1)
    configs = spark.createDataFrame(GRID, "cfg int, k1 double, b double, min_match_ratio double, max_terms int")
    return evaluate.grid_scores(fe, tasks, configs).groupBy("cfg").agg(F.count("*").alias("found"), F.sum("rank").cast("long").alias("ranks"))


SAMPLES = "s AS (SELECT concat('r', doc_id % 5) AS repo, lang, n_chars / 100000.0::DOUBLE AS base, (doc_id % 11) / 10.0::DOUBLE AS evidence, quality AS label FROM documents JOIN labels USING (doc_id))"


def samples(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return d.select(F.concat(F.lit("r"), (F.col("doc_id") % 5).cast("string")).alias("repo"), "lang", (F.col("n_chars") / F.lit(100000.0)).alias("base"), ((F.col("doc_id") % 11) / F.lit(10.0)).alias("evidence"), "label")


FIT = "n AS (SELECT count(*)::DOUBLE AS n FROM s), x AS (SELECT base, evidence, CASE WHEN lang = 'en' THEN evidence ELSE 0 END AS en, label, count(*)::DOUBLE AS m FROM s GROUP BY ALL), it AS (SELECT 0 AS step, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS w3, 1.0::DOUBLE AS moved UNION ALL SELECT step + 1, w0 - u0, w1 - u1, w2 - u2, w3 - u3, greatest(abs(u0), abs(u1), abs(u2), abs(u3)) FROM (SELECT step, w0, w1, w2, w3, r * g0 / n AS u0, r * (g1 + 3 * w1) / n AS u1, r * (g2 + 3 * w2) / n AS u2, r * (g3 + 3 * w3) / n AS u3 FROM (SELECT step, w0, w1, w2, w3, n, 0.4::DOUBLE / (1 + 0.01::DOUBLE * step) AS r, sum(e) AS g0, sum(e * base) AS g1, sum(e * evidence) AS g2, sum(e * en) AS g3 FROM (SELECT it.*, x.base, x.evidence, x.en, n.n, m * (1 / (1 + exp(-greatest(-35, least(35, w0 + w1 * base + w2 * evidence + w3 * en)))) - label) AS e FROM it CROSS JOIN x CROSS JOIN n WHERE step < 2000 AND moved >= 1e-7) GROUP BY ALL)))"


@query(f"WITH RECURSIVE {SAMPLES}, {FIT}, z AS (SELECT * FROM it ORDER BY step DESC LIMIT 1) SELECT position::INT AS position, round(weight, 6) AS weight FROM (SELECT unnest([0, 1, 2, 3]) AS position, unnest([w0, w1, w2, w3]) AS weight FROM z)")
def logistic_fit(spark, sf_dir):
    rows = fit.feature_rows(samples(spark, sf_dir), ["en"])
    w = fit.fit_gradient(rows, 4, 3.0)
    return spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(w)], "position int, weight double")


@query(f"WITH {SAMPLES}, p AS (SELECT repo, label, 1 / (1 + exp(-(0.4 + 1.5 * base - 0.8 * evidence))) AS p FROM s) SELECT repo, round(-avg(label * ln(greatest(1e-12, least(1 - 1e-12, p))) + (1 - label) * ln(1 - greatest(1e-12, least(1 - 1e-12, p)))), 9) AS loss FROM p GROUP BY repo")
def logloss(spark, sf_dir):
    rows = fit.feature_rows(samples(spark, sf_dir), [])
    return rows.groupBy("repo").agg(F.round(fit.log_loss(fit.probability([0.4, 1.5, -0.8])), 9).alias("loss"))


@query(f"WITH {SAMPLES}, l AS (SELECT lang, sum(label)::BIGINT AS n_positive, avg(evidence) AS raw FROM s GROUP BY lang), k AS (SELECT median(n_positive::DOUBLE) AS k FROM l) SELECT lang, n_positive, round(n_positive / (n_positive + k), 9) AS alpha, round(n_positive / (n_positive + k) * raw + (1 - n_positive / (n_positive + k)) * 0.2, 9) AS weight FROM l CROSS JOIN k")
def shrinkage(spark, sf_dir):
    per = samples(spark, sf_dir).groupBy("lang").agg(F.sum("label").alias("n_positive"), F.avg("evidence").alias("raw")).withColumn("global_weight", F.lit(0.2))
    return fit.shrunk(per).withColumns({"alpha": F.round("alpha", 9), "weight": F.round("weight", 9)})


# Checks.


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1")
def dup_check(spark, sf_dir):
    return contracts.duplicates(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def contract_dangling(spark, sf_dir):
    return contracts.dangling(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", table(spark, sf_dir, "labels"), "doc_id")


@query("WITH s AS (SELECT o_custkey AS plan, (o_orderkey % 50)::VARCHAR AS id, o_orderkey % 40 AS ord, (o_orderkey % 30)::VARCHAR AS dep FROM orders) SELECT rule, count(*) AS n FROM (SELECT 'unknown dependency' AS rule FROM s LEFT JOIN s t ON t.plan = s.plan AND t.id = s.dep WHERE t.id IS NULL UNION ALL SELECT 'dependency order' FROM s JOIN s t ON t.plan = s.plan AND t.id = s.dep WHERE t.ord >= s.ord UNION ALL SELECT 'order' FROM (SELECT ord, row_number() OVER (PARTITION BY plan ORDER BY ord, id) AS w FROM s) WHERE ord <> w) GROUP BY rule")
def contract_violations(spark, sf_dir):
    """All orders; each customer's are a plan."""
    key = lambda n: (F.col("o_orderkey") % n).cast("string")
    steps = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plan"), key(50).alias("id"), (F.col("o_orderkey") % 40).alias("order"), F.array(key(30)).alias("dependencies"))
    return contracts.plan_violations(steps, ("plan",)).groupBy("rule").agg(F.count("*").alias("n"))


@query("WITH g AS (SELECT concat('repo', p_partkey % 6) AS repo, concat(p_brand, '/', p_size, '.rs') AS gold_file FROM part), d AS (SELECT DISTINCT concat('repo', p_partkey % 5) AS repo, concat(p_brand, '/', p_size, '.rs') AS gold_file FROM part WHERE p_size <= 25) SELECT g.repo, count(*) AS tasks, sum((d.repo IS NULL)::INT)::BIGINT AS missing, bool_or(g.repo IN (SELECT repo FROM d)) AS indexed FROM g LEFT JOIN d ON g.repo = d.repo AND g.gold_file = d.gold_file GROUP BY g.repo")
def gold_coverage(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    name = F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string"), F.lit(".rs"))
    repo = lambda n: F.concat(F.lit("repo"), (F.col("p_partkey") % n).cast("string"))
    return evaluate.gold_coverage(part.select(repo(6).alias("repo"), name.alias("gold_file")), part.where("p_size <= 25").select(repo(5).alias("repo"), name.alias("path")))


@query(f"WITH {DOCS}, t AS (SELECT l.doc_id AS task_id, upper(concat(d.source, '/doc_', l.doc_id, '.', d.lang)) AS gold_file, left(trim(d.text), 60) || CASE WHEN l.doc_id % 3 = 0 THEN ' zzz' ELSE '' END AS anchor FROM labels l JOIN documents d USING (doc_id)) SELECT task_id, d.text IS NOT NULL AS file_found, coalesce(contains(d.text, anchor), FALSE) AS anchor_found, coalesce(contains(d.text, array_to_string(regexp_split_to_array(trim(anchor, ' '), '\\s+')[1:5], ' ')), FALSE) AS partial FROM t LEFT JOIN d ON lower(d.path) = lower(t.gold_file)")
def anchor_verify(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    some = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    tasks = some.select(F.col("doc_id").alias("task_id"), F.upper("path").alias("gold_file"), F.concat(F.left(F.trim("text"), F.lit(60)), F.when(F.col("doc_id") % 3 == 0, " zzz").otherwise("")).alias("anchor"))
    return evaluate.anchor_check(tasks, docs)


@query("SELECT 'union' AS op, count(*) AS n FROM (SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer) UNION ALL SELECT 'intersect', count(*) FROM (SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer) UNION ALL SELECT 'except', count(*) FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT c_nationkey FROM customer)")
def set_ops(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    count = lambda d, op: d.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return count(s.union(c).distinct(), "union").unionByName(count(s.intersect(c), "intersect")).unionByName(count(n.exceptAll(c.distinct()), "except"))


from lexgrain.plans import contract as _contract  # noqa: E402, F401  registers its queries here too
