import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lexgrain.operators import index as I
from lexgrain.operators import regions as R
from lexgrain.operators.output import BUDGET, format_results, run_query, to_dict, within_budget
from lexgrain.operators.search import Near, Query, Search, SymbolWeights, dsl_faults, result_rows, search, search_page


def build(spark, files, **kw):
    return I.Index.build(spark.createDataFrame([(p, c, lang) for p, c, lang in files], "path string, content string, lang string"), **kw)


def paths(index, weights=None, **q):
    return [r.path for r in search(index, Query.of(**q), weights=weights)]


def test_documents_of_a_term(spark):
    ix = build(spark, [("test.py", "def hello_world():\n    return hello", "python"), ("other.py", "def goodbye():\n    pass", "python")])
    assert paths(ix, must=["hello"]) == ["test.py"]
    assert {r.term: r.tf for r in ix.postings.where("term = 'hello'").collect()} == {"hello": 2}


def test_posting_lines_survive_save_and_load(spark, tmp_path):
    ix = build(spark, [("a.py", "alpha\nbeta alpha\nbeta", None)])
    ix.save(str(tmp_path / "ix"))
    again = I.Index.load(spark, str(tmp_path / "ix"))
    assert again.postings.where("term = 'alpha'").first().lines == [1, 2]
    assert again.fingerprint() == ix.fingerprint()


def test_python_regions(spark):
    ix = build(spark, [("a.py", "def first():\n    alpha\n\n\ndef second():\n    beta\n", "python")])
    d = ix.documents.first()
    assert [tuple(r) for r in d.symbol_regions] == [(1, 2), (5, 6)] and [tuple(r) for r in d.block_regions] == [(1, 2), (5, 6)]


@pytest.mark.parametrize(
    ("lang", "text", "block", "symbol"),
    [
        ("python", "def f(:\n\n  x", [(1, 1), (3, 3)], [(1, 1), (3, 3)]),
        ("rust", "fn a() {\n x { y }\n}\n}\nfn b() {\n", [(1, 3), (2, 2)], [(1, 4), (5, 6)]),
        ("rust", "pub fn a\n", [(1, 1)], [(1, 1)]),
        (None, "\n \n", [(1, 3)], [(1, 3)]),
        (None, "", [(1, 1)], [(1, 1)]),
        ("go", "Func x\n\n type y", [(1, 1), (3, 3)], [(1, 2), (3, 3)]),
    ],
)
def test_region_dispatch(spark, lang, text, block, symbol):
    d = build(spark, [("a", text, lang)]).documents.first()
    assert ([tuple(r) for r in d.block_regions], [tuple(r) for r in d.symbol_regions]) == (block, symbol)


def test_metadata_and_symbol(spark):
    ix = build(spark, [("src/main.py", "def parse_args():\n    pass", "python"), ("docs/readme.md", "parse args reference", "markdown")])
    assert paths(ix, symbol=["parse_args"], lang=["python"], ext=[".py"], path_prefix=["src/"]) == ["src/main.py"]
    heavy = SymbolWeights({"python": 100.0, "markdown": 1.0})
    assert paths(ix, heavy, symbol=["parse_args"])[0] == "src/main.py"
    low = search(ix, Query.of(symbol=["parse_args"]), weights=SymbolWeights({"python": -10.0, "markdown": -10.0}))
    assert low and all(r.score >= 0 for r in low)


NEAR = [Near(("alpha", "beta"), "line_window", 2)]


def test_near_line_window(spark):
    ix = build(spark, [("a.py", "alpha\nx\nbeta", None), ("b.py", "alpha\nx\nx\nx\nbeta", None)])
    assert paths(ix, near=NEAR) == ["a.py"]


def test_near_block_and_symbol(spark):
    ix = build(spark, [("same_block.py", "alpha\nbeta\n", "python"), ("two.py", "alpha\n\nbeta\n", "python")])
    assert paths(ix, near=[{"terms": ["alpha", "beta"], "scope": "block", "window": 10}]) == ["same_block.py"]
    ix = build(spark, [("same_symbol.py", "def f():\n    alpha\n    beta\n", "python"), ("two.py", "def f():\n    alpha\n\ndef g():\n    beta\n", "python")])
    assert paths(ix, near=[{"terms": ["alpha", "beta"], "scope": "symbol", "window": 10}]) == ["same_symbol.py"]
    assert paths(ix, near=[{"terms": ["alpha", "beta"], "scope": "galaxy", "window": 10}]) == []
    assert paths(ix, near=[{"terms": ["alpha"]}]) == []


def test_cursor(spark):
    ix = build(spark, [(f"f{i}.py", "alpha\n", None) for i in range(5)])
    q, sizes, cursor = Query.of(must=["alpha"]), [], None
    for _ in range(3):
        page = search_page(ix, q, max_results=2, cursor=cursor)
        sizes.append(len(page.results))
        cursor = page.cursor_after(len(page.results))
    assert sizes == [2, 2, 1] and cursor is None
    for bad in ("cur_invalid", "cur_2_deadbeef"):
        with pytest.raises(ValueError):
            search_page(ix, q, cursor=bad)
    a = search_page(ix, q, 2, weights=SymbolWeights({"python": 1.0}))
    with pytest.raises(ValueError):
        search_page(ix, q, 2, cursor=a.cursor_after(2), weights=SymbolWeights({"python": 2.0}))


def test_quirks(spark):
    ix = build(spark, [("a.md", "alpha beta", None), ("b.md", "gamma_ray", None)])
    assert paths(ix, exclude=["alpha"]) == []  # nothing to take away from
    assert paths(ix, exclude=["alpha"], ext=["md"]) == ["b.md"]
    assert paths(ix, must=["gamma_ray"]) == []  # terms are never split
    assert paths(ix, must=["nothing"], symbol=["alpha"]) == ["a.md"]  # the symbol stands in
    one, two = (search(ix, Query.of(must=m))[0].score for m in (["alpha"], ["alpha", "alpha"]))
    assert abs(two - 2 * one) <= 1
    assert paths(ix, should=["alpha", "alpha"], min_match=2) == ["a.md"]
    assert paths(ix) == []


def test_bm25_value(spark):
    ix = build(spark, [("a", "x x y", None), ("b", "x z", None), ("c", "z", None)])
    n, df, tf, dl, avg = 3, 2, 2, 3, 2.0
    want = math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg))
    assert Search.indexed(ix, Query.of(must=["x"])).scored().where("path = 'a'").first().raw == pytest.approx(want, rel=1e-12)


def test_scan_and_index_plans_agree(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "parse_args", "HTTPServer", "\n", "\n\n", "def f():\n"]
    files = [(f"p{i:02}.{rng.choice(['py', 'md'])}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 25))), rng.choice([None, "markdown"])) for i in range(40)]
    ix = build(spark, files)
    docs = I.prepared(spark.createDataFrame(files, "path string, content string, lang string"))
    for q in (Query.of(must=["alpha"], should=["beta", "gamma"], min_match=1), Query.of(should=["http"], exclude=["beta"]), Query.of(symbol=["parse_args"], ext=["py"]), Query.of(must=["alpha"], near=[{"terms": ["alpha", "beta", "gamma"], "scope": "block", "window": 1}])):
        a, b = ({(r.path, r.score) for r in s.scored().collect()} for s in (Search.indexed(ix, q), Search.scan(docs, q)))
        assert a == b


def test_near_against_brute_force(spark):
    rng = random.Random(9)
    files = [(f"f{i:03}", "\n".join(rng.choice(["a", "b", "c", "", "a b", "x"]) for _ in range(rng.randint(1, 9))), None) for i in range(60)]
    ix = build(spark, files)
    for scope, w in itertools.product(("line_window", "block"), (0, 1, 3)):
        want = []
        for p, text, _ in files:
            lines = text.split("\n")
            at = {t: [k for k, s in enumerate(lines, 1) if t in s.split()] for t in "abc"}
            block = {}
            for k, s in enumerate(lines, 1):
                block[k] = block.get(k - 1, k) if s.strip() and (k == 1 or lines[k - 2].strip()) else k
            if any(max(x) - min(x) <= w and (scope == "line_window" or len({block[k] for k in x}) == 1) for x in itertools.product(at["a"], at["b"], at["c"])):
                want.append(p)
        got = {r.path for r in Search.indexed(ix, Query.of(near=[Near(("a", "b", "c"), scope, w)])).scored().collect()}
        assert got == set(want)


def test_brace_regions_against_a_model():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("{}\nx") for _ in range(30))
        line, stack, want = 1, [], []
        for ch in text:
            line += ch == "\n"
            if ch == "{":
                stack.append(line)
            if ch == "}" and stack:
                want.append((stack.pop(), line))
        assert [(r["start"], r["end"]) for r in R.brace_regions(text)] == sorted(want)


def test_update_keeps_ids(spark):
    ix = build(spark, [("a", "x", None), ("b", "y", None), ("c", "z", None)])
    new = ix.updated(spark.createDataFrame([("a", "x", None), ("c", "zz", None), ("d", "w", None)], "path string, content string, lang string"))
    assert {r.path: r.doc_id for r in new.documents.collect()} == {"a": 0, "c": 3, "d": 4}
    assert {r.term for r in new.postings.collect()} == {"x", "zz", "w"}


def test_empty_corpus(spark):
    ix = build(spark, [])
    assert paths(ix, must=["x"]) == [] and ix.stats().first().avg_doc_length == 0.0


def rows(n, text="t"):
    return [{"path": p, "score": 5, "hits": [{"line": 1, "text": text, "score": 5}], "from_line": 1, "to_line": 1, "bound_start": 1, "bound_end": 1, "doc_handle": "doc_00000000", "span_handle": "span_00000000_001", "digest": "0" * 16, "next_spans": []} for p in (f"f{i}" for i in range(n))]


def test_output_budget_and_paths():
    out, fit = format_results(rows(2, "x" * 120), {"max_bytes": 560, "max_excerpt": 256})
    assert out["t"] and fit < 2 and out["lim"]["emitted_bytes"] <= 560
    a, b = rows(2)
    out, _ = format_results([a, a, b])
    assert out["p"] == ["f0", "f1"] and [r["pi"] for r in out["r"]] == [0, 0, 1]
    out, _ = format_results(rows(1), cursor="cur_2_deadbeef", more=True)
    assert out["cur"] == "cur_2_deadbeef" and out["t"]
    whole = to_dict([], False, None, BUDGET)
    emitted, whole["lim"]["emitted_bytes"] = whole["lim"]["emitted_bytes"], 0  # measured with a zero in its own place
    assert len(json.dumps(whole).encode()) == emitted


def test_byte_budget_as_a_plan(spark):
    ix = build(spark, [(f"dir{i % 3}/f{i}.py", "alpha\n" * (i + 1), "python") for i in range(12)])
    found = Search.indexed(ix, Query.of(must=["alpha"])).ranked(12)
    data = result_rows(found).collect()
    ranked = spark.createDataFrame([(k + 1, r.doc_id, r.path, r.score, r.bound_end, r.digest) for k, r in enumerate(data)], "rank int, doc_id long, path string, score int, line_count int, content_hash string")
    for most in (300, 900, 2000, 9000):
        assert within_budget(ranked, most, {"max_bytes": 8192}).count() == sum(to_dict(data[: k + 1], False, None, BUDGET)["lim"]["emitted_bytes"] <= most for k in range(len(data)))


def test_run_query(spark):
    ix = build(spark, [(f"f{i}.py", "alpha\n", None) for i in range(5)])
    first = run_query(ix, {"must": ["alpha"], "budget": {"max_results": 3}})
    second = run_query(ix, {"must": ["alpha"], "budget": {"max_results": 3}, "options": {"cursor": first["cur"]}})
    assert (len(first["r"]), first["t"], len(second["r"]), second["cur"], second["t"]) == (3, True, 2, None, False)
    with pytest.raises(ValueError):
        run_query(ix, {"must": ["alpha"], "budget": {"max_bytes": 100}})
    with pytest.raises(ValueError):
        run_query(ix, {"must": ["alpha"], "wat": 1}, strict=True)


def test_dsl_limits():
    assert dsl_faults({"must": ["a"] * 65}) and dsl_faults({"near": [{"terms": ["a"], "scope": "block", "window": 201}]}) and not dsl_faults({"must": ["a"], "near": [{"terms": ["a", "b"], "scope": "block", "window": 3}]})
    assert SymbolWeights.from_dict({"by_lang": {"c": "x"}}) == SymbolWeights.disabled()


@pytest.mark.parametrize("size", [3, 10, 50])
def test_all_pages_are_those_of_the_cursors_from_one_ranking(spark, monkeypatch, size):
    from conftest import SF

    from lexgrain.operators import search as module
    from lexgrain.plans import catalogue, contract

    index, q, none = catalogue.saved_index(spark, SF), Query.of(**contract.PAGED), SymbolWeights.disabled()
    rankings, indexed = [], Search.indexed
    monkeypatch.setattr(Search, "indexed", lambda *a, **kw: rankings.append(a) or indexed(*a, **kw))
    got = [tuple(r) for r in module.all_pages(index, q, size, weights=none).drop("path").orderBy("place").collect()]
    assert len(rankings) == 1 and [r[1] for r in got] == list(range(1, 21))
    pages = {page: [r for r in got if r[0] == page] for page in sorted({r[0] for r in got})}
    cursor = None
    for page in list(pages)[:3]:
        found = search_page(index, q, size, cursor=cursor, weights=none)
        cursor = found.cursor_after(len(found.results))
        assert pages[page] == [(page, found.start + k + 1, r["doc_id"], r["score"], cursor) for k, r in enumerate(found.results)]
    assert got[-1][4] is None


def test_cursor_pages_asks_once(spark, monkeypatch):
    from conftest import SF

    from lexgrain.plans import contract

    asked, indexed = [], Search.indexed
    monkeypatch.setattr(Search, "indexed", lambda *a, **kw: asked.append(a) or indexed(*a, **kw))
    assert contract.cursor_pages(spark, SF.replace("sf0.001", "sf0.01")).count() == 99 and len(asked) == 1
