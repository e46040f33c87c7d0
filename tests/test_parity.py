"""Behaviours of sources, tokens, clauses and the command line that plain Python says too."""

import json

import pytest
from pyspark.sql import functions as F

from lexgrain import cli
from lexgrain.functions import text as T
from lexgrain.operators import regions as R
from lexgrain.operators.index import Index
from lexgrain.operators.search import Query, Search, SymbolWeights
from lexgrain.sources import files as S


def test_blank_lines_are_those_that_strip_empties(spark):
    lines = ["", " \t", " ", "　 ", "\x1c\x1d\x1e\x1f", "\x85", "​", "x", " x", "     "]
    row = spark.createDataFrame([(lines,)], "l array<string>").select(R.full_lines(F.col("l")).alias("f")).first()
    assert row.f == [bool(x.strip()) for x in lines]


def test_broken_bytes_go_and_genuine_marks_stay(spark, tmp_path):
    (tmp_path / "a.py").write_bytes("x � y".encode())
    (tmp_path / "b.py").write_bytes(b"x \xff\xfe y \xef\xbf\xbd \xe2\x82")
    (tmp_path / "c.py").write_bytes(b"")
    got = {r.path: r.content for r in S.read_tree(spark, str(tmp_path)).collect()}
    assert got == {"a.py": "x � y", "b.py": "x  y � ", "c.py": ""}


def test_braces(spark):
    for s in ("{\n{}\n}\n", "}{{\n\n}", "a\n\n{x}\n{\n{\n}\n}\n}{", ""):
        out, stack, line = [], [], 1
        for ch in s:
            line += ch == "\n"
            if ch == "{":
                stack.append(line)
            elif ch == "}" and stack:
                out.append((stack.pop(), line))
        assert [(x["start"], x["end"]) for x in R.brace_regions(s)] == sorted(out)


def test_places_of_tokens(spark):
    rows = spark.createDataFrame([("parseHTTP x\n é9a HTTP2 _b",), (None,), ("",)], "s string").select(T.placed_tokens(F.col("s")).alias("t")).collect()
    assert [(x.text, x.pos) for x in rows[0].t] == [("parse", 0), ("http", 0), ("x", 10), ("9a", 14), ("http2", 17), ("b", 24)]
    assert rows[1].t is None and rows[2].t == []


def test_places_of_tokens_keep_few_python_objects(spark, monkeypatch):
    """A batch of long texts goes into Arrow's buffers bit by bit; objects of all its tokens came to gigabytes."""
    import tracemalloc

    import pyarrow as pa

    texts = ["parseHTTP X9 _b " * 20_000, None, "", "é a"] * 3
    tracemalloc.start()
    out = T._place_batch(pa.array(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out.flatten()) == 3 * (4 * 20_000 + 1) and peak < 60 * T.PLACE_TOKENS * 4
    monkeypatch.setattr(T, "PLACE_TOKENS", 7)
    assert T._place_batch(pa.array(texts)).equals(out) and T._place_batch(pa.array([], pa.string())).to_pylist() == []
    assert out[0].as_py()[-2:] == [{"text": "x9", "pos": 16 * 19_999 + 10}, {"text": "b", "pos": 16 * 19_999 + 14}]
    assert [out[i].as_py() for i in (1, 2, 3)] == [None, [], [{"text": "a", "pos": 2}]]


@pytest.fixture
def files(spark):
    return [("a.py", "def parse_args():\n    alpha beta\n", "python"), ("b.py", "alpha\n\n\nbeta parse args\n", "python"), ("c.md", "alpha beta", "markdown")]


def test_malformed_near_clauses_are_dropped(spark, files):
    ix = Index.build(spark.createDataFrame(files, "path string, content string, lang string"))
    count = lambda near: Search.indexed(ix, Query.of(must=["alpha"], near=near)).scored().count()
    assert count([{"terms": ["alpha", "beta"], "window": 0}]) == 3
    assert count([{"terms": ["alpha", "beta"], "scope": "line_window"}]) == 3
    assert count([{"terms": ["alpha", "beta"], "scope": "line_window", "window": 0}]) == 2


def test_saved_index_knows_its_totals(spark, files, tmp_path):
    ix = Index.build(spark.createDataFrame(files, "path string, content string, lang string"))
    ix.save(str(tmp_path / "ix"))
    again = Index.load(spark, str(tmp_path / "ix"))
    assert again.known == {"n": 3, "avg": ix.totals()[1], "fingerprint": ix.fingerprint()}


def test_command_line_takes_weights_and_near(spark, files, tmp_path, capsys, monkeypatch):
    class Known:  # the session of the tests, which main() must not stop
        builder = type("B", (), {"appName": lambda self, _: self, "getOrCreate": lambda self: spark})()

    monkeypatch.setattr(cli, "SparkSession", Known)
    for name, text, _ in files:
        (tmp_path / "src").mkdir(exist_ok=True)
        (tmp_path / "src" / name).write_text(text)
    assert cli.main(["ix", "build", str(tmp_path / "src"), "-o", str(tmp_path / "ix")]) == 0
    SymbolWeights({"python": 3.0}).save(spark, str(tmp_path / "w.json"))
    assert cli.main(["q", str(tmp_path / "ix"), "--symbol", "parse_args", "--weights", str(tmp_path / "w.json"), "--near", "alpha,beta:line_window:0"]) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["p"] == ["a.py"] and out["r"][0]["s"] == 300
