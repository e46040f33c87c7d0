"""Queries that once read a part of their table, against plain versions over all of it."""

import ast

from conftest import SF

from lexgrain.operators import contracts
from lexgrain.plans import catalogue


def test_python_regions_read_whole_texts(spark, tmp_path):
    texts = {1: "x" * 50, 2: "x" * 50 + "\nit's\r\n\n \nback\\\\slash\\ \0 'end", 3: "", 4: "\n".join(["é'\"\"\"{"] * 40)}
    spark.createDataFrame([(i, t, "en", "s") for i, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_blocks, r.n_symbols, r.parsed) for r in catalogue.python_regions(spark, str(tmp_path)).collect()}
    for i, t in texts.items():
        source = "class A:\n    pass\n" + "".join(f"    def f(self):\n        return {x!r}\n" for x in t.split("\n") if x.strip()) + "if A:\n    pass\n"
        kinds = [type(n) for n in ast.walk(ast.parse(source))]
        symbols = sum(k in (ast.FunctionDef, ast.ClassDef) for k in kinds)
        assert got[i] == (symbols + kinds.count(ast.If), symbols, True)


def test_set_ops_read_all_customers(spark):
    keys = lambda t, c: {r[0] for r in spark.read.parquet(f"{SF}/{t}.parquet").select(c).collect()}
    s, c, n = keys("supplier", "s_nationkey"), keys("customer", "c_nationkey"), keys("nation", "n_nationkey")
    assert {r.op: r.n for r in catalogue.set_ops(spark, SF).collect()} == {"union": len(s | c), "intersect": len(s & c), "except": len(n - c)}


def test_plans_are_checked_apart(spark):
    steps = spark.createDataFrame([(p, i, o, d) for p in (1, 2) for i, o, d in (("a", 1, []), ("b", 2, ["a"]))] + [(3, "c", 1, ["a"])], "plan int, id string, order int, dependencies array<string>")
    assert [(r.plan, r.rule, r.detail) for r in contracts.plan_violations(steps, ("plan",)).collect()] == [(3, "unknown dependency", "c")]
