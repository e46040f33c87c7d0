import json
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexgrain.operators import balance, contracts, evaluate, fit
from lexgrain.operators.index import Index
from lexgrain.sources import files as S
from lexgrain.streaming import incremental


def test_ranks_and_summaries(spark):
    results = spark.createDataFrame([("t1", 1, "src/a.rs"), ("t1", 2, "src/b.rs"), ("t2", 3, "x/b.rs"), ("t3", 1, "z")], "task_id string, rank int, path string")
    tasks = spark.createDataFrame([("t1", "b.rs", "easy", "r", 1.0), ("t2", "b.rs", "hard", "r", 3.0), ("t3", "", "easy", "s", 2.0)], "task_id string, gold_file string, difficulty string, repo string, latency_ms double")
    ranks = evaluate.gold_rank(results, tasks)
    assert {r.task_id: r.rank for r in ranks.collect()} == {"t1": 2, "t2": 3, "t3": None}
    o = evaluate.overall(ranks).first()
    assert (o.total, o.found) == (3, 2) and o.macro_mrr == pytest.approx((0.5 + 1 / 3) / 4) and o.micro_mrr == pytest.approx((0.5 + 1 / 3) / 3)
    assert evaluate.rollup_by(ranks, "repo", "difficulty").where("repo is null").first().recall == pytest.approx(2 / 3)
    assert evaluate.tool_calls(ranks).first().grep_calls == pytest.approx((3 + 4 + 6) / 3)


def test_distributions(spark):
    x = [1.0, 2.0, 2.0, 7.0, 9.0, 4.0]
    rows = spark.createDataFrame([(v,) for v in x], "v double")
    q = evaluate.quantiles(rows, "v").first()
    assert (q.p50, q.p95) == (pytest.approx(np.quantile(x, 0.5)), pytest.approx(np.quantile(x, 0.95)))
    for p in (0.0, 0.3, 0.5, 0.9, 1.0):
        assert balance.nearest_rank(rows, "v", p).first().value == sorted(x)[round(p * (len(x) - 1))]
    c = evaluate.confidence(rows, "v").first()
    assert c.std == pytest.approx(statistics.stdev(x)) and c.ci95 == pytest.approx(1.96 * statistics.stdev(x) / len(x) ** 0.5)
    assert evaluate.confidence(rows.limit(1), "v").first().std == 0.0
    empty = evaluate.quantiles(rows.limit(0), "v").first()
    assert (empty.n, empty.p95) == (0, 0.0)


def test_relaxation(spark):
    q = evaluate.relax(["Parse_HTTP2"], 0.5, 3)
    assert (q.must, q.should, q.min_match) == (("parse",), ("http", "2"), 1)
    assert evaluate.relax(["one"]).must == ("one",) and evaluate.relax_search_variant(["a b c"], 0.0, 3).must == ("a", "b", "c")
    row = spark.createDataFrame([(["parse", "http", "2"],)], "t array<string>").select(*[c.alias(n) for c, n in zip(evaluate.relaxed_columns(F.col("t"), 0.5, 3), "abc", strict=True)]).first()
    assert (row.a, row.b, row.c) == (["parse"], ["http", "2"], 1)
    assert len(evaluate.grid()) == 300 and len(evaluate.search_grid()) == 27 and set(evaluate.ablation_variants(["a", "b"], ["s"])) == {"bm25_only", "plus_symbol", "plus_near", "plus_prior"}


def brute_sample(entries, n, goal):
    import hashlib

    key = lambda e: hashlib.sha256(e[0].encode()).hexdigest()
    chosen = sorted(entries, key=lambda e: (abs(e[1] - goal / n), key(e)))[:n]
    rest = [e for e in entries if e not in chosen]
    now = sum(s for _, s in chosen)
    best = (abs(now - goal), None, None)
    for i, (_, s) in enumerate(chosen):
        for j, (_, r) in enumerate(rest):
            if abs(now - s + r - goal) < best[0]:
                best = (abs(now - s + r - goal), i, j)
    return best[0]


def test_balanced_sample_reaches_the_best_swap(spark):
    rng = np.random.default_rng(4)
    data = [("r", f"f{i}", int(rng.integers(1, 500)), "rust", ".rs", 1) for i in range(60)]
    rows = spark.createDataFrame(data, "repo string, path string, size long, lang string, suffix string, depth int")
    for n, goal in ((7, 1500), (10, 900), (3, 1400)):
        got = balance.balanced_sample(rows, n, goal).collect()
        assert len(got) == n and abs(sum(r.size for r in got) - goal) == brute_sample([(p, s) for _, p, s, *_ in data], n, goal)
    with pytest.raises(ValueError):
        balance.balanced_sample(rows, 0, 5)
    profiles, sample, fair = balance.prepare(rows.unionByName(rows.withColumn("repo", F.lit("s")).where("size < 300")))
    assert profiles.count() == 2 and fair.first().files_min == fair.first().files_max and balance.most_complex(profiles).count() == 1 and sample.count() > 0


def test_fit_agrees_with_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [("r%d" % (i % 3), "rust" if i % 2 else "go", float(rng.random()), float(rng.random()), int(rng.random() < 0.4)) for i in range(200)]
    df = spark.createDataFrame(rows, "repo string, lang string, base double, evidence double, label int")
    table = fit.feature_rows(df, ["go", "rust"])
    got = fit.fit_gradient(table, 5, 3.0, steps=50)
    x = np.array([[1, b, e, e * (lang == "go"), e * (lang == "rust")] for _, lang, b, e, _ in rows])
    y, w = np.array([r[4] for r in rows]), np.zeros(5)
    for step in range(50):
        g = x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y)
        g[1:] += 3.0 * w[1:] / len(y)
        w -= 0.4 / (1 + 0.01 * step) * g
    assert got == pytest.approx(w.tolist(), rel=1e-9)
    far = fit.fit_optimum(table, 5, 3.0)
    assert len(far) == 5
    best, losses = fit.choose_l2(table, 5, (0.1, 3.0))
    assert best in losses and set(fit.fit_weights(df, 3.0).by_lang) == {"go", "rust"}


def test_grep_coverage_anchors(spark):
    docs = spark.createDataFrame([("a.rs", "Foo\nbar foo\nx"), ("b.md", "nothing")], "path string, text string")
    assert [(r.path, r.line) for r in evaluate.grep(docs, ["foo", "zzz"]).orderBy("line").collect()] == [("a.rs", 1), ("a.rs", 2)]
    assert evaluate.grep(docs, ["f.o"], fixed=True).count() == 0 and evaluate.grep(docs, ["foo"], max_count=1).count() == 1 and evaluate.grep(docs, ["foo"], path_filter=r"\.md$").count() == 0
    tasks = spark.createDataFrame([("1", "A.RS", "bar foo"), ("2", "a.rs", "Foo bar foo x"), ("3", "no", "x")], "task_id string, gold_file string, anchor string")
    assert {r.task_id: (r.file_found, r.anchor_found) for r in evaluate.anchor_check(tasks, docs).collect()} == {"1": (True, True), "2": (True, False), "3": (False, False)}


def test_contracts(spark):
    good = {"id": "1", "repo": "r", "query_nl": "q", "query_dsl": {"must": ["a"], "k": 5}, "gold": {"kind": "file", "file": "f", "anchor": "a"}}
    lines = spark.createDataFrame([(1, json.dumps(good)), (2, ""), (3, "{oops"), (4, json.dumps({k: v for k, v in good.items() if k != "gold"}))], "line_no int, value string")
    assert {r.line_no: r.reason for r in contracts.malformed(lines).collect()} == {3: "malformed", 4: "missing gold"}
    steps = spark.createDataFrame([("a", 1, []), ("b", 2, ["c"]), ("c", 4, ["x"])], "id string, order int, dependencies array<string>")
    assert sorted((r.rule, r.detail) for r in contracts.plan_violations(steps).collect()) == [("dependency order", "b"), ("order", "c"), ("unknown dependency", "c")]
    tasks = spark.createDataFrame([("1", "r"), ("1", "q")], "id string, repo string")
    corpora = spark.createDataFrame([("r", "TBD")], "id string, commit string")
    assert sorted(r.rule for r in contracts.task_violations(tasks, corpora, 5).collect()) == ["duplicate task", "placeholder", "tasks", "unknown repo"]
    assert contracts.check_queries(spark, [{"must": [1]}]).count() == 1


def test_sources(spark, tmp_path):
    (tmp_path / "src/target").mkdir(parents=True)
    (tmp_path / "src/a.rs").write_bytes(b"fn main() {\n}\n\xff")
    (tmp_path / "src/readme.md").write_text("hello")
    (tmp_path / "src/target/b.rs").write_text("x")
    (tmp_path / "src/c.bin").write_bytes(b"x")
    tree = S.read_tree(spark, str(tmp_path))
    assert {(r.path, r.lang) for r in tree.collect()} == {("src/a.rs", "rust"), ("src/readme.md", "markdown"), ("src/target/b.rs", "rust")}
    assert [r.path for r in S.read_tree(spark, str(tmp_path), skip=True).collect()] == ["src/a.rs"]
    assert [(r.path, r.size, r.depth) for r in S.scan_code_files(spark, str(tmp_path)).collect()] == [("src/a.rs", 15, 1)]
    assert {r.status: r.n for r in S.scan_counts(spark, str(tmp_path)).collect()} == {"indexed": 1, "skipped": 3}
    ix = Index.build(tree)
    S.export_index(ix, str(tmp_path / "ix.json"))
    again = S.import_index(spark, str(tmp_path / "ix.json"))
    assert again.fingerprint() == ix.fingerprint() and again.postings.count() == ix.postings.count()
    (tmp_path / "m.json").write_text(json.dumps({"corpora": [{"id": "r"}, {"id": "q"}]}))
    corpora = S.read_manifest(spark, str(tmp_path / "none.json"), str(tmp_path / "m.json"))
    assert S.select_corpora(corpora, repos=["q"]).count() == 1 and corpora.count() == 2
    assert "| id |" in S.markdown_report("t", {"c": corpora.select("id")})


def test_streaming(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", None, "alpha beta"), (2, "b", None, "alpha")], "doc_id long, path string, lang string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    incremental.append_postings(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/postings")).count() == 3
    q = incremental.term_counts(stream).writeStream.format("memory").queryName("terms").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.term: (r.df, r.tf) for r in spark.table("terms").collect()} == {"alpha": (2, 2), "beta": (1, 1)}


def test_ablation_and_samples_from_an_index(spark):
    files = [(f"src/f{i}.py", f"def parse_args{i % 2}():\n    alpha beta\n" if i % 3 else "alpha parse args\n", "python") for i in range(9)]
    ix = Index.build(spark.createDataFrame(files, "path string, content string, lang string"))
    tasks = [{"id": "t1", "repo": "r", "must": ["alpha beta"], "symbol": ["parse_args"], "symbols": ["parse_args"], "gold_file": "f1.py"}, {"id": "t2", "repo": "s", "must": ["alpha"], "symbol": ["parse_args"], "symbols": [], "gold_file": "f0.py"}]
    out = {r.variant: r for r in evaluate.run_ablation(ix, tasks).collect()}
    assert set(out) == {"bm25_only", "plus_symbol", "plus_near", "plus_prior"} and out["bm25_only"].recall == 1.0 and out["bm25_only"].mrr_delta == 0.0
    rows = fit.collect_samples(ix, tasks).collect()
    assert {r.repo for r in rows} == {"r", "s"} and {r.evidence for r in rows} == {1.0} and sum(r.label for r in rows) == 2
    from lexgrain.sources import config

    c = config.derived(config.DEFAULT | {"repositories": [{"id": "fd"}]}, "/x/", True)
    assert config.repositories(spark, c).first().source == "/x/balanced/fd"


def brute_ranks(features, tasks, configs, top):
    """Each configuration by itself, in plain Python."""
    out = {}
    for c in configs:
        for task, goal in tasks:
            points = {}
            for doc in {f[1] for f in features if f[0] == task}:
                rows = sorted(f[2:] for f in features if f[:2] == (task, doc) and f[2] <= c["max_terms"])
                if not rows:
                    continue
                terms = min(rows[0][5], c["max_terms"])
                head = terms if terms < 2 else max(1, math.floor(terms * (1 - c["min_match_ratio"])))
                if sum(r[0] <= head for r in rows) != head or terms > head and not any(r[0] > head for r in rows):
                    continue
                parts = [(math.log((n - df + 0.5) / (df + 0.5) + 1) * (tf * (c["k1"] + 1) / (tf + c["k1"] * (1 - c["b"] + c["b"] * size / 120.0)))) * (1.0 if no <= head else 0.5) for no, tf, df, size, n, _ in rows if tf is not None]
                points[doc] = min(1000, math.floor(sum(parts) * 100)) if parts else 1000
            if goal in points and (rank := 1 + sum((-p, d) < (-points[goal], goal) for d, p in points.items())) <= top:
                out[c["cfg"], task] = rank
    return out


@pytest.mark.parametrize("name", ["grid", "search_grid"])
def test_grid_makes_no_row_for_a_configuration(spark, name):
    """Ranks as by brute force, with tasks of few terms, missing numbers and ties; and a plan in which the rows are those of the features."""
    rng = np.random.default_rng(5)
    features = [(t, d, no, None if rng.random() < 0.05 else float(rng.integers(1, 4)), float(3 + no), float(80 + d % 3 * 40), 60.0, n) for t, n in ((1, 7), (2, 3), (3, 1), (4, 5)) for d in range(40) for no in range(1, n + 1) if rng.random() < 0.8]
    full = lambda t: max(range(40), key=lambda d: sum(f[:2] == (t, d) for f in features))
    tasks, configs = [(1, full(1)), (2, full(2)), (3, full(3)), (4, 99)], getattr(evaluate, name)()
    fe = spark.createDataFrame(features, "task_id long, doc_id long, term_no int, tf double, df double, doc_length double, n double, n_terms int").withColumn("avg", F.lit(120.0))
    some = spark.createDataFrame([(c["cfg"], c["k1"], c["b"], float(c["min_match_ratio"]), c["max_terms"]) for c in configs], "cfg int, k1 double, b double, min_match_ratio double, max_terms int")
    ranks = evaluate.grid_scores(fe, spark.createDataFrame(tasks, "task_id long, gold_doc long"), some, 30)
    got = {(r.cfg, r.task_id): r["rank"] for r in ranks.collect()}
    assert got == brute_ranks(features, tasks, configs, 30) and len({t for _, t in got}) == 3
    assert "explode(" not in ranks._jdf.queryExecution().optimizedPlan().toString()
