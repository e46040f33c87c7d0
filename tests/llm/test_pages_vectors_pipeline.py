"""HTML extraction, embedding near-duplicates and the pipeline."""

import html as entities
import re

import numpy as np
import pytest
from llm.conftest import HARD, SF, words

import corpus_pipeline
from lexgrain.llm import components, embeddings, html_text, pieces, simhash
from lexgrain.llm.scratch import Scratch

PAGE = "page_id long, url string, html string"


def extract(spark, pages):
    df = spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(pages)], PAGE)
    return {r.page_id: r.text for r in html_text.main_text(df).collect()}


def test_pages_against_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_text.main_text(pages).collect()}
    for r in pages.collect():
        body = r.html.split("<article>")[1].split("</article>")[0]
        blocks = (" ".join(entities.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split("</?(?:p|h1)>", body))
        assert got[r.page_id].text == "\n".join(filter(None, blocks)) and got[r.page_id].n_chars == len(got[r.page_id].text)


LONG = "This is a sentence of the article that goes on for quite some time, as they do. "


def test_pages_of_other_shapes(spark):
    pages = [
        None,
        "",
        "<p>unclosed &amp; lonely",
        f'<html><body><div class="nav"><a href=x>Home</a></div><div id="main-content"><h1>Hello</h1><p>{LONG * 2}</p><p>Short.</p><div class="comments"><p>{LONG}</p></div></div><div class="cookie-notice"><p>{LONG}</p></div><footer><p>c</p></footer></body></html>',
        f"<article><header>By me</header><p>A&nbsp;b<aside>rel</aside><p>B<br>c<section class='reader-comments'><p>{LONG}</p></section><form><p>{LONG}</p></form></article>",
        f"<article><p>x<script>if (a < b) {{ '</p>' }}</script>y</p><!-- <p>no</p> --><style>p{{}}</style><ul><li>one<li>two</ul></article>",
        "<" * 500 + "div class='" + "x" * 5000,
        f"<main><p>{LONG}</p></main></div></p>" + "<div>" * 3000,
    ]
    got = extract(spark, pages)
    assert got[0] == got[1] == ""
    assert got[3] == f"Hello\n{(LONG * 2).strip()}\nShort."
    assert got[4] == "A b\nB c"
    assert got[5] == "x y\none\ntwo"
    assert got[7] == LONG.strip()


def test_no_pages(spark):
    assert extract(spark, []) == {}


def test_marginals_against_enumeration():
    """Sum-product on a small tree equals the sum over all labellings."""
    import itertools

    tree = html_text.Tree(html_text.fixed())
    nodes, _ = html_text.parse(f"<body><div><p>{LONG}</p></div><ul><li><a>x</a></li></ul></body>")
    tables = tree.tables(nodes)
    total, mass = 0.0, np.zeros((len(nodes), 3))
    for y in itertools.product((0, 1, 2), repeat=len(nodes) - 1):
        y = (2, *y)
        p = np.prod([tables[k][y[n.parent]][y[k]] for k, n in enumerate(nodes[1:], 1)])
        total += p
        for k in range(len(nodes)):
            mass[k, y[k]] += p
    assert np.allclose(tree.marginals(nodes), mass / total)


def test_unmarked_articles(spark):
    """Articles without a tag or a class of their own; a telling word inside a name tells nothing."""
    pages = [
        f"<body><p>{LONG}{LONG}</p><p>{LONG}</p></body>",
        f"<body><div><h1>T</h1><p>{LONG}{LONG}</p></div></body>",
        f'<div class="x">{LONG * 9}</div>',
        f'<article><div class="legal-form-guide"><p>{LONG}</p></div></article>',
        f"<article><p>{LONG}</p></article><div class='rail'><p>{LONG}</p></div>",
        f"<article><p>{LONG}</p><section class='reader-comments'>{f'<p>{LONG}</p>' * 60}</section></article>",
    ]
    one = LONG.strip()
    assert extract(spark, pages) == dict(enumerate([f"{one} {one}\n{one}", f"T\n{one} {one}", " ".join([one] * 9), one, one, one]))


def test_articles_with_their_mark_hidden(spark):
    """What the table's marked pages teach holds where the tag is hidden."""
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    plain = [p.replace("<article>", "<div>").replace("</article>", "</div>") for p in pages]
    got = extract(spark, pages + plain)
    assert all(got[k] == got[k + len(pages)] for k in range(len(pages)))


def test_markup_that_is_kept_and_dropped(spark):
    pages = [
        f'<p title="x>{LONG}</p>',
        "<article><p>a <math>x+y</math> <object>o</object><svg/>z<svg><text>no</text></svg> <b>c</p></article>",
        "<article><p>a<select>b</article>",
        "<article><p>a<select><option>b</select>c</article>",
        "<article><p>1 < 2 &lt; 3</p></article>",
    ]
    assert extract(spark, pages) == {0: LONG.strip(), 1: "a x+y o z c", 2: "a b", 3: "a c", 4: "1 < 2 < 3"}


@pytest.mark.parametrize("unit", ["<a ", "<a href='", "<div></p>", '<a ">" ', "<select>", "<!--", "<", "<svg>", "</p>", "<li><ul><div>", "<p title=\"x'>"])
def test_a_broken_megabyte_takes_linear_time(unit):
    import time

    tree, began = html_text.Tree(html_text.fixed()), time.time()
    tree.extract(unit * (1_000_000 // len(unit)))
    tree.extract("<ul>" + "<div>" * 50_000 + "<li></li>" * 50_000 + "</p>" * 50_000)
    assert time.time() - began < 10


def test_pages_rows_and_clashing_columns(spark):
    rows = [(1, "u", f"<p>{LONG}{LONG}</p>"), (1, "u", f"<p>{LONG}{LONG}</p>"), (None, None, f"<div>{LONG * 20_000}</div>"), (2, "v", None)]
    df = spark.createDataFrame(rows, PAGE)
    for name in ("text", "n_chars", "__html", "key", "n"):
        df = df.withColumn(name, html_text.F.lit("clash"))
    got = sorted((str(r.page_id), r.n_chars) for r in html_text.main_text(df).collect())
    assert got == [("1", 2 * len(LONG) - 1)] * 2 + [("2", 0), ("None", 20_000 * len(LONG) - 1)]


VECTOR = "vec_id long, embedding array<double>, label int"


def brute(rows, threshold=0.98):
    ok = {k: np.array(e, float) for k, (i, e, label) in enumerate(rows) if e and label is not None and i is not None and None not in e and np.isfinite(e).all() and any(e)}
    near = {k: [j for j in ok if j != k and rows[j][2] == rows[k][2] and len(ok[j]) == len(ok[k]) and ok[k] @ ok[j] / np.linalg.norm(ok[k]) / np.linalg.norm(ok[j]) >= threshold] for k in ok}
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((i, len(near.get(k, [])), least, i is not None and i == least))
    return sorted(out, key=str)


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for label in (0, 1, 2):
        base = rng.standard_normal((40, 16))
        for b in base:
            for _ in range(int(rng.integers(1, 5))):
                rows.append((n, (b + 0.07 * rng.standard_normal(16)).tolist(), label))
                n += 1
    dense = rng.standard_normal(16)
    rows += [(n + k, (dense + 0.05 * rng.standard_normal(16)).tolist(), 1) for k in range(200)]
    rows += [(5000 + k, dense.tolist(), 1) for k in range(30)] + [(5000, dense.tolist(), 1)]
    rows += [(6000, None, 1), (6001, [0.0] * 16, 1), (6002, [float("nan")] * 16, 1), (6003, [None] + [1.0] * 15, 1), (6004, dense.tolist(), None), (None, dense.tolist(), 1), (6005, [], 1), (6006, [1.0, 2.0], 1), (6007, [2.0, 4.0], 1), (6008, [float("inf")] * 16, 1), (6009, (-0.0 * dense).tolist(), 1)]
    df = spark.createDataFrame(rows, VECTOR).repartition(3)
    got = sorted((tuple(r) for r in embeddings.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)


def test_embedding_recall_on_fifty_thousand(spark):
    """Links found of those that brute force finds, in groups of all sizes and at all similarities about the threshold."""
    rng, d, n = np.random.default_rng(11), 32, 50_000
    label = rng.integers(0, 5, n)
    x = rng.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at = 0
    for size in [2] * 4000 + [3] * 1500 + [8] * 300 + [60] * 30 + [1500]:
        seed = rng.standard_normal(d)
        spread = rng.uniform(0.01, 0.16) / np.sqrt(d)
        x[at : at + size] = seed / np.linalg.norm(seed) + spread * rng.standard_normal((size, d))
        label[at : at + size] = label[at]
        at += size
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, e, int(k)) for i, (e, k) in enumerate(zip(x.tolist(), label, strict=True))], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df.withColumn("blob", embeddings.F.lit("clash")).withColumn("rep", embeddings.F.lit(0))).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = 0
    for k in range(5):
        ids = np.flatnonzero(label == k)
        for p in range(0, len(ids), 1000):
            links = (u[ids[p : p + 1000]] @ u[ids].T >= 0.98).sum(axis=1) - 1
            want += int(links.sum())
            assert (np.array([got[int(i)] for i in ids[p : p + 1000]]) <= links).all()
    assert len(got) == n and sum(got.values()) >= 0.99 * want > 100_000


def test_windows_go_on_across_tasks(spark):
    """Sixty-four partitions of few rows: neighbours in order meet, whichever tasks hold them."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal(16)
    rows = [(k, (base + 0.0005 * k * rng.standard_normal(16)).tolist(), 1) for k in range(120)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = sorted((tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame(rows, VECTOR), passes=1).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute(rows)


def test_embedding_labels_and_emptiness(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], VECTOR)).collect() == []
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 2), (3, [1.0, 0.1], 1)]
    assert sorted(map(tuple, embeddings.near_duplicates(spark.createDataFrame(rows, VECTOR)).collect())) == [(1, 1, 1, True), (2, 0, 2, True), (3, 1, 1, False)]


def test_components(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(k, k + 1) for k in range(200, 260)] + [(500, k) for k in range(501, 560)] + [(5, 5)]
    up = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    want = {x: c for x, c in up.items() if any(x in e and e[0] != e[1] for e in edges)}
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in components.connected_components(df, Scratch(spark, "t")).collect()} == want
    assert components.connected_components(df.limit(0), Scratch(spark, "t")).collect() == []


def stages(spark, docs):
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = Scratch(spark, "t").save(stage(spark, docs, SF), "docs")
        out.append(docs)
    return out


def test_pipeline_stages(spark, documents):
    languages, distinct, cut, mixed, encoded = stages(spark, documents)
    for d in (languages, distinct, cut, mixed):
        assert d.schema == documents.schema
    text = {r.doc_id: r.text for r in languages.collect()}
    groups = {}
    for r in simhash.near_duplicates(languages).collect():
        groups.setdefault(r.component_id, []).append(r.doc_id)
    assert {r.doc_id for r in distinct.collect()} == {min(g) for g in groups.values()}
    seen, want = set(), {}
    for i, t in sorted((r.doc_id, r.text) for r in distinct.collect()):
        w = t.encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        if kept := [x for x, g in zip(w, gone, strict=True) if not g]:
            want[i] = kept
    assert {r.doc_id: r.text.encode().split() for r in cut.collect()} == want
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    assert {r.doc_id for r in mixed.collect()} <= set(want) and mixed.count() > 0 and set(want) <= set(text)
    coder = pieces.Encoder(pieces.Lattice.load(corpus_pipeline.tokenizer_file("piece_bpe_32k.model")))
    whole = {r.doc_id: r.text for r in mixed.collect()}
    assert {r.doc_id: coder.decode(r.piece_ids) for r in encoded.collect()} == whole


def test_pipeline_run(spark):
    a = {tuple(map(str, r)) for r in corpus_pipeline.run(spark, SF).collect()}
    assert a and a == {tuple(map(str, r)) for r in corpus_pipeline.run(spark, SF).collect()}


@pytest.mark.parametrize("rows", [[], HARD, [(k, " ".join(words(k % 3, 60))) for k in range(30)]])
def test_pipeline_on_hard_tables(spark, table, rows):
    docs = table(rows, ("digest", "score", "row", "fp", "key", "mark", "starts", "group", "kept", "__key", "__mark", "__row", "__keep", "__starts", "__id"))
    *kept, ids = stages(spark, docs)
    for d in kept:
        assert d.columns == docs.columns
    assert ids.columns == ["doc_id", "piece_ids", "best_score", "n_alternatives"] and ids.count() == kept[-1].count()


def test_rows_without_or_with_repeated_ids_pass_every_stage(spark, table, monkeypatch):
    """Each row is followed by its text: only what a stage is there to remove goes."""
    monkeypatch.setattr(corpus_pipeline.mixing, "TEMPERATURE", {"source": 1.0, "lang": 1.0, "topic": 1.0})
    mix = corpus_pipeline.mixing.mix
    monkeypatch.setattr(corpus_pipeline.mixing, "mix", lambda docs, **kw: mix(docs, budget=1.0, **kw))
    texts = {k: " ".join(words(k, 40, 400)) for k in range(40)}
    rows = [(None if k < 10 else 7 if k < 20 else k, t) for k, t in texts.items()]
    rows += [(None, texts[0]), (None, texts[30]), (99, texts[5]), (7, texts[12])]  # copies
    languages, distinct, cut, mixed, encoded = stages(spark, table(rows))
    whole = lambda d: sorted((str(r.doc_id), r.text) for r in d.collect())
    assert whole(languages) == sorted((str(i), t) for i, t in rows)
    want = sorted((str(99 if k == 5 else None if k < 10 else 7 if k < 20 else k), t) for k, t in texts.items())
    assert whole(distinct) == want and whole(cut) == want and whole(mixed) == want
    assert sorted(str(r.doc_id) for r in encoded.collect()) == sorted(i for i, _ in want)
