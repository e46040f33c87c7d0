"""Operators on documents against brute-force versions, and on the hard rows."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import zstandard
from llm.conftest import CLASH, HARD, words
from pyspark.sql import functions as F

from lexgrain.llm import language_id, mixing, pieces, pitman_yor, quality, simhash, substrings, token_counts

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


OPERATORS = {
    "language": lambda d: language_id.predict_languages(d),
    "tokens": lambda d: token_counts.count_tokens(d, BPE),
    "mixing": lambda d: mixing.mix(d),
    "pieces": lambda d: pieces.digests(d, PIECES),
    "encoded": lambda d: pieces.encoded(d, PIECES),
    "substrings": lambda d: substrings.kept_words(d),
    "quality": lambda d: quality.judge(d),
    "simhash": lambda d: simhash.near_duplicates(d),
    "pitman": lambda d: pitman_yor.score(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_hard_rows_and_clashing_columns(table, name):
    rows = OPERATORS[name](table(HARD, CLASH)).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in HARD)
    assert {r.doc_id for r in rows} == {i for i, _ in HARD}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(table, name):
    assert OPERATORS[name](table([])).collect() == []


def test_language_id(documents, table):
    got = language_id.predict_languages(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    odd = by_id(language_id.predict_languages(documents.unionByName(table([(9001, "123 %%"), (9002, None), (9003, "")]))).where("doc_id > 9000"))
    assert {r.lang_pred for r in odd.values()} == {"und"} and {r.score for r in odd.values()} == {0.0}


def test_language_is_not_read_from_label_or_source(documents):
    swapped = documents.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("z"))
    a, b = (by_id(language_id.predict_languages(d)) for d in (documents, swapped))
    assert all(a[i].lang_pred == b[i].lang_pred for i in a)


def test_pieces_of_long_texts_give_the_same_counts(monkeypatch):
    for text in ("".join(f"Wort{i} — " for i in range(300)), "  a", "a  ", "ab" * 200, "a" + " " * 300 + "b", "é. " * 100):
        monkeypatch.setattr(language_id, "PIECE", 1 << 20)
        whole = language_id.ngram_counts(text)
        for piece in (1, 2, 3, 97):
            monkeypatch.setattr(language_id, "PIECE", piece)
            assert (language_id.ngram_counts(text) == whole).all()


def test_ngram_counts_against_plain_loops():
    text, bins = "Ab, c\n\nd!", 1 << 15
    symbols = [32, *map(ord, "ab"), 32, ord("c"), 32, ord("d"), 32, 32]
    want = np.zeros(bins, np.int64)
    for n in (1, 2, 3):
        for k in range(len(symbols) - n + 1):
            h = n * 0x85EBCA6B & 0xFFFFFFFF
            for c in symbols[k : k + n]:
                h = (h ^ c) * 0x9E3779B1 & 0xFFFFFFFF
                h ^= h >> 15
            want[h & bins - 1] += 1
    assert (language_id.ngram_counts(text) == want).all()


def test_ftrl_against_plain_loops():
    """Follow-the-regularised-leader with L1 and L2, weight by weight."""
    rng, bins, classes = np.random.default_rng(1), 12, 3
    rows = [(np.sort(rng.choice(bins, 4, replace=False)), rng.random(4)) for _ in range(30)]
    y = rng.integers(0, classes, 30)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.8, 0.1
    z, n = [[0.0] * classes for _ in range(bins + 1)], [[0.0] * classes for _ in range(bins + 1)]

    def w(i, c):
        bound = 0 if i == bins else l1
        return 0.0 if abs(z[i][c]) <= bound else -(z[i][c] - math.copysign(bound, z[i][c])) / ((beta + math.sqrt(n[i][c])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(3):
        for r in order.permutation(30):
            x = [*zip(rows[r][0].tolist(), rows[r][1].tolist(), strict=True), (bins, 1.0)]
            logit = [sum(v * w(i, c) for i, v in x) for c in range(classes)]
            e = [math.exp(v - max(logit)) for v in logit]
            now = {(i, c): w(i, c) for i, _ in x for c in range(classes)}
            for i, v in x:
                for c in range(classes):
                    g = v * (e[c] / sum(e) - (c == y[r]))
                    z[i][c] += g - (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / alpha * now[i, c]
                    n[i][c] += g * g
    weights, bias = language_id.train_ftrl(rows, y, classes, bins, l1=l1)
    assert np.allclose(weights, [[w(i, c) for c in range(classes)] for i in range(bins)]) and np.allclose(bias, [w(bins, c) for c in range(classes)])
    assert (weights == 0).any()


def test_temperature_has_the_least_loss():
    rng = np.random.default_rng(2)
    logits, y = rng.standard_normal((200, 3)) * 6, rng.integers(0, 3, 200)
    loss = lambda t: -sum(math.log(math.exp(z[k] / t) / sum(math.exp(v / t) for v in z)) for z, k in zip(logits, y, strict=True))
    t = language_id.temperature(logits, y)
    assert loss(t) <= min(map(loss, np.exp(np.linspace(-3, 3, 50)))) + 0.05 and language_id.temperature(logits[:0], y[:0]) == 1.0


def test_repeated_rows_do_not_swell_the_sample(table):
    """One id and text that fill the table: drawn together, held to the bound."""
    rows = [(2, "the same text again", "en")] * 900 + [(k, " ".join(words(k, 9)), "fr") for k in range(3, 30)]
    out = language_id.predict_languages(table(rows), max_train=20).collect()
    assert len(out) == len(rows)


def test_language_columns_may_clash(documents):
    d = documents.withColumn("__held", F.lit("x")).withColumn("held_out", F.lit("y")).withColumn("__text", F.lit("z"))
    assert dict(language_id.predict_languages(d).dtypes)["held_out"] == "boolean" and by_id(language_id.predict_languages(d)) == by_id(language_id.predict_languages(documents))


def test_token_counts(documents, table):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(BPE)
    odd = [(9001 + k, t) for k, t in enumerate(["<|endoftext|> a", "x" * 5000, " " * 3000 + "y", "日本 ɐ ok", "\x85\xa0\x1c z", "don't  we'll\n\n"])]
    d = documents.unionByName(table(odd))
    got = by_id(token_counts.count_tokens(d, BPE))
    for i, t in d.select("doc_id", "text").collect():
        n = len(own.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 1024)


def test_settled_scripts_count_alike():
    """The two libraries on every settled character, alone and between others."""
    from tokenizers import Tokenizer

    own, count = Tokenizer.from_file(BPE), token_counts.counter(BPE)
    texts = [f"{a}{chr(c)}{b}" for c in range(0x250) for a, b in (("", ""), ("a", "b"), (" ", " "), ("1", "."), ("'", "s"), ("\n", "x"))]
    assert count(texts) == [len(e.ids) for e in own.encode_batch(texts, add_special_tokens=False)]


def test_cache_encodes_misses_once(spark, table, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    d = table([(1, "same"), (2, "same"), (3, "else")])
    first = by_id(token_counts.count_tokens(d, BPE, cache))
    assert spark.read.parquet(cache).count() == 2
    again = by_id(token_counts.count_tokens(d.unionByName(table([(4, "new"), (5, "same")])), BPE, cache))
    assert spark.read.parquet(cache).count() == 3 and first[1].n_tokens == again[5].n_tokens
    token_counts.count_tokens(d, PIECES, cache).collect()
    assert spark.read.parquet(cache).count() == 5  # another tokenizer's counts are its own


def test_query_keeps_counts_where_the_session_says(spark, tmp_path):
    from lexgrain.llm import queries

    spark.conf.set(queries.TOKEN_CACHE, str(tmp_path / "kept"))
    try:
        first = queries.op2_token_counts(spark, "/root/testdata/sf0.001").collect()
        many = spark.read.parquet(str(tmp_path / "kept")).count()
        assert sorted(first) == sorted(queries.op2_token_counts(spark, "/root/testdata/sf0.001").collect())
        assert spark.read.parquet(str(tmp_path / "kept")).count() == many > 0
    finally:
        spark.conf.unset(queries.TOKEN_CACHE)


def test_rows_without_an_id_have_draws_of_their_own(table):
    rows = [(None, " ".join(words(k, 30))) for k in range(200)]
    kept = [r.kept for r in mixing.mix(table(rows), budget=0.5).collect()]
    assert 50 < sum(kept) < 150


def test_topics_against_plain_loops(spark, table):
    """k-means over all rows: each row lies nearest to its own centre, each centre is the mean of its rows, and word use decides."""
    from lexgrain.llm.scratch import Scratch

    prose = lambda k: [f"{'en' if k % 3 else 'fr'}{x}" if j % 2 else f"{'a' if k % 2 else 'b'}{x}" for j, x in enumerate(words(k, 60, 8))]
    rows = [(k, " ".join(prose(k)), "en" if k % 3 else "fr") for k in range(120)] + [(900, ""), (901, None), (902, "", "xx")]
    texts = {i: t for i, t, *_ in rows}
    scratch = Scratch(spark, "t")
    weighed = scratch.save(mixing.weigh(table(rows)), "w")
    assert {r.doc_id: r.n_tokens for r in weighed.collect()} == {i: len((t or "").split()) for i, t in texts.items()}
    vectors = scratch.save(mixing.vectors(weighed, scratch), "v")
    bins = {r.doc_id: [r.bins.count(b) for b in mixing.BINS] for r in weighed.collect() if r.n_tokens}
    lang = {i: rest[0] if rest else "en" for i, _, *rest in rows}
    mean = {k: np.sum([c for i, c in bins.items() if lang[i] == k], axis=0) / sum(sum(c) for i, c in bins.items() if lang[i] == k) for k in ("en", "fr")}
    share = {i: (np.array(c) + 20 * mean[lang[i]]) / (sum(c) + 20) - mean[lang[i]] for i, c in bins.items()}
    width = np.sqrt(np.mean([x * x for x in share.values()], axis=0))
    for r in vectors.where("n_tokens > 0").collect():
        assert np.allclose(r.z, share[r.doc_id] / np.where(width > 0, width, 1), atol=1e-3)
    centres = np.array(mixing.centres_of(vectors, 2, 50))
    got = by_id(mixing.with_topics(vectors, 2))
    z = {i: np.array(r.z, float) for i, r in got.items() if r.n_tokens}
    near = {i: int(((x - centres) ** 2).sum(axis=1).argmin()) for i, x in z.items()}
    assert {i: r.topic for i, r in got.items()} == {i: f"t{near[i]}" if i in near else "empty" for i in got}
    for k in (0, 1):
        assert np.allclose(centres[k], np.mean([x for i, x in z.items() if near[i] == k], axis=0), atol=0.02)
    assert len({(i % 2, near[i]) for i in near}) == 2  # topics, not languages


def test_raking_meets_its_targets(spark, documents):
    out = mixing.mix(documents, budget=0.4).persist()
    rows = [r for r in out.collect() if r.n_tokens]
    total = sum(r.n_tokens for r in rows)
    assert sum(r.n_tokens * r.probability for r in rows) == pytest.approx(0.4 * total, rel=1e-6)
    part = Counter()
    for r in rows:
        part[r.lang] += r.n_tokens * r.probability * r.weight
    have = Counter()
    for r in rows:
        have[r.lang] += r.n_tokens
    want = {k: v**0.5 for k, v in have.items()}
    for k in have:
        assert part[k] / sum(part.values()) == pytest.approx(want[k] / sum(want.values()), rel=1e-3)
    again = by_id(mixing.mix(documents.repartition(3), budget=0.4))
    assert all(again[r.doc_id].kept == r.kept for r in rows)


def test_raking_against_plain_loops(spark):
    rng = np.random.default_rng(3)
    cells = [(f"s{i}", f"l{j}", f"t{k}", int(rng.integers(1, 99))) for i in range(4) for j in range(3) for k in range(2)]
    aims = {"source": rng.dirichlet(np.ones(4)), "lang": rng.dirichlet(np.ones(3)), "topic": rng.dirichlet(np.ones(2))}
    w = np.array([c[3] for c in cells], float).reshape(4, 3, 2)
    w /= w.sum()
    for _ in range(200):
        for axis, name in enumerate(aims):
            w *= (aims[name] / w.sum(axis=tuple({0, 1, 2} - {axis}))).reshape([-1 if a == axis else 1 for a in range(3)])
    targets = {n: spark.createDataFrame([(f"{n[0]}{i}", float(x)) for i, x in enumerate(aims[n])], f"{n} string, share double") for n in aims}
    got = {(r.source, r.lang, r.topic): r.weight for r in mixing.rake(spark.createDataFrame(cells, "source string, lang string, topic string, tokens long"), targets, mixing.Scratch(spark, "t"), 60, 1e-9).collect()}
    assert all(got[c[:3]] == pytest.approx(w.ravel()[k], rel=1e-5) for k, c in enumerate(cells))


def test_n_best_against_all_paths():
    import itertools
    import random

    lattice, rng = pieces.Lattice.load(PIECES), random.Random(2)
    coder = pieces.Encoder(lattice)

    def paths(edges, s=0):
        if s == len(edges):
            yield 0.0
            return
        for e, score, _ in edges[s]:
            for rest in paths(edges, e):
                yield score + rest

    for _ in range(150):
        unit = pieces.SPACE + "".join(rng.choice("theanrоé\n%") for _ in range(rng.randint(0, 7)))
        want = sorted(paths(lattice.edges(unit)), reverse=True)
        assert np.allclose([s for s, _ in lattice.n_best(unit, 6)], want[:6])
        ids, best, gap = lattice.first_two(unit)
        assert best == pytest.approx(want[0]) and (len(want) == 1 and gap == np.inf or gap == pytest.approx(want[0] - want[1], abs=1e-9))
    for _ in range(60):
        text = " ".join("".join(rng.choice("thean") for _ in range(rng.randint(1, 3))) for _ in range(3))
        want = sorted((sum(x) for x in itertools.product(*[list(paths(lattice.edges(u))) for u in coder.units_of(text)])), reverse=True)
        ids, best = coder.encode(text)
        assert np.allclose([s for s, _ in best], want[:4])
        assert all(coder.decode(coder.apply(ids, e)) == text for _, e in best) and len({tuple(coder.apply(ids, e)) for _, e in best}) == len(best)


def test_pieces_round_trip(documents, table):
    d = documents.unionByName(table([(9000 + k, t) for k, t in enumerate(["  two  spaces ", "tab\t\n\n", "日本語 🎉", "\x00", "a" * 3000])]))
    assert d.count() == pieces.digests(d, PIECES).where("round_trip").count()
    coder = pieces.Encoder(pieces.Lattice.load(PIECES))
    marked = by_id(pieces.digests(table([(1, "a ▁ b"), (2, "a b"), (3, "▁")]), PIECES))
    assert [marked[k].round_trip for k in (1, 2, 3)] == [False, True, False]
    for r in pieces.encoded(d, PIECES).join(d.select("doc_id", "text"), "doc_id").collect():
        assert coder.decode(r.piece_ids) == r.text
        for a in r.alternatives:
            assert coder.decode(coder.apply(r.piece_ids, {e["at"]: (e["n"], e["ids"]) for e in a["edits"]})) == r.text


def brute_windows(rows, width=20):
    seen, out = set(), []
    for i, text in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if key in seen:
                gone[k : k + width] = [True] * width
            seen.add(key)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def test_substrings(documents):
    rows = sorted((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())
    assert sorted(map(tuple, substrings.kept_words(documents).collect())) == brute_windows(rows)


def test_substrings_of_runs_periods_and_edges(table):
    base = words(1, 60)
    rows = [(1, " ".join(base)), (2, " ".join(words(2, 7) + base[10:50] + words(3, 5))), (3, "a " * 300), (4, "b a " * 5 + "a " * 100), (5, "a b " * 80), (6, " ".join(base[20:40])), (7, " ".join(base[20:39])), (8, "c b a b " * 40), (9, "\x0b".join(base)), (10, "é x " * 50)]
    assert sorted(map(tuple, substrings.kept_words(table(rows)).collect())) == brute_windows(rows)


def test_windows_share_a_key_in_every_context():
    """Random texts over few words, where most windows recur: equal windows always have equal keys and digests."""
    rng = np.random.default_rng(6)
    for vocabulary in (1, 2, 3, 8, 40):
        lengths = rng.integers(0, 70, 60)
        codes = rng.integers(0, vocabulary, lengths.sum())
        doc = np.repeat(np.arange(60), lengths)
        p, _, key, digest = substrings.anchors(substrings.mix(codes.astype(np.uint64) + np.uint64(7)), doc, np.cumsum(lengths))
        seen = {}
        for q, k, d in zip(p, key, digest, strict=True):
            assert seen.setdefault(tuple(codes[q : q + 20]), (k, d)) == (k, d)
        assert len(set(seen.values())) == len(seen)


def test_substrings_in_small_pieces(table, monkeypatch):
    monkeypatch.setattr(substrings, "BATCH_WORDS", 64)
    base = words(4, 500, 400)
    rows = [(1, " ".join(base)), (2, " ".join(base[100:300])), (3, " ".join(base[:40] + base[:40]))]
    lengths = [len(t.split()) for _, t in rows]
    blobs, later = [], []
    for (i, t), n in zip(rows, lengths, strict=True):
        h = substrings.hashes_of(substrings.words_of(t))
        for k in range(0, max(n - 19, 0), 64):
            piece = h[k : k + 64 + 19]
            out, late = substrings.records(piece, np.array([len(piece)]), np.array([i]), np.array([0]), np.array([k]), np.array([64]), 2, 20, 5)
            blobs += out
            later += [(i, int(x) + k) for x in late]
    for b in (0, 1):
        ids, _, place = substrings.repeated([x for c, x in blobs if c == b])
        later += list(zip(ids.tolist(), place.tolist(), strict=True))
    seen, want = set(), set()
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                want.add((i, k))
            seen.add(key)
    assert set(later) == want


def test_quality_measures(documents, table):
    d = documents.unionByName(table([(9001, "a b c d e a b c d e"), (9002, "x\nx\n \nx"), (9003, "#*$%&|<> a|b")]))
    got = by_id(quality.judge(d))
    for i, text in d.select("doc_id", "text").collect():
        w = WORD.findall(text or "")
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        twice = {j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(x in quality.SYMBOLS for x in text or ""), len(lines) - len(set(lines)), len(twice))
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        failed = len(w) < 10 or 100 * len(twice) > 20 * len(w)
        assert g.base_failed == failed and not (failed and g.kept)


def test_quality_em_against_plain_loops(spark):
    import random

    rng, names = random.Random(8), ["a", "b", "c"]
    rows = Counter()
    for _ in range(4000):
        good = rng.random() < 0.7
        rows[tuple(None if rng.random() < 0.2 else int((rng.random() < acc) == good) for acc in (0.9, 0.8, 0.7))] += 1
    df = spark.createDataFrame([(*k, n) for k, n in rows.items()], "v_a int, v_b int, v_c int, n long")
    prior, good, bad = quality.fit(df, names, 25)
    q0, g0, b0 = 0.8, dict.fromkeys(names, 0.8), dict.fromkeys(names, 0.8)
    for _ in range(25):
        post = {}
        for votes in rows:
            odds = q0 / (1 - q0)
            for r, v in zip(names, votes, strict=True):
                odds *= 1 if v is None else g0[r] / (1 - b0[r]) if v else (1 - g0[r]) / b0[r]
            post[votes] = odds / (1 + odds)
        total = sum(rows.values())
        old = [q0, *g0.values(), *b0.values()]
        q0 = min(max(sum(n * post[k] for k, n in rows.items()) / total, 0.05), 0.95)
        for at, r in enumerate(names):
            voted = [(k, n) for k, n in rows.items() if k[at] is not None]
            of = lambda hit, weight: sum(n * weight(post[k]) for k, n in voted if hit is None or k[at] == hit)  # noqa: E731, B023
            g0[r] = min(max((of(1, lambda p: p) + 8) / (of(None, lambda p: p) + 10), 0.5), 0.99)
            b0[r] = min(max((of(0, lambda p: 1 - p) + 8) / (of(None, lambda p: 1 - p) + 10), 0.02), 0.99)
        if max(abs(a - b) for a, b in zip(old, [q0, *g0.values(), *b0.values()], strict=True)) < 1e-4:
            break
    assert prior == pytest.approx(q0) and good == pytest.approx(g0) and bad == pytest.approx(b0)
    assert prior == pytest.approx(0.7, abs=0.08) and good["a"] > good["c"] and good["a"] == pytest.approx(0.9, abs=0.06) and bad["a"] == pytest.approx(0.9, abs=0.1)


def test_quality_keeps_clean_documents(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    marked = quality.judge(documents).join(labels, "doc_id").where("not base_failed").collect()
    good = [r.kept for r in marked if r.label == 1]
    assert sum(good) >= 0.97 * len(good)


def test_simhash(documents, table):
    d = documents.unionByName(table([(9001, None), (9002, ""), (9003, "A b"), (9004, "a B"), (9005, "Éa b c d")]))
    got = by_id(simhash.near_duplicates(d))
    rows = sorted((r.doc_id, r.text) for r in d.select("doc_id", "text").collect())
    fp = [simhash.fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        return x if up[x] == x else root(up[x])

    for a in range(len(rows)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= 4:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    for k, (i, _) in enumerate(rows):
        assert (got[i].fingerprint, got[i].component_id) == (f"{fp[k]:016x}", rows[root(k)][0])


def test_fingerprint_bits(spark):
    text = "The quick brown Fox jumps over the lazy dog"
    w = text.lower().split()
    hashes = [r.h & (2**64 - 1) for r in spark.createDataFrame([(" ".join(w[k : k + 4]),) for k in range(len(w) - 3)], "s string").select(F.xxhash64("s").alias("h")).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == want


def test_simhash_buckets_lose_no_link():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2**63, 300, dtype=np.int64).view(np.uint64)
    dense = fp[0] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    fp = np.unique(np.concatenate([fp, dense]))
    links = simhash._links(fp, np.arange(len(fp)), np.array([0, len(fp)]), 4)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    comp = np.arange(len(fp))
    for _ in range(20):
        comp = np.array([comp[near[k]].min() for k in range(len(fp))])
    got = np.arange(len(fp))
    for _ in range(len(fp)):
        old = got.copy()
        for a, b in links:
            got[a] = got[b] = min(got[a], got[b])
        if (old == got).all():
            break
    assert (got == comp).all()


def components_of(fp):
    """The least fingerprint that each can reach by links."""
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    comp = fp.view(np.int64).copy()
    while True:
        new = np.array([comp[near[k]].min() for k in range(len(fp))])
        if (new == comp).all():
            return comp
        comp = new


def test_simhash_splits_large_buckets(spark):
    """Buckets over the limit are keyed anew by more bits; no link is lost, at any number of blocks."""
    from lexgrain.llm.components import connected_components
    from lexgrain.llm.scratch import Scratch

    rng = np.random.default_rng(3)
    fp = rng.integers(-(2**63), 2**63, 200, dtype=np.int64).view(np.uint64)
    for seed in fp[:3]:
        near = np.full(300, seed)
        for _ in range(6):
            near ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
        fp = np.concatenate([fp, near])
    low = rng.integers(0, 1 << 22, 600).astype(np.uint64)  # all in one bucket of the high bits
    fp = np.unique(np.concatenate([fp, low]))
    want = {int(f): int(c) for f, c in zip(fp.view(np.int64), components_of(fp), strict=True)}
    classes = spark.createDataFrame([(int(f),) for f in fp.view(np.int64)], "fp long")
    for blocks, limit in ((6, 64), (8, 1 << 15), (9, 64)):
        scratch = Scratch(spark, "t")
        found = connected_components(simhash.near_edges(classes, scratch, blocks, 4, limit), scratch, f"cc{blocks}")
        got = {r.node: r.component for r in found.collect()}
        assert all(got.get(f, f) == c for f, c in want.items())


def test_more_fingerprints_take_more_blocks():
    assert [simhash.blocks_for(n) for n in (0, 1000, 10**8, 10**10, 10**12)] == [6, 6, 7, 8, 9]
    assert len(simhash.block_masks(7)) == 35 and all(m.bit_count() >= 27 for m in simhash.block_masks(7))


def test_simhash_keeps_rows_that_share_an_id_apart(table):
    rows = [(7, "a b c d e"), (7, "quite another text"), (8, "Quite another text"), (None, "a b c d e")]
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(table(rows)).collect())
    assert got == [("7", 7), ("7", 7), ("8", 7), ("None", 7)]
    assert len({r.group for r in simhash.grouped(table(rows)).collect()}) == 2


def test_pitman_yor(documents):
    got = by_id(pitman_yor.score(documents))
    text = {r.doc_id: [*(r.text or "").encode().lower().split(), b"\n"] for r in documents.select("doc_id", "text").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in text}
    c = Counter(w for i, ws in text.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in text.items():
        g = got[i]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert g.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
    out = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in out) > sum(g.base_score for g in out)


def test_pitman_yor_is_a_distribution(spark, table):
    """Known words and the unknown type add up to one."""
    rows = [(i, " ".join(words(i, 40, 30))) for i in range(1, 40)]
    known = sorted({w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in t.split()})
    probes = [(1000 + k, w, zlib.crc32(str(1000 + k).encode()) % 10) for k, w in enumerate([*known, "unseen"] * 1)]
    # Probes must not be learned from: give each an id that is held out.
    ids = iter(i for i in range(10_000, 40_000) if zlib.crc32(str(i).encode()) % 10 == 0)
    probes = [(next(ids), w) for _, w, _ in probes] + [(next(ids), "")]
    got = by_id(pitman_yor.score(table(rows + probes)))
    end = got[probes[-1][0]].score
    assert sum(10 ** (got[i].score - end) for i, _ in probes[:-1]) + 10**end == pytest.approx(1.0, abs=1e-3)


def test_pitman_yor_reads_the_word_before(spark, table):
    """After a word, known words, the unknown type and the end add up to one; a scrambled text scores lower."""
    rows = [(i, "a b c d e f g h " * 3 + " ".join(words(i, 10, 5))) for i in range(1, 40)]
    known = sorted({w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in t.split()})
    ids = iter(i for i in range(10_000, 40_000) if zlib.crc32(str(i).encode()) % 10 == 0)
    probes = {t: next(ids) for t in ["", "a", "unseen", "a b c d e f g h", "d a h c f b g e", *[f"{v} {w}" for v in ("a", "unseen") for w in [*known, "unseen2"]]]}
    got = by_id(pitman_yor.score(table(rows + [(i, t) for t, i in probes.items()])))
    at = {t: got[i].score for t, i in probes.items()}
    assert at["a b c d e f g h"] > at["d a h c f b g e"] + 3
    assert got[probes["a b c d e f g h"]].base_score == pytest.approx(got[probes["d a h c f b g e"]].base_score)
    for v in ("a", "unseen"):
        assert sum(10 ** (at[f"{v} {w}"] - at[v]) for w in [*known, "unseen2"]) + 10 ** at[""] == pytest.approx(1.0, abs=1e-3)


def test_pitman_yor_pairs_across_pieces():
    """A piece of a long text begins with the last word of the one before; the pairs of both are those of the text."""
    h = pitman_yor._hashes([b"a", b"b", b"c", pitman_yor.END])
    whole = pitman_yor.bigrams(np.array([0, 1, 2, 0, 3]), np.array([[0, 1, 0, 5, 0, 0]]), h)
    parts = pitman_yor.bigrams(np.array([0, 1, 2, 2, 0, 3]), np.array([[0, 1, 0, 3, 0, 0], [0, 1, 0, 3, 0, 1]]), h)
    assert whole[4].tolist() == parts[4].tolist() and len(whole[0]) == len(parts[0]) == 3


def test_marks_are_ordered_whatever_bits_they_differ_in():
    rng = np.random.default_rng(1)
    wide = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    for marks in (wide, np.append(wide, wide), np.append(wide, wide ^ np.uint64(1)), rng.integers(0, 64, 5000).astype(np.uint64), wide[:1], wide[:0]):
        assert (pitman_yor.ordered(marks) == np.argsort(marks, kind="stable")).all()


def test_pairs_seat_alike_wherever_they_are():
    rng = np.random.default_rng(0)
    c, base, marks = rng.integers(0, 3000, 2000), rng.random(2000) * 50, rng.integers(0, 2**63, 2000).astype(np.uint64)
    t = pitman_yor.seat_pairs(c, base, 0.5, marks, 1)
    some = rng.permutation(2000)[:300]
    assert (pitman_yor.seat_pairs(c[some], base[some], 0.5, marks[some], 1) == t[some]).all()
    assert (t <= c).all() and ((t > 0) == (c > 0)).all()
    ends = c == 65  # one customer is left over when strides begin
    c[:400], ends[:400] = 65, True
    t = pitman_yor.seat_pairs(c, base, 0.5, marks, 1)
    assert (pitman_yor.seat_pairs(c[ends], base[ends], 0.5, marks[ends], 1) == t[ends]).all()
    plain = np.mean([pitman_yor.seat(c, base, 0.5, np.random.default_rng(k)).sum() for k in range(5)])
    assert t.sum() == pytest.approx(plain, rel=0.02)


def test_seats_stay_within_customers():
    rng = np.random.default_rng(0)
    c = np.array([0, 1, 2, 50, 10_000, 5_000_000])
    t = pitman_yor.seat(c, np.full(6, 3.0), 0.5, rng)
    assert (t <= c).all() and (t[1:] >= 1).all() and t[0] == 0


def test_spelling_is_normalised():
    _, keys, _ = pitman_yor.spelled([b"the", b"then", b"a"])
    key, at = np.unique(keys[pitman_yor.ORDER], return_inverse=True)
    model = pitman_yor.Spelling(key, np.bincount(at) * 5, 1)
    one = model.probabilities([bytes([b]) for b in range(256)])
    _, k, _ = pitman_yor.spelled([b""])
    p = None
    for order in range(pitman_yor.ORDER + 1):
        context = k[order] // pitman_yor.DISHES * pitman_yor.DISHES
        p = model._look(order, np.sort(context + np.arange(pitman_yor.DISHES)), np.full(pitman_yor.DISHES, 1 / 257) if order == 0 else p)
    assert p.sum() == pytest.approx(1.0) and 0 < one.sum() < 1


def test_a_spelling_is_looked_up_once(monkeypatch):
    """The letters of many words share few contexts; each is asked for once, and a word's probability is as if it came alone."""
    ws = [f"{a}{b}{c}".encode() for a in "abcd" for b in "efgh" for c in "ijkl"] * 50
    _, keys, _ = pitman_yor.spelled(ws)
    key, at = np.unique(keys[pitman_yor.ORDER], return_inverse=True)
    model = pitman_yor.Spelling(key, np.bincount(at), 1)
    asked, look = [], pitman_yor.Spelling._look
    monkeypatch.setattr(pitman_yor.Spelling, "_look", lambda self, k, x, *below: asked.append(len(x)) or look(self, k, x, *below))
    got = model.probabilities(ws)
    assert max(asked) == len(key)
    assert (got == [model.probabilities([w])[0] for w in ws]).all()
    found = pitman_yor.distinct_keys(keys[pitman_yor.ORDER])
    assert (found[0] == key).all() and (found[1] == at).all()


def test_byte_planes_cost_less_than_turning_the_matrix():
    rng = np.random.default_rng(0)
    for a in (rng.geometric(0.3, 400_000), rng.integers(0, 2**64, 400_000, dtype=np.uint64), rng.integers(0, 9, 800_000).astype(np.uint32), np.array([7])):
        blob = pitman_yor._zip(a)
        assert (pitman_yor._unzip(blob, a.dtype) == a).all()
        assert zstandard.decompress(blob) == a.view(np.uint8).reshape(len(a), -1).T.tobytes()
    a = np.arange(1_000_000) % 50
    cost = lambda f: min(f() for _ in range(3))

    def both():
        begin = time.process_time()
        pitman_yor._unzip(pitman_yor._zip(a), np.int64)
        return time.process_time() - begin

    def turned():
        begin = time.process_time()
        a.view(np.uint8).reshape(len(a), -1).T.tobytes()
        return time.process_time() - begin

    assert cost(both) < cost(turned)


def test_drawn_numbers_are_the_inverse_of_the_distribution():
    rng = np.random.default_rng(2)
    n, p, marks = rng.integers(1, 900, 3000), rng.random(3000) * 0.2, rng.integers(0, 2**63, 3000).astype(np.uint64)
    got, u = pitman_yor.drawn(n, p, marks, 1, 70), pitman_yor._uniform(marks, 1, 70)
    for i in range(0, 3000, 7):
        out, mass = 0, np.exp(n[i] * np.log1p(-p[i]))
        below, odds = mass, p[i] / (1 - p[i])
        while u[i] > below and out < n[i]:
            out += 1
            mass *= (n[i] - out + 1) / out * odds
            below += mass
        assert got[i] == out
