"""Language identification: FTRL-trained sparse multinomial regression over TF-IDF character n-grams."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrain.llm.scratch import Scratch, full, replaced

BINS = 1 << 15
NGRAMS = (1, 2, 3)
MAX_TRAIN = 4000
PIECE = 1 << 20
MAX_BROADCAST = 10_000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str | None, bins: int = BINS) -> np.ndarray | None:
    """Hashed n-gram counts of the whole text, lower-cased, each stretch without a letter as one space; None without a letter."""
    if not text:
        return None
    known, out, any_letter = letters(), np.zeros(bins, np.int64), False
    text = text.lower()
    tail, inside = np.empty(0, np.uint32), False  # the last symbols so far, and whether the last character was a letter
    for k in range(0, len(text), PIECE):  # in pieces, so that a very long text needs little memory; the counts are those of the whole
        code = np.frombuffer(text[k : k + PIECE].encode("utf-32-le", "surrogatepass"), "<u4")
        word = known[code]
        any_letter |= bool(word.any())
        keep = word.copy()
        keep[1:] |= word[:-1]
        keep[0] |= inside
        inside = bool(word[-1])
        edge = [32] if k == 0 else [], [32] if k + PIECE >= len(text) else []
        new = np.concatenate((edge[0], np.where(word, code, 32)[keep], edge[1])).astype(np.uint32)
        for n in NGRAMS:
            c = np.concatenate((tail[max(len(tail) - n + 1, 0) :] if n > 1 else tail[:0], new))
            if len(c) < n:
                continue
            h = np.full(len(c) - n + 1, n * 0x85EBCA6B & 0xFFFFFFFF, np.uint32)
            for j in range(n):
                h = (h ^ c[j : len(c) - n + 1 + j]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            out += np.bincount(h & np.uint32(bins - 1), minlength=bins)
        tail = np.concatenate((tail, new))[-max(NGRAMS) + 1 :]
    return out if any_letter else None


def weighted(idx: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit-length TF-IDF values."""
    x = (1 + np.log(count)) * idf[idx]
    return x / np.sqrt((x * x).sum())


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = ngram_counts(text, len(self.idf)) if self.langs else None
        if counts is None:
            return UNKNOWN, 0.0
        idx = np.flatnonzero(counts)
        p = softmax((weighted(idx, counts[idx], self.idf) @ self.weights[idx] + self.bias) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows, labels: np.ndarray, classes: int, bins: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
    """FTRL-proximal on (idx, value) rows. Returns weights [bins, classes], exactly zero where l1 holds them, and bias."""
    z, n = np.zeros((bins + 1, classes)), np.zeros((bins + 1, classes))
    penalty = np.full((bins + 1, 1), l1)
    penalty[bins] = 0

    def weight(zi, ni, l1i):
        return np.where(np.abs(zi) <= l1i, 0, -(zi - np.sign(zi) * l1i) / ((beta + np.sqrt(ni)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            idx, x = np.append(rows[r][0], bins), np.append(rows[r][1], 1.0)
            zi, ni = z[idx], n[idx]
            w = weight(zi, ni, penalty[idx])
            p = softmax(x @ w)
            p[labels[r]] -= 1
            g = x[:, None] * p
            z[idx] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[idx] = ni + g * g
    w = weight(z, n, penalty)
    return w[:bins], w[bins]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The scale of logits that gives held rows the least log loss; 1 where there are none."""
    if not len(labels):
        return 1.0
    scales = np.exp(np.linspace(np.log(0.05), np.log(20), 200))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-300)).mean() for t in scales]
    return float(scales[int(np.argmin(loss))])


def train(docs: DataFrame, scratch: Scratch, max_train: int = MAX_TRAIN, bins: int = BINS) -> Model:
    """docs(doc_id, text, lang), all of them labelled.

    Document frequencies are of all rows. The classifier learns from a sample of about max_train rows
    (the documented bound; twice that at the very most), the same number of each language or all it
    has, drawn by a hash of id and text; a fifth of the sample sets the temperature instead.
    """
    langs = scratch.save(docs.groupBy("lang").count().where("lang <> ''"), "langs")
    many = langs.count()
    rates = langs.select("lang", F.least(F.lit(1.0), F.lit(max_train / max(many, 1)) / F.col("count")).alias("rate"))
    if many <= MAX_BROADCAST:  # else a sort-merge join, whose hot languages adaptive execution splits
        rates = F.broadcast(rates)
    mark = F.xxhash64("doc_id", "text")
    draw = F.pmod(F.xxhash64(mark, F.lit(11)), F.lit(1_000_000)) / 1e6
    rows = docs.join(rates, "lang").select("lang", "text", (draw < F.col("rate")).alias("pick"), (F.pmod(F.xxhash64(mark, F.lit(12)), F.lit(5)) == 0).alias("held"))

    def run(batches):
        total, n = np.zeros(bins, np.int64), 0
        for pdf in full(batches):
            picked = []
            for lang, text, pick, held in zip(pdf["lang"], pdf["text"], pdf["pick"], pdf["held"], strict=True):
                counts = ngram_counts(text, bins)
                if counts is None:
                    continue
                idx = np.flatnonzero(counts)
                total[idx] += 1
                n += 1
                if pick:
                    picked.append((lang, bool(held), 0, zlib.compress(idx.astype("<u4").tobytes() + counts[idx].astype("<f4").tobytes(), 1)))
            if picked:
                yield pd.DataFrame(picked, columns=["lang", "held", "n", "blob"])
        yield pd.DataFrame({"lang": [None], "held": [False], "n": [n], "blob": [zlib.compress(total.astype("<i8").tobytes(), 1)]})

    shape = "lang string, held boolean, n long, blob binary"
    seen = scratch.save(rows.mapInPandas(run, shape), "seen")

    def add(batches):
        total, n = np.zeros(bins, np.int64), 0
        for pdf in full(batches):
            for k, blob in zip(pdf["n"], pdf["blob"], strict=True):
                total += np.frombuffer(zlib.decompress(blob), "<i8")
                n += int(k)
        yield pd.DataFrame({"lang": [None], "held": [False], "n": [n], "blob": [zlib.compress(total.astype("<i8").tobytes(), 1)]})

    sums = seen.where("lang is null")
    fan = max(1, int(sums.count() ** 0.5))
    df, n = np.zeros(bins, np.int64), 0
    for row in sums.repartition(fan).mapInPandas(add, shape).coalesce(1).mapInPandas(add, shape).collect():
        df, n = df + np.frombuffer(zlib.decompress(row.blob), "<i8"), n + row.n
    idf = np.log((1 + n) / (1 + df)) + 1
    sample = []
    # Rows that repeat one id and text are drawn together: the limit holds the sample to its bound whatever repeats.
    picked = seen.where("lang is not null").orderBy(F.xxhash64("blob"), "lang", "held").limit(2 * max_train).collect()
    for r in sorted(picked, key=lambda r: r.lang):
        raw = zlib.decompress(r.blob)
        idx = np.frombuffer(raw, "<u4", len(raw) // 8).astype(np.int32)
        sample.append((r.lang, r.held, idx, weighted(idx, np.frombuffer(raw, "<f4", len(idx), 4 * len(idx)), idf).astype(np.float32)))
    names = sorted({s[0] for s in sample})
    if not names:
        return Model([], idf, np.zeros((bins, 0)), np.zeros(0), 1.0)
    # Two large arrays instead of thousands of small ones, so that the driver gives their memory back.
    cuts = np.cumsum([len(s[2]) for s in sample])[:-1]
    x = list(zip(np.split(np.concatenate([s[2] for s in sample]), cuts), np.split(np.concatenate([s[3] for s in sample]), cuts), strict=True))
    y = np.array([names.index(s[0]) for s in sample])
    held = np.array([s[1] for s in sample])
    del sample
    if held.all() or not held.any():
        held[:] = False
    learn = np.flatnonzero(~held)
    w, b = train_ftrl([x[k] for k in learn], y[learn], len(names), bins)
    logits = np.array([v @ w[i] + b for (i, v), h in zip(x, held, strict=True) if h])
    return Model(names, idf, w.astype(np.float32), b, temperature(logits, y[held]))


def identify(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", keep: tuple[str | Column, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, the columns in keep (not named doc_id, lang_pred or score), lang_pred, score (calibrated probability).

    A null text, or one without a letter, is `und` with score 0, as is every text where nothing was
    learned. Repeated rows, null ids and very long texts are rows like any other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bins x languages, whatever the corpus
    source = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).cast("string").alias("__text"))
    shape = source.drop("__text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column("__text").to_pylist()]
            yield replaced(batch, ("__text",), {"lang_pred": pa.array([f[0] for f in found], pa.string()), "score": pa.array([f[1] for f in found], pa.float64())})

    return source.mapInArrow(run, shape)


def fold(doc_id: str, parts: int):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts))


def predict_languages(docs: DataFrame, max_train: int = MAX_TRAIN, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row: learned from the rows with a lang that crc32(doc_id) mod 3 does not hold out.

    lang, source and doc_id are no inputs of a prediction. A null doc_id has no remainder: it is not
    learned from and counts as held out. An empty table gives no rows. Of columns beside doc_id, text and
    lang only those in keep are read. Equal texts have equal answers; of equally probable languages the
    first by name wins.
    """
    scratch = Scratch(docs.sparkSession, "langid")
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(True))
    labelled = docs.where(~held & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    model = train(labelled, scratch, max_train)
    return identify(docs, model, keep=(*keep, held.alias("held_out"))).select("doc_id", "held_out", "lang_pred", "score", *keep)
