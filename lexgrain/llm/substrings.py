"""Exact removal of repeated word windows, found through recompressed symbols.

The first round of recompression names maximal runs of one symbol, each round pairs (left, right) of a
split of the alphabet drawn anew for the round. A name is a 64-bit digest of what it stands for: a
function of the run or pair alone, so that all executors give equal ones the same name in every round
without a naming shuffle of all words, which would be several times the input. With every symbol
goes its context: the words that the decisions behind it have looked at. A symbol whose context lies
inside a window is in every copy of the window, at the same place and under the same name. So each
window goes by one such symbol of the highest level, the windows of one symbol travel together, and
only symbols that occur more than once have their windows compared.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrain.llm.scratch import Scratch, full, partitions, replaced

WINDOW = 20
ROUNDS = 5
BATCH_WORDS = 1 << 19
#: Buckets of windows in one partition; a task holds one of them at a time.
FINER = 4
GOLD = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Sums:
    """Digests of any stretches of a sequence of 64-bit values, from one running sum of value * r^i."""

    _power: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, base: int):
        n = len(values) + 1
        up, down = self._power.get(base, (np.ones(1, np.uint64),) * 2)
        if len(up) < n:
            inverse = pow(base, -1, 1 << 64)
            up, down = (np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n * 5 // 4, b, np.uint64), dtype=np.uint64))) for b in (base, inverse))
            self._power[base] = up, down
        self.sum = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: n - 1], dtype=np.uint64)))
        self.down = down

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sum[stop] - self.sum[start]) * self.down[start] + (stop - start).astype(np.uint64) * GOLD)


def symbols(words: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS):
    """For each round (name, lo, hi) of the symbols whose context [lo, hi) is whole, in order of lo."""
    name, lo, hi, doc = words, np.arange(len(words)), np.arange(1, len(words) + 1), doc
    bad = np.zeros(len(words), bool)
    out = []
    for r in range(rounds):
        if len(name) < 2:
            break
        # Runs of a later round's symbols are rare, and asking for them widens each context: shuffle and disk grow by a quarter.
        for step in ("run", "pair") if r == 0 else ("pair",):
            n = len(name)
            near = np.zeros(n + 1, bool)  # near[k]: k-1 and k are in one document
            near[1:n] = doc[1:] == doc[:-1]
            if step == "run":
                begins = np.ones(n, bool)
                begins[1:] = ~(near[1:n] & (name[1:] == name[:-1]))
                a = np.flatnonzero(begins)
                b = np.append(a[1:], n) - 1
                left, right = np.maximum(a - 1, 0), np.minimum(b + 1, n - 1)
                whole = near[a] & near[b + 1]
                count = (b - a + 1).astype(np.uint64)
                new = np.where(count > 1, mix(name[a] * GOLD + count), name[a])
                bad_new = ~whole | bad[left] | bad[right] | (np.add.reduceat(bad, a) > 0)
                lo, hi = np.where(whole, lo[left], lo[a]), np.where(whole, hi[right], hi[b])
                doc = doc[a]
            else:
                heads = (mix(name ^ np.uint64(0x5851F42D4C957F2D * (r + 1) & (1 << 64) - 1)) & np.uint64(1)).astype(bool)
                joins = np.zeros(n + 1, bool)  # joins[k]: k and k+1 become one
                joins[: n - 1] = heads[:-1] & ~heads[1:] & near[1:n]
                kept = np.ones(n, bool)
                kept[1:] = ~joins[: n - 1]
                a = np.flatnonzero(kept)
                pair = joins[a]
                ahead, back = np.minimum(a + 1, n - 1), np.maximum(a - 1, 0)
                looks = heads[a]  # a head has looked at the next symbol, a tail at the one before
                whole = np.where(looks, near[a + 1], near[a])
                new = np.where(pair, mix(mix(name[a]) * GOLD + name[ahead]), name[a])
                bad_new = ~whole | bad[a] | np.where(looks, bad[ahead], bad[back])
                lo, hi = np.where(looks | ~whole, lo[a], lo[back]), np.where(looks & whole, hi[ahead], hi[a])
                doc = doc[a]
            name, bad = new, bad_new
        good = ~bad
        out.append((name[good], lo[good], hi[good]))
    return out


def anchors(words: np.ndarray, doc: np.ndarray, ends: np.ndarray, width: int = WINDOW, rounds: int = ROUNDS):
    """Each window's start, symbol's place, key (the same in all copies of the window) and 48-bit digest."""
    p = np.arange(len(words))
    p = p[p + width <= ends[doc]]
    one, two = Sums(words, 0x2545F4914F6CDD1D), Sums(mix(words ^ GOLD), 0x9E6C63D0876A9A47 | 1)
    key, place = one.of(p, p + width), p * (rounds + 1)
    digest = two.of(p, p + width) >> np.uint64(16)
    for r, (name, lo, hi) in enumerate(symbols(words, doc, rounds), 1):
        if not len(lo):
            continue
        k = np.minimum(np.searchsorted(lo, p), len(lo) - 1)
        fits = (lo[k] >= p) & (hi[k] <= p + width)
        k = k[fits]
        key[fits] = mix(one.of(lo[k], hi[k]) ^ mix(name[k]) + np.uint64(r))
        place[fits] = lo[k] * (rounds + 1) + r
    return p, place, key, digest


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def records(words: np.ndarray, lengths: np.ndarray, doc_id: np.ndarray, mark: np.ndarray, base: np.ndarray, limit: np.ndarray, buckets: int, width: int, rounds: int):
    """What one batch of documents sends: (bucket, blob). Of windows equal within the batch, the first goes.

    Documents are in order of doc_id. base is the place of each one's first word here in its whole
    text, limit the number of windows that start in this piece.
    """
    doc = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.cumsum(lengths)
    begin = ends - lengths
    p, symbol, key, digest = anchors(words, doc, ends, width, rounds)
    own = p - begin[doc[p]] < limit[doc[p]]
    p, symbol, key, digest = p[own], symbol[own], key[own], digest[own]
    if not len(p):
        return [], np.empty(0, np.int64)
    # A symbol's windows follow one another; its first one stands for the symbol.
    first = np.ones(len(p), bool)
    first[1:] = symbol[1:] != symbol[:-1]
    run = np.cumsum(first) - 1
    runs = np.flatnonzero(first)
    by = np.argsort(key[runs], kind="stable")
    again = np.zeros(len(runs), bool)
    same = key[runs][by][1:] == key[runs][by][:-1]
    again[by[1:][same]] = True
    again[by[:-1][same]] = True
    send = np.ones(len(p), bool)
    if again.any():
        w = np.flatnonzero(again[run])
        place = p[w] - begin[doc[p[w]]] + base[doc[p[w]]]
        order = np.lexsort((place, doc_id[doc[p[w]]], digest[w], key[w]))
        w, place = w[order], place[order]
        d = doc_id[doc[p[w]]]
        lead = np.ones(len(w), bool)
        lead[1:] = (key[w[1:]] != key[w[:-1]]) | (digest[w[1:]] != digest[w[:-1]])
        head = np.maximum.accumulate(np.where(lead, np.arange(len(w)), 0))
        send[w[(d != d[head]) | (place != place[head])]] = False
    later = p[~send]
    p, symbol, key, digest = p[send], symbol[send], key[send], digest[send]
    first = np.ones(len(p), bool)
    first[1:] = (symbol[1:] != symbol[:-1]) | (p[1:] != p[:-1] + 1)
    runs = np.flatnonzero(first)
    many = np.diff(np.append(runs, len(p)))
    bucket = (key[runs] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    out = []
    for b in range(buckets):
        r = order[cuts[b] : cuts[b + 1]]
        if not len(r):
            continue
        d = doc[p[runs[r]]]
        docs, at = np.unique(d, return_inverse=True)
        place = p[runs[r]] - begin[d] + base[d]
        w = np.repeat(runs[r] - np.concatenate(([0], np.cumsum(many[r])[:-1])), many[r]) + np.arange(many[r].sum())
        head = np.array([len(docs), len(r), len(w)], np.int64)
        six = np.ascontiguousarray(digest[w]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        out.append((b, head.tobytes() + key[runs[r]].tobytes() + six.tobytes() + _pack(doc_id[docs], mark[docs], np.diff(at, prepend=0).astype(np.int32), place.astype(np.int64), many[r].astype(np.int32))))
    return out, later


def _unpack(blob: bytes):
    d, r, w = np.frombuffer(blob, np.int64, 3)
    key = np.frombuffer(blob, np.uint64, r, 24)
    six = np.zeros((w, 8), np.uint8)
    six[:, :6] = np.frombuffer(blob, np.uint8, w * 6, 24 + r * 8).reshape(-1, 6)
    rest = zstandard.decompress(memoryview(blob)[24 + r * 8 + w * 6 :])
    ids, mark = np.frombuffer(rest, np.int64, d), np.frombuffer(rest, np.int64, d, 8 * d)
    at = np.cumsum(np.frombuffer(rest, np.int32, r, 16 * d))
    place = np.frombuffer(rest, np.int64, r, 16 * d + 4 * r)
    many = np.frombuffer(rest, np.int32, r, 16 * d + 12 * r).astype(np.int64)
    return key, six.view("<u8").ravel(), ids[at], mark[at], place, many


def repeated(blobs: list[bytes]):
    """(doc_id, mark, place) of the windows of one bucket that also start earlier."""
    parts = [_unpack(b) for b in blobs]
    key, _, ids, mark, place, many = (np.concatenate([x[k] for x in parts]) for k in range(6))
    digest = np.concatenate([x[1] for x in parts])
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    more = np.zeros(len(key), bool)
    more[order[1:][same]] = True
    more[order[:-1][same]] = True
    at = np.concatenate(([0], np.cumsum(many)[:-1]))
    r = np.flatnonzero(more)
    if not len(r):
        return (np.empty(0, np.int64),) * 3
    step = np.arange(many[r].sum()) - np.repeat(np.cumsum(many[r]) - many[r], many[r])
    run = np.repeat(r, many[r])
    k, d, i, m, q = key[run], digest[at[run] + step], ids[run], mark[run], place[run] + step
    order = np.lexsort((q, i, d, k))
    k, d, i, m, q = (x[order] for x in (k, d, i, m, q))
    lead = np.ones(len(k), bool)
    lead[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    head = np.maximum.accumulate(np.where(lead, np.arange(len(k)), 0))
    late = (i != i[head]) | (q != q[head])
    return i[late], m[late], q[late]


def _groups(ids: np.ndarray, groups: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _sent(ids, mark, place, groups: int):
    """Rows (group, blob) that bring the found windows of a document together."""
    g = _groups(ids, groups)
    order = np.lexsort((place, mark, ids, g))
    g, ids, mark, place = (x[order] for x in (g, ids, mark, place))
    cuts = np.searchsorted(g, np.arange(groups + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        s = slice(cuts[b], cuts[b + 1])
        yield int(b), len(place[s]).to_bytes(8, "little") + _pack(ids[s], mark[s], np.diff(place[s], prepend=0))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.empty(0, np.uint64)


def repeated_windows(docs: DataFrame, scratch: Scratch, width: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """docs(doc_id, mark, text) -> (doc_id, mark, starts): zipped int64 starts of windows that also start earlier."""
    tasks = partitions(scratch.spark)
    groups = tasks * FINER

    def send(batches):
        held, total = [], 0

        def flush():
            held.sort(key=lambda x: (x[0], x[1], x[3]))
            lengths = np.array([len(x[2]) for x in held], np.int64)
            ids, mark = (np.array([x[k] for x in held], np.int64) for k in (0, 1))
            base, limit = (np.array([x[k] for x in held], np.int64) for k in (3, 4))
            out, later = records(np.concatenate([x[2] for x in held]), lengths, ids, mark, base, limit, groups, width, rounds)
            rows = [(b, False, blob) for b, blob in out]
            if len(later):
                doc = np.repeat(np.arange(len(lengths)), lengths)[later]
                rows += [(g, True, blob) for g, blob in _sent(ids[doc], mark[doc], later - (np.cumsum(lengths) - lengths)[doc] + base[doc], groups)]
            held.clear()
            return pd.DataFrame(rows, columns=["bucket", "found", "blob"])

        for pdf in full(batches):
            for i, m, t in zip(pdf["doc_id"], pdf["mark"], pdf["text"], strict=True):
                w = hashes_of(words_of(t))
                for k in range(0, max(len(w) - width + 1, 0), BATCH_WORDS):  # a very long text goes in pieces that share width - 1 words
                    piece = w[k : k + BATCH_WORDS + width - 1]
                    held.append((i, m, piece, k, BATCH_WORDS))
                    total += len(piece)
                    if total >= BATCH_WORDS:
                        yield flush()
                        total = 0
        if held:
            yield flush()

    def by_bucket(batches):
        """The blobs of each bucket, in order of buckets."""
        now, blobs = None, []
        for pdf in full(batches):
            for b, blob in zip(pdf["bucket"].tolist(), pdf["blob"], strict=True):
                if b != now and blobs:
                    yield blobs
                    blobs = []
                now = b
                blobs.append(blob)
        if blobs:
            yield blobs

    def compare(batches):
        for blobs in by_bucket(batches):
            rows = list(_sent(*repeated(blobs), groups))
            if rows:
                yield pd.DataFrame({"bucket": [g for g, _ in rows], "found": True, "blob": [b for _, b in rows]})

    def gather(batches):
        for blobs in by_bucket(batches):
            parts = []
            for blob in blobs:
                n, rest = int.from_bytes(blob[:8], "little"), zstandard.decompress(blob[8:])
                ids, mark, place = np.frombuffer(rest, np.int64).reshape(3, n)
                parts.append((ids, mark, np.cumsum(place)))
            ids, mark, place = (np.concatenate([x[k] for x in parts]) for k in range(3))
            order = np.lexsort((place, mark, ids))
            ids, mark, place = ids[order], mark[order], place[order]
            first = np.ones(len(ids), bool)
            first[1:] = (ids[1:] != ids[:-1]) | (mark[1:] != mark[:-1])
            cuts = np.append(np.flatnonzero(first), len(ids))
            for k in range(0, len(cuts) - 1, 1000):
                part = list(zip(cuts[k : k + 1000], cuts[k + 1 : k + 1001], strict=False))
                yield pd.DataFrame({"doc_id": [ids[a] for a, _ in part], "mark": [mark[a] for a, _ in part], "starts": [_pack(np.unique(place[a:b])) for a, b in part]})

    shape = "bucket int, found boolean, blob binary"
    at = F.floor(F.col("bucket") / FINER).cast("int")
    sent = docs.select("doc_id", "mark", "text").mapInPandas(send, shape)
    # Rows that a batch has settled by itself pass through the same exchange, by document group.
    dealt = sent.repartitionById(tasks, at).sortWithinPartitions("found", "bucket")

    def compare_or_pass(batches):
        passed: list[pd.DataFrame] = []  # of the batch in which those to compare end, which come first

        def rest():
            for pdf in full(batches):
                if pdf["found"].any():
                    passed.append(pdf[pdf["found"]])
                if not pdf["found"].all():
                    yield pdf[~pdf["found"]]
                if passed:
                    return

        yield from compare(rest())
        yield from passed
        yield from full(batches)

    found = scratch.save(dealt.mapInPandas(compare_or_pass, shape).select("bucket", "blob"), "found")
    scratch.drop(shuffles=True)  # the windows are compared: their shuffle need not wait on disk for the texts
    return found.repartitionById(tasks, at).sortWithinPartitions("bucket").mapInPandas(gather, "doc_id long, mark long, starts binary")


def removed(n: int, starts: bytes | None, width: int = WINDOW) -> np.ndarray:
    """Which of n words the windows at these starts cover."""
    step = np.zeros(n + 1, np.int64)
    if starts:
        s = np.frombuffer(zstandard.decompress(starts), np.int64)
        np.add.at(step, s, 1)
        np.add.at(step, np.minimum(s + width, n), -1)
    return np.cumsum(step[:n]) > 0


def _marked(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("raw_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1)).alias("doc_id"), F.xxhash64(body).alias("mark"), body.alias("text"))


def kept_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256.

    A word goes if a window of width words over it also starts earlier, by (doc_id, place), in the
    input. Rows that repeat a doc_id count as the same document, so a window does not repeat itself in
    its own copy of the row; a null doc_id sorts last. Null and short texts lose nothing. An empty
    table gives no rows. Other columns of docs are not read.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    rows = _marked(docs, text, doc_id)
    starts = repeated_windows(rows, scratch, width, rounds)

    def digest(batches):
        for batch in batches:
            out = []
            for t, s in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                words = words_of(t)
                gone = removed(len(words), s, width)
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if s else words
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            new = {n: pa.array([x[k] for x in out], kind) for k, (n, kind) in enumerate({"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()}.items())}
            yield replaced(batch, ("text", "starts"), new)

    return rows.join(starts, ["doc_id", "mark"], "left").select(F.col("raw_id").alias("doc_id"), "text", "starts").mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_text(text: str, starts: bytes | None, width: int = WINDOW) -> str:
    """The text without the words that the windows cover; what stays keeps its own white space, one space joins its stretches."""
    if not starts:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in WORD.finditer(raw)]
    keep = ~removed(len(spans), starts, width)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], keep, [False])).astype(np.int8)))
    return b" ".join(raw[spans[a][0] : spans[b - 1][1]] for a, b in zip(edge[::2], edge[1::2], strict=True)).decode("utf-8", "surrogatepass")
