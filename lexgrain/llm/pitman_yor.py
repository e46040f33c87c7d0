"""Language-model scores by a hierarchical Pitman-Yor model of words and their spelling.

Each word has a restaurant of the words that follow it; their tables are customers of the word restaurant,
which a text's first word and its end enter without a context. The tables of that one are draws from a
spelling model: restaurants of contexts of three, two, one and no preceding byte classes, each the child of
the next shorter one, above a uniform base. Seatings are sampled by blocked Gibbs sweeps: tables of pairs
given the words, of words given the spelling, spelling given the tables. Scores use predictive probabilities
averaged over the seatings after the first. As in the base score, all words that training has not seen are
one type of the distribution; it gets the mass of new tables that singletons say goes to new words, and known
words share the rest of that mass by their spelling. open_score also spells out the unknown words.

The corpus never meets one machine: batches of documents ask for their distinct words, by a digest of
the word; the words of a bucket are counted, seated and answered together. Pairs of words are counted by a digest
of both; every batch draws the tables of its pairs from that digest, so all that share a pair agree.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrain.llm.language_id import fold
from lexgrain.llm.scratch import Scratch, partitions

BATCH_WORDS = 1 << 20
CHUNK = 100_000
STRENGTH = 1.0
SWEEPS = 2
END = b"\n"
STOP = 256
DISHES = 257
CLASSES = 32
ORDER = 3
ALPHA = 0.1


def byte_classes() -> np.ndarray:
    """32 classes of context bytes: letters apart, digits, other ASCII, lead and trail bytes, and the word's start.

    They bound the spelling model: 32^3 contexts of 257 dishes at most, whatever the corpus.
    """
    out = np.full(DISHES, 28, np.int64)
    out[97:123] = np.arange(26)
    out[48:58] = 27
    out[128:192] = 30 + np.arange(64) % 2
    out[192:256] = 29
    out[STOP] = 26
    return out


CLASS = byte_classes()


def _zip(a: np.ndarray) -> bytes:
    """By byte plane, where small numbers compress well. A plane at a time, as numpy turns a matrix byte by byte."""
    rows = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1)
    planes = np.empty(rows.shape[::-1], np.uint8)
    for k in range(len(planes)):
        planes[k] = rows[:, k]
    return zstandard.compress(planes, 1)


def _unzip(b: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    rows = np.empty(planes.shape[::-1], np.uint8)
    for k, plane in enumerate(planes):
        rows[:, k] = plane
    return rows.ravel().view(kind)


def spelled(words: list[bytes]):
    """(dish, keys by order, word) of each letter of the words and their stops; a key is context * 257 + dish."""
    joined = np.frombuffer(b"".join(words), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), size + 1)
    at = np.cumsum(size + 1) - 1
    dish = np.full(len(word), STOP, np.int64)
    letters = np.ones(len(word), bool)
    letters[at] = False
    dish[letters] = joined
    keys, context = [dish.copy()], np.zeros(len(word), np.int64)
    place = np.arange(len(word)) - np.repeat(at - size, size + 1)
    for k in range(1, ORDER + 1):
        back = np.full(len(word), CLASS[STOP])
        back[k:] = CLASS[dish[:-k]]
        back[place < k] = CLASS[STOP]
        context = context + back * CLASSES ** (k - 1)
        keys.append(context * DISHES + dish)
    return dish, keys, word


def distinct_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(keys, return_inverse=True) of keys of spelled(), whose bound makes a table of all keys cheaper than a sort."""
    seen = np.zeros(DISHES * CLASSES**ORDER, bool)
    seen[keys] = True
    found, place = np.flatnonzero(seen), np.empty(len(seen), np.int32)
    place[found] = np.arange(len(found))
    return found, place[keys].astype(np.int64)


def discount(counts: np.ndarray) -> float:
    one, two = (counts == 1).sum(), (counts == 2).sum()
    return float(min(max(one / max(one + 2 * two, 1), 0.1), 0.9))


def seat(customers: np.ndarray, base: np.ndarray, discounted: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after its customers have come in. base: (strength + discount * tables) * parent's probability.

    One by one at first, when most tables open; then in strides of a fifth of those present.
    """
    tables = (customers > 0).astype(np.int64)
    here, k = np.flatnonzero(customers > 1), 1
    while len(here):
        stride = max(1, k // 5) if k >= 64 else 1
        step = np.minimum(stride, customers[here] - k)
        p = base[here] / (base[here] + k - discounted * tables[here])
        tables[here] += rng.binomial(step, np.clip(p, 0, 1))
        k += stride
        here = here[customers[here] > k]
    return np.minimum(tables, customers)


class Spelling:
    """Seated context restaurants; probabilities of whole words."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        levels = [(keys, counts)]
        for k in range(ORDER - 1, -1, -1):  # a first guess: one table for each dish of a child
            up = keys // DISHES % CLASSES**k * DISHES + keys % DISHES
            levels.append(np.unique(up, return_counts=True))
            keys = levels[-1][0]
        self.levels: list[tuple] = [()] * (ORDER + 1)
        down = levels[::-1]
        for _ in range(2):
            for k in range(ORDER + 1):  # from the base on: what each dish's parent gives it
                self.levels[k] = self._restaurant(*down[k], k, rng)
            for k in range(ORDER, 0, -1):  # and back: a child's tables are its parent's customers
                keys, tables = self.levels[k][0], self.levels[k][2]
                up = keys // DISHES % CLASSES ** (k - 1) * DISHES + keys % DISHES
                found, at = np.unique(up, return_inverse=True)
                down[k - 1] = found, np.bincount(at, tables).astype(np.int64)
        for k in range(ORDER + 1):
            self.levels[k] = self._restaurant(*down[k], k, rng)

    def _restaurant(self, keys, counts, k, rng):
        d = discount(counts)
        context = keys // DISHES
        begins = np.flatnonzero(np.diff(context, prepend=-1)) if len(keys) else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(keys))))
        parent = self._look(k - 1, keys // DISHES % CLASSES ** max(k - 1, 0) * DISHES + keys % DISHES)
        dishes = np.bincount(owner, minlength=len(begins)).astype(float)
        tables = seat(counts, (STRENGTH + d * dishes[owner]) * parent, d, rng)
        total, laid = np.bincount(owner, counts), np.bincount(owner, tables)
        return keys, counts, tables, context[begins], total, laid, d

    def _look(self, k: int, keys: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """P(dish | context) of keys of order k; the order below is looked up unless given."""
        if k < 0:
            return np.full(len(keys), 1.0 / DISHES)
        have, counts, tables, contexts, total, laid, d = self.levels[k]
        if below is None:
            below = self._look(k - 1, keys // DISHES % CLASSES ** max(k - 1, 0) * DISHES + keys % DISHES)
        if not len(have):
            return below
        context = keys // DISHES
        r = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
        open_ = contexts[r] == context
        i = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        own = np.where(have[i] == keys, counts[i] - d * tables[i], 0.0)
        return np.where(open_, (own + (STRENGTH + d * laid[r]) * below) / (STRENGTH + total[r]), below)

    def probabilities(self, words: list[bytes]) -> np.ndarray:
        """Of each word, with its stop."""
        if not words:
            return np.empty(0)
        _, keys, word = spelled(words)
        key, at = distinct_keys(keys[ORDER])  # far fewer than the letters
        return np.maximum(np.exp(np.bincount(word, np.log(self._look(ORDER, key))[at], minlength=len(words))), 1e-300)


def _hashes(words: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


END_HASH = _hashes([END])[0]


def mix(a: np.ndarray, b) -> np.ndarray:
    """64 bits of an ordered pair of 64-bit numbers."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(marks: np.ndarray, turn: int, k: int) -> np.ndarray:
    return ((mix(marks, np.uint64(turn << 32 | k)) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def drawn(n: np.ndarray, p: np.ndarray, marks: np.ndarray, turn: int, k: int) -> np.ndarray:
    """Binomial numbers that depend on the mark, the turn and k alone: the inverse of the distribution, a normal number where its mean is large."""
    u = _uniform(marks, turn, k)
    out, large = np.zeros(len(n), np.int64), n * p > 200
    z = np.sqrt(-2 * np.log(u[large])) * np.cos(2 * np.pi * _uniform(marks[large], turn, k | 1 << 31))
    out[large] = np.clip(np.rint(n[large] * p[large] + z * np.sqrt(n[large] * p[large] * (1 - p[large]))), 0, n[large])
    here, reached = np.flatnonzero(~large), 0
    n, p, u, got = n[here], p[here], u[here], out[here]
    mass = np.exp(n * np.log1p(-p))
    below, odds = mass.copy(), p / (1 - p)
    while left := np.count_nonzero(going := (u > below) & (n > reached)):
        if 4 * left < 3 * len(here):  # those that have their number leave, many at a time; until then they stay as they are
            out[here] = got
            here, n, u, got, mass, below, odds, going = (x[going] for x in (here, n, u, got, mass, below, odds, going))
        reached += 1
        got += going
        mass *= (n - reached + 1) / reached * odds
        below += mass
    out[here] = got
    return out


def seat_pairs(customers: np.ndarray, base: np.ndarray, discounted: float, marks: np.ndarray, turn: int) -> np.ndarray:
    """seat() by numbers drawn from the pair's mark, so that every batch that has the pair finds the same tables."""
    tables = (customers > 0).astype(np.int64)
    busy = np.flatnonzero(customers > 1)
    busy = busy[np.argsort(-customers[busy], kind="stable")]  # those still coming in are the first ones
    c, b, t, m = customers[busy], base[busy], tables[busy], marks[busy]
    k = 1
    while n := int(np.searchsorted(-c, -k)):
        p = np.clip(b[:n] / (b[:n] + k - discounted * t[:n]), 0, 1 - 1e-12)
        stride = max(1, k // 5) if k >= 64 else 1
        t[:n] += _uniform(m[:n], turn, k) < p if stride == 1 else drawn(np.minimum(stride, c[:n] - k), p, m[:n], turn, k)
        k += stride
    tables[busy] = np.minimum(t, c)
    return tables


def ordered(marks: np.ndarray) -> np.ndarray:
    """Stable order of 64-bit marks. Sorting numbers is far faster than their places, so the place takes the lowest bits, and marks that differ there alone send all to the slower sort."""
    bits = np.uint64(len(marks).bit_length())
    packed = np.sort((marks >> bits) << bits | np.arange(len(marks), dtype=np.uint64))
    order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    there = marks[order]
    return order if (there[1:] >= there[:-1]).all() else np.argsort(marks, kind="stable")


def bigrams(code: np.ndarray, info: np.ndarray, hashes: np.ndarray):
    """(places of the tokens that follow a word, pair after pair, where each pair begins among them, and by pair, in order of marks, its left word, right word and mark).

    A text's first word has no word before it; the end is left to the word restaurant.
    """
    digests = hashes[code]
    inner = digests != END_HASH
    inner[np.cumsum(info[:, 3]) - info[:, 3]] = False
    token = np.flatnonzero(inner)
    marks = mix(digests[:-1], digests[1:])[inner[1:]]
    order = ordered(marks)
    token, marks = token[order], marks[order]
    begin = np.flatnonzero(np.append(True, marks[1:] != marks[:-1])) if len(marks) else np.empty(0, np.int64)
    return token, begin, code[token[begin] - 1].astype(np.int64), code[token[begin]].astype(np.int64), marks[begin]


def by_pair(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums over each pair's tokens."""
    return np.add.reduceat(x.astype(np.int64), begin) if len(begin) else np.empty(0, np.int64)


def _cuts(bucket: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(bucket, np.arange(buckets + 1))


def _pair_bucket(marks: np.ndarray, buckets: int) -> np.ndarray:
    """Rises with the mark."""
    return ((marks >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


ROWS = "kind int, batch string, bucket int, blob binary, more binary, hashes binary"
ROW_COLUMNS = [x.split()[0] for x in ROWS.split(", ")]


def ask(docs: DataFrame, buckets: int) -> DataFrame:
    """docs(doc_id, none, held, text) -> rows (kind, batch, bucket, blob, more, hashes).

    kind 0: a batch's documents, with each token as the place of its word in the batch's list, and the words' digests.
    kind 1: the part of that list in one bucket, in order of digests, with the words' training counts: as tokens, before
    another word, and, one table for each pair of the batch, tables of their own restaurant and customers of the words'.
    """

    def run(batches):
        task, number, held, total, row = TaskContext.get().partitionId(), 0, [], 0, 0

        def flush():
            nonlocal number
            words = [w for x in held for w in x[3]]
            size = np.array([len(x[3]) for x in held], np.int64)
            code, distinct = pd.factorize(_hashes(words))
            first = np.full(len(distinct), -1, np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            lists = [words[k] for k in first.tolist()]
            bucket = (distinct % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((distinct, bucket))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            code, hashes, cuts = place[code], distinct[order], _cuts(bucket[order], buckets)
            info = np.array([[x[0], -1 if x[1] is None else x[1], x[2], len(x[3]), x[1] is None, x[4]] for x in held], np.int64)
            train = np.repeat(np.array([not x[2] for x in held]), size)
            begin = np.cumsum(size) - size
            count = lambda x: np.bincount(x, minlength=len(order))
            token, pair, left, right, _ = bigrams(code, info, hashes)
            n = by_pair(train[token], pair)
            train[begin[info[:, 5] == 1]] = False  # a word that only is context here
            alone = train.copy()
            alone[token] = False
            seen = n > 0
            per_word = [count(code[train]), count(code[token[train[token]] - 1]), count(left[seen]), count(right[seen]) + count(code[alone])]
            name = f"{task}-{number}"
            number += 1
            rows = [(0, name, 0, _zip(code.astype(np.uint32)), info.tobytes(), hashes.tobytes())]
            for b in np.flatnonzero(np.diff(cuts)):
                part = order[cuts[b] : cuts[b + 1]].tolist()
                rows.append((1, name, int(b), b" ".join([lists[k] if lists[k] != END else b"" for k in part]), _zip(np.concatenate([x[cuts[b] : cuts[b + 1]] for x in per_word])), None))
            held.clear()
            return pd.DataFrame(rows, columns=ROW_COLUMNS)

        for pdf in batches:
            for i, none, h, t in zip(pdf["doc_id"].tolist(), pdf["none"], pdf["held"], pdf["text"], strict=True):
                words = [*(t or "").encode("utf-8", "surrogatepass").lower().split(), END]
                for k in range(0, len(words), BATCH_WORDS):
                    held.append(((task << 40) + row, None if none else i, bool(h), words[max(k - 1, 0) : k + BATCH_WORDS], k > 0))
                    total += len(held[-1][3])
                    if total >= BATCH_WORDS:
                        yield flush()
                        total = 0
                row += 1
        if held:
            yield flush()

    return docs.mapInPandas(run, ROWS)


def _split(blob: bytes) -> list[bytes]:
    """A list of words; the end, which has none of their bytes, went as an empty one."""
    return [w or END for w in blob.split(b" ")]


def pair_asks(batches_: DataFrame, buckets: int) -> DataFrame:
    """kind 2: marks of a batch's pairs in one bucket, with their training counts; made from the written batch, so that they go into the exchange only."""

    def run(parts):
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                info, code = np.frombuffer(r.more, np.int64).reshape(-1, 6), _unzip(r.blob, np.uint32).astype(np.int64)
                token, pair, _, _, marks = bigrams(code, info, np.frombuffer(r.hashes, np.uint64))
                train = np.repeat(info[:, 2] == 0, info[:, 3])
                n = by_pair(train[token], pair)
                cuts = _cuts(_pair_bucket(marks, buckets), buckets)
                rows = [(2, r.batch, int(b), _zip(np.diff(marks[cuts[b] : cuts[b + 1]], prepend=np.uint64(0))), _zip(n[cuts[b] : cuts[b + 1]]), None) for b in np.flatnonzero(np.diff(cuts))]
                yield pd.DataFrame(rows, columns=ROW_COLUMNS)

    return batches_.select("batch", "blob", "more", "hashes").mapInPandas(run, ROWS)


def pair_counts(asks: DataFrame, buckets: int) -> DataFrame:
    """For each asked list of pairs, twice their training counts in all batches, and one more in the batch that seats them for all."""

    def run(batches):
        asked: dict[int, list] = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                asked.setdefault(r.bucket, []).append((r.batch, np.cumsum(_unzip(r.blob, np.uint64), dtype=np.uint64), _unzip(r.more, np.int64)))
        while asked:
            b, parts = asked.popitem()
            marks, first, at = np.unique(np.concatenate([x[1] for x in parts]), return_index=True, return_inverse=True)
            c = np.bincount(at, np.concatenate([x[2] for x in parts])).astype(np.int64)
            both = 2 * c[at]
            both[first] += 1
            begin = 0
            for batch, part, _ in parts:
                yield pd.DataFrame([(2, batch, b, _zip(both[begin : begin + len(part)]), int((c == 1).sum()) if not begin else 0, int((c == 2).sum()) if not begin else 0)], columns=["kind", "batch", "bucket", "blob", "one", "two"])
                begin += len(part)

    return asks.select("batch", "bucket", "blob", "more").repartitionById(buckets, F.col("bucket")).mapInPandas(run, "kind int, batch string, bucket int, blob binary, one long, two long")


WORDS = "kind int, batch string, bucket int, chunk int, words binary, counts binary, inside array<binary>, customers array<binary>, tables array<binary>, spelling array<binary>, n_words long, n_tokens long, n_customers long, n_tables long, one long, two long, spelt double, end_customers long, end_tables long, end_spelt double"
WORD_COLUMNS = [x.split()[0] for x in WORDS.split(", ")]


def vocabulary(asks: DataFrame, buckets: int) -> DataFrame:
    """Kind 0: all words of all batches with their training counts, a row for each CHUNK words of a bucket. Kind 1: by batch, where in the bucket its words are."""

    def run(batches):
        seen: dict[int, tuple[defaultdict, list]] = {}
        for pdf in batches:
            for batch, b, blob, more in zip(pdf["batch"], pdf["bucket"], pdf["blob"], pdf["more"], strict=True):
                known, asked = seen.setdefault(b, (defaultdict(), []))
                known.default_factory = known.__len__  # a new word gets the next number
                at = np.fromiter(map(known.__getitem__, _split(blob)), np.int64)
                asked.append((batch, at, _unzip(more, np.int64).reshape(4, -1)))
        while seen:
            b, (known, asked) = seen.popitem()
            words = list(known)
            order = np.argsort(_hashes(words), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            sums = np.zeros((4, len(order)), np.int64)
            for batch, at, n in asked:
                sums[:, place[at]] += n
                yield pd.DataFrame([(1, batch, b, 0, None, _zip(np.diff(place[at], prepend=0)), [], [], [], [], *[0] * 10)], columns=WORD_COLUMNS)
            for k in range(0, len(order), CHUNK):
                part = [words[i] for i in order[k : k + CHUNK].tolist()]
                c, before, inside, customers = sums[:, k : k + CHUNK]
                yield pd.DataFrame([_chunk(b, k // CHUNK, part, np.concatenate([c, before]), [inside], [customers], [], [])], columns=WORD_COLUMNS)

    return asks.select("batch", "bucket", "blob", "more").repartitionById(buckets, F.col("bucket")).mapInPandas(run, WORDS)


def _chunk(b, k, words, counts, inside, customers, tables, spelling):
    """counts: of tokens, then of tokens before another word. By seating: tables of the word's own restaurant, customers and tables of the word, and its spelling."""
    blob = b" ".join([b"" if w == END else w for w in words])
    n = customers[-1]
    t = tables[-1] if tables else (n > 0).astype(np.int64)
    end = [i for i, w in enumerate(words) if w == END]
    spelt = spelling[-1] if spelling else np.zeros(len(n))
    of_end = lambda x, kind: kind(x[end].sum())
    return (0, None, b, k, blob, _zip(counts), *[[_zip(x) for x in xs] for xs in (inside, customers, tables)], [x.tobytes() for x in spelling], int((n > 0).sum()), int(counts[: len(n)].sum()), int(n.sum()), int(t.sum()), int((n == 1).sum()), int((n == 2).sum()), float(spelt[n > 0].sum()), of_end(n, int), of_end(t, int), of_end(spelt, float))


def _unchunk(r):
    lists = [[_unzip(x, np.int64) for x in xs] for xs in (r.inside, r.customers, r.tables)]
    return _split(r.words), _unzip(r.counts, np.int64), *lists, [np.frombuffer(x) for x in r.spelling]


def spelling_counts(vocab: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Customers of the longest contexts: the letters of each word once for each of its tables. Bounded by the byte classes."""

    def run(batches):
        for pdf in batches:
            for blob, tables, customers in zip(pdf["words"], pdf["tables"], pdf["customers"], strict=True):
                _, keys, word = spelled(_split(blob))
                key, at = distinct_keys(keys[ORDER])
                laid = _unzip(tables[-1], np.int64) if len(tables) else (_unzip(customers[-1], np.int64) > 0).astype(np.int64)
                yield pd.DataFrame({"key": key, "n": np.bincount(at, laid[word]).astype(np.int64)})

    rows = vocab.select("words", "tables", "customers").mapInPandas(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 0").toPandas().sort_values("key")
    return rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def sweep(vocab: DataFrame, spelling, strength: float, discounted: float, turn: int) -> DataFrame:
    """New tables for every word, given the spelling model, the tables laid before and the customers the pairs send.

    The first seating, which no score averages, goes when the second is there.
    """
    gone = int(turn == 1)

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                words, c, inside, customers, tables, spelt = _unchunk(r)
                p = spelling.value.probabilities(words)
                t = seat(customers[-1], strength * p, discounted, np.random.default_rng([turn, r.bucket, r.chunk]))
                yield pd.DataFrame([_chunk(r.bucket, r.chunk, words, c, inside[gone:], customers[gone:], [*tables, t][gone:], [*spelt, p][gone:])], columns=WORD_COLUMNS)

    return vocab.mapInPandas(run, WORDS)


class Seating:
    """What all share of one seating of the word restaurant: the rate a spelling is worth in customers, probabilities of unknown words and of the end."""

    def __init__(self, sums, discounted: float, new: float):
        self.discounted, self.total = discounted, STRENGTH + (sums["n_customers"] or 0)
        opened = STRENGTH + discounted * (sums["n_tables"] or 0)
        self.rate = opened * (1 - new) / (sums["spelt"] or 1.0)
        self.unknown = new * opened / self.total
        self.end = float(self.known(sums["end_customers"], sums["end_tables"], sums["end_spelt"])) if sums["end_customers"] else 0.0

    def known(self, customers, tables, spelt):
        return (customers - self.discounted * tables + self.rate * spelt) / self.total


def answers(vocab: DataFrame, places: DataFrame, buckets: int, seatings: list[Seating], last: int) -> DataFrame:
    """For each batch's list in a bucket: of the last seatings the words' probabilities, of unknown words the spelling, in blob; the counts and by seating the tables of the word's own restaurant in more."""
    seatings = seatings[-last:]

    def run(batches):
        chunks: dict[int, list] = {}
        waiting: list[tuple] = []
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.kind == 1:
                    waiting.append((r.batch, r.bucket, r.counts))
                    continue
                c = _unzip(r.counts, np.int64).reshape(2, -1)
                inside, customers, tables = ([_unzip(x, np.int64) for x in xs[-last:]] for xs in (r.inside, r.customers, r.tables))
                spelt = [np.frombuffer(x) for x in r.spelling[-last:]]
                p = [np.where(c[0] > 0, s.known(n, t, q), q) for s, n, t, q in zip(seatings, customers, tables, spelt, strict=True)]
                chunks.setdefault(r.bucket, []).append((r.chunk, np.array(p, np.float32), np.array([*c, *inside])))
        both = {}
        for b, parts in chunks.items():
            parts.sort(key=lambda x: x[0])
            both[b] = np.concatenate([x[1] for x in parts], axis=1), np.concatenate([x[2] for x in parts], axis=1)
        while waiting:
            batch, b, steps = waiting.pop()
            at = np.cumsum(_unzip(steps, np.int64))
            yield pd.DataFrame([(1, batch, b, both[b][0][:, at].tobytes(), _zip(both[b][1][:, at].ravel()), None)], columns=ROW_COLUMNS)

    rows = vocab.unionByName(places).select("kind", "batch", "bucket", "chunk", "words", "counts", "inside", "customers", "tables", "spelling").withColumn("words", F.lit(None).cast("binary"))
    return rows.repartitionById(buckets, F.col("bucket")).mapInPandas(run, ROWS)


class Batch:
    """A batch with what it asked for: its words' probabilities by seating and its pairs' counts."""

    def __init__(self, doc, words, pairs, seatings: list[Seating], discounted: float):
        self.info = np.frombuffer(doc[1], np.int64).reshape(-1, 6)
        self.code = _unzip(doc[0], np.uint32).astype(np.int64)
        self.token, self.begin, self.left, self.right, self.marks = bigrams(self.code, self.info, np.frombuffer(doc[2], np.uint64))
        words.sort(key=lambda x: x[0])
        pairs.sort(key=lambda x: x[0])
        k = len(seatings)
        p = np.concatenate([np.frombuffer(x[1], np.float32).reshape(k, -1) for x in words], axis=1).astype(float)
        self.buckets = [(x[0], len(x[1]) // (4 * k)) for x in words]
        self.counts, self.before, *self.inside = np.concatenate([_unzip(x[2], np.int64).reshape(k + 2, -1) for x in words], axis=1)
        self.spelt = p.mean(axis=0)
        self.words = [np.where(self.counts > 0, x, s.unknown) for x, s in zip(p, seatings, strict=True)]
        n = np.concatenate([_unzip(x[1], np.int64) for x in pairs]) if pairs else np.zeros(0, np.int64)
        assert len(n) == len(self.marks)
        self.customers, self.owned = n >> 1, (n & 1 == 1) & (n > 1)
        self.base = [(STRENGTH + discounted * t[self.left]) * x[self.right] / (1 - s.end) for t, x, s in zip(self.inside, self.words, seatings, strict=True)]
        self.seatings, self.discounted = seatings, discounted

    def seated(self, turn: int) -> np.ndarray:
        return seat_pairs(self.customers, self.base[0], self.discounted, self.marks, turn)

    def probabilities(self, laid: list) -> np.ndarray:
        """Of each token, averaged over the seatings. laid: (turn, tables of the pairs of more than one customer)."""
        total, size, seen = np.zeros(len(self.code)), np.diff(np.append(self.begin, len(self.token))), (self.customers > 0).astype(np.int64)
        busy, of_turn = np.flatnonzero(self.customers > 1), dict(laid)
        for k, s in enumerate(self.seatings):
            p, tables = self.words[k][self.code], seen.copy()
            if len(busy):
                tables[busy] = _unzip(of_turn[k + 1], np.int64)
            own = self.customers - self.discounted * tables
            p[self.token] = np.repeat((1 - s.end) * (own + self.base[k]) / (STRENGTH + self.before[self.left]), size)
            total += p
        return total / len(self.seatings)


def by_batch(batches_: DataFrame, pairs: DataFrame, answered: DataFrame, use, schema: str, *laid: DataFrame) -> DataFrame:
    """Rows that use(name, doc, words, pairs, laid) makes of each batch. laid: kind 3, the pairs' tables by turn."""

    def run(parts):
        name, doc, got = None, None, ([], [], [])
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                if r.batch != name:
                    if doc is not None:
                        yield use(name, doc, *got)
                    name, doc, got = r.batch, None, ([], [], [])
                if r.kind == 0:
                    doc = (r.blob, r.more, r.hashes)
                else:
                    got[r.kind - 1].append((r.bucket, r.blob, r.more))
        if doc is not None:
            yield use(name, doc, *got)

    n = partitions(batches_.sparkSession)
    dealt = batches_.unionByName(answered)
    for x in (pairs, *laid):
        dealt = dealt.unionByName(x.select("kind", "batch", "bucket", "blob"), allowMissingColumns=True)
    dealt = dealt.repartition(n, "batch").sortWithinPartitions("batch", "kind", "bucket")
    return dealt.mapInPandas(run, schema)


def pair_tables(batches_: DataFrame, pairs: DataFrame, answered: DataFrame, seating: Seating, discounted: float, turn: int) -> DataFrame:
    """New tables for every pair, given the words' probabilities. Kind 2: summed by left and by right word of the batch that seats the pair, for each bucket. Kind 3: of the batch's pairs of more than one customer, for the scores."""

    def use(name, doc, words, asked, _):
        x = Batch(doc, words, asked, [seating], discounted)
        every = x.seated(turn)
        t = every[x.owned]
        alone = np.repeat(x.info[:, 2] == 0, x.info[:, 3])
        alone[(np.cumsum(x.info[:, 3]) - x.info[:, 3])[x.info[:, 5] == 1]] = False
        alone[x.token] = False
        n = len(x.counts)
        inside = np.bincount(x.left[x.owned], t, n).astype(np.int64)
        customers = (np.bincount(x.right[x.owned], t, n) + np.bincount(x.code[alone], minlength=n)).astype(np.int64)
        rows, begin, busy = [], 0, every[x.customers > 1]
        for b, size in x.buckets:
            rows.append((2, name, b, _zip(np.concatenate([inside[begin : begin + size], customers[begin : begin + size]]))))
            begin += size
        if len(busy):
            rows.append((3, name, turn, _zip(busy)))
        return pd.DataFrame(rows, columns=["kind", "batch", "bucket", "blob"])

    return by_batch(batches_, pairs, answered, use, "kind int, batch string, bucket int, blob binary")


def gathered(vocab: DataFrame, places: DataFrame, laid: DataFrame, buckets: int) -> DataFrame:
    """The words with one more seating of the pairs: tables of each word's own restaurant, and its customers."""

    def run(batches):
        rows: dict[int, list] = {}
        where: dict[tuple, np.ndarray] = {}
        parts: list[tuple] = []
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.kind == 0:
                    rows.setdefault(r.bucket, []).append(r)
                elif r.kind == 1:
                    where[r.bucket, r.batch] = np.cumsum(_unzip(r.counts, np.int64))
                else:
                    parts.append((r.bucket, r.batch, r.counts))
        sums = {b: np.zeros((2, sum(len(_unzip(r.counts, np.int64)) // 2 for r in chunks)), np.int64) for b, chunks in rows.items()}
        for b, batch, blob in parts:
            sums[b][:, where[b, batch]] += _unzip(blob, np.int64).reshape(2, -1)
        for b, chunks in rows.items():
            begin = 0
            for r in sorted(chunks, key=lambda r: r.chunk):
                words, c, inside, customers, tables, spelt = _unchunk(r)
                more = sums[b][:, begin : begin + len(words)]
                begin += len(words)
                yield pd.DataFrame([_chunk(b, r.chunk, words, c, [*inside, more[0]], [*customers, more[1]], tables, spelt)], columns=WORD_COLUMNS)

    new = laid.withColumnRenamed("blob", "counts")
    rows = vocab.unionByName(places).unionByName(new, allowMissingColumns=True)
    return rows.repartitionById(buckets, F.col("bucket")).mapInPandas(run, WORDS)


def scored(batches_: DataFrame, pairs: DataFrame, answered: DataFrame, laid: list[DataFrame], seatings: list[Seating], discounted: float, n_train: int, n_types: int) -> DataFrame:
    """The documents' sums: row, doc_id, held, tokens, known, base, score, open; a very long text has a row for each piece."""

    def use(name, doc, words, asked, tables):
        x = Batch(doc, words, asked, seatings, discounted)
        c, begin = x.counts, np.cumsum(x.info[:, 3]) - x.info[:, 3]
        base = np.log10((c + ALPHA) / (n_train + ALPHA * (n_types + 1)))[x.code]
        score, own = np.log10(x.probabilities([t[:2] for t in tables])), np.ones(len(x.code), np.int64)
        own[begin[x.info[:, 5] == 1]] = 0
        known = c[x.code] > 0
        add = lambda v: np.add.reduceat(v * own, begin)
        ids = pd.array(x.info[:, 1], dtype="Int64")
        ids[x.info[:, 4] == 1] = pd.NA
        return pd.DataFrame({"row": x.info[:, 0], "doc_id": ids, "held": x.info[:, 2] == 1, "tokens": add(np.ones(len(own), np.int64)), "known": add(known.astype(np.int64)), "base": add(base), "score": add(score), "open": add(np.where(known, score, score + np.log10(x.spelt)[x.code]))})

    return by_batch(batches_, pairs, answered, use, "row long, doc_id long, held boolean, tokens long, known long, base double, score double, open double", *laid)


def _by_kind(rows: DataFrame, scratch: Scratch, table: str, kinds: tuple[int, int]) -> list[DataFrame]:
    """The two kinds as tables of their own, so that each can be deleted after its last reader."""
    spark, name, root = rows.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", f"{scratch.root}/{table}"
    before = spark.conf.get(name, "0")
    spark.conf.set(name, "2")  # else each task sorts its blobs by kind
    try:
        rows.write.partitionBy("kind").option("parquet.block.size", 16 << 20).parquet(root)
    finally:
        spark.conf.set(name, before)
    shape = rows.drop("kind").schema
    read = lambda k: spark.read.schema(shape).option("recursiveFileLookup", True).parquet(f"{root}/kind={k}")
    exists = {k for k in kinds if _exists(spark, f"{root}/kind={k}")}
    return [(read(k) if k in exists else spark.createDataFrame([], shape)).select(F.lit(k).alias("kind"), *shape.names) for k in kinds]


def _exists(spark, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _discount(sums) -> float:
    one, two = sums["one"] or 0, sums["two"] or 0
    return min(max(one / max(one + 2 * two, 1), 0.1), 0.9)


def score(docs: DataFrame, held: Column | None = None, sweeps: int = SWEEPS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, open_score, perplexity.

    perplexity is 10 to the power of -score / n_tokens. Counts and digests of all rows decide every seat;
    large customers' counts are seated in strides of a fifth of those present, as one binomial number each.

    Learns from the rows that held (default: crc32(doc_id) mod 10 = 0, or no doc_id) does not hold out.
    A null or empty text is its end alone. Repeated rows count, and are scored, as often as they come. A
    table without a training row knows no word, and all it meets is the unknown type. An empty table
    gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch, buckets = Scratch(spark, "pitman-yor"), partitions(spark)
    held = F.coalesce(fold(doc_id, 10) == 0, F.lit(True)) if held is None else held
    source = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)).alias("doc_id"), F.col(doc_id).isNull().alias("none"), held.alias("held"), F.col(text).cast("string").alias("text"))
    batches, word_asks = _by_kind(ask(source, buckets), scratch, "asks", (0, 1))
    pairs = scratch.save(pair_counts(pair_asks(batches, buckets), buckets), "pairs")
    scratch.drop(shuffles=True)
    of_pairs = pairs.agg(F.sum("one").alias("one"), F.sum("two").alias("two")).first()
    inner = _discount(of_pairs)
    both = scratch.save(vocabulary(word_asks, buckets), "words")
    scratch.drop("asks/kind=1", shuffles=True)
    places, vocab = both.where("kind = 1"), both.where("kind = 0")
    names = ("n_words", "n_tokens", "n_customers", "n_tables", "one", "two", "spelt", "end_customers", "end_tables", "end_spelt")
    sums = lambda v: v.agg(*[F.sum(x).alias(x) for x in names]).first()
    now = sums(vocab)
    n_types, n_train = now["n_words"] or 0, now["n_tokens"] or 0
    discounted = _discount(now)
    new = min(max((now["one"] or 0) / max(discounted * (now["n_tables"] or 0), 1.0), 0.01), 0.99) if n_types else 1.0
    seatings, tables = [], []
    for turn in range(sweeps + 1):
        if turn:
            answered = scratch.save(answers(vocab, places, buckets, seatings, 1), f"answers-{turn}")
            laid, of_turn = _by_kind(pair_tables(batches, pairs, answered, seatings[-1], inner, turn), scratch, f"laid-{turn}", (2, 3))
            tables.append(of_turn)
            scratch.drop(f"answers-{turn}", shuffles=True)
            vocab = scratch.save(gathered(vocab, places, laid, buckets), f"customers-{turn}")
            scratch.drop(f"laid-{turn}/kind=2", f"seated-{turn - 1}", shuffles=True)
        spelling = spark.sparkContext.broadcast(Spelling(*spelling_counts(vocab), seed=turn + 1))
        vocab = scratch.save(sweep(vocab, spelling, STRENGTH + discounted * (now["n_tables"] or 0), discounted, turn), f"seated-{turn}")
        scratch.drop(*([f"customers-{turn}"] if turn else []))
        now = sums(vocab)
        seatings.append(Seating(now, discounted, new))
    answered = scratch.save(answers(vocab, places, buckets, seatings, sweeps), "answers")
    scratch.drop("words", f"seated-{sweeps}", shuffles=True)
    rows = scored(batches, pairs, answered, tables, seatings[1:], inner, n_train, n_types).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held").alias("held_out"), F.sum("tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"), F.sum("open").alias("open_score"))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score", "open_score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
