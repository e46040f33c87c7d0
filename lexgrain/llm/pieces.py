"""SentencePiece-style encoding and decoding: the N best segmentations over the piece lattice.

Forward Viterbi scores are exact heuristics for an A-star search from the end of the lattice, so its
paths come out best first. No piece crosses from a word to the white space after it: the lattice falls
into units there, and the N best of a text are the best of every unit with the cheapest exchanges.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexgrain.llm.scratch import Scratch, replaced

SPACE = "▁"
N_BEST = 4
FOUND = "piece_ids array<int>, best_score double, alternatives array<struct<score:double,edits:array<struct<at:int,n:int,ids:array<int>>>>>"
CACHE = 500_000
#: Units whose lattices are built together.
LEARN = 40_000
PENALTY = 10.0
ALTERNATIVES = pa.list_(pa.struct({"score": pa.float64(), "edits": pa.list_(pa.struct({"at": pa.int32(), "n": pa.int32(), "ids": pa.list_(pa.int32())}))}))
DIGESTS = {"n_pieces": pa.int64(), "best_score": pa.float64(), "n_segmentations": pa.int32(), "margin": pa.float64(), "ids_sha256": pa.string(), "round_trip": pa.bool_()}
LONG_UNIT = 48
BASE = np.uint64(0xD1342543DE82EF95)
SLOT_BITS = 20


def utf8_size(code: np.ndarray) -> np.ndarray:
    return 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)


@dataclass
class Lattice:
    """Pieces with log-probabilities, and the single bytes for characters that no piece has."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: list[int]
    byte_score: float
    longest: int = field(init=False)
    lone: str = field(init=False)
    table: tuple | None = field(init=False, default=None)

    def __post_init__(self):
        self.longest = max(map(len, self.pieces), default=1)
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("a piece crosses from a word to white space")
        self.lone = "" if any("\n" in p for p in self.pieces) else "\n"
        body = f"[^{SPACE}{self.lone}]"
        self.units = re.compile((f"{self.lone}|" if self.lone else "") + f"{SPACE}*{body}+|{SPACE}+")
        self.names = {i: p for p, (i, _) in self.pieces.items()}
        self.bytes_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.raw = {i: p.encode("utf-8") for i, p in self.names.items()} | {i: bytes((b,)) for i, b in self.bytes_of.items()}
        self.trie: dict = {}
        for p, found in self.pieces.items():
            node = self.trie
            for ch in p:
                node = node.setdefault(ch, {})
            node[""] = found

    @classmethod
    def load(cls, model: str) -> Lattice:
        """Of a .model file. Scores that are log-probabilities (a unigram model) are taken as they are; those of a
        BPE are 0, -1, -2 and so on, mere ranks: there a piece of rank r has a share of 1 / (1 + r), as Zipf has it."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        score = {i: sp.get_score(i) for i in plain}
        if all(s <= 0 and s == int(s) for s in score.values()):
            share = {i: 1.0 / (1.0 - s) for i, s in score.items()}
            total = np.log(sum(share.values()))
            score = {i: float(np.log(x) - total) for i, x in share.items()}
        pieces = {sp.id_to_piece(i): (i, score[i]) for i in plain}
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls(pieces, byte_ids, min(s for _, s in pieces.values()) - PENALTY)

    def edges(self, unit: str) -> list[list[tuple[int, float, int]]]:
        """For each place, the edges (end, score, id) that start there; id -1 stands for the bytes of one character."""
        out, n, root, last = [], len(unit), self.trie, self.longest
        for s in range(n):
            here, node, e = [], root, s
            for ch in unit[s : s + last]:
                if (node := node.get(ch)) is None:
                    break
                e += 1
                if "" in node:
                    i, score = node[""]
                    here.append((e, score, i))
            if not here or here[0][0] != s + 1:
                here.append((s + 1, self.byte_score * len(unit[s].encode("utf-8", "surrogatepass")), -1))
            out.append(here)
        return out

    @staticmethod
    def forward(edges) -> tuple[list[float], list[tuple[int, int]]]:
        """Viterbi: the best score of each place, and the edge (start, id) that it comes by; of equal ones the longest."""
        best, back = [0.0] + [-np.inf] * len(edges), [(0, 0)] * (len(edges) + 1)
        for s, here in enumerate(edges):
            base = best[s]
            for e, score, i in here:
                if base + score > best[e]:
                    best[e], back[e] = base + score, (s, i)
        return best, back

    def _ids(self, unit: str, s: int, i: int) -> list[int]:
        return [i] if i >= 0 else [self.byte_ids[b] for b in unit[s].encode("utf-8", "surrogatepass")]

    def first_two(self, unit: str) -> tuple[array, float, float]:
        """Ids of the best path, its score, and how much worse the next path is (inf: there is none).

        Any other path has an edge off the best one, and the best path over an edge is a forward plus a
        backward score.
        """
        n, low, root, last = len(unit), -np.inf, self.trie, self.longest
        best, back, edges = [0.0] + [low] * n, [(0, 0)] * (n + 1), []
        for s in range(n):
            node, e, base, lone = root, s, best[s], True
            for ch in unit[s : s + last]:
                if (node := node.get(ch)) is None:
                    break
                e += 1
                if (found := node.get("")) is not None:
                    i, score = found
                    edges.append((s, e, score))
                    if e == s + 1:
                        lone = False
                    if (score := score + base) > best[e]:
                        best[e], back[e] = score, (s, i)
            if lone:
                score = self.byte_score * len(unit[s].encode("utf-8", "surrogatepass"))
                edges.append((s, s + 1, score))
                if (score := score + base) > best[s + 1]:
                    best[s + 1], back[s + 1] = score, (s, -1)
        path, on, e = [], set(), n
        while e:
            s, i = back[e]
            on.add((s, e))
            path.append(i if i >= 0 else unit[s])
            e = s
        behind, second = [low] * n + [0.0], low
        for s, e, score in reversed(edges):
            score += behind[e]
            if score > behind[s]:
                behind[s] = score
            if (score := score + best[s]) > second and (s, e) not in on:
                second = score
        path.reverse()
        try:
            ids = array("i", path)
        except TypeError:  # characters without a piece
            ids = array("i", chain.from_iterable([x] if isinstance(x, int) else [self.byte_ids[b] for b in x.encode("utf-8", "surrogatepass")] for x in path))
        return ids, best[n], max(best[n] - second, 0.0)

    def _table(self):
        """Digests of all beginnings of pieces, a slot table over them, and each one's id (or -1) and score."""
        if self.table is None:
            found: dict[str, tuple[int, float]] = {}
            for p, x in self.pieces.items():
                for k in range(1, len(p)):
                    found.setdefault(p[:k], (-1, 0.0))
                found[p] = x
            keys = np.zeros(len(found), np.uint64)
            codes = [np.frombuffer(p.encode("utf-32-le"), "<u4") for p in found]
            for k in range(self.longest):
                here = np.array([len(c) > k for c in codes])
                keys[here] = keys[here] * BASE + np.array([c[k] for c in codes if len(c) > k], np.uint64) + np.uint64(1)
            order = np.argsort(keys)
            keys = keys[order]
            if (keys[1:] == keys[:-1]).any():
                raise ValueError("two beginnings of pieces have one digest")
            slots = np.full(1 << SLOT_BITS, -1, np.int32)
            at = self._slot(keys)
            slots[at] = np.arange(len(keys))
            slots[at[np.bincount(at, minlength=len(slots))[at] > 1]] = -2  # several: look among the sorted digests
            x = list(found.values())
            self.table = keys, slots, np.array([i for i, _ in x], np.int32)[order], np.array([y for _, y in x])[order]
        return self.table

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def _all_edges(self, code: np.ndarray, end: np.ndarray):
        """(start, length, id, score) of the edges of all places of many units at once, by start and length."""
        keys, slots, ids, scores = self._table()
        i, h, out = np.arange(len(code)), np.zeros(len(code), np.uint64), []
        for length in range(1, self.longest + 1):
            fits = i + length <= end[i]
            i, h = i[fits], h[fits]
            if not len(i):
                break
            h = h * BASE + code[i + length - 1] + np.uint64(1)
            k = slots[self._slot(h)]
            if (many := k == -2).any():
                k[many] = np.minimum(np.searchsorted(keys, h[many]), len(keys) - 1)
            good = (k >= 0) & (keys[k] == h)
            if length == 1:
                bare = np.ones(len(code), bool)
                bare[i[good][ids[k[good]] >= 0]] = False
            i, h, k = i[good], h[good], k[good]
            own = ids[k] >= 0
            out.append((i[own], np.full(own.sum(), length), ids[k[own]], scores[k[own]]))
        bare = np.flatnonzero(bare)
        out.append((bare, np.ones(len(bare), np.int64), np.full(len(bare), -1, np.int32), self.byte_score * utf8_size(code[bare])))
        start, length, found, score = (np.concatenate([x[k] for x in out]) for k in range(4))
        order = np.argsort(start * 64 + length, kind="stable")
        return start[order], length[order], found[order], score[order]

    def first_two_of(self, units: list[str]):
        """first_two() of many short units together, place by place over all of them: ids, how many of each unit, scores, gaps."""
        code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        size = np.fromiter(map(len, units), np.int64, len(units))
        unit = np.repeat(np.arange(len(units)), size)
        last = np.cumsum(size)
        begin = last - size
        start, length, found, score = self._all_edges(code, last[unit])
        owner = unit[start]
        a = start + owner  # nodes: each unit has one more than it has characters
        b = a + length
        step = start - begin[owner]
        by_step = np.argsort(step, kind="stable")
        cuts = np.searchsorted(step[by_step], np.arange(size.max() + 1))
        best, back = np.full(len(code) + len(units), -np.inf), np.zeros(len(code) + len(units), np.int64)
        best[begin + np.arange(len(units))] = 0.0
        for k in range(size.max()):
            e = by_step[cuts[k] : cuts[k + 1]]
            through = best[a[e]] + score[e]
            e, through = (x[m] for m in [through > best[b[e]]] for x in (e, through))
            best[b[e]], back[b[e]] = through, e
        final = last + np.arange(len(units))
        behind = np.full(len(best), -np.inf)
        behind[final] = 0.0
        for k in range(size.max() - 1, -1, -1):
            e = by_step[cuts[k] : cuts[k + 1]]
            first = np.flatnonzero(np.diff(a[e], prepend=-1))
            behind[a[e][first]] = np.maximum.reduceat(score[e] + behind[b[e]], first)
        on, node, left = np.zeros(len(start), bool), final.copy(), np.arange(len(units))
        while len(left):
            e = back[node[left]]
            on[e] = True
            node[left] = a[e]
            left = left[start[e] > begin[left]]
        other = np.where(on, -np.inf, best[a] + score + behind[b])
        second = np.maximum.reduceat(other, np.searchsorted(owner, np.arange(len(units))))
        path = np.flatnonzero(on)
        wide = np.where(found[path] >= 0, 1, utf8_size(code[start[path]]))
        flat = np.repeat(found[path], wide)
        for k, e in zip((np.cumsum(wide) - wide)[found[path] < 0].tolist(), path[found[path] < 0].tolist(), strict=True):
            raw = chr(int(code[start[e]])).encode("utf-8", "surrogatepass")
            flat[k : k + len(raw)] = [self.byte_ids[x] for x in raw]
        return flat.astype(np.int32), np.bincount(owner[path], wide, len(units)).astype(np.int64), best[final], np.maximum(best[final] - second, 0.0)

    def n_best(self, unit: str, n: int = N_BEST) -> list[tuple[float, list[int]]]:
        """The n best paths, best first; A-star from the end, with the forward score as what is still to come."""
        edges = self.edges(unit)
        best, _ = self.forward(edges)
        into: list[list[tuple[int, float, int]]] = [[] for _ in range(len(edges) + 1)]
        for s, here in enumerate(edges):
            for e, score, i in here:
                into[e].append((s, score, i))
        count, out = 0, []
        agenda = [(-best[-1], 0, len(edges), 0.0, None)]
        pops = [0] * (len(edges) + 1)
        while agenda and len(out) < n:
            _, _, e, score, tail = heapq.heappop(agenda)
            if pops[e] >= n:  # n better ways from here to the end are known
                continue
            pops[e] += 1
            if not e:
                ids = []
                while tail:
                    s, i, tail = tail
                    ids += self._ids(unit, s, i)
                out.append((score, ids))
                continue
            for s, add, i in into[e]:
                count += 1
                heapq.heappush(agenda, (-(best[s] + score + add), count, s, score + add, (s, i, tail)))
        return out


class Encoder:
    """Encodes whole texts; keeps what it has found about recent units, in columns."""

    def __init__(self, lattice: Lattice, n: int = N_BEST):
        self.lattice, self.n = lattice, n
        self.lists: dict[str, list[tuple[float, list[int]]]] = {}
        self._forget()

    def _forget(self):
        self.known: dict[str, int] = {}
        self.flat, self.many = np.empty(1 << 16, np.int32), 0  # ids of all known units, one after another
        self.offset, self.size = array("q"), array("i")
        self.best, self.gap, self.good = array("d"), array("d"), array("b")

    def encode(self, text: str, units: list[str] | None = None):
        """(ids, n best as (score, {unit's place in ids: (how many ids it replaces, ids)}), best first)."""
        if not text:
            return np.empty(0, np.int32), [(0.0, {})]
        units = units or self.units_of(text)
        row = self._rows(units)
        size = np.frombuffer(self.size, np.int32)[row]
        end = np.cumsum(size, dtype=np.int64)
        ids = self.flat[np.repeat(np.frombuffer(self.offset, np.int64)[row] - end + size, size) + np.arange(end[-1])]
        return ids, self._exchanges(units, end - size, size, np.frombuffer(self.gap)[row], float(np.frombuffer(self.best)[row].sum()))

    def decodes(self, text: str, units: list[str] | None = None) -> bool:
        """Whether the best ids decode to the text: each unit's ids were decoded when it was learned, and units are all of a text.

        A U+2581 of the text itself decodes to a space, as in all of this family, so such a text does not come back.
        """
        if not text:
            return True
        if SPACE in text:
            return False
        units = units or self.units_of(text)
        return bool(np.frombuffer(self.good, np.int8)[self._rows(units)].all()) and sum(map(len, units)) == len(text) + 1

    def _rows(self, units: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        except KeyError:  # not prepared
            self.learn(set(units).difference(self.known))
            return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))

    def _keep(self, units: list[str], ids: np.ndarray, size: np.ndarray, best: np.ndarray, gap: np.ndarray):
        while self.many + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        self.flat[self.many : self.many + len(ids)] = ids
        end = np.cumsum(size, dtype=np.int64)
        names, listed = self.lattice.raw, ids.tolist()
        spans = zip(units, (end - size).tolist(), end.tolist(), strict=True)
        self.good.extend([b"".join(map(names.__getitem__, listed[x:y])) == u.encode("utf-8", "surrogatepass") for u, x, y in spans])
        self.offset.frombytes((end - size + self.many).tobytes())
        self.size.frombytes(size.astype(np.int32).tobytes())
        self.best.frombytes(best.tobytes())
        self.gap.frombytes(gap.tobytes())
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units)), strict=True))
        self.many += len(ids)

    def learn(self, units: set[str]):
        short = [u for u in units if len(u) <= LONG_UNIT]
        if len(short) >= 16:
            for k in range(0, len(short), LEARN):
                self._keep(short[k : k + LEARN], *self.lattice.first_two_of(short[k : k + LEARN]))
            units = units.difference(short)
        for u in units:
            ids, best, gap = self.lattice.first_two(u)
            self._keep([u], np.frombuffer(ids, np.int32), np.array([len(ids)]), np.array([best]), np.array([gap]))

    def prepare(self, texts) -> list[list[str] | None]:
        """Learn what a batch of texts needs, all together; forget before it if too much is known.

        Returns the units of the texts, of half a million units in all at most; None for the others.
        """
        if len(self.known) > CACHE:
            self._forget()
        if len(self.lists) > CACHE >> 4:
            self.lists.clear()
        new: set[str] = set()
        out, held = [], 0
        for t in texts:
            units = self.units_of(t) if t else []
            new.update(units)
            held += len(units)
            out.append(units if held <= 1 << 19 else None)
            if len(new) > LEARN:
                self.learn(new.difference(self.known))
                new = set()
        self.learn(new.difference(self.known))
        return out

    def units_of(self, text: str) -> list[str]:
        return self.lattice.units.findall(SPACE + text.replace(" ", SPACE))

    def _exchanges(self, units, begin, size, gap, total):
        worst = np.partition(gap, self.n - 2)[self.n - 2] if len(gap) >= self.n > 1 else np.inf
        near = np.flatnonzero(gap <= worst)
        few = np.sort(near[np.argsort(gap[near], kind="stable")[: self.n - 1]])
        few = [int(k) for k in few if np.isfinite(gap[k])]
        if not few:
            return [(total, {})]
        lists = []
        for k in few:
            if units[k] not in self.lists:
                self.lists[units[k]] = self.lattice.n_best(units[k], self.n)
            lists.append(self.lists[units[k]])
        out, seen, heap = [], {(0,) * len(few)}, [(0.0, (0,) * len(few))]
        while heap and len(out) < self.n:
            loss, pick = heapq.heappop(heap)
            out.append((total - loss, {int(begin[few[j]]): (int(size[few[j]]), lists[j][c][1]) for j, c in enumerate(pick) if c}))
            for j, c in enumerate(pick):
                if c + 1 < len(lists[j]):
                    new = (*pick[:j], c + 1, *pick[j + 1 :])
                    if new not in seen:
                        seen.add(new)
                        heapq.heappush(heap, (loss + lists[j][c][0] - lists[j][c + 1][0], new))
        return out

    def apply(self, ids, edits: dict[int, tuple[int, list[int]]]) -> list[int]:
        """The ids of one of the n best."""
        out, at = [], 0
        for k in sorted(edits):
            n, new = edits[k]
            out += [*ids[at:k], *new]
            at = k + n
        return [*out, *ids[at:]]

    def unit_text(self, ids) -> bytes:
        return b"".join(map(self.lattice.raw.__getitem__, ids))

    def decode(self, ids) -> str:
        """The text; U+2581 in it has become a space, as in all of this family."""
        names, byte = self.lattice.names, self.lattice.bytes_of
        if not len(ids):
            return ""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        if byte.keys().isdisjoint(ids):
            return "".join(map(names.__getitem__, ids)).replace(SPACE, " ")[1:]
        return self.unit_text(ids).decode("utf-8", "surrogatepass").replace(SPACE, " ")[1:]


def encoded(docs: DataFrame, model: str, n: int = N_BEST, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, keep, piece_ids, best_score, alternatives [(score, edits [(at, n, ids)])].

    The model file is read on each executor, at a path that is good there. A null or empty text has no
    pieces, score 0 and one segmentation. Repeated rows, null ids and very long texts are rows like any
    other; ties go to the longer piece, then to the order of the search, which is fixed.
    """
    Scratch(docs.sparkSession, "pieces")
    source = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).cast("string").alias("__text"))
    shape = source.drop("__text").schema
    shape = StructType([*shape.fields, *StructType.fromDDL(FOUND).fields])

    def run(batches):
        coder = Encoder(Lattice.load(model), n)
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            found = [coder.encode(t or "", u) for t, u in zip(texts, coder.prepare(texts), strict=True)]
            more = [[{"score": s, "edits": [{"at": k, "n": m, "ids": i} for k, (m, i) in sorted(e.items())]} for s, e in best[1:]] for _, best in found]
            size = np.cumsum([0] + [len(ids) for ids, _ in found]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(size), pa.array(np.concatenate([np.empty(0, np.int32), *[ids for ids, _ in found]])))
            yield replaced(batch, ("__text",), {"piece_ids": ids, "best_score": pa.array([best[0][0] for _, best in found], pa.float64()), "alternatives": pa.array(more, ALTERNATIVES)})

    return source.mapInArrow(run, shape)


def digests(docs: DataFrame, model: str, n: int = N_BEST, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_pieces, best_score, n_segmentations, margin (null with one), ids_sha256 and round_trip.

    The operator's own encoder, with the ids kept on the executor: ids_sha256 is of the best path's ids
    as little-endian 32-bit integers. Each unit's ids are decoded and compared when they are found;
    round_trip says that the best decodes to the text and the exchanges of the others to what they replace;
    it is false for a text with U+2581, which comes back as a space. Nulls, empty and repeated rows, ties
    and other columns are as in encoded().
    """
    Scratch(docs.sparkSession, "pieces")

    def run(batches):
        coder = Encoder(Lattice.load(model), n)
        for batch in batches:
            out = []
            texts = batch.column("text").to_pylist()
            for t, units in zip(texts, coder.prepare(texts), strict=True):
                ids, best = coder.encode(t or "", units)
                good = coder.decodes(t or "", units)
                for _, edits in best[1:]:
                    for at, (m, new) in edits.items():  # one exchange alters its own unit only
                        good &= coder.unit_text(ids[at : at + m]) == coder.unit_text(new)
                out.append((len(ids), best[0][0], len(best), best[0][0] - best[1][0] if len(best) > 1 else None, hashlib.sha256(ids.tobytes()).hexdigest(), bool(good)))
            yield replaced(batch, ("text",), {n: pa.array([x[k] for x in out], kind) for k, (n, kind) in enumerate(DIGESTS.items())})

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_pieces long, best_score double, n_segmentations int, margin double, ids_sha256 string, round_trip boolean")
