"""Language-model scores from a log-frequency Bloom filter of word n-grams, orders 1 to 3.

Counts of all n-grams of the training rows are quantised to powers of two, level 1 for one seen once, and an
n-gram of level q is filed in the filter under (n-gram, 1) to (n-gram, q); a reader probes level after level
until one is missing. A level q stands for the middle v(q) of the counts that it covers. With the mass
S(h) = sum of v over the words that follow a history h and T(h), how many those are,

    P(w | h) = (v(h w) + T(h) * P(w | h without its first word)) / (S(h) + T(h)),
    P(w) = (v(w) + 0.1) / (S + 0.1 * (V + 1)),

where the last word of the V + 1 is any unknown one. S and T are sums over each history's own n-grams as the
filter gives their levels, so the probabilities after every history add up to one but for what the filter
wrongly has of n-grams never seen (one probe in 1,700).

Scale: the filter follows the corpus, so it is not broadcast. Its segments hold ranges of the key space,
each in the task that counts the range; blocks of the corpus ask a segment about their distinct n-grams
(see blocks.py), and it answers from its bits. Keys begin with 40 bits of the history, so a segment knows
its histories' masses; a history with more successors than a segment holds lies in several, and such sums
are put together from two histories a segment. The driver gets those, and nothing else of the corpus.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ask_all, by_group, group_bounds, joined, make_blocks, packed, parted, told, unpacked, unpacked_sorted, windows
from .common import LOWER, U64, mix, word_hashes, written

#: the hash of a text's end, which is also what stands before its first word; no word holds a space
END = word_hashes([b" end"])[0]
ORDERS = 3
PROBES = 8
#: bits of a key that name the word after the history
TAIL = 24


class Tokens:
    """Tokens of a block's rows: hashes, row and fold."""

    def __init__(self, rows: pa.RecordBatch, parts: int, held: int):
        self.ids = rows.column("doc_id").to_pylist()
        split = [t.encode("utf-8", "replace").translate(LOWER).split() if t else [] for t in rows.column("text").to_pylist()]
        self.sizes = np.array([len(w) + 1 for w in split], np.int64)
        ends = np.cumsum(self.sizes)
        self.first = ends - self.sizes
        self.hash = np.full(ends[-1] if len(ends) else 0, END, U64)
        inside = np.ones(len(self.hash), bool)
        inside[ends - 1] = False
        self.hash[inside] = word_hashes([w for words in split for w in words])
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.held_out = np.array([zlib.crc32(str(i).encode() if i is not None else b"") % parts == held for i in self.ids], bool)
        self.train = ~self.held_out[self.row]

    def keys(self, order: int) -> np.ndarray:
        return ngram_keys(self.hash, self.first, order)


def ngram_keys(hashes: np.ndarray, first: np.ndarray, order: int) -> np.ndarray:
    """A key for the n-gram that ends at each token: 40 bits of its history's hash, then 24 of its own. `first`: where texts begin."""
    if order == 1 or not len(hashes):
        return mix(hashes)
    history = np.zeros(len(hashes), U64)
    with np.errstate(over="ignore"):
        for back in range(order - 1, 0, -1):
            before = np.r_[np.full(min(back, len(hashes)), END, U64), hashes[:-back]]
            for i in range(back):  # tokens whose neighbour so far back is in another text
                at = first + i
                before[at[at < len(hashes)]] = END
            history = history * U64(0x9E3779B97F4A7C15) + mix(before)
        history = mix(history + U64(order))
        own = mix(history + mix(hashes))
    return (history & ~U64((1 << TAIL) - 1)) | (own >> U64(64 - TAIL))


def levels(counts: np.ndarray) -> np.ndarray:
    """1 for 1, 2 for 2 and 3, 3 for 4 to 7, and so on; 0 for 0."""
    return np.where(counts > 0, 1 + np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64), 0)


def worth(level: np.ndarray) -> np.ndarray:
    """Twice the middle of the counts of a level, a whole number: 2, 5, 11, 23, ...; 0 for level 0."""
    return np.where(level > 0, 3 * (1 << np.maximum(level - 1, 0)) - 1, 0)


class Filter:
    """A segment of the filter: bits for (key, level) pairs."""

    def __init__(self, keys: np.ndarray, level: np.ndarray, bits_each: int = 16):
        self.size = max(64, int(level.sum()) * bits_each)
        self.deepest = int(level.max(initial=0))
        bits = np.zeros(self.size, bool)
        for q in range(1, self.deepest + 1):
            some = keys[level >= q]
            for probe in range(PROBES):
                bits[self.slot(some, q, probe)] = True
        self.bits = np.packbits(bits, bitorder="little")

    def slot(self, keys: np.ndarray, level: int, probe: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            one = mix(keys + U64(level) * U64(0x9E3779B97F4A7C15))
            return (((one + U64(probe) * (mix(one) | U64(1))) >> U64(1)) % U64(self.size)).astype(np.int64)

    def level(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key: the last one that the filter has, 0 for none. Never too low."""
        out = np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        for level in range(1, self.deepest + 1):
            for probe in range(PROBES):
                bit = self.slot(keys[left], level, probe)
                left = left[(self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0]
            if not len(left):
                break
            out[left] = level
        return out


def runs(histories: np.ndarray) -> np.ndarray:
    """Whether a sorted value is the first of its kind."""
    return np.r_[True, histories[1:] != histories[:-1]] if len(histories) else np.empty(0, bool)


def scores(docs: DataFrame, parts: int = 10, held: int = 0, bits_each: int = 16, block_bytes: int = 8 << 20, group_bytes: int = 12 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    Learns from rows whose crc32(doc_id) mod parts isn't `held`. Null and empty texts have one token, their end. A null id counts
    as the empty text for the fold. Repeated rows count as often as they occur. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def census(batch: pa.RecordBatch) -> np.ndarray:
        some = [word_hashes(piece.translate(LOWER).split()) for piece in windows(batch)]
        first = np.cumsum([0, *(len(h) for h in some)])[:-1]
        flat = np.concatenate(some) if some else np.empty(0, U64)
        return np.concatenate([ngram_keys(flat, first, order)[::16] for order in range(1, ORDERS + 1)])

    def ask(batch: pa.RecordBatch):
        own = Tokens(batch, parts, held)
        for order in range(1, ORDERS + 1):
            keys, at = np.unique(own.keys(order), return_inverse=True)
            counts = np.bincount(at[own.train], minlength=len(keys))
            del at
            yield keys, lambda a, b, counts=counts: packed(counts[a:b])

    def answer(group: int, asked: list):
        out = []
        for kind in range(ORDERS):
            mine = [(block, unpacked_sorted(keys), unpacked(extra).astype(np.int64)) for block, k, keys, extra in asked if k == kind]
            if not mine:
                continue
            keys, at = np.unique(np.concatenate([k for _, k, _ in mine]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([c for _, _, c in mine])).astype(np.int64)
            known = counts > 0
            level = Filter(keys[known], levels(counts[known]), bits_each).level(keys)
            mass = worth(level) * known
            edges = np.cumsum([0, *(len(k) for _, k, _ in mine)])
            slices = [(block, at[a:b]) for (block, _, _), a, b in zip(mine, edges[:-1], edges[1:], strict=True)]
            if kind == 0:
                out += [(block, group, kind, joined(level[i], counts[i])) for block, i in slices]
                out.append((-1, group, kind, joined(np.array([counts.sum(), known.sum(), mass.sum()]))))
            else:
                history = keys >> U64(TAIL)
                start = np.flatnonzero(runs(history))
                of = np.cumsum(runs(history)) - 1
                total, kinds = np.add.reduceat(mass, start), np.add.reduceat(known.astype(np.int64), start)
                for block, i in slices:
                    h = of[i][runs(of[i])]
                    out.append((block, group, kind, joined(level[i], kinds[h], total[h] - 2 * kinds[h])))
                ends = np.unique([0, len(start) - 1])  # others lie in this group alone
                out.append((-1, group, kind, joined(history[start[ends]], kinds[ends], total[ends])))
        b, g, k, a = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(g, pa.int32()), pa.array(k, pa.int8()), pa.array(a, pa.binary())], names=["block", "grp", "kind", "answer"])

    blocks = make_blocks(rows, census, block_bytes)
    bounds = group_bounds(blocks, group_bytes)
    answers = written(ask_all(blocks, bounds, ask, answer, "block long, grp int, kind byte, answer binary"))
    shared = docs.sparkSession.sparkContext.broadcast(totals(answers) | {"bounds": bounds})

    def finish(batch: pa.RecordBatch, told_: dict) -> pa.RecordBatch:
        model = shared.value
        n_train, vocabulary, whole = model["tokens"], model["kinds"], model["mass"]
        own = Tokens(batch, parts, held)
        n = len(own.sizes)
        keys, at = np.unique(own.keys(1), return_inverse=True)
        level, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for g, a, b in by_group(keys, model["bounds"]):
            level[a:b], count[a:b] = parted(told_[g, 0])
        c = count[at]
        base = np.bincount(own.row, np.log10((c + 0.1) / (n_train + 0.1 * (vocabulary + 1))), n)
        known = np.bincount(own.row, c > 0, n).astype(np.int64)
        p = ((worth(level) + 0.2) / (whole + 0.2 * (vocabulary + 1)))[at]
        seen = None
        for kind in range(1, ORDERS):
            keys, at = np.unique(own.keys(kind + 1), return_inverse=True)
            level, after, mass = (np.zeros(len(keys), np.int64) for _ in range(3))
            for g, a, b in by_group(keys, model["bounds"]):
                run = np.cumsum(runs(keys[a:b] >> U64(TAIL))) - 1
                level[a:b], kinds, rest = parted(told_[g, kind])
                after[a:b], mass[a:b] = kinds[run], (rest + 2 * kinds)[run]
            cut, kinds, total = model["cut"][kind]
            if len(cut):
                to = np.minimum(np.searchsorted(cut, keys >> U64(TAIL)), len(cut) - 1)
                hit = cut[to] == keys >> U64(TAIL)
                after[hit], mass[hit] = kinds[to[hit]], total[to[hit]]
            level, after, mass = level[at], after[at], mass[at]
            level = np.where(after > 0, level, 0)
            if seen is not None:
                level = np.where(seen, level, 0)  # an n-gram whose end was never seen was never seen
            seen = level > 0
            p = np.where(after > 0, (np.minimum(worth(level), mass) + 2 * after * p) / np.maximum(mass + 2 * after, 1), p)
        score = np.bincount(own.row, np.log10(p), n)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(own.held_out), pa.array(own.sizes), pa.array(known), pa.array(np.full(n, n_train, np.int64)), pa.array(base), pa.array(score)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return told(blocks, answers.where("block >= 0"), finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def totals(answers: DataFrame) -> dict:
    """Tokens, kinds and mass of all words; for each order the histories at the ends of segments, sorted, with their kinds and mass over all segments.

    The driver gets a row for each segment and order.
    """
    whole = np.zeros(3, np.int64)
    ends: list[list[tuple]] = [[] for _ in range(ORDERS)]
    for row in answers.where("block < 0").select("kind", "answer").toLocalIterator():
        if row["kind"] == 0:
            whole += parted(bytes(row["answer"]))[0]
        else:
            ends[row["kind"]] += zip(*parted(bytes(row["answer"])), strict=True)
    cut = []
    for found in ends:
        h, kinds, mass = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        at, inverse = np.unique(h, return_inverse=True)
        sums = [np.zeros(len(at), np.int64) for _ in range(2)]
        np.add.at(sums[0], inverse, kinds)
        np.add.at(sums[1], inverse, mass)
        cut.append((at.astype(U64), *sums))
    return {"tokens": int(whole[0]), "kinds": int(whole[1]), "mass": int(whole[2]), "cut": cut}
