"""Benchmark decontamination by SimHash windows.

Each benchmark item has a fingerprint of its weighted shingles (five words; a shingle's weight is its
inverse frequency among the items). A document is looked at in windows of as many words as an item has;
only windows that hold some shingle of an item of that size can come near one, so others are skipped. A
multi-index of eight 8-bit blocks, each filed under all values within two bits, finds all items whose
fingerprints are within `radius` bits of a window's (23 at most are guaranteed). Candidates are verified by
their exact weighted resemblance, the sum of smaller over the sum of larger shingle weights.

Scale: documents are read once, without a shuffle. The items' index is broadcast in slices of checked size
(`slice_bytes` of text); a benchmark of many slices takes as many passes.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, ngram_hashes, texts, word_hashes, words

SHINGLE, BLOCKS, BLOCK_RADIUS = 5, 8, 2
NEAR = np.array([v for v in range(256) if v.bit_count() <= BLOCK_RADIUS])


def fingerprint(hashes: np.ndarray, weights: np.ndarray) -> int:
    """Bits that carry over half of the weight."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(weights @ bits * 2 > weights.sum(), bitorder="little").view(U64)[0])


class Index:
    """Items by size, with their shingles, weights and fingerprints."""

    def __init__(self, items: list[tuple[int, str | None]]):
        kept = [(i, word_hashes(words(t))) for i, t in items]
        self.short = defaultdict(list)  # items of fewer words than a shingle: whole documents only
        for i, h in kept:
            if 0 < len(h) < SHINGLE:
                self.short[tuple(h.tolist())].append(i)
        kept = [(i, ngram_hashes(h, SHINGLE), len(h)) for i, h in kept if len(h) >= SHINGLE]
        often = Counter(x for _, s, _ in kept for x in set(s.tolist()))
        self.rare = float(np.log1p(len(kept)))
        self.weight = {x: float(np.log1p(len(kept) / n)) for x, n in often.items()}
        self.ids = [i for i, _, _ in kept]
        self.counts = [Counter(s.tolist()) for _, s, _ in kept]
        self.sizes = np.array([n for _, _, n in kept], np.int64)
        self.prints = [fingerprint(s, self.weights(s)) for _, s, _ in kept]
        self.shingles = np.array(sorted(often), U64)
        self.holders = defaultdict(set)  # shingle -> sizes of the items that have it
        for counts, n in zip(self.counts, self.sizes.tolist(), strict=True):
            for x in counts:
                self.holders[x].add(n)
        self.blocks: dict[int, list[dict[int, list[int]]]] = {}
        for at, (print_, n) in enumerate(zip(self.prints, self.sizes.tolist(), strict=True)):
            files = self.blocks.setdefault(n, [defaultdict(list) for _ in range(BLOCKS)])
            for b in range(BLOCKS):
                for value in ((print_ >> 8 * b & 255) ^ NEAR).tolist():
                    files[b][value].append(at)

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        return np.array([self.weight.get(x, self.rare) for x in shingles.tolist()])

    def resemblance(self, at: int, shingles: np.ndarray) -> float:
        own, other = self.counts[at], Counter(shingles.tolist())
        low = high = 0.0
        for x in own.keys() | other.keys():
            w = self.weight.get(x, self.rare)
            low += w * min(own[x], other[x])
            high += w * max(own[x], other[x])
        return low / high if high else 0.0

    def hits(self, text: str | None, radius: int, least: float) -> dict[int, tuple[float, int, int]]:
        """item -> (resemblance, first word, words) of its best window."""
        tokens = words(text)
        if not tokens:
            return {}
        h = word_hashes(tokens)
        out = {i: (1.0, 0, len(h)) for i in self.short.get(tuple(h.tolist()), ())} if len(h) < SHINGLE else {}
        shingles = ngram_hashes(h, SHINGLE)
        if not len(self.shingles) or not len(shingles):
            return out
        at = np.searchsorted(self.shingles, shingles)
        at[at == len(self.shingles)] = 0
        met = np.flatnonzero(self.shingles[at] == shingles)
        if not len(met):
            return out
        by_size: dict[int, list[int]] = defaultdict(list)
        for p in met.tolist():
            for n in self.holders[int(shingles[p])]:
                by_size[n].append(p)
        for n, places in by_size.items():
            width = n - SHINGLE + 1  # shingles of a window
            # a window short of half the shingles met can't reach 0.5, let alone more
            count = np.zeros(len(shingles) + 1, np.int64)
            count[np.array(places) + 1] = 1
            total = np.cumsum(count)
            starts = np.arange(max(1, len(shingles) - width + 1))
            full = total[np.minimum(starts + width, len(shingles))] - total[starts]
            for s in starts[full >= 0.5 * least * width].tolist():
                window = shingles[s : s + width]
                print_ = fingerprint(window, self.weights(window))
                candidates = {c for b, file in enumerate(self.blocks[n]) for c in file.get(print_ >> 8 * b & 255, ())}
                for c in candidates:
                    if (self.prints[c] ^ print_).bit_count() <= radius:
                        found = self.resemblance(c, window)
                        if found >= least and found > out.get(self.ids[c], (0.0,))[0]:
                            out[self.ids[c]] = (found, s, len(window) + SHINGLE - 1)
        return out


def slices(benchmark: DataFrame, slice_bytes: int) -> Iterator[list[tuple[int, str | None]]]:
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // slice_bytes))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, radius: int = 20, slice_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: the best window of each document for each item it comes near (`least` or more).

    Words are lower-cased (A-Z). Documents and items without words match nothing. An item of fewer than five words matches only a
    document of the same words. Repeated items and documents keep their rows; null ids are kept. Other columns are ignored.
    """
    out = None
    for items in slices(benchmark, slice_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            for batch in batches:
                rows, known = [], {}
                for i, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                    if text not in known:
                        known[text] = index.hits(text, radius, least)
                    rows += [(i, item, *found) for item, found in known[text].items()]
                if rows:
                    columns = zip(*rows, strict=True)
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, item_id long, similarity double, first_word long, n_words long")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, radius: int = 20, slice_bytes: int = 32 << 20) -> DataFrame:
    """The rows of docs that come near no benchmark item, all columns as they were."""
    for items in slices(benchmark, slice_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            for batch in batches:
                yield batch.filter(pa.array([not index.hits(t, radius, least) for t in texts(batch)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
