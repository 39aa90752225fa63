"""Exact substring deduplication over the paths of all suffixes, cut off at the depth of a window.

Every word position starts a suffix. Its path is a hash of its first words (8 bits, four words) and of the
whole window of 20 words (56 bits), so suffixes that begin alike lie together. Prefixes of paths, as long as
the census says, split the suffixes into groups that fit in memory; each group is sorted, and equal paths
are a node. Of a node with more than one leaf the first (smallest doc_id, then smallest start) stays, and
later ones are cut from their documents. Overlapping windows make maximal repeats, given as spans.

What this is not: a suffix tree whose edges hold words. Words would cost twenty times as much in the shuffle
as paths do. Two different windows of a corpus share a path with a probability of 2^-56 if they begin
with the same four words, and of 2^-64 else.

Scale: a block sends each distinct path once (about five bytes) with the first document that has it, and
gets one bit back; text is never shuffled beyond one pass of compressed blocks. A path that a third of all
documents share costs each block one entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ask_all, group_bounds, make_blocks, packed, told, unpacked, unpacked_sorted, windows
from .common import U64, ngram_hashes, word_hashes

LAST_ID = np.iinfo(np.int64).max


def paths(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window of words its path: 8 bits for the first four words, 56 for all."""
    whole = ngram_hashes(hashes, window)
    return (ngram_hashes(hashes, min(4, window))[: len(whole)] & ~U64((1 << 56) - 1)) | (whole >> U64(8))


class Block:
    """Windows and their paths of a block's rows, in the order of doc_id. Words are only held text by text: as objects they are ten times the text."""

    def __init__(self, rows: pa.RecordBatch, window: int, key: str = "doc_id"):
        ids = rows.column(key).fill_null(LAST_ID).to_numpy()
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]
        texts = rows.column("text").to_pylist()
        self.texts = [texts[i] for i in self.order]
        self.window = window

    def words(self, i: int) -> list[bytes]:
        return self.texts[i].encode("utf-8", "surrogatepass").split() if self.texts[i] else []

    def paths(self) -> None:
        """sizes in words; path, start (position among all words of the block) and row of each window; the distinct paths and where each comes first."""
        hashed = [word_hashes(self.words(i)) for i in range(len(self.texts))]
        self.sizes = np.array([len(h) for h in hashed], np.int64)
        every = paths(np.concatenate([np.empty(0, U64), *hashed]), self.window)
        del hashed
        ends = np.cumsum(self.sizes)
        n = np.maximum(self.sizes - self.window + 1, 0)
        self.row = np.repeat(np.arange(len(n)), n)
        self.start = np.arange(n.sum()) + np.repeat(ends - self.sizes - (np.cumsum(n) - n), n)
        self.path = every[self.start] if len(every) else every
        self.keys, self.first = np.unique(self.path, return_index=True)


def repeats(docs: DataFrame, window: int = 20, block_bytes: int = 6 << 20, group_bytes: int = 12 << 20, digest: bool = True, keep_columns: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, spans, and kept_sha256 (digest) or all columns of docs with the kept words as text (keep_columns).

    A word goes if a window of `window` words that covers it also starts earlier: in a smaller doc_id, or before in the same
    document. spans are the maximal runs of removed words, (first, end). A text that loses nothing stays as it is, white space
    included; others keep their words with one space between. Null and empty texts have no words. Documents of fewer words
    than a window lose nothing. Rows with a null id come last; of rows with one id the earlier one counts as first.
    """
    columns = docs.columns if keep_columns else ["doc_id", "text"]
    rows = docs.select(*columns).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))

    def census(rows: pa.RecordBatch) -> np.ndarray:
        some = [word_hashes(piece.split()) for piece in windows(rows)]
        return np.concatenate([paths(h, window)[::16] for h in some]) if some else np.empty(0, U64)

    def ask(rows: pa.RecordBatch):
        block = Block(rows, window)
        block.paths()
        ids, first_row = np.unique(block.ids, return_inverse=True)
        owner = first_row[block.row[block.first]] if len(block.first) else np.empty(0, np.int64)
        listed = ids.astype(U64)

        def extra(a: int, b: int) -> bytes:
            used, local = np.unique(owner[a:b], return_inverse=True)
            head = packed(np.diff(listed[used], prepend=U64(0)))
            return len(head).to_bytes(4, "little") + head + packed(local)

        yield block.keys, extra

    def answer(group: int, asked: list):
        paths, owners, blocks, sizes = [], [], [], []
        asked = sorted(asked, key=lambda r: r[0])
        for block, _, keys, extra in asked:
            n = int.from_bytes(extra[:4], "little")
            with np.errstate(over="ignore"):
                ids = np.cumsum(unpacked(extra[4 : 4 + n]), dtype=U64).view(np.int64)
            paths.append(unpacked_sorted(keys))
            owners.append(ids[unpacked(extra[4 + n :]).astype(np.int64)])
            sizes.append(len(paths[-1]))
            blocks.append(block)
        path, owner = np.concatenate(paths), np.concatenate(owners)
        # leaves of the subtree in order; of a node's leaves the first document's comes first, then the earlier block's
        order = np.argsort(path, kind="stable")
        sorted_ = path[order]
        node = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
        size = np.diff(np.r_[node, len(sorted_)])
        later = np.zeros(len(path), bool)
        deep = np.flatnonzero(np.repeat(size > 1, size))
        if len(deep):
            of = np.repeat(np.arange(len(node)), size)[deep]
            leaf = order[deep]
            best = np.lexsort((leaf, owner[leaf], of))
            ranked = of[best]
            later[leaf[best[np.flatnonzero(np.r_[False, ranked[1:] == ranked[:-1]])]]] = True
        edges = np.cumsum([0, *sizes])
        masks = [np.packbits(later[a:b], bitorder="little").tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([group] * len(blocks), pa.int32()), pa.array([0] * len(blocks), pa.int8()), pa.array(masks, pa.binary())], names=["block", "grp", "kind", "answer"])

    blocks = make_blocks(rows, census, block_bytes)
    bounds = group_bounds(blocks, group_bytes)
    answers = ask_all(blocks, bounds, ask, answer, "block long, grp int, kind byte, answer binary")
    shared = docs.sparkSession.sparkContext.broadcast(bounds)

    def finish(rows: pa.RecordBatch, masks: dict) -> pa.RecordBatch:
        block = Block(rows, window)
        block.paths()
        later = np.zeros(len(block.keys), bool)
        edges = [0, *np.searchsorted(block.keys, shared.value).tolist(), len(block.keys)]
        for g, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if b > a:
                later[a:b] = np.unpackbits(np.frombuffer(masks[g, 0], np.uint8), count=b - a, bitorder="little")
        cut = np.ones(len(block.path), bool)
        cut[block.first[~later]] = False
        total = int(block.sizes.sum())
        covered = np.zeros(total + 1, np.int64)
        np.add.at(covered, block.start[cut], 1)
        np.subtract.at(covered, block.start[cut] + window, 1)
        gone = np.cumsum(covered)[:total] > 0
        ends = np.cumsum(block.sizes)
        removed, spans, kept, digests = [], [], [], []
        for i in range(len(block.texts)):
            words = block.words(i)
            mine = gone[ends[i] - len(words) : ends[i]]
            n = int(mine.sum())
            removed.append(n)
            edge = np.flatnonzero(np.diff(np.r_[False, mine, False])) if n else ()
            spans.append([{"first": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            left = words if not n else [w for w, g in zip(words, mine.tolist(), strict=True) if not g]
            if keep_columns:
                kept.append(block.texts[i] if not n else b" ".join(left).decode("utf-8", "surrogatepass"))
            if digest:
                digests.append(hashlib.sha256(b" ".join(left)).hexdigest())
        out = rows.take(pa.array(block.order))
        if keep_columns:
            at = out.schema.get_field_index("text")
            out = out.set_column(at, "text", pa.array(kept, out.schema.field(at).type))
            return out
        data = {"doc_id": out.column("doc_id"), "n_words": pa.array(block.sizes), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))}
        if digest:
            data["kept_sha256"] = pa.array(digests, pa.string())
        return pa.RecordBatch.from_pydict(data)

    schema = rows.schema if keep_columns else "doc_id long, n_words long, n_removed long, spans array<struct<first:long,end:long>>" + (", kept_sha256 string" if digest else "")
    return told(blocks, answers, finish, schema)


def without_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """All rows and columns of docs; text without the words that `repeats` removes."""
    return repeats(docs, window, digest=False, keep_columns=True)
