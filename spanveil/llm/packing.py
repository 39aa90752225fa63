"""Hierarchical packing of documents into windows of several lengths.

Documents are tokenised, ended with a token and cut at 2,048 where they are longer. What is left of each is
routed to the smallest tier (256, 512, 1,024, 2,048) that holds it. Tiers are packed from the longest down:
a window takes the longest document that is left in its tier, then the longest that fits from its own and
shorter tiers, and where none fits, the head of the shortest one, so that it is full. What cannot fill a
window at the end of a unit is cut at powers of two. Sequences of a tier are dealt to step groups of
equally many tokens.

Scale: a unit is about a million tokens of one partition, packed in memory; there is no shuffle, and a lost
task is packed again from its own rows.
"""

from __future__ import annotations

import base64
import re
import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

TIERS = (256, 512, 1024, 2048)
#: what both tokenizer libraries cut alike; other texts go to `tokenizers`
PLAIN = re.compile("[^\x00-\x1b\x20-ɏ‐-‧‰-⁞€]")


def encoder(vocabulary: str = "byte_bpe_50k") -> Callable[[str], list[int]]:
    """text -> ids as `tokenizers` gives them, without special tokens added.

    vocabulary: the name of a public tokenizer, or the path of a tokenizers file. For the public one, `tiktoken` reads the same
    vocabulary as ranks, several times faster; texts with rare characters or the name of a special token go to `tokenizers`.
    """
    import public_tokenizers
    from tokenizers import Tokenizer

    if vocabulary.endswith(".json"):
        own = Tokenizer.from_file(vocabulary)
        return lambda text: own.encode(text, add_special_tokens=False).ids
    import tiktoken

    own = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if PLAIN.search(text) or "<|" in text:
            return own.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def pack_unit(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold each token of documents of these lengths once."""
    top = tiers[-1]
    done, waiting = [], []
    for doc, n in enumerate(lengths):
        whole = n // top
        done += [[(doc, k * top, top)] for k in range(whole)]
        if n > whole * top:
            waiting.append((n - whole * top, doc, whole * top))
    waiting.sort()
    for size, below in zip(reversed(tiers), [*reversed(tiers[:-1]), 0], strict=True):
        while waiting and waiting[-1][0] > below:
            window, room = [], size
            while room and waiting:
                at = bisect_right(waiting, (room, len(lengths), 0)) - 1
                if at >= 0:
                    n, doc, start = waiting.pop(at)
                    window.append((doc, start, n))
                    room -= n
                else:
                    n, doc, start = waiting.pop(0)
                    window.append((doc, start, room))
                    insort(waiting, (n - room, doc, start + room))
                    room = 0
            done += [window] if not room else powers(window)
    return done


def powers(window: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A window that isn't full, cut into sequences whose lengths are powers of two."""
    out, left = [], sum(n for _, _, n in window)
    pieces = list(reversed(window))
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out.append([])
        while room:
            doc, start, n = pieces.pop()
            out[-1].append((doc, start, min(n, room)))
            if n > room:
                pieces.append((doc, start + room, n - room))
            room -= min(n, room)
    return out


def balanced(sizes: list[int], step_tokens: int) -> list[int]:
    """A step group for each sequence: as many groups as come nearest to step_tokens each, the longest sequences first, each to the group with the fewest tokens."""
    groups = [(0, g) for g in range(max(1, round(sum(sizes) / step_tokens)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        held, g = groups[0]
        heapq.heapreplace(groups, (held + sizes[i], g))
        out[i] = g
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step long"


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k", end: int = 1, unit_tokens: int = 1 << 20, step_tokens: int = 1 << 16, ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step for each piece; with `ids` also the piece's ids.

    Null texts are empty: one piece of the end token. Null and repeated ids are packed like others, each row for itself.
    Step groups (step) share out the sequences of one unit, about `step_tokens` each and apart by one sequence at most. Other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary), TaskContext.get().partitionId()
        names, bodies, held, unit = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal names, bodies, held, unit
            rows, base = [], (part << 36) | (unit << 20)
            packed = pack_unit([len(b) // 4 for b in bodies])
            sizes = [sum(n for _, _, n in sequence) for sequence in packed]
            for at, (sequence, size, step) in enumerate(zip(packed, sizes, balanced(sizes, step_tokens), strict=True)):
                offset, tier = 0, next((t for t in TIERS if size <= t), TIERS[-1])
                for doc, start, n in sequence:
                    body = bodies[doc][4 * start : 4 * (start + n)]
                    rows.append((names[doc], start, n, zlib.crc32(body), len(bodies[doc]) // 4, base + at, offset, tier, base + step, body))
                    offset += n
            names, bodies, held, unit = [], [], 0, unit + 1
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
            fields = [x.split()[0] for x in SCHEMA.split(", ")]
            if ids:
                arrays.append(pa.array([np.frombuffer(b, "<u4").astype(np.int32) for b in columns[9]], pa.list_(pa.int32())))
                fields.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=fields)

        for batch in batches:
            known: dict[str, bytes] = {}
            for name, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                text = text or ""
                if (body := known.get(text)) is None:
                    body = known[text] = np.array([*encode(text), end], "<u4").tobytes()
                names.append(name)
                bodies.append(body)
                held += len(body) // 4
                if held >= unit_tokens or len(names) >= 1 << 18:
                    yield flush()
        if names:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA + (", ids array<int>" if ids else ""))
