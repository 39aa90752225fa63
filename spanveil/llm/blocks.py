"""Asking all blocks of a corpus about hashed keys, and answering each block.

Rows are put into blocks of some megabytes, whose rows stay together as one compressed value. A block asks
about its distinct keys, sorted, so that a key costs some five bytes; groups hold ranges of the key space
and answer each block key by key, in the order asked; the block then sees its rows and its answers. A key
that a third of all rows have is asked once for each block, so no group gets more for it than there are
blocks. Bounds of the groups are quantiles of keys that every block samples from all over its texts, so a
prefix of any length that would outgrow a group's memory is split.

Rows sent are blocks x groups, that is size^2 / (block_bytes * group_bytes): both grow with the executors'
memory on a larger cluster, which keeps a row at some kilobytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, sliced, tidy, written

def packed(values: np.ndarray) -> bytes:
    """Whole numbers, byte planes apart, compressed."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + len(values).to_bytes(5, "little") + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    width, n = raw[0], int.from_bytes(raw[1:6], "little")
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[6:]), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel().astype(U64, copy=False)


def joined(*arrays: np.ndarray) -> bytes:
    """Packed arrays, each behind its length."""
    return b"".join(len(raw).to_bytes(4, "little") + raw for raw in map(packed, arrays))


def parted(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 4], "little")
        out.append(unpacked(raw[at + 4 : at + 4 + size]).astype(np.int64))
        at += 4 + size
    return out


def packed_sorted(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=U64(0)))


def unpacked_sorted(raw: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(unpacked(raw), dtype=U64)


def enclosed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def opened(raw: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(raw).read_all().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)


def make_blocks(docs: DataFrame, census: Callable[[pa.RecordBatch], np.ndarray], block_bytes: int = 12 << 20, text: str = "text") -> DataFrame:
    """(block, bytes, census, rows): a table of blocks; census(rows of a block) gives keys that its own are spread like."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            nonlocal n, held, size
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            keys = pa.array([census(rows).astype(np.float64)], pa.list_(pa.float64()))
            out = pa.RecordBatch.from_arrays([pa.array([(part << 32) | n], pa.int64()), pa.array([size], pa.int64()), keys, pa.array([enclosed(rows)], pa.binary())], names=["block", "bytes", "census", "rows"])
            n, held, size = n + 1, [], 0
            return out

        for batch in batches:
            lengths = pc.binary_length(batch.column(text).cast(pa.large_string()).cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False) + 16
            at = 0
            for piece in sliced(batch, lengths, block_bytes):
                held.append(piece)
                size += int(lengths[at : at + piece.num_rows].sum())
                at += piece.num_rows
                if size >= block_bytes // 2:
                    yield block()
        if held:
            yield block()

    return written(docs.mapInArrow(run, "block long, bytes long, census array<double>, rows binary"), compression="none")


def windows(rows: pa.RecordBatch, text: str = "text", each: int = 4 << 10, every: int = 64 << 10) -> list[bytes]:
    """Pieces of the texts, one of `each` bytes in every `every` bytes of them all; only a census reads these."""
    out, at = [], 0
    for t in rows.column(text).to_pylist():
        if not t:
            continue
        raw = t.encode("utf-8", "surrogatepass")
        first = -(-at // every) * every - at  # the next multiple of `every` that falls into this text
        begin = at % every
        if begin < each:
            out.append(raw[: each - begin])
        out += [raw[i : i + each] for i in range(first, len(raw), every) if i or begin]
        at += len(raw) + 1
    return out


def group_bounds(blocks: DataFrame, group_bytes: int = 24 << 20) -> np.ndarray:
    """First keys of the groups but the first: quantiles of the census, so that groups hold the keys of about `group_bytes` of text each."""
    size = blocks.agg(F.sum("bytes")).first()[0] or 0
    groups = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // group_bytes))
    shares = F.array(*(F.lit(i / groups) for i in range(1, groups))) if groups > 1 else F.array(F.lit(0.0))
    found = blocks.select(F.explode("census").alias("key")).agg(F.percentile_approx("key", shares, F.lit(20 * groups)).alias("at")).first()["at"]
    return np.unique(np.array([min(int(x), (1 << 64) - 1) for x in found or []], U64))


Ask = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, Callable[[int, int], bytes]]]]


def questions(blocks: DataFrame, bounds: np.ndarray, ask: Ask) -> DataFrame:
    """(grp, block, kind, keys, extra): what each block asks of each group.

    ask(rows) gives for each kind sorted distinct keys with functions of a slice of them: what else to send for it.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(bounds)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = shared.value
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("rows"), strict=True):
                for kind, (keys, extra) in enumerate(ask(opened(raw.as_py()))):
                    rows = [(g, block, kind, packed_sorted(keys[a:b]), extra(a, b)) for g, a, b in by_group(keys, bounds)]
                    if rows:
                        g, b, k, keys_, extras = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(b, pa.int64()), pa.array(k, pa.int8()), pa.array(keys_, pa.binary()), pa.array(extras, pa.binary())], names=["grp", "block", "kind", "keys", "extra"])
                        del g, b, k, keys_, extras
                    del keys, extra, rows
                tidy()

    return blocks.select("block", "rows").mapInArrow(asked, "grp int, block long, kind byte, keys binary, extra binary")


def by_group(keys: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """(group, start, end) of the slices of sorted keys that groups hold, empty ones left out."""
    edges = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
    return [(g, a, b) for g, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]


def ask_all(blocks: DataFrame, bounds: np.ndarray, ask: Ask, answer: Callable, schema: str) -> DataFrame:
    """answer(group, [(block, kind, keys, extra)]) for each group, as batches of `schema`; ask as in `questions`."""

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list] = {}
        for batch in batches:
            for g, *rest in zip(*(batch.column(c).to_pylist() for c in ("grp", "block", "kind", "keys", "extra")), strict=True):
                rows.setdefault(g, []).append(rest)
        for g in list(rows):
            yield from answer(g, rows.pop(g))
            tidy()

    return questions(blocks, bounds, ask).repartitionById(len(bounds) + 1, F.col("grp")).mapInArrow(answered, schema)


def told(blocks: DataFrame, answers: DataFrame, finish: Callable[[pa.RecordBatch, dict], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """finish(rows of a block, {(grp, kind): answer}) for each block; answers has (block, grp, kind, answer)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = zip(*(right.column(c).to_pylist() for c in ("grp", "kind", "answer")), strict=True)
        parts = finish(opened(left.column("rows")[0].as_py()), {(g, k): a for g, k, a in keys})
        tidy()
        return pa.Table.from_batches([parts])

    return blocks.select("block", "rows").groupBy("block").cogroup(answers.select("block", "grp", "kind", "answer").groupBy("block")).applyInArrow(run, schema)
