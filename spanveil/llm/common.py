"""Text splitting, hashing and table helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes 0x41-0x5A to 0x61-0x7A; bytes.split() then cuts at 0x20 and 0x09-0x0D, as the contracts ask
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or the one set on the context.

    Where neither is set, one under the warehouse is, which is shared as well; a machine's own temporary folder never.
    """
    context = spark.sparkContext
    named, given = spark.conf.get("spark.checkpoint.dir", None), context._jsc.sc().getCheckpointDir()
    if given.isEmpty():
        context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints")
    return named or context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from the shared folder: lineage ends here and lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, folder: str | None = None, **options: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder, or in one of `scratch`, for wide binary rows."""
    spark = df.sparkSession
    path = f"{(folder or shared_dir(spark)).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Shuffle files of jobs that are done go now. Spark deletes them when the driver collects its garbage, which a driver with little to do seldom does."""
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder in the shared one that is deleted at the end of the block. What outlives the block must be cut in it."""
    folder = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        released(spark)


def fold(key: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo parts; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(parts))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of a text; none for null."""
    return text.encode("utf-8", "replace").translate(LOWER).split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), dtype=U64, count=len(tokens))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive word hashes; order counts."""
    if len(h) < n:
        return np.empty(0, U64)
    out = np.zeros(len(h) - n + 1, U64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * U64(0x9E3779B97F4A7C15) + h[i : i + len(out)]
    return mix(out)


def spread(lengths: np.ndarray) -> np.ndarray:
    """0..length-1 for each length, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links a-b: (member, smallest member of its group) for all that aren't the smallest."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        if (root[x] == low).all() and (root[y] == low).all():
            break
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def by_key(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches that are sorted by key. Memory: a batch and a group."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        start = int(np.searchsorted(k, k[-1]))
        if start:
            rest.append(batch.slice(0, start))
            yield pa.Table.from_batches(rest).combine_chunks()
            rest = []
        elif rest and rest[0].column(key)[0].as_py() != k[0]:
            yield pa.Table.from_batches(rest).combine_chunks()
            rest = []
        rest.append(batch.slice(start))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def tidy() -> None:
    """Memory that this worker has freed goes back to the machine; a reused worker would else keep its largest moment."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(name).to_pylist()


def sliced(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of about so many bytes each; one row at least."""
    if not batch.num_rows:
        return
    group = (np.cumsum(sizes) - sizes) // most
    for start, end in itertools.pairwise([0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]):
        yield batch.slice(start, end - start)
