"""Near copies: all pairs of texts whose shingle sets have a resemblance of 4/5 or more.

SimHash comes first: texts whose fingerprints are equal or differ in few bits are candidates, by the
generalised pigeonhole of simhash.py. A fingerprint of 64 bits can't promise a pair at 0.8 (it differs in ten
bits there, and no partition finds that cheaply), so a second way makes the result whole: the shingles of all
texts have one order, those that are frequent in a sample last; two sets with a resemblance of 4/5 share a
shingle among the first n // 5 + 1 of each, so every such pair meets under one of those, whatever the order.
All candidates of both ways are verified on whole sets.

Scale: equal sets are one node. Where many near copies meet, each is first verified against the one that the
shingle comes earliest in, the least changed of them; what these and the SimHash links connect needs no
further look. In the second round all pairs of different components meet, and bit maps of the sets bound what
they can share, so that few are verified that aren't links. Texts are hashed once: their packed sets are a table in the shared folder, of some
six bytes a shingle, and are shuffled only for nodes that meet others and few more, as a bit map of those nodes, of
bounded size, goes before the exact join. All tables are deleted when the answer is there.
A shingle's rows go through one task, in Arrow batches; the driver gets at most `most_hot` shingles of the
sample and SimHash's tables of fixed size.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import packed_sorted, unpacked_sorted
from .common import U64, by_key, cut, released, scratch, texts, tidy, words, written
from .components import components

#: bits of a set's map
MAP = 1024


def as_set(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes >> U64(16))


def node_of(own: np.ndarray) -> int:
    return int(np.array(xxhash.xxh64_intdigest(own.tobytes()), U64).view(np.int64))


def bit_map(own: np.ndarray) -> bytes:
    return np.packbits(np.bincount((own % U64(MAP)).astype(np.int64), minlength=MAP) & 1).tobytes()


def groups(arrays: Iterable[np.ndarray], length: Callable[[np.ndarray], int], most: int = 1 << 16) -> Iterator[list[np.ndarray]]:
    """Arrays in lists of about `most` entries."""
    held, n = [], 0
    for x in arrays:
        held.append(x)
        n += length(x)
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def sets(docs: DataFrame, size: int, folder: str | None = None) -> DataFrame:
    """(doc_id, node, map, fp, hashes): for each of MAP bits whether an odd number of the set's hashes falls on it; the SimHash of the text's shingles; the packed set.

    Texts are split and hashed here alone; the table is read again wherever sets are needed.
    """
    from .simhash import majority, shingle_hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
            hashes = [np.array(shingle_hashes(words(t), size), U64) for t in texts(batch)]
            own = list(map(as_set, hashes))
            prints = majority(np.concatenate(hashes), np.array([len(h) for h in hashes], np.int64))
            columns = [pa.array(map(node_of, own), pa.int64()), *(pa.array(c, pa.binary()) for c in (map(bit_map, own), (p.tobytes() for p in prints), map(packed_sorted, own)))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "node", "map", "fp", "hashes"])
        tidy()

    return written(docs.mapInArrow(run, "doc_id long, node long, map binary, fp binary, hashes binary"), folder, **{"parquet.block.size": str(16 << 20)})


def alike(own: DataFrame, radius: int) -> DataFrame:
    """(a, b): nodes whose fingerprints are equal, or linked within the radius."""
    from .simhash import links

    each = own.select("node", "fp").distinct()
    reps = cut(each.groupBy("fp").agg(F.min("node").alias("rep")))
    same = each.join(reps, "fp").where("node <> rep").select(F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b"))
    return same.unionByName(links(reps, 1, radius).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def hot_shingles(held: DataFrame, sample: int, most_hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) that several of about `sample` texts have, with how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in groups((unpacked_sorted(raw).astype(np.int64) for raw in batch.column("hashes").to_pylist()), len):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(some))], names=["h"])

    every = max(1, held.count() // sample)
    some = held.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("hashes").mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    found = some.where("n >= 4").orderBy(F.desc("n"), "h").limit(most_hot).toPandas().sort_values("h")
    return found["h"].to_numpy(np.int64).astype(U64), found["n"].to_numpy(np.int64)


def meetings(held: DataFrame, sample: int, most_hot: int, folder: str | None = None) -> DataFrame:
    """(h, n, node, at, hub): for shingles h that come early in several sets, the sets with their sizes and the place of h.

    hub is the set that h comes earliest in, null if the two can't be near copies.
    """
    shared = held.sparkSession.sparkContext.broadcast(hot_shingles(held, sample, most_hot))

    def early(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, seen = shared.value

        def first(node: int, raw: bytes) -> np.ndarray:
            own = unpacked_sorted(raw)
            n = len(own)
            count = np.zeros(n, np.int64)
            if len(hot):
                to = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
                count = np.where(hot[to] == own, seen[to], 0)
            h = own[np.lexsort((own, count))[: n // 5 + 1]].astype(np.int64)
            return np.stack([h, np.full(len(h), n), np.full(len(h), node), np.arange(len(h))])

        for batch in batches:
            distinct = dict(zip(*(batch.column(c).to_pylist() for c in ("node", "hashes")), strict=True))  # of copies in a batch, one is sent
            for some in groups(itertools.starmap(first, distinct.items()), lambda x: x.shape[1]):
                h, n, node, at = np.concatenate(some, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int32)), pa.array(node), pa.array(at.astype(np.int32))], names=["h", "n", "node", "at"])
            tidy()

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, "h"):
            h, node = table.column("h").to_numpy(), table.column("node").to_numpy()
            start = np.r_[True, h[1:] != h[:-1]]
            own = start | np.r_[True, node[1:] != node[:-1]]  # copies of a set come one after another
            group = np.cumsum(start) - 1
            keep = own & (np.bincount(group[own])[group] > 1)
            table = table.filter(pa.array(keep))
            h, n, node, place = (table.column(c).to_numpy().astype(np.int64) for c in ("h", "n", "node", "at"))
            if not len(h):
                continue
            group = ends(h)
            order = np.lexsort((node, place, group))
            start = np.r_[True, group[order][1:] != group[order][:-1]]
            hub = np.empty(len(h), np.int64)
            hub[order] = order[start][np.cumsum(start) - 1]
            far = ~possible(n, place, np.arange(len(h)), hub)
            yield from table.append_column("hub", pa.array(node[hub], mask=far)).to_batches()
        tidy()

    rows = held.select("node", "hashes").mapInArrow(early, "h long, n int, node long, at int").repartition(F.col("h")).sortWithinPartitions("h", "n", "node")
    return written(rows.mapInArrow(several, "h long, n int, node long, at int, hub long"), folder)


def by_shingle(met: DataFrame) -> DataFrame:
    return met.repartition(F.col("h")).sortWithinPartitions("h", "n", "node")


def ends(h: np.ndarray) -> np.ndarray:
    """For each row the end of its run of equal values."""
    edge = np.r_[np.flatnonzero(h[1:] != h[:-1]) + 1, len(h)]
    return edge[np.searchsorted(edge, np.arange(len(h)), side="right")]


def possible(n: np.ndarray, place: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows a and b can be near copies by their sizes and by what is left of them from the shingle on, if it is their first in common."""
    return (9 * np.minimum(n[a] - place[a], n[b] - place[b]) >= 4 * (n[a] + n[b])) & (a != b)


def unconnected(met: DataFrame) -> DataFrame:
    """Rows (h, n, node, at, component) under shingles that more than one component has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, "h"):
            h, group = table.column("h").to_numpy(), table.column("component").to_numpy()
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            mixed = np.minimum.reduceat(group, first) != np.maximum.reduceat(group, first)
            yield from table.filter(pa.array(np.repeat(mixed, np.diff(np.r_[first, len(h)])))).to_batches()

    return by_shingle(met).mapInArrow(run, "h long, n int, node long, at int, component long")


def pairs(met: DataFrame) -> DataFrame:
    """(a, b, m): all pairs of rows (h, n, node, at, component, map) under one shingle that may be near copies and aren't connected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, "h"):
            h, n, node, place, group = (table.column(c).to_numpy().astype(np.int64) for c in ("h", "n", "node", "at", "component"))
            maps = np.frombuffer(b"".join(table.column("map").to_pylist()), U64).reshape(len(h), -1)
            end, at, step = ends(h), np.arange(len(h)), 1
            while len(at):
                at = at[at + step < end[at]]
                at = at[5 * n[at] >= 4 * n[at + step]]  # sizes ascend, so later rows are too large as well
                hit = at[(group[at] != group[at + step]) & possible(n, place, at, at + step)]
                hit = hit[9 * np.bitwise_count(maps[hit] ^ maps[hit + step]).sum(axis=1, dtype=np.int64) <= n[hit] + n[hit + step]]
                a, b = node[hit], node[hit + step]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(n[hit] + n[hit + step])], names=["a", "b", "m"])
                step += 1

    return by_shingle(met).mapInArrow(run, "a long, b long, m long").distinct()


def maybe_among(rows: DataFrame, wanted: DataFrame, most_bits: int = 1 << 26) -> DataFrame:
    """All rows (node, hashes) of wanted nodes, and some others: under one in 64, or more where 64 places a node are over `most_bits`. Nodes are hashes."""
    bits = max(1 << 15, min(most_bits, 1 << (64 * wanted.count()).bit_length()))
    place = F.col("node").bitwiseAND(F.lit(bits - 1))
    parts = wanted.groupBy(F.shiftright(place, 15).alias("part")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    seen = np.zeros((bits >> 15, 1 << 12), np.uint8)
    for row in parts.collect():
        seen[row["part"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(seen.ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for batch in batches:
            at = batch.column("node").to_numpy() & (8 * len(seen) - 1)
            yield batch.filter(pa.array((seen[at >> 3] >> (at & 7) & 1).astype(bool)))
        tidy()

    return rows.select("node", "hashes").mapInArrow(run, "node long, hashes binary")


def verified(candidates: DataFrame, held: DataFrame, maps: DataFrame) -> DataFrame:
    """The candidates (a, b, and m: their sizes together) whose sets have a resemblance of 4/5 or more. Sets are read only for those that the maps allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = unpacked_sorted(x.as_py()), unpacked_sorted(y.as_py())
                near.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), U64).reshape(batch.num_rows, -1) for c in ("x", "y"))
            near = 9 * np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= batch.column("m").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(near))

    def beside(pairs_: DataFrame, own: DataFrame, column: str) -> DataFrame:
        one = pairs_.join(own.select(F.col("node").alias("a"), F.col(column).alias("x")), "a")
        return one.join(own.select(F.col("node").alias("b"), F.col(column).alias("y")), "b")

    with scratch(held.sparkSession) as folder:
        left = written(beside(candidates, maps, "map").select("a", "b", "m", "x", "y").mapInArrow(allowed, "a long, b long"), folder)
        wanted = written(left.select(F.explode(F.array("a", "b")).alias("node")).distinct(), folder)
        released(held.sparkSession)
        few = written(maybe_among(held, wanted).join(wanted, "node", "left_semi").dropDuplicates(["node"]), folder)
        released(held.sparkSession)
        return cut(beside(left, few, "hashes").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def near_copies(docs: DataFrame, size: int = 5, radius: int = 3, sample: int = 16_384, most_hot: int = 1 << 17) -> DataFrame:
    """(doc_id, component): the smallest doc_id that links of a resemblance of 4/5 or more reach. Rows with a null doc_id have none."""
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch(docs.sparkSession) as folder:
        held = sets(rows, size, folder)
        own = held.select("doc_id", "node", "fp")
        maps = written(held.select("node", "map").dropDuplicates(["node"]), folder)
        met = meetings(held, sample, most_hot, folder)
        released(docs.sparkSession)
        sizes = met.select("node", "n").distinct()
        stars = met.where("hub IS NOT NULL").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
        stars = stars.unionByName(alike(own, radius)).distinct()
        for end in ("a", "b"):
            stars = stars.join(sizes.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}")), end)
        links = verified(stars.withColumn("m", F.expr("CAST(n_a + n_b AS BIGINT)")), held, maps)
        group = cut(components(links))
        named = met.join(group, "node", "left").select("h", "n", "node", "at", F.coalesce("component", "node").alias("component"))
        left = unconnected(named).join(maps, "node")
        links = links.unionByName(verified(pairs(left), held, maps))
        joined = own.join(components(links), "node", "left").select("doc_id", F.coalesce("component", "node").alias("group"))
        least = joined.groupBy("group").agg(F.min("doc_id").alias("component"))
        return cut(joined.join(least, "group").select("doc_id", "component"))
