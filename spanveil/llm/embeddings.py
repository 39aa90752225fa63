"""Embedding near-duplicates by product quantisation.

Unit vectors go to the nearest of k coarse centroids, about 2 sqrt(n) of them; what is left of each is cut
into subspaces and coded, one byte for each, and the codes are stored beside the vectors. A vector probes the
lists whose side of the bisector between their centroid and its own is within `reach` of the link distance,
and a link counts for both ends as soon as one of them finds it. Of two linked vectors in different lists one
is at most half the link distance from the bisector, so a reach of 0.5 finds every link for certain; 0.3 is
enough unless two vectors differ along the line between two centroids and hardly elsewhere. In a list,
distances are looked up in tables of the query against the stored codes; a member is a candidate unless its
distance less its own coding error is over the link distance, so no candidate is lost there. Cosines of
candidates are then computed from the vectors in double precision.

Scale: equal vectors are one class with a count, so copies cost nothing. Centroids and codes are trained on
a sample of `sample` vectors, or four a list beyond some four million; every vector is indexed. Lists and
their probes are dealt to pairs of chunks by their counts, and a unit sends link counts and a spanning
forest, never pairs. Vectors of floats are sent as floats. Work grows as n sqrt(n).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, by_key, cut, mix, spread, star_forest
from .components import components


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        order = np.argsort(own, kind="stable")
        used, first = np.unique(own[order], return_index=True)
        centres[used] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.r_[first, len(x)])[:, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(half - x[i : i + 2048] @ centres.T).argmin(axis=1) for i in range(0, len(x), 2048)]) if len(x) else np.empty(0, np.int64)


def unit_rows(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of length one; the largest component is divided out first, so that none is too small or too large to square."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, initial=0)[:, None]
    return x / np.sqrt((x**2).sum(axis=1))[:, None]


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, sample: int = 16_384, reach: float = 0.3, chunk: int = 2048, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row.

    Null and zero vectors and those with null or non-finite components link with nothing; vectors of different lengths don't
    link (each length is a plan of its own). Repeated ids count as vectors of their own. A null id keeps its row, but links
    nothing. Other columns are ignored.
    """
    kind = "<f4" if vectors.schema[column].dataType.elementType.typeName() == "float" else "<f8"

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("v").to_pylist():
                x = np.array(v if v and None not in v else [], kind)
                out.append((x + np.zeros(1, kind)).tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)  # adding zero makes -0 and 0 one
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "raw"])

    rows = cut(vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<float>" if kind == "<f4" else "array<double>").alias("v")).mapInArrow(raw, "id long, raw binary"))
    # a class of equal vectors is numbered, not named by an id, which others may have
    reps = cut(rows.where("id IS NOT NULL AND raw IS NOT NULL").groupBy("raw").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).withColumn("rep", F.monotonically_increasing_id()))
    width = np.dtype(kind).itemsize
    parts = [linked(reps.where(F.octet_length("raw") == size), size // width, kind, cosine, sample, reach, chunk) for size in sorted(r[0] for r in reps.select(F.octet_length("raw")).distinct().collect())]
    found = vectors.sparkSession.createDataFrame([], "a long, b long, links long")
    for part in parts:
        found = found.unionByName(part)
    found = cut(found)
    group = components(found.where("b IS NOT NULL").select("a", "b"))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    known = cut(reps.join(counts, "rep", "left").join(group.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("raw").alias("raw_"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("group"), "least"
    ))
    named = known.groupBy("group").agg(F.min("least").alias("component_id"))
    out = rows.join(known.join(named, "group"), (rows.raw == F.col("raw_")) & rows.id.isNotNull(), "left")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def linked(reps: DataFrame, dims: int, kind: str, cosine: float, sample: int, reach: float, chunk: int) -> DataFrame:
    """(a, b, links): links of class a to rows of other classes (b null), and a spanning forest a-b (links null)."""
    context = reps.sparkSession.sparkContext
    n = reps.count()
    lists = int(max(1, 2 * n**0.5))
    share = min(1.0, max(sample, 4 * lists) / max(1, n))
    fit = unit_rows([bytes(r[0]) for r in reps.where(F.pmod(F.xxhash64("raw"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("raw").orderBy("raw").collect()], kind)
    if not len(fit):
        fit = unit_rows([bytes(r[0]) for r in reps.limit(1).select("raw").collect()], kind)
    k = int(min(lists, max(1, len(fit) // 4)))
    centres = kmeans(fit, k)
    rest = fit - centres[nearest(fit, centres)]
    cuts = np.linspace(0, dims, min(8, dims) + 1).astype(int)
    books = [kmeans(rest[:, a:b], min(64, len(rest))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    limit = (2 - 2 * cosine) ** 0.5
    shared = context.broadcast((centres, books, cuts))

    def own_and_probed(x: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        centres, _, _ = shared.value
        squares = (centres**2).sum(axis=1)
        apart = squares - 2 * x @ centres.T
        own = apart.argmin(axis=1) if own is None else own
        gap = np.sqrt(np.maximum(squares + squares[own][:, None] - 2 * centres[own] @ centres.T, 1e-12))
        side = (apart - apart[np.arange(len(x)), own][:, None]) / (2 * gap)
        side[np.arange(len(x)), own] = 0
        return own, side <= reach * limit

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books, cuts = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit_rows(batch.column("raw").to_pylist(), kind)
            own, probed = own_and_probed(x)
            rest, codes, error = x - centres[own], np.empty((len(x), len(books)), np.uint8), np.zeros(len(x))
            for i, (book, s, e) in enumerate(zip(books, cuts[:-1], cuts[1:], strict=True)):
                codes[:, i] = nearest(rest[:, s:e], book)
                error += ((rest[:, s:e] - book[codes[:, i]]) ** 2).sum(axis=1)
            row, to = np.nonzero(probed)
            probes = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(x) + 1)), pa.int32()), pa.array(to.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("n"), batch.column("raw"), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(np.sqrt(error)), probes], names=["rep", "n", "raw", "home", "code", "error", "probes"]
            )

    coded = cut(reps.select("rep", "n", "raw").mapInArrow(index, "rep long, n long, raw binary, home int, code binary, error double, probes array<int>"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, probes = np.zeros(k, np.int64), np.zeros(k, np.int64)
        for batch in batches:
            members += np.bincount(batch.column("home").to_numpy(), minlength=k)
            probes += np.bincount(batch.column("probes").flatten().to_numpy(), minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(members), pa.array(probes)], names=["list", "members", "probes"])

    counts = coded.select("home", "probes").mapInArrow(tally, "list long, members long, probes long").groupBy("list").agg(F.sum("members").alias("members"), F.sum("probes").alias("probes")).toPandas()
    members, probes = np.zeros(k, np.int64), np.zeros(k, np.int64)
    members[counts["list"]], probes[counts["list"]] = counts["members"], counts["probes"]
    sizes = context.broadcast((-(-members // chunk), -(-probes // chunk), members))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member_chunks, probe_chunks, members = sizes.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rep, own = batch.column("rep").to_numpy(), batch.column("home").to_numpy().astype(np.int64)
            probes = batch.column("probes")
            row = np.repeat(np.arange(len(rep)), np.diff(probes.offsets.to_numpy()))
            to = probes.flatten().to_numpy().astype(np.int64)
            live = members[to] > 0
            row, to = row[live], to[live]
            spin = mix(rep.astype(U64))
            # a member meets all chunks of its list's probes, a probe all chunks of the list's members
            for rows, lists, mine, others, probe in ((np.arange(len(rep)), own, member_chunks, probe_chunks, False), (row, to, probe_chunks, member_chunks, True)):
                chunk_ = (spin[rows] % np.maximum(mine[lists], 1).astype(U64)).astype(np.int64)
                times = others[lists]
                at, other = np.repeat(np.arange(len(rows)), times), spread(times)
                a, b = (other, chunk_[at]) if probe else (chunk_[at], other)
                unit = (lists[at] << 40) | (a << 20) | b
                for i in range(0, len(at), 1 << 14):
                    part = pa.array(rows[at[i : i + (1 << 14)]])
                    sent = batch.select(["rep", "n", "home", "raw"]).take(part)
                    code, error = (pa.nulls(len(part), t) for t in (pa.binary(), pa.float64())) if probe else (batch.column(c).take(part) for c in ("code", "error"))
                    yield pa.RecordBatch.from_arrays([pa.array(unit[i : i + (1 << 14)]), pa.array(np.full(len(part), probe)), *sent.columns, code, error], names=["unit", "probe", "rep", "n", "home", "raw", "code", "error"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books, cuts = shared.value
        for table in by_key(batches, "unit"):
            units, probe, rep, n, home = (table.column(c).to_numpy() for c in ("unit", "probe", "rep", "n", "home"))
            x = unit_rows(table.column("raw").to_pylist(), kind)
            edges = np.flatnonzero(np.r_[True, units[1:] != units[:-1], True])
            who, many, a, b = [], [], [], []
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                member, query = (start + np.flatnonzero(probe[start:end] == v) for v in (False, True))
                if not len(member) or not len(query):
                    continue
                here, own = int(units[start] >> 40), table.take(pa.array(member))
                codes = np.frombuffer(b"".join(own.column("code").to_pylist()), np.uint8).reshape(len(member), -1)
                most = (limit + own.column("error").to_numpy() + 1e-9) ** 2
                for i in range(0, len(query), 512):
                    mine = query[i : i + 512]
                    from_centre = x[mine] - centres[here]
                    far = np.zeros((len(mine), len(member)))
                    for m, (book, s, e) in enumerate(zip(books, cuts[:-1], cuts[1:], strict=True)):
                        distances = (from_centre[:, s:e] ** 2).sum(axis=1)[:, None] + (book**2).sum(axis=1) - 2 * from_centre[:, s:e] @ book.T
                        far += distances[:, codes[:, m]]
                    p, q = np.nonzero(far <= most)
                    p, q = mine[p], member[q]
                    hit = rep[p] != rep[q]
                    p, q = p[hit], q[hit]
                    close = np.concatenate([np.einsum("ij,ij->i", x[p[j : j + 65536]], x[q[j : j + 65536]]) for j in range(0, len(p), 65536)]) >= cosine if len(p) else np.empty(0, bool)
                    p, q = p[close], q[close]
                    if len(p):
                        # a member that doesn't look into the query's list gets its link here
                        back = home[p] == here
                        for j in np.flatnonzero(np.bincount(home[p[~back]])):
                            other = np.flatnonzero(home[p] == j)
                            ends, at = np.unique(q[other], return_inverse=True)
                            gap = np.sqrt(max(((centres[here] - centres[j]) ** 2).sum(), 1e-12))
                            side = ((centres[j] ** 2).sum() - (centres[here] ** 2).sum() - 2 * x[ends] @ (centres[j] - centres[here])) / (2 * gap)
                            back[other] = (side <= reach * limit)[at]
                        found = np.r_[p, q[~back]]
                        at, inverse = np.unique(found, return_inverse=True)
                        who.append(rep[at])
                        many.append(np.bincount(inverse, n[np.r_[q, p[~back]]]).astype(np.int64))
                        hung = star_forest(rep[p], rep[q])
                        a.append(hung[0])
                        b.append(hung[1])
            if who:
                who, many = np.concatenate(who), np.concatenate(many)
                a, b = star_forest(np.concatenate(a), np.concatenate(b))
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[who, a]), pa.array([None] * len(who) + b.tolist(), pa.int64()), pa.array(many.tolist() + [None] * len(a), pa.int64())], names=["a", "b", "links"])

    sent = coded.mapInArrow(emit, "unit long, probe boolean, rep long, n long, home int, raw binary, code binary, error double")
    return sent.repartition(F.col("unit")).sortWithinPartitions("unit").mapInArrow(search, "a long, b long, links long")
