"""SimHash near-duplicates by the generalised pigeonhole principle.

Bits of a fingerprint that go together are put into the same partition. For each fingerprint, dynamic
programming spreads a threshold budget over the partitions (unequal, -1 skips one), so that the candidates
that the partitions' value counts foretell are fewest. If the thresholds of m partitions add up to
radius - m + 1, every fingerprint within the radius agrees with it in some partition up to that partition's
threshold. Each fingerprint is filed under its value in every partition, and probes the values within its
own thresholds; candidates are verified on all bits.

Scale: equal fingerprints are one node, so copies cost nothing. Rows of one value that are more than
`cell_rows` are dealt to pairs of chunks, so no task gets an unbounded group, and each unit sends on only a
spanning forest of its links, never all pairs. The driver gets tables of fixed size: 64 x 64 bit counts for
each word of the fingerprint and 65,536 value counts for each partition.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import resemblance
from .blocks import packed, unpacked
from .common import U64, by_key, cut, mix, spread, star_forest, texts, words
from .components import components

#: SPREAD[b] holds the 8 bits of b in 8 bytes; up to 255 of them add without a carry
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(U64).ravel()
CELLS = 1 << 16


def shingle_hashes(tokens: list[bytes], size: int, seed: int = 42) -> list[int]:
    """XXH64 of each shingle of `size` words, joined by a space; of all words if there are fewer."""
    if not tokens:
        return []
    digest, joined = xxhash.xxh64_intdigest, b" ".join(tokens)
    if len(tokens) <= size:
        return [digest(joined, seed)]
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=False)]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each group of so many hashes, the 64-bit word whose bits are set in over half of them; 0 for none."""
    out = np.zeros(len(sizes), U64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    parts = -(-n // 255)
    first = np.repeat(np.cumsum(n) - n, parts) + 255 * spread(parts)
    octets, edges = hashes.view(np.uint8).reshape(-1, 8), np.r_[first, len(hashes)]
    counts = np.empty((len(first), 64), np.int32)
    for i in range(0, len(first), 1024):  # a quarter million hashes at a time
        here, end = first[i : i + 1024], edges[min(i + 1024, len(first))]
        counts[i : i + 1024] = np.add.reduceat(SPREAD[octets[here[0] : end]], here - here[0], axis=0).view(np.uint8).reshape(-1, 64)
    counts = np.add.reduceat(counts, np.cumsum(parts) - parts, axis=0)
    out[full] = np.packbits(counts * 2 > n[:, None], axis=1, bitorder="little").view(U64).ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, folds: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): `folds` 64-bit SimHash words of the whole text, little-endian, one after another.

    The first word is the majority of the shingles' XXH64 (seed 42); further ones are the majority of mixed
    copies of them. Null and wordless texts have zeros.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, sizes, at = [], [], {}
            rows = [at.setdefault(t, len(at)) for t in texts(batch)]
            for t in at:
                h = shingle_hashes(words(t), shingle)
                hashes.append(np.array(h, U64))
                sizes.append(len(h))
            flat, sizes = np.concatenate(hashes) if hashes else np.empty(0, U64), np.array(sizes, np.int64)
            with np.errstate(over="ignore"):
                fps = np.stack([majority(mix(flat + U64(k) * U64(0x9E3779B97F4A7C15)) if k else flat, sizes) for k in range(folds)], axis=1)
            raw = fps.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([raw[8 * folds * r : 8 * folds * (r + 1)] for r in rows], pa.binary())], names=[key, "fp"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text")).mapInArrow(run, f"{key} long, fp binary")


def as_words(column: pa.Array, folds: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), U64).reshape(-1, folds)


def group_bits(both: np.ndarray, n: int, widths: list[int]) -> list[list[int]]:
    """Bits of a word put into partitions of these widths; a partition takes the bits that go best with those it has.

    both: how many fingerprints have bits i and j set; n: how many there are.
    """
    p = np.diag(both) / max(n, 1)
    spread_ = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    with_ = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread_, spread_)
    np.fill_diagonal(with_, 0)
    left, parts = set(range(len(p))), []
    for width in widths:
        part = [max(left, key=lambda i: (with_[i, sorted(left)].sum(), -i))]
        left.discard(part[0])
        while len(part) < width:
            part.append(max(left, key=lambda i: (with_[i, part].sum(), -i)))
            left.discard(part[-1])
        parts.append(part)
    return parts


class Plan:
    """Partitions of the bits, their values' counts, and thresholds for each fingerprint."""

    def __init__(self, folds: int, per_word: int, radius: int, cell_rows: int):
        self.folds, self.radius, self.cell_rows = folds, radius, cell_rows
        self.widths = [64 // per_word + (i < 64 % per_word) for i in range(per_word)]
        self.bits: list[list[list[int]]] = []
        self.cells = np.zeros((folds * per_word, CELLS), np.int32)

    @property
    def parts(self) -> int:
        return self.folds * len(self.widths)

    def budget(self) -> int:
        return self.radius - self.parts + 1

    def values(self, fp: np.ndarray) -> np.ndarray:
        out = np.zeros((len(fp), self.parts), np.int64)
        for word, groups in enumerate(self.bits):
            for k, group in enumerate(groups):
                for to, at in enumerate(group):
                    out[:, word * len(groups) + k] |= ((fp[:, word] >> U64(at)) & U64(1)).astype(np.int64) << to
        return out

    def shift(self, part: int) -> int:
        return max(0, self.widths[part % len(self.widths)] - 16)

    def counted(self) -> None:
        """Candidates that a probe of threshold 0, 1, 2 is expected to meet, by value. Counts of wider values are spread evenly."""
        at = np.arange(CELLS)
        self.expected = []
        for part, cells in enumerate(self.cells.astype(np.float64)):
            own = cells / (1 << self.shift(part))
            w = self.widths[part % len(self.widths)]
            near = sum((own[at ^ (1 << b)] for b in range(min(w, 16))), own * self.shift(part))
            far = (sum((near[at ^ (1 << b)] for b in range(min(w, 16))), near * self.shift(part)) - w * own) / 2
            probes = [1, 1 + w, 1 + w + w * (w - 1) // 2]
            self.expected.append([c + 2.0 * p for c, p in zip((own, own + near, own + near + np.maximum(far, 0)), probes, strict=True)])

    def thresholds(self, values: np.ndarray) -> np.ndarray:
        """For each row the cheapest thresholds (-1 to 2) that add up to the budget."""
        n, want = len(values), self.budget() + self.parts  # thresholds + 1 add up to this
        cost = np.full((n, want + 1), np.inf)
        cost[:, 0] = 0
        choice = np.zeros((self.parts, n, want + 1), np.int8)
        for part in range(self.parts):
            cell = values[:, part] >> self.shift(part)
            options = [np.zeros(n), *(e[cell] for e in self.expected[part])]
            best, pick = np.full_like(cost, np.inf), choice[part]
            for step, extra in enumerate(options[: want + 1]):
                moved = cost[:, : want + 1 - step] + extra[:, None]
                better = moved < best[:, step:]
                best[:, step:][better] = moved[better]
                pick[:, step:][better] = step
            cost = best
        out, at, rows = np.zeros((n, self.parts), np.int8), np.full(n, want), np.arange(n)
        for part in range(self.parts - 1, -1, -1):
            step = choice[part][rows, at]
            out[:, part] = step - 1
            at = at - step
        return out


def plan_for(reps: DataFrame, folds: int, radius: int, per_word: int | None, cell_rows: int) -> Plan:
    def bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, 64, 64), np.int64)
        for batch in batches:
            fp = as_words(batch.column("fp"), folds)
            for k in range(folds):
                bits = np.unpackbits(fp[:, k].copy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total[k] += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "n"])

    n = reps.count()
    # wide enough that a value has few rows by chance; 16 bits until 2^24 fingerprints
    plan = Plan(folds, per_word or (4 if n <= 1 << 24 else 3 if n <= 1 << 30 else 2), radius, cell_rows)
    both = np.zeros(folds * 4096, np.int64)
    for row in reps.mapInArrow(bit_counts, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        both[row["at"]] = row["n"]
    plan.bits = [group_bits(b, n, plan.widths) for b in both.reshape(folds, 64, 64)]
    parts, shifts = plan.parts, np.array([plan.shift(p) for p in range(plan.parts)])

    def cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = plan.values(as_words(batch.column("fp"), folds)) >> shifts
            cells, counts = np.unique(v + np.arange(parts) * CELLS, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), pa.array(counts.ravel())], names=["cell", "n"])

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            cell, n = batch.column("cell").to_numpy(), batch.column("n").to_numpy()
            for part in np.unique(cell >> 16).tolist():
                mine = cell >> 16 == part
                found.setdefault(part, np.zeros(CELLS, np.int64))[cell[mine] & 0xFFFF] = n[mine]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([packed(v) for v in found.values()], pa.binary())], names=["part", "counts"])

    sums = reps.mapInArrow(cell_counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    for row in sums.repartitionById(parts, F.shiftright("cell", 16).cast("int")).mapInArrow(dense, "part long, counts binary").collect():
        plan.cells[row["part"]] = unpacked(bytes(row["counts"]))
    return plan


def flips(width: int, threshold: int) -> np.ndarray:
    """What to xor a value with to reach all values within the threshold, itself first."""
    near = [0, *(1 << b for b in range(width))] if threshold > 0 else [0]
    return np.array([*near, *((1 << a) | (1 << b) for a, b in itertools.combinations(range(width), 2))] if threshold > 1 else near, np.int64)


def links(reps: DataFrame, folds: int, radius: int, per_word: int | None = None, cell_rows: int = 1024) -> DataFrame:
    """A spanning forest (a, b) of the links between representatives (rep, fp) whose fingerprints differ in `radius` bits or fewer."""
    plan = plan_for(reps, folds, radius, per_word, cell_rows)
    shared = reps.sparkSession.sparkContext.broadcast(vars(plan))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Plan.__new__(Plan)
        vars(plan).update(shared.value)
        plan.counted()
        for batch in batches:
            rep, raw = batch.column("rep").to_numpy(), np.array(batch.column("fp").to_pylist(), object)
            values = plan.values(as_words(batch.column("fp"), folds))
            thresholds = plan.thresholds(values)
            for part in range(plan.parts):
                v, t = values[:, part], thresholds[:, part]
                picked = [(np.arange(len(v)), v, np.where(t >= 0, 3, 1))]
                for k in (1, 2):
                    at = np.flatnonzero(t == k)
                    if len(at):
                        near = flips(plan.widths[part % len(plan.widths)], k)[1:]
                        picked.append((np.repeat(at, len(near)), (v[at][:, None] ^ near).ravel(), np.full(len(at) * len(near), 2)))
                row, value, role = (np.concatenate(x) for x in zip(*picked, strict=True))
                rows_here = plan.cells[part][value >> plan.shift(part)] >> plan.shift(part)
                live = (rows_here > 0) | (plan.shift(part) > 0)  # a probe of a value that nothing has meets nothing
                row, value, role, rows_here = row[live], value[live], role[live], rows_here[live]
                chunks = -(-np.maximum(rows_here, 1) // plan.cell_rows)
                own = (mix(rep[row].astype(U64)) % chunks.astype(U64)).astype(np.int64)
                other = spread(chunks)
                row, value, role, own, chunks = (np.repeat(x, chunks) for x in (row, value, role, own, chunks))
                pair = np.minimum(own, other) * chunks + np.maximum(own, other)
                with np.errstate(over="ignore"):
                    unit = mix(mix((value | (part << 40)).astype(U64)) + pair.astype(U64)).view(np.int64)
                for i in range(0, len(row), 1 << 16):
                    cut_ = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(unit[cut_]), pa.array(role[cut_].astype(np.int8)), pa.array(rep[row[cut_]]), pa.array(raw[row[cut_]].tolist(), pa.binary())], names=["unit", "role", "rep", "fp"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, "unit"):
            unit, role, rep = (table.column(c).to_numpy() for c in ("unit", "role", "rep"))
            fp = as_words(table.column("fp"), folds)
            a, b = [], []
            first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            size = np.diff(np.r_[first, len(unit)])
            small = np.repeat(np.where(size <= 64, size, 0), size)
            left = np.repeat(first + size, size) - np.arange(len(unit)) - 1  # rows of the unit after this one
            at = np.flatnonzero((left > 0) & (small > 0))
            step = 1
            while len(at):
                to = at + step
                near = (((role[at] & 1) & (role[to] >> 1)) | ((role[at] >> 1) & (role[to] & 1))) > 0
                x, y = at[near], to[near]
                hit = (np.bitwise_count(fp[x] ^ fp[y]).sum(axis=1) <= radius) & (rep[x] != rep[y])
                a.append(rep[x[hit]])
                b.append(rep[y[hit]])
                step += 1
                at = at[left[at] >= step]
            for start, n in zip(first[size > 64], size[size > 64], strict=True):
                index, probe = (start + np.flatnonzero(role[start : start + n] & bit) for bit in (1, 2))
                for i in range(0, len(probe), 256):
                    mine = probe[i : i + 256]
                    apart = sum(np.bitwise_count(fp[mine, k][:, None] ^ fp[index, k]).astype(np.int16) for k in range(folds))
                    x, y = np.nonzero(apart <= radius)
                    hung = star_forest(rep[mine[x]], rep[index[y]])
                    a.append(hung[0])
                    b.append(hung[1])
            if a:
                x, y = star_forest(np.concatenate(a), np.concatenate(b))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    rows = reps.mapInArrow(emit, "unit long, role byte, rep long, fp binary")
    return rows.repartition(F.col("unit")).sortWithinPartitions("unit").mapInArrow(verified, "a long, b long")


def classes(prints: DataFrame, folds: int, radius: int, key: str = "doc_id", **options) -> DataFrame:
    """(key, fp, component): each row of (key, fp) with the smallest key reachable by links. Rows with a null key link nothing and keep a null component."""
    prints = cut(prints)
    reps = cut(prints.where(F.col(key).isNotNull()).groupBy("fp").agg(F.min(key).alias("rep")))
    group = components(links(reps, folds, radius, **options))
    named = cut(reps.join(group, reps.rep == group.node, "left").select("fp", F.coalesce("component", "rep").alias("component")))
    out = prints.join(named.withColumnRenamed("fp", "fp_"), F.col("fp") == F.col("fp_"), "left").drop("fp_")
    return out.withColumn("component", F.when(F.col(key).isNotNull(), F.col("component")))


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: documents whose 64-bit fingerprints differ in `radius` bits or fewer are linked.

    Null and empty texts have fingerprint zero and link like any other. Repeated ids keep their rows. A null id keeps
    its row with a null component. Other columns are ignored.
    """
    found = classes(fingerprints(docs, shingle), 1, radius)
    return found.select("doc_id", F.lower(F.concat(*(F.substring(F.hex("fp"), i, 2) for i in range(15, 0, -2)))).alias("fingerprint"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The rows of `docs`, one (smallest doc_id) of each group of near copies: resemblance of 0.8 or more on 5-word shingles.

    SimHash links and an exact join beside them find candidates, and whole shingle sets decide (see resemblance.py). Wordless texts are copies of each other. Rows with a null doc_id stay. Repeated ids
    stay together.
    """
    gone = resemblance.near_copies(docs, shingle).where(F.col("component") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
