"""Toxicity by weak supervision.

Thousands of voters look at a text: each word and each stem (words that begin alike, one, two or three
different ones) that a fair number of the training texts have, and patterns of writing. Which of them vote is
settled by how many texts they speak of, never by labels. A voter says toxic, or nothing. A generative label
model, fitted by expectation-maximisation, estimates how often each voter speaks under either class and which
voters err together: what two have in common beyond the class lowers the weight of both. The annotators are
one more voter, whose errors are estimated like all others'; they name the classes, as the first guess is
theirs. A linear classifier on the features that tell most about the model's posterior labels is trained on
those, and scores every document.

Scale: training reads a sample of labelled rows whose size is bounded by `most_training`, found by hash
and joined as a broadcast of (doc_id, label) only. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, cut, fold, mix, ngram_hashes, texts, tidy, word_hashes, words

WORD = re.compile(r"\w+")
STEMS = (3, 4, 5, 6)


#: a stem counts as such, in two and in three different words
TIMES = ("s:", "t:", "u:")


def found(text: str | None) -> set[str]:
    """What a text has: words (w:), stems in one, two, three words (s:, t:, u:) and patterns (p:)."""
    if not text:
        return set()
    seen = set(WORD.findall(text.lower()))
    stems = Counter(w[:n] for w in seen for n in STEMS if len(w) >= n)
    out = {f"w:{w}" for w in seen}
    for k, kind in enumerate(TIMES):
        out.update(f"{kind}{s}" for s, c in stems.items() if c > k)
    return out | patterns(text)


#: habits of writing, each a voter
HABITS = {
    "p:marks": re.compile(r"!!|\?!"), "p:masked": re.compile(r"\w\*{2,}|[#@$%&]{3,}"), "p:drawn": re.compile(r"([^\W\d_])\1{3}"),
    "p:addressed": re.compile(r"\b(?:you|your|du|dein\w*|tu|toi|eres|tú)\b", re.I), "p:mixed": re.compile(r"\b[^\W\d_]+\d[^\W\d_]+\b"),
}


CAPITALS = bytes(range(65, 91))


def patterns(text: str, of: Iterable[str] = ("p:shouting", *HABITS)) -> set[str]:
    """Those of the habits that a text has."""
    out = {name for name in of if name in HABITS and HABITS[name].search(text)}
    if "p:shouting" in of:
        raw = text.encode("utf-8", "replace")
        upper, lower = (len(raw) - len(raw.translate(None, letters)) for letters in (CAPITALS, CAPITALS.lower()))
        if upper + lower >= 20 and upper > lower:
            out.add("p:shouting")
    return out


def add_up(index: np.ndarray, weights: np.ndarray, by: np.ndarray, m: int, part: int = 1 << 20) -> np.ndarray:
    """Sums of weights[by] at index, a part at a time: the driver holds no copy as long as the pairs."""
    out = np.zeros(m)
    for i in range(0, len(index), part):
        out += np.bincount(index[i : i + part], weights[by[i : i + part]], m)
    return out


class Model:
    """Feature names with weights, and a bias; voters: (name, accuracy, rows spoken of, weight) of those that the label model heard."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: float, voters: list[tuple] = ()):
        of = {n: w for n, w in zip(names, weights.tolist(), strict=True)}
        self.words = {n[2:]: w for n, w in of.items() if n[:2] == "w:"}
        self.patterns = {n: w for n, w in of.items() if n[:2] == "p:"}
        stems = {n[2:] for n in of if n[:2] in TIMES}
        self.stems = {s: [sum(of.get(kind + s, 0.0) for kind in TIMES[: k + 1]) for k in range(len(TIMES))] for s in stems}
        self.sizes = sorted(set(map(len, stems)))
        self.bias, self.voters = bias, list(voters)

    def margin(self, text: str | None) -> float:
        total = self.bias
        if not text:
            return total
        seen = set(WORD.findall(text.lower()))
        total += sum(map(self.words.__getitem__, seen & self.words.keys()))
        for n in self.sizes:
            stems = [w[:n] for w in seen if len(w) >= n]
            for s in self.stems.keys() & stems:
                total += self.stems[s][min(stems.count(s), len(TIMES)) - 1]
        if self.patterns:
            total += sum(map(self.patterns.__getitem__, patterns(text, self.patterns)))
        return total


def label_model(row: np.ndarray, column: np.ndarray, m: int, said: np.ndarray, prior: float, rounds: int = 30, most_paired: int = 400) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 for each row, accuracies and weights of m voters that speak where (row, column) says so. said: the annotators' 0 or 1.

    A voter speaks with a probability of its own under either class. It is heard if these differ by over four standard errors;
    residual correlations of the `most_paired` loudest, what two have in common beyond the class, are estimated from the
    posteriors, and a voter's weight is one over the sum of its own.
    """
    n, spoken = len(said), np.bincount(column, minlength=m)
    q = np.where(said > 0, 0.9, 0.05)
    weights = np.ones(m)
    for turn in range(rounds):
        ones = add_up(column, q, row, m)
        one, nil = (ones + 0.5) / (q.sum() + 1), (spoken - ones + 0.5) / (n - q.sum() + 1)
        odds, silence = np.log(one / nil), np.log1p(-np.minimum(one, 0.999)) - np.log1p(-np.minimum(nil, 0.999))
        heard = np.abs(odds) > 4 * np.sqrt(1 / (ones + 0.5) + 1 / (spoken - ones + 0.5))
        if turn % 10 == 0:
            loud = np.flatnonzero(heard)
            loud = loud[np.argsort(-np.abs(odds[loud]) * np.sqrt(spoken[loud]), kind="stable")[:most_paired]]
            heard_only, at = np.zeros(m), np.full(m, -1)
            at[loud] = np.arange(len(loud))
            mine = at[column] >= 0
            rest = np.zeros((n, len(loud)), np.float32)
            rest[row[mine], at[column[mine]]] = 1
            rest -= np.outer(q.astype(np.float32), (one - nil)[loud].astype(np.float32))
            rest -= nil[loud].astype(np.float32)
            scale = np.sqrt((rest**2).mean(axis=0)) + 1e-9
            together = np.abs(rest.T @ rest / n) / np.outer(scale, scale)
            together[together < 0.2] = 0
            np.fill_diagonal(together, 1)
            heard_only[loud] = 1 / together.sum(axis=1)
            weights = heard_only
        own = weights * heard
        right, wrong = ((q * said).sum() + 0.5) / (q.sum() + 1), (((1 - q) * said).sum() + 0.5) / (n - q.sum() + 1)
        annotators = np.where(said > 0, np.log(right / wrong), np.log((1 - right) / (1 - wrong)))
        log = np.log(prior / (1 - prior)) + annotators + (own * silence).sum() + add_up(row, own * (odds - silence), column, n)
        q = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    return q, add_up(column, q, row, m) / np.maximum(spoken, 1), weights * heard


def linear(rows: np.ndarray, columns: np.ndarray, n: int, m: int, target: np.ndarray, rounds: int = 400, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on 0/1 features given as (row, column) pairs, with soft targets; full-batch Adam."""
    w, bias = np.zeros(m), 0.0
    first, second = np.zeros(m + 1), np.zeros(m + 1)
    share = np.maximum(target.mean(), 1e-3)
    by_class = np.where(target > 0.5, 0.5 / share, 0.5 / (1 - min(share, 0.999)))
    by_class /= by_class.sum()
    for turn in range(1, rounds + 1):
        z = bias + np.bincount(rows, w[columns], n)
        slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * by_class
        grad = np.r_[np.bincount(columns, slope[rows], m) + l2 * w, slope.sum()]
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        step = 0.1 * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def training_rows(docs: DataFrame, labels: DataFrame, parts: int, held: int, most: int) -> DataFrame:
    """(doc_id, text, y) of at most about `most` labelled documents outside the held-out fold, chosen by hash of the id."""
    kept = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", parts) != held)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    share = min(1.0, most / max(1, kept.count()))
    picked = kept.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    found_ = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return one_of_copies(cut(found_.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))))


def one_of_copies(sample: DataFrame) -> DataFrame:
    """A bounded sample without copies and near copies, which would make their own words look telling.

    Of rows that share one of three minima of hashed word pairs, the one with the smallest id stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            minima = []
            for text in texts(batch):
                h = word_hashes(words(text))
                pairs = ngram_hashes(h, 2) if len(h) > 1 else h
                minima.append([int(mix(pairs ^ U64(salt)).min() >> U64(1)) if len(pairs) else 0 for salt in (1, 2, 3)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(minima, pa.list_(pa.int64()))], names=["doc_id", "minima"])

    seen: list[set[int]] = [set(), set(), set()]
    kept = []
    for row in sample.select("doc_id", "text").mapInArrow(run, "doc_id long, minima array<long>").orderBy("doc_id").collect():
        if not any(m in s for m, s in zip(row["minima"], seen, strict=True)):
            kept.append((row["doc_id"],))
        for m, s in zip(row["minima"], seen, strict=True):
            s.add(m)
    return sample.join(F.broadcast(sample.sparkSession.createDataFrame(kept, "doc_id long")), "doc_id", "left_semi")


def train(docs: DataFrame, labels: DataFrame, most_training: int = 8_000, parts: int = 5, held: int = 0, features: int = 1500, voters: int = 40_000) -> Model:
    """A model from at most `most_training` labelled rows outside the fold `held` of `parts`. Without any, or with one class only, it says 0 for all."""
    sample = training_rows(docs, labels, parts, held, most_training)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter[str] = Counter()
        for batch in batches:
            for text in texts(batch):
                tally.update(found(text))
        yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], names=["name", "n"])

    n, ones = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < ones < n:
        return Model([], np.zeros(0), -5.0)
    counts = sample.select("text").mapInArrow(counted, "name string, n long").groupBy("name").agg(F.sum("n").alias("n"))
    least = max(3, n // 2000)
    names = [r["name"] for r in counts.where((F.col("n") >= least) & (F.col("n") <= 0.15 * n)).orderBy(F.desc("n"), "name").limit(voters).collect()]
    at = {name: i for i, name in enumerate(names)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [sorted(at[x] for x in found(t) & at.keys()) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(hits, pa.list_(pa.int32()))], names=["y", "hits"])

    table = sample.mapInArrow(rows, "y int, hits array<int>").toArrow()
    said, hits = table.column("y").to_numpy(), table.column("hits").combine_chunks()
    column = hits.flatten().to_numpy()
    row = np.repeat(np.arange(len(said), dtype=np.int32), table.column("hits").combine_chunks().value_lengths().to_numpy())
    target, accuracy, weight = label_model(row, column, len(names), said, min(max(ones / n, 0.01), 0.99))
    spoken = np.bincount(column, minlength=len(names))
    heard = [(names[i], float(accuracy[i]), int(spoken[i]), float(weight[i])) for i in np.flatnonzero(weight).tolist()]
    chosen = telling(names, spoken, add_up(column, target, row, len(names)), target, features)
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    mine = place[column] >= 0
    w, bias = linear(row[mine], place[column[mine]], len(said), len(chosen), target)
    return Model([names[i] for i in chosen], w, bias, heard)


def telling(names: list[str], spoken: np.ndarray, ones: np.ndarray, target: np.ndarray, most: int) -> list[int]:
    """The features that are least likely to have nothing to do with the posterior labels, beyond what so many show by chance.

    Without stems that a longer stem or a word says as well: one that begins alike and is found nearly as often.
    """
    base, zeros = target.mean(), spoken - ones
    part = lambda k, p: np.where(k > 0, k * np.log(np.maximum(k, 1e-300) / np.maximum(spoken * p, 1e-300)), 0)
    gain = part(ones, base) + part(zeros, 1 - base)
    top = [i for i in np.argsort(-gain, kind="stable")[:most].tolist() if gain[i] > np.log(len(names)) + 1]
    by_rest: dict[str, list[int]] = {}
    for i in top:
        kind, rest = names[i][:2], names[i][2:]
        for size in STEMS:
            if len(rest) > size or kind == "w:":
                by_rest.setdefault(rest[:size], []).append(i)

    def same(i: int, o: int) -> bool:
        alike = names[o][:2] == names[i][:2] or (names[i][:2] == "s:" and names[o][:2] == "w:")
        return o != i and alike and spoken[o] >= 0.9 * spoken[i] and ones[o] >= 0.9 * ones[i]

    return [i for i in top if names[i][:2] not in TIMES or not any(same(i, o) for o in by_rest.get(names[i][2:], ()))]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 at 0.5 and more) for each row; null and empty texts score as a text without any feature."""
    state = vars(model)
    shared = docs.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.__new__(Model)
        vars(own).update(shared.value)
        for batch in batches:
            z = np.clip(np.array([own.margin(t) for t in texts(batch)], float), -30, 30)
            p = 1 / (1 + np.exp(-z))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])
        tidy()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted. Learns from labelled rows whose crc32(doc_id) mod 5 isn't 0; other columns are ignored."""
    return scored(docs, train(docs, labels, **options)).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def clean_only(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the model doesn't reject, all columns as they were."""
    model = train(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.__new__(Model)
        vars(own).update(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([own.margin(t) < 0 for t in texts(batch)], pa.bool_()))
        tidy()

    return docs.mapInArrow(run, docs.schema)
