"""Language identification by cross-parsing.

For each language, a suffix automaton of a sample of its labelled text. A text is parsed greedily into the
longest phrases that occur in that sample; the automaton's state is followed until it has no step. The
language that needs the fewest phrases, normalised by the text's length and the log of the sample's size
(a cross-entropy in nats a character), wins.

Scale: the samples are bounded (`sample_chars` over all languages), found by hash, so the automata are
broadcast with a bounded size. A text is parsed in segments of `segment` characters, thousands at a time,
one array step per character position. No shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, texts

#: columns of an automaton's table: letters beyond a language's 63 commonest have their steps in a sorted list
COLUMNS = 64
SPACE = 1


def letters_only(text: str) -> str:
    """Lower-cased letters; whatever stands between them becomes one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def alphabet(samples: dict[str, str]) -> np.ndarray:
    """Symbol of each code point: 1 for a space and all that is no letter, 2 and more for letters of any sample, 0 for letters of none."""
    table = np.array([not chr(c).isalpha() for c in range(0x110000)], np.int32)
    seen = np.unique(np.frombuffer("".join(samples.values()).encode("utf-32-le"), np.uint32))
    seen = seen[seen != 32]
    table[seen] = np.arange(2, 2 + len(seen))
    return table


class Automaton:
    """Suffix automaton of a sequence of symbols: state 0 is the start, step 0 means none."""

    def __init__(self, symbols: list[int], kinds: int):
        step: list[dict[int, int]] = [{}]
        link, longest, last = [-1], [0], 0
        for c in symbols:
            new = len(step)
            step.append({})
            link.append(0)
            longest.append(longest[last] + 1)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if longest[p] + 1 == longest[q]:
                    link[new] = q
                else:
                    copy = len(step)
                    step.append(dict(step[q]))
                    link.append(link[q])
                    longest.append(longest[p] + 1)
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        self.kinds = kinds
        common = np.argsort(-np.bincount(np.array(symbols, np.int64), minlength=kinds), kind="stable")[: COLUMNS - 1]
        self.column = np.zeros(kinds, np.uint8)
        self.column[common] = np.arange(1, len(common) + 1)
        state, symbol, to = (np.array(x, np.int64) for x in zip(*((i, c, q) for i, own in enumerate(step) for c, q in own.items()), strict=True)) if symbols else (np.empty(0, np.int64),) * 3
        column = self.column[symbol]
        self.dead = len(step)  # a state without any step: what follows begins a phrase
        self.table = np.zeros((len(step) + 1) * COLUMNS, np.int32)
        self.table[state[column > 0] * COLUMNS + column[column > 0]] = to[column > 0]
        rare = column == 0
        keys = state[rare] * kinds + symbol[rare]
        order = np.argsort(keys)
        self.keys, self.rare = keys[order], to[rare][order].astype(np.int32)

    def follow(self, state: np.ndarray, symbol: np.ndarray, column: np.ndarray) -> np.ndarray:
        to = self.table[state * COLUMNS + column]
        if len(self.keys):
            at = np.flatnonzero((column == 0) & (symbol > 0))
            if len(at):
                key = state[at].astype(np.int64) * self.kinds + symbol[at]
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                to[at] = np.where(self.keys[place] == key, self.rare[place], 0)
        return to


class Model:
    """Languages, their automata and sample sizes, and the alphabet."""

    def __init__(self, samples: dict[str, str], segment: int = 1024):
        self.segment = segment
        self.languages = sorted(samples)
        self.table = alphabet(samples)
        self.automata, self.scale = [], []
        for name in self.languages:
            symbols = self.table[np.frombuffer(samples[name].encode("utf-32-le"), np.uint32)]
            self.automata.append(Automaton(symbols.tolist(), int(self.table.max()) + 1))
            self.scale.append(np.log(max(2, len(symbols))))

    def symbols(self, text: str) -> tuple[np.ndarray, bool]:
        """Symbols of a text with one space between words, and whether it has a letter."""
        out = self.table[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
        keep = (out != SPACE) | (np.r_[np.int32(SPACE), out[:-1]] != SPACE)
        return out[keep], bool((out != SPACE).any())

    def phrases(self, segments: list[np.ndarray]) -> np.ndarray:
        """Phrases that each language needs for each segment, languages x segments."""
        lengths = np.array([len(s) for s in segments], np.int64)
        order = np.argsort(-lengths, kind="stable")
        most = int(lengths.max(initial=0))
        grid = np.zeros((most, len(segments)), np.int32)
        for column, at in enumerate(order):
            grid[: lengths[at], column] = segments[at]
        live = np.searchsorted(-lengths[order], -np.arange(most), side="left")
        out = np.zeros((len(self.languages), len(segments)), np.int64)
        for k, own in enumerate(self.automata):
            state, count = np.full(len(segments), own.dead, np.int32), np.zeros(len(segments), np.int64)
            columns = own.column[grid]
            for t in range(most):
                n = live[t]
                symbol, column = grid[t, :n], columns[t, :n]
                to = own.follow(state[:n], symbol, column)
                stuck = to == 0
                count[:n] += stuck
                first = own.follow(np.zeros(int(stuck.sum()), np.int32), symbol[stuck], column[stuck])
                to[stuck] = np.where(first > 0, first, own.dead)
                state[:n] = to
            out[k, order] = count
        return out

    def predict(self, rows: list[str | None]) -> tuple[list[str], np.ndarray]:
        owners, segments, answer, score = [], [], ["und"] * len(rows), np.zeros(len(rows))
        sizes = np.zeros(len(rows))
        for i, text in enumerate(rows):
            symbols, has = self.symbols(text) if text else (None, False)
            if has:
                sizes[i] = len(symbols)
                for a in range(0, len(symbols), self.segment):
                    owners.append(i)
                    segments.append(symbols[a : a + self.segment])
        if not segments or not self.languages:
            return answer, score
        total = np.zeros((len(self.languages), len(rows)))
        for a in range(0, len(segments), 8192):
            part = self.phrases(segments[a : a + 8192])
            for k in range(len(self.languages)):
                total[k] += np.bincount(owners[a : a + 8192], part[k], len(rows))
        nats = total * np.array(self.scale)[:, None] / np.maximum(sizes, 1)
        best = nats.argmin(axis=0)
        share = np.exp(-(nats - nats.min(axis=0)) * np.minimum(sizes, 64))
        top = 1 / share.sum(axis=0)
        for i in np.flatnonzero(sizes):
            answer[i], score[i] = self.languages[best[i]], top[i]
        return answer, score


def train(docs: DataFrame, sample_chars: int = 160_000, row_chars: int = 10_000, parts: int = 3, held: int = 1, segment: int = 1024) -> Model:
    """A model from labelled documents outside the fold `held`.

    `sample_chars` bounds the text kept of all languages together, `row_chars` what one row gives: a stretch from a place in its
    text that its id's hash names. Rows are chosen by that hash until a language's share is full; the last one is cut there.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", parts) != held)).select(F.col("lang").cast("string").alias("lang"), F.col("text"), F.xxhash64("doc_id").alias("h"))
    sizes = known.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n")).where("chars > 0").collect()
    if not sizes:
        return Model({}, segment)
    share = max(2000, sample_chars // len(sizes))
    # three times the share in expectation, so that it fills
    limits = {r["lang"]: min(1.0, max(3 * share / r["chars"], 24 / r["n"])) for r in sizes}
    limit = F.element_at(F.create_map(*(F.lit(x) for pair in limits.items() for x in pair)), F.col("lang"))
    start = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - row_chars, F.lit(0)) + 1) + 1
    picked = known.where(F.pmod("h", F.lit(1 << 30)) < limit * (1 << 30)).select("lang", "h", F.substring("text", start.cast("int"), F.lit(row_chars)).alias("text")).toPandas()
    samples = {}
    for lang, rows in picked.sort_values(["lang", "h", "text"]).groupby("lang"):
        joined = letters_only(" ".join(rows["text"]))[:share]
        if joined:
            samples[lang] = joined
    return Model(samples, segment)


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Null texts and texts without a letter are `und` with score 0.

    Learns from rows with a language whose crc32(doc_id) mod 3 isn't 1. The score is the winner's share of likelihood over at
    most 64 characters. Ties go to the first language by name; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(train(docs, **options)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.__new__(Model)
        vars(own).update(shared.value)
        for batch in batches:
            lang, score = own.predict(texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return told.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
