"""A linear-chain CRF as an Arrow scorer: features, best path and entities. Weights are the caller's."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: words of letters, digits, apostrophes and hyphens, without the last two at the ends
TOKEN = re.compile(r"[^\W_](?:(?:[^\W_]|['-])*[^\W_])?", re.UNICODE)
# fixed values: names of the features that published weights are keyed by, and the bounds of word lengths
LENGTHS = [(2, "short"), (5, "medium"), (10, "long")]
NAMES = {"word": "word=", "shape": "shape=", "prefix": "p{}=", "suffix": "s{}=", "before": "-1:", "after": "+1:", "upper": "isupper", "title": "istitle", "digit": "isdigit", "alpha": "isalpha", "length": "len=", "listed": "gaz=", "first": "BOS", "last": "EOS"}


def shape(word: str) -> str:
    """X for upper case, x for lower case, d for digits, others as they are; a run of one kind counts once."""
    kinds = ("X" if c.isupper() else "x" if c.islower() else "d" if c in "0123456789" else c for c in word)
    return "".join(k for k, _ in itertools.groupby(kinds))


def features(words: list[str], i: int, lists: dict[str, set[str]] | None = None) -> list[str]:
    """What a word shows: itself, its shape, first and last letters, case, length and lists that have it, and its neighbours. Code points, never bytes."""
    w, low, of = words[i], words[i].lower(), NAMES
    cases = {"upper": all(c.isupper() for c in w), "title": w[:1].isupper() and all(c.islower() for c in w[1:]), "digit": all(c in "0123456789" for c in w), "alpha": w.isalpha()}
    out = [of["word"] + low, of["shape"] + shape(w)]
    out += [of[end].format(n) + part for n in (1, 2, 3) if len(low) >= n for end, part in (("prefix", low[:n]), ("suffix", low[-n:]))]
    out += [of[name] for name, yes in cases.items() if yes]
    out.append(of["length"] + next((name for most, name in LENGTHS if len(low) <= most), "vlong"))
    out += [of["listed"] + name for name, own in (lists or {}).items() if low in own or w in own]
    for at, side, edge in ((i - 1, "before", "first"), (i + 1, "after", "last")):
        out += [of[side] + of["word"] + words[at].lower(), of[side] + of["shape"] + shape(words[at])] if 0 <= at < len(words) else [of[edge]]
    return out


def shown(docs: DataFrame, lists: dict[str, set[str]] | None = None) -> DataFrame:
    """(doc_id, i, feature): the features of every word of docs (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                own = TOKEN.findall(text or "")
                rows += [(doc, i, f) for i in range(len(own)) for f in features(own, i, lists)]
            yield pd.DataFrame(rows, columns=["doc_id", "i", "feature"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, i int, feature string")


def best_path(words: list[str], state: dict[str, list[float]], moves: list[list[float]], lists: dict[str, set[str]] | None = None) -> tuple[list[int], list[float]]:
    """Labels of the best path and its running score at each word."""
    n = len(moves)
    rows, back = [], []
    for i in range(len(words)):
        own = [sum(x) for x in zip([0.0] * n, *(state[f] for f in features(words, i, lists) if f in state), strict=False)]
        if not rows:
            rows.append(own)
            continue
        from_ = [max(range(n), key=lambda a, b=b: (rows[-1][a] + moves[a][b], -a)) for b in range(n)]
        back.append(from_)
        rows.append([rows[-1][from_[b]] + moves[from_[b]][b] + own[b] for b in range(n)])
    if not rows:
        return [], []
    path = [max(range(n), key=lambda a: (rows[-1][a], -a))]
    for step in reversed(back):
        path.append(step[path[-1]])
    path.reverse()
    return path, [r[k] for r, k in zip(rows, path, strict=True)]


def scan(docs: DataFrame, labels: list[str], state: dict[str, list[float]], moves: list[list[float]], least: float = 0.5, lists: dict[str, set[str]] | None = None) -> DataFrame:
    """Spans (doc_id, start, end, value, type, confidence, source) of BIO entities; the confidence is the logistic of the mean running score."""
    shared = docs.sparkSession.sparkContext.broadcast((labels, state, moves, lists))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labels, state, moves, lists = shared.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                found = list(TOKEN.finditer(text or ""))
                path, scores = best_path([m.group() for m in found], state, moves, lists)
                open_: list[int] = []
                for i in range(len(found) + 1):
                    tag = labels[path[i]] if i < len(found) else "O"
                    if open_ and not (tag.startswith("I-") and tag[2:] == labels[path[open_[0]]][2:]):
                        mean = sum(scores[k] for k in open_) / len(open_)
                        p = 1 / (1 + math.exp(-max(-50.0, min(50.0, mean))))
                        if p >= least:
                            a, b = found[open_[0]].start(), found[open_[-1]].end()
                            rows.append((doc, a, b, text[a:b], labels[path[open_[0]]][2:].lower(), p, "semantic"))
                        open_ = []
                    if tag != "O":
                        open_.append(i)
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "value", "type", "confidence", "source"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, start int, end int, value string, type string, confidence double, source string")
