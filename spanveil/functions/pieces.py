"""Sub-word pieces, chunks of long texts and span repair, as Arrow functions over the caller's vocabulary."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKS = re.compile(r"[\w']+|[^\w\s]", re.UNICODE)


def pieces_of(text: str, vocabulary: dict[str, int], cased: bool, unknown: str = "[UNK]", most: int = 512) -> list[int]:
    """Ids of the longest pieces from the left; a word's later pieces begin with ##; a word with no way through is one unknown."""
    out: list[int] = []
    for word in MARKS.findall(text if cased else text.lower()):
        start, own = 0, []
        while start < len(word):
            end = next((e for e in range(len(word), start, -1) if ("##" if start else "") + word[start:e] in vocabulary), None)
            if end is None:
                own = [vocabulary[unknown]]
                break
            own.append(vocabulary[("##" if start else "") + word[start:end]])
            start = end
        out += own
    return out[:most]


def pieces(text: Column, vocabulary: list[str], most: int = 512) -> Column:
    """Piece ids; texts are lower-cased unless some piece of the vocabulary has capitals (special ones in brackets apart)."""
    ids = {p: i for i, p in enumerate(vocabulary)}
    cased = any(p != p.lower() for p in vocabulary if not p.startswith("["))

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pieces_of(t or "", ids, cased, most=most))

    return run(text)


def chunked(docs: DataFrame, most: int = 800, overlap: int = 150) -> DataFrame:
    """(doc_id, at, chunk): parts of at most `most` bytes, cut after white space where there is some, each with `overlap` bytes of the one before."""

    def cuts(text: str) -> Iterator[tuple[int, str]]:
        sizes = [len(c.encode("utf-8", "replace")) for c in text]
        start = 0
        while start < len(text):
            end, size = start, 0
            while end < len(text) and size + sizes[end] <= most:
                size += sizes[end]
                end += 1
            end = max(end, start + 1)
            if end < len(text):
                space = max((i for i in range(start + 1, end) if text[i - 1].isspace()), default=end)
                end = space if space > start + (end - start) // 2 else end
            yield start, text[start:end]
            if end >= len(text):
                return
            back, size = end, 0
            while back > start + 1 and size + sizes[back - 1] <= overlap:
                back -= 1
                size += sizes[back]
            start = back if back > start else end

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(d, a, c) for d, t in zip(b["doc_id"], b["text"], strict=True) for a, c in cuts(t or "")], columns=["doc_id", "at", "chunk"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, at int, chunk string")


def merged_chunks(spans: DataFrame) -> DataFrame:
    """Spans of overlapping chunks: of one type's spans that touch, the first stays. spans: (doc_id, start, end, value, type, ...)."""
    from ..operators.spans import _folded

    return _folded(spans, ("doc_id", "type"), lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]), acc).otherwise(F.concat(acc, F.array(s))))


def repaired(text: Column, span: Column, least: float = 0.6) -> Column:
    """The part of the text that a span means: as it stands, without regard to case, else the window most like it, if alike enough."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, spans, strict=True):
            if not t or not s:
                out.append(None)
            elif s in t:
                out.append(s)
            elif (at := t.lower().find(s.lower())) >= 0 and len(t.lower()) == len(t):
                out.append(t[at : at + len(s)])
            else:
                words, n = t.split(), max(1, len(s.split()))
                windows = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
                ratios = [difflib.SequenceMatcher(None, w.lower(), s.lower()).ratio() for w in windows]
                best = max(range(len(windows)), key=lambda i: (ratios[i], -i))
                out.append(windows[best] if ratios[best] >= least else None)
        return pd.Series(out, dtype=object)

    return run(text, span)


def bio_label(index: Column, labels: list[str] | None = None) -> Column:
    """A model's class as its BIO label; eleven labels where none are given."""
    own = labels or ["O", "B-PER", "I-PER", "B-LOC", "I-LOC", "B-ORG", "I-ORG", "B-HEALTH", "I-HEALTH", "B-CHILD", "I-CHILD"]
    return F.coalesce(F.get(F.array(*map(F.lit, own)), index), F.lit("O"))


def engine_for(wanted: Column, has_model: Column, has_crf: Column) -> Column:
    """The engine that runs: the one wanted if there is one, else the next simpler one."""
    return F.when(wanted.isin("auto", "ner") & has_model, "ner").when((wanted != "regex") & has_crf, "crf").otherwise("regex")
