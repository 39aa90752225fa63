"""The whole scan: patterns, dictionaries, names, a sequence model and the patterns of the text's language, put to the vote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.io import Config
from . import dims, spans

KEPT = ["doc_id", "start", "end", "value", "type", "confidence", "source"]


def scanned_languages(text: Column, allowed: list[str] | None = None) -> Column:
    """array of the languages whose patterns a text is searched for: the one detected and those close to it, of those allowed (none named: all)."""
    own = {k: [x for x in v if not allowed or x in allowed] for k, v in dims.RELATED.items()}
    table = F.create_map(*(x for k, v in own.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))
    return F.coalesce(F.element_at(table, tx.language(text)), F.expr("CAST(array() AS array<string>)"))


def by_language(docs: DataFrame, allowed: list[str] | None = None, text: str = "text") -> DataFrame:
    """Spans of the patterns of each document's languages; of two that overlap in one language the longer stays."""
    patterns = [p for p in dims.LANGUAGE if not allowed or p.lang in allowed]
    if not patterns:
        patterns, docs = dims.LANGUAGE[:1], docs.where("false")
    marked = docs.select("doc_id", F.col(text).alias("text"), scanned_languages(F.col(text), allowed).alias("scanned"))
    found = spans.scan(marked.where(F.size("scanned") > 0), patterns, only=lambda p: F.array_contains("scanned", p.lang))
    lang = F.element_at(F.create_map(*(F.lit(x) for p in patterns for x in (p.key, p.lang))), F.col("pattern"))
    return spans.adjacent(found.withColumn("lang", lang).drop("pattern"), ("doc_id", "lang")).select(*KEPT)


def engines(docs: DataFrame, keywords: DataFrame | None = None, first: DataFrame | None = None, last: DataFrame | None = None, semantic: Callable[[DataFrame], DataFrame] | None = None, languages: list[str] | None = None) -> DataFrame:
    """Spans of all engines over docs (doc_id, text), before any of them is chosen."""
    found = [spans.scan(docs, dims.BASE), by_language(docs, languages)]
    if keywords is not None:
        found.append(spans.phrase_scan(docs, keywords))
    if first is not None and last is not None:
        found.append(spans.names_scan(docs, first, last))
    if semantic is not None:
        found.append(semantic(docs))
    out = found[0].select(*KEPT)
    for more in found[1:]:
        out = out.unionByName(more.select(*KEPT))
    return out


def detect(docs: DataFrame, keywords: DataFrame | None = None, first: DataFrame | None = None, last: DataFrame | None = None, semantic: Callable[[DataFrame], DataFrame] | None = None, config: Config | None = None) -> DataFrame:
    """doc_id, start, end, value, type, confidence, sources of the entities in docs (doc_id, text).

    Code in backticks is blanked first (config.respect_fences), without a change of offsets. keywords: (phrase, type, rank); first
    and last: (name); semantic: a model's scan. Languages are config.languages, or all. Overlapping spans vote. Values are of the
    text as it was: only documents with a backtick are read again for that. Ids must be unique; null texts have no spans. With
    config.passthrough nothing is scanned.
    """
    config = config or Config()
    rows = docs.select("doc_id", "text").where(F.lit(not config.passthrough))
    masked = rows.withColumn("text", F.when(F.contains("text", F.lit("`")), tx.fences_masked(F.col("text"))).otherwise(F.col("text"))) if config.respect_fences else rows
    won = spans.vote(engines(masked, keywords, first, last, semantic, config.languages), bonus=config.agreement_bonus, least=config.min_confidence)
    if not config.respect_fences:
        return won
    fenced = rows.where(F.contains("text", F.lit("`"))).withColumnRenamed("text", "whole")
    original = F.when(F.col("whole").isNotNull(), F.substring("whole", F.col("start") + 1, F.col("end") - F.col("start"))).otherwise(F.col("value"))
    return won.join(fenced, "doc_id", "left").withColumn("value", original).drop("whole")
