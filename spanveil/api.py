"""The engine's front door: texts in, spans, safe texts and reports out. Every function takes and returns DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import encode, hybrid, respond, spans
from .sources.io import Config

REQUEST = "00000000-0000-0000-0000-000000000000"


def detect(docs: DataFrame, config: Config | None = None, **lists) -> DataFrame:
    """Spans of docs (doc_id, text); see operators.hybrid.detect for lists (keywords, first, last, semantic)."""
    return hybrid.detect(docs, config=config, **lists)


def redact(docs: DataFrame, engine: str = "hybrid", config: Config | None = None, **lists) -> DataFrame:
    """docs with the name of its type in brackets for each span. engine: hybrid, or lite for five patterns alone."""
    if engine == "lite":
        return encode.lite(docs)
    if engine != "hybrid":
        raise ValueError(f"no engine {engine!r}")
    found = spans.greedy(detect(docs, config, **lists))
    return spans.spliced(docs, found.withColumn("replacement", F.concat(F.lit("["), F.upper("type"), F.lit("]"))))


def sanitize(docs: DataFrame, key: bytes, config: Config | None = None, **lists) -> tuple[DataFrame, DataFrame]:
    """(docs with spans replaced by ciphertexts and tokens, the mapping that restores them). docs may name a request_id for each row."""
    config = config or Config()
    named = docs if "request_id" in docs.columns else docs.withColumn("request_id", F.lit(REQUEST))
    found = spans.greedy(detect(named, config, **lists)).join(named.select("doc_id", "request_id"), "doc_id")
    safe, mapping = encode.sanitized(named, found, key, config.fail_open)
    return safe.select(*docs.columns), mapping


def restore(docs: DataFrame, mapping: DataFrame, fuzzy: bool = True) -> DataFrame:
    """docs with what sanitize hid; each document's own mapping counts."""
    return encode.restored(docs, mapping, fuzzy=fuzzy)


def scan_response(responses: DataFrame, config: Config | None = None, **classifier) -> DataFrame:
    """responses (doc_id, text) with the phrases' categories, severity and label."""
    config = config or Config()
    return respond.assessed(responses, level=config.sensitivity, least_flags=config.least_flags, **classifier)
