"""Leaves of arbitrary JSON, and writing changed leaves back."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dims import SKIPPED_KEYS

LEAF = "path string, segments array<string>, value string, depth int"


def leaves_of(body: str | None, skipped: tuple[str, ...], nested: int = 2) -> list[tuple[str, list[str], str, int]]:
    """String leaves of a JSON text, depth first; strings that are JSON themselves are opened, `nested` levels deep.

    Skipped: keys by name at any depth, `data` beside a base64 type, and data:image strings. Numbers, booleans and nulls are no leaves.
    """
    out: list[tuple[str, list[str], str, int]] = []

    def walk(node, path: str, segments: list[str], depth: int) -> None:
        if isinstance(node, str):
            text = node.strip()
            if node.startswith("data:image/") and ";base64," in node:
                return
            if depth < nested and (text[:1] + text[-1:]) in ("{}", "[]"):
                try:
                    walk(json.loads(text), path, segments, depth + 1)
                    return
                except ValueError:
                    pass
            out.append((path, segments, node, depth))
        elif isinstance(node, dict):
            for k, v in node.items():
                if k in skipped or (k == "data" and node.get("type") == "base64"):
                    continue
                walk(v, f"{path}.{k}" if path else k, [*segments, k], depth)
        elif isinstance(node, list):
            for i, v in enumerate(node):
                walk(v, f"{path}[{i}]", [*segments, str(i)], depth)

    try:
        walk(json.loads(body or ""), "", [], 0)
    except ValueError:
        return []
    return out


def leaves(df: DataFrame, key: str, body: str, skipped: list[str] | None = None, nested: int = 2) -> DataFrame:
    """(key, path, segments, value, depth) of each string leaf; bodies that aren't JSON have none."""
    keys = tuple(SKIPPED_KEYS if skipped is None else skipped)
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {LEAF}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *leaf) for k, b in zip(batch[key], batch[body], strict=True) for leaf in leaves_of(b, keys, nested)]
            yield pd.DataFrame(rows, columns=[key, "path", "segments", "value", "depth"])

    return df.select(key, body).mapInPandas(run, schema)


def rewritten(body: Column, changes: Column) -> Column:
    """The JSON with leaves set: changes is array<struct<segments: array<string>, value: string>>. Key order and other values stay.

    A change whose segments lead nowhere, or through a string that isn't opened, is left out. Null where the body isn't JSON.
    """

    @F.pandas_udf("string")
    def run(bodies: pd.Series, all_changes: pd.Series) -> pd.Series:
        out = []
        for b, changes in zip(bodies, all_changes, strict=True):
            try:
                tree = json.loads(b or "")
            except ValueError:
                out.append(None)
                continue
            for c in changes if changes is not None else ():
                node, segments = tree, list(c["segments"])
                try:
                    for s in segments[:-1]:
                        node = node[int(s)] if isinstance(node, list) else node[s]
                    last = int(segments[-1]) if isinstance(node, list) else segments[-1]
                    if isinstance(node[last], str):
                        node[last] = c["value"]
                except (KeyError, IndexError, ValueError, TypeError):
                    continue
            out.append(json.dumps(tree, ensure_ascii=False, separators=(",", ":")))
        return pd.Series(out, dtype=object)

    return run(body, changes)


def url_images(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, path, segments, url) of image addresses to fetch, both shapes of content block; inline images have none."""
    last = lambda i: F.try_element_at("segments", F.lit(-i))
    holds = (last(1) == "url") & last(2).isin("image_url", "source")
    return leaves(df, key, body, nested=0).where(holds & F.regexp_like("value", F.lit("(?i)^https?://"))).select(key, "path", "segments", F.col("value").alias("url"))


def sanitized(requests: DataFrame, patterns: list, key: bytes, fail_open: bool = True) -> tuple[DataFrame, DataFrame]:
    """(requests (request_id, body) with entities in all string leaves replaced, mapping as in encode.sanitized; its doc_id is the leaf's).

    Strings that hold JSON are scanned as they are, so that they can be written back. Bodies that aren't JSON, or hold no
    entity, stay as they are. request_id is unique.
    """
    from .encode import sanitized as encode_spans
    from .spans import dealt, greedy, scan

    found = leaves(requests, "request_id", "body", nested=0).withColumn("doc_id", F.concat_ws("#", "request_id", "path"))
    texts = found.select("request_id", "doc_id", "path", "segments", F.col("value").alias("text"))
    hits = greedy(scan(texts, patterns).drop("pattern")).join(dealt(texts.select("doc_id", "request_id", "path")), "doc_id")
    safe, mapping = encode_spans(texts.join(dealt(hits.select("doc_id").distinct()), "doc_id", "left_semi"), hits, key, fail_open)
    changes = safe.groupBy("request_id").agg(F.collect_list(F.struct("segments", F.col("text").alias("value"))).alias("changes"))
    out = requests.join(dealt(changes), "request_id", "left")
    body = F.when(F.col("changes").isNotNull(), rewritten(F.col("body"), F.col("changes"))).otherwise(F.col("body"))
    return out.withColumn("body", body).drop("changes"), mapping


def media_blocks(df: DataFrame, key: str, messages: Column) -> DataFrame:
    """(key, at, kind, media_type, has_data, url) of image and audio blocks among message content (array<string> of JSON objects)."""
    got = lambda p: F.get_json_object("block", p)
    rows = df.select(key, F.posexplode(messages).alias("at", "block"))
    kind = (
        F.when((got("$.type") == "image") & got("$.source.type").isin("base64", "url"), "image")
        .when((got("$.type") == "image_url") & got("$.image_url.url").isNotNull(), "image")
        .when((got("$.type") == "audio") & got("$.source.data").isNotNull(), "audio")
        .when((got("$.type") == "input_audio") & got("$.input_audio.data").isNotNull(), "audio")
    )
    url = F.coalesce(got("$.source.url"), got("$.image_url.url"))
    inline = url.startswith("data:")
    media = F.coalesce(got("$.source.media_type"), F.when(inline, F.regexp_extract(url, "^data:([^;,]+)", 1)), got("$.input_audio.format"))
    has = F.coalesce(got("$.source.data").isNotNull() | got("$.input_audio.data").isNotNull() | inline, F.lit(False))
    return rows.withColumn("kind", kind).where("kind IS NOT NULL").select(key, "at", "kind", media.alias("media_type"), has.alias("has_data"), F.when(~F.coalesce(inline, F.lit(False)), url).alias("url"))
