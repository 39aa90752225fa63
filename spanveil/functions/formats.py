"""Response and stream formats of chat providers, as native expressions over JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _is(body: Column, path: str, kind: str) -> Column:
    """Whether the JSON at a path begins like a list, a string or anything."""
    got = F.get_json_object(body, path)
    return got.startswith("[") if kind == "list" else got.isNotNull()


def is_json(body: Column) -> Column:
    return F.try_parse_json(body).isNotNull()


def response_format(content_type: Column, body: Column) -> Column:
    """anthropic, openai, gemini, cohere, ollama, unknown_json, plain_text or opaque, the first that fits."""
    ct = F.lower(content_type)
    plain = ct.startswith("text/plain") | ct.startswith("text/markdown")
    odd = ~ct.contains("json") & ~ct.startswith("text/")
    blocks = F.from_json(F.get_json_object(body, "$.content"), "array<struct<type:string,text:string>>")
    choices = F.from_json(F.get_json_object(body, "$.choices"), "array<struct<message:struct<content:string>>>")
    candidates = F.from_json(F.get_json_object(body, "$.candidates"), "array<struct<content:struct<parts:array<string>>>>")
    generations = F.from_json(F.get_json_object(body, "$.generations"), "array<struct<text:string>>")
    some = lambda c, test: F.coalesce(F.exists(c, test), F.lit(False))
    return (
        F.when(plain, "plain_text")
        .when(odd | (body == "") | body.isNull(), "opaque")
        .when(~is_json(body), F.when(content_type.isNull(), "plain_text").otherwise("opaque"))
        .when(some(blocks, lambda b: b["type"].isNotNull() & b["text"].isNotNull()), "anthropic")
        .when(some(choices, lambda c: c["message"]["content"].isNotNull()), "openai")
        .when(some(candidates, lambda c: c["content"]["parts"].isNotNull()), "gemini")
        .when(F.get_json_object(body, "$.text").isNotNull() | some(generations, lambda g: g["text"].isNotNull()), "cohere")
        .when(F.get_json_object(body, "$.model").isNotNull() & (F.get_json_object(body, "$.message.content").isNotNull() | F.get_json_object(body, "$.response").isNotNull()), "ollama")
        .otherwise("unknown_json")
    )


def response_text(kind: Column, body: Column) -> Column:
    """All text of a response, parts joined by a space; null if there is none."""
    joined = lambda path, schema, pick: F.array_join(F.filter(F.transform(F.from_json(F.get_json_object(body, path), schema), pick), lambda x: x.isNotNull()), " ")
    text = (
        F.when(kind == "anthropic", joined("$.content", "array<struct<text:string>>", lambda b: b["text"]))
        .when(kind == "openai", joined("$.choices", "array<struct<message:struct<content:string>>>", lambda c: c["message"]["content"]))
        .when(kind == "gemini", F.array_join(F.flatten(F.transform(F.from_json(F.get_json_object(body, "$.candidates"), "array<struct<content:struct<parts:array<struct<text:string>>>>>"), lambda c: F.transform(c["content"]["parts"], lambda p: p["text"]))), " "))
        .when(kind == "cohere", F.coalesce(F.get_json_object(body, "$.text"), joined("$.generations", "array<struct<text:string>>", lambda g: g["text"])))
        .when(kind == "ollama", F.coalesce(F.get_json_object(body, "$.message.content"), F.get_json_object(body, "$.response")))
        .when(kind == "plain_text", body)
    )
    return F.when(text != "", text)


def with_warning(kind: Column, body: Column, label: Column) -> Column:
    """The body with the label before its first text; null where the format has no place for it.

    The first text's JSON string is found as written, so keys, numbers and spacing elsewhere stay as they are.
    """
    quoted = F.to_json(F.struct(label.alias("x")))  # {"x":"..."}
    escaped = F.substring(quoted, F.lit(7), F.length(quoted) - 8)
    key = F.when(kind == "anthropic", "text").when(kind == "openai", "content").when(kind == "gemini", "text").when(kind == "cohere", "text").when(kind == "ollama", F.when(F.get_json_object(body, "$.message.content").isNotNull(), "content").otherwise("response"))
    mark = F.concat(F.lit('"'), key, F.lit('"'))
    opening = F.call_function("regexp_extract", body, F.concat(F.lit("^([\\s\\S]*?"), mark, F.lit('\\s*:\\s*")')), F.lit(1))
    return F.when(kind == "plain_text", F.concat(label, body)).when(key.isNotNull() & (opening != ""), F.concat(opening, escaped, F.substring(body, F.length(opening) + 1, F.length(body))))


def stream_delta(data: Column) -> tuple[Column, Column]:
    """(format, text) of one event's JSON."""
    paths = [("anthropic", "$.delta.text"), ("openai", "$.choices[0].delta.content"), ("gemini", "$.candidates[0].content.parts[0].text"), ("generic", "$.text"), ("generic", "$.content")]
    kind = F.coalesce(*(F.when(F.get_json_object(data, p).isNotNull(), F.lit(k)) for k, p in paths))
    return kind, F.coalesce(*(F.get_json_object(data, p) for _, p in paths))


def delta_event(kind: Column, text: Column) -> Column:
    """One event that carries text in the stream's format."""
    of = lambda name: F.to_json(F.struct(text.alias(name)))
    body = (
        F.when(kind == "anthropic", F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.struct(F.lit("text_delta").alias("type"), text.alias("text")).alias("delta"))))
        .when(kind == "openai", F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("delta"))).alias("choices"))))
        .when(kind == "gemini", F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(text.alias("text"))).alias("parts")).alias("content"))).alias("candidates"))))
        .otherwise(of("text"))
    )
    return F.concat(F.lit("data: "), body, F.lit("\n\n"))
