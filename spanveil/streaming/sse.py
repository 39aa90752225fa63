"""Event streams of chat providers: whole events out of chunks, text restored once a stream ends."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import delta_event, stream_delta


def events(chunks: DataFrame) -> DataFrame:
    """(stream_id, i, data) of a finished table of chunks (stream_id, seq, chunk): chunks joined in order, cut at line ends, data lines kept."""
    whole = chunks.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda c: c["chunk"]), "").alias("raw"))
    lines = whole.select("stream_id", F.posexplode(F.split("raw", "\r?\n")).alias("i", "line")).where(F.startswith("line", F.lit("data:")))
    return lines.select("stream_id", "i", F.trim(F.substring("line", 6, 1 << 30)).alias("data"))


def contents(chunks: DataFrame) -> DataFrame:
    """(stream_id, format, text, done): the text of each stream's deltas, in order; the first event that has one fixes the format."""
    kind, text = stream_delta(F.col("data"))
    rows = events(chunks).withColumn("format", F.when(F.col("data") != "[DONE]", kind)).withColumn("text", F.when(F.col("data") != "[DONE]", text))
    ordered = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("i", "format", "text"))))
    per = rows.groupBy("stream_id").agg(ordered.alias("parts"), F.max(F.col("data") == "[DONE]").alias("done"))
    return per.select("stream_id", F.get("parts", F.lit(0))["format"].alias("format"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"), "done")


def replayed(chunks: DataFrame, texts: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """(stream_id, at, event): what goes out of finished streams, numbered from 1.

    Data lines without content pass as they are. The content goes out as one event in the stream's format, its text from texts
    (stream_id, text), right before [DONE], or last where that never came; a warning (stream_id, warning) goes before it.
    Streams without content get no content event; streams without a text keep none of theirs.
    """
    kind, _ = stream_delta(F.col("data"))
    rows = events(chunks).withColumn("format", F.when(F.col("data") != "[DONE]", kind))
    ends = rows.groupBy("stream_id").agg(
        F.coalesce(F.min(F.when(F.col("data") == "[DONE]", F.col("i"))), F.max("i") + 1).alias("i"),
        F.min(F.when(F.col("format").isNotNull(), F.struct("i", "format")))["format"].alias("format"),
    )
    out = rows.where("format IS NULL").select("stream_id", "i", F.lit(2).alias("k"), F.concat(F.lit("data: "), "data", F.lit("\n\n")).alias("event"))
    said = ends.where("format IS NOT NULL").join(texts.where("text IS NOT NULL"), "stream_id")
    out = out.unionByName(said.select("stream_id", "i", F.lit(1).alias("k"), delta_event(F.col("format"), F.col("text")).alias("event")))
    if warnings is not None:
        warned = ends.join(warnings.where("warning IS NOT NULL"), "stream_id")
        out = out.unionByName(warned.select("stream_id", "i", F.lit(0).alias("k"), delta_event(F.coalesce("format", F.lit("generic")), F.col("warning")).alias("event")))
    return out.select("stream_id", F.row_number().over(Window.partitionBy("stream_id").orderBy("i", "k")).alias("at"), "event")


def released(chunks: DataFrame, hold: int) -> DataFrame:
    """(stream_id, seq, text): what each chunk lets go while the last `hold` characters are held back; a stream's last chunk lets all go."""
    rows = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("chunk", F.lit("")).alias("chunk"))))
    per = chunks.groupBy("stream_id").agg(rows.alias("rows"))
    empty = F.struct(F.lit("").alias("held"), F.expr("CAST(array() AS array<struct<seq:bigint,text:string>>)").alias("out"), F.lit(0).alias("n"))

    def step(acc, row):
        text = F.concat(acc["held"], row["chunk"])
        go = F.when(acc["n"] + 1 == F.size("rows"), F.length(text)).otherwise(F.greatest(F.length(text) - hold, F.lit(0)))
        sent = F.struct(row["seq"].cast("long").alias("seq"), F.substring(text, F.lit(1), go).alias("text"))
        return F.struct(F.substring(text, go + 1, F.length(text)).alias("held"), F.concat(acc["out"], F.array(sent)).alias("out"), (acc["n"] + 1).alias("n"))

    return per.select("stream_id", F.explode(F.aggregate("rows", empty, step, lambda acc: acc["out"])).alias("r")).select("stream_id", "r.seq", "r.text")


def collapsed(bodies: DataFrame) -> DataFrame:
    """(id, text, lines) of bodies (id, body) of two or more JSON lines with message.content: contents joined in order."""
    lines = bodies.select("id", F.posexplode(F.split("body", "\n")).alias("i", "line")).where(F.trim("line") != "")
    said = lines.withColumn("text", F.get_json_object("line", "$.message.content"))
    per = said.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "").alias("text"), F.count(F.lit(1)).cast("long").alias("lines"))
    return per.where("lines >= 2")


STATE, OUT = "held string, waiting string, next long", "stream_id string, format string, text string"


def contents_streaming(chunks: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """The same of a stream of chunks: one row for each stream, when its [DONE] has come. Chunks may come out of order, also across batches.

    Events that aren't JSON have no content. With ttl_ms, a stream that has been silent for so long is forgotten; nothing of it goes out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, waiting, at = state.get if state.exists else ("", "{}", 0)
        early = {int(k): v for k, v in json.loads(waiting).items()}
        for batch in batches:
            early |= dict(zip(batch["seq"].tolist(), batch["chunk"].tolist(), strict=True))
        while at in early:
            held += early.pop(at)
            at += 1
        lines = held.split("\n")
        data = [line[5:].strip() for line in lines[:-1] if line.startswith("data:")]
        if "[DONE]" in data:
            found = [f for f in map(pick, data[: data.index("[DONE]")]) if f]
            if state.exists:
                state.remove()
            yield pd.DataFrame([(key[0], found[0][0] if found else None, "".join(t for _, t in found))], columns=["stream_id", "format", "text"])
        else:
            state.update((held, json.dumps(early), at))
            if ttl_ms is not None:
                state.setTimeoutDuration(ttl_ms)

    return chunks.groupBy("stream_id").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout" if ttl_ms is None else "ProcessingTimeTimeout")


def pick(data: str) -> tuple[str, str] | None:
    """(format, text) of one event; None where it has no text or isn't JSON."""
    try:
        event = json.loads(data)
    except ValueError:
        return None

    def at(*keys):
        node = event
        for k in keys:
            try:
                node = node[k]
            except (KeyError, IndexError, TypeError):
                return None
        return node if isinstance(node, str) else None

    for kind, keys in (("anthropic", ("delta", "text")), ("openai", ("choices", 0, "delta", "content")), ("gemini", ("candidates", 0, "content", "parts", 0, "text")), ("generic", ("text",)), ("generic", ("content",))):
        if (text := at(*keys)) is not None:
            return kind, text
    return None


def buffered(text, most_bytes: int = 256 * 1024):
    """A text of at most so many bytes, cut where a character ends."""
    raw = F.encode(text, "UTF-8")
    inside = lambda i: F.hex(F.substring(raw, i, 1)).between("80", "BF")  # noqa: E731  a byte that continues a character
    size = F.lit(most_bytes)
    for back in (2, 1, 0):
        size = F.when(~inside(most_bytes - back + 1), most_bytes - back).otherwise(F.lit(most_bytes - 3) if back == 2 else size)
    return F.when(F.octet_length(text) <= most_bytes, text).otherwise(F.decode(F.substring(raw, F.lit(1), size), "UTF-8"))


def entity_windows(events_: DataFrame, width: str = "1 hour") -> DataFrame:
    """Counts of (ts, type) rows by tumbling window; with a watermark on streams."""
    return events_.withWatermark("ts", "10 minutes").groupBy(F.window("ts", width), "type").agg(F.count(F.lit(1)).alias("n"))

