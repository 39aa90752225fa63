"""Pseudonymising spans and restoring them: ciphertexts that keep the format, tokens, and the mapping between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import crypto
from ..functions.text import plain_dashes, unescaped
from .dims import TYPES
from .spans import dealt, matches, spliced

OF = {name: (radix, least, label, prefix) for name, radix, least, label, prefix in TYPES}


def of_type(kind: Column, at: int) -> Column:
    """A property of a type: radix (0), least length (1), label (2) or token prefix (3)."""
    return F.element_at(F.create_map(*(F.lit(x) for name in OF for x in (name, OF[name][at]))), kind)


def parts(value: Column, kind: Column) -> tuple[Column, Column, Column]:
    """What stays before, what is encrypted, what stays after: an email's local part, an IBAN without its country, else all."""
    low = F.when(kind.isin("email", "ipv6_address", "mac_address", "iban"), F.lower(value)).otherwise(value)
    before = F.when(kind == "iban", F.substring(value, 1, 2)).otherwise("")
    middle = F.when(kind == "email", F.substring_index(low, "@", 1)).when(kind == "iban", F.substring(low, F.lit(3), F.length(low))).otherwise(low)
    after = F.when(kind == "email", F.concat(F.lit("@"), F.substring_index(low, "@", -1))).otherwise("")
    return before, middle, after


def bare(text: Column, kind: Column) -> Column:
    """Characters of the type's alphabet only."""
    radix = of_type(kind, 0)
    return (
        F.when(radix == 10, F.regexp_replace(text, "[^0-9]", "")).when(radix == 16, F.regexp_replace(text, "[^0-9a-f]", "")).when(radix == 36, F.regexp_replace(text, "[^0-9a-z]", "")).otherwise(F.regexp_replace(text, "[^0-9A-Za-z]", ""))
    )


def sealed(value: Column, kind: Column, tweak: Column, key: bytes, decrypt: bool = False) -> Column:
    """Ciphertext (or plaintext) in the value's own format; null where the type has none or the value is too short."""
    before, middle, after = parts(value, kind)
    return F.concat(before, crypto.ff1_column(middle, tweak, of_type(kind, 0), of_type(kind, 1), key, decrypt), after)


def encoded(spans: DataFrame, key: bytes, fail_open: bool = True) -> DataFrame:
    """spans (request_id, doc_id, start, end, value, type) with place, replacement and route. Spans of a JSON body name their leaf (path), so equal offsets in two leaves have two tweaks.

    Types with an alphabet are encrypted under a tweak of request and place; what is too short for that gets a token, or with
    fail_open off the type's label and no mapping. Other types get tokens.
    """
    leaf = F.col("path") if "path" in spans.columns else F.lit("m")
    place = F.concat(leaf, F.lit(":"), F.col("start").cast("string"))
    out = spans.withColumn("place", place).withColumn("cipher", sealed(F.col("value"), F.col("type"), crypto.tweak(F.col("request_id"), place), key))
    token = crypto.token(of_type(F.col("type"), 3), F.col("request_id"), F.col("value"))
    eligible = of_type(F.col("type"), 0) > 0
    closed = F.concat(F.lit("[REDACTED:"), F.col("type"), F.lit("]"))
    route = F.when(F.col("cipher").isNotNull(), "cipher").when(eligible & F.lit(not fail_open), "closed").otherwise("token")
    return out.withColumn("route", route).withColumn("replacement", F.when(F.col("route") == "cipher", F.col("cipher")).when(F.col("route") == "closed", closed).otherwise(token)).drop("cipher")


def collisions_resolved(tokens: DataFrame) -> DataFrame:
    """tokens (request_id, base, value, seen) with token: the base for the value seen first, then the base with b, c, ..., z, then a second hash."""
    first = tokens.groupBy("request_id", "base", "value").agg(F.min("seen").alias("seen"))
    rank = F.row_number().over(Window.partitionBy("request_id", "base").orderBy("seen", "value"))
    again = F.concat("base", F.lit("_"), crypto.base36_4(F.substring(F.sha2(F.concat("base", "value"), 256), 1, 8)))
    return first.withColumn("rank", rank).select(
        "request_id", "base", "value", "seen", F.when(F.col("rank") == 1, F.col("base")).when(F.col("rank") <= 26, F.concat("base", F.char(F.col("rank") + 96))).otherwise(again).alias("token")
    )


def sanitized(docs: DataFrame, spans: DataFrame, key: bytes, fail_open: bool = True) -> tuple[DataFrame, DataFrame]:
    """(docs with spans replaced, mapping (request_id, doc_id, place, ciphertext, plaintext, type)). docs: (request_id, doc_id, text)."""
    coded = encoded(spans, key, fail_open)
    mapping = coded.where("route <> 'closed'").select("request_id", "doc_id", "place", F.col("replacement").alias("ciphertext"), F.col("value").alias("plaintext"), "type")
    return spliced(docs, coded.select("doc_id", "start", "end", "replacement")), mapping


def one_per_plaintext(spans: DataFrame, order: list[str]) -> DataFrame:
    """spans with replacement: the one given to the plaintext where a conversation (conv_id) first had it, in the given order."""
    w = Window.partitionBy("conv_id", "type", "value").orderBy(*order)
    return spans.withColumn("replacement", F.first("replacement").over(w))


def sanitized_messages(messages: DataFrame, spans: DataFrame, prior: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(messages with spans replaced, the mapping's new entries (conv_id, value, replacement, type)).

    messages: (conv_id, turn, role, text); spans: (conv_id, turn, start, end, value, type, replacement), none overlapping; prior:
    (conv_id, value, replacement), what earlier requests gave. Assistant turns stay as they are. A value has one replacement in
    a conversation: the prior one, else that of its first place.
    """
    asked = messages.where("role <> 'assistant'").select("conv_id", "turn")
    own = spans.join(asked, ["conv_id", "turn"], "left_semi")
    first = own.groupBy("conv_id", "value").agg(F.min_by(F.struct("replacement", "type"), F.struct("turn", "start")).alias("f")).select("conv_id", "value", F.col("f.replacement").alias("given"), F.col("f.type").alias("type"))
    if prior is not None:
        known = prior.groupBy("conv_id", "value").agg(F.min("replacement").alias("before"))
        first = first.join(known, ["conv_id", "value"], "left").withColumn("given", F.coalesce("before", "given"))
    else:
        first = first.withColumn("before", F.lit(None).cast("string"))
    named = own.drop("replacement", "type").join(first.select("conv_id", "value", F.col("given").alias("replacement")), ["conv_id", "value"])
    place = lambda df: df.withColumn("doc_id", F.concat_ws("#", "conv_id", "turn"))
    out = spliced(place(messages), place(named).select("doc_id", "start", "end", "replacement")).select(*messages.columns)
    return out, first.where("before IS NULL").select("conv_id", "value", F.col("given").alias("replacement"), "type")


def restored(texts: DataFrame, mapping: DataFrame, key: str = "doc_id", fuzzy: bool = True) -> DataFrame:
    """texts (key, text) with ciphertexts replaced by plaintexts, longest first; where one isn't found as it stands, with other separators."""
    row = F.struct((-F.length("ciphertext")).alias("k"), "ciphertext", "plaintext", "type")
    per = mapping.groupBy(key).agg(F.array_sort(F.collect_set(row)).alias("maps"))
    joined = texts.join(dealt(per), key, "left").withColumn("clean", plain_dashes(unescaped(F.col("text"))))
    quoted = lambda p: F.replace(F.replace(p, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))

    def step(acc: Column, m: Column) -> Column:
        exact = F.replace(acc, m["ciphertext"], m["plaintext"])
        if not fuzzy:
            return exact
        pattern = loose(m["ciphertext"], m["type"])
        return F.when(F.contains(acc, m["ciphertext"]), exact).when(pattern.isNotNull(), F.regexp_replace(acc, pattern, quoted(m["plaintext"]))).otherwise(acc)

    return joined.withColumn("text", F.when(F.col("maps").isNull(), F.col("clean")).otherwise(F.aggregate("maps", F.col("clean"), step))).select(*texts.columns)


#: types whose values are written in several layouts, and how many characters one must have to be told from other text
LAID_OUT = {"phone": 10, "ssn": 9, "credit_card": 13, "iban": 15}


def loose(cipher: Column, kind: Column) -> Column:
    """A pattern of a ciphertext in any layout: its letters and digits in order, in either case, whatever spaces, dots, dashes and
    brackets stand between; a country's 1 before ten digits may be missing. Null for types of one layout and short values."""
    least = F.element_at(F.create_map(*(F.lit(x) for pair in LAID_OUT.items() for x in pair)), kind)
    chars = F.regexp_extract_all(cipher, F.lit("[0-9A-Za-z]"), F.lit(0))
    optional = (kind == "phone") & (F.size(chars) == 11) & (chars[0] == "1")
    body = F.array_join(F.when(optional, F.slice(chars, 2, 10)).otherwise(chars), r"[-.\s()]*")
    head = F.when(optional, F.lit(r"(?:\+?1[-.\s]*)?")).otherwise("")
    return F.when(F.size(chars) >= least, F.concat(F.lit(r"(?i)(?<![0-9A-Za-z])"), head, F.lit(r"\(?"), body, F.lit("(?![0-9A-Za-z])")))


def lite(docs: DataFrame, labels: dict[str, str] | None = None, semantic: DataFrame | None = None) -> DataFrame:
    """The small redactor: five patterns, first match wins, labels in place of values.

    semantic: spans (doc_id, start, end, value, type) of another engine, which come first: a pattern's match that overlaps one goes.
    Types without a label get their name in brackets. All offsets are of the text as it was.
    """
    from .dims import BASE
    from .spans import greedy, scan

    labels = labels or {"ssn": "[SSN]", "credit_card": "[CREDIT_CARD]", "phone": "[PHONE]", "email": "[EMAIL]", "api_key": "[API_KEY]"}
    found = scan(docs, [p for p in BASE if p.type in labels], validate=False).select("doc_id", "start", "end", "value", "type")
    if semantic is not None:
        first = semantic.select("doc_id", "start", "end", "value", "type")
        meets = (F.col("f.doc_id") == F.col("s.doc_id")) & (F.col("f.start") < F.col("s.end")) & (F.col("s.start") < F.col("f.end"))
        found = found.alias("f").join(first.alias("s"), meets, "left_anti").unionByName(first)
    found = greedy(found)
    label = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)), F.col("type")), F.concat(F.lit("["), F.upper("type"), F.lit("]")))
    return spliced(docs, found.withColumn("replacement", label))
