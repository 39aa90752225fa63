"""Spans: where patterns and phrases occur, which of them overlap, and what stands in their place.

A span row has (doc_id, start, end, value, type, confidence, source); offsets are code points, half-open.
Finding is narrow: arrays per document, exploded only where something was found. Resolution shuffles spans
by document, never text.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.validators import VALIDATORS
from .dims import Pattern


def bound(value: Column, use) -> Column:
    """use(value), with the value worked out once for each row."""
    return F.transform(F.array(value), use)[0]


def matches(text: Column, regex: str, around: bool = False) -> Column:
    """array<struct<start,end,value>> of all matches, left to right; with `around` also the characters before and after.

    Offsets are sums over what lies between the matches, taken in blocks of 64, so that a text's cost grows little faster than
    its matches. Texts without a match are not taken apart.
    """
    some = 64

    def offsets(lengths: Column) -> Column:
        add = lambda acc, x: acc + x
        total = lambda xs, first, n: F.aggregate(F.slice(xs, first, n), F.lit(0), add)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / some).cast("int")), lambda k: total(lengths, k * some + 1, F.lit(some)))
        before = bound(blocks, lambda xs: F.transform(xs, lambda _, i: total(xs, F.lit(1), i)))
        return bound(before, lambda xs: F.transform(lengths, lambda _, i: xs[F.floor(i / some).cast("int")] + total(lengths, i - i % some + 1, i % some)))

    def spans_of(s: Column) -> Column:
        value, gap = s["value"], s["gap"]
        ahead = F.zip_with(F.slice(gap, F.lit(1), F.size(value)), value, lambda g, v: F.length(g) + F.length(v))

        def one(at: Column, v: Column, i: Column) -> Column:
            start = at[i] + F.length(gap[i])
            fields = [start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value")]
            if around:
                fields += [F.right(F.concat(F.when(i > 0, F.get(value, i - 1)).otherwise(""), gap[i]), F.lit(1)).alias("before")]
                fields += [F.left(F.concat(gap[i + 1], F.when(i + 1 < F.size(value), F.get(value, i + 1)).otherwise("")), F.lit(1)).alias("after")]
            return F.struct(*fields)

        return bound(bound(ahead, offsets), lambda at: F.transform(value, lambda v, i: one(at, v, i)))

    taken = lambda found: F.when(F.size(found) > 0, bound(F.struct(found.alias("value"), F.split(text, regex, -1).alias("gap")), spans_of))
    more = ",before:string,after:string" if around else ""
    return F.coalesce(bound(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), taken), F.expr(f"CAST(array() AS array<struct<start:int,end:int,value:string{more}>>)"))


def scan(docs: DataFrame, patterns: list[Pattern], text: str = "text", validate: bool = True, source: str = "regex", confidence: float = 1.0, only=None) -> DataFrame:
    """Spans of all patterns over doc_id and text. Texts are only searched for patterns that they hold a needed part of.

    only(pattern): a condition on columns of docs under which a row is searched for the pattern. No row carries text past the
    search: a match brings the characters beside it.
    """
    kept = docs.where(F.col(text).isNotNull())
    empty = F.expr("CAST(array() AS array<struct<start:int,end:int,value:string,before:string,after:string>>)")
    per = []
    for p in patterns:
        found, due = matches(F.col(text), p.regex, around=True), [F.contains(text, F.lit(part)) for part in p.needs]
        gate = functools.reduce(Column.__or__, due) if due else None
        if only is not None:
            gate = only(p) if gate is None else only(p) & gate
        per.append(found if gate is None else F.when(gate, found).otherwise(empty))
    tagged = F.array(*(F.struct(F.lit(p.key).alias("pattern"), F.lit(p.type).alias("type"), found.alias("found")) for p, found in zip(patterns, per, strict=True)))
    long = kept.select("doc_id", F.explode(F.filter(tagged, lambda t: F.size(t["found"]) > 0)).alias("p")).select("doc_id", "p.pattern", "p.type", F.explode("p.found").alias("m"))
    out = long.select("doc_id", "pattern", "type", "m.*")
    if validate:
        verdict = F.lit(True)
        for p in patterns:
            if p.validator:
                verdict = F.when(F.col("pattern") == p.key, VALIDATORS[p.validator](F.col("value"))).otherwise(verdict)
        guarded = [p.key for p in patterns if p.guard]
        if guarded:
            verdict = verdict & (~F.col("pattern").isin(guarded) | ~F.regexp_like(F.concat("before", "after"), F.lit("[0-9]")))
        out = out.where(verdict)
    return out.select("doc_id", "start", "end", "value", "type", F.lit(confidence).alias("confidence"), F.lit(source).alias("source"), "pattern")


def resliced(found: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """Spans found in masked texts, with their values as they are in the documents."""
    whole = docs.select("doc_id", F.col(text).alias("whole"))
    return found.join(whole, "doc_id").withColumn("value", F.substring("whole", F.col("start") + 1, F.col("end") - F.col("start"))).drop("whole")


def tokens(text: Column, lower: bool = True) -> Column:
    """array<struct<start,end,value>> of words: letters and digits, with hyphens and apostrophes inside."""
    return matches(F.lower(text) if lower else text, r"[\p{L}\p{N}](?:[\p{L}\p{N}'-]*[\p{L}\p{N}])?")


def beside(df: DataFrame, most_rows: int = 1 << 18) -> DataFrame:
    """df, marked for broadcast if it is counted to have at most so many rows; a larger one is joined by shuffle, where hot keys are split at run time."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def dealt(df: DataFrame) -> DataFrame:
    """df, to be joined by shuffle. Spark guesses the size of rows made from keys by the keys' files, a fraction of what the driver would hold to broadcast them."""
    return df.hint("merge")


def phrase_scan(docs: DataFrame, phrases: DataFrame, text: str = "text", most: int = 3, confidence: float = 0.7, source: str = "keyword") -> DataFrame:
    """Spans of dictionary phrases (phrase, type, rank) of up to `most` words; longer ones first, none overlapping.

    Words that begin no phrase go first, by a semi join; n-grams are only made of those left, and join the dictionary by
    equality, so it may be of any size (Spark broadcasts it while its own estimate is small). A word's row holds the words
    that may follow it, never the text. Of one phrase's types the smallest rank wins.
    """
    one = phrases.groupBy(F.lower("phrase").alias("phrase")).agg(F.min_by("type", "rank").alias("type"))
    heads = one.select(F.substring_index("phrase", " ", 1).alias("head")).distinct()
    following = bound(tokens(F.col(text)), lambda w: F.transform(w, lambda x, i: F.slice(w, i + 1, F.lit(most))))
    begun = docs.select("doc_id", F.explode(following).alias("w")).withColumn("head", F.col("w")[0]["value"]).join(beside(heads), "head", "left_semi")
    grams = begun.select("doc_id", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("n"))
    said = grams.select("doc_id", "n", F.expr("w[0].start").alias("start"), F.expr("w[n - 1].end").alias("end"), F.expr("array_join(transform(slice(w, 1, n), x -> x.value), ' ')").alias("phrase"))
    hits = said.join(one, "phrase").select("doc_id", "n", "start", "end", F.col("phrase").alias("value"), "type")
    return longest_first(hits).select("doc_id", "start", "end", "value", "type", F.lit(confidence).alias("confidence"), F.lit(source).alias("source"))


def longest_first(hits: DataFrame) -> DataFrame:
    """Hits (n words) that no accepted hit of more words, or as many and further left, overlaps."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("start").alias("start"), F.col("end").alias("end"), F.col("value").alias("value"), F.col("type").alias("type"))))
    kept = F.aggregate(
        "hits",
        F.expr("CAST(array() AS array<struct<k:int,start:int,end:int,value:string,type:string>>)"),
        lambda acc, h: F.when(F.exists(acc, lambda a: (h["start"] < a["end"]) & (h["end"] > a["start"])), acc).otherwise(F.concat(acc, F.array(h))),
    )
    per = hits.groupBy("doc_id").agg(ordered.alias("hits"))
    return per.select("doc_id", F.explode(kept).alias("h")).select("doc_id", "h.start", "h.end", "h.value", "h.type")


def names_scan(docs: DataFrame, first: DataFrame, last: DataFrame, text: str = "text") -> DataFrame:
    """Person spans: a first name before a surname (0.7), else a single known name (0.4). Case matters. first, last: (name)."""
    words = docs.select("doc_id", F.posexplode(tokens(F.col(text), lower=False)).alias("i", "w")).select("doc_id", "i", F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col("w.value").alias("value"))
    listed = first.select(F.col("name").alias("value"), F.lit(True).alias("f"), F.lit(False).alias("l")).unionByName(last.select(F.col("name").alias("value"), F.lit(False).alias("f"), F.lit(True).alias("l")))
    # one join that only known names pass; what follows sees no other word
    known = words.join(beside(listed.groupBy("value").agg(F.max("f").alias("is_first"), F.max("l").alias("is_last"))), "value")
    w = Window.partitionBy("doc_id").orderBy("i")
    near = known.withColumn("next_i", F.lead("i").over(w)).withColumn("next_last", F.lead("is_last").over(w)).withColumn("next_end", F.lead("end").over(w)).withColumn("next_value", F.lead("value").over(w))
    pair = F.coalesce(F.col("is_first") & (F.col("next_i") == F.col("i") + 1) & F.col("next_last"), F.lit(False))
    marked = near.withColumn("pair", pair).withColumn("taken", F.coalesce(F.lag("pair").over(w), F.lit(False)))
    # in a run of names each pair takes two words, so a word that ends a pair can't begin one
    runs = marked.withColumn("begins", F.when(F.col("pair") & ~F.col("taken"), 1).otherwise(0)).withColumn("run", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = runs.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("i"))).withColumn("own", F.col("pair") & (F.col("k") % 2 == 1)).withColumn("second", F.coalesce(F.lag("own").over(w), F.lit(False)))
    return at.where("NOT second OR own").select(
        "doc_id", "start", F.when(F.col("own"), F.col("next_end")).otherwise(F.col("end")).alias("end"), F.when(F.col("own"), F.concat("value", F.lit(" "), "next_value")).otherwise(F.col("value")).alias("value"),
        F.lit("person").alias("type"), F.when(F.col("own"), 0.7).otherwise(0.4).alias("confidence"), F.lit("gazetteer").alias("source"),
    )


def greedy(spans: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Left to right, longer first: a span stays if it starts where the last kept one ended, or later."""
    return _folded(spans, keys, lambda acc, s: F.when((F.size(acc) == 0) | (s["start"] >= F.element_at(acc, -1)["end"]), F.concat(acc, F.array(s))).otherwise(acc))


def adjacent(spans: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Left to right: of a span and the last kept one that it overlaps, the longer stays."""

    def step(acc, s):
        last = F.element_at(acc, -1)
        longer = (s["end"] - s["start"]) > (last["end"] - last["start"])
        return F.when((F.size(acc) == 0) | (s["start"] >= last["end"]), F.concat(acc, F.array(s))).when(longer, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(s))).otherwise(acc)

    return _folded(spans, keys, step)


def _folded(spans: DataFrame, keys, step) -> DataFrame:
    rest = [c for c in spans.columns if c not in (*keys, "start", "end")]
    row = F.struct("start", (-F.col("end")).alias("back"), "end", *rest)
    per = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("all"))
    empty = F.slice("all", 1, 0)
    return per.select(*keys, F.explode(F.aggregate("all", empty, step)).alias("s")).select(*keys, "s.start", "s.end", *(f"s.{c}" for c in rest))


def clusters(spans: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """spans with cluster: 1, 2, ... for maximal sets linked by overlap, left to right."""
    order = [*keys]
    w = Window.partitionBy(*order).orderBy("start", "end", *[c for c in ("type", "source", "value") if c in spans.columns])
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("new", F.when(reach.isNull() | (reach <= F.col("start")), 1).otherwise(0)).withColumn("cluster", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def vote(spans: DataFrame, keys: tuple[str, ...] = ("doc_id",), bonus: float = 0.15, least: float = 0.5) -> DataFrame:
    """One winner for each cluster.

    For each type its best confidence, plus the bonus (at most 1) if two kinds of source agree; a lone span keeps its own. The
    best type wins; ties go to the longer span, then the earlier, then the type's name. Winners under `least` go.
    """
    own = [*keys, "cluster"]
    found = clusters(spans, keys)
    size = Window.partitionBy(*own)
    by_type = (
        found.withColumn("n", F.count(F.lit(1)).over(size))
        .groupBy(*own, "type")
        .agg(
            F.max(F.struct("confidence", (F.col("end") - F.col("start")).alias("length"), (-F.col("start")).alias("early"), "start", "end", "value")).alias("best"),
            F.count_distinct("source").alias("sources"),
            F.max("n").alias("n"),
        )
    )
    score = F.when((F.col("n") > 1) & (F.col("sources") > 1), F.least(F.lit(1.0), F.col("best.confidence") + bonus)).otherwise(F.col("best.confidence"))
    ranked = by_type.withColumn("confidence", score).withColumn("rank", F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("confidence"), F.desc("best.length"), "best.start", "type")))
    return ranked.where((F.col("rank") == 1) & (F.col("confidence") >= least)).select(*keys, "best.start", "best.end", "best.value", "type", "confidence", "sources")


def spliced(docs: DataFrame, spans: DataFrame, text: str = "text", by: str = "replacement") -> DataFrame:
    """docs with `text` where each span (doc_id, start, end, replacement; none overlapping) is replaced, in one pass from the left."""
    per = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col(by).alias("by")))).alias("cuts"))
    step = lambda acc, s: F.struct(
        s["end"].alias("at"), F.concat(acc["out"], F.substring("text_", acc["at"] + 1, s["start"] - acc["at"]), s["by"]).alias("out")
    )
    done = F.aggregate("cuts", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring("text_", acc["at"] + 1, F.length("text_"))))
    joined = docs.withColumnRenamed(text, "text_").join(dealt(per), "doc_id", "left")
    return joined.withColumn(text, F.when(F.col("cuts").isNull(), F.col("text_")).otherwise(done)).select(*docs.columns)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two structs with x_min, y_min, x_max, y_max."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    area = lambda c: (c["x_max"] - c["x_min"]) * (c["y_max"] - c["y_min"])
    inter = side("x_min", "x_max") * side("y_min", "y_max")
    whole = area(a) + area(b) - inter
    return F.when(whole > 0, inter / whole).otherwise(0.0)


def non_maximum(boxes: DataFrame, key: str = "image_id", threshold: float = 0.5) -> DataFrame:
    """Boxes that none of higher confidence, itself kept, overlaps by more than the threshold. Ties go to the smaller box_id."""
    row = F.struct((-F.col("confidence")).alias("k"), "box_id", "x_min", "y_min", "x_max", "y_max", "confidence")
    per = boxes.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("all"))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, b: F.when(F.exists(acc, lambda a: iou(a, b) > threshold), acc).otherwise(F.concat(acc, F.array(b))))
    return per.select(key, F.explode(kept).alias("b")).select(key, "b.box_id", "b.confidence")
