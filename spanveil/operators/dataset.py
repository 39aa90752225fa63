"""Preparing and judging labelled data."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spans import dealt


def normalised_labels(rows: DataFrame, synonyms: DataFrame, column: str = "label") -> DataFrame:
    """label by the synonym table (synonym, label), else lower-cased with underscores."""
    key = F.lower(F.trim(F.col(column)))
    joined = rows.withColumn("synonym", key).join(synonyms.select(F.lower("synonym").alias("synonym"), F.col("label").alias("to")), "synonym", "left")
    return joined.withColumn(column, F.coalesce("to", F.regexp_replace("synonym", r"[\s-]+", "_"))).select(*rows.columns)


def first_of_each(rows: DataFrame, text: str, order: str) -> DataFrame:
    """Rows whose text, lower-cased and with single spaces, no earlier row has. Firsts are found by a combining aggregate, so copies of one text don't meet in a task."""
    key = F.lower(F.regexp_replace(F.trim(F.col(text)), r"\s+", " "))
    hashed = rows.withColumn("h_", F.sha2(key, 256))
    firsts = hashed.groupBy("h_").agg(F.min(order).alias("first_"))
    kept = hashed.join(firsts.withColumnRenamed("first_", order), ["h_", order], "left_semi")
    return kept.dropDuplicates(["h_"]).select(*rows.columns)


#: counts of grams are kept by so many values of their hash; texts up to so many characters go with their grams
SLOTS, CARRIED = 1 << 14, 256


def similar_pairs(rows: DataFrame, key: str, text: str, block: list[str], least: float = 0.85, length: float = 0.3, gram: int = 3) -> DataFrame:
    """(a, b, ratio) of all pairs of rows of one block whose lengths differ by at most `length` and whose edit ratio is `least` or more.

    The ratio is 1 - edit distance / longer length. No pair is missed: one edit spoils at most `gram` of a text's grams and one of
    those that don't overlap. A text's prefix is its `gram` * edits + 1 rarest grams, its pivots edits + 1 of them that don't overlap.
    Of two texts that few edits separate, the one whose prefix ends first has a pivot in the other's prefix; texts too short for that
    meet by block and length. Any order of grams is right, so it is that of counts by hash, which the driver keeps: grams that
    aren't in a prefix are never sent. Pairs are judged where they meet, so only similar ones are sent on; texts over
    `CARRIED` characters are fetched for the pairs that met.
    """
    low = least - 5e-5  # ratios are rounded
    n = F.length("t_")
    own = rows.select(F.col(key).alias("k_"), F.col(text).alias("t_"), *block).where(n > 0).dropna(subset=block)
    # few bytes make much work here: parts of a given number aren't put together by their size
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = own.repartition(parts, "k_")
    # at most so many edits, for the longer of the two is at most n / low long
    own = own.withColumn("n_", n).withColumn("e_", F.floor(n * ((1 - low) / low) + 1e-9).cast("int"))
    hashes = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n_") - gram + 1, F.lit(1))), lambda i: F.xxhash64(*block, F.substring("t_", i, F.lit(gram))))
    slot = lambda h: h.bitwiseAND(F.lit(SLOTS - 1)).cast("int")
    often = own.select("n_", F.explode(hashes).alias("h_")).groupBy(slot(F.col("h_")).alias("slot_")).agg(F.count(F.lit(1)).alias("c_"), F.max("n_").alias("n_")).collect()
    ranks = [0] * SLOTS
    for r in often:
        ranks[r["slot_"]] = int(2 * math.log2(r["c_"]))
    table = F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<int>")
    order = lambda h: F.shiftleft(F.get(table, slot(h)).cast("long"), 57).bitwiseOR(h.bitwiseAND(F.lit((1 << 57) - 1)))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n_") - 1, F.lit(1))), lambda i: F.hash(F.substring("t_", i, F.lit(2))))
    # 256 bits of which words of two characters a text has: an edit changes four at most
    bits = lambda k: F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, h: F.when(F.shiftright(h, 6).bitwiseAND(F.lit(3)) == k, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63))))).otherwise(acc))
    words = [f"bits{k}_" for k in range(4)]
    apart = lambda grams: F.aggregate(grams, F.expr("CAST(array() AS array<struct<o:bigint,at:int>>)"), lambda acc, x: F.when(F.exists(acc, lambda y: F.abs(y["at"] - x["at"]) < gram), acc).otherwise(F.concat(acc, F.array(x))))
    by_place = F.array_sort("first_", lambda x, y: x["at"] - y["at"])

    def close(x: str, y: str) -> Column:
        longer = F.greatest(F.length(x), F.length(y))
        edits = F.expr(f"levenshtein({x}, {y}, CAST(floor(greatest(length({x}), length({y})) * {1 - low!r} + 1e-9) AS INT))")  # -1 beyond that
        return F.when((F.abs(F.length(x) - F.length(y)) <= length * longer) & (edits >= 0), F.round(1 - edits / longer, 4))

    def judged(met: DataFrame) -> DataFrame:
        return met.where(close("x", "y") >= least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), close("x", "y").alias("ratio"))

    def meeting(texts: DataFrame, carried: bool) -> DataFrame:
        kept = ["t_"] if carried else []
        signed = texts.where(F.col("n_") - gram + 1 > gram * F.col("e_")).withColumn("first_", F.slice(F.array_sort(F.transform(hashes, lambda h, i: F.struct(order(h).alias("o"), i.alias("at")))), F.lit(1), gram * F.col("e_") + 1))
        signed = signed.select("k_", *kept, *block, "e_", "first_", F.element_at("first_", -1)["o"].alias("last_"), *(bits(k).alias(w) for k, w in enumerate(words)))
        rare = apart(F.col("first_"))
        pivots = signed.withColumn("rare_", rare).withColumn("rare_", F.when(F.size("rare_") > F.col("e_"), F.col("rare_")).otherwise(apart(by_place)))
        pivots = pivots.select("k_", *kept, *block, "e_", "last_", *words, F.explode(F.array_distinct(F.slice("rare_", F.lit(1), F.col("e_") + 1)["o"])).alias("g_"))
        prefixes = signed.select("k_", *kept, *block, "last_", *words, F.explode(F.array_distinct(F.col("first_")["o"])).alias("g_"))
        other = dealt(prefixes.repartition(parts, "g_", *block).withColumnsRenamed({"k_": "b", "t_": "y", "last_": "last2_"} | {w: f"other_{w}" for w in words}))
        differing = " + ".join(f"bit_count({w} ^ other_{w})" for w in words)
        return pivots.repartition(parts, "g_", *block).withColumnsRenamed({"k_": "a", "t_": "x"}).join(other, ["g_", *block]).where(f"(last_ < last2_ OR (last_ = last2_ AND a < b)) AND a <> b AND {differing} <= 4 * e_")

    found = judged(meeting(own.where(F.col("n_") <= CARRIED), True))
    width = F.floor(F.log("n_") / -math.log(low - 1e-6))
    short = own.where(F.col("n_") - gram + 1 <= gram * F.col("e_")).select(F.col("k_").alias("a"), F.col("t_").alias("x"), *block, F.explode(F.array(width - 1, width, width + 1)).alias("w_"))
    found = found.unionByName(judged(short.join(dealt(own.select(F.col("k_").alias("b"), F.col("t_").alias("y"), *block, width.alias("w_"))), [*block, "w_"]).where("a <> b")))
    if max((r["n_"] for r in often), default=0) > CARRIED:
        met = meeting(own.where(F.col("n_") > int(CARRIED * low)), False).select("a", "b").distinct()
        sides = met.join(dealt(own.select(F.col("k_").alias("a"), F.col("t_").alias("x"))), "a").join(dealt(own.select(F.col("k_").alias("b"), F.col("t_").alias("y"))), "b")
        found = found.unionByName(judged(sides.where(F.greatest(F.length("x"), F.length("y")) > CARRIED)))
    return found.distinct()


def similar_classes(rows: DataFrame, key: str, text: str, block: list[str], **how) -> DataFrame:
    """(a, b, ratio) as of `similar_pairs`, where the smallest key of a block's equal texts stands for all of them, and (it, another of them, 1.0).

    Copies make as many rows as there are copies, not the square; every pair of similar rows is that of their first ones.
    """
    own = rows.where(F.length(text) > 0)
    first = own.groupBy(*block, text).agg(F.min(key).alias("a"))
    copies = own.select(F.col(key).alias("b"), *block, text).join(dealt(first), [*block, text]).where("a <> b")
    return similar_pairs(first, "a", text, block, **how).unionByName(copies.select("a", "b", F.lit(1.0).alias("ratio")))


def mapped(rows: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """rows whose value of the column the table knows, with the table's other columns."""
    return rows.join(table, column)


def detection_scores(found: DataFrame, truth: DataFrame, texts: DataFrame) -> DataFrame:
    """type, tp, found, truth, precision, recall, f1, overlaps, misplaced of found (doc_id, start, end, value, type) against truth (doc_id, value, type).

    overlaps: found spans that begin inside an earlier one of the same document; misplaced: those whose text isn't their value.
    """
    w = Window.partitionBy("doc_id").orderBy("start", F.desc("end"), "type").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.join(texts.select("doc_id", "text"), "doc_id").withColumn("overlap", F.coalesce(F.max("end").over(w) > F.col("start"), F.lit(False)))
    off = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("value")
    right = truth.select("doc_id", "value", "type").distinct().withColumn("true", F.lit(1))
    n = lambda c: F.sum(c.cast("long"))
    own = placed.withColumn("off", off).join(right, ["doc_id", "value", "type"], "left").groupBy("type").agg(n(F.col("true").isNotNull()).alias("tp"), F.count(F.lit(1)).alias("found"), n(F.col("overlap")).alias("overlaps"), n(F.col("off")).alias("misplaced"))
    both = own.join(right.groupBy("type").agg(F.count(F.lit(1)).alias("truth")), "type", "full").na.fill(0, ["tp", "found", "truth", "overlaps", "misplaced"])
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return both.select("type", "tp", "found", "truth", share(F.col("tp"), F.col("found")).alias("precision"), share(F.col("tp"), F.col("truth")).alias("recall"), share(2 * F.col("tp"), F.col("found") + F.col("truth")).alias("f1"), "overlaps", "misplaced")


def entry_type(text: Column, category: Column) -> Column:
    """phrase or paragraph, manipulative or benign."""
    size = F.when(F.size(F.split(F.trim(text), r"\s+")) <= 8, "phrase").otherwise("para")
    return F.concat(size, F.lit("_"), F.when(category.isNull() | (category == "benign"), "benign").otherwise("manip"))


def multi_hot(categories: Column, known: list[str]) -> Column:
    return F.array(*(F.array_contains(categories, k).cast("int") for k in known))


def vocabulary_errors(rows: DataFrame, key: str, allowed: dict[str, list[str]]) -> DataFrame:
    """(key, field, value) of values that their field's list doesn't hold. A null is missing, not wrong."""
    checks = [F.when(~F.col(c).cast("string").isin(known), F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))) for c, known in allowed.items()]
    return rows.select(key, F.explode(F.filter(F.array(*checks), lambda e: e.isNotNull())).alias("e")).select(key, "e.field", "e.value")


def paragraph_rows(paras: DataFrame, labelled: DataFrame, most_benign: int = 500) -> DataFrame:
    """(doc_id, i, text, labels): all labelled paragraphs, and as many of the others as asked for, by hash of their place."""
    rows = paras.select("doc_id", "i", "text").join(labelled, ["doc_id", "i"], "left")
    benign = rows.where("labels IS NULL").withColumn("labels", F.expr("CAST(array() AS array<string>)"))
    picked = benign.orderBy(F.md5(F.concat_ws(":", "doc_id", "i")), "doc_id", "i").limit(most_benign)
    return rows.where("labels IS NOT NULL").unionByName(picked)


def split(rows: DataFrame, key: str, by: Column, train: float = 0.7, validation: float = 0.15, seed: int = 42) -> DataFrame:
    """rows with part: train, validation or test, in these shares (rounded down) of each stratum, by hash of key and seed.

    Rows are ranked within 4,096 ranges of the hash, and ranges by their counts, so no task gets a whole stratum. Rows without a
    key come last. Shares are decimals: as a double, 0.7 of 90 is less than 63.
    """
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}")))
    ranged = rows.withColumn("stratum_", by).withColumn("order_", order).withColumn("range_", F.coalesce(F.substring("order_", 1, 3), F.lit("~")))
    counts = ranged.groupBy("stratum_", "range_").agg(F.count(F.lit(1)).alias("c_"))
    before = Window.partitionBy("stratum_").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before_", F.coalesce(F.sum("c_").over(before), F.lit(0))).withColumn("n_", F.sum("c_").over(Window.partitionBy("stratum_"))).drop("c_")
    # null strata are strata too
    met = ranged.join(offsets.select(F.col("stratum_").alias("s_"), F.col("range_").alias("r_"), "before_", "n_"), F.col("stratum_").eqNullSafe(F.col("s_")) & (F.col("range_") == F.col("r_")))
    i = F.col("before_") + F.row_number().over(Window.partitionBy("stratum_", "range_").orderBy(F.asc_nulls_last("order_"), key)) - 1
    share = lambda x: F.floor(F.col("n_") * F.lit(Decimal(str(x))))
    first = share(train)
    part = F.when(F.col("i_") < first, "train").when(F.col("i_") < first + share(validation), "validation").otherwise("test")
    return met.withColumn("i_", i).withColumn("part", part).select(*rows.columns, "part")


def bio_errors(sentences: DataFrame) -> DataFrame:
    """(id, i, tag) of I-X tags that no B-X or I-X stands before. sentences: (id, tags)."""
    tags = sentences.select("id", F.posexplode("tags").alias("i", "tag"))
    before = F.coalesce(F.lag("tag").over(Window.partitionBy("id").orderBy("i")), F.lit("O"))
    return tags.withColumn("before", before).where(F.col("tag").startswith("I-") & (F.substring("before", 2, 100) != F.substring("tag", 2, 100))).select("id", "i", "tag")


def entities(sentences: DataFrame) -> DataFrame:
    """(id, first, last, entity, words) of BIO runs: B-X, or an I-X that continues nothing, begins one. sentences: (id, tokens, tags)."""
    rows = sentences.select("id", F.posexplode(F.arrays_zip("tokens", "tags")).alias("i", "z")).select("id", "i", F.col("z.tokens").alias("word"), F.col("z.tags").alias("tag"))
    w = Window.partitionBy("id").orderBy("i")
    kind = F.substring("tag", 3, 100)
    begins = F.col("tag").startswith("B-") | (F.col("tag").startswith("I-") & (F.substring(F.coalesce(F.lag("tag").over(w), F.lit("O")), 3, 100) != kind))
    run = F.sum(F.when(begins | (F.col("tag") == "O"), 1).otherwise(0)).over(w)
    return rows.withColumn("run", run).where("tag <> 'O'").groupBy("id", "run").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.min(kind).alias("entity"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda s: s["word"]), " ").alias("words")).drop("run")


def label_scores(rows: DataFrame, labels: list[str]) -> DataFrame:
    """label, tp, fp, fn, support, precision, recall, f1 from arrays truth and guess of 0/1."""
    one = rows.select(F.explode(F.arrays_zip(F.array(*map(F.lit, labels)).alias("label"), F.col("truth").alias("t"), F.col("guess").alias("g"))).alias("z")).select("z.*")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    sums = one.groupBy("label").agg(count((F.col("t") == 1) & (F.col("g") == 1)).alias("tp"), count((F.col("t") == 0) & (F.col("g") == 1)).alias("fp"), count((F.col("t") == 1) & (F.col("g") == 0)).alias("fn"))
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    out = sums.withColumn("support", F.col("tp") + F.col("fn")).withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("support")))
    return out.withColumn("f1", share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def paragraphs(docs: DataFrame, least: int = 30) -> DataFrame:
    """(doc_id, i, start, end, text) of paragraphs between blank lines, of `least` characters or more; start and end in code points."""
    from .spans import matches

    found = F.filter(matches(F.col("text"), r"[^\n]+(?:\n[^\n]+)*"), lambda m: F.length(m["value"]) >= least)
    return docs.select("doc_id", F.posexplode(found).alias("i", "m")).select("doc_id", "i", "m.start", "m.end", F.col("m.value").alias("text"))


def labelled_paragraphs(paras: DataFrame, spans: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, i, labels): labels of spans (doc_id, first, last, label) of which at least that share lies in the paragraph."""
    inside = F.greatest(F.lit(0), F.least("end", "last") - F.greatest("start", "first"))
    met = paras.select("doc_id", "i", "start", "end").join(spans, "doc_id").where(inside >= least * (F.col("last") - F.col("first")))
    return met.groupBy("doc_id", "i").agg(F.sort_array(F.collect_set("label")).alias("labels"))


def box_scores(found: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """image_id, tp, found, truth, precision, recall, f1. In the order of box_id each found box takes the true box left over that it overlaps most, if by the threshold."""
    from .spans import iou

    corners = ["x_min", "y_min", "x_max", "y_max"]
    own = found.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("box_id", *corners))).alias("boxes"))
    real = truth.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("box_id", *corners))).alias("left"))
    both = own.join(real, "image_id", "full")
    none = F.expr("CAST(array() AS array<struct<iou:double,first:double,box_id:bigint>>)")

    def step(acc, box):
        fits = F.filter(F.transform(F.col("left"), lambda t: F.struct(iou(box, t).cast("double").alias("iou"), (-t["box_id"]).cast("double").alias("first"), t["box_id"].cast("long").alias("box_id"))), lambda t: (t["iou"] >= threshold) & (t["iou"] > 0) & ~F.exists(acc, lambda a: a["box_id"] == t["box_id"]))
        return F.when(F.size(fits) > 0, F.concat(acc, F.array(F.array_max(fits)))).otherwise(acc)

    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    tp = F.when(F.col("boxes").isNull() | F.col("left").isNull(), 0).otherwise(F.size(F.aggregate("boxes", none, step)))
    counted = both.select("image_id", tp.cast("long").alias("tp"), n("boxes").cast("long").alias("found"), n("left").cast("long").alias("truth"))
    share = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 6)
    return counted.withColumn("precision", share("tp", "found")).withColumn("recall", share("tp", "truth")).withColumn("f1", F.round(F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("found") + F.col("truth"))).otherwise(0.0), 6))


def expectations(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """file, matches, least, verdict: pass, short or missing. found: (file, type); wanted: (file, least, types)."""
    have = found.groupBy("file").agg(F.count(F.lit(1)).alias("matches"), F.collect_set("type").alias("have"))
    both = wanted.join(have, "file", "full")
    lacking = F.size(F.array_except(F.coalesce("types", F.expr("CAST(array() AS array<string>)")), F.coalesce("have", F.expr("CAST(array() AS array<string>)")))) > 0
    n = F.coalesce("matches", F.lit(0))
    return both.select("file", n.alias("matches"), "least", F.when(F.col("least").isNull(), "unexpected").when(n < F.col("least"), "short").when(lacking, "missing").otherwise("pass").alias("verdict"))
