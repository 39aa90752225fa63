"""Decisions on images and audio, given what a model or decoder found. Models themselves are the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dims import SCREENS


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def nsfw(logits: Column, threshold: float = 0.8) -> tuple[Column, Column]:
    """(score, flagged) from five logits: drawings, hentai, neutral, porn, sexy. Hentai counts if drawings reach 0.1; not-a-number is 0."""
    p = softmax(logits)
    score = p[3] + p[4] + F.when(p[0] >= 0.1, p[1]).otherwise(0.0)
    score = F.when(F.isnan(score), 0.0).otherwise(score)
    return score, score >= threshold


def screen_size(width: Column, height: Column) -> Column:
    return F.coalesce(*(F.when((width == w) & (height == h), True) for w, h in SCREENS), F.lit(False))


def screenshot(software: Column, camera: Column, width: Column, height: Column, bar_variance: Column, tools: list[str]) -> Column:
    """A screenshot tool's name in the software tag, or two of: a screen's size, an even status bar, software but no camera."""
    low = F.lower(F.coalesce(software, F.lit("")))
    tool = F.exists(F.array(*map(F.lit, tools)), lambda t: F.contains(low, t))
    reasons = screen_size(width, height).cast("int") + F.coalesce(bar_variance < 50, F.lit(False)).cast("int") + ((low != "") & camera.isNull()).cast("int")
    return tool | (reasons >= 2)


def expanded(box: Column, width: Column, height: Column, margin: float = 0.15) -> Column:
    """A box grown by a share of its sides and held inside the image, in whole pixels."""
    w, h = box["x_max"] - box["x_min"], box["y_max"] - box["y_min"]
    low = lambda x: F.floor(F.greatest(x, F.lit(0.0))).cast("int")
    high = lambda x, most: F.least(F.ceil(x), most).cast("int")
    return F.struct(low(box["x_min"] - w * margin).alias("x0"), low(box["y_min"] - h * margin).alias("y0"), high(box["x_max"] + w * margin, width).alias("x1"), high(box["y_max"] + h * margin, height).alias("y1"))


def face_fill(box: Column, width: Column, height: Column) -> Column:
    """all if the face covers over 80 % of the image, else ellipse."""
    return F.when((box["x_max"] - box["x_min"]) * (box["y_max"] - box["y_min"]) > 0.8 * width * height, "all").otherwise("ellipse")


def box_issues(b: DataFrame) -> DataFrame:
    """(box_id, severity, check) of what is wrong with boxes (x_min, y_min, x_max, y_max, confidence, img_width, img_height)."""
    w, h = F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")
    finite = ~(F.isnan("x_min") | F.isnan("y_min") | F.isnan("x_max") | F.isnan("y_max"))
    rules = [
        ("error", "finite_values", ~finite),
        ("error", "ordered_coords", F.col("x_min") >= F.col("x_max")),
        ("error", "ordered_coords", F.col("y_min") >= F.col("y_max")),
        ("error", "within_bounds", F.col("x_min") < 0),
        ("error", "within_bounds", F.col("y_min") < 0),
        ("error", "within_bounds", F.col("x_max") > F.col("img_width")),
        ("error", "within_bounds", F.col("y_max") > F.col("img_height")),
        ("error", "no_full_image_box", w * h / (F.col("img_width") * F.col("img_height")) > 0.95),
        ("warning", "minimum_size", (w < 5) | (h < 5)),
        ("error", "confidence_range", (F.col("confidence") <= 0) | (F.col("confidence") > 1)),
    ]
    all_ = F.filter(F.array(*(F.when(bad, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("check"))) for s, c, bad in rules)), lambda x: x.isNotNull())
    return b.select("box_id", F.explode(all_).alias("x")).select("box_id", "x.severity", "x.check")


def ctc(frames: Column, classes: int, dictionary: Column) -> Column:
    """Text of per-frame best classes (array<struct<best:int,p:double>>): blanks (0) and repeats go; with the mean probability of what stays."""
    kept = F.filter(frames, lambda f, i: (f["best"] != 0) & ((i == 0) | (F.get(frames, i - 1)["best"] != f["best"])))
    text = F.array_join(F.transform(kept, lambda f: F.get(dictionary, f["best"] - 1)), "")
    mean = F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, f: a + f["p"]) / F.size(kept)).otherwise(0.0)
    return F.struct(text.alias("text"), mean.alias("confidence"))


def ocr_input(width: Column, height: Column, most: int = 960) -> Column:
    """Sides for a detector: the longer at most 960, each a multiple of 32 and 32 at least."""
    scale = F.least(F.lit(1.0), most / F.greatest(width, height))
    side = lambda x: F.greatest(F.lit(32), (F.round(x * scale / 32) * 32).cast("int"))
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def anchors(spark, size: int = 128, strides: tuple[int, ...] = (8, 16, 16, 16), each: int = 2) -> DataFrame:
    """Centres (layer, y, x, k) of a detector's grid, as shares of the image."""
    layers = spark.createDataFrame([(i, size // s) for i, s in enumerate(strides)], "layer int, n int")
    grid = layers.select("layer", "n", F.explode(F.expr("sequence(0, n - 1)")).alias("row")).select("layer", "n", "row", F.explode(F.expr("sequence(0, n - 1)")).alias("col"))
    return grid.select("layer", ((F.col("row") + 0.5) / F.col("n")).alias("y"), ((F.col("col") + 0.5) / F.col("n")).alias("x"), F.explode(F.expr(f"sequence(0, {each - 1})")).alias("k"))


NOTICE = "[AUDIO REMOVED]"


def audio_stripped(bodies: DataFrame, heard: DataFrame, key: str = "request_id") -> DataFrame:
    """bodies (key, body) where inline audio gives way to a notice, in requests whose transcript (heard: key) held a telling phrase. Others stay as they are."""
    from . import jsonwalk

    last = lambda i: F.try_element_at("segments", F.lit(-i))
    sounds = jsonwalk.leaves(bodies, key, "body", skipped=[], nested=0).where((last(1) == "data") & (last(2) == "input_audio")).join(heard.select(key).distinct(), key, "left_semi")
    changes = sounds.groupBy(key).agg(F.collect_list(F.struct("segments", F.lit(NOTICE).alias("value"))).alias("changes"))
    out = bodies.join(changes, key, "left")
    return out.withColumn("body", F.when(F.col("changes").isNotNull(), jsonwalk.rewritten(F.col("body"), F.col("changes"))).otherwise(F.col("body"))).drop("changes")
