"""Response risk: persuasion phrases, severity, sensitivity and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dims import PERSUASION
from .spans import phrase_scan

# fixed values: names shown for the classifier's categories
FRIENDLY = {"Art_5_1_a_Deceptive": "Deceptive Practices", "Art_5_1_b_Age": "Age-Based Targeting", "Art_5_1_b_SocioEcon": "Socioeconomic Targeting", "Art_5_1_c_Social_Scoring": "Social Scoring"}


def phrases(spark: SparkSession, lists: dict[str, list[str]] = PERSUASION) -> DataFrame:
    """(phrase, type, rank): a phrase in two categories counts for the one of smaller rank."""
    return spark.createDataFrame([(p, name, i) for i, (name, own) in enumerate(lists.items()) for p in own], "phrase string, type string, rank int")


def flagged(responses: DataFrame, most: int = 3) -> DataFrame:
    """(doc_id, n_flags, categories) of responses that hold persuasion phrases."""
    found = phrase_scan(responses, phrases(responses.sparkSession), most=most, confidence=1.0, source="persuasion")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_flags"), F.sort_array(F.collect_set("type")).alias("categories"))


def severity(flags: Column, first: Column, second: Column, top: Column) -> Column:
    """Caution, Warning or Notice. flags: how many phrases; first, second: categories of phrases and of the classifier; top: its best score."""
    both = F.size(first) + F.size(second)
    pushed = F.array_contains(first, "Commercial") & (F.array_contains(first, "Fear") | F.array_contains(first, "Urgency"))
    return (
        F.when((both >= 4) | pushed | ((F.size(second) >= 2) & F.coalesce(top > 0.9, F.lit(False))), "Caution")
        .when((both >= 2) | (flags >= 3) | ((F.size(first) == 0) & (F.size(second) > 0)), "Warning")
        .otherwise("Notice")
    )


def role(flagged_: Column, second: Column) -> Column:
    """What the classifier does to the phrases' finding."""
    some = F.size(second) > 0
    return F.when(flagged_ & some, "upgrade").when(flagged_, "suppress").when(some, "discover").otherwise("clean")


# fixed values: categories of the classifier, in the order of its scores
CLASSES = ["Art_5_1_a_Deceptive", "Art_5_1_b_Age", "Art_5_1_b_SocioEcon", "Art_5_1_c_Social_Scoring"]


def sampled(id_: Column, share: float = 0.1) -> Column:
    """A fixed share of ids, by hash."""
    return F.conv(F.substring(F.md5(id_.cast("string")), 1, 8), 16, 10).cast("long") % 1000 < round(share * 1000)


def second_look(level: Column, flagged_: Column, id_: Column, share: float = 0.1) -> Column:
    """Whether the classifier is asked: never (off), always (high), where phrases were found (low), and with medium for a share of the others as well."""
    return F.when(level == "off", False).when(level == "high", True).when(level == "medium", flagged_ | sampled(id_, share)).otherwise(flagged_)


def classified(logits: Column, threshold: float = 0.55, early: Column | None = None, least: float = 0.3) -> Column:
    """The classifier's categories from its logits, by the logistic; none if the best score of a first look (early logits) is under `least`."""
    score = lambda x: 1 / (1 + F.exp(-x))
    names = F.array(*map(F.lit, CLASSES))
    found = F.transform(F.filter(F.arrays_zip(names.alias("name"), logits.alias("x")), lambda z: z["x"].isNotNull() & (score(z["x"]) >= threshold)), lambda z: z["name"])
    return found if early is None else F.when(score(F.array_max(early)) < least, F.slice(names, 1, 0)).otherwise(found)


def shown(level: str, severity_: Column) -> Column:
    """Whether a sensitivity (off, low, medium, high) lets a severity through."""
    return {"off": F.lit(False), "low": severity_ != "Notice"}.get(level, F.lit(True))


# fixed values: what a label says
WORDING = {
    "head": "--- WARNING ---\nDetected: ",
    "Warning": "This response contains language patterns associated with influence tactics.\n",
    "Caution": "Recommendation: Pause and verify with objective evidence before acting.\n",
    "foot": "---\n\n",
}


def label(severity_: Column, first: Column, second: Column) -> Column:
    """The text put before a response."""
    plain = F.transform(second, lambda c: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in FRIENDLY.items() for x in pair)), c), c))
    tactics = F.array_join(F.array_sort(F.array_distinct(F.concat(first, plain))), " • ")
    more = F.when(severity_ == "Warning", WORDING["Warning"]).when(severity_ == "Caution", WORDING["Caution"]).otherwise("")
    return F.concat(F.lit(WORDING["head"]), tactics, F.lit("\n"), more, F.lit(WORDING["foot"]))


def assessed(responses: DataFrame, level: str = "medium", least_flags: int = 3, second: str | None = None, top: str | None = None) -> DataFrame:
    """responses (doc_id, text) with n_flags, categories, severity, shown, label; second, top: columns of a classifier, if there is one."""
    two = F.coalesce(F.col(second), F.expr("CAST(array() AS array<string>)")) if second else F.expr("CAST(array() AS array<string>)")
    score = F.col(top) if top else F.lit(None).cast("double")
    found = responses.join(flagged(responses.select("doc_id", "text")), "doc_id", "left").withColumn("n_flags", F.coalesce("n_flags", F.lit(0))).withColumn("categories", F.coalesce("categories", F.expr("CAST(array() AS array<string>)")))
    grave = F.when((F.col("n_flags") > 0) | (F.size(two) > 0), severity(F.col("n_flags"), F.col("categories"), two, score))
    out = found.withColumn("severity", grave)
    seen = F.coalesce(shown(level, F.col("severity")) & (F.col("n_flags") >= least_flags), F.lit(False))
    return out.withColumn("shown", seen).withColumn("label", F.when(seen, label(F.col("severity"), F.col("categories"), two)))
