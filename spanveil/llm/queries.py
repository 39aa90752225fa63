"""One query for each operator, over whole tables with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embeddings, langid, lm, packing, sharding, simhash, substring, toxicity, urlfilter


#: (host, path prefix, verdict) as op8's contract lists them
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=3, shingle=3)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.verdicts(table(spark, sf_dir, "pages"), rules=URL_RULES)


def url_filters_with_redirect_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator with a crawler's log beside the pages, in which classes change verdicts."""
    pages = table(spark, sf_dir, "pages")
    a, b = pages.select("page_id", "url"), pages.select((F.col("page_id") + 1).alias("page_id"), F.col("url").alias("dst"))
    key = F.col("page_id").cast("string")
    chains = a.where("page_id % 4 IN (1, 2)").join(b, "page_id").select(F.col("url").alias("src"), "dst")
    blocked = a.where("page_id % 8 = 3").select(F.col("url").alias("src"), F.concat(F.lit("HTTPS://www.Go.example.net:443/de/"), key, F.lit("/?utm_source=log")).alias("dst"))
    allowed = a.where("page_id % 8 = 7 OR page_id % 24 = 3").select(F.col("url").alias("src"), F.concat(F.lit("http://go.example.com/x/../en/7/./"), key).alias("dst"))
    return urlfilter.verdicts(pages, chains.unionByName(blocked).unionByName(allowed))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup, op2_toxicity, op3_sharding, op4_benchmark_decontamination, op5_substring_dedup, op6_embedding_near_dedup,
        op7_language_id, op8_url_filters, url_filters_with_redirect_log, op9_packing, op10_lm_scoring, pipeline,
    )
}

SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT doc_id, p, w[p] AS word, CASE WHEN p + 19 <= len(w) THEN array_to_string(w[p:p + 19], ' ') END AS path FROM s),
f AS (SELECT doc_id, p, word, path IS NOT NULL AND row_number() OVER (PARTITION BY path ORDER BY doc_id, p) > 1 AS later FROM k),
c AS (SELECT doc_id, p, word, bool_or(later) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(a.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(a.kept, '')) AS kept_sha256
FROM d LEFT JOIN a ON d.doc_id = a.doc_id"""

EMBEDDING_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size FROM v),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM n x JOIN n y ON x.vec_id <> y.vec_id AND x.size > 0 AND y.size > 0 AND list_dot_product(x.e, y.e) / (x.size * y.size) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT v.vec_id, CAST((SELECT count(*) FROM links WHERE a = v.vec_id) AS BIGINT) AS n_links,
  least(v.vec_id, coalesce((SELECT min(b) FROM reach WHERE a = v.vec_id), v.vec_id)) AS component_id FROM v)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM c"""

ORACLES: dict[str, str] = {
    "op3_sharding": sharding.oracle(),
    "op5_substring_dedup": SUBSTRING_SQL,
    "op6_embedding_near_dedup": EMBEDDING_SQL,
    "op8_url_filters": urlfilter.oracle(),
    "url_filters_with_redirect_log": urlfilter.oracle(urlfilter.LOG),
}
