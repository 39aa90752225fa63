"""Queries of pieces, pixels, media rewriting and vocabulary checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pieces
from ..operators import crf, dims, jsonwalk, ops, pixels, spans
from ..streaming import sse
from . import corpus as cp
from .detecting import listed

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


customers = lambda s, d: s.read.parquet(f"{d}/customer.parquet")
VOCABULARY = ["[UNK]", "un", "##aff", "##able", "hello", "!"]
add("t13_chunks", lambda s, d: pieces.chunked(cp.documents(s, d)).groupBy("doc_id").agg((F.max(F.octet_length("chunk")) <= 800).alias("fits"), F.max(F.col("at") + F.length("chunk")).cast("long").alias("reach")), "SELECT doc_id, true AS fits, CAST(length(text) AS BIGINT) AS reach FROM documents WHERE text <> ''")
WORD = "substr('Aline', 1, CAST(c_custkey % 5 AS INT) + 1) || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '-7' ELSE 'B' END"


def crf_words(s, d):
    """Features of the first word of a two-word text made from the key."""
    made = customers(s, d).selectExpr("c_custkey AS doc_id", f"{WORD} || ' met ' || c_name AS text")
    return crf.shown(made).where("i = 0").select("doc_id", "feature")


LOW, TAIL = "lower(w)", "CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '-d' ELSE 'X' END"
add("d46_crf_features", crf_words, f"""WITH t AS (SELECT c_custkey AS doc_id, {WORD} AS w FROM customer),
f AS (SELECT doc_id, unnest([
  'word=' || {LOW}, 'shape=X' || CASE WHEN doc_id % 5 > 0 THEN 'x' ELSE '' END || CASE WHEN doc_id % 5 = 0 AND doc_id % 3 = 2 THEN '' ELSE {TAIL} END,
  'p1=' || left({LOW}, 1), 's1=' || right({LOW}, 1), CASE WHEN length(w) > 1 THEN 'p2=' || left({LOW}, 2) END, CASE WHEN length(w) > 1 THEN 's2=' || right({LOW}, 2) END,
  CASE WHEN length(w) > 2 THEN 'p3=' || left({LOW}, 3) END, CASE WHEN length(w) > 2 THEN 's3=' || right({LOW}, 3) END,
  CASE WHEN doc_id % 5 = 0 AND doc_id % 3 <> 1 THEN 'isupper' END, CASE WHEN doc_id % 3 = 0 THEN 'istitle' END, CASE WHEN doc_id % 3 <> 1 THEN 'isalpha' END,
  'len=' || CASE WHEN length(w) <= 2 THEN 'short' WHEN length(w) <= 5 THEN 'medium' ELSE 'long' END, 'BOS', '+1:word=met', '+1:shape=x']) AS feature FROM t)
SELECT doc_id, feature FROM f WHERE feature IS NOT NULL""")
touching = lambda s, d: customers(s, d).select(F.col("c_custkey").alias("doc_id"), F.explode(F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(v).alias("value"), F.lit(t).alias("type")) for a, b, v, t in ((0, 4, "a", "person"), (4, 9, "b", "person"), (2, 6, "c", "location"), (12, 15, "d", "person"))))).alias("x")).select("doc_id", "x.*")
add("d51_chunk_merge", lambda s, d: pieces.merged_chunks(touching(s, d)).select("doc_id", "value"), "SELECT c_custkey AS doc_id, unnest(['a', 'c', 'd']) AS value FROM customer")
add("d52_label_map", lambda s, d: customers(s, d).select("c_custkey", pieces.bio_label((F.col("c_custkey") % 13).cast("int")).alias("label")), "SELECT c_custkey, CASE WHEN c_custkey % 13 BETWEEN 1 AND 10 THEN CASE c_custkey % 2 WHEN 1 THEN 'B-' ELSE 'I-' END || ['PER', 'LOC', 'ORG', 'HEALTH', 'CHILD'][CAST((c_custkey % 13 + 1) // 2 AS INT)] ELSE 'O' END AS label FROM (SELECT c_custkey % 13 + 0 AS k, c_custkey FROM customer)".replace("CASE c_custkey % 2 WHEN 1", "CASE c_custkey % 13 % 2 WHEN 1"))
add("d57_engine_choice", lambda s, d: customers(s, d).select("c_custkey", pieces.engine_for(F.element_at(F.array(*map(F.lit, ["auto", "ner", "crf", "regex"])), (F.col("c_custkey") % 4 + 1).cast("int")), F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 2 == 0).alias("engine")),
    "SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 1) AND c_custkey % 3 = 0 THEN 'ner' WHEN c_custkey % 4 <> 3 AND c_custkey % 2 = 0 THEN 'crf' ELSE 'regex' END AS engine FROM customer")
add("e4_span_repair", lambda s, d: customers(s, d).select("c_custkey", pieces.repaired(F.concat(F.lit("You must Act Now or "), F.col("c_name")), F.element_at(F.array(*map(F.lit, ["must Act", "act now", "act nov", "zzzzzz"])), (F.col("c_custkey") % 4 + 1).cast("int"))).alias("span")), "SELECT c_custkey, ['must Act', 'Act Now', 'Act Now', NULL][c_custkey % 4 + 1] AS span FROM customer")
image = lambda s, d: customers(s, d).select("c_custkey", F.unhex(F.lit("00" * 4 * 8 + "FF" * 4 * 8)).alias("p"), F.lit(8).alias("w"))
add("m9_text_policy", lambda s, d: customers(s, d).select("c_custkey", pixels.text_policy((F.col("c_custkey") % 10) / 10, F.col("c_custkey") % 2 == 0).alias("fill")), "SELECT c_custkey, CASE WHEN c_custkey % 10 < 8 OR c_custkey % 2 = 0 THEN 'all' ELSE 'none' END AS fill FROM customer")
SOUND = '{"m":[{"type":"input_audio","input_audio":{"data":"AA","format":"wav"}}],"t":"x"}'
notice = lambda path, value: F.array(F.struct(F.array(*map(F.lit, path)).alias("segments"), F.lit(value).alias("value")))
