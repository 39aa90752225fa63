"""Queries of whole flows: streams replayed, bodies rewritten, engines merged, rows checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import dataset, dims, encode, jsonwalk, spans
from ..streaming import sse
from . import corpus as cp
from .detecting import BASE_SQL, FIRST, LAST
from .serving import LEAVES, SAMPLE_KEY, chunks, json_rows

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


customers = lambda s, d: s.read.parquet(f"{d}/customer.parquet")

# --- streams
OPENAI = """'data: {"choices":[{"delta":{"content":"' || %s || '"}}]}' || chr(10) || chr(10)"""
DONE = "'data: [DONE]' || chr(10) || chr(10)"
add("z3_replayed_stream", lambda s, d: sse.replayed(chunks(s, d), sse.contents(chunks(s, d)).select("stream_id", F.upper("text").alias("text"))),
    f"SELECT CAST(c_custkey AS VARCHAR) AS stream_id, unnest([1, 2]) AS \"at\", unnest([{OPENAI % "upper('Hello ' || c_name)"}, {DONE}]) AS event FROM customer")
add("z7_warning_before_done", lambda s, d: sse.replayed(chunks(s, d), sse.contents(chunks(s, d)).select("stream_id", "text"), customers(s, d).where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("stream_id"), F.lit("Mind this.").alias("warning"))),
    f"SELECT CAST(c_custkey AS VARCHAR) AS stream_id, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY k) AS INT) AS \"at\", event FROM (SELECT c_custkey, unnest([0, 1, 2]) AS k, unnest([{OPENAI % "'Mind this.'"}, {OPENAI % "'Hello ' || c_name"}, {DONE}]) AS event FROM customer) WHERE k > 0 OR c_custkey % 2 = 0")
WHOLE = """'data: {"choices":[{"delta":{"content":"Hello "}}]}' || chr(10) || chr(10) || 'data: {"choices":[{"delta":{"content":"' || c_name || '"}}]}' || chr(10) || chr(10) || 'data: [DONE]' || chr(10) || chr(10)"""
BEGINS = """'data: {"choices":[{"delta":{"content":"He'"""
add("z4_held_back", lambda s, d: sse.released(chunks(s, d), hold=12),
    f"SELECT CAST(c_custkey AS VARCHAR) AS stream_id, CAST(unnest([0, 1, 2]) AS BIGINT) AS seq, unnest([substr(w, 1, a - 12), substr(w, a - 11, b - a), substr(w, b - 11)]) AS text FROM (SELECT c_custkey, {WHOLE} AS w, length({BEGINS}) AS a, length({WHOLE}) - 15 AS b FROM customer)")

# --- bodies
REQUEST_ID = "lpad(lower(hex(c_custkey)), 32, '0')"


def _bodies(s, d):
    return json_rows(s, d).select(F.regexp_replace(F.expr(REQUEST_ID), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-").alias("request_id"), "body")


def _body_round_trip(s, d):
    """Leaves of the safe bodies, restored, and whether they differed before."""
    safe, mapping = jsonwalk.sanitized(_bodies(s, d), [dims.BASE[1], dims.BASE[3]], SAMPLE_KEY)
    texts = jsonwalk.leaves(safe, "request_id", "body", nested=0).withColumn("doc_id", F.concat_ws("#", "request_id", "path"))
    back = encode.restored(texts.select("doc_id", F.col("value").alias("text")), mapping)
    number = F.conv(F.regexp_replace(F.col("request_id"), "-", ""), 16, 10).cast("long")
    return texts.join(spans.dealt(back), "doc_id").select(number.alias("c_custkey"), "path", F.col("text").alias("restored"), (F.col("text") != F.col("value")).alias("was_hidden"))


add("p19_body_round_trip", _body_round_trip,
    f"""SELECT CAST(c_custkey AS BIGINT) AS c_custkey, replace(x.p, '.ssn', '') AS path, CASE WHEN x.p LIKE '%.ssn' THEN '{{"ssn":"' || x.v || '"}}' ELSE x.v END AS restored, x.p NOT LIKE '%role' AS was_hidden FROM ({LEAVES})""")
PICTURES = '{"messages":[{"content":[{"type":"image_url","image_url":{"url":"https://x.example/%s"}},{"type":"image_url","image_url":{"url":"data:image/png;base64,AA"}},{"type":"image","source":{"type":"url","url":"http://y.example/%s"}},{"type":"text","text":"https://z.example"}]}]}'
add("o4_url_images", lambda s, d: jsonwalk.url_images(customers(s, d).select("c_custkey", F.format_string(PICTURES, F.col("c_custkey").cast("string"), F.col("c_custkey").cast("string")).alias("body")), "c_custkey", "body").select("c_custkey", "path", "url"),
    "SELECT c_custkey, unnest(['messages[0].content[0].image_url.url', 'messages[0].content[2].source.url']) AS path, unnest(['https://x.example/' || c_custkey, 'http://y.example/' || c_custkey]) AS url FROM customer")

# --- engines and spans
named = lambda s, names: s.createDataFrame([(n,) for n in names], "name string")
add("d59_merged_redactor", lambda s, d: encode.lite(cp.corpus(s, d, cp.SAID), semantic=spans.names_scan(cp.corpus(s, d, cp.SAID), named(s, FIRST), named(s, LAST))),
    f"SELECT doc_id, replace(replace(replace(replace(text, 'Anna Smith', '[PERSON]'), 'Maria Garcia', '[PERSON]'), 'John', '[PERSON]'), '123-45-6789', '[SSN]') AS text FROM ({cp.corpus_sql(cp.SAID)})")
HITS = [(1, 0, 4, "aa"), (2, 3, 9, "bb"), (3, 8, 20, "cc"), (1, 21, 25, "dd"), (2, 21, 30, "ee")]
MIXED = "CASE c_custkey % 3 WHEN 0 THEN 'User' || c_custkey || '@Mail.Example' WHEN 1 THEN 'AA:BB:0' || c_custkey % 10 || ':DD:EE:FF' ELSE 'sk-AbC' || c_custkey END"
add("p6_case_folding", lambda s, d: (lambda v, t: customers(s, d).select("c_custkey", F.concat(*encode.parts(v, t)).alias("folded")))(F.expr(MIXED), F.expr("CASE c_custkey % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'mac_address' ELSE 'api_key' END")),
    f"SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN lower({MIXED}) ELSE {MIXED} END AS folded FROM customer")

# --- rows
ALLOWED = {"c_mktsegment": ["BUILDING", "MACHINERY"], "c_name": ["nobody"]}
add("v18_vocabulary_checks", lambda s, d: dataset.vocabulary_errors(customers(s, d), "c_custkey", ALLOWED),
    "SELECT c_custkey, 'c_mktsegment' AS field, c_mktsegment AS value FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') UNION ALL SELECT c_custkey, 'c_name', c_name FROM customer")
paras = lambda s, d: customers(s, d).select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("i"), F.col("c_name").alias("text"))
add("o13_paragraph_rows", lambda s, d: dataset.paragraph_rows(paras(s, d), paras(s, d).where("doc_id % 4 = 0").select("doc_id", "i", F.array(F.lit("Fear")).alias("labels")), most_benign=50).select("doc_id", "text", F.size("labels").alias("n")),
    "SELECT c_custkey AS doc_id, c_name AS text, 1 AS n FROM customer WHERE c_custkey % 4 = 0 UNION ALL (SELECT c_custkey, c_name, 0 FROM customer WHERE c_custkey % 4 <> 0 ORDER BY md5(c_custkey || ':0'), c_custkey LIMIT 50)")
