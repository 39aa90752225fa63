"""Queries whose input and answer differ from row to row, for operators that one constant says little about."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formats, pieces
from ..functions import text as tx
from ..operators import dataset, dims, encode, hybrid, jsonwalk, media, ops, pixels, respond, spans
from ..sources.io import Config
from . import corpus as cp
from ..streaming import sse
from .detecting import BASE_SQL, found_sql, spans_sql
from .serving import BOUND, GREEDY, REQUEST, SAMPLE_KEY, _round_trip, chunks, made, samples

QUERIES: dict = {}
ORACLES: dict = {}
K = "c_custkey"


def add(name: str, query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


def customers(s, d):
    return s.read.parquet(f"{d}/customer.parquet")


def spliced_sql(docs: str, found: str) -> str:
    """docs (doc_id, text) with the non-overlapping spans of found (doc_id, start, end, label) replaced."""
    return f"""(WITH t AS ({docs}), f AS ({found}), o AS (SELECT f.*, lag("end", 1, 0) OVER (PARTITION BY doc_id ORDER BY "start") AS back FROM f),
p AS (SELECT o.doc_id, string_agg(substr(text, CAST(back AS INT) + 1, CAST("start" - back AS INT)) || label, '' ORDER BY "start") AS head, max("end") AS reach FROM o JOIN t ON o.doc_id = t.doc_id GROUP BY o.doc_id)
SELECT t.doc_id, CASE WHEN head IS NULL THEN text ELSE head || substr(text, CAST(reach AS INT) + 1) END AS text FROM t LEFT JOIN p ON t.doc_id = p.doc_id)"""


def greedy_sql(found: str) -> str:
    return f"""(WITH RECURSIVE f AS ({found}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC, value, type) AS i FROM f),
g AS (SELECT r.*, "end" AS reach, true AS kept FROM r WHERE i = 1 UNION ALL SELECT r.*, CASE WHEN r."start" >= g.reach THEN r."end" ELSE g.reach END, r."start" >= g.reach FROM g JOIN r ON r.doc_id = g.doc_id AND r.i = g.i + 1)
SELECT doc_id, "start", "end", value, type FROM g WHERE kept)"""


# --- requests
headers, HEADERS = made([f"{K} AS id", f"CASE {K} % 5 WHEN 0 THEN 'Host' WHEN 1 THEN 'X-Key' WHEN 2 THEN 'Transfer-Encoding' WHEN 3 THEN 'x-trace' ELSE 'TE' END AS a", f"CASE {K} % 3 WHEN 0 THEN 'Accept' WHEN 1 THEN 'Keep-Alive' ELSE 'Content-Type' END AS b", "c_name AS v"])
add("s6_forwarded_headers", lambda s, d: headers(s, d).select("id", F.array_join(F.array_sort(F.transform(F.map_entries(ops.forwarded(F.create_map("a", "v", "b", F.lit("1")), ["x-key"])), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("kept")),
    f"SELECT id, concat_ws(';', CASE WHEN b IN ('Accept', 'Content-Type') THEN b || '=1' END, CASE WHEN a = 'x-trace' THEN 'x-trace=' || v END) AS kept FROM ({HEADERS})")
add("s9_health_report", lambda s, d: ops.latency(samples(s, d).withColumn("metric", F.lit("all"))),
    f"WITH b AS (SELECT us, {BOUND} AS bound, row_number() OVER (ORDER BY us) AS i, count(*) OVER () AS n FROM (SELECT CAST(abs(floor(value * 1000)) AS BIGINT) AS us FROM events)) SELECT 'all' AS metric, count(*) AS n, CAST(floor(sum(us) / count(*)) AS BIGINT) AS mean_us, "
    + ", ".join(f"CAST(min(bound) FILTER (i >= ceil(n * {p})) AS BIGINT) AS p{int(p * 100)}" for p in (0.5, 0.95, 0.99)) + " FROM b")
COUNTED = f"CASE WHEN {K} % 13 < 11 THEN " + "CASE " + f"{K} % 13 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(ops.COUNTERS)) + " END ELSE 'other' END"
log, LOG = made([f"{COUNTED} AS counter", f"CAST({K} AS BIGINT) AS n"])
add("a3_counters", lambda s, d: ops.counters(log(s, d)), "SELECT " + ", ".join(f"CAST(coalesce(sum(n) FILTER (counter = '{c}'), 0) AS BIGINT) AS {c}" for c in ops.COUNTERS) + f" FROM ({LOG})")
snaps, SNAPS = made(["o_orderkey AS at", *(f"CAST(o_orderkey * {i + 1} AS BIGINT) AS {c}" for i, c in enumerate(ops.COUNTERS))], "orders")
add("s10_resumed_counters", lambda s, d: ops.resumed(snaps(s, d), log(s, d)), "SELECT " + ", ".join(f"CAST(coalesce(sum(n) FILTER (counter = '{c}'), 0) + (SELECT max(o_orderkey) * {i + 1} FROM orders) AS BIGINT) AS {c}" for i, c in enumerate(ops.COUNTERS)) + f" FROM ({LOG})")
add("o2_timing_headers", lambda s, d: customers(s, d).select(K, F.array_join(F.array_sort(F.transform(F.map_entries(ops.timing_headers(F.expr(f"map('regex_us', {K} % 3, 'voting_us', {K} % 2, 'total_us', {K})"))), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ";").alias("sent")),
    f"SELECT {K}, concat_ws(';', CASE WHEN {K} % 3 > 0 THEN 'x-regex-us=' || {K} % 3 END, CASE WHEN {K} > 0 THEN 'x-total-us=' || {K} END, CASE WHEN {K} % 2 > 0 THEN 'x-voting-us=' || {K} % 2 END) AS sent FROM customer")

# --- bodies
B64 = f"""'{{"a":{{"type":"' || CASE {K} % 3 WHEN 0 THEN 'base64' ELSE 'text' END || '","data":"D' || {K} || '"}},"b":"' || CASE {K} % 4 WHEN 0 THEN 'data:image/png;base64,AA' ELSE 'v' || {K} END || '"}}'"""
add("t3_base64_skipped", lambda s, d: jsonwalk.leaves(customers(s, d).selectExpr(K, f"{B64} AS body"), K, "body").select(K, "path", "value"),
    f"SELECT {K}, 'a.type' AS path, CASE {K} % 3 WHEN 0 THEN 'base64' ELSE 'text' END AS value FROM customer UNION ALL SELECT {K}, 'a.data', 'D' || {K} FROM customer WHERE {K} % 3 <> 0 UNION ALL SELECT {K}, 'b', 'v' || {K} FROM customer WHERE {K} % 4 <> 0")
TREE = f"""'{{"m":[{{"c":"x' || {K} || '","n":1}},{{"c":"y","n":' || {K} || '}}],"t":"z"}}'"""
add("t8_json_rewrite", lambda s, d: customers(s, d).selectExpr(K, f"{TREE} AS body", f"array(struct(CASE {K} % 3 WHEN 0 THEN array('m', CAST({K} % 2 AS STRING), 'c') WHEN 1 THEN array('t') ELSE array('m', '7', 'c') END AS segments, concat('new', {K}) AS value)) AS ch").select(K, jsonwalk.rewritten(F.col("body"), F.col("ch")).alias("body")),
    f"""SELECT {K}, '{{"m":[{{"c":"' || CASE WHEN {K} % 3 = 0 AND {K} % 2 = 0 THEN 'new' ELSE 'x' END || {K} || '","n":1}},{{"c":"' || CASE WHEN {K} % 3 = 0 AND {K} % 2 = 1 THEN 'new' || {K} ELSE 'y' END || '","n":' || {K} || '}}],"t":"' || CASE WHEN {K} % 3 = 1 THEN 'new' || {K} ELSE 'z' END || '"}}' AS body FROM customer""")
add("t7_fan_out", lambda s, d: jsonwalk.leaves(customers(s, d).selectExpr(K, f"{TREE} AS body"), K, "body").groupBy(K, F.element_at("segments", 1).alias("entry")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("last")),
    f"SELECT {K}, unnest(['m', 't']) AS entry, CAST(unnest([2, 1]) AS BIGINT) AS n, unnest(['y', 'z']) AS last FROM customer")
ONE = f"""CASE {K} % 5 WHEN 0 THEN '{{"type":"image","source":{{"type":"base64","media_type":"image/gif","data":"AA"}}}}' WHEN 1 THEN '{{"type":"image_url","image_url":{{"url":"https://x.example/' || {K} || '"}}}}' WHEN 2 THEN '{{"type":"audio","source":{{"type":"base64","media_type":"audio/wav","data":"AA"}}}}' WHEN 3 THEN '{{"type":"input_audio","input_audio":{{"data":"AA","format":"mp3"}}}}' ELSE '{{"type":"text","text":"image"}}' END"""
blocks = lambda s, d: jsonwalk.media_blocks(customers(s, d).selectExpr(K, f"{ONE} AS block"), K, F.array("block", F.lit('{"type":"image","source":{"type":"file"}}')))
BLOCK_SQL = f"SELECT {K}, 0 AS at, CASE WHEN {K} % 5 < 2 THEN 'image' ELSE 'audio' END AS kind, CASE {K} % 5 WHEN 0 THEN 'image/gif' WHEN 2 THEN 'audio/wav' WHEN 3 THEN 'mp3' END AS media_type, {K} % 5 <> 1 AS has_data, CASE WHEN {K} % 5 = 1 THEN 'https://x.example/' || {K} END AS url FROM customer WHERE {K} % 5 < 4"
add("d60_media_blocks", lambda s, d: blocks(s, d).select(K, "at", "kind", "media_type", "has_data", "url"), BLOCK_SQL)
add("o8_audio_blocks", lambda s, d: blocks(s, d).where("kind = 'audio'").select(K, "at", "media_type"), f"SELECT {K}, \"at\", media_type FROM ({BLOCK_SQL}) WHERE kind = 'audio'")
PICTURE = f"""'{{"image_url":{{"url":"https://x.example/' || {K} || '"}},"source":{{"type":"base64","data":"old' || {K} || '"}}}}'"""
put = lambda path, value: F.array(F.struct(F.array(*map(F.lit, path)).alias("segments"), value.alias("value")))
add("j4_url_to_base64", lambda s, d: customers(s, d).selectExpr(K, "c_name", f"{PICTURE} AS body").select(K, jsonwalk.rewritten(F.col("body"), put(["image_url", "url"], F.concat(F.lit("data:image/png;base64,"), F.base64(F.encode("c_name", "UTF-8"))))).alias("body")),
    f"""SELECT {K}, replace({PICTURE}, 'https://x.example/' || {K}, 'data:image/png;base64,' || base64(encode(c_name))) AS body FROM customer""")
add("j5_image_replace", lambda s, d: customers(s, d).selectExpr(K, "c_name", f"{PICTURE} AS body").select(K, jsonwalk.rewritten(F.col("body"), put(["source", "data"], F.base64(F.encode("c_name", "UTF-8")))).alias("body")),
    f"""SELECT {K}, replace({PICTURE}, 'old' || {K}, base64(encode(c_name))) AS body FROM customer""")
SOUND = f"""'{{"m":[{{"type":"input_audio","input_audio":{{"data":"S' || {K} || '","format":"wav"}}}}],"t":"x"}}'"""
transcripts = lambda s, d: spans.phrase_scan(cp.corpus(s, d, cp.SAID), s.createDataFrame([(p, "spoken", 0) for p in dims.SPOKEN], "phrase string, type string, rank int")).select(F.col("doc_id").alias("request_id"))
STRIPPED = f"SELECT CAST({K} AS BIGINT) AS request_id, CASE WHEN {K} % 5 IN (0, 1) THEN replace({SOUND}, 'S' || {K}, '[AUDIO REMOVED]') ELSE {SOUND} END AS body FROM customer"
for _name in ("m11_audio_strip", "j6_audio_notice"):
    add(_name, lambda s, d: media.audio_stripped(customers(s, d).selectExpr(f"CAST({K} AS BIGINT) AS request_id", f"{SOUND} AS body"), transcripts(s, d)), STRIPPED)

# --- text
VOCABULARY = ["[UNK]", "un", "##aff", "##able", "hello", "!", "##o", "h", "##e"]
add("t12_wordpiece", lambda s, d: customers(s, d).select(K, F.array_join(pieces.pieces(F.expr(f"CASE {K} % 4 WHEN 0 THEN 'Hello!' WHEN 1 THEN 'unaffable heo' WHEN 2 THEN 'unable! zz' ELSE 'UNAFF' END || CASE {K} % 3 WHEN 0 THEN ' he' ELSE '' END"), VOCABULARY), ",").alias("ids")),
    f"SELECT {K}, CASE {K} % 4 WHEN 0 THEN '4,5' WHEN 1 THEN '1,2,3,7,8,6' WHEN 2 THEN '1,3,5,0' ELSE '1,2' END || CASE {K} % 3 WHEN 0 THEN ',7,8' ELSE '' END AS ids FROM customer")
hits = lambda s, d: customers(s, d).selectExpr(f"{K} AS doc_id", f"explode(array(struct(1 AS n, CAST({K} % 7 AS INT) AS start, CAST({K} % 7 + 3 AS INT) AS `end`, 'one' AS value, 't' AS type), named_struct('n', 2, 'start', 4, 'end', CAST(4 + {K} % 6 AS INT), 'value', 'two', 'type', 't'), named_struct('n', 3, 'start', 8, 'end', 20, 'value', 'three', 'type', 't'))) AS h").select("doc_id", "h.*")
TWO = f"NOT (4 < 20 AND 4 + {K} % 6 > 8)"
add("d43_longer_first", lambda s, d: spans.longest_first(hits(s, d)).select("doc_id", "value"),
    f"SELECT {K} AS doc_id, 'three' AS value FROM customer UNION ALL SELECT {K}, 'two' FROM customer WHERE {TWO} UNION ALL SELECT {K}, 'one' FROM customer WHERE {K} % 7 + 3 <= 8 AND NOT ({TWO} AND {K} % 7 < 4 + {K} % 6 AND {K} % 7 + 3 > 4)")
PARAGRAPH = r"[^\n]+(?:\n[^\n]+)*"
add("r9_labelled_paragraphs", lambda s, d: dataset.labelled_paragraphs(dataset.paragraphs(cp.documents(s, d)), cp.documents(s, d).selectExpr("doc_id", "CAST(doc_id * 37 % 400 AS INT) AS first", "CAST(doc_id * 37 % 400 + 20 + doc_id % 90 AS INT) AS last", "concat('l', doc_id % 3) AS label")).select("doc_id", "i", F.array_join("labels", ",").alias("labels")),
    f"WITH p AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY \"start\") - 1 AS INT) AS i, \"start\", \"end\" FROM {spans_sql('SELECT doc_id, text FROM documents', PARAGRAPH)} WHERE length(value) >= 30), s AS (SELECT doc_id, doc_id * 37 % 400 AS first, doc_id * 37 % 400 + 20 + doc_id % 90 AS last, 'l' || doc_id % 3 AS label FROM documents) "
    "SELECT p.doc_id, i, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p JOIN s ON p.doc_id = s.doc_id WHERE greatest(0, least(\"end\", last) - greatest(\"start\", first)) >= 0.5 * (last - first) GROUP BY p.doc_id, i")  # fmt: skip
LITE = {"ssn": "[SSN]", "credit_card": "[CREDIT_CARD]", "phone": "[PHONE]", "email": "[EMAIL]", "api_key": "[API_KEY]"}
LABEL = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LITE.items()) + " END"


def lite_sql(docs: str) -> str:
    rows = " UNION ALL ".join(f"SELECT doc_id, \"start\", \"end\", value, '{p.type}' AS type FROM {spans_sql(docs, p.regex)}" for p in dims.BASE if p.type in LITE)
    return spliced_sql(docs, f"SELECT *, {LABEL} AS label FROM {greedy_sql(rows)}")


add("d58_lite_redactor", lambda s, d: encode.lite(cp.corpus(s, d)), f"SELECT * FROM {lite_sql(cp.corpus_sql())}")
CALL = f"""'{{"tool":"send","arguments":{{"to":"user' || {K} || '@mail.example.com","note":"' || CASE {K} % 3 WHEN 0 THEN 'call 415-555-' || lpad(CAST({K} % 10000 AS STRING), 4, '0') WHEN 1 THEN 'id 123-45-' || lpad(CAST({K} % 10000 AS STRING), 4, '0') ELSE 'none' END || '"}}}}'"""
add("p20_tool_hooks", lambda s, d: encode.lite(cp.corpus(s, d, CALL)), f"SELECT * FROM {lite_sql(cp.corpus_sql(CALL))}")
add("p14_splice", lambda s, d: spans.spliced(cp.corpus(s, d), spans.greedy(spans.scan(cp.corpus(s, d), dims.BASE).drop("pattern")).withColumn("replacement", F.concat(F.lit("<"), "type", F.length("value").cast("string"), F.lit(">")))),
    f"SELECT * FROM {spliced_sql(cp.corpus_sql(), f'''SELECT *, '<' || type || length(value) || '>' AS label FROM {greedy_sql(f'SELECT doc_id, {chr(34)}start{chr(34)}, {chr(34)}end{chr(34)}, value, type FROM ({BASE_SQL})')}''')}")
add("p18_transcript_counts", lambda s, d: spans.scan(cp.corpus(s, d), dims.BASE).groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n")), f"SELECT doc_id, type, count(*) AS n FROM ({BASE_SQL}) GROUP BY ALL")

# --- encoding
LOCAL = f"substr('abcdefgh', 1, CAST({K} % 8 AS INT) + 1) || '@x.example'"
shorts = lambda s, d: customers(s, d).selectExpr(f"CAST({K} AS BIGINT) AS doc_id", "0 AS start", f"CASE WHEN {K} % 3 = 0 THEN c_name ELSE {LOCAL} END AS value", f"CASE WHEN {K} % 3 = 0 THEN 'person' ELSE 'email' END AS type", f"{REQUEST} AS request_id").withColumn("end", F.length("value"))
ROUTE = f"CASE WHEN {K} % 3 = 0 THEN 'token' WHEN {K} % 8 + 1 >= 4 THEN 'cipher' ELSE 'OTHER' END"
shown = lambda df: df.select("doc_id", "route", F.when(F.col("route") == "cipher", F.length("replacement") - F.length("value")).alias("grown"), F.when(F.col("route") == "closed", F.col("replacement")).alias("closed"), F.when(F.col("route") == "token", F.substring_index("replacement", "_", 1)).alias("prefix"))
for _name, _open, _other in (("p11_routing", True, "token"), ("p12_fail_closed", False, "closed"), ("p13_fail_open", True, "token")):
    add(_name, lambda s, d, o=_open: shown(encode.encoded(shorts(s, d), SAMPLE_KEY, fail_open=o)),
        f"SELECT CAST({K} AS BIGINT) AS doc_id, r AS route, CASE WHEN r = 'cipher' THEN 0 END AS grown, CASE WHEN r = 'closed' THEN '[REDACTED:email]' END AS closed, CASE WHEN r = 'token' THEN CASE WHEN {K} % 3 = 0 THEN '{encode.OF['person'][3]}' ELSE '{encode.OF['email'][3]}' END END AS prefix FROM (SELECT {K}, {ROUTE.replace('OTHER', _other)} AS r FROM customer)")
GUARDED = [k for k, (radix, *_) in encode.OF.items() if radix == 10]
value = f"substr('12345678901234567', 1, CAST({K} % 17 + 1 AS INT))"
kind = f"CASE {K} % {len(GUARDED)} " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(GUARDED)) + " END"
least = f"CASE {K} % {len(GUARDED)} " + " ".join(f"WHEN {i} THEN {encode.OF[k][1]}" for i, k in enumerate(GUARDED)) + " END"
add("p7_domain_guard", lambda s, d: customers(s, d).selectExpr(K, f"{value} AS v", f"{kind} AS t").select(K, (F.length(encode.bare(encode.parts(F.col("v"), F.col("t"))[1], F.col("t"))) >= encode.of_type(F.col("t"), 1)).alias("allowed")), f"SELECT {K}, length({value}) >= {least} AS allowed FROM customer")
stable = lambda s, d: customers(s, d).selectExpr("c_nationkey AS conv_id", f"{K} AS turn", "'person' AS type", "c_mktsegment AS value", f"concat('T', {K}) AS replacement")
add("p3_stable_encrypt", lambda s, d: encode.one_per_plaintext(stable(s, d), ["turn"]).select("turn", "replacement"), f"SELECT {K} AS turn, 'T' || min({K}) OVER (PARTITION BY c_nationkey, c_mktsegment) AS replacement FROM customer")
PERSON = "'P' || conv_id % 7 || 'x' || turn % 2"


def registry(s, d):
    """Messages that name a person, some of them by the assistant; some conversations have a mapping from before."""
    talk = s.read.parquet(f"{d}/conversations.parquet").selectExpr("conv_id", "turn", "role", f"{PERSON.replace(' || ', ', ').join(('concat(', ')'))} AS value").withColumn("text", F.concat(F.lit("say "), "value", F.lit("!")))
    found = talk.selectExpr("conv_id", "turn", "4 AS start", "4 + length(value) AS `end`", "value", "'person' AS type", "concat('N', conv_id, '_', turn) AS replacement")
    prior = talk.where("conv_id % 3 = 0 AND turn % 2 = 0").selectExpr("conv_id", "value", "concat('OLD', conv_id) AS replacement").distinct()
    return encode.sanitized_messages(talk.select("conv_id", "turn", "role", "text"), found, prior)


add("p17_message_registry", lambda s, d: registry(s, d)[0],
    f"WITH t AS (SELECT conv_id, turn, role, {PERSON} AS v FROM conversations), f AS (SELECT conv_id, v, min(turn) AS first FROM t WHERE role <> 'assistant' GROUP BY ALL) "
    "SELECT t.conv_id, t.turn, role, 'say ' || CASE WHEN role = 'assistant' THEN t.v WHEN t.conv_id % 3 = 0 AND EXISTS (SELECT 1 FROM t o WHERE o.conv_id = t.conv_id AND o.v = t.v AND o.turn % 2 = 0) THEN 'OLD' || t.conv_id ELSE 'N' || t.conv_id || '_' || f.first END || '!' AS text FROM t LEFT JOIN f ON t.conv_id = f.conv_id AND t.v = f.v")  # fmt: skip
FOUR = f"lpad(CAST({K} % 10000 AS STRING), 4, '0')"
maps = lambda s, d: customers(s, d).selectExpr(f"{K} AS doc_id", f"'415-555-' || {FOUR} AS ciphertext", "concat('$1\\\\', c_name) AS plaintext", "'phone' AS type")
call = lambda s, d: customers(s, d).selectExpr(f"{K} AS doc_id", f"CASE {K} % 4 WHEN 0 THEN 'call (415) 555 ' || {FOUR} || ' now' WHEN 1 THEN 'call 415.555.' || {FOUR} WHEN 2 THEN 'call 415-555-' || {FOUR} || '; 415555' || {FOUR} ELSE 'call 9415555' || {FOUR} END AS text")
add("x4_fuzzy_restore", lambda s, d: encode.restored(call(s, d), maps(s, d)),
    f"SELECT {K} AS doc_id, CASE {K} % 4 WHEN 0 THEN 'call $1\\' || c_name || ' now' WHEN 1 THEN 'call $1\\' || c_name WHEN 2 THEN 'call $1\\' || c_name || '; 415555' || {FOUR} ELSE 'call 9415555' || {FOUR} END AS text FROM customer")
add("x3_exact_restore", lambda s, d: encode.restored(call(s, d), maps(s, d), fuzzy=False),
    f"SELECT {K} AS doc_id, CASE {K} % 4 WHEN 0 THEN 'call (415) 555 ' || {FOUR} || ' now' WHEN 1 THEN 'call 415.555.' || {FOUR} WHEN 2 THEN 'call $1\\' || c_name || '; 415555' || {FOUR} ELSE 'call 9415555' || {FOUR} END AS text FROM customer")

# --- responses
HASHED = f"('0x' || substr(md5(CAST({K} AS VARCHAR)), 1, 8))::BIGINT % 1000 < 100"
add("c5_sampling", lambda s, d: customers(s, d).selectExpr(K, f"CASE {K} % 4 WHEN 0 THEN 'off' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS level", f"{K} % 5 = 0 AS flagged").select(K, respond.second_look(F.col("level"), F.col("flagged"), F.col(K)).alias("asked")),
    f"SELECT {K}, CASE {K} % 4 WHEN 0 THEN false WHEN 3 THEN true WHEN 2 THEN {K} % 5 = 0 OR {HASHED} ELSE {K} % 5 = 0 END AS asked FROM customer")
LOGITS = "SELECT vec_id, [CAST(embedding[i] AS DOUBLE) * 8 for i in range(1, 5)] AS x FROM embeddings WHERE len(embedding) >= 4 AND embedding IS NOT NULL"
logits = lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").where("size(embedding) >= 4").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double") * 8).alias("x"))
PICKED = "list_transform(list_filter(range(1, 5), lambda i: 1 / (1 + exp(-x[i])) >= 0.55), lambda i: " + str(respond.CLASSES) + "[i])"
add("c6_classifier_labels", lambda s, d: logits(s, d).select("vec_id", F.array_join(respond.classified(F.col("x")), ",").alias("labels")), f"SELECT vec_id, array_to_string({PICKED}, ',') AS labels FROM ({LOGITS})")
add("c7_early_exit", lambda s, d: logits(s, d).select("vec_id", F.array_join(respond.classified(F.col("x"), early=F.transform("x", lambda v: v - 2)), ",").alias("labels")),
    f"SELECT vec_id, CASE WHEN 1 / (1 + exp(-(list_max(x) - 2))) < 0.3 THEN '' ELSE array_to_string({PICKED}, ',') END AS labels FROM ({LOGITS})")

# --- datasets
near, NEAR = made([f"{K} AS id", "c_mktsegment AS label", f"c_mktsegment || ' offers ' || substr(c_name, 10, 9) || CAST({K} % 10 AS STRING) || ' of ' || CAST(c_nationkey AS STRING) AS text"])
RATIO = "round(1 - levenshtein(x.text, y.text) / greatest(length(x.text), length(y.text)), 4)"
add("e3_similar_pairs", lambda s, d: dataset.similar_classes(near(s, d), "id", "text", ["label"], least=0.93),
    f"WITH n AS ({NEAR}), f AS (SELECT label, text, min(id) AS id FROM n GROUP BY ALL) SELECT x.id AS a, y.id AS b, {RATIO} AS ratio FROM f x JOIN f y ON x.label = y.label AND x.id < y.id WHERE abs(length(x.text) - length(y.text)) <= 0.3 * greatest(length(x.text), length(y.text)) AND {RATIO} >= 0.93 "
    "UNION ALL SELECT f.id, n.id, CAST(1 AS DOUBLE) FROM n JOIN f ON n.label = f.label AND n.text = f.text WHERE n.id <> f.id")  # fmt: skip
add("e8_technique_mapping", lambda s, d: dataset.mapped(customers(s, d).select(K, "c_mktsegment"), s.createDataFrame([("BUILDING", "fear", "loss"), ("MACHINERY", "urgency", "time"), ("NONE", "x", "y")], "c_mktsegment string, category string, subcategory string"), "c_mktsegment").select(K, "category", "subcategory"),
    f"SELECT {K}, CASE c_mktsegment WHEN 'BUILDING' THEN 'fear' ELSE 'urgency' END AS category, CASE c_mktsegment WHEN 'BUILDING' THEN 'loss' ELSE 'time' END AS subcategory FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
TRUTH = [("email", f"'user' || {cp.num(4, 7)} || '@mail' || CAST({K} % 7 AS STRING) || '.example.com'"), ("ssn", f"{cp.num(3, 1)} || '-' || {cp.num(2, 2)} || '-' || {cp.num(4, 3)}"), ("credit_card", f"{cp.CARD} || (CASE WHEN {K} % 3 = 0 THEN '0' ELSE {cp.luhn_digit(cp.CARD, 15)} END)")]


def planted(s, d):
    out = None
    for name, expression in TRUTH:
        own = customers(s, d).selectExpr(f"CAST({K} AS BIGINT) AS doc_id", f"{expression} AS value", f"'{name}' AS type")
        out = own if out is None else out.unionByName(own)
    return out


JUDGED = [p for p in dims.BASE if p.type in dict(TRUTH)]
PLANTED = " UNION ALL ".join(f"SELECT CAST({K} AS BIGINT) AS doc_id, {e} AS value, '{t}' AS type FROM customer" for t, e in TRUTH)
add("e11_detection_recall", lambda s, d: dataset.detection_scores(spans.scan(cp.corpus(s, d), JUDGED), planted(s, d), cp.corpus(s, d)),
    f"""WITH f AS ({found_sql(cp.TEXT, JUDGED)}), p AS (SELECT DISTINCT * FROM ({PLANTED})), o AS (SELECT f.*, coalesce(max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC, type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > "start", false) AS "overlap" FROM f),
n AS (SELECT o.type, count(p.value) AS tp, count(*) AS found, count(*) FILTER (o."overlap") AS "overlaps" FROM o LEFT JOIN p ON o.doc_id = p.doc_id AND o.value = p.value AND o.type = p.type GROUP BY o.type), t AS (SELECT type, count(*) AS truth FROM p GROUP BY type)
SELECT t.type, tp, found, truth, round(tp / found, 6) AS precision, round(tp / truth, 6) AS recall, round(2 * tp / (found + truth), 6) AS f1, "overlaps", 0::BIGINT AS misplaced FROM t JOIN n ON t.type = n.type""")  # fmt: skip
WANTED = f"CAST({K} % 12 AS INT) AS least"
add("e13_expectations", lambda s, d: dataset.expectations(spans.scan(cp.corpus(s, d), dims.BASE).select(F.col("doc_id").alias("file"), "type"), customers(s, d).selectExpr(f"CAST({K} AS BIGINT) AS file", WANTED, f"CASE WHEN {K} % 2 = 0 THEN array('email', 'api_key') ELSE array('ssn', 'credit_card') END AS types")),
    f"WITH f AS ({BASE_SQL}), n AS (SELECT doc_id, count(*) AS matches, list(DISTINCT type) AS have FROM f GROUP BY doc_id), w AS (SELECT CAST({K} AS BIGINT) AS file, {WANTED}, CASE WHEN {K} % 2 = 0 THEN ['email', 'api_key'] ELSE ['ssn', 'credit_card'] END AS types FROM customer) "
    "SELECT file, coalesce(matches, 0) AS matches, least, CASE WHEN coalesce(matches, 0) < least THEN 'short' WHEN NOT list_has_all(coalesce(have, []), types) THEN 'missing' ELSE 'pass' END AS verdict FROM w LEFT JOIN n ON w.file = n.doc_id")  # fmt: skip

# --- dictionaries and names of any size, as tables
MANY = "'condition ' || CAST(o_orderkey AS STRING)"
add("d42_dictionary_table", lambda s, d: spans.phrase_scan(customers(s, d).selectExpr(f"CAST({K} AS BIGINT) AS doc_id", f"'Has Condition ' || CAST({K} AS STRING) || ', not condition ' || CAST({K} + 1 AS STRING) || '.' AS text"), s.read.parquet(f"{d}/orders.parquet").selectExpr(f"{MANY} AS phrase", "CASE WHEN o_orderkey % 2 = 0 THEN 'health' ELSE 'child' END AS type", "0 AS rank")).select("doc_id", "start", "value", "type"),
    f"WITH t AS (SELECT {K} AS k, unnest([4, 4 + 10 + length(CAST({K} AS VARCHAR)) + 6]) AS s, unnest([{K}, {K} + 1]) AS c FROM customer) SELECT CAST(k AS BIGINT) AS doc_id, CAST(s AS INT) AS \"start\", 'condition ' || c AS value, CASE WHEN c % 2 = 0 THEN 'health' ELSE 'child' END AS type FROM t WHERE c IN (SELECT o_orderkey FROM orders)")
add("d45_name_tables", lambda s, d: spans.names_scan(customers(s, d).selectExpr(f"CAST({K} AS BIGINT) AS doc_id", f"'Ask Fn' || CAST({K} AS STRING) || ' Ln' || CAST({K} + 1 AS STRING) || ' or fn1' AS text"), s.read.parquet(f"{d}/orders.parquet").selectExpr("concat('Fn', o_orderkey) AS name"), s.read.parquet(f"{d}/supplier.parquet").selectExpr("concat('Ln', s_suppkey) AS name")).select("doc_id", "value", "confidence"),
    f"WITH t AS (SELECT CAST({K} AS BIGINT) AS doc_id, 'Fn' || {K} AS f, 'Ln' || ({K} + 1) AS l, {K} IN (SELECT o_orderkey FROM orders) AS a, {K} + 1 IN (SELECT s_suppkey FROM supplier) AS b FROM customer) SELECT doc_id, CASE WHEN a AND b THEN f || ' ' || l WHEN a THEN f ELSE l END AS value, CAST(CASE WHEN a AND b THEN 0.7 ELSE 0.4 END AS DOUBLE) AS confidence FROM t WHERE a OR b")
add("a8_passthrough", lambda s, d: customers(s, d).select(F.col(K).cast("long").alias("doc_id")).join(hybrid.detect(cp.corpus(s, d), config=Config(passthrough=True)).select("doc_id", "value"), "doc_id", "left"), f"SELECT CAST({K} AS BIGINT) AS doc_id, NULL AS value FROM customer")

# --- pictures: eight by eight, black down to a row that the key names
picture = lambda s, d: customers(s, d).selectExpr(K, f"unhex(concat(repeat('00', 8 * CAST({K} % 7 + 1 AS INT)), repeat('FF', 8 * CAST(7 - {K} % 7 AS INT)))) AS p", "8 AS w")
R = f"({K} % 7 + 1)"
add("m6_edge_density", lambda s, d: picture(s, d).select(K, F.round(pixels.edge_density(F.col("p"), F.col("w")), 4).alias("density")), f"SELECT {K}, round(CASE WHEN {R} IN (1, 7) THEN 6 ELSE 12 END / 36, 4) AS density FROM customer")
add("m7_regions", lambda s, d: picture(s, d).select(K, F.size(pixels.regions(F.col("p"), F.col("w"))).alias("n"), F.get(pixels.regions(F.col("p"), F.col("w")), F.lit(0))["y0"].alias("y0")), f"SELECT {K}, CASE WHEN {R} > 5 THEN 0 ELSE 1 END AS n, CASE WHEN {R} > 5 THEN NULL ELSE {R} END AS y0 FROM customer")
add("m10_region_fill", lambda s, d: picture(s, d).select(K, F.hex(pixels.filled(F.col("p"), F.col("w"), F.struct(F.lit(1).alias("x0"), F.lit(4).alias("y0"), F.lit(4).alias("x1"), F.lit(6).alias("y1")))).alias("pixels")),
    f"SELECT {K}, array_to_string(list_transform(range(8), lambda y: CASE WHEN y < {R} THEN repeat('00', 8) WHEN y IN (4, 5) THEN 'FF' || repeat('00', 3) || repeat('FF', 4) ELSE repeat('FF', 8) END), '') AS pixels FROM customer")
add("m2_status_bar", lambda s, d: picture(s, d).select(K, (pixels.row_variance(F.col("p"), F.col("w"), 2) < 50).alias("even")), f"SELECT {K}, {R} <> 1 AS even FROM customer")
FRAMES = f"array(CAST({K} % 3 AS INT), CAST({K} % 3 AS INT), 0, CAST({K} % 2 AS INT), 2, 2)"
add("m8_ctc", lambda s, d: customers(s, d).selectExpr(K, f"transform({FRAMES}, (b, i) -> struct(b AS best, CAST(i + 1 AS DOUBLE) / 10 AS p)) AS frames").select(K, media.ctc(F.col("frames"), 3, F.array(F.lit("x"), F.lit("y"))).alias("c")).select(K, "c.text", F.round("c.confidence", 6).alias("confidence")),
    f"SELECT {K}, array_to_string(list_transform(kept, lambda i: ['x', 'y'][f[i]]), '') AS text, round(list_avg(list_transform(kept, lambda i: i / 10)), 6) AS confidence FROM (SELECT {K}, f, list_filter(range(1, 7), lambda i: f[i] <> 0 AND (i = 1 OR f[i - 1] <> f[i])) AS kept FROM (SELECT {K}, [{K} % 3, {K} % 3, 0, {K} % 2, 2, 2] AS f FROM customer))")
add("o7_anchors", lambda s, d: media.anchors(s).select("layer", F.round("y", 6).alias("y"), F.round("x", 6).alias("x"), "k"),
    "SELECT l.layer, round((r.i + 0.5) / l.n, 6) AS y, round((c.i + 0.5) / l.n, 6) AS x, k.i AS k FROM (VALUES (0, 16), (1, 8), (2, 8), (3, 8)) l(layer, n) JOIN range(16) r(i) ON r.i < l.n JOIN range(16) c(i) ON c.i < l.n JOIN range(2) k(i) ON true")

# --- flows
add("p2_ff1_decrypt", lambda s, d: _round_trip(s, d).select("doc_id", "start", "type", "plain"), f'SELECT doc_id, "start", type, value AS plain FROM {GREEDY}')
CUT = f"substr('aab', 1, CAST({K} % 4 AS INT)) || repeat('é', CAST({K} % 20 AS INT))"
add("z5_buffer_cap", lambda s, d: customers(s, d).selectExpr(K, f"{CUT} AS t").select(K, sse.buffered(F.col("t"), 16).alias("text")), f"SELECT {K}, CASE WHEN {K} % 4 + 2 * ({K} % 20) <= 16 THEN {CUT} ELSE substr({CUT}, 1, CAST({K} % 4 + (16 - {K} % 4) // 2 AS INT)) END AS text FROM customer")
DELTA = """'{"choices":[{"delta":{"content":"' || %s || '"}}]}'"""
add("z1_line_reassembly", lambda s, d: sse.events(chunks(s, d)).select("stream_id", "data"), f"SELECT CAST({K} AS VARCHAR) AS stream_id, unnest([{DELTA % "'Hello '"}, {DELTA % 'c_name'}, '[DONE]']) AS data FROM customer")
REPLY = f"""CASE {K} % 3 WHEN 0 THEN '{{"choices":[{{"message":{{"content":"hi T' || {K} || '"}}}}]}}' WHEN 1 THEN '{{"content":[{{"type":"text","text":"T' || {K} || ' a"}},{{"type":"text","text":"b"}}]}}' ELSE 'plain T' || {K} END"""


def processed(s, d):
    """The text of each reply, by its format, with tokens restored."""
    replies = customers(s, d).selectExpr(f"{K} AS doc_id", f"{REPLY} AS body", f"CASE WHEN {K} % 3 < 2 THEN 'application/json' END AS ct", "c_name")
    texts = replies.withColumn("kind", formats.response_format(F.col("ct"), F.col("body"))).withColumn("text", formats.response_text(F.col("kind"), F.col("body")))
    mapping = replies.select("doc_id", F.concat(F.lit("T"), "doc_id").alias("ciphertext"), F.col("c_name").alias("plaintext"), F.lit("person").alias("type"))
    return encode.restored(texts.select("doc_id", "kind", "text"), mapping)


add("x8_response_process", processed, f"SELECT {K} AS doc_id, ['openai', 'anthropic', 'plain_text'][{K} % 3 + 1] AS kind, ['hi ' || c_name, c_name || ' a b', 'plain ' || c_name][{K} % 3 + 1] AS text FROM customer")
FENCED = f"{cp.TEXT} || ' `' || {cp.TEXT} || '`'"
MASK = f"SELECT doc_id, regexp_replace(text, '`[^`]*`', '') || repeat(' ', 0) AS text FROM ({cp.corpus_sql(FENCED)})"
add("t6_original_values", lambda s, d: spans.resliced(spans.scan(cp.corpus(s, d, FENCED).withColumn("text", tx.fences_masked(F.col("text"))), dims.BASE).drop("pattern", "value"), cp.corpus(s, d, FENCED)), found_sql("", dims.BASE, MASK))
