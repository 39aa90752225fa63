"""Queries of traversal, encoding, restoring, responses, streams, monitoring, dataset and media operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import crypto, formats
from ..functions import text as tx
from ..operators import crf, dataset, dims, encode, jsonwalk, media, ops, respond, spans
from ..streaming import sse
from . import corpus as cp
from .detecting import BASE_SQL, GREEDY_SQL, listed, phrases_sql

QUERIES: dict = {}
ORACLES: dict = {}
#: only for the queries' sample data; callers bring their own
SAMPLE_KEY = bytes(range(32))
REQUEST = "'00112233-4455-6677-8899-aabbccddeeff'"


def add(name: str, query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


def made(select: str, table: str = "customer"):
    """The same SELECT list over a table in both engines."""
    return lambda s, d: s.read.parquet(f"{d}/{table}.parquet").selectExpr(*select), f"SELECT {', '.join(select)} FROM {table}"


# --- sources and gates
bodies, BODIES = made(["c_custkey AS id", "CASE c_custkey % 3 WHEN 0 THEN 'lite' WHEN 1 THEN 'standard' ELSE 'full' END AS tier", "CASE c_custkey % 5 WHEN 0 THEN 'application/json' WHEN 1 THEN 'application/vnd.api+JSON; charset=utf-8' WHEN 2 THEN 'text/event-stream' WHEN 3 THEN 'text/html' ELSE NULL END AS ct", "CAST(c_custkey * 70001 AS BIGINT) AS size"])
add("s1_body_limit", lambda s, d: bodies(s, d).where(F.col("size") <= ops.body_limit(F.col("tier"))).select("id", "tier"),
    f"SELECT id, tier FROM ({BODIES}) WHERE size <= CASE tier WHEN 'lite' THEN 10485760 WHEN 'standard' THEN 52428800 ELSE 104857600 END")
add("s2_tier_limits", lambda s, d: bodies(s, d).groupBy("tier", ops.body_limit(F.col("tier")).alias("most")).agg(F.count(F.lit(1)).alias("n")),
    f"SELECT tier, CASE tier WHEN 'lite' THEN 10485760 WHEN 'standard' THEN 52428800 ELSE 104857600 END AS most, count(*) AS n FROM ({BODIES}) GROUP BY ALL")
add("s3_content_type_gate", lambda s, d: bodies(s, d).select("id", ops.scanned_type(F.col("ct")).alias("scanned")), f"SELECT id, ct IS NULL OR lower(ct) LIKE 'application/json%' OR lower(ct) LIKE '%+json%' AS scanned FROM ({BODIES})")
add("s4_event_stream_gate", lambda s, d: bodies(s, d).select("id", ops.event_stream(F.col("ct")).alias("streamed")), f"SELECT id, coalesce(lower(ct) LIKE '%text/event-stream%', false) AS streamed FROM ({BODIES})")
PROVIDERS = [("/a", "one"), ("/a/v1", "two"), ("/b/", "three")]
paths, PATHS = made(["c_custkey AS id", "CASE c_custkey % 4 WHEN 0 THEN '/a/v1/chat' WHEN 1 THEN '/a/x' WHEN 2 THEN '/b/y' ELSE '/c' END AS path"])
add("s5_provider_routing", lambda s, d: ops.routed(paths(s, d), PROVIDERS),
    f"SELECT id, path, (SELECT v.p FROM (VALUES ('/a', 'one'), ('/a/v1', 'two'), ('/b/', 'three')) v(x, p) WHERE starts_with(path, v.x) ORDER BY length(v.x) DESC LIMIT 1) AS provider, "
    f"CASE WHEN starts_with(path, '/a/v1') THEN substr(path, 6) WHEN starts_with(path, '/a') THEN substr(path, 3) WHEN starts_with(path, '/b/') THEN substr(path, 4) END AS rest FROM ({PATHS})")  # fmt: skip
urls, URLS = made(["c_custkey AS id", "CASE c_custkey % 6 WHEN 0 THEN 'https://img.example.com/a.png' WHEN 1 THEN 'http://localhost:8080/a' WHEN 2 THEN 'http://example.com/a' WHEN 3 THEN 'https://10.0.0.' || CAST(c_custkey % 200 AS STRING) || '/a' WHEN 4 THEN 'ftp://example.com/a' ELSE 'https://127.0.0.1/a' END AS url"])
_host = lambda c: F.regexp_extract(c, r"^[a-z]+://([^/:]*)", 1)
from ..functions.validators import private_ip  # noqa: E402

add("s7_fetch_guard", lambda s, d: urls(s, d).select("id", ops.fetchable(F.col("url"), private_ip(_host(F.col("url")))).alias("fetchable")), f"SELECT id, id % 6 IN (0, 1) AS fetchable FROM ({URLS})")
add("s8_detect_endpoint", lambda s, d: spans.scan(cp.corpus(s, d).where(ops.within_endpoint(F.col("text"))), dims.BASE).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), f"SELECT doc_id, count(*) AS n FROM ({BASE_SQL}) GROUP BY doc_id")
msgs, MSGS = made(["conv_id", "turn", "role", "text"], "conversations")
add("s17_message_texts", lambda s, d: msgs(s, d).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda m: m["text"]), " | ").alias("texts")),
    f"SELECT conv_id, string_agg(text, ' | ' ORDER BY turn) AS texts FROM ({MSGS}) GROUP BY conv_id")

# --- JSON
JSON = """'{"model":"m' || CAST(c_custkey AS STRING) || '","messages":[{"role":"user","content":"mail user' || CAST(c_custkey AS STRING) || '@example.com"},{"role":"tool","content":"{\\"ssn\\":\\"123-45-' || lpad(CAST(c_custkey % 9000 + 1000 AS STRING), 4, '0') || '\\"}"}],"n":5}'"""
json_rows = lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.concat(F.lit('{"model":"m'), F.col("c_custkey").cast("string"), F.lit('","messages":[{"role":"user","content":"mail user'), F.col("c_custkey").cast("string"), F.lit('@example.com"},{"role":"tool","content":"{\\"ssn\\":\\"123-45-'), F.lpad((F.col("c_custkey") % 9000 + 1000).cast("string"), 4, "0"), F.lit('\\"}"}],"n":5}')).alias("body"))
LEAVES = """SELECT c_custkey, unnest([struct_pack(p := 'messages[0].role', v := 'user'), struct_pack(p := 'messages[0].content', v := 'mail user' || c_custkey || '@example.com'), struct_pack(p := 'messages[1].role', v := 'tool'),
 struct_pack(p := 'messages[1].content.ssn', v := '123-45-' || lpad(CAST(c_custkey % 9000 + 1000 AS VARCHAR), 4, '0'))]) AS x FROM customer"""
add("t1_json_leaves", lambda s, d: jsonwalk.leaves(json_rows(s, d), "c_custkey", "body").select("c_custkey", "path", "value"), f"SELECT c_custkey, x.p AS path, x.v AS value FROM ({LEAVES})")
add("t2_skipped_keys", lambda s, d: jsonwalk.leaves(json_rows(s, d), "c_custkey", "body", skipped=["model", "role"]).select("c_custkey", "path", "value"), f"SELECT c_custkey, x.p AS path, x.v AS value FROM ({LEAVES}) WHERE x.p NOT LIKE '%role'")
add("t4_nested_json", lambda s, d: jsonwalk.leaves(json_rows(s, d), "c_custkey", "body").where("depth = 1").select("c_custkey", "path", "value"), f"SELECT c_custkey, x.p AS path, x.v AS value FROM ({LEAVES}) WHERE x.p LIKE '%ssn'")
BASE64 = lambda s, d: s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.lit('{"a":{"type":"base64","data":"AAAA"},"b":"data:image/png;base64,AA","c":"kept"}').alias("body"))
add("t9_path_segments", lambda s, d: json_rows(s, d).select("c_custkey", F.array_join(tx.path_segments(F.concat(F.lit("a["), (F.col("c_custkey") % 7).cast("string"), F.lit("].b.c"))), "/").alias("segments")), "SELECT c_custkey, 'a/' || (c_custkey % 7) || '/b/c' AS segments FROM customer")
add("d55_json_scan", lambda s, d: spans.scan(jsonwalk.leaves(json_rows(s, d), "c_custkey", "body").select(F.col("c_custkey").alias("doc_id"), F.col("value").alias("text")), [dims.BASE[1], dims.BASE[3]]).select("doc_id", "value", "type"),
    f"SELECT c_custkey AS doc_id, CASE WHEN x.p LIKE '%ssn' THEN x.v ELSE substr(x.v, 6) END AS value, CASE WHEN x.p LIKE '%ssn' THEN 'ssn' ELSE 'email' END AS type FROM ({LEAVES}) WHERE x.p LIKE '%ssn' OR x.p LIKE '%[0].content'")
add("d56_json_scan_flat", lambda s, d: spans.scan(jsonwalk.leaves(json_rows(s, d), "c_custkey", "body", nested=0).select(F.col("c_custkey").alias("doc_id"), F.col("value").alias("text")), [dims.BASE[1], dims.BASE[3]]).select("doc_id", "value", "type"),
    f"SELECT c_custkey AS doc_id, CASE WHEN x.p LIKE '%ssn' THEN x.v ELSE substr(x.v, 6) END AS value, CASE WHEN x.p LIKE '%ssn' THEN 'ssn' ELSE 'email' END AS type FROM ({LEAVES}) WHERE x.p LIKE '%ssn' OR x.p LIKE '%[0].content'")
BLOCKS = ['{"type":"image","source":{"type":"base64","media_type":"image/png","data":"AA"}}', '{"type":"image_url","image_url":{"url":"https://x.example/a.png"}}', '{"type":"input_audio","input_audio":{"data":"AA","format":"wav"}}', '{"type":"text","text":"hi"}']


# --- encoding and restoring
def base_spans(s, d):
    found = spans.greedy(spans.scan(cp.corpus(s, d), dims.BASE).drop("pattern"))
    return found.withColumn("request_id", F.expr(REQUEST))


def request_docs(s, d):
    return cp.corpus(s, d).withColumn("request_id", F.expr(REQUEST))


GREEDY = f"({GREEDY_SQL})"
add("p1_ff1_round_trip", lambda s, d: _round_trip(s, d), f'SELECT doc_id, "start", type, value AS plain, true AS same_shape FROM {GREEDY}')


def _round_trip(s, d):
    coded = encode.encoded(base_spans(s, d), SAMPLE_KEY).where("route = 'cipher'")
    plain = encode.sealed(F.col("replacement"), F.col("type"), crypto.tweak(F.col("request_id"), F.col("place")), SAMPLE_KEY, decrypt=True)
    shape = lambda c: F.regexp_replace(F.regexp_replace(c, "[0-9a-zA-Z]", "x"), "x", "x")
    return coded.select("doc_id", "start", "type", plain.alias("plain"), (shape(F.col("value")) == shape(F.col("replacement"))).alias("same_shape"))


TWEAK = f"lower(hex(unhex('00112233445566778899aabbccddeeff'))) || substr(sha256('m:' || \"start\"), 1, 32)"
add("p4_tweaks", lambda s, d: base_spans(s, d).select("doc_id", "start", F.lower(F.hex(crypto.tweak(F.col("request_id"), F.concat(F.lit("m:"), F.col("start").cast("string"))))).alias("tweak")),
    f"SELECT doc_id, \"start\", '00112233445566778899aabbccddeeff' || substr(sha256('m:' || \"start\"), 1, 32) AS tweak FROM {GREEDY}")
add("p5_encryptable_parts", lambda s, d: _parts(s, d),
    f"SELECT doc_id, \"start\", CASE WHEN type = 'email' THEN split_part(lower(value), '@', 1) WHEN type IN ('ipv6_address', 'mac_address') THEN lower(value) ELSE value END AS middle, CASE WHEN type = 'email' THEN '@' || split_part(lower(value), '@', 2) ELSE '' END AS after FROM {GREEDY}")


def _parts(s, d):
    before, middle, after = encode.parts(F.col("value"), F.col("type"))
    return base_spans(s, d).select("doc_id", "start", middle.alias("middle"), after.alias("after"))


named = lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.col("c_name").alias("value"), F.expr(REQUEST).alias("request_id"))
HASH = "('0x' || substr(sha256(unhex('00112233445566778899aabbccddeeff') || encode(c_name)), 1, 8))::BIGINT % 1679616"
TOKEN = f"'PER_' || substr('{crypto.BASE36}', CAST(h // 46656 AS INT) + 1, 1) || substr('{crypto.BASE36}', CAST(h // 1296 % 36 AS INT) + 1, 1) || substr('{crypto.BASE36}', CAST(h // 36 % 36 AS INT) + 1, 1) || substr('{crypto.BASE36}', CAST(h % 36 AS INT) + 1, 1)"
add("p8_hash_tokens", lambda s, d: named(s, d).select("c_custkey", crypto.token(F.lit("PER"), F.col("request_id"), F.col("value")).alias("token")), f"SELECT c_custkey, {TOKEN} AS token FROM (SELECT c_custkey, {HASH} AS h FROM customer)")
crowded = lambda s, d: s.read.parquet(f"{d}/customer.parquet").select(F.lit("r").alias("request_id"), F.concat(F.lit("PER_"), (F.col("c_custkey") % 100).cast("string")).alias("base"), F.col("c_name").alias("value"), F.col("c_custkey").alias("seen"))
add("p9_token_collisions", lambda s, d: encode.collisions_resolved(crowded(s, d)).select("base", "value", "token"),
    f"SELECT base, value, CASE WHEN k = 1 THEN base WHEN k <= 26 THEN base || chr(CAST(k + 96 AS INT)) ELSE base || '_' || {TOKEN.removeprefix("'PER_' || ")} END AS token FROM (SELECT *, ('0x' || substr(sha256(base || value), 1, 8))::BIGINT % 1679616 AS h FROM (SELECT 'PER_' || (c_custkey % 100) AS base, c_name AS value, row_number() OVER (PARTITION BY c_custkey % 100 ORDER BY c_custkey, c_name) AS k FROM customer))")
add("p10_token_dedup", lambda s, d: named(s, d).unionByName(named(s, d)).select("request_id", "value", crypto.token(F.lit("PER"), F.col("request_id"), F.col("value")).alias("token")).distinct().groupBy("request_id").agg(F.count(F.lit(1)).alias("n")), f"SELECT {REQUEST} AS request_id, count(DISTINCT c_name) AS n FROM customer")
short = lambda s, d: s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("doc_id"), F.lit(0).alias("start"), F.lit(5).alias("end"), F.lit("ab@x.example").alias("value"), F.lit("email").alias("type"), F.expr(REQUEST).alias("request_id"))


def _said(s, d):
    rows = s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.lit("person").alias("type"), F.lit("Anna Smith").alias("value"))
    return rows.withColumn("replacement", F.concat(F.lit("PER_"), F.col("turn").cast("string")))




def _sanitize_restore(s, d):
    docs = request_docs(s, d)
    safe, mapping = encode.sanitized(docs, base_spans(s, d), SAMPLE_KEY)
    return encode.restored(safe.select("doc_id", "text"), mapping)


add("p16_sanitize_restore", _sanitize_restore, cp.corpus_sql())
add("x5_restore_text", _sanitize_restore, cp.corpus_sql())
add("x9_longest_cipher", lambda s, d: encode.sanitized(request_docs(s, d), base_spans(s, d), SAMPLE_KEY)[1].groupBy("doc_id").agg(F.max(F.length("ciphertext")).alias("longest")), f"SELECT doc_id, max(length(value)) AS longest FROM {GREEDY} GROUP BY doc_id")
maps = lambda s, d: s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), F.lit("415-555-2671").alias("ciphertext"), F.concat(F.lit("$1\\"), F.col("c_name")).alias("plaintext"), F.lit("phone").alias("type"))
add("x2_markdown_unescaped", lambda s, d: s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", tx.unescaped(F.concat(F.lit("PER\\_"), F.col("n_name"))).alias("t")), "SELECT n_nationkey, 'PER_' || n_name AS t FROM nation")
ttl, TTL = made(["c_custkey AS id", "CAST(c_custkey * 10 AS BIGINT) AS created_at"])
add("x6_ttl", lambda s, d: ops.live(ttl(s, d), now=9000, ttl_s=3000), f"SELECT * FROM ({TTL}) WHERE created_at + 3000 > 9000")
add("x7_ndjson_collapse", lambda s, d: sse.collapsed(s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.concat(F.lit('{"model":"m","message":{"content":"a"}}\n{"model":"m","message":{"content":"'), F.col("c_name"), F.lit('"}}\n')).alias("body"))), "SELECT c_custkey AS id, 'a' || c_name AS text, CAST(2 AS BIGINT) AS lines FROM customer")
uses, USES = made(["c_custkey AS use_id", "CAST(c_custkey AS BIGINT) AS at"])
add("p21_key_versions", lambda s, d: ops.key_at(uses(s, d), s.createDataFrame([(1, 0), (2, 500), (3, 1000)], "version int, since long")),
    f"SELECT use_id, \"at\", CASE WHEN \"at\" >= 1000 THEN 3 WHEN \"at\" >= 500 THEN 2 ELSE 1 END AS version, CASE WHEN \"at\" >= 1000 AND \"at\" < 1030 THEN 2 WHEN \"at\" >= 500 AND \"at\" < 530 THEN 1 END AS with_old FROM ({USES})")

# --- responses
REPLIES = ['{"content":[{"type":"text","text":"Hi"},{"type":"text","text":"you"}]}', '{"choices":[{"message":{"content":"Hi"}}]}', '{"candidates":[{"content":{"parts":[{"text":"Hi"}]}}]}', '{"generations":[{"text":"Hi"}]}', '{"model":"m","message":{"content":"Hi"}}', '{"x":1}', "plain words"]
KINDS = ["anthropic", "openai", "gemini", "cohere", "ollama", "unknown_json", "plain_text"]
SAYS = ["Hi you", "Hi", "Hi", "Hi", "Hi", None, "plain words"]
replies = lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.element_at(F.array(*map(F.lit, REPLIES)), (F.col("c_custkey") % 7 + 1).cast("int")).alias("body"), F.when(F.col("c_custkey") % 7 < 6, "application/json").alias("ct"))
sql_list = lambda xs: "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in xs) + "]"
add("j1_response_format", lambda s, d: replies(s, d).select("c_custkey", formats.response_format(F.col("ct"), F.col("body")).alias("kind")), f"SELECT c_custkey, {sql_list(KINDS)}[c_custkey % 7 + 1] AS kind FROM customer")
add("j2_response_text", lambda s, d: replies(s, d).withColumn("kind", formats.response_format(F.col("ct"), F.col("body"))).select("c_custkey", formats.response_text(F.col("kind"), F.col("body")).alias("text")), f"SELECT c_custkey, {sql_list(SAYS)}[c_custkey % 7 + 1] AS text FROM customer")
WARNED = ["! Hi you", "! Hi", "! Hi", "! Hi", "! Hi", None, "! plain words"]
add("j3_warning_injection", lambda s, d: replies(s, d).withColumn("kind", formats.response_format(F.col("ct"), F.col("body"))).select("c_custkey", formats.response_text(F.col("kind"), formats.with_warning(F.col("kind"), F.col("body"), F.lit("! "))).alias("text")), f"SELECT c_custkey, {sql_list(WARNED)}[c_custkey % 7 + 1] AS text FROM customer")
add("c9_min_flags", lambda s, d: respond.assessed(cp.corpus(s, d, cp.SAID)).where("shown").select("doc_id", "n_flags"), f"SELECT doc_id, count(*) AS n_flags FROM ({phrases_sql(dims.PERSUASION, 1.0, 'p')}) GROUP BY doc_id HAVING count(*) >= 3")
FLAGS = f"f AS (SELECT doc_id, count(*) AS n, list_sort(list_distinct(list(type))) AS c FROM ({phrases_sql(dims.PERSUASION, 1.0, 'p')}) GROUP BY doc_id)"
SEVERITY = "CASE WHEN len(c) >= 4 OR (list_contains(c, 'Commercial') AND (list_contains(c, 'Fear') OR list_contains(c, 'Urgency'))) THEN 'Caution' WHEN len(c) >= 2 OR n >= 3 THEN 'Warning' ELSE 'Notice' END"
add("c3_severity", lambda s, d: respond.assessed(cp.corpus(s, d, cp.SAID)).where("severity IS NOT NULL").select("doc_id", "n_flags", "severity"), f"WITH {FLAGS} SELECT doc_id, n AS n_flags, {SEVERITY} AS severity FROM f")
add("c4_sensitivity", lambda s, d: respond.assessed(cp.corpus(s, d, cp.SAID), level="low", least_flags=1).where("shown").select("doc_id", "severity"), f"WITH {FLAGS} SELECT doc_id, severity FROM (SELECT doc_id, {SEVERITY} AS severity FROM f) WHERE severity <> 'Notice'")
add("c10_labels", lambda s, d: respond.assessed(cp.corpus(s, d, cp.SAID), least_flags=1).where("shown").select("doc_id", F.element_at(F.split("label", "\n"), 2).alias("line")), f"WITH {FLAGS} SELECT doc_id, 'Detected: ' || array_to_string(c, ' • ') AS line FROM f")
add("c2_dictionaries", lambda s, d: respond.phrases(s).groupBy("type").agg(F.count(F.lit(1)).alias("n")), "SELECT * FROM (VALUES ('Urgency', 38), ('Scarcity', 28), ('Social Proof', 35), ('Fear', 35), ('Authority', 35), ('Commercial', 47), ('Flattery', 30)) v(type, n)")
roles, ROLES = made(["c_custkey AS id", "c_custkey % 2 = 0 AS flagged", "c_custkey % 3 = 0 AS second"])
add("c8_roles", lambda s, d: roles(s, d).select("id", respond.role(F.col("flagged"), F.when(F.col("second"), F.array(F.lit("x"))).otherwise(F.expr("CAST(array() AS array<string>)"))).alias("role")), f"SELECT id, CASE WHEN flagged AND second THEN 'upgrade' WHEN flagged THEN 'suppress' WHEN second THEN 'discover' ELSE 'clean' END AS role FROM ({ROLES})")
scores, SCORES = made(["vec_id", "CAST(embedding[0] AS DOUBLE) AS a", "CAST(embedding[1] AS DOUBLE) AS b"], "embeddings")
SCORES = SCORES.replace("embedding[0]", "embedding[1]#").replace("embedding[1] AS", "embedding[2] AS").replace("embedding[1]#", "embedding[1]")

# --- streams, as finished tables
chunks = lambda s, d: s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("stream_id"), F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("seq"), c.alias("chunk")) for i, c in enumerate([F.lit('data: {"choices":[{"delta":{"content":"He'), F.concat(F.lit('llo "}}]}\n\ndata: {"choices":[{"delta":{"content":"'), F.col("c_name"), F.lit('"}}]}\n')), F.lit("\ndata: [DONE]\n\n")])))).alias("c")).select("stream_id", "c.seq", "c.chunk")
add("z3_stream_contents", lambda s, d: sse.contents(chunks(s, d)), "SELECT CAST(c_custkey AS VARCHAR) AS stream_id, 'openai' AS format, 'Hello ' || c_name AS text, true AS done FROM customer")
DELTAS = ['{"delta":{"text":"x"}}', '{"choices":[{"delta":{"content":"x"}}]}', '{"candidates":[{"content":{"parts":[{"text":"x"}]}}]}', '{"text":"x"}', '{"content":"x"}']
deltas = lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.element_at(F.array(*map(F.lit, DELTAS)), (F.col("c_custkey") % 5 + 1).cast("int")).alias("data"))
add("z2_delta_extraction", lambda s, d: deltas(s, d).select("c_custkey", formats.stream_delta(F.col("data"))[0].alias("format"), formats.stream_delta(F.col("data"))[1].alias("text")), "SELECT c_custkey, ['anthropic', 'openai', 'gemini', 'generic', 'generic'][c_custkey % 5 + 1] AS format, 'x' AS text FROM customer")
add("z6_delta_events", lambda s, d: deltas(s, d).select("c_custkey", formats.stream_delta(F.regexp_extract(formats.delta_event(formats.stream_delta(F.col("data"))[0], F.lit("y")), "^data: (.*)", 1))[1].alias("text")), "SELECT c_custkey, 'y' AS text FROM customer")

# --- monitoring
samples, SAMPLES = made(["event_type AS metric", "CAST(abs(floor(value * 1000)) AS BIGINT) AS us"], "events")
BOUND = "CASE " + " ".join(f"WHEN us <= {b} THEN {b}" for b in dims.LATENCY_BOUNDS) + f" ELSE {dims.LATENCY_BOUNDS[-1]} END"
add("a4_latency", lambda s, d: ops.latency(samples(s, d)),
    f"WITH b AS (SELECT metric, us, {BOUND} AS bound, row_number() OVER (PARTITION BY metric ORDER BY us) AS i, count(*) OVER (PARTITION BY metric) AS n FROM ({SAMPLES})) SELECT metric, count(*) AS n, CAST(floor(sum(us) / count(*)) AS BIGINT) AS mean_us, "
    + ", ".join(f"CAST(min(bound) FILTER (i >= ceil(n * {p})) AS BIGINT) AS p{int(p * 100)}" for p in (0.5, 0.95, 0.99)) + " FROM b GROUP BY metric")
lines, LINES = made(["'J|' || CAST(c_custkey % 900 AS STRING) || '|' || CAST(c_custkey AS STRING) || '|3|' || CASE WHEN c_custkey > 900 THEN '1' ELSE '0' END AS line"])
add("a5_unfinished", lambda s, d: ops.unfinished(lines(s, d)), 'SELECT CAST(c_custkey % 900 AS VARCHAR) AS id, CAST(min(c_custkey) AS BIGINT) AS "at", 3 AS n FROM customer WHERE c_custkey <= 900 AND c_custkey % 900 NOT IN (SELECT c_custkey % 900 FROM customer WHERE c_custkey > 900) GROUP BY c_custkey % 900')
ram, RAM = made(["c_custkey AS id", "c_custkey * 4 AS mb"])
add("a6_tiers", lambda s, d: ram(s, d).select("id", ops.tier(F.col("mb")).alias("tier"), ops.embedded_budget(F.col("mb")).alias("budget")), f"SELECT id, CASE WHEN mb >= 3584 THEN 'full' WHEN mb >= 1536 THEN 'standard' ELSE 'lite' END AS tier, greatest(12, least(275, CAST(floor(mb / 5) AS INT))) AS budget FROM ({RAM})")
beats, BEATS = made(["c_custkey % 10 AS client", "c_custkey AS at", "c_custkey % 7 <> 0 AS ok", "c_custkey % 11 = 0 AS passthrough"])
BEAT_STATES = f"SELECT *, CASE WHEN NOT ok THEN 'degraded' WHEN passthrough THEN 'passthrough' ELSE 'active' END AS state FROM ({BEATS})"
add("a7_heartbeat", lambda s, d: ops.heartbeat(beats(s, d)).select("client", "at", "state", F.array_join("passed", ">").alias("passed")),
    f"SELECT client, \"at\", state, CASE WHEN state = b THEN '' WHEN state = 'active' THEN 'recovering>active' ELSE state END AS passed FROM (SELECT *, coalesce(lag(state) OVER (PARTITION BY client ORDER BY \"at\"), 'active') AS b FROM ({BEAT_STATES}))")
add("a9_model_percentiles", lambda s, d: samples(s, d).groupBy("metric").agg(F.round(F.percentile("us", 0.5), 3).alias("p50"), F.round(F.percentile("us", 0.95), 3).alias("p95"), F.round(F.avg("us"), 3).alias("mean"), F.round(F.stddev("us"), 3).alias("sd")), f"SELECT metric, round(quantile_cont(us, 0.5), 3) AS p50, round(quantile_cont(us, 0.95), 3) AS p95, round(avg(us), 3) AS mean, round(stddev(us), 3) AS sd FROM ({SAMPLES}) GROUP BY metric")

# --- datasets
add("e1_label_normalisation", lambda s, d: dataset.normalised_labels(s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.col("c_mktsegment").alias("label")), s.createDataFrame([("BUILDING", "construction")], "synonym string, label string")), "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'construction' ELSE replace(lower(c_mktsegment), ' ', '_') END AS label FROM customer")
add("e2_exact_dedup", lambda s, d: dataset.first_of_each(cp.documents(s, d).select("doc_id", "text"), "text", "doc_id").select("doc_id"), "SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(regexp_replace(trim(text), '\\s+', ' ', 'g'))")
near, NEAR = made(["c_custkey AS id", "c_mktsegment AS label", "substr(c_name, 1, 17) || CAST(c_custkey % 10 AS STRING) AS text", "CAST(c_custkey % 50 AS INT) AS grp"])
add("e5_entry_types", lambda s, d: cp.documents(s, d).select("doc_id", dataset.entry_type(F.col("text"), F.when(F.col("doc_id") % 2 == 0, "fear")).alias("kind")), "SELECT doc_id, CASE WHEN len(string_split_regex(regexp_replace(text, '^ +| +$', '', 'g'), '\\s+')) <= 8 THEN 'phrase' ELSE 'para' END || '_' || CASE WHEN doc_id % 2 = 0 THEN 'manip' ELSE 'benign' END AS kind FROM documents")
add("e6_multi_hot", lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.array_join(dataset.multi_hot(F.array("c_mktsegment"), ["BUILDING", "MACHINERY"]), "").alias("hot")), "SELECT c_custkey, CAST(CAST(c_mktsegment = 'BUILDING' AS INT) AS VARCHAR) || CAST(CAST(c_mktsegment = 'MACHINERY' AS INT) AS VARCHAR) AS hot FROM customer")
add("e7_stratified_split", lambda s, d: dataset.split(s.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id", F.col("toxic")),
    "WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id || '/42'), doc_id) - 1 AS i, count(*) OVER (PARTITION BY toxic) AS n FROM labels) SELECT doc_id, toxic, CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.7) + floor(n * 0.15) THEN 'validation' ELSE 'test' END AS part FROM r")
tagged = lambda s, d: s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.array(*map(F.lit, ["a", "b", "c", "d"])).alias("tokens"), F.when(F.col("c_custkey") % 2 == 0, F.array(*map(F.lit, ["B-PER", "I-PER", "O", "I-LOC"]))).otherwise(F.array(*map(F.lit, ["O", "B-LOC", "B-LOC", "I-LOC"]))).alias("tags"))
add("v17_bio_errors", lambda s, d: dataset.bio_errors(tagged(s, d)), "SELECT c_custkey AS id, 3 AS i, 'I-LOC' AS tag FROM customer WHERE c_custkey % 2 = 0")
add("d50_bio_decode", lambda s, d: dataset.entities(tagged(s, d)),
    "SELECT c_custkey AS id, 0 AS first, 1 AS last, 'PER' AS entity, 'a b' AS words FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 3, 3, 'LOC', 'd' FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 1, 1, 'LOC', 'b' FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT c_custkey, 2, 3, 'LOC', 'c d' FROM customer WHERE c_custkey % 2 = 1")
add("e9_entity_distribution", lambda s, d: dataset.entities(tagged(s, d)).groupBy("entity").agg(F.count(F.lit(1)).alias("n")), "SELECT 'PER' AS entity, count(*) FILTER (c_custkey % 2 = 0) AS n FROM customer UNION ALL SELECT 'LOC', count(*) + count(*) FILTER (c_custkey % 2 = 1) FROM customer")
judged = lambda s, d: s.read.parquet(f"{d}/customer.parquet").select(F.array((F.col("c_custkey") % 2).cast("int"), (F.col("c_custkey") % 3 == 0).cast("int")).alias("truth"), F.array((F.col("c_custkey") % 4 == 1).cast("int"), (F.col("c_custkey") % 5 == 0).cast("int")).alias("guess"))
PRF = lambda n, t, g: f"SELECT '{n}' AS label, count(*) FILTER ({t} AND {g}) AS tp, count(*) FILTER (NOT {t} AND {g}) AS fp, count(*) FILTER ({t} AND NOT {g}) AS fn FROM customer"
add("e10_label_scores", lambda s, d: dataset.label_scores(judged(s, d), ["a", "b"]), f"SELECT *, tp + fn AS support, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM ({PRF('a', '(c_custkey % 2 = 1)', '(c_custkey % 4 = 1)')} UNION ALL {PRF('b', '(c_custkey % 3 = 0)', '(c_custkey % 5 = 0)')})")
PARA = "WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS t FROM documents) SELECT count(*) FILTER (length(t) >= 30) AS n FROM p"
add("t14_paragraphs", lambda s, d: dataset.paragraphs(cp.documents(s, d)).agg(F.count(F.lit(1)).alias("n")), PARA)

# --- media decisions
boxes, BOXES = made(["c_custkey % 100 AS image_id", "c_custkey AS box_id", "CAST(c_custkey % 7 * 3 AS DOUBLE) AS x_min", "CAST(c_custkey % 5 * 4 AS DOUBLE) AS y_min", "CAST(c_custkey % 7 * 3 + 20 + c_custkey % 3 AS DOUBLE) AS x_max", "CAST(c_custkey % 5 * 4 + 18 AS DOUBLE) AS y_max", "CAST(c_custkey % 13 AS DOUBLE) / 13 AS confidence", "40 AS img_width", "30 AS img_height"])
IOU = lambda a, b: f"(greatest(0, least({a}.x_max, {b}.x_max) - greatest({a}.x_min, {b}.x_min)) * greatest(0, least({a}.y_max, {b}.y_max) - greatest({a}.y_min, {b}.y_min)))"
AREA = lambda a: f"(({a}.x_max - {a}.x_min) * ({a}.y_max - {a}.y_min))"
RATIO = lambda a, b: f"({IOU(a, b)} / ({AREA(a)} + {AREA(b)} - {IOU(a, b)}))"
NMS = f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, box_id) AS i FROM ({BOXES})),
k AS (SELECT image_id, i, [struct_pack(box_id := box_id, confidence := confidence, x_min := x_min, y_min := y_min, x_max := x_max, y_max := y_max)] AS kept FROM r WHERE i = 1
 UNION ALL SELECT r.image_id, r.i, CASE WHEN len(list_filter(k.kept, lambda z: {RATIO('z', 'r')} > 0.5)) > 0 THEN k.kept ELSE list_append(k.kept, struct_pack(box_id := r.box_id, confidence := r.confidence, x_min := r.x_min, y_min := r.y_min, x_max := r.x_max, y_max := r.y_max)) END FROM k JOIN r ON r.image_id = k.image_id AND r.i = k.i + 1),
m AS (SELECT image_id, unnest(max_by(kept, i)) AS b FROM k GROUP BY image_id) SELECT image_id, b.box_id AS box_id, b.confidence AS confidence FROM m"""
add("r8_non_maximum", lambda s, d: spans.non_maximum(boxes(s, d)), NMS)
add("r10_expanded_boxes", lambda s, d: boxes(s, d).select("box_id", media.expanded(F.struct("x_min", "y_min", "x_max", "y_max"), F.col("img_width"), F.col("img_height")).alias("b")).select("box_id", "b.*"),
    f"SELECT box_id, CAST(floor(greatest(x_min - (x_max - x_min) * CAST(0.15 AS DOUBLE), 0)) AS INT) AS x0, CAST(floor(greatest(y_min - (y_max - y_min) * CAST(0.15 AS DOUBLE), 0)) AS INT) AS y0, CAST(least(ceil(x_max + (x_max - x_min) * CAST(0.15 AS DOUBLE)), img_width) AS INT) AS x1, CAST(least(ceil(y_max + (y_max - y_min) * CAST(0.15 AS DOUBLE)), img_height) AS INT) AS y1 FROM ({BOXES})")
add("m5_face_fill", lambda s, d: boxes(s, d).select("box_id", media.face_fill(F.struct("x_min", "y_min", "x_max", "y_max"), F.lit(22), F.lit(20)).alias("fill")), f"SELECT box_id, CASE WHEN (x_max - x_min) * (y_max - y_min) > 0.8 * 440 THEN 'all' ELSE 'ellipse' END AS fill FROM ({BOXES})")
add("m12_box_issues", lambda s, d: media.box_issues(boxes(s, d)).groupBy("check", "severity").agg(F.count(F.lit(1)).alias("n")),
    f"SELECT 'within_bounds' AS \"check\", 'error' AS severity, count(*) FILTER (x_max > img_width) + count(*) FILTER (y_max > img_height) AS n FROM ({BOXES}) UNION ALL SELECT 'confidence_range', 'error', count(*) FILTER (confidence <= 0 OR confidence > 1) FROM ({BOXES})")
IOU = "greatest(0, least(f.x_max, t.x_max) - greatest(f.x_min, t.x_min)) * greatest(0, least(f.y_max, t.y_max) - greatest(f.y_min, t.y_min))"
AREA = lambda x: f"({x}.x_max - {x}.x_min) * ({x}.y_max - {x}.y_min)"
E12 = f"""WITH RECURSIVE b AS ({BOXES}), p AS (SELECT f.image_id, f.box_id, t.box_id AS t, {IOU} AS i, {AREA('f')} + {AREA('t')} AS area FROM b f JOIN b t ON f.image_id = t.image_id AND f.box_id % 2 = 0 AND t.box_id % 2 = 1),
c AS (SELECT image_id, box_id, list(t ORDER BY i / (area - i) DESC, t) AS fits FROM p WHERE i / (area - i) >= 0.5 GROUP BY ALL),
f AS (SELECT b.image_id, coalesce(c.fits, []) AS fits, row_number() OVER (PARTITION BY b.image_id ORDER BY b.box_id) AS k FROM b LEFT JOIN c ON c.image_id = b.image_id AND c.box_id = b.box_id WHERE b.box_id % 2 = 0),
g AS (SELECT DISTINCT image_id, 0::BIGINT AS k, CAST([] AS BIGINT[]) AS taken FROM b UNION ALL
  SELECT g.image_id, f.k, CASE WHEN len(list_filter(f.fits, lambda x: NOT list_contains(g.taken, x))) > 0 THEN list_append(g.taken, list_filter(f.fits, lambda x: NOT list_contains(g.taken, x))[1]) ELSE g.taken END FROM g JOIN f ON f.image_id = g.image_id AND f.k = g.k + 1),
h AS (SELECT image_id, max(len(taken)) AS tp FROM g GROUP BY ALL), n AS (SELECT image_id, count(*) FILTER (box_id % 2 = 0) AS found, count(*) FILTER (box_id % 2 = 1) AS truth FROM b GROUP BY ALL)
SELECT n.image_id, tp, found, truth, round(CASE WHEN found > 0 THEN tp / found ELSE 0 END, 6) AS precision, round(CASE WHEN truth > 0 THEN tp / truth ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * tp / (found + truth) ELSE 0 END, 6) AS f1 FROM n JOIN h ON n.image_id = h.image_id"""
add("e12_box_scores", lambda s, d: dataset.box_scores(boxes(s, d).where("box_id % 2 = 0"), boxes(s, d).where("box_id % 2 = 1")), E12)
sizes, SIZES = made(["c_custkey AS id", "CASE WHEN c_custkey % 3 = 0 THEN 1920 ELSE CAST(c_custkey AS INT) END AS w", "CASE WHEN c_custkey % 3 = 0 THEN 1080 ELSE 900 END AS h", "CASE WHEN c_custkey % 5 = 0 THEN 'ShareX 1' WHEN c_custkey % 5 = 1 THEN 'Editor' END AS software", "CASE WHEN c_custkey % 2 = 0 THEN 'Cam' END AS camera"])
PAIRS = ", ".join(f"({a}, {b})" for a, b in dims.SCREENS)
add("m2_screenshots", lambda s, d: sizes(s, d).select("id", media.screenshot(F.col("software"), F.col("camera"), F.col("w"), F.col("h"), F.lit(None).cast("double"), ["sharex", "screenshot"]).alias("shot")),
    f"SELECT id, coalesce(lower(software) LIKE '%sharex%', false) OR CAST((w, h) IN ({PAIRS}) AS INT) + CAST(software IS NOT NULL AND camera IS NULL AS INT) >= 2 AS shot FROM ({SIZES})")
add("o6_ocr_input", lambda s, d: sizes(s, d).select("id", media.ocr_input(F.col("w"), F.col("h")).alias("o")).select("id", "o.*"),
    f"SELECT id, greatest(32, CAST(round(w * least(1.0::DOUBLE, 960::DOUBLE / greatest(w, h)) / 32) * 32 AS INT)) AS width, greatest(32, CAST(round(h * least(1.0::DOUBLE, 960::DOUBLE / greatest(w, h)) / 32) * 32 AS INT)) AS height FROM ({SIZES})")
add("m3_nsfw", lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", media.nsfw(F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double") * 20))[1].alias("flagged")),
    "WITH e AS (SELECT vec_id, list_transform(embedding[1:5], lambda x: exp(CAST(x AS DOUBLE) * 20)) AS p FROM embeddings), q AS (SELECT vec_id, list_transform(p, lambda x: x / list_sum(p)) AS p FROM e) SELECT vec_id, p[4] + p[5] + CASE WHEN p[1] >= 0.1 THEN p[2] ELSE 0 END >= 0.8 AS flagged FROM q")
frames = lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.array(*(F.struct(F.lit(b).alias("best"), F.lit(0.5).alias("p")) for b in (1, 1, 0, 1, 2, 2, 0))).alias("f"))
add("m8_ctc_decode", lambda s, d: frames(s, d).select("c_custkey", media.ctc(F.col("f"), 3, F.array(F.lit("a"), F.lit("b"))).alias("x")).select("c_custkey", "x.*"), "SELECT c_custkey, 'aab' AS text, CAST(0.5 AS DOUBLE) AS confidence FROM customer")
CRF = (["O", "B-PER", "I-PER"], {"isalpha": [0.2, 0.0, 0.0], "word=anna": [0.0, 2.0, 0.0], "word=smith": [0.0, 0.0, 2.0]}, [[0.5, 0.0, -5.0], [0.0, -1.0, 1.0], [0.0, -1.0, -0.5]])
add("d47_crf", lambda s, d: crf.scan(cp.corpus(s, d, cp.SAID), *CRF).select("doc_id", "value", "type"), "SELECT CAST(c_custkey AS BIGINT) AS doc_id, 'Anna Smith' AS value, 'person' AS type FROM customer WHERE c_custkey % 4 <> 0".replace("'person'", "'per'"))
# --- reports over the events, beyond the inventory
add("x_rollup_report", lambda s, d: cp.documents(s, d).rollup("lang", "source").agg(F.count(F.lit(1)).alias("n")), "SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
