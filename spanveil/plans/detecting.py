"""Queries of validators, patterns and span algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import validators as va
from ..operators import dims, hybrid, spans
from ..sources.io import Config
from . import corpus as cp

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


# --- validators: the same rule, once as the library's expression and once as plain SQL over digits

D = lambda i: f"CAST(substr(value, {i}, 1) AS INT)"
W = lambda ws, at=1: "(" + " + ".join(f"{D(i + at)} * {w}" for i, w in enumerate(ws)) + ")"
TAIL = [9, 8, 7, 6, 5, 4, 3, 2]
CPF1, CPF2 = f"{W(range(10, 1, -1))} * 10 % 11 % 10", f"{W(range(11, 1, -1))} * 10 % 11 % 10"
CNPJ = lambda ws: f"(CASE WHEN {W(ws)} % 11 < 2 THEN 0 ELSE 11 - {W(ws)} % 11 END)"
DNI = "TRWAGMYFPDXBNJZSQVHLCKE"
LUHN16 = "(" + " + ".join((f"(CASE WHEN {D(i)} < 5 THEN {D(i)} * 2 ELSE {D(i)} * 2 - 9 END)" if i % 2 else D(i)) for i in range(1, 17)) + ") % 10 = 0"
N = cp.NUMBERS
LETTER = f"substr('{DNI}', CAST(o_orderkey * 13 % 23 AS INT) + 1, 1)"
RULES = {
    "v1_luhn": (f"{N[8]} || {cp.num(8, 3, 'o_orderkey')}", va.luhn, LUHN16),
    "v2_ssn": (f"{N[9]}", va.ssn, "substr(value, 1, 3) NOT IN ('000', '666') AND CAST(substr(value, 1, 3) AS INT) < 900 AND substr(value, 4, 2) <> '00' AND substr(value, 6, 4) <> '0000'"),
    "v3_ipv4": ("CAST(o_orderkey % 256 AS STRING) || '.' || CAST(o_orderkey * 3 % 256 AS STRING) || '.' || CAST(o_orderkey * 5 % 256 AS STRING) || '.7'", va.ipv4, "split_part(value, '.', 1) NOT IN ('0', '127') AND NOT starts_with(value, '169.254.') AND value <> '255.255.255.255'"),
    "v4_saudi_id": (N[10], va.saudi_id, "substr(value, 1, 1) IN ('1', '2')"),
    "v4_emirates_id": (f"CASE WHEN o_orderkey % 2 = 0 THEN '784' ELSE '783' END || {N[12]}", va.emirates_id, "starts_with(value, '784')"),
    "v5_german_tax_id": (N[11], va.german_tax_id, "substr(value, 1, 1) <> '0' AND list_max(list_transform(range(10), lambda k: length(substr(value, 1, 10)) - length(replace(substr(value, 1, 10), CAST(k AS VARCHAR), '')))) BETWEEN 2 AND 3"),
    "v6_dni": (f"{N[8]} || {LETTER}", va.dni, f"substr('{DNI}', CAST(CAST(substr(value, 1, 8) AS BIGINT) % 23 AS INT) + 1, 1) = substr(value, 9, 1)"),
    "v6_nie": (f"substr('XYZ', CAST(o_orderkey % 3 AS INT) + 1, 1) || substr({N[8]}, 1, 7) || {LETTER}", va.nie, f"substr('{DNI}', CAST(CAST(translate(substr(value, 1, 1), 'XYZ', '012') || substr(value, 2, 7) AS BIGINT) % 23 AS INT) + 1, 1) = substr(value, 9, 1)"),
    "v7_iban_es": (f"'ES' || substr({N[8]}, 1, 2) || {N[8]} || {N[12]}", lambda v: va.iban(v, "ES", 24), "CAST(substr(value, 5, 20) || '1428' || substr(value, 3, 2) AS HUGEINT) % 97 = 1"),
    "v7_iban_de": (f"'DE' || substr({N[8]}, 1, 2) || {N[8]} || {N[10]}", lambda v: va.iban(v, "DE", 22), "CAST(substr(value, 5, 18) || '1314' || substr(value, 3, 2) AS HUGEINT) % 97 = 1"),
    "v7_iban_fr": (f"'FR' || substr({N[8]}, 1, 2) || {N[8]} || {N[15]}", lambda v: va.iban(v, "FR", 27), "CAST(substr(value, 5, 23) || '1527' || substr(value, 3, 2) AS HUGEINT) % 97 = 1"),
    "v8_nir": (N[15], va.nir, "97 - CAST(substr(value, 1, 13) AS BIGINT) % 97 = CAST(substr(value, 14, 2) AS INT)"),
    "v9_my_number": (N[12], va.my_number, f"(CASE WHEN {W([6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2])} % 11 <= 1 THEN 0 ELSE 11 - {W([6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2])} % 11 END) = {D(12)}"),
    "v10_rrn": (N[13], va.rrn, f"(11 - {W([2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5])} % 11) % 10 = {D(13)}"),
    "v11_cpf": (N[11], va.cpf, f"value <> repeat(substr(value, 1, 1), 11) AND {CPF1} = {D(10)} AND {CPF2} = {D(11)}"),
    "v11_cnpj": (N[14], va.cnpj, f"{CNPJ([5, 4, 3, 2, *TAIL])} = {D(13)} AND {CNPJ([6, 5, 4, 3, 2, *TAIL])} = {D(14)}"),
    "v12_citizen_id": (f"{N[15]} || substr({N[8]}, 1, 2) || substr('0123456789X', CAST(o_orderkey % 11 AS INT) + 1, 1)", va.citizen_id, f"substr('10X98765432', {W([7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2])} % 11 + 1, 1) = substr(value, 18, 1)"),
    "v14_looks_like_json": ("CASE o_orderkey % 4 WHEN 0 THEN ' {\"a\": 1} ' WHEN 1 THEN '[1]' WHEN 2 THEN '{]' ELSE 'text' END", va.looks_like_json, "(trim(value) LIKE '{%}') OR (trim(value) LIKE '[%]')"),
    "v16_private_ip": ("CAST(o_orderkey * 7 % 256 AS STRING) || '.' || CAST(o_orderkey * 11 % 256 AS STRING) || '.3.4'", va.private_ip, "split_part(value, '.', 1) IN ('10', '127') OR (starts_with(value, '172.') AND CAST(split_part(value, '.', 2) AS INT) BETWEEN 16 AND 31) OR starts_with(value, '192.168.') OR starts_with(value, '169.254.') OR (starts_with(value, '100.') AND CAST(split_part(value, '.', 2) AS INT) BETWEEN 64 AND 127)"),
}
for _name, (_expression, _rule, _sql) in RULES.items():
    add(
        _name,
        lambda s, d, e=_expression, r=_rule: cp.numbers(s, d, e).select("id", "value", r(F.col("value")).alias("valid")),
        f"SELECT id, value, ({_sql}) AS valid FROM ({cp.numbers_sql(_expression)})",
    )
MAGIC = "CASE o_orderkey % 9 WHEN 0 THEN '89504E470D0A1A0A00000000' WHEN 1 THEN 'FFD8FFE000104A4649460001' WHEN 2 THEN '474946383961000000000000' WHEN 3 THEN '524946460000000057454250' WHEN 4 THEN '524946460000000057415645' WHEN 5 THEN '494433030000000000000000' WHEN 6 THEN '4F6767530000000000000000' WHEN 7 THEN '1A45DFA30000000000000000' ELSE '000000000000000000000000' END"
add(
    "v15_magic_bytes",
    lambda s, d: cp.numbers(s, d, MAGIC).select("id", va.image_type(F.col("value")).alias("image"), va.audio_type(F.col("value")).alias("audio")),
    f"SELECT id, CASE WHEN value LIKE '89504E47%' THEN 'image/png' WHEN value LIKE 'FFD8FF%' THEN 'image/jpeg' WHEN value LIKE '47494638%' THEN 'image/gif' WHEN value LIKE '52494646%57454250' THEN 'image/webp' END AS image, "
    f"CASE WHEN value LIKE '52494646%57415645' THEN 'wav' WHEN value LIKE '494433%' OR value LIKE 'FFE%' OR value LIKE 'FFF%' THEN 'mp3' WHEN value LIKE '4F676753%' THEN 'ogg' WHEN value LIKE '1A45DFA3%' THEN 'webm' END AS audio FROM ({cp.numbers_sql(MAGIC)})",
)

# --- patterns


def spans_sql(source: str, regex: str, text: bool = True) -> str:
    """(doc_id, text, start, end, value) of all matches, from what the pattern extracts and what it splits."""
    quoted, kept = regex.replace("'", "''"), "doc_id, text" if text else "doc_id"
    return (
        f"(WITH t AS ({source}), m AS (SELECT {kept}, regexp_extract_all(text, '{quoted}') AS v, string_split_regex(text, '{quoted}') AS g FROM t), "
        f"x AS (SELECT {kept}, unnest(v) AS value, unnest(g[1:len(v)]) AS gap, unnest(range(1, len(v) + 1)) AS i FROM m WHERE len(v) > 0), "
        f"y AS (SELECT {kept}, value, CAST(sum(length(gap) + length(value)) OVER (PARTITION BY doc_id ORDER BY i) - length(value) AS INT) AS s FROM x) "
        f'SELECT {kept}, s AS "start", CAST(s + length(value) AS INT) AS "end", value FROM y)'
    )


DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
LETTERS = "upper(regexp_replace(value, '[^0-9A-Za-z]', '', 'g'))"
CODES = {"ES": "1428", "DE": "1314", "FR": "1527"}


def rule_sql(validator: str | None) -> str:
    if validator is None:
        return "true"
    if validator == "luhn":
        total = "list_sum(list_transform(range(length(d)), lambda i: CASE WHEN (length(d) - i) % 2 = 1 THEN CAST(substr(d, CAST(i AS INT) + 1, 1) AS INT) WHEN CAST(substr(d, CAST(i AS INT) + 1, 1) AS INT) < 5 THEN CAST(substr(d, CAST(i AS INT) + 1, 1) AS INT) * 2 ELSE CAST(substr(d, CAST(i AS INT) + 1, 1) AS INT) * 2 - 9 END))"
        return f"(length({DIGITS}) BETWEEN 13 AND 19 AND {total.replace('(d)', f'({DIGITS})').replace('(d,', f'({DIGITS},')} % 10 = 0)"
    if validator.startswith("iban"):
        c = validator[-2:].upper()
        return f"CAST(substr({LETTERS}, 5) || '{CODES[c]}' || substr({LETTERS}, 3, 2) AS HUGEINT) % 97 = 1"
    name = next(n for n in RULES if n.split("_", 1)[1] == validator)
    clean = "upper(replace(value, '-', ''))" if validator in ("dni", "nie") else LETTERS if validator == "citizen_id" else "value" if validator == "ipv4" else DIGITS
    return "(" + RULES[name][2].replace("(value", f"({clean}").replace("value <>", f"{clean} <>") + ")"


GUARD = "NOT regexp_matches(CASE WHEN \"start\" > 0 THEN substr(text, \"start\", 1) ELSE '' END, '[0-9]') AND NOT regexp_matches(substr(text, \"end\" + 1, 1), '[0-9]')"
COLUMNS = 'doc_id, "start", "end", value, type, confidence, source'
for _p in dims.BASE:
    for _where, _text in (("", None), ("_corpus", cp.TEXT)):
        _source = cp.corpus_sql(_text) if _text else "SELECT doc_id, text FROM documents"
        add(
            f"{_p.key}_{_p.type}{_where}",
            lambda s, d, p=_p, t=_text: spans.scan(cp.corpus(s, d, t) if t else cp.documents(s, d), [p]).drop("pattern"),
            f"SELECT doc_id, \"start\", \"end\", value, '{_p.type}' AS type, CAST(1.0 AS DOUBLE) AS confidence, 'regex' AS source FROM {spans_sql(_source, _p.regex)} WHERE {rule_sql(_p.validator)}",
        )
for _p in dims.LANGUAGE:
    add(
        f"{_p.key}_{_p.lang}_{_p.type}",
        lambda s, d, p=_p: spans.scan(cp.corpus(s, d, cp.FOREIGN), [p]).drop("pattern"),
        f"SELECT doc_id, \"start\", \"end\", value, '{_p.type}' AS type, CAST(1.0 AS DOUBLE) AS confidence, 'regex' AS source FROM {spans_sql(cp.corpus_sql(cp.FOREIGN), _p.regex)} WHERE {rule_sql(_p.validator)} AND {GUARD}",
    )


def found_sql(text: str, patterns, source: str | None = None) -> str:
    """All patterns' spans over the corpus, as SQL."""
    return " UNION ALL ".join(
        f"SELECT doc_id, \"start\", \"end\", value, '{p.type}' AS type, CAST(1.0 AS DOUBLE) AS confidence, 'regex' AS source FROM {spans_sql(source or cp.corpus_sql(text), p.regex)} WHERE {rule_sql(p.validator)}" + (f" AND {GUARD}" if p.guard else "")
        for p in patterns
    )


BASE_SQL = found_sql(cp.TEXT, dims.BASE)
add("d10_regex_scan", lambda s, d: spans.scan(cp.corpus(s, d), dims.BASE).drop("pattern"), BASE_SQL)
# greedy: a span goes if a kept one before it reaches over its start; by recursion over ranks
GREEDY_SQL = f"""
WITH RECURSIVE f AS ({BASE_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC, value, type) AS i FROM f),
g AS (SELECT r.*, "end" AS reach, true AS kept FROM r WHERE i = 1
  UNION ALL SELECT r.*, CASE WHEN r."start" >= g.reach THEN r."end" ELSE g.reach END, r."start" >= g.reach FROM g JOIN r ON r.doc_id = g.doc_id AND r.i = g.i + 1)
SELECT {COLUMNS} FROM g WHERE kept"""
add("d11_greedy_dedupe", lambda s, d: spans.greedy(spans.scan(cp.corpus(s, d), dims.BASE).drop("pattern")), GREEDY_SQL)
PT = [p for p in dims.LANGUAGE if p.lang in ("es", "pt")]
add("d36_language_scan", lambda s, d: spans.scan(cp.corpus(s, d, cp.FOREIGN), dims.LANGUAGE).drop("pattern"), found_sql(cp.FOREIGN, dims.LANGUAGE))
ADJACENT_SQL = f"""
WITH RECURSIVE f AS ({found_sql(cp.FOREIGN, PT)}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC, confidence, source, type, value) AS i FROM f),
g AS (SELECT doc_id, i, [struct_pack(s := "start", e := "end", v := value, t := type)] AS kept FROM r WHERE i = 1
  UNION ALL SELECT r.doc_id, r.i, CASE WHEN r."start" >= g.kept[-1].e THEN list_append(g.kept, struct_pack(s := r."start", e := r."end", v := r.value, t := r.type))
    WHEN r."end" - r."start" > g.kept[-1].e - g.kept[-1].s THEN list_append(g.kept[1:len(g.kept) - 1], struct_pack(s := r."start", e := r."end", v := r.value, t := r.type)) ELSE g.kept END
  FROM g JOIN r ON r.doc_id = g.doc_id AND r.i = g.i + 1),
l AS (SELECT doc_id, max_by(kept, i) AS kept FROM g GROUP BY doc_id), u AS (SELECT doc_id, unnest(kept) AS k FROM l)
SELECT doc_id, k.s AS "start", k.e AS "end", k.v AS value, k.t AS type, CAST(1.0 AS DOUBLE) AS confidence, 'regex' AS source FROM u"""
add("d37_adjacent_dedupe", lambda s, d: spans.adjacent(spans.scan(cp.corpus(s, d, cp.FOREIGN), PT).drop("pattern")), ADJACENT_SQL)
add(
    "v13_digit_boundary",
    lambda s, d: spans.scan(cp.corpus(s, d, cp.FOREIGN), dims.LANGUAGE).groupBy("pattern", "type").agg(F.count(F.lit(1)).alias("n")),
    " UNION ALL ".join(f"SELECT '{p.key}' AS pattern, '{p.type}' AS type, count(*) AS n FROM {spans_sql(cp.corpus_sql(cp.FOREIGN), p.regex)} WHERE {rule_sql(p.validator)}" + (f" AND {GUARD}" if p.guard else "") + " HAVING count(*) > 0" for p in dims.LANGUAGE),
)
RELATED_SQL = "VALUES " + ", ".join(f"('{k}', '{x}')" for k, own in dims.RELATED.items() for x in own)
add("t10_dictionary_tokens", lambda s, d: cp.corpus(s, d, cp.SAID).select("doc_id", F.posexplode(spans.tokens(F.col("text"))).alias("i", "w")).select("doc_id", "i", "w.start", "w.end", "w.value"),
    "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY \"start\") - 1 AS INT) AS i, \"start\", \"end\", value FROM " + spans_sql(f"SELECT doc_id, lower(text) AS text FROM ({cp.corpus_sql(cp.SAID)})", r"[\p{L}\p{N}](?:[\p{L}\p{N}'-]*[\p{L}\p{N}])?"))
add("t11_words_and_marks", lambda s, d: cp.corpus(s, d, cp.SAID).select("doc_id", F.posexplode(tx.words_and_marks(F.col("text"))).alias("i", "token")),
    f"SELECT doc_id, CAST(unnest(range(len(t))) AS INT) AS i, unnest(t) AS token FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}'']+|[^\\p{{L}}\\p{{N}}''\\s]') AS t FROM ({cp.corpus_sql(cp.SAID)}))")

# --- dictionaries
PHRASE_LISTS = {"health_keyword": ["type 2 diabetes", "diabetes", "asthma"], "child_keyword": ["school", "kindergarten"]}


def listed(spark, lists):
    return spark.createDataFrame([(p, t, i) for i, (t, own) in enumerate(lists.items()) for p in own], "phrase string, type string, rank int")


def phrases_sql(lists: dict[str, list[str]], confidence: float, source: str, text: str = cp.SAID, of: str | None = None) -> str:
    """Hits of n words (3, 2, 1), each kept if no longer one and no kept one of its length overlaps it from the left."""
    rows = ", ".join(f"('{p.replace(chr(39), chr(39) * 2)}', '{t}', {i})" for i, (t, own) in enumerate(lists.items()) for p in own)
    words = spans_sql(f"SELECT doc_id, lower(text) AS text FROM ({of or cp.corpus_sql(text)})", r"[\p{L}\p{N}](?:[\p{L}\p{N}'-]*[\p{L}\p{N}])?", text=False)
    return f"""
WITH RECURSIVE p AS (SELECT phrase, min_by(type, rank) AS type FROM (VALUES {rows}) v(phrase, type, rank) GROUP BY phrase),
w AS (SELECT doc_id, "start" AS s, "end" AS e, value, row_number() OVER (PARTITION BY doc_id ORDER BY "start") AS i FROM {words}),
l AS (SELECT *, lead(value) OVER x AS v2, lead(value, 2) OVER x AS v3, lead(e) OVER x AS e2, lead(e, 2) OVER x AS e3 FROM w WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, 1 AS n, s, e, value FROM l UNION ALL SELECT doc_id, 2, s, e2, value || ' ' || v2 FROM l WHERE v2 IS NOT NULL UNION ALL SELECT doc_id, 3, s, e3, value || ' ' || v2 || ' ' || v3 FROM l WHERE v3 IS NOT NULL),
h AS (SELECT g.*, p.type, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, s) AS i FROM g JOIN p ON g.value = p.phrase),
k AS (SELECT doc_id, i, [struct_pack(s := s, e := e, v := value, t := type)] AS kept FROM h WHERE i = 1
  UNION ALL SELECT h.doc_id, h.i, CASE WHEN len(list_filter(k.kept, lambda z: h.s < z.e AND h.e > z.s)) > 0 THEN k.kept ELSE list_append(k.kept, struct_pack(s := h.s, e := h.e, v := h.value, t := h.type)) END
  FROM k JOIN h ON h.doc_id = k.doc_id AND h.i = k.i + 1),
m AS (SELECT doc_id, max_by(kept, i) AS kept FROM k GROUP BY doc_id), u AS (SELECT doc_id, unnest(kept) AS z FROM m)
SELECT doc_id, z.s AS "start", z.e AS "end", z.v AS value, z.t AS type, CAST({confidence} AS DOUBLE) AS confidence, '{source}' AS source FROM u"""


add("d41_keyword_dictionary", lambda s, d: spans.phrase_scan(cp.corpus(s, d, cp.SAID), listed(s, PHRASE_LISTS)), phrases_sql(PHRASE_LISTS, 0.7, "keyword"))
add("d61_spoken_phrases", lambda s, d: spans.phrase_scan(cp.corpus(s, d, cp.SAID), listed(s, {"spoken": dims.SPOKEN}), confidence=1.0, source="spoken"), phrases_sql({"spoken": dims.SPOKEN}, 1.0, "spoken"))
add("c1_persuasion_scan", lambda s, d: spans.phrase_scan(cp.corpus(s, d, cp.SAID), listed(s, dims.PERSUASION), confidence=1.0, source="persuasion"), phrases_sql(dims.PERSUASION, 1.0, "persuasion"))
FIRST, LAST = ["Maria", "John", "Anna"], ["Garcia", "Smith"]


def names(spark, own):
    return spark.createDataFrame([(x,) for x in own], "name string")


def names_sql(of: str) -> str:
    return f"""
WITH w AS (SELECT doc_id, "start" AS s, "end" AS e, value, row_number() OVER (PARTITION BY doc_id ORDER BY "start") AS i FROM {spans_sql(of, r"[\p{L}\p{N}](?:[\p{L}\p{N}'-]*[\p{L}\p{N}])?", text=False)}),
l AS (SELECT *, lead(value) OVER x AS v2, lead(e) OVER x AS e2, lag(value) OVER x AS v0 FROM w WINDOW x AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, s AS "start", CASE WHEN v2 IN ('Garcia', 'Smith') AND value IN ('Maria', 'John', 'Anna') THEN e2 ELSE e END AS "end",
  CASE WHEN v2 IN ('Garcia', 'Smith') AND value IN ('Maria', 'John', 'Anna') THEN value || ' ' || v2 ELSE value END AS value, 'person' AS type,
  CAST(CASE WHEN v2 IN ('Garcia', 'Smith') AND value IN ('Maria', 'John', 'Anna') THEN 0.7 ELSE 0.4 END AS DOUBLE) AS confidence, 'gazetteer' AS source
FROM l WHERE (value IN ('Maria', 'John', 'Anna') OR value IN ('Garcia', 'Smith')) AND NOT (value IN ('Garcia', 'Smith') AND coalesce(v0, '') IN ('Maria', 'John', 'Anna'))"""


NAMES_SQL = names_sql(cp.corpus_sql(cp.SAID))
add("d44_name_gazetteer", lambda s, d: spans.names_scan(cp.corpus(s, d, cp.SAID), names(s, FIRST), names(s, LAST)), NAMES_SQL)

# --- resolution


BOTH = f"{cp.SAID} || ' ' || {cp.TEXT}"


def engines(s, d):
    """Spans of the engines over the mixed corpus; its sentences have no language of their own patterns."""
    return hybrid.engines(cp.corpus(s, d, BOTH), listed(s, PHRASE_LISTS), names(s, FIRST), names(s, LAST))


ENGINES_SQL = f"({found_sql(BOTH, dims.BASE)}) UNION ALL ({phrases_sql(PHRASE_LISTS, 0.7, 'keyword', BOTH)}) UNION ALL ({names_sql(cp.corpus_sql(BOTH))})"
CLUSTERS_OF = f"e AS ({ENGINES_SQL}),\n"
CLUSTERS = f"""{CLUSTERS_OF}r AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end", type, source, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
c AS (SELECT doc_id, "start", "end", value, type, confidence, source, CAST(sum(CASE WHEN reach IS NULL OR reach <= "start" THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY "start", "end", type, source, value ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM r)"""
add("r1_overlap_clusters", lambda s, d: spans.clusters(engines(s, d)), f"WITH {CLUSTERS} SELECT * FROM c")
VOTE = f"""{CLUSTERS},
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, cluster) AS n FROM c),
t AS (SELECT doc_id, cluster, type, max(confidence) AS conf, count(DISTINCT source) AS sources, max(n) AS n, arg_max(struct_pack(s := "start", e := "end", v := value), (confidence, "end" - "start", -"start")) AS b FROM n GROUP BY ALL),
q AS (SELECT *, CASE WHEN n > 1 AND sources > 1 THEN least(CAST(1 AS DOUBLE), conf + CAST(0.15 AS DOUBLE)) ELSE conf END AS confidence FROM t),
v AS (SELECT *, row_number() OVER (PARTITION BY doc_id, cluster ORDER BY confidence DESC, b.e - b.s DESC, b.s, type) AS k FROM q)"""
VOTE_SQL = f'WITH {VOTE} SELECT doc_id, b.s AS "start", b.e AS "end", b.v AS value, type, CAST(confidence AS DOUBLE) AS confidence, sources FROM v WHERE k = 1'
add("r2_cluster_vote", lambda s, d: spans.vote(engines(s, d), least=0.0), VOTE_SQL)
add("r3_singletons", lambda s, d: spans.vote(engines(s, d), least=0.0).where("sources = 1").groupBy("type").agg(F.count(F.lit(1)).alias("n")), f"SELECT type, count(*) AS n FROM ({VOTE_SQL}) WHERE sources = 1 GROUP BY type")
add("r4_confidence_filter", lambda s, d: spans.vote(engines(s, d)), f"SELECT * FROM ({VOTE_SQL}) WHERE confidence >= 0.5")
add("r5_bonus_off", lambda s, d: spans.vote(engines(s, d), bonus=0.0), f"SELECT * FROM ({VOTE_SQL.replace('CAST(0.15 AS DOUBLE)', '0')}) WHERE confidence >= 0.5")
REACH_SQL = f"""
WITH RECURSIVE e AS ({ENGINES_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC, value, type, confidence, source) AS i FROM e),
g AS (SELECT r.*, "end" AS reach, true AS kept FROM r WHERE i = 1
  UNION ALL SELECT r.*, CASE WHEN r."start" >= g.reach THEN r."end" ELSE g.reach END, r."start" >= g.reach FROM g JOIN r ON r.doc_id = g.doc_id AND r.i = g.i + 1)
SELECT {COLUMNS} FROM g WHERE kept"""
add("r6_ordered_spans", lambda s, d: spans.greedy(engines(s, d)).select("doc_id", "start", "end", "value", "type", "confidence", "source"), REACH_SQL)
# documents with entities of their own key after the text, some of them in code
FENCE = r"'```[\s\S]*?```|`[^`\n]+`'"
PLANTED = " || ' ' || ".join(["text", *(x.replace(cp.KEY, "doc_id") for x in (cp.SAID, cp.TEXT, cp.FOREIGN))])
PLANTED_SQL = f"SELECT doc_id, {PLANTED} AS text FROM documents"
MASKED_SQL = f"""SELECT doc_id, CASE WHEN strpos(text, '`') > 0 THEN array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || CASE WHEN i <= len(v) THEN regexp_replace(v[i], '[^\n]', ' ', 'g') ELSE '' END), '') ELSE text END AS text
FROM (SELECT doc_id, text, regexp_extract_all(text, {FENCE}) AS v, string_split_regex(text, {FENCE}) AS g FROM planted)"""


def language_sql() -> str:
    """(doc_id, lang): tx.language over `masked`."""
    share = lambda a, b: f"length(regexp_replace(text, '[^{a}-{b}]', '', 'g')) / greatest(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')), 1)"
    stops = ", ".join(f"struct_pack(n := len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in own)}))), i := {-i}, lang := '{k}')" for i, (k, own) in enumerate(tx.STOP_WORDS.items()))
    scripts = [("ja", "\\x{3040}", "\\x{30FF}", 0.1), ("ko", "\\x{AC00}", "\\x{D7AF}", 0.3), ("ar", "\\x{0600}", "\\x{06FF}", 0.3), ("zh", "\\x{4E00}", "\\x{9FFF}", 0.3)]
    cases = " ".join(f"WHEN {share(a, b)} > {least} THEN '{k}'" for k, a, b, least in scripts)
    return f"""SELECT doc_id, CASE WHEN strlen(text) < 20 THEN NULL {cases} WHEN best.n >= 0.15 * greatest(len(w), 1) THEN best.lang END AS lang
FROM (SELECT *, list_max([{stops}]) AS best FROM (SELECT doc_id, text, list_filter(string_split_regex(lower(text), '[^\\p{{L}}]+'), lambda x: x <> '') AS w FROM masked))"""


add("d38_language_detect", lambda s, d: cp.documents(s, d).select("doc_id", tx.language(F.col("text")).alias("lang")), f"WITH masked AS (SELECT doc_id, text FROM documents) {language_sql()}")
add(
    "d39_related_languages",
    lambda s, d: cp.documents(s, d).select("doc_id", F.explode(hybrid.scanned_languages(F.col("text"))).alias("scanned")),
    f"WITH masked AS (SELECT doc_id, text FROM documents), l AS ({language_sql()}) SELECT l.doc_id, r.s AS scanned FROM l JOIN ({RELATED_SQL}) r(l, s) ON l.lang = r.l",
)


def hybrid_sql(allowed: list[str]) -> str:
    """The whole scan over documents with planted entities, by the languages allowed."""
    parts = [f"({found_sql('', dims.BASE, 'SELECT * FROM masked')})", f"({phrases_sql(PHRASE_LISTS, 0.7, 'keyword', of='SELECT * FROM masked')})", f"({names_sql('SELECT * FROM masked')})"]
    pairs = [(k, x) for k, own in dims.RELATED.items() for x in own if not allowed or x in allowed]
    ctes = f"planted AS MATERIALIZED ({PLANTED_SQL}), masked AS MATERIALIZED ({MASKED_SQL}), lang AS MATERIALIZED ({language_sql()}), scanned AS (SELECT doc_id, s FROM lang JOIN (VALUES {', '.join(f'{p!r}' for p in pairs)}) r(l, s) ON lang.lang = r.l)"
    own = sorted({x for _, x in pairs} & {"es", "pt", "fr", "de"})  # no document here is in another script
    rows = " UNION ALL ".join(f"SELECT *, '{k}' AS lang FROM ({found_sql('', [p for p in dims.LANGUAGE if p.lang == k], f'SELECT m.* FROM masked m JOIN scanned c ON m.doc_id = c.doc_id AND c.s = {k!r}')})" for k in own)
    ctes += f""", lf AS MATERIALIZED ({rows}), lr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, lang ORDER BY "start", "end" DESC, value, type) AS i FROM lf),
lg AS (SELECT doc_id, lang, i, [struct_pack(s := "start", e := "end", v := value, t := type)] AS kept FROM lr WHERE i = 1
  UNION ALL SELECT lr.doc_id, lr.lang, lr.i, CASE WHEN lr."start" >= lg.kept[-1].e THEN list_append(lg.kept, struct_pack(s := lr."start", e := lr."end", v := lr.value, t := lr.type))
    WHEN lr."end" - lr."start" > lg.kept[-1].e - lg.kept[-1].s THEN list_append(lg.kept[1:len(lg.kept) - 1], struct_pack(s := lr."start", e := lr."end", v := lr.value, t := lr.type)) ELSE lg.kept END
  FROM lg JOIN lr ON lr.doc_id = lg.doc_id AND lr.lang = lg.lang AND lr.i = lg.i + 1),
ll AS (SELECT doc_id, lang, max_by(kept, i) AS kept FROM lg GROUP BY ALL), lu AS (SELECT doc_id, unnest(kept) AS k FROM ll)"""
    parts.append("SELECT doc_id, k.s, k.e, k.v, k.t, CAST(1.0 AS DOUBLE), 'regex' FROM lu")
    vote = VOTE.replace(ENGINES_SQL, " UNION ALL ".join(parts))
    return f"""WITH RECURSIVE {ctes}, {vote} SELECT v.doc_id, b.s AS "start", b.e AS "end", substr(p.text, b.s + 1, b.e - b.s) AS value, type, confidence, sources FROM v JOIN planted p ON p.doc_id = v.doc_id WHERE k = 1 AND confidence >= 0.5"""


def hybrid_scan(s, d, allowed: list[str]):
    docs = cp.spread(s.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", f"{PLANTED} AS text"))
    return hybrid.detect(docs, listed(s, PHRASE_LISTS), names(s, FIRST), names(s, LAST), config=Config(languages=allowed))


for _name, _allowed in (("d54_hybrid_scan", []), ("d40_language_allow_list", ["de"]), ("d40_two_languages", ["es", "fr"])):
    add(_name, lambda s, d, a=_allowed: hybrid_scan(s, d, a), hybrid_sql(_allowed))
add("a1_type_counts", lambda s, d: spans.vote(engines(s, d)).groupBy("type").agg(F.count_distinct("value").alias("n")), f"SELECT type, count(DISTINCT value) AS n FROM ({VOTE_SQL}) WHERE confidence >= 0.5 GROUP BY type")
add("a2_categories", lambda s, d: spans.vote(engines(s, d)).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types")), f"SELECT doc_id, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM ({VOTE_SQL}) WHERE confidence >= 0.5 GROUP BY doc_id")
add("d54_hybrid_scan_counts", lambda s, d: spans.vote(spans.scan(cp.documents(s, d), dims.BASE)).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs")),
    f"WITH RECURSIVE e AS ({found_sql('', dims.BASE, 'SELECT doc_id, text FROM documents')}), {VOTE.replace(CLUSTERS_OF, '')} SELECT type, count(*) AS n, count(DISTINCT doc_id) AS docs FROM v WHERE k = 1 AND confidence >= 0.5 GROUP BY type")
add("p15_label_redaction", lambda s, d: spans.spliced(cp.corpus(s, d), spans.greedy(spans.scan(cp.corpus(s, d), [dims.BASE[3]]).drop("pattern")).withColumn("replacement", F.lit("[EMAIL]"))),
    f"SELECT doc_id, regexp_replace(text, '{dims.BASE[3].regex}', '[EMAIL]', 'g') AS text FROM ({cp.corpus_sql()})")
add("t5_code_fences", lambda s, d: cp.corpus(s, d, cp.SAID).select("doc_id", tx.fences_masked(F.col("text")).alias("text")),
    f"SELECT doc_id, CASE WHEN strpos(text, '`') > 0 THEN replace(text, regexp_extract(text, '`[^`]+`'), repeat(' ', length(regexp_extract(text, '`[^`]+`')))) ELSE text END AS text FROM ({cp.corpus_sql(cp.SAID)})")
SCRUB_SQL = "text"
for _regex, _label in dims.SCRUB:
    SCRUB_SQL = f"regexp_replace({SCRUB_SQL}, '{_regex}', '{_label}', 'g')"
add("s16_log_scrub", lambda s, d: cp.corpus(s, d).select("doc_id", tx.scrubbed(F.col("text")).alias("text")), f"SELECT doc_id, {SCRUB_SQL} AS text FROM ({cp.corpus_sql()})")
add("x1_plain_dashes", lambda s, d: s.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey AS id", "concat('a', char(8211), 'b', char(45), c_name) AS t").select("id", tx.plain_dashes(F.regexp_replace(F.col("t"), "^a.", "a–")).alias("t")),
    "SELECT c_custkey AS id, 'a-b-' || c_name AS t FROM customer")
