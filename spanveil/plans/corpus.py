"""A corpus with known entities, made from table keys by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.io import spread

KEY = "c_custkey"


def num(n: int, salt: int, key: str = KEY) -> str:
    """n digits that look drawn at random, by key."""
    return f"lpad(CAST(({key} * 7919 + {salt}) * 104729 % {10**n} AS STRING), {n}, '0')"


def luhn_digit(body: str, n: int) -> str:
    """The digit that makes n digits of body and itself pass."""
    terms = []
    for i in range(1, n + 1):
        d = f"CAST(substr({body}, {i}, 1) AS INT)"
        terms.append(f"(CASE WHEN {d} < 5 THEN {d} * 2 ELSE {d} * 2 - 9 END)" if (n - i) % 2 == 0 else d)
    return f"CAST((10 - ({' + '.join(terms)}) % 10) % 10 AS STRING)"


CARD = f"('4' || {num(14, 11)})"
TEXT = " || ".join(
    [
        f"'Case ' || CAST({KEY} AS STRING) || ' of account holder: SSN ' || {num(3, 1)} || '-' || {num(2, 2)} || '-' || {num(4, 3)}",
        f"', card ' || {CARD} || (CASE WHEN {KEY} % 3 = 0 THEN '0' ELSE {luhn_digit(CARD, 15)} END)",
        f"', call ' || (CASE {KEY} % 3 WHEN 0 THEN '(' || {num(3, 4)} || ') ' || {num(3, 5)} || '-' || {num(4, 6)} WHEN 1 THEN {num(3, 4)} || '-' || {num(3, 5)} || '-' || {num(4, 6)} ELSE '+1 ' || {num(3, 4)} || ' ' || {num(3, 5)} || ' ' || {num(4, 6)} END)",
        f"', mail user' || {num(4, 7)} || '@mail' || CAST({KEY} % 7 AS STRING) || '.example.com'",
        f"(CASE {KEY} % 4 WHEN 0 THEN ', key sk-' || {num(12, 8)} || {num(12, 9)} WHEN 1 THEN ', key AKIA' || {num(14, 8)} || '77' WHEN 2 THEN ', key ghp_' || {num(12, 8)} || {num(12, 9)} || {num(12, 10)} ELSE '' END)",
        f"', from ' || CAST({KEY} % 256 AS STRING) || '.' || CAST({KEY} * 7 % 300 AS STRING) || '.' || CAST({KEY} * 3 % 256 AS STRING) || '.1'",
        f"', v6 2001:db8::' || substr({num(4, 12)}, 1, 4) || ':1'",
        f"', mac ' || {num(2, 13)} || ':1a:' || {num(2, 14)} || ':2b:' || {num(2, 15)} || ':ff'",
        f"', at ' || CAST({KEY} % 80 AS STRING) || '.' || {num(4, 16)} || ', -' || CAST({KEY} % 99 AS STRING) || '.' || {num(5, 17)}",
        "'.'",
    ]
)
FOREIGN = " || ".join(
    [
        f"'ID ' || {num(10, 21)} || ' ; 784-' || {num(4, 22)} || '-' || {num(7, 23)} || '-1 ; +966 5' || {num(1, 24)} || ' ' || {num(3, 25)} || ' ' || {num(4, 26)} || ' ; +971 5' || {num(1, 24)} || '-' || {num(3, 25)} || '-' || {num(4, 26)}",
        f"' ; ' || {num(11, 27)} || ' ; +49 30 ' || {num(7, 28)} || ' ; DE' || {num(2, 29)} || ' ' || {num(4, 30)} || ' ' || {num(4, 31)} || ' ' || {num(4, 32)} || ' ' || {num(4, 33)} || ' ' || {num(2, 34)}",
        f"' ; ' || {num(8, 35)} || substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST({KEY} % 23 AS INT) + 1, 1) || ' ; X' || {num(7, 36)} || 'T ; +34 ' || {num(3, 37)} || ' ' || {num(3, 38)} || ' ' || {num(3, 39)} || ' ; ES' || {num(2, 40)} || ' ' || {num(4, 41)} || ' ' || {num(4, 42)} || ' ' || {num(4, 43)} || ' ' || {num(4, 44)} || ' ' || {num(4, 45)}",
        f"' ; 1' || {num(14, 46)} || ' ; +33 6 ' || {num(2, 47)} || ' ' || {num(2, 48)} || ' ' || {num(2, 49)} || ' ' || {num(2, 50)} || ' ; 06 ' || {num(2, 47)} || ' ' || {num(2, 48)} || ' ' || {num(2, 49)} || ' ' || {num(2, 50)} || ' ; FR' || {num(2, 51)} || ' ' || {num(4, 52)} || ' ' || {num(4, 53)} || ' ' || {num(4, 54)} || ' ' || {num(4, 55)} || ' ' || {num(4, 56)} || ' ' || {num(3, 57)}",
        f"' ; ' || {num(4, 58)} || '-' || {num(4, 59)} || '-' || {num(4, 60)} || ' ; +81 3 ' || {num(4, 61)} || ' ' || {num(4, 62)} || ' ; 090-' || {num(4, 61)} || '-' || {num(4, 62)}",
        f"' ; ' || {num(6, 63)} || '-' || CAST({KEY} % 4 + 1 AS STRING) || {num(6, 64)} || ' ; +82 10 ' || {num(4, 65)} || ' ' || {num(4, 66)} || ' ; 010-' || {num(4, 65)} || '-' || {num(4, 66)}",
        f"' ; ' || {num(3, 67)} || '.' || {num(3, 68)} || '.' || {num(3, 69)} || '-' || {num(2, 70)} || ' ; ' || {num(2, 71)} || '.' || {num(3, 72)} || '.' || {num(3, 73)} || '/' || {num(4, 74)} || '-' || {num(2, 75)} || ' ; +55 11 ' || {num(5, 76)} || '-' || {num(4, 77)} || ' ; +351 ' || {num(3, 78)} || ' ' || {num(3, 79)} || ' ' || {num(3, 80)}",
        f"' ; 11' || {num(4, 81)} || '19' || {num(2, 82)} || lpad(CAST({KEY} % 12 + 1 AS STRING), 2, '0') || lpad(CAST({KEY} % 28 + 1 AS STRING), 2, '0') || {num(4, 83)} || ' ; +86 13' || {num(1, 84)} || ' ' || {num(4, 85)} || ' ' || {num(4, 86)} || ' ; 138 ' || {num(4, 85)} || ' ' || {num(4, 86)} || ' ;'",
    ]
)
#: sentences with persuasion, spoken and dictionary phrases and names
SAID = " || ".join(
    [
        f"(CASE {KEY} % 6 WHEN 0 THEN 'Act now, only a few left! ' WHEN 1 THEN 'You could lose your best deal; hurry up. ' WHEN 2 THEN 'Experts agree and most people know. ' WHEN 3 THEN 'A smart choice: free trial, cancel anytime. ' WHEN 4 THEN 'This limited time offer expires soon. ' ELSE 'The report is attached. ' END)",
        f"(CASE {KEY} % 5 WHEN 0 THEN 'My social security and credit card number are here. ' WHEN 1 THEN 'Please give your date of birth. ' WHEN 2 THEN 'She has type 2 diabetes and asthma. ' WHEN 3 THEN 'Maria Garcia met John at school. ' ELSE 'Nothing else. ' END)",
        f"(CASE {KEY} % 4 WHEN 0 THEN 'Use `{'{'}key 123-45-6789{'}'}` in code.' ELSE 'Thanks, Anna Smith.' END)",
    ]
)
#: twelve to eighteen digits for the check-digit functions
NUMBERS = {n: num(n, 7 * n, "o_orderkey") for n in (8, 9, 10, 11, 12, 13, 14, 15)}


def corpus(spark: SparkSession, sf_dir: str, text: str = TEXT) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/customer.parquet")).selectExpr(f"CAST({KEY} AS BIGINT) AS doc_id", f"{text} AS text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def corpus_sql(text: str = TEXT) -> str:
    return f"SELECT CAST({KEY} AS BIGINT) AS doc_id, {text} AS text FROM customer"


def numbers(spark: SparkSession, sf_dir: str, expression: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("CAST(o_orderkey AS BIGINT) AS id", f"{expression} AS value")


def numbers_sql(expression: str) -> str:
    return f"SELECT CAST(o_orderkey AS BIGINT) AS id, {expression} AS value FROM orders"
