"""Every registered query against its SQL, row by row, on the smallest tables."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from spanveil.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (float, np.floating)):
        return f"{v:.9g}"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    return str(v)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in ORACLES:
        assert len(got.columns)
        return
    want = duck.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["p16_sanitize_restore", "x5_restore_text", "p19_body_round_trip", "e3_similar_pairs"])
def test_rows_made_from_keys_are_not_broadcast(spark, name):
    assert "Broadcast" not in QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
