"""Queries of the surface against an independent database, on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from millrace.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int | decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, oracle, name):
    df = registry.queries()[name](spark, FOLDER)
    relation = oracle.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    places = [relation.columns.index(c) for c in columns]
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[i]) for i in places) for r in relation.fetchall()), key=repr)
    assert mine == theirs


def test_every_query_is_known():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_formats_at_every_size(spark, tmp_path):
    keys = "[NULL, 1, 2, 1048, 1049, 1073741, 1073742, 2147484, 1099511628, 5000000000]"
    duckdb.sql(f"COPY (SELECT p.* REPLACE (unnest({keys}) AS p_partkey) FROM (FROM '{FOLDER}/part.parquet' LIMIT 1) AS p) TO '{tmp_path}/part.parquet'")
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW part AS FROM '{tmp_path}/part.parquet'")
    theirs = connection.sql(registry.oracle_sql()["fn_formats"]).fetchall()
    assert len(theirs) == 10
    assert sorted(map(tuple, registry.queries()["fn_formats"](spark, str(tmp_path)).collect()), key=repr) == sorted(theirs, key=repr)
