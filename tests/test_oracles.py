"""Each registered query against the same query in SQL, on the smallest driver tables."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__
from docquarry.plans import queries as plans

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return str(v.date()) if v.time() == datetime.time() else str(v)
    return str(v) if isinstance(v, datetime.date) else v


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    made = duck.execute(plans.ORACLE[name])
    names = [x[0] for x in made.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in made.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_query_without_sql_has_rows(spark, name):
    assert plans.QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
