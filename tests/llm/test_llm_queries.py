"""Registered queries: DuckDB SQL on the sf0.01 tables, flat outputs, and the subpackage guard."""

import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import types as T

from leadlens.llm import queries as Q

SF = "/root/testdata/sf0.01"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(Q.SQL))
def test_matches_sql(spark, con, key):
    df = Q.QUERIES[key](spark, SF)
    cur = con.execute(Q.SQL[key])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(map(repr, cur.fetchall()))
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == want


def test_one_query_per_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in Q.QUERIES) == list(range(1, 14))


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' in q and 'op1_decontamination' in q"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=REPO, check=True)


@pytest.mark.parametrize("key", ["op1_decontamination", "op2_secret_scan", "op7_exact_dedup", "op10_mixing"])
def test_flat_outputs(spark, key):
    schema = Q.QUERIES[key](spark, "/root/testdata/sf0.001").schema
    assert not [f for f in schema if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
