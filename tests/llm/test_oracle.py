"""Queries against their DuckDB SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
from codeeval.llm import oracle, queries

SF = "/root/testdata/sf0.001"


def test_registered():
    names = set(queries.all_queries())
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)}
    assert names | {"pipeline"} <= set(E.queries())


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(oracle.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    want = sorted(map(str, want.fetchall()))
    got = sorted(map(str, map(tuple, queries.all_queries()[name](spark, SF).select(*cols).collect())))
    assert got == want
