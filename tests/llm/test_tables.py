"""Steps that operators share."""

from collections import Counter

from pyspark.sql import functions as F

from codeeval.llm import tables


def test_possible_rows_hold_all_ids(spark):
    rows = spark.range(0, 20_000).select("id", F.lit("t").alias("text")).union(spark.sql("SELECT CAST(NULL AS LONG), 'n'"))
    ids = spark.createDataFrame([(i,) for i in [*range(0, 20_000, 50), -5]], "x long")
    got = {r.id for r in tables.possible(rows, "id", ids).collect()}
    assert set(range(0, 20_000, 50)) <= got and len(got) < 450
    marked = tables.maybe_in(rows, "id", ids, "named")
    assert marked.columns == ["id", "text", "named"] and marked.count() == 20_001
    assert {r.id for r in marked.where("named").collect()} == got
    assert tables.possible(rows, "id", ids.where("false")).count() == 0
    plan = tables.possible(rows, "id", ids)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "SortMergeJoin" not in plan


def test_spread_join_is_a_left_join(spark):
    rows = spark.createDataFrame([(1, i) for i in range(500)] + [(2, 7), (3, 8), (None, 9)], "k long, v long")
    table = spark.createDataFrame([(1, "a"), (2, "b"), (4, "c"), (None, "n")], "k long, name string")
    got = Counter(map(tuple, tables.spread_join(rows, table, ["k"], F.col("v")).select("k", "v", "name").collect()))
    want = Counter([(1, i, "a") for i in range(500)] + [(2, 7, "b"), (3, 8, None), (None, 9, None)])
    assert got == want
