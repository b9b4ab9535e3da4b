"""Plan checks over every registered query and the DuckDB oracle at sf0.001."""

import pytest

import __spark_entry__ as E
from codeeval.plans import catalog, oracle
from tests.conftest import SF_SMALL
from tests.oracle_check import compare

QUERIES = catalog.all_queries()


def test_every_query_has_an_oracle():
    assert set(oracle.oracle_sql()) == set(QUERIES)
    assert set(QUERIES) <= set(E.queries()) and set(oracle.oracle_sql()) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "avg_bleu" in df.columns


#: Queries over document snippets, whose stand-in joins the one-row item count.
ONE_ROW_ITEMS = {"generation_log", "report_lines", "clean_code", "strip_backticks", "apply_verdicts", "model_rollup",
                 "bleu_prompt_as_reference", "failing_snippets", "failing_snippets_file", "prompt_evaluation",
                 "variation_rollup", "prompt_variation_summary"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_is_jvm_only_and_pair_free(spark, name):
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    for bad in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "CartesianProduct"):
        assert bad not in plan, (name, bad)
    # the only nested-loop joins allowed are against a broadcast side of proven size:
    # the 5-row template table (J4) or a one-row aggregate (max id / top size / count)
    if "BroadcastNestedLoopJoin" in plan:
        assert name in {"prompt_variations", "append_working", "batch_edits", "registry_append",
                        "performance_trend", "eval_document_roundtrip"} | ONE_ROW_ITEMS, name


def test_queries_match_oracle(spark):
    res = compare(spark, SF_SMALL, sorted(QUERIES), verbose=False)
    bad = {k: v for k, v in res.items() if v != "OK"}
    assert not bad, bad


def test_filters_and_columns_reach_the_scan(spark):
    """Pushdown / pruning regressions: the first-message filter reaches the
    parquet scan, and a two-column count reads only the id column."""
    plan = QUERIES["test_prompts"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(turn,0)" in plan
    plan = QUERIES["dataset_size"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<conv_id:bigint>" in plan
