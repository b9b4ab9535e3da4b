"""SURVEY section 2.12: each quirk of the original toolchain and the decision
taken, as a named case."""

import pytest
from pyspark.sql import functions as F

from codeeval.operators import dedup as D
from codeeval.operators import pairs as P
from codeeval.operators import registry as G
from codeeval.functions import text as T
from tests.conftest import messages_df


def test_q1_prefixed_prompts_never_match_raw_main_prompts(spark):
    """Q1: the verdict path carries ``Human: `` prompts (P3); J2 compares raw
    values, so pass P4 prompts to find raw duplicates -- P3 prompts only
    reproduce the original's behaviour (no match on the first append)."""
    m = messages_df(spark, [(1, 0, "human", "q"), (1, 1, "assistant", "a")])
    main = messages_df(spark, [(9, 0, "human", "q"), (9, 1, "assistant", "other")])
    raw = P.pair_role_zip(m)
    prefixed = P.pair_role_zip_context(m)
    assert D.dedup_against_main(raw, main).count() == 0
    assert D.dedup_against_main(prefixed, main).count() == 1


def test_q3_eval_results_become_prompt_code_pairs(spark, tmp_path):
    """Q3: evaluation documents are split by X2 instead of yielding zero pairs."""
    import json
    from codeeval.sources.readers import read_eval_documents
    doc = {"timestamp": "t", "average_metrics": {"bleu": 0.0}, "training_dataset_size": 1,
           "detailed_results": [{"reference": "r", "generated": "user\n\nWrite X\nassistant\n\nobject X", "bleu": 0.0}]}
    (tmp_path / "e.json").write_text(json.dumps(doc))
    r = read_eval_documents(spark, str(tmp_path / "e.json"), multiline=True).first()
    assert (r.prompt, r.code) == ("Write X", "object X")


def test_q7_trial_report_carries_real_components(spark):
    """Q7: the best trial reports its own rate and BLEU, not fractions of the score."""
    reg = spark.createDataFrame([(0, "h", 0.4, 12, 17)], "seq long, model_hash string, avg_bleu double, ok int, total int") \
        .select("seq", "model_hash", "avg_bleu",
                F.struct(F.col("ok").alias("successful_runs"), F.col("total").alias("total_snippets")).alias("execution_check"))
    top = G.trial_score_topk(reg).first()
    assert top.execution_rate == pytest.approx(12 / 17, abs=1e-6) and top.avg_bleu == 0.4
    assert top.score == pytest.approx(0.7 * 12 / 17 + 0.3 * 0.4, abs=1e-6)


def test_q11_report_division_is_guarded(spark):
    """Q11: a zero total gives a 0 rate, not an error (ANSI division raises)."""
    df = spark.createDataFrame([(0, 0)], "ok long, total long")
    assert df.select(T.safe_rate("ok", "total").alias("r")).first().r == 0.0


def test_q13_short_conversations_are_filtered_not_misaligned(spark):
    """Q13: P5 drops conversations without both roles as rows, so texts stay
    aligned with their conversations."""
    m = messages_df(spark, [(1, 0, "human", "only"), (2, 0, "human", "q"), (2, 1, "assistant", "a")])
    assert [tuple(r) for r in P.pair_first_of_role(m).collect()] == [(2, "q", "a")]


def test_q4_counts_follow_the_processing_loop(spark):
    """Q2/Q4: ledger semantics follow the processing loop -- a skipped pair
    still counts in total_snippets (R1)."""
    from codeeval.operators import verdicts as V
    verdicted = spark.createDataFrame([(1, True, True)], "conv_id long, executed boolean, success boolean")
    skipped = spark.createDataFrame([(1,)], "conv_id long")
    r = V.execution_rate(verdicted, skipped=skipped).first()
    assert (r.successful_runs, r.total_snippets) == (1, 2)
