"""G1-G3, R6-R8, W1-W8, edits."""

import hashlib

import pytest
from pyspark.sql import functions as F

from codeeval.operators import edits as E
from codeeval.operators import history as H
from codeeval.operators import registry as G
from tests.conftest import messages_df


def _registry(spark, rows):
    # (seq, hash, size, bleu, ok, total)
    df = spark.createDataFrame(rows, "seq long, model_hash string, train_dataset_size int, avg_bleu double, ok int, total int")
    return df.select("seq", "model_hash", "train_dataset_size", "avg_bleu",
                     F.struct(F.col("ok").alias("successful_runs"), F.col("total").alias("total_snippets"))
                     .alias("execution_check"))


ROWS = [(0, "h0", 48, 0.30, 5, 17), (1, "h1", 48, 0.35, 7, 17), (2, "h2", 48, 0.40, 7, 17),
        (3, "h3", 90, 0.39, 8, 17), (4, "h4", 265, 0.44, 12, 17), (5, "h5", 265, 0.38, 12, 17),
        (6, "h6", 90, 0.10, 0, 0)]


def test_config_hash_matches_python_format(spark):
    df = spark.createDataFrame([(2, "0.0002", 1, -1, 265, 17, 64, 512, "0")],
                               "b int, lr string, e int, m int, tr int, te int, r int, a int, d string")
    h = df.select(G.config_hash(*[F.col(c) for c in df.columns]).alias("h")).first().h
    s = "batch_size=2-lr=0.0002-epochs=1-max_steps=-1-train_size=265-test_size=17-lora_rank=64-lora_alpha=512-lora_dropout=0"
    assert h == hashlib.sha256(s.encode()).hexdigest()


def test_best_run_ties_keep_file_order(spark):
    best = {r.train_dataset_size: r.model_hash for r in G.best_run_per_size(_registry(spark, ROWS)).collect()}
    assert best == {48: "h2", 90: "h3", 265: "h4"}


def test_size_statistics_and_zero_total(spark):
    st = {r.train_dataset_size: r for r in G.size_statistics(_registry(spark, ROWS)).collect()}
    assert st[48].num_models == 3 and st[48].max_rate == pytest.approx(7 / 17, abs=1e-6)
    assert st[90].min_rate == 0.0                   # zero total snippets -> rate 0, no error


def test_performance_trend(spark):
    tr = {r.train_dataset_size: r for r in G.performance_trend(_registry(spark, ROWS)).collect()}
    assert tr[48].prev_size is None
    assert tr[90].delta_size == 42 and tr[90].delta_rate == pytest.approx(8 / 17 - 7 / 17, abs=1e-6)
    assert [s for s, r in tr.items() if r.is_best_size] == [265]


def test_trial_topk(spark):
    top = G.trial_score_topk(_registry(spark, ROWS), k=1).first()
    assert top.model_hash == "h4"


def test_registry_append_twice_is_once(spark):
    reg = _registry(spark, ROWS[:2])
    batch = _registry(spark, [(10, "h1", 48, 0.9, 1, 1), (11, "hx", 48, 0.1, 1, 1), (12, "hx", 48, 0.2, 1, 1)])
    once = G.registry_append(reg, batch)
    twice = G.registry_append(once, batch)
    assert sorted(r.model_hash for r in once.collect()) == ["h0", "h1", "hx"]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert {r.model_hash: r.seq for r in once.collect()}["hx"] == 2
    assert [r.avg_bleu for r in once.collect() if r.model_hash == "hx"] == [0.1]


def test_loss_smoothing_matches_reference_rule(spark):
    import numpy as np
    vals = [3.0, 2.0, 2.5, 1.0, 0.5, 0.7, 0.2, 0.9]
    rows = [("r", i + 1, v) for i, v in enumerate(vals)] + [("short", i + 1, v) for i, v in enumerate(vals[:5])]
    df = spark.createDataFrame(rows, "run_id string, step long, loss double")
    got = {(r.run_id, r.step): r.smoothed for r in H.loss_smoothing(df).collect()}
    for i in range(len(vals)):
        want = np.mean(vals[: i + 1]) if i < 5 else np.mean(vals[i - 4: i + 1])
        assert got[("r", i + 1)] == pytest.approx(want)
    assert all(got[("short", i + 1)] is None for i in range(5))


def test_trailing_mean_across_blocks(spark):
    from codeeval.operators.ordinals import trailing_mean
    rows = [("r", i + 1, float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "run_id string, step long, loss double")
    got = {r.step: r.sm for r in trailing_mean(df, ["run_id"], "step", "loss", 5, out="sm", block=7).collect()}
    for s in range(1, 51):
        lo = max(0, s - 5)
        assert got[s] == pytest.approx(sum(range(lo, s)) / (s - lo))


def test_rank_within_blocks(spark):
    from codeeval.operators.ordinals import rank_within
    rows = [(1, t) for t in range(0, 300, 3)] + [(2, 5)]
    df = spark.createDataFrame(rows, "g long, t long")
    got = {(r.g, r.t): r.rank for r in rank_within(df, ["g"], "t", block=16).collect()}
    assert [got[(1, t)] for t in range(0, 300, 3)] == list(range(100)) and got[(2, 5)] == 0


def test_number_steps_skips_missing_values(spark):
    df = spark.createDataFrame([("r", 3, 1.0), ("r", 1, None), ("r", 2, 2.0)], "run_id string, t long, loss double")
    got = {r.t: r.step for r in H.number_steps(df, "run_id", ["t"], "loss").collect()}
    assert got == {2: 1, 3: 2}


def test_trim_keeps_a_prefix(spark):
    m = messages_df(spark, [(c, t, "human", f"{c}-{t}") for c in (3, 7, 9, 12) for t in (0, 1)])
    assert sorted({r.conv_id for r in E.trim_first_n(m, 2).collect()}) == [3, 7]


def test_batch_edits(spark):
    m = messages_df(spark, [(0, 0, "human", "a"), (0, 1, "assistant", "b"), (0, 2, "human", "c"),
                            (1, 0, "human", "d"), (1, 1, "assistant", "e")])
    upd = spark.createDataFrame([(0, " new ", "resp"), (1, "", "x")], "conv_id long, prompt string, response string")
    dels = spark.createDataFrame([(1,)], "conv_id long")
    adds = spark.createDataFrame([(5, "p5", "r5"), (2, "p2", "r2"), (9, " ", "r")], "edit_seq long, prompt string, response string")
    out = sorted(tuple(r) for r in E.batch_edits(m, adds=adds, updates=upd, deletes=dels).collect())
    assert out == [(0, 0, "human", "new"), (0, 1, "assistant", "resp"),
                   (2, 0, "human", "p2"), (2, 1, "assistant", "r2"),
                   (3, 0, "human", "p5"), (3, 1, "assistant", "r5")]


def test_keyword_search_rejects_blank(spark):
    m = messages_df(spark, [(0, 0, "human", "Hello World"), (0, 1, "assistant", "x"),
                            (1, 0, "human", "nothing"), (1, 1, "assistant", "WORLD peace")])
    assert sorted(r.conv_id for r in E.keyword_search(m, "  world ").collect()) == [0, 1]
    assert E.keyword_search(m, "wor%").count() == 0
    with pytest.raises(ValueError):
        E.keyword_search(m, "   ")


def test_history_from_arrays_skips_runs_without_history(spark):
    rows = [("a", {"loss": [1.0, 0.5, 0.25], "learning_rate": [1e-4, 9e-5]}), ("b", None)]
    df = spark.createDataFrame(rows, "run_id string, metrics_history struct<loss:array<double>,learning_rate:array<double>>")
    got = sorted(tuple(r) for r in H.history_from_arrays(df).collect())
    assert got == [("a", 1, 1.0, 1e-4), ("a", 2, 0.5, 9e-5), ("a", 3, 0.25, None)]


def test_running_sum_within_blocks(spark):
    from codeeval.operators.ordinals import running_sum_within
    rows = [(1, t, t * 2) for t in range(40)] + [(2, 0, 5)]
    df = spark.createDataFrame(rows, "g long, t long, v long")
    inc = {(r.g, r.t): r.s for r in running_sum_within(df, ["g"], "t", "v", "s", block=7).collect()}
    exc = {(r.g, r.t): r.s for r in running_sum_within(df, ["g"], "t", "v", "s", inclusive=False, block=7).collect()}
    for t in range(40):
        assert inc[(1, t)] == sum(2 * x for x in range(t + 1))
        assert exc[(1, t)] == sum(2 * x for x in range(t))
    assert inc[(2, 0)] == 5 and exc[(2, 0)] == 0


def test_rank_in_order_spreads_one_group(spark):
    from codeeval.operators.ordinals import rank_in_order
    df = spark.range(4000).selectExpr("if(id % 500 = 1, 1, 0) AS g", "cast((id * 7919) % 4001 AS double) AS t", "id")
    got = {}
    for r in rank_in_order(df, ["g"], ["t", "id"], partitions=16).collect():
        got.setdefault(r.g, []).append((r.t, r.id, r["rank"]))
    for rows in got.values():
        assert [r[2] for r in sorted(rows)] == list(range(len(rows)))


def test_each_series_is_numbered_on_its_own(spark):
    df = spark.createDataFrame([("a", 1, 0.5, None), ("a", 2, None, 1e-4), ("a", 3, 0.4, 1e-5), ("b", 1, 0.9, None)],
                               "run_id string, ts long, loss double, learning_rate double")
    loss = sorted((r.run_id, r.step, r.loss) for r in H.number_steps(df, "run_id", ["ts"], "loss").collect())
    rate = sorted((r.run_id, r.step, r.learning_rate) for r in H.number_steps(df, "run_id", ["ts"], "learning_rate").collect())
    assert loss == [("a", 1, 0.5), ("a", 2, 0.4), ("b", 1, 0.9)] and rate == [("a", 1, 1e-4), ("a", 2, 1e-5)]
    history = H.number_steps(df, "run_id", ["ts"], "loss")
    assert sorted(map(tuple, H.aligned_series(history, ["b"]).collect())) == [(1, "b", 0.9)]


def test_trim_rejects_more_than_there_is(spark):
    from codeeval.operators.edits import trim_first_n
    m = spark.createDataFrame([(3, 0, "human", "x"), (9, 0, "human", "y")], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in trim_first_n(m, 1).collect()] == [3]
    for n in (0, 3, 99):
        with pytest.raises(ValueError):
            trim_first_n(m, n)
