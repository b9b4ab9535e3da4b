"""J1-J5, R1, R3 and the streaming dedup."""

import pytest

from codeeval.operators import dedup as D
from codeeval.operators import verdicts as V
from codeeval.session import scratch_path
from codeeval.streaming.dedup import SNIPPET_DDL, dedup_stream_once

PAIRS = [(1, 0, "p", "c"), (1, 1, "p", "c"), (2, 0, "ab", ""), (3, 0, "a", "b"), (4, 0, "q", "z")]


def _pairs(spark):
    df = spark.createDataFrame(PAIRS, "conv_id long, k long, prompt string, code string")
    return D.with_snippet_hash(df)


def test_dedup_keeps_first_and_honours_ledger(spark):
    hp = _pairs(spark)
    ledger = hp.filter("conv_id = 4").select("snippet_hash")
    kept = sorted((r.conv_id, r.k) for r in D.dedup_ledger(hp, ledger).collect())
    # (1,1) repeats (1,0); (3,0) collides with (2,0) by construction of the hash; 4 is in the ledger
    assert kept == [(1, 0), (2, 0)]


def test_dedup_is_idempotent(spark):
    hp = _pairs(spark)
    once = D.dedup_ledger(hp, None)
    twice = D.dedup_ledger(once.select(*hp.columns), None)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.select(*once.columns).collect()))


def test_ledger_update_and_anti_join(spark):
    hp = _pairs(spark)
    new_ledger = D.ledger_update(None, hp)
    assert D.dedup_ledger(hp, new_ledger).count() == 0


def test_dedup_against_main(spark):
    main = spark.createDataFrame([(10, 0, "human", "p"), (10, 1, "assistant", None)],
                                 "conv_id long, turn long, role string, text string")
    pairs = spark.createDataFrame([(1, 0, "p", "x"), (2, 0, "q", "p"), (3, 0, "q", None), (4, 0, "r", "s")],
                                  "conv_id long, k long, prompt string, code string")
    kept = sorted(r.conv_id for r in D.dedup_against_main(pairs, main).collect())
    assert kept == [3, 4]           # a null never matches
    prefixed = spark.createDataFrame([(11, 0, "human", "Human: q")], "conv_id long, turn long, role string, text string")
    assert sorted(r.conv_id for r in D.dedup_against_main(pairs, prefixed).collect()) == [1, 2, 3, 4]
    assert sorted(r.conv_id for r in D.dedup_against_main(pairs, prefixed, prefixed=True).collect()) == [1, 4]
    plan = D.dedup_against_main(pairs, main)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan


def test_append_working_numbers_after_main(spark):
    main = spark.createDataFrame([(5, 0, "human", "m"), (5, 1, "assistant", "n")],
                                 "conv_id long, turn long, role string, text string")
    passing = spark.createDataFrame([(8, 0, "p1", "c1"), (7, 0, "p2", "c2"), (9, 0, "m", "c3")],
                                    "conv_id long, k long, prompt string, code string")
    out = sorted(tuple(r) for r in D.append_working(main, passing).collect())
    assert (6, 0, "human", "p2") in out and (7, 0, "human", "p1") in out
    assert not any(r[3] == "c3" for r in out)      # duplicate of a main value
    empty = main.limit(0)
    assert D.append_working(empty, passing).count() == 0


def test_append_working_keeps_pairs_of_one_conversation_apart(spark):
    main = spark.createDataFrame([(5, 0, "human", "m")], "conv_id long, turn long, role string, text string")
    passing = spark.createDataFrame([(8, 1, "p2", "c2"), (8, 0, "p1", "c1"), (7, 3, "p0", "c0")],
                                    "conv_id long, k long, prompt string, code string")
    out = sorted(tuple(r) for r in D.append_working(main, passing).collect() if r.conv_id > 5)
    assert out == [(6, 0, "human", "p0"), (6, 1, "assistant", "c0"), (7, 0, "human", "p1"), (7, 1, "assistant", "c1"),
                   (8, 0, "human", "p2"), (8, 1, "assistant", "c2")]
    stored = [r.text for r in D.append_working(main, passing, prefixed=True).collect() if r.conv_id > 5 and r.turn == 0]
    assert sorted(stored) == ["Human: p0", "Human: p1", "Human: p2"]
    with pytest.raises(Exception, match="occurs twice"):
        D.append_working(main, passing.withColumn("k", passing.k * 0)).collect()


def test_pairs_without_a_hash_are_all_processed(spark):
    df = spark.createDataFrame([(1, 0, None, "c"), (2, 0, None, "d"), (3, 0, "p", "c")],
                               "conv_id long, k long, prompt string, code string")
    hp = D.with_snippet_hash(df)
    assert sorted(r.conv_id for r in D.dedup_ledger(hp, hp.filter("conv_id = 3").select("snippet_hash")).collect()) == [1, 2]


def test_keep_first_aggregates_no_text(spark):
    plan = D.dedup_ledger(_pairs(spark), None)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        assert not ("SortAggregate" in line and ("prompt" in line or "code" in line)), line


def test_execution_rate_once(spark):
    pairs = D.with_snippet_hash(spark.createDataFrame(
        [(1, 0, "p", "c"), (1, 1, "p", "c"), (2, 0, "p", "c"), (2, 1, "q", " "), (3, 0, "x", "bad"), (4, 0, None, "z")],
        "conv_id long, k long, prompt string, code string").selectExpr("*", "conv_id * 10 + k AS doc_id"))
    v = spark.createDataFrame([(10, True, True), (20, True, False), (30, False, True), (40, True, True)],
                              "doc_id long, build_ok boolean, run_ok boolean")
    df = V.execution_rate_once(pairs, v, ["doc_id"])
    r = df.first()
    assert (r.successful_runs, r.total_snippets, r.executed_snippets, r.conversations) == (2, 6, 4, 4)


def test_verdicts_do_not_move_text_that_is_not_asked_for(spark, tmp_path):
    spark.range(100).selectExpr("id AS doc_id", "repeat('x', 50) AS code").write.parquet(str(tmp_path / "p"))
    v = spark.createDataFrame([(1, True, "", True, "ok")],
                              "doc_id long, build_ok boolean, build_message string, run_ok boolean, run_message string")
    out = V.apply_verdicts(spark.read.parquet(str(tmp_path / "p")), v.hint("merge"), ["doc_id"]).select("doc_id", "success")
    node = out._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().head()
    moved = node.left().output().mkString(" ")
    assert "_blank" in moved and "code" not in moved      # decided before the join, where the text is read


def test_apply_verdicts_precedence(spark):
    pairs = spark.createDataFrame([(1, " "), (2, "code"), (3, "code"), (4, "code")], "doc_id long, code string")
    v = spark.createDataFrame([(1, True, "", True, "ok"), (2, False, "boom\n", True, "ok"),
                               (3, True, "", False, "crash")],
                              "doc_id long, build_ok boolean, build_message string, run_ok boolean, run_message string")
    got = {r.doc_id: (r.executed, r.success, r.message)
           for r in V.apply_verdicts(pairs, v, ["doc_id"]).collect()}
    assert got[1] == (True, False, "No code provided")
    assert got[2] == (True, False, "Build failed: boom\n")
    assert got[3] == (True, False, "crash")
    assert got[4] == (False, None, None)
    no_run = {r.doc_id: r.message for r in V.apply_verdicts(pairs, v, ["doc_id"], run=False).collect()}
    assert no_run[3] == "Code written successfully"


def test_execution_rate_counts_skipped(spark):
    verdicted = spark.createDataFrame([(1, True, True), (2, True, False)], "conv_id long, executed boolean, success boolean")
    skipped = spark.createDataFrame([(3,)], "conv_id long")
    r = V.execution_rate(verdicted, skipped=skipped).first()
    assert (r.successful_runs, r.total_snippets, r.executed_snippets, r.conversations) == (1, 3, 2, 3)
    assert r.success_rate == pytest.approx(1 / 3, abs=1e-6)


def test_dedup_stream_second_run_emits_nothing_new(spark):
    hp = _pairs(spark).select("snippet_hash", "conv_id", "k")
    incoming, sink, ckpt = (scratch_path(spark, x) for x in ("in", "sink", "ckpt"))
    hp.limit(2).write.mode("append").parquet(incoming)
    dedup_stream_once(spark, incoming, sink, ckpt)
    first = spark.read.schema(SNIPPET_DDL).parquet(sink).count()
    hp.write.mode("append").parquet(incoming)       # repeats batch 1 plus new rows
    dedup_stream_once(spark, incoming, sink, ckpt)
    total = spark.read.schema(SNIPPET_DDL).parquet(sink)
    assert total.count() == hp.select("snippet_hash").distinct().count()
    assert total.select("snippet_hash").distinct().count() == total.count()
    assert first >= 1
    dedup_stream_once(spark, incoming, sink, ckpt)   # nothing new arrived
    assert spark.read.schema(SNIPPET_DDL).parquet(sink).count() == total.count()


def test_dedup_stream_takes_the_first_in_order_and_knows_the_seed(spark):
    from codeeval.streaming.dedup import ledger_from_state, run_dedup_stream
    ddl = "snippet_hash string, conv_id long, k long"
    one = spark.createDataFrame([("a", 5, 1), ("a", 5, 0), ("b", 9, 0), ("s", 1, 0), (None, 3, 0)], ddl)
    two = spark.createDataFrame([("a", 1, 0), ("c", 8, 2), ("c", 7, 3), ("c", 7, 4), ("t", 2, 0)], ddl)
    seed = spark.createDataFrame([("s",), ("t",), ("u",), ("s",), (None,)], "snippet_hash string")
    out, checkpoint = run_dedup_stream(spark, [one, two, two], seed)
    # an earlier run's first pair stays, whatever its order; the seed is never emitted
    assert sorted(map(tuple, out.collect())) == [("a", 5, 0), ("b", 9, 0), ("c", 7, 3)]
    assert sorted(r[0] for r in ledger_from_state(spark, checkpoint).collect()) == ["a", "b", "c", "s", "t", "u"]


def test_dedup_stream_to_ledger(spark):
    from codeeval.sources.readers import read_ledger
    from codeeval.streaming.dedup import dedup_stream_to_ledger
    hp = _pairs(spark).select("snippet_hash", "conv_id", "k")
    incoming, ledger, ckpt = (scratch_path(spark, x) for x in ("in2", "ledger2", "ckpt2"))
    seen = []
    hp.limit(2).write.mode("append").parquet(incoming)
    dedup_stream_to_ledger(spark, incoming, ledger, ckpt, on_new=lambda df, e: seen.append(df.count()))
    hp.write.mode("append").parquet(incoming)
    dedup_stream_to_ledger(spark, incoming, ledger, ckpt, on_new=lambda df, e: seen.append(df.count()))
    n_distinct = hp.select("snippet_hash").distinct().count()
    assert sum(seen) == n_distinct
    assert read_ledger(spark, ledger).distinct().count() == n_distinct


def test_execution_rate_counts_dataset_conversations(spark):
    verdicted = spark.createDataFrame([(1, True, True)], "conv_id long, executed boolean, success boolean")
    dataset = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "conv_id long, turn long")   # 2 and 3 yield no pair
    r = V.execution_rate(verdicted, dataset=dataset).first()
    assert (r.successful_runs, r.total_snippets, r.conversations) == (1, 1, 3)
