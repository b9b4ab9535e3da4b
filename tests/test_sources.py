"""I1-I6 readers and S1-S7 writers: round trips and the legacy layouts."""

import json
import os

import pytest
from pyspark.sql import functions as F

from codeeval.plans import catalog
from codeeval.session import scratch_path
from codeeval.sources import readers as R
from codeeval.sources import writers as W
from tests.conftest import messages_df

ROWS = [(0, 0, "human", "q0"), (0, 1, "assistant", "a0"), (1, 0, "human", "q1"), (1, 1, "assistant", "a1"),
        (2, 0, "human", "q2")]


def test_jsonl_round_trip_keeps_order(spark):
    path = scratch_path(spark, "t-jsonl")
    m = messages_df(spark, ROWS)
    W.write_conversations(m, path)
    back = R.read_conversations_jsonl(spark, path)
    got = {r.conv_id: [x["value"] for x in r.conversations] for r in back.collect()}
    assert got == {0: ["q0", "a0"], 1: ["q1", "a1"], 2: ["q2"]}


def test_legacy_array_and_eval_document(spark, tmp_path):
    arr = [{"conversations": [{"from": "human", "value": "x"}, {"from": "gpt", "value": "y"}]},
           {"other": 1},
           {"conversations": [{"from": "human", "value": "z"}]}]
    (tmp_path / "a.json").write_text(json.dumps(arr, indent=2))
    got = {r.conv_id: [m["value"] for m in r.conversations]
           for r in R.read_conversations_array(spark, str(tmp_path / "a.json")).collect()}
    assert got == {0: ["x", "y"], 1: [], 2: ["z"]}        # missing conversations -> empty list
    doc = {"timestamp": "t", "average_metrics": {"bleu": 0.5}, "training_dataset_size": 3,
           "detailed_results": [{"reference": "r", "generated": "user\n\np\nassistant\n\nc", "bleu": 0.5}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    conv = R.read_conversations_array(spark, str(tmp_path / "d.json")).first()
    assert [(m["from"], m["value"]) for m in conv.conversations] == [("assistant", "user\n\np\nassistant\n\nc")]
    ev = R.read_eval_documents(spark, str(tmp_path / "d.json"), multiline=True).first()
    assert (ev.prompt, ev.code, ev.idx) == ("p", "c", 0)


def test_pair_folder_text_layout(spark, tmp_path):
    files = {"prompt_1.txt": " p1 \n", "code_1.txt": "c1", "prompt_2.txt": "p2", "code_10.txt": "c10",
             "prompt_3.txt": "  ", "code_3.txt": "\n", "notes.txt": "ignored", "code_x.txt": "bad"}
    for name, content in files.items():
        (tmp_path / name).write_text(content)
    got = sorted(tuple(r) for r in R.read_pair_folder(spark, str(tmp_path)).collect())
    assert got == [(1, "p1", "c1"), (2, "p2", ""), (10, "", "c10")]


def test_pairs_long_form_round_trip(spark):
    pairs = spark.createDataFrame([(1, "p", "c"), (2, "", "only code")], "idx long, prompt string, code string")
    path = scratch_path(spark, "t-long")
    W.write_pairs_long(pairs, path)
    assert sorted(tuple(r) for r in R.read_pairs_long(spark, path).collect()) == [(1, "p", "c"), (2, "", "only code")]


def test_missing_ledger_is_empty(spark):
    assert R.read_ledger(spark, scratch_path(spark, "nope")).count() == 0


def test_ledger_append_only(spark):
    path = scratch_path(spark, "t-ledger")
    h = spark.createDataFrame([("a",), ("b",), ("a",)], "snippet_hash string")
    W.append_ledger(h, path)
    W.append_ledger(spark.createDataFrame([("c",)], "snippet_hash string"), path)
    assert sorted(r.snippet_hash for r in R.read_ledger(spark, path).collect()) == ["a", "b", "c"]


def test_report_written_in_order(spark):
    from codeeval.operators.prompts import report_lines
    res = spark.createDataFrame([(0, "Zero shot", 0.03125, 1, 1), (1, "ReAct", 0.5, 0, 1), (2, "Zero shot", 0.0, 0, 1)],
                                "seq long, variation_name string, bleu double, successful_runs long, total_runs long")
    path = scratch_path(spark, "t-report")
    W.write_report(report_lines(res), path)
    text = "".join(open(os.path.join(path, f)).read() for f in sorted(os.listdir(path)) if f.startswith("part-"))
    assert text.startswith("# Evaluation Final Report\n\n## Summary\nTotal running code snippets: 1/3\n")
    assert "### Zero shot\n- Average BLEU Score: 0.0156\n- Success Rate: 50.00% (1/2 snippets)\n" in text
    assert text.index("### Zero shot") < text.index("### ReAct")


def test_failing_snippets_reader_drops_corrupt(spark, tmp_path):
    (tmp_path / "f.json").write_text("{not json")
    assert R.read_failing_snippets(spark, str(tmp_path / "f.json")).count() == 0


def test_eval_document_round_trip(spark):
    scored = spark.createDataFrame([("r1", "g1", 0.5), ("r2", "g2", 0.25)], "reference string, generated string, bleu double")
    path = scratch_path(spark, "t-evaldoc")
    W.write_eval_document(scored, path, 265, "2025-01-01T00:00:00")
    summary = spark.read.json(f"{path}/summary").first()
    assert summary.average_metrics.bleu == 0.375 and summary.training_dataset_size == 265
    back = R.read_eval_folder(spark, path).orderBy("reference").collect()
    assert [(r.reference, r.generated, r.bleu, r.training_dataset_size) for r in back] == \
        [("r1", "g1", 0.5, 265), ("r2", "g2", 0.25, 265)]


def test_legacy_registry_array_gets_file_order(spark, tmp_path):
    from codeeval.operators.registry import best_run_per_size
    recs = [{"model_hash": h, "train_dataset_size": 48, "avg_bleu": 0.3,
             "execution_check": {"successful_runs": ok, "total_snippets": 17}, "lora_rank": 64,
             "target_modules": ["q_proj", "v_proj"]} for h, ok in (("a", 5), ("b", 7), ("c", 7))]
    (tmp_path / "trained_models.json").write_text(json.dumps(recs, indent=2))
    reg = R.read_registry(spark, str(tmp_path / "trained_models.json"))
    assert sorted((r.seq, r.model_hash) for r in reg.collect()) == [(0, "a"), (1, "b"), (2, "c")]
    assert best_run_per_size(reg).first().model_hash == "b"     # tie with "c": file order wins


def test_arrays_of_several_files_are_numbered_on(spark, tmp_path):
    conv = lambda *texts: [{"conversations": [{"from": "human", "value": t}]} for t in texts]
    (tmp_path / "part-99999.json").write_text(json.dumps(conv("a", "b")))
    (tmp_path / "part-100000.json").write_text(json.dumps(conv("c")))
    (tmp_path / "part-100001.json").write_text("[{broken")
    (tmp_path / "part-100002.json").write_text(json.dumps(conv("d")))
    rows = R.read_conversations_array(spark, str(tmp_path)).orderBy("conv_id").collect()
    assert [(r.conv_id, [m["value"] for m in r.conversations]) for r in rows] == \
        [(0, ["a"]), (1, ["b"]), (2, ["c"]), (3, []), (4, ["d"])]
    assert [r._corrupt_record for r in rows] == [None, None, None, "[{broken", None]
    with pytest.raises(Exception, match="not a registry"):
        R.read_registry(spark, str(tmp_path / "part-100001.json")).collect()


def test_legacy_arrays_grow_in_number_not_size(spark, tmp_path, monkeypatch):
    n = 6000
    rows = [(i * 7919 % n, t, r, f"{i}-{t}") for i in range(n) for t, r in enumerate(("user", "assistant"))]
    rows.append((None, 0, "user", "no id"))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet"))
    paths, read = [], R.read_conversations_array
    monkeypatch.setattr(R, "read_conversations_array", lambda s, path: paths.append(path) or read(s, path))
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        back = catalog.ingest_conversations_array(spark, str(tmp_path))
        got = sorted((r.conv_id, r.turn, r.text) for r in back.collect())
    finally:
        spark.conf.set(coalesce, "true")
    assert got == sorted((0 if i is None else i + 1, t, text) for i, t, _, text in rows)   # null comes first
    files = spark.read.text(paths[0], wholetext=True).selectExpr(
        "regexp_extract(_metadata.file_name, '^part-([0-9]+)', 1) AS task", "json_array_length(value) AS size").collect()
    sizes = [f["size"] for f in files if f["size"] is not None]
    assert sum(sizes) == n + 1 and max(sizes) <= 1000
    assert len({f.task for f in files}) > 1


def test_json_lines_follow_part_numbers(spark, tmp_path):
    for n, t in ((100000, "late"), (99999, "early")):
        (tmp_path / f"part-{n}.json").write_text(json.dumps({"conversations": [{"from": "human", "value": t}]}) + "\n")
    got = {r.conv_id: r.conversations[0]["value"] for r in R.read_conversations_jsonl(spark, str(tmp_path)).collect()}
    assert got == {0: "early", 1: "late"}


def test_only_a_missing_ledger_is_empty(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        R.read_ledger(spark, str(tmp_path / "l")).collect()


def test_metric_history_run_folders(spark, tmp_path):
    from codeeval.operators.history import history_from_arrays, loss_smoothing
    for run, hist in (("trial_a", {"loss": [3.0, 2.0, 1.0, 0.5, 0.4, 0.3], "learning_rate": [1e-4] * 6}),
                      ("trial_b", None)):
        (tmp_path / run).mkdir()
        body = {"training_time_seconds": 1.5, "training_stats": {"x": 1}}
        if hist is not None:
            body["metrics_history"] = hist
        (tmp_path / run / "training_metrics.json").write_text(json.dumps(body, indent=2))
    runs = R.read_metric_history(spark, str(tmp_path / "*" / "training_metrics.json"))
    assert [r.run_id for r in runs.collect()] == ["trial_a"]
    sm = {r.step: r.smoothed for r in loss_smoothing(history_from_arrays(runs)).collect()}
    assert sm[6] == pytest.approx((2.0 + 1.0 + 0.5 + 0.4 + 0.3) / 5)


def test_evaluation_document_scores_once(spark, tmp_path):
    """The average belongs to the results that were written, not to a second scoring."""
    import random
    score = F.udf(lambda: random.random(), "double").asNondeterministic()
    scored = spark.range(20).select(F.lit("r").alias("reference"), F.lit("g").alias("generated"), score().alias("bleu"))
    path = str(tmp_path / "doc")
    W.write_eval_document(scored, path, 3, "t")
    mean = spark.read.json(f"{path}/detailed_results").agg(F.avg("bleu")).first()[0]
    assert spark.read.json(f"{path}/summary").first().average_metrics.bleu == pytest.approx(mean, abs=1e-12)
