"""I4/S2 as a folder of text files, and I6 as metric files."""

import json
import os

import pytest

from codeeval.operators import history as H
from codeeval.sources import named_files as N
from codeeval.sources import readers as R


def pairs(spark, rows):
    return spark.createDataFrame(rows, "idx long, prompt string, code string").repartition(3)


def test_reads_a_folder_as_it_was_written_by_hand(spark, tmp_path):
    code = 'object HelloWorld {\n  def main(args: Array[String]): Unit = {\n    println("Hello")\n  }\n}\n'
    for name, text in {"prompt_1.txt": "Write a program.", "code_1.txt": code, "code_2.txt": code, "prompt_10.txt": " 　ten\r\nlines\r",
                       "prompt_3.txt": " \n", "code_3.txt": "", "prompt_02.txt": "other two", "notes.txt": "x", "code_x.txt": "y",
                       "prompt_4.txt.bak": "z", "code_5.scala": "w"}.items():
        (tmp_path / name).write_bytes(text.encode())
    os.mkdir(tmp_path / "prompt_9.txt")
    got = N.read_pair_files(spark, str(tmp_path), pairs_per_partition=2)
    assert got.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, got.collect())) == [(1, "Write a program.", code.strip()), (2, "", code.strip()),
                                                 (2, "other two", ""), (10, "ten\nlines", "")]


def test_round_trip_and_modes(spark, tmp_path):
    folder = str(tmp_path / "out" / "folder")
    N.write_pair_files(pairs(spark, [(i, f"p{i} é", None if i % 3 == 0 else f"c{i}") for i in range(1, 30)]), folder)
    assert os.path.exists(f"{folder}/_SUCCESS") and not [n for n in os.listdir(folder) if n.startswith(".")]
    assert open(f"{folder}/prompt_7.txt", encoding="utf-8").read() == "p7 é" and not os.path.exists(f"{folder}/code_3.txt")
    assert {r.idx: (r.prompt, r.code) for r in N.read_pair_files(spark, "file://" + folder).collect()} == {
        i: (f"p{i} é", "" if i % 3 == 0 else f"c{i}") for i in range(1, 30)}
    open(f"{folder}/notes.txt", "w").write("kept")
    N.write_pair_files(pairs(spark, [(1, "new", "new"), (99, "p", "c")]), folder, mode="append")
    assert N.read_pair_files(spark, folder).count() == 30
    N.write_pair_files(pairs(spark, [(5, "only", "one")]), folder)
    assert [tuple(r) for r in N.read_pair_files(spark, folder).collect()] == [(5, "only", "one")]
    assert sorted(os.listdir(folder)) == ["_SUCCESS", "code_5.txt", "notes.txt", "prompt_5.txt"]


def test_empty_missing_and_bad(spark, tmp_path):
    folder = str(tmp_path / "none")
    N.write_pair_files(pairs(spark, []), folder)
    assert N.read_pair_files(spark, folder).count() == 0
    with pytest.raises(Exception, match="not found|No such|does not exist|cannot"):
        N.read_pair_files(spark, str(tmp_path / "missing")).count()
    with pytest.raises(Exception, match="without an index"):
        N.write_pair_files(pairs(spark, [(None, "p", "c")]), folder)
    with pytest.raises(Exception, match="not a file name"):
        N.write_named_files(spark.createDataFrame([("../up", "x")], "name string, content string"), folder, "x")
    (tmp_path / "none" / "prompt_1.txt").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="decode"):
        N.read_pair_files(spark, folder).count()


def test_agrees_with_the_reader_for_any_store(spark, tmp_path):
    folder = str(tmp_path / "both")
    N.write_pair_files(pairs(spark, [(3, " a ", "b"), (1, None, "c"), (2, "", " ")]), folder)
    assert sorted(map(tuple, N.read_pair_files(spark, folder).collect())) == sorted(
        map(tuple, R.read_pair_folder(spark, folder).collect())) == [(1, "", "c"), (3, "a", "b")]


def test_metric_files(spark, tmp_path):
    runs = spark.createDataFrame(
        [("r1", 1.5, ([0.5, 0.25], [0.1])), ("r2", 2.0, ([], [])), ("r3", 3.0, None)],
        "run_id string, training_time_seconds double, metrics_history struct<loss:array<double>,learning_rate:array<double>>")
    folder = str(tmp_path / "runs")
    N.write_metric_history(runs, folder)
    assert json.load(open(f"{folder}/r1/training_metrics.json")) == {
        "training_time_seconds": 1.5, "metrics_history": {"loss": [0.5, 0.25], "learning_rate": [0.1]}}
    got = H.history_from_arrays(R.read_metric_history(spark, f"{folder}/*/training_metrics.json"))
    assert sorted(map(tuple, got.collect())) == [("r1", 1, 0.5, 0.1), ("r1", 2, 0.25, None)]
