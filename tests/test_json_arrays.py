"""Single JSON arrays of any size, split anywhere."""

import json
import random

import pytest

from codeeval.sources import readers as R
from codeeval.sources import writers as W

PIECES = ["", "}", "{", "]", "[", '"', "\\", '\\"', "},{", "}\n]", "a", "é", "\n", "\t", " ", "😀", '{"x": [1}', ", ", "\\u007d"]


def odd_text(rng):
    return "".join(rng.choice(PIECES) for _ in range(rng.randrange(8)))


def conversations(rng, n):
    return [{"conversations": [{"from": odd_text(rng), "value": odd_text(rng)} for _ in range(rng.randrange(4))]} for _ in range(n)]


def values(rows):
    return {r.conv_id: [(m["from"], m["value"]) for m in r.conversations] for r in rows}


def wanted(records):
    return {i: [(m["from"], m["value"]) for m in c["conversations"]] for i, c in enumerate(records)}


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "997", "spark.sql.files.openCostInBytes": "0",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("form", ({"indent": 2}, {}, {"ensure_ascii": False, "indent": 1}, {"separators": (",", ":")}))
def test_an_array_is_read_by_several_tasks(spark, tmp_path, small_splits, form):
    records = conversations(random.Random(str(form)), 60)
    (tmp_path / "a.json").write_text(json.dumps(records, **form), encoding="utf-8")
    path = str(tmp_path / "a.json")
    assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 4
    assert values(R.read_conversations_array(spark, path).collect()) == wanted(records)


def test_records_longer_than_splits(spark, tmp_path, small_splits):
    records = [{"conversations": [{"from": "human", "value": ("}{\"[" * 700) + str(i)}]} for i in range(3)]
    (tmp_path / "a.json").write_text(" \n" + json.dumps(records, indent=2) + "\n\n")
    rows = R.read_conversations_array(spark, str(tmp_path / "a.json")).collect()
    assert values(rows) == wanted(records) and all(r._corrupt_record is None for r in rows)


def test_documents_and_several_files(spark, tmp_path, small_splits):
    rng = random.Random(9)
    first, last = conversations(rng, 20), conversations(rng, 7)
    results = [{"reference": odd_text(rng), "generated": odd_text(rng) + str(i), "bleu": 0.5} for i in range(25)]
    document = {"timestamp": "t", "average_metrics": {"bleu": 0.5}, "detailed_results": results, "training_dataset_size": 3}
    (tmp_path / "part-2.json").write_text(json.dumps(first))
    (tmp_path / "part-10.json").write_text(json.dumps(document, indent=2))
    (tmp_path / "part-11.json").write_text("[]")
    (tmp_path / "part-12.json").write_text(json.dumps(last, indent=4))
    want = first + [{"conversations": [{"from": "assistant", "value": r["generated"]}]} for r in results] + last
    assert values(R.read_conversations_array(spark, str(tmp_path)).collect()) == wanted(want)


@pytest.mark.parametrize("text,good,bad", (
    ("[]", 0, 0), (" [ \n ] ", 0, 0), ("", 0, 0), ("no json", 0, 1), ("[{broken", 0, 1),
    ('[{"conversations": []}, {"conversations": [{"from": "h", "val', 1, 1), ('[{"conversations": []}, 5, {"conversations": []}]', 1, 1),
    ('[{"conversations": []} {"other": 1}]', 2, 0), ('[{"a": {"b": {"c": [{"d": "}"}]}}}]', 1, 0), ('[{"conversations": nope}, {"x": 1}]', 1, 1)))
def test_broken_and_odd_files(spark, tmp_path, text, good, bad):
    (tmp_path / "a.json").write_text(text)
    rows = R.read_conversations_array(spark, str(tmp_path / "a.json")).collect()
    assert [r._corrupt_record is None for r in rows].count(True) == good
    assert [r._corrupt_record is None for r in rows].count(False) == bad
    assert sorted(r.conv_id for r in rows) == list(range(good + bad))


def written(path):
    return "".join(p.read_text(encoding="utf-8") for p in sorted(path.glob("part-*")))


@pytest.mark.parametrize("ascii_only", (True, False))
def test_one_array_in_parts(spark, tmp_path, small_splits, ascii_only):
    """The parts' concatenation is what Python's json writes, and is read back as one array."""
    rng = random.Random(11)
    odd = ["\x00\x1f\x7f\x80", "\b\f\n\r\t\"\\/", "\u2028\ud7ff\ue000\uffff", "😀\U0010ffff", "", "é ü"]
    rows = [(c, t, r, rng.choice(odd) + odd_text(rng)) for c in range(80) for t, r in enumerate(("human", "assistant"))]
    rows += [(None, 0, "human", "no id"), (7, 5, None, None)]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    W.write_conversations_array(m, str(tmp_path / "out"), ascii_only)
    text = written(tmp_path / "out")
    records = json.loads(text)
    assert text.rstrip("\n") == json.dumps(records, indent=2, ensure_ascii=ascii_only) and len(records) == 81
    assert [x["value"] for x in records[1]["conversations"]] == [t for c, _, _, t in rows if c == 0]
    assert len(list((tmp_path / "out").glob("part-*"))) > 1
    back = R.read_conversations_array(spark, str(tmp_path / "out"), one=True).collect()
    assert values(back) == wanted(records) and all(r._corrupt_record is None for r in back)


def test_an_empty_array_in_parts(spark, tmp_path):
    W.write_conversations_array(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), str(tmp_path / "out"))
    assert json.loads(written(tmp_path / "out")) == []
    assert R.read_conversations_array(spark, str(tmp_path / "out"), one=True).count() == 0
