"""The pipeline's stages, each held against a plain version on its own input."""

import random
from collections import Counter

import pytest

import corpus_pipeline as P
from codeeval.llm import quality
from codeeval.llm.tables import saved, table

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Every stage's output, and the input first."""
    docs = table(spark, SF, "documents")
    out = {"documents": docs}
    for name, stage in P.STAGES:
        docs = out[name] = saved(stage(spark, docs, SF), name)
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_and_columns(steps):
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "benchmark", "mixing", "sharding"]
    for name in ("quality", "near_duplicates", "benchmark", "mixing"):
        assert steps[name].columns == steps["documents"].columns


def test_quality_stage_keeps_what_scores_enough(spark, steps):
    scores = quality.classify(steps["documents"], table(spark, SF, "labels"))
    want = {r.doc_id for r in scores.where("predicted = 1").collect()}
    assert {i for i, _ in rows(steps["quality"])} == want and 0 < len(want) < steps["documents"].count()


def test_near_duplicate_stage_keeps_one_of_each_group(steps):
    want = {i for i, (_, _, kept) in brute.near_duplicates(rows(steps["quality"]), P.NEAR).items() if kept}
    assert Counter(i for i, _ in rows(steps["near_duplicates"])) == Counter(want)


def test_near_duplicate_stage_links_from_080_on(spark):
    rng = random.Random(12)
    texts = []
    for edits in list(range(4, 14)) * 3:                  # (96 - edits) / (96 + edits): 0.92 to 0.76
        base = [f"w{rng.randrange(10 ** 6)}" for _ in range(100)]
        texts += [" ".join(base), " ".join(base[:-edits] + ["e"] * edits)]
    schema = table(spark, SF, "documents").schema
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], schema)
    kept = {t: {i for i, (_, _, k) in brute.near_duplicates(list(enumerate(texts)), t).items() if k} for t in (80, 85)}
    assert kept[80] < kept[85]                            # some pairs lie between
    assert Counter(r.doc_id for r in P.without_near_copies(spark, docs, SF).collect()) == Counter(kept[80])


def test_benchmark_stage_drops_contaminated(spark, steps):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    judged = brute.decontaminate(rows(steps["near_duplicates"]), items)
    assert {i for i, _ in rows(steps["benchmark"])} == {r[0] for r in judged if not r[5]}


def test_mixing_stage_repeats_whole_documents(steps):
    before, after = steps["benchmark"].collect(), Counter(steps["mixing"].collect())
    assert set(after) <= set(before) and max(after.values()) <= 3
    sizes = Counter()
    for r in before:
        sizes[r.source] += len(brute.SPACE.findall(r.text or ""))
    taken, largest = Counter(), Counter()
    for r, n in after.items():
        words = len(brute.SPACE.findall(r.text))
        taken[r.source] += n * words
    for r in before:
        largest[r.source] = max(largest[r.source], len(brute.SPACE.findall(r.text or "")))
    for s, target in brute.targets(sizes).items():
        assert abs(taken[s] - target) <= largest[s] / 2 + 1


def test_sharding_stage_places_every_row(steps):
    out = steps["sharding"].collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows(steps["mixing"]))
    slots: dict = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) and 0 <= k < 40 for k, s in slots.items())


def odd_documents(spark, rows):
    schema = table(spark, SF, "documents").schema
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], schema)


def test_rows_are_judged_by_their_own_text(spark):
    """Rows that share a doc_id, or have none, and equal rows."""
    item = table(spark, SF, "benchmark").where("length(text) > 200").first().text
    rng = random.Random(8)
    clean = [" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(60)) for _ in range(5)]
    near = clean[3].split()[:-2] + ["x", "y"]                            # 54 of 58 shingles in common
    docs = odd_documents(spark, [(None, clean[0] + " " + item, "s"), (1, clean[1], "s"), (2, clean[2], "s"),
                                 (2, clean[4] + " " + item, "s"), (None, clean[3], "s"), (None, " ".join(near), "s"),
                                 (5, clean[2], "s"), (7, "", "s"), (7, None, "s"), (1, clean[1], "s"), (1, clean[1], "s")])
    got = Counter(rows(P.without_benchmark(spark, docs, SF)))
    assert got == Counter((i, t) for i, t in rows(docs) if item not in (t or ""))
    got = Counter(rows(P.without_near_copies(spark, docs, SF)))
    one = [x for x in got if x[0] is None and x[1] in (clean[3], " ".join(near))]
    assert len(one) == 1 and got.pop(one[0]) == 1                        # either of two without ids
    assert got == Counter([(None, clean[0] + " " + item), (1, clean[1]), (2, clean[2]), (2, clean[4] + " " + item),
                           (7, ""), (7, None)])


def test_mix_takes_equal_rows_together(spark):
    """Two sources of one text each, one repeated: every row's copies add up to the mix."""
    docs = odd_documents(spark, [(1, "a b c d", "p")] * 3 + [(2, "e f g h", "q")] * 6 + [(None, "i j k l", "p"), (3, "", "q")])
    got = Counter(rows(P.mixed(spark, docs, SF)))
    words = {"p": 4 * (got[1, "a b c d"] + got[None, "i j k l"]), "q": 4 * got[2, "e f g h"]}
    want = brute.targets({"p": 16, "q": 24})
    assert all(abs(words[s] - want[s]) <= 2 for s in want) and (3, "") not in got
    assert got[1, "a b c d"] <= 9 and got[2, "e f g h"] <= 18


def test_stages_with_missing_values(spark):
    """What must remain of rows with nulls, empty texts and repeated rows, and of nothing."""
    odd = odd_documents(spark, [(None, None, None), (1, "", None), (2, "a b c", "s"), (2, "a b c", "s")])
    near = P.without_near_copies(spark, odd, SF)
    assert Counter(rows(near)) == Counter([(None, None), (1, ""), (2, "a b c")])
    assert Counter(rows(P.without_benchmark(spark, odd, SF))) == Counter(rows(odd))
    assert Counter(rows(P.mixed(spark, near, SF))) == Counter([(2, "a b c")])
    placed = P.sharded(spark, odd, SF).collect()
    assert Counter(r.doc_id for r in placed) == Counter([None, 1, 2, 2])
    for name, stage in P.STAGES:
        assert stage(spark, odd.where("false"), SF).count() == 0, name
