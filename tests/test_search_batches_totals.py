"""P9 for many terms, F3's batch hook, running totals (R1/R2) and J2's bit table."""

import random

import pytest
from pyspark.sql import functions as F

from codeeval.operators import batched as B
from codeeval.operators import dedup as D
from codeeval.operators import edits as E
from codeeval.operators import prompts as PR
from codeeval.operators import search as S
from codeeval.session import scratch_path
from codeeval.streaming.rollup import RESULTS_DDL, current_totals, rollup_once

from .conftest import messages_df


def conversations(spark, rng, n):
    letters = "abAé😀 ßİ."
    text = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(12)))
    return messages_df(spark, [(c, t, r, text()) for c in range(n) for t, r in enumerate(("human", "assistant"))])


def test_terms_find_what_the_scan_finds(spark):
    m = conversations(spark, random.Random(3), 150).cache()
    terms = ["a", "AB", " aba ", "é", "b😀", "😀", "ß", "ab.a", "zzz", "aaaa", "a b", "bab"]
    got = {}
    for r in S.search_terms(m, spark.createDataFrame([(t,) for t in terms + ["aba"]], "term string")).collect():
        got.setdefault(r.term, set()).add((r.conv_id, r.preview))
    for t in terms:
        want = {tuple(r) for r in E.keyword_search(m, t).collect()}
        assert got.get(t.strip().lower(), set()) == want, t
    assert sum(map(len, got.values())) > 50


def test_blank_terms_and_nothing_to_search(spark):
    m = conversations(spark, random.Random(4), 5)
    for bad in ("", "  ", None):
        with pytest.raises(Exception, match="blank"):
            S.search_terms(m, spark.createDataFrame([("a",), (bad,)], "term string")).collect()
    none = spark.createDataFrame([], "term string")
    assert S.search_terms(m, none).count() == 0
    assert S.search_terms(messages_df(spark, []), spark.createDataFrame([("a",)], "term string")).count() == 0


def test_index_holds_each_gram_once(spark):
    df = spark.createDataFrame([(1, "abAB"), (2, "x"), (3, ""), (4, None)], "id long, t string")
    got = sorted(map(tuple, S.term_index(df, ["id"], "t").collect()))
    assert got == sorted([(1, g) for g in ("a", "b", "ab", "ba", "aba", "bab")] + [(2, "x")])


def test_a_long_text_takes_linear_time(spark):
    """Texts of 200 kB are split into characters once a size, not once a gram."""
    import time
    df = spark.createDataFrame([(i, f"{i} " + "abcdefghij klm" * 15_000) for i in range(2)], "id long, t string")
    started = time.monotonic()
    assert S.term_index(df, ["id"], "t").where("length(gram) = 3").count() > 20
    assert time.monotonic() - started < 60


def test_candidates_meet_their_text_once(spark):
    """Many terms in one conversation: the text is not copied to each of them before it is compared."""
    m = messages_df(spark, [(c, t, r, "abc abd bcd " * 50) for c in range(3) for t, r in enumerate(("human", "assistant"))])
    terms = spark.createDataFrame([(t,) for t in ("a", "ab", "abc", "abc abd", "bd bc", "abd abc")], "term string")
    found = S.search_terms(m, terms)
    assert sorted({r.term for r in found.collect()}) == ["a", "ab", "abc", "abc abd", "bd bc"] and found.count() == 15
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join Inner")        # one row a conversation until the hits are listed


def test_batches_call_the_function_once_each(spark, tmp_path):
    seen = tmp_path / "calls"
    seen.mkdir()

    def fn(texts):
        import uuid
        (seen / uuid.uuid4().hex).write_text(str(len(texts)))
        return [None if t is None else len(t) for t in texts]

    df = spark.range(0, 25, 1, 3).select("id", F.when(F.col("id") % 5 > 0, F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("text"))
    rows = B.map_text_batches(df, fn, "text", "n", "int").collect()
    assert sorted((r.id, r.n) for r in rows) == [(i, i if i % 5 else None) for i in range(25)]
    sizes = sorted(int(p.read_text()) for p in seen.iterdir())
    assert sum(sizes) == 25 and len(sizes) == 3
    assert B.map_text_batches(df.where("id < 0"), fn, "text", "n", "int").count() == 0
    assert len(list(seen.iterdir())) == 3                               # never for an empty batch
    with pytest.raises(Exception, match="gave 1 values"):
        B.map_text_batches(df, lambda texts: [0], "text", "n", "int").collect()


def test_tokens_of_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, " a b\n"), (2, ""), (3, None)], "id long, text string")
    got = {r.id: r.tokens for r in B.map_text_batches(df, B.whitespace_tokens, "text", "tokens", "array<string>").collect()}
    assert got == {1: ["a", "b"], 2: [], 3: []}


def test_totals_after_a_restart_equal_the_batch(spark):
    rng = random.Random(5)
    rows = [(rng.choice("xyz"), rng.random(), rng.randrange(3), 3) for _ in range(90)]
    incoming, totals, state = (scratch_path(spark, f"t-roll-{x}") for x in ("in", "out", "state"))

    def arrive(part):
        spark.createDataFrame(part, RESULTS_DDL).write.mode("append").parquet(incoming)

    def failing(results):
        return PR.variation_rollup(results).withColumn("n_results", F.raise_error(F.lit("stopped")).cast("long"))

    arrive(rows[:40])
    rollup_once(spark, incoming, totals, state, PR.variation_rollup)
    arrive(rows[40:70])
    with pytest.raises(Exception, match="stopped"):
        rollup_once(spark, incoming, totals, state, failing)             # fails while it writes
    arrive(rows[70:])
    rollup_once(spark, incoming, totals, state, PR.variation_rollup)
    rollup_once(spark, incoming, totals, state, PR.variation_rollup)     # nothing new
    want = PR.variation_rollup(spark.createDataFrame(rows, RESULTS_DDL))
    got = current_totals(spark, totals).select(*want.columns)
    key = lambda r: (r["variation_name"] or "", r["is_total"])
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_bit_table_only_spares(spark):
    """Every main value that a pair's hash matches passes, and nearly all others stop."""
    values = spark.range(0, 20_000).select(F.xxhash64("id").alias("h"), "id")
    hashes = values.where("id % 100 = 0").select("h")
    got = {r.id for r in D._possible(values, "h", hashes).collect()}
    assert {i for i in range(0, 20_000, 100)} <= got and len(got) < 260
    assert D._possible(values, "h", hashes.where("false")).count() == 0
    plan = D._possible(values, "h", hashes)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan
