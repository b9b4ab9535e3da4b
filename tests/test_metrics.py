"""M1-M4: sentence BLEU and chrF against an independent Python oracle."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from codeeval.functions import text as T
from codeeval.operators import metrics as M
from codeeval.plans import oracle
from tests import pyoracle as O

PAIRS = [
    ("val total = items.map(_.price).sum", "val total = items.map(_.price).sum"),      # identical
    ("val total = items.map(_.price).sum", "val sum = items.map(_.cost).sum"),         # two names differ
    ("val total = items.map(_.price).sum", "var total = prices.reduce(_ + _)"),        # same idea
    ("val total = items.map(_.price).sum", "import akka.actor"),                       # one dot in common
    ("", ""),                                                                  # both empty
    ("hello world", ""),                                                       # empty hypothesis
    ("", "hello"),                                                             # empty reference
    ("hello", "hello"),                                                        # one token each
    ("hello world", "world"),                                                  # one-token hypothesis
    ("a b c d e f", "x y z"),                                                  # no overlap
    ("val x = 1\nprintln(x)", "val x = 1 \n  println( x )"),                   # whitespace only
    ("Grüße an ñandú 42", "grüße an Ñandú 42!"),                               # unicode
    ("a a a a b", "a a a a a a a a"),                                          # clipping
]


#: What the word rules look at, and some that they must leave alone.
PIECES = list("abstmdnreX0é_²'\"`.,:;@#$%&?!*()[]{}<>-«“‘„»”’ \t\n\xa0\x1c") + [
    "''", "``", "--", "...", "'s", "'LL", "n't", "cannot", "d'ye", "gimme", "Gonna", "gotta", "lemme", "more'n", "wanna",
    " 'tis", " 'twas", "a.b", "x.", "\r\n", "   "]


def token_lists(spark, texts):
    """Tokens by the column expression and by the SQL."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string").repartition(4)
    got = {r.id: r.w for r in df.select("id", T.word_tokens("t").alias("w")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id BIGINT, t VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    return got, dict(con.execute(f"SELECT id, {oracle.word_tokens('t')} FROM t").fetchall())


def test_word_tokens_by_hand(spark):
    texts = ["val a.b = f(x).c.", "He said \"it's 3,5\" -- no. And: (don't!)", "I cannot; 'tis wanna be", None, " \n",
             "items.map(_.price).sum", "1:2 a:b a: e.g. end.)  "]
    got, sql = token_lists(spark, texts)
    assert got[0] == ["val", "a.b", "=", "f", "(", "x", ")", ".c", "."]
    assert got[1] == ["He", "said", "``", "it", "'s", "3,5", "''", "--", "no.", "And", ":", "(", "do", "n't", "!", ")"]
    assert got[2] == ["I", "can", "not", ";", "'t", "is", "wan", "na", "be"]
    assert got[3] == got[4] == []
    assert got[5] == ["items.map", "(", "_.price", ")", ".sum"]
    assert got[6] == ["1:2", "a", ":", "b", "a", ":", "e.g.", "end", ".", ")"]
    assert sql == got == {i: O.tokens(t) for i, t in enumerate(texts)}


def test_word_tokens_on_random_strings(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(14))) for _ in range(6000)]
    got, sql = token_lists(spark, texts)
    want = {i: O.tokens(t) for i, t in enumerate(texts)}
    assert [(texts[i], got[i], w) for i, w in want.items() if got[i] != w][:5] == []
    assert [(texts[i], sql[i], w) for i, w in want.items() if sql[i] != w][:5] == []


def test_word_tokens_are_linear(spark):
    """Long runs after a period, and of quotes and brackets, are not scanned again and again."""
    text = ". ".join("x" * 3 for _ in range(2000)) + "." + " " * 200_000 + "y" + ".)" * 100_000 + "'" * 100_000
    got, sql = token_lists(spark, [text])       # the SQL's patterns run in linear time
    assert got == sql and len(got[0]) > 200_000


def test_word_tokens_take_few_passes(spark):
    """A text without quotes is rewritten twice, and white space is not mapped letter by letter."""
    df = spark.createDataFrame([("a",)], "t string").select(T.word_tokens("t").alias("w"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 2 + 17 and "translate(" not in plan


def test_merged_word_rules(spark):
    """Rules that share a pattern see a text as when they run one after the other."""
    texts = ["a,,b", "a,,,b", "a,,5", "a:,", ",:", "x--- -y", "a.. .", "a.)\n", ".", ".)", "x.“", "x.»» ", "cannot,gonna wanna\xa0gotta.",
             "wanna.", "wanna", "CANNOT-lemme", "“.", ",.", "a…b", "a\x1cb\u2003c", "x.\n)", "'tis'twas", "cannot'tis", "\n'tis", "d'ye,,'a", "more'n:,."]
    got, sql = token_lists(spark, texts)
    assert got == sql == {i: O.tokens(t) for i, t in enumerate(texts)}
    assert got[0] == ["a", ",", ",b"] and got[12] == ["can", "not", ",", "gon", "na", "wan", "na", "got", "ta", "."]


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame([(i, r, c) for i, (r, c) in enumerate(PAIRS)], "id long, ref string, cand string")
    b = M.bleu_pairs(df, ["id"], "ref", "cand")
    c = M.chrf_pairs(df, ["id"], "ref", "cand")
    return {r["id"]: (r["bleu"], r["chrf"]) for r in b.join(c, "id").collect()}


def test_bleu_matches_python_oracle(scored):
    for i, (ref, cand) in enumerate(PAIRS):
        assert scored[i][0] == pytest.approx(O.bleu(ref, cand), abs=1e-12), (i, ref, cand)


def test_chrf_matches_python_oracle(scored):
    for i, (ref, cand) in enumerate(PAIRS):
        assert scored[i][1] == pytest.approx(O.chrf(ref, cand), abs=1e-12), (i, ref, cand)


def test_by_hand(scored):
    assert scored[0] == (pytest.approx(1.0), pytest.approx(1.0))
    # "a a a a b" vs eight a's: 4 of 8 unigrams, 3 of 7, 2 of 6, 1 of 5; hypothesis longer, no penalty
    assert scored[12][0] == pytest.approx((4 / 8 * 3 / 7 * 2 / 6 * 1 / 5) ** 0.25)
    # "hello world" vs "world": every 1- and 2-gram of five letters occurs in the ten of the reference
    f = [(1.0, r) for r in (5 / 10, 4 / 9, 3 / 8, 2 / 7, 1 / 6)]
    p, r = sum(x for x, _ in f) / 5, sum(y for _, y in f) / 5
    assert scored[8][1] == pytest.approx(5 * p * r / (4 * p + r))
    assert scored[4] == (0.0, 0.0) and scored[5] == (0.0, 0.0) and scored[9] == (0.0, 0.0)


def test_one_long_pair_spreads_over_tasks(spark):
    """The n-grams of a single pair are dealt out by n-gram, without joins, hints or repartitions."""
    text = " ".join(f"t{i * 7919 % 100003}" for i in range(700_000))       # about 5 million characters
    df = spark.createDataFrame([(0, text, text)], "id long, ref string, cand string")
    scores = M.bleu_pairs(df, ["id"], "ref", "cand")
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "REPARTITION" not in plan and plan.count("Scan") + plan.count("LocalTable") <= 1
    assert "hashpartitioning(id" in plan and "g0" in plan[plan.index("hashpartitioning(id"):]
    assert scores.first()["bleu"] == pytest.approx(1.0)


def test_every_pair_gets_a_row(scored):
    assert set(scored) == set(range(len(PAIRS)))


def test_average_metric(spark):
    df = spark.createDataFrame([(0, "a b c", "a b c"), (1, "a b c", "x")], "id long, ref string, cand string")
    b = M.bleu_pairs(df, ["id"], "ref", "cand")
    row = M.average_metric(b).first()
    assert row["n_pairs"] == 2
    # three tokens have no 4-gram: smoothing applies even to an identical pair
    assert row["avg_bleu"] == pytest.approx((O.bleu("a b c", "a b c") + 0.0) / 2, abs=1e-12)


def test_average_metric_empty(spark):
    empty = spark.createDataFrame([], "id long, ref string, cand string")
    row = M.average_metric(M.bleu_pairs(empty, ["id"], "ref", "cand")).first()
    assert row["n_pairs"] == 0 and row["avg_bleu"] == 0.0


def test_long_text_is_not_quadratic(spark):
    words = " ".join(f"w{i % 997}" for i in range(20000))
    df = spark.createDataFrame([(0, words, words[: len(words) // 2])], "id long, ref string, cand string")
    got = M.bleu_pairs(df, ["id"], "ref", "cand").first()["bleu"]
    assert got == pytest.approx(O.bleu(words, words[: len(words) // 2]), abs=1e-12)


def test_no_python_udf_in_plan(spark):
    df = spark.createDataFrame([(0, "a b", "a c")], "id long, ref string, cand string")
    plan = M.chrf_pairs(df, ["id"], "ref", "cand")._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def shuffled_rows(df):
    """Rows that all exchanges of a query wrote, by its plan's own metrics."""
    df.collect()

    def walk(p):
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(p.executedPlan())
        if name.endswith("QueryStage"):
            return walk(p.plan())
        own = p.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
        return own + sum(walk(p.children().apply(i)) for i in range(p.children().size()))
    return walk(df._jdf.queryExecution().executedPlan())


def test_ngrams_of_ordinary_pairs_are_not_shuffled(spark):
    text = " ".join(f"w{i}" for i in range(500))
    df = spark.createDataFrame([(i, text, text + f" {i}") for i in range(20)], "id long, ref string, cand string")
    for score, orders in ((M.bleu_pairs, 4), (M.chrf_pairs, 6)):
        assert shuffled_rows(score(df, ["id"], "ref", "cand")) <= 20 * 2 * (orders + 2)


def test_counting_in_the_row_and_by_ngram_agree(spark, monkeypatch):
    rng = random.Random(8)
    pieces = ["a", "a a", "b.", "it's", "cannot", "“é”", "😀", " ", "\n", "中文", "ab ab"]
    rows = [(i, *(" ".join(rng.choice(pieces) for _ in range(rng.randrange(25))) for _ in range(2))) for i in range(300)]
    rows += [(300, "".join(chr(0x4e00 + j) for j in range(1100)), "".join(chr(0x4e00 + 2 * j) for j in range(700))),  # many letters
             (301, None, "a"), (302, "a", None), (303, "\x00\x00a\x00", "\x00a\x00\x00\x00")]
    df = spark.createDataFrame(rows, "id long, ref string, cand string")

    def scores():
        return {r.id: (r.bleu, r.chrf) for r in M.bleu_pairs(df, ["id"], "ref", "cand")
                .join(M.chrf_pairs(df, ["id"], "ref", "cand"), "id").collect()}
    in_row = scores()
    monkeypatch.setattr(M, "LOCAL_UNITS", -1)
    assert in_row == scores() and len(in_row) == len(rows)
    for i, r, c in rows:
        assert in_row[i] == (pytest.approx(O.bleu(r or "", c or ""), abs=1e-12), pytest.approx(O.chrf(r or "", c or ""), abs=1e-12)), i


def test_rows_with_equal_ids_are_scored_as_one(spark):
    df = spark.createDataFrame([(1, "a b", "c d"), (1, "c d", "a b"), (None, "x y", "x"), (None, "z", "y"), (2, "a", "b")],
                               "id long, ref string, cand string")
    got = {r.id: r.chrf for r in M.chrf_pairs(df, ["id"], "ref", "cand").collect()}
    assert got[1] > 0 and got[2] == 0 and 0 < got[None] < 1        # found in the other row of the id


def test_texts_are_dealt_before_they_are_cut_into_words(spark):
    """The word rules run on all tasks, also where the texts come from one file or a broadcast join."""
    df = spark.createDataFrame([(0, "a b", "a c")], "id long, ref string, cand string")
    plan = M.bleu_pairs(df, ["id"], "ref", "cand")._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan             # slow: it copies its state for every word
    assert 0 < plan.rindex("regexp_replace") < plan.rindex("Exchange hashpartitioning(id")
