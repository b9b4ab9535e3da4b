"""Property tests: random batches of awkward strings through the column
expressions and the scoring plans, against plain-Python statements of the
same rules.  Each hypothesis example is one batch -> one Spark job."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeeval.functions import text as T
from codeeval.operators import metrics as M
from tests import pyoracle as O

PIECES = ["```", "```scala", "scala\n", "<|endoftext|>", "### Response:", "user", "assistant", "\n\n", "\n",
          " ", "\t", "　", "\xa0", "\x1c", "`", "a", "Z", "é", "42", "_", "(", ")", "{", "}", ".", "Human: "]
texts = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)
batches = st.lists(texts, min_size=1, max_size=60)
SETTINGS = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(batches)
def test_text_rules_hold(spark, batch):
    """What must hold whatever the text: stripped ends, no markers left,
    unfenced text unchanged, the last piece after a marker."""
    df = spark.createDataFrame([(i, s) for i, s in enumerate(batch)], "i long, s string")
    fenced = F.concat(F.lit("```scala\n"), "s", F.lit("\n```<|endoftext|>"))
    whole = F.concat(F.lit("User\n\nask\u2003ASSISTANT \n\n"), "s")
    got = {r.i: r for r in df.select("i", T.ustrip("s").alias("strip"), T.clean_code("s").alias("clean"),
                                      T.clean_code(fenced).alias("unfenced"), T.strip_backticks("s").alias("bt"),
                                      T.after_marker("s").alias("after"), T.transcript_prompt(whole).alias("tp"),
                                      T.transcript_code(whole).alias("tc"), T.last_human_turn("s").alias("last")).collect()}
    for i, s in enumerate(batch):
        r = got[i]
        assert r.strip == s.strip()
        assert r.clean == r.clean.strip() and "<|endoftext|>" not in s or r.clean in s.replace("<|endoftext|>", "")
        assert r.unfenced == s.replace("<|endoftext|>", "").strip()
        assert r.bt == s if not s.startswith("```") else not r.bt.endswith("`")
        assert r.after == s.split("### Response:")[-1].strip()
        assert (r.tp, r.tc) == ("ask", s.strip() or "Generated code not found.")
        assert r.last == s.split("Human: ")[-1]


words = st.lists(st.sampled_from(["val", "x", "=", "1", "(", ")", "def", "f", "é", "Ω", "_a", "42"]), max_size=25).map(" ".join)
pair_batches = st.lists(st.tuples(words, words), min_size=1, max_size=40)


@SETTINGS
@given(pair_batches)
def test_scores_match_python(spark, pairs):
    df = spark.createDataFrame([(i, r, c) for i, (r, c) in enumerate(pairs)], "id long, ref string, cand string")
    b = {r.id: r.bleu for r in M.bleu_pairs(df, ["id"], "ref", "cand").collect()}
    c = {r.id: r.chrf for r in M.chrf_pairs(df, ["id"], "ref", "cand").collect()}
    for i, (ref, cand) in enumerate(pairs):
        assert b[i] == pytest.approx(O.bleu(ref, cand), abs=1e-12)
        assert c[i] == pytest.approx(O.chrf(ref, cand), abs=1e-12)


doubles = st.lists(st.one_of(st.floats(min_value=0, max_value=1e6, allow_nan=False, allow_infinity=False),
                             st.sampled_from([0.00015, 0.125, 0.03125, 2.675, 0.12345, 0.5, 1.5, 2.5, 1e-9, 99.995])),
                   min_size=1, max_size=200)


@SETTINGS
@given(doubles)
def test_format_fixed_is_python_format(spark, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x double")
    got = {r.i: (r.f4, r.f2, r.f0) for r in df.select("i", T.format_fixed("x", 4).alias("f4"),
                                                        T.format_fixed("x", 2).alias("f2"),
                                                        T.format_fixed("x", 0).alias("f0")).collect()}
    for i, x in enumerate(xs):
        assert got[i] == (f"{x:.4f}", f"{x:.2f}", f"{x:.0f}"), x
