"""P1-P8 on the edge cases FIXTURES.md asks for."""

from codeeval.operators import pairs as P
from tests.conftest import messages_df

ROWS = [
    # 1: system first, then two exchanges
    (1, 0, "system", "be brief"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"),
    (1, 3, "user", "q2"), (1, 4, "assistant", "a2"),
    # 2: dangling human turn
    (2, 0, "human", "only q"), (2, 1, "gpt", "ans"), (2, 2, "human", "dangling"),
    # 3: two assistants in a row
    (3, 0, "human", "q"), (3, 1, "assistant", "x"), (3, 2, "assistant", "y"),
    # 4: single message
    (4, 0, "human", "alone"),
    # 5: assistant first
    (5, 0, "assistant", "hello"), (5, 1, "human", "hi"),
]


def _msgs(spark):
    return P.normalize_roles(messages_df(spark, ROWS))


def test_role_zip_truncates_and_ignores_system(spark):
    got = sorted(tuple(r) for r in P.pair_role_zip(_msgs(spark)).collect())
    assert got == [(1, 0, "q1", "a1"), (1, 1, "q2", "a2"), (2, 0, "only q", "ans"),
                   (3, 0, "q", "x"), (5, 0, "hi", "hello")]


def test_role_zip_context_accumulates_human_turns(spark):
    got = {(r.conv_id, r.k): r.prompt for r in P.pair_role_zip_context(_msgs(spark)).collect()}
    assert got[(1, 1)] == "Human: q1\nHuman: q2"
    assert got[(1, 0)] == "Human: q1"
    assert (2, 1) not in got


def test_positional_is_role_blind(spark):
    got = {r.conv_id: (r.prompt, r.reference) for r in P.pair_positional(_msgs(spark)).collect()}
    assert got[1] == ("be brief", "q1")
    assert got[5] == ("hello", "hi")
    assert 4 not in got


def test_first_of_role(spark):
    got = {r.conv_id: (r.prompt, r.code) for r in P.pair_first_of_role(_msgs(spark)).collect()}
    assert got == {1: ("q1", "a1"), 2: ("only q", "ans"), 3: ("q", "x"), 5: ("hi", "hello")}


def test_multi_snippet_profile(spark):
    m = _msgs(spark)
    prof = {(r.conv_id, r.k): (r.n_snippets, r.is_multi, r.last_prompt)
            for r in P.multi_snippet_profile(m).collect()}
    assert prof[(1, 1)] == (2, True, "q2")
    assert prof[(2, 0)] == (1, False, "only q")


def test_validate_pairs_strips_and_filters(spark):
    df = spark.createDataFrame([(1, 0, " p ", " c "), (2, 0, "p", " 　"), (3, 0, "", "c")],
                               "conv_id long, k long, prompt string, code string")
    both = sorted(tuple(r) for r in P.validate_pairs(df).collect())
    either = sorted(r.conv_id for r in P.validate_pairs(df, require_both=False).collect())
    assert both == [(1, 0, "p", "c")]
    assert either == [1, 2, 3]


def test_flatten_round_trip(spark):
    from codeeval.operators.formatting import rebuild_conversations
    m = messages_df(spark, ROWS)
    back = P.flatten_messages(rebuild_conversations(m))
    assert sorted(tuple(r) for r in back.collect()) == sorted(ROWS)
