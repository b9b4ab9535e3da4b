"""Conversation -> message -> prompt/code pair operators.

Message tables have the flat shape ``(conv_id, turn, role, text)`` where
``turn`` is the message's position inside its conversation.  Pair tables
have the shape ``(conv_id, k, prompt, code)`` where ``k`` is the 0-based
pair number inside the conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from .ordinals import rank_within


def flatten_messages(nested: DataFrame, id_col: str = "conv_id",
                     array_col: str = "conversations") -> DataFrame:
    """One row per message, in order.  ``posexplode_outer`` keeps a
    conversation without messages as a single null row, which is dropped
    here (a missing ``conversations`` list means no messages)."""
    return (nested.select(id_col, F.posexplode_outer(array_col).alias("turn", "m"))
                  .filter(F.col("m").isNotNull())
                  .select(F.col(id_col).alias("conv_id"), F.col("turn").cast("long"),
                          F.col("m.from").alias("role"), F.col("m.value").alias("text")))


def normalize_roles(messages: DataFrame) -> DataFrame:
    """Map ``user``/``gpt`` onto ``human``/``assistant`` (narrow)."""
    return messages.withColumn("role", T.normalize_role("role"))


def pair_positional(messages: DataFrame) -> DataFrame:
    """message[0] is the prompt and message[1] the reference, whatever
    their roles; conversations with fewer than two messages are dropped.

    One aggregate per conversation; partial aggregation keeps only two
    values per conversation before the shuffle."""
    return (messages.filter(F.col("turn") < 2)
                    .groupBy("conv_id")
                    .agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("prompt"),
                         F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("reference"))
                    .dropna(subset=["prompt", "reference"]))


def _role_ranks(messages: DataFrame) -> DataFrame:
    """Human and assistant messages with ``k`` = their 0-based position among
    the conversation's messages of the same role -- one ranking pass for
    both roles (the two role branches below share its exchanges)."""
    m = (messages.filter(F.col("role").isin(fixed.HUMAN, fixed.ASSISTANT))
                 .select("conv_id", "turn", "role", "text"))
    return rank_within(m, ["conv_id", "role"], "turn", out="k")


def _role_side(ranked: DataFrame, role: str, out: str) -> DataFrame:
    return ranked.filter(F.col("role") == role).select("conv_id", "k", F.col("text").alias(out))


def pair_role_zip(messages: DataFrame) -> DataFrame:
    """K-th human message with k-th assistant message; surplus on either
    side dropped; other roles ignored.  Roles must be normalised."""
    ranked = _role_ranks(messages)
    return _role_side(ranked, fixed.HUMAN, "prompt").join(_role_side(ranked, fixed.ASSISTANT, "code"),
                                                          ["conv_id", "k"], "inner")


def pair_role_zip_context(messages: DataFrame) -> DataFrame:
    """Like P4, but the k-th prompt is every human message up to and
    including the k-th, each as ``"Human: " + text``, joined by newlines.

    The running concatenation is a window over the conversation; its output
    is quadratic in the number of human turns by definition, so one
    conversation is one unit of work here."""
    humans = messages.filter(F.col("role") == fixed.HUMAN).select("conv_id", "turn", "text")
    w = Window.partitionBy("conv_id").orderBy("turn")
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    humans = humans.select(
        "conv_id",
        (F.row_number().over(w) - 1).cast("long").alias("k"),
        F.array_join(F.collect_list(F.concat(F.lit(fixed.HUMAN_PREFIX), F.col("text"))).over(running),
                     "\n").alias("prompt"))
    codes = rank_within(messages.filter(F.col("role") == fixed.ASSISTANT).select("conv_id", "turn", "text"),
                        ["conv_id"], "turn", out="k").select("conv_id", "k", F.col("text").alias("code"))
    return humans.join(codes, ["conv_id", "k"], "inner")


def pair_first_of_role(messages: DataFrame) -> DataFrame:
    """P5: conversations with at least two messages; first human message and
    first assistant message.  A conversation lacking either role is dropped."""
    return (messages.groupBy("conv_id")
                    .agg(F.count(F.lit(1)).alias("n_messages"),
                         F.min_by("text", F.when(F.col("role") == fixed.HUMAN, F.col("turn"))).alias("prompt"),
                         F.min_by("text", F.when(F.col("role") == fixed.ASSISTANT, F.col("turn"))).alias("code"))
                    .filter((F.col("n_messages") >= 2) & F.col("prompt").isNotNull()
                            & F.col("code").isNotNull())
                    .drop("n_messages"))


def multi_snippet_profile(messages: DataFrame) -> DataFrame:
    """Per pair, the conversation's assistant count, the multi-snippet
    flag and the differential prompt (text after the last ``Human: `` of the
    accumulated prompt, which always lies in the last human message)."""
    n_code = (messages.filter(F.col("role") == fixed.ASSISTANT)
                      .groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_snippets")))
    return (pair_role_zip(messages).join(n_code, "conv_id")
                         .select("conv_id", "k", "n_snippets",
                                 (F.col("n_snippets") > 1).alias("is_multi"),
                                 T.last_human_turn(F.concat(F.lit(fixed.HUMAN_PREFIX), F.col("prompt"))).alias("last_prompt")))


def first_messages(messages: DataFrame) -> DataFrame:
    """Value of message[0] of every conversation."""
    return messages.filter(F.col("turn") == 0).select("conv_id", F.col("text").alias("prompt"))


def validate_pairs(pairs: DataFrame, prompt: str = "prompt", code: str = "code",
                   require_both: bool = True) -> DataFrame:
    """Strip both sides; keep rows where both (or, folder variant, either)
    are non-empty.  The stripped values replace the originals."""
    d = pairs.withColumn(prompt, T.ustrip(prompt)).withColumn(code, T.ustrip(code))
    p_ok, c_ok = F.col(prompt) != "", F.col(code) != ""
    return d.filter((p_ok & c_ok) if require_both else (p_ok | c_ok))


def preview_text(df: DataFrame, col: str = "prompt", out: str = "preview") -> DataFrame:
    """P10: list-view preview of a text column."""
    return df.withColumn(out, T.preview(col))
