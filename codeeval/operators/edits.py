"""Dataset editing: keyword search, batch add / update / delete, trim."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from .ordinals import global_ordinal
from .pairs import pair_positional, validate_pairs


def keyword_search(messages: DataFrame, term: str) -> DataFrame:
    """Conversations whose message[0] or message[1] contains the term,
    case-insensitively (plain substring, no wildcards).  A blank term is
    rejected.  Returns (conv_id, preview) -- the list view."""
    t = term.strip().lower()
    if not t:
        raise ValueError("the search term is blank")
    pos = pair_positional(messages)
    hit = F.contains(F.lower("prompt"), F.lit(t)) | F.contains(F.lower("reference"), F.lit(t))
    return pos.filter(hit).select("conv_id", T.preview("prompt").alias("preview"))


def _two_messages(ids: DataFrame) -> DataFrame:
    return ids.select("conv_id", F.inline(F.array(
        F.struct(F.lit(0).cast("long").alias("turn"), F.lit(fixed.HUMAN).alias("role"), F.col("prompt").alias("text")),
        F.struct(F.lit(1).cast("long").alias("turn"), F.lit(fixed.ASSISTANT).alias("role"),
                 F.col("response").alias("text")))))


def batch_edits(messages: DataFrame, adds: DataFrame | None = None, updates: DataFrame | None = None,
                deletes: DataFrame | None = None, add_order: str = "edit_seq") -> DataFrame:
    """P11-P13 applied as one batch, keyed by ``conv_id``.

    * deletes ``(conv_id)``: the conversation is removed (ids stay stable
      keys; positions are renumbered only on export);
    * updates ``(conv_id, prompt, response)``: after P8 validation the
      conversation is replaced by a 2-message conversation (extra turns are
      lost); invalid updates are ignored;
    * adds ``(edit_seq, prompt, response)``: after P8 validation appended
      with ids ``max(conv_id) + 1 + position of edit_seq``.
    """
    out = messages.select("conv_id", "turn", "role", "text")
    if deletes is not None:
        out = out.join(deletes.select("conv_id").distinct(), "conv_id", "left_anti")
    if updates is not None:
        upd = validate_pairs(updates, "prompt", "response").select("conv_id", "prompt", "response")
        upd = upd.join(out.select("conv_id").distinct(), "conv_id", "left_semi")
        out = out.join(upd.select("conv_id"), "conv_id", "left_anti").unionByName(_two_messages(upd))
    if adds is not None:
        add = validate_pairs(adds, "prompt", "response")
        top = messages.agg(F.coalesce(F.max("conv_id"), F.lit(-1)).alias("_top"))   # one row
        ords = global_ordinal(add.select(add_order), add_order, out="_ord", unique=True)
        add = (add.join(ords, add_order).crossJoin(F.broadcast(top))
                  .withColumn("conv_id", F.col("_top") + 1 + F.col("_ord")))
        out = out.unionByName(_two_messages(add))
    return out


def trim_first_n(messages: DataFrame, n: int) -> DataFrame:
    """The first ``n`` conversations in dataset order (1 <= n <= size; any
    other ``n`` is an error).  Positions come from ``global_ordinal``, so no
    single task ever holds the first ``n`` ids."""
    ords = global_ordinal(messages.select("conv_id"), "conv_id", out="_pos")
    size = ords.count()                                   # of the checkpointed ids
    if not 1 <= n <= size:
        raise ValueError(f"n must be between 1 and the number of conversations, {size}")
    keep = ords.filter(F.col("_pos") < n).select("conv_id")
    return messages.join(keep, "conv_id", "left_semi")
