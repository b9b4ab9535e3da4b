"""Training-text rendering: chat template text, response spans, instruction
(alpaca-style) text, and regrouping messages into conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .ordinals import running_sum_within


def _template_role(role):
    """Chat-template role name for a normalised role (human -> user)."""
    return F.when(role == fixed.HUMAN, F.lit("user")).otherwise(role)


def _segment(role, text, header_start=fixed.CHAT_HEADER_START, header_end=fixed.CHAT_HEADER_END,
             turn_end=fixed.CHAT_TURN_END):
    return F.concat(F.lit(header_start), _template_role(role), F.lit(header_end),
                    F.coalesce(text, F.lit("")), F.lit(turn_end))


def rebuild_conversations(messages: DataFrame) -> DataFrame:
    """S1 (shape): messages regrouped per conversation, in turn order, as
    ``conversations array<struct<from, value>>``."""
    return (messages.groupBy("conv_id")
                    .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_m"))
                    .select("conv_id", F.transform("_m", lambda m: F.struct(m["role"].alias("from"),
                                                                            m["text"].alias("value")))
                            .alias("conversations")))


def chat_template_text(messages: DataFrame, begin: str = fixed.CHAT_BEGIN) -> DataFrame:
    """One training text per conversation: ``begin`` followed by every turn
    as header(role) + text + turn terminator, in turn order."""
    seg = messages.select("conv_id", "turn", _segment(F.col("role"), F.col("text")).alias("seg"))
    return (seg.groupBy("conv_id")
               .agg(F.array_sort(F.collect_list(F.struct("turn", "seg"))).alias("_s"))
               .select("conv_id", F.concat(F.lit(begin),
                                           F.array_join(F.transform("_s", lambda s: s["seg"]), ""))
                       .alias("text")))


def response_spans(messages: DataFrame, begin: str = fixed.CHAT_BEGIN) -> DataFrame:
    """Character span ``[span_start, span_end)`` of every assistant turn's
    text plus terminator inside the chat-template text -- the part that is
    trained on.  Offsets are a running sum of segment lengths per
    conversation, blocked so one long conversation is not one task."""
    seg_len = F.length(_segment(F.col("role"), F.col("text")))
    head_len = F.length(F.concat(F.lit(fixed.CHAT_HEADER_START), _template_role(F.col("role")),
                                 F.lit(fixed.CHAT_HEADER_END)))
    d = messages.select("conv_id", "turn", "role", seg_len.alias("_len"), head_len.alias("_head"))
    d = running_sum_within(d, ["conv_id"], "turn", "_len", "_before", inclusive=False) \
        .withColumn("_before", F.col("_before") + F.lit(len(begin)))
    return (d.filter(F.col("role") == fixed.ASSISTANT)
             .select("conv_id", "turn",
                     (F.col("_before") + F.col("_head")).cast("long").alias("span_start"),
                     (F.col("_before") + F.col("_len")).cast("long").alias("span_end")))


def instruction_text(pairs: DataFrame, prompt: str = "prompt", response: str | None = "code",
                     eos: str = fixed.END_OF_TEXT, system: str = fixed.INSTRUCTION_SYSTEM_PROMPT) -> DataFrame:
    """X11: alpaca-style text.  Training form (with response, EOS appended) when
    ``response`` is given; inference form (empty response, no EOS) otherwise."""
    head, rest = fixed.INSTRUCTION_TEMPLATE.split("{instruction}")
    mid, tail = rest.split("{response}")
    head = head.replace("{system}", system)
    mid = mid.replace("{input}", "")
    if response is None:
        text = F.concat(F.lit(head), F.col(prompt), F.lit(mid), F.lit(tail))
    else:
        text = F.concat(F.lit(head), F.col(prompt), F.lit(mid), F.col(response), F.lit(tail), F.lit(eos))
    return pairs.withColumn("text", text)
