"""Operator 7: chat formatting with offset-aligned loss masks.

A conversation is rendered as one string, turn by turn::

    <|turn|>role<|text|>text<|end|>\\n

encoded once with character offsets, and each token is in the loss if its span
meets the text of an assistant turn; the tokens of a turn are found by binary
search in the sorted token starts and ends.  The three markers are single
tokens, so no token reaches over the edge of a text.

Inside roles and texts, control strings (``CONTROL``: markers and those of
other common templates) get a backslash after their first character, and those
that already have some one more, so taking one away gives the text back.

Turns are ordered by turn, then role and text, nulls first; repeated rows stay.
A null role or text is empty; a null conv_id is one conversation.  A
conversation is one row of the output and so is gathered in one task; nothing
larger is.  No rows give no conversations.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import map_batches

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of chat templates, first character and the rest.
CONTROL = r"(<|\[)(\\*)(\||/?s>|/?INST\]|/?<?SYS>>)"
_ESCAPE, _UNESCAPE = re.compile(CONTROL), re.compile(CONTROL.replace(r"(\\*)", r"(\\*)\\"))
_READ = re.compile(re.escape(TURN) + r"(.*?)" + re.escape(TEXT) + r"(.*?)" + re.escape(END) + "\n", re.S)
LOSS_ROLE = "assistant"
AT_ONCE = 128


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the texts in the loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tokens whose span meets one of the sorted ``spans``."""
    out = np.zeros(len(starts), bool)
    if spans:
        s = np.asarray(spans)
        s = s[s[:, 1] > s[:, 0]]
        for lo, hi in zip(np.searchsorted(ends, s[:, 0], "right"), np.searchsorted(starts, s[:, 1], "left")):
            out[lo:hi] = True
    return out


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _READ.findall(formatted)]


def masked_texts(formatted: str, starts, ends, in_loss) -> list[str]:
    """Unescaped runs of text that the masked tokens cover."""
    runs: list[list[int]] = []
    for a, b in zip(np.asarray(starts)[in_loss].tolist(), np.asarray(ends)[in_loss].tolist()):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [unescape(formatted[a:b]) for a, b in runs]


def tokenizer(definition: str):
    """The byte-level tokenizer with the markers as tokens of their own and
    offsets that leave no gaps."""
    from tokenizers import AddedToken, Tokenizer, processors
    tok = Tokenizer.from_str(definition)
    tok.post_processor = processors.ByteLevel(trim_offsets=False)
    tok.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in (TURN, TEXT, END)])
    return tok


def _format(definition: Broadcast):
    state: dict = {}

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if "tok" not in state:
            state["tok"] = tokenizer(definition.value)
        for a in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(a, AT_ONCE)
            done = [render([(t["role"] or "", t["text"] or "") for t in turns.as_py()]) for turns in part.column(1)]
            encoded = [state["tok"].encode(text, add_special_tokens=False) for text, _ in done]
            offsets = [np.array(e.offsets, np.int32).reshape(-1, 2) for e in encoded]
            yield {"conv_id": part.column(0), "formatted": pa.array([text for text, _ in done], pa.string()),
                   "input_ids": pa.array([e.ids for e in encoded], pa.list_(pa.int32())),
                   "starts": pa.array([o[:, 0] for o in offsets], pa.list_(pa.int32())),
                   "ends": pa.array([o[:, 1] for o in offsets], pa.list_(pa.int32())),
                   "in_loss": pa.array([mask(o[:, 0], o[:, 1], spans) for o, (_, spans) in zip(offsets, done)],
                                       pa.list_(pa.bool_()))}
    return run


def format_chats(conversations: DataFrame, tokenizer_path: str = TOKENIZER) -> DataFrame:
    """``conv_id, formatted, input_ids, starts, ends, in_loss`` of every
    conversation of ``conversations(conv_id, turn, role, text)``."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = conversations.sparkSession.sparkContext.broadcast(f.read())
    turns = (conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id"))
             .agg(F.sort_array(F.collect_list(F.struct(
                 F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
                 F.col("text").cast("string").alias("text")))).alias("turns")))
    return map_batches(turns, _format(definition),
                       "conv_id long, formatted string, input_ids array<int>, starts array<int>, ends array<int>, "
                       "in_loss array<boolean>")


def _digest(batch: pa.RecordBatch) -> Iterator[dict]:
    col = lambda name: batch.column(batch.schema.get_field_index(name))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out: dict[str, list] = {n: [] for n in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
    for text, starts, ends, in_loss in zip(*map(col, ("formatted", "starts", "ends", "in_loss"))):
        text = text.as_py()
        turns = read_back(text)
        loss = "".join(masked_texts(text, starts.values.to_numpy(), ends.values.to_numpy(),
                                    in_loss.values.to_numpy(zero_copy_only=False)))
        out["n_turns"].append(len(turns))
        out["turns_sha256"].append(sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        out["loss_chars"].append(len(loss))
        out["loss_sha256"].append(sha(loss))
        out["formatted_chars"].append(len(text))
    yield {"conv_id": batch.column(0)} | {n: pa.array(v) for n, v in out.items()}


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the output of ``format_chats``."""
    return map_batches(formatted.select("conv_id", "formatted", "starts", "ends", "in_loss"), _digest,
                       "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                       "formatted_chars long")
