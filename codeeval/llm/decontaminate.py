"""Operator 2: benchmark decontamination by winnowing.

Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z.
Of every ``WINDOW`` consecutive ``GRAM``-word hashes the smallest is kept (the
last of equals), so two texts that share ``SPAN`` words share a kept
fingerprint.  Document fingerprints are joined with those of the benchmark,
and each hit is extended to both sides over the words it carries along: a run
of at least ``SPAN`` equal words is contamination.  An item of fewer than
``SPAN`` words is one window, matched as a whole at every position of a
document.

Before the join a bit table of ``FILTER_BITS`` bits, set from the benchmark's
fingerprints and so of one size whatever the benchmark, drops most document
fingerprints that no item has.  It only spares the shuffle: what it lets
through is joined and compared word by word.

No words (null or empty text): ``n_words`` 0, nothing hit, not contaminated.
No benchmark: nothing hit.  Rows are judged by their own text, also when they
repeat a doc_id; equal items are all listed; an item with a null id marks
words but cannot be listed.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import map_batches, saved, text_of

SPAN, GRAM = 13, 6
WINDOW = SPAN - GRAM + 1
SIDE = SPAN - GRAM          # words carried along before and after a fingerprint
CONTEXT = GRAM + 2 * SIDE
FILTER_BITS = 1 << 21


def winnow(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions of the kept fingerprints of the windows that begin at ``starts``."""
    best, at = grams[starts].copy(), starts.copy()
    for j in range(1, WINDOW):
        other = grams[starts + j]
        better = other <= best
        best[better] = other[better]
        at[better] = starts[better] + j
    return at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at


def _tagged(h: np.ndarray, length: int) -> np.ndarray:
    return W.combine(h, np.full(len(h), length, W.U64))


def _fingerprints(w: W.Words, h: np.ndarray, short: list[int], whole: bool):
    """(flat word position, length, fingerprint) of a chunk's texts.  ``whole``:
    texts under SPAN words give themselves, else every run of a length in ``short``."""
    grams = W.window_hashes(h, GRAM)
    starts, _ = w.windows(SPAN)
    at = winnow(grams, starts)
    found = [(at, GRAM, _tagged(grams[at], GRAM))]
    counts = w.counts()
    for n in range(1, SPAN) if whole else short:
        pos = w.first[:-1][counts == n] if whole else w.windows(n)[0]
        if len(pos):
            found.append((pos, n, _tagged(W.window_hashes(h, n)[pos], 100 + n)))
    pos = np.concatenate([f[0] for f in found])
    length = np.concatenate([np.full(len(f[0]), f[1], np.int32) for f in found])
    return pos, length, np.concatenate([f[2] for f in found])


def _context(w: W.Words, h: np.ndarray, pos: np.ndarray, doc: np.ndarray, outside: int) -> np.ndarray:
    """Word hashes around each position; ``outside`` where the text has none."""
    at = pos[:, None] + np.arange(-SIDE, GRAM + SIDE)[None, :]
    ok = (at >= w.first[:-1][doc][:, None]) & (at < w.first[1:][doc][:, None])
    out = np.full(at.shape, outside, W.U64)
    out[ok] = h[at[ok]]
    return out


def _emit(column: pa.Array, short: list[int], bits: np.ndarray | None, outside: int):
    """Per chunk: first row, words, and its fingerprints by text."""
    for row, buf, offs in W.chunks(column):
        w = W.split_words(buf, offs, W.ALNUM_WORDS, lower=True)
        h = w.hashes()
        pos, length, fp = _fingerprints(w, h, short, bits is None)
        if bits is not None:
            slot = (fp & W.U64(FILTER_BITS - 1)).astype(np.int64)
            keep = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
            pos, length, fp = pos[keep], length[keep], fp[keep]
        doc = np.searchsorted(w.first, pos, "right") - 1
        order = np.argsort(doc, kind="stable")
        pos, length, fp, doc = pos[order], length[order], fp[order], doc[order]
        around = _context(w, h, pos, doc, outside)
        n = len(pos)
        hits = pa.StructArray.from_arrays(
            [pa.array(W.signed(fp)), pa.array((pos - w.first[doc]).astype(np.int32)), pa.array(length),
             W.lists(W.signed(around.ravel()), np.arange(n + 1) * CONTEXT, pa.int64())],
            ["fp", "at", "len", "words"])
        where = np.searchsorted(doc, np.arange(len(offs))).astype(np.int32)
        yield row, w, buf, offs, pa.ListArray.from_arrays(pa.array(where), hits)


_HITS = "array<struct<fp: long, at: int, len: int, words: array<long>>>"


def _items(batch: pa.RecordBatch):
    for row, w, _, offs, hits in _emit(batch.column(1), [], None, 1):
        yield {"item_id": batch.column(0).slice(row, len(offs) - 1), "hits": hits}


def _docs(short: list[int], bits: np.ndarray):
    def run(batch: pa.RecordBatch):
        for row, w, buf, offs, hits in _emit(batch.column(1), short, bits, 0):
            tag = [int.from_bytes(hashlib.blake2b(buf[a:b], digest_size=8).digest(), "little", signed=True)
                   for a, b in zip(offs[:-1], offs[1:])]
            yield {"doc_id": batch.column(0).slice(row, len(offs) - 1), "tag": pa.array(tag, pa.int64()),
                   "n_words": pa.array(w.counts(), pa.int64()), "hits": hits}
    return run


def _extend(batch: pa.RecordBatch):
    """From a fingerprint that a document and an item share to the run of equal words around it."""
    get = lambda name: batch.column(batch.schema.get_field_index(name))
    def context(name):
        col = get(name)
        return col.values.to_numpy()[col.offsets[0].as_py():col.offsets[-1].as_py()].reshape(-1, CONTEXT)

    equal = context("dw") == context("iw")
    at, length = get("at").to_numpy(), get("len").to_numpy()
    inner = np.arange(GRAM + SIDE)[None, :] < length[:, None]
    sure = (equal[:, SIDE:] | ~inner).all(1)
    left = np.logical_and.accumulate(equal[:, SIDE - 1::-1], axis=1).sum(1)
    right = np.logical_and.accumulate(equal[:, SIDE + GRAM:], axis=1).sum(1)
    long = length == GRAM
    # an item of exactly GRAM words has a tagged fingerprint of its own and is not extended
    long &= get("whole").to_numpy(zero_copy_only=False) == 0
    begin = np.where(long, at - left, at)
    end = np.where(long, at + GRAM + right, at + length)
    keep = pa.array(sure & (~long | (end - begin >= SPAN)))
    yield {"doc_id": get("doc_id").filter(keep), "tag": get("tag").filter(keep), "item_id": get("item_id").filter(keep),
           "begin": pa.array(begin.astype(np.int32)).filter(keep), "end": pa.array(end.astype(np.int32)).filter(keep)}


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every
    row of ``docs(doc_id, text)`` against ``benchmark(item_id, text)``."""
    items = saved(map_batches(text_of(benchmark, "item_id").withColumnRenamed("doc_id", "item_id"), _items,
                              f"item_id long, hits {_HITS}"), "items").select("item_id", F.explode("hits").alias("h"))
    # An item under SPAN words has one fingerprint and no neighbours: `whole`.
    inside = F.aggregate("h.words", F.lit(0), lambda n, x: n + F.when(x == 1, 0).otherwise(1))
    items = items.select("item_id", "h.fp", "h.len", F.col("h.words").alias("iw"),
                         (inside < SPAN).cast("int").alias("whole")) \
        .withColumn("whole", F.when(F.col("len") != GRAM, 1).otherwise(F.col("whole")))
    # Both are bounded: lengths under SPAN, and slots of the bit table.
    short = sorted(r[0] for r in items.where("whole = 1").select("len").distinct().collect())
    slots = np.array([r[0] for r in items.select(F.col("fp").bitwiseAND(FILTER_BITS - 1).alias("s")).distinct().collect()],
                     np.int64)
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    np.bitwise_or.at(bits, slots >> 3, (1 << (slots & 7)).astype(np.uint8))

    scanned = saved(map_batches(text_of(docs), _docs(short, bits),
                                f"doc_id long, tag long, n_words long, hits {_HITS}"), "fingerprints")
    found = (scanned.select("doc_id", "tag", F.explode("hits").alias("h"))
             .select("doc_id", "tag", "h.fp", "h.at", F.col("h.words").alias("dw"))
             .join(items, "fp").select("doc_id", "tag", "at", "len", "whole", "dw", "iw", "item_id"))
    spans = map_batches(found, _extend, "doc_id long, tag long, item_id long, begin int, end int")
    by_doc = (spans.groupBy("doc_id", "tag")
              .agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("spans"),
                   F.collect_set("item_id").alias("items")))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["upto"], s["end"]).alias("upto"),
                              (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["upto"], s["begin"]))).alias("n")),
        lambda a: a["n"])
    hit = by_doc.select(F.col("doc_id").alias("d"), F.col("tag").alias("t"), covered.alias("n_hit"), "items")
    rows = scanned.select("doc_id", "tag", "n_words").join(
        hit, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t")), "left")
    listed = F.coalesce("items", F.array().cast("array<long>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array(listed.cast("array<string>"))), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))
