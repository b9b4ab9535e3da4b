"""Operator 11: runs, the maximal periodic stretches of words of a text.

A run is a stretch of consecutive words with smallest period q (words q apart
are the same), of at least ``MIN_LENGTH`` and 2q words, that neither neighbour
extends.  Every run shows in the Lyndon array of one of the two orders of the
words (an order and its reverse): at some of its places the longest Lyndon word
has length q.  So, for each order,

1. the grouping phase of Baier's suffix sorter gives the Lyndon array directly,
   without a suffix array: groups of blocks with equal content are taken from the
   largest down; a taken block is final, and each stretch of m equal taken blocks
   is appended to the block on its left, which moves to a new group just above
   its own (among these, more copies come higher);
2. each Lyndon word w[i : i + q] is extended to both sides by the longest common
   extensions of i and i + q (hashed prefix sums and binary search, for all
   candidates at once); those that reach 2q are runs.  Each is then compared word
   by word, and one that does not agree is extended word by word instead.

Only words that a run can hold enter step 1.  In a run of MIN_LENGTH = 12 words
or more every word lies in a ``GRAM`` = 6-word gram that the run holds twice.  So
the texts are cut to the stretches covered by grams that come twice in the same
stretch, until nothing changes.  This loses no run, and most texts hold none.

Words are compared by 64-bit hashes.  A text is worked on whole, by one task;
nothing is shuffled.

Null and empty texts have no words and no runs.  Rows are independent: a null or
repeated doc_id changes nothing.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import map_batches

MIN_LENGTH = 12
#: Of a run's words, pairs q apart in a row number MIN_LENGTH - q or q at least, so grams of this size repeat in it.
GRAM = MIN_LENGTH // 2


def repeating(h: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that a run within their part can hold, and the
    stretch of each.  ``h``: word hashes; ``part``: their texts, ascending."""
    at = np.arange(len(h))
    while len(at):
        keys = W.window_hashes(h[at], GRAM)
        begin = np.flatnonzero(part[:len(keys)] == part[GRAM - 1:])
        keys = W.combine(keys[begin], part[begin].astype(W.U64))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = begin[order[np.r_[False, same] | np.r_[same, False]]] if len(order) else order
        cover = np.zeros(len(at) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + GRAM, -1)
        held = np.cumsum(cover[:-1]) > 0
        if held.all():
            break
        begins = held & np.r_[True, ~held[:-1] | (part[1:] != part[:-1])]
        at, part = at[held], (np.cumsum(begins) - 1)[held]
    return at, part


def lyndon_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of the longest Lyndon word that starts at each place of ``s``
    (non-negative integers), and its group: places of equal words share one."""
    n, values = len(s), np.unique(s)
    order = np.argsort(s, kind="stable")
    members = [x.tolist() for x in np.split(order, np.searchsorted(s[order], values[1:]))]
    group = np.searchsorted(values, s).tolist()
    length = [1] * len(values)
    below, above = list(range(-1, len(values) - 1)), list(range(1, len(values) + 1))
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))    # neighbouring blocks that are not final
    lyndon = [1] * n
    top = len(values) - 1 if n else -1
    while top >= 0:
        size, longer = length[top], {}
        for i in members[top]:
            if group[i] != top:
                continue                                # it has moved to a larger group
            before = left[i]
            if before >= 0 and group[before] == top:
                continue                                # not the first of equal blocks
            j = i
            while j < n and group[j] == top:
                lyndon[j] = size
                j = right[j]
            if j < n:
                left[j] = before
            if before >= 0:
                right[before] = j
                longer.setdefault((group[before], j - i), []).append(before)
        members[top] = None
        for own, more in sorted(longer, reverse=True):  # each goes just above its own group, fewer copies last
            new = len(length)
            for i in longer[own, more]:
                group[i] = new
            members.append(longer[own, more])
            length.append(length[own] + more)
            upper = above[own]
            below.append(own)
            above.append(upper)
            above[own] = below[upper] = new
        top = below[top]
    return np.array(lyndon, np.int64), np.array(group, np.int64)


class Extensions:
    """How far the words from two places on, or before them, agree: by prefix
    sums of a polynomial modulo two primes."""

    def __init__(self, v: np.ndarray):
        self.of = []
        h = W.mix(v.astype(W.U64) + W.U64(1))
        for p, base in ((2**31 - 1, 1_566_083_941), (2**31 - 19, 812_383_907)):
            powers = np.ones(len(v) + 1, np.int64)
            n = 1
            while n < len(powers):
                step = powers[n - 1] * base % p
                powers[n:2 * n] = powers[:min(n, len(powers) - n)] * step % p
                n *= 2
            terms = (h % W.U64(p)).astype(np.int64) * powers[:-1] % p
            self.of.append((p, powers, np.r_[0, np.cumsum(terms) % p]))
            h = W.mix(h)

    def _equal(self, i, j, n) -> np.ndarray:
        same = np.ones(len(i), bool)
        for p, powers, sums in self.of:
            same &= (sums[i + n] - sums[i]) % p * powers[j - i] % p == (sums[j + n] - sums[j]) % p
        return same

    def reach(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """Greatest n <= ``most`` with n equal words from i and j > i on (``back``: before them)."""
        low, high = np.zeros_like(i), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            good = self._equal(i - mid, j - mid, mid) if back else self._equal(i, j, mid)
            low, high = np.where(good, mid, low), np.where(good, high, mid - 1)
        return low


def runs_of(v: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of the runs in words ``v`` that do not
    leave their ``part`` (ascending); starts count from the front of ``v``."""
    if not len(v):
        return np.empty((0, 3), np.int64)
    _, ranks = np.unique(v, return_inverse=True)
    front = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    begin = np.repeat(front, np.diff(np.r_[front, len(v)]))
    end = np.repeat(np.r_[front[1:], len(v)], np.diff(np.r_[front, len(v)]))
    place = np.arange(len(v)) + np.searchsorted(front, np.arange(len(v)), "right")   # one mark before each part
    same = Extensions(v)
    found = []
    for order in (ranks, ranks.max() - ranks):
        marked = np.arange(len(v) + len(front))
        marked[front + np.arange(len(front))] = np.arange(len(front))     # marks are below all words
        marked[place] = order + len(front)
        length, group = (x[place] for x in lyndon_array(marked))
        i = np.flatnonzero((np.arange(len(v)) + length < end) | (np.arange(len(v)) > begin))
        q = length[i]
        fits = (i + q <= end[i]) & (2 * q <= (end - begin)[i])
        i, q = i[fits], q[fits]
        j = np.minimum(i + q, len(v) - 1)
        forward = (i + q < end[i]) & (v[i] == v[j])
        backward = (i > begin[i]) & (v[i - 1] == v[i + q - 1])
        back = np.maximum(i - q, begin[i])
        again = (i - q >= begin[i]) & (group[back] == group[i])           # the same word just before: the same run
        some = (forward | backward) & ~again
        i, q = i[some], q[some]
        after = same.reach(i, i + q, end[i] - i - q)
        before = same.reach(i, i + q, i - begin[i], back=True)
        long = before + q + after >= np.maximum(MIN_LENGTH, 2 * q)
        found.append(np.stack([i - before, before + q + after, q, i], 1)[long])
    out = np.concatenate(found)
    out = out[np.unique(out[:, :3], axis=0, return_index=True)[1]]
    checked = [_exact(v, *row, begin[row[3]], end[row[3]]) for row in out.tolist()]
    return np.array(sorted({x for x in checked if x}), np.int64).reshape(-1, 3)


def _exact(v: np.ndarray, start: int, size: int, q: int, i: int, begin: int, end: int) -> tuple | None:
    """The run as told if its words agree, else (the sums of two primes have
    collided) what holds around the Lyndon word at i, if that is a run."""
    if np.array_equal(v[start:start + size - q], v[start + q:start + size]):
        return start, size, q
    differs = begin + np.flatnonzero(v[begin:end - q] != v[begin + q:end])
    k = np.searchsorted(differs, i)
    start = int(differs[k - 1]) + 1 if k else begin
    size = (int(differs[k]) if k < len(differs) else end - q) + q - start
    return (start, size, q) if size >= max(MIN_LENGTH, 2 * q) else None


def joined(w: W.Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    n = np.where(keep, w.end - w.start + 1, 0)
    upto = np.r_[0, np.cumsum(n)]
    out = np.full(upto[-1], 0x20, np.uint8)
    size = n[keep] - 1
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(upto[:-1][keep], size) + inner] = w.buf[np.repeat(w.start[keep], size) + inner]
    data, ends = out.tobytes(), upto[w.first]
    return pa.array([data[a:b - 1] if b > a else b"" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())],
                    pa.binary()).cast(pa.string())


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _runs(batch: pa.RecordBatch):
    for row, buf, offs in W.chunks(batch.column(1)):
        w = W.split_words(buf, offs, W.SPACE_WORDS)
        h, doc = w.hashes(), w.doc_of()
        at, part = repeating(h, doc)
        found = runs_of(h[at], part)
        start, size, period = at[found[:, 0]] if len(found) else found[:, 0], found[:, 1], found[:, 2]
        gone = np.zeros(len(h) + 1, np.int64)
        np.add.at(gone, start + period, 1)
        np.add.at(gone, start + size, -1)
        of = doc[start] if len(start) else start
        runs = pa.StructArray.from_arrays([pa.array(start - w.first[of]), pa.array(size), pa.array(period)],
                                          fields=list(_RUN))
        per_doc = np.searchsorted(of, np.arange(len(offs))).astype(np.int32)
        yield {"doc_id": batch.column(0).slice(row, len(offs) - 1), "n_words": pa.array(w.counts(), pa.int64()),
               "runs": pa.ListArray.from_arrays(pa.array(per_doc), runs),
               "collapsed": joined(w, np.cumsum(gone[:-1]) <= 0)}


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row of ``docs(doc_id,
    text)``.  ``runs``: array of (start, length, period) by start, then period;
    ``collapsed``: the words joined by one space, without those that a run holds
    after its first period."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_batches(rows, _runs, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, "
                       "runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of ``docs``; of every tenth document, by crc32 h of its
    doc_id, each word i >= a is word a + (i - a) % p, with g = h div 10, a = g % n
    and p = 1 + (n - a) div (3 + g % 8).  Rows without doc_id or words stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    text = F.col("text").cast("string")
    return (docs.select("doc_id", text.alias("text"), h.alias("h"),
                        F.when(h % 10 == 0, F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"))).alias("w"))
            .withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10))
            .withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
            .withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
            .select("doc_id", F.when(F.col("n") > 0, _periodic(F.col("w"), F.col("n"), F.col("a"), F.col("p")))
                    .otherwise(F.col("text")).alias("text")))


def _periodic(w: Column, n: Column, a: Column, p: Column) -> Column:
    period = F.slice(w, a + 1, F.least(p, n - a))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")


def digests(runs: DataFrame) -> DataFrame:
    """Per row of ``periodic_runs``: the number of runs, the longest (ties: the
    smallest start, then period; nulls without runs) and digests."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    one = runs.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.period")
    return one.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
                      length.alias("length"), period.alias("period"),
                      F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
                      F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
                      F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
