"""Operator 1: near-duplicate groups by min-max hashing.

A document's set holds its distinct five-word shingles (lower-cased A-Z,
words between white space).  Under each of ``PERMUTATIONS`` permutations of
64-bit shingle hashes both the smallest and the largest value are kept, so one
evaluation gives two signature values: 128 values from 64 permutations.
Bands of four values are hashed; documents that share a band are candidates.
Two documents of similarity 0.85 meet in one of the 32 bands with probability
1 - (1 - 0.85^4)^32 > 1 - 1e-10, and of 0.8 with over 1 - 1e-7.
The least similarity of a link, in hundredths, is a parameter.

The whole job, without forming all pairs of a group:

1. documents with the same set are one class, by its smallest doc_id;
2. in each band bucket every class is compared with the bucket's hub, the
   class that shares most buckets with others -- as many pairs as members;
3. classes that share a bucket but not yet a component are compared as well
   where sizes and the places of their rarest shingles leave a link possible
   (an exact prefix filter);
4. every link is confirmed on the full sets; components follow from links.

Empty input gives no rows.  A null or empty text, or one without words, has an
empty set, is linked with nothing and is its own component.  A text of fewer
than five words is one shingle.  Rows that repeat a doc_id are judged by their
own text; a null doc_id takes part as a copy only, and stays where nothing
else has its set.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .tables import map_batches, n_partitions, possible, saved, spread_join, text_of

K = 5
PERMUTATIONS = 64
BAND_ROWS = 4
BANDS = 2 * PERMUTATIONS // BAND_ROWS
THRESHOLD = 85
_rng = np.random.default_rng(20240501)
_XOR = _rng.integers(0, 2**63, PERMUTATIONS).astype(W.U64)
_MUL = _rng.integers(0, 2**63, PERMUTATIONS).astype(W.U64) * W.U64(2) + W.U64(1)


def shingle_sets(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and where each begins."""
    w = W.split_words(buf, offs, W.SPACE_WORDS, lower=True)
    h = w.hashes()
    at, doc = w.windows(K)
    full = W.window_hashes(h, K)[at]
    begin = np.searchsorted(doc, np.arange(len(offs)))
    sets = []
    for d, n in enumerate(w.counts()):
        if 0 < n < K:
            sets.append(W.window_hashes(h[w.first[d]:w.first[d + 1]], int(n)))
        else:
            s = np.sort(full[begin[d]:begin[d + 1]])
            sets.append(s[np.r_[True, s[1:] != s[:-1]]] if len(s) > 1 else s)
    first = np.zeros(len(offs), np.int64)
    np.cumsum([len(s) for s in sets], out=first[1:])
    return np.concatenate(sets) if sets else np.empty(0, W.U64), first


def band_keys(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(sets, BANDS) band keys of non-empty sets."""
    starts = first[:-1]
    keys = np.empty((len(starts), BANDS), W.U64)
    per = BAND_ROWS // 2
    for band in range(BANDS):
        key = np.full(len(starts), band + 1, W.U64)
        for p in range(band * per, (band + 1) * per):
            v = (values ^ _XOR[p]) * _MUL[p]
            key = W.combine(key, np.minimum.reduceat(v, starts))
            key = W.combine(key, np.maximum.reduceat(v, starts))
        keys[:, band] = key
    return keys


def _sketch(batch: pa.RecordBatch):
    ids = batch.column(0)
    for row, buf, offs in W.chunks(batch.column(1)):
        values, first = shingle_sets(buf, offs)
        n = np.diff(first)
        some = np.flatnonzero(n)
        s1, s2 = _set_hashes(values, first)
        bands = np.empty((0, BANDS), W.U64)
        if len(some):
            bands = band_keys(values, np.append(first[:-1][some], len(values)))
        where = np.concatenate([[0], np.cumsum(n > 0)]) * BANDS
        yield {"doc_id": ids.slice(row, len(n)), "n_shingles": pa.array(n, pa.int64()),
               "s1": pa.array(W.signed(s1)), "s2": pa.array(W.signed(s2)),
               "bands": W.lists(W.signed(bands.ravel()), where, pa.int64())}


def _set_hashes(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent order-free hashes of each set; 0 of an empty one."""
    some = np.flatnonzero(np.diff(first))
    s1, s2 = np.zeros(len(first) - 1, W.U64), np.zeros(len(first) - 1, W.U64)
    if len(some):
        begin = first[:-1][some]
        s1[some] = np.add.reduceat(W.mix(values ^ W.U64(0x51ED270B)), begin)
        s2[some] = np.add.reduceat(W.mix(values * W.U64(0x9E3779B97F4A7C15)), begin)
    return s1, s2


def _sets(batch: pa.RecordBatch):
    """Sets of the rows whose text is the class's (a doc_id may have come with another text too)."""
    w1, w2 = (batch.column(i).to_numpy() for i in (2, 3))
    for row, buf, offs in W.chunks(batch.column(1)):
        values, first = shingle_sets(buf, offs)
        s1, s2 = _set_hashes(values, first)
        n = len(s1)
        keep = pa.array((W.signed(s1) == w1[row:row + n]) & (W.signed(s2) == w2[row:row + n]))
        yield {"node": batch.column(0).slice(row, n).filter(keep),
               "shingles": W.lists(W.signed(values), first, pa.int64()).filter(keep)}


def _agree(threshold: int):
    """Of each pair of sets, whether the intersection reaches the threshold."""
    def run(batch: pa.RecordBatch):
        def column(name):
            c = batch.column(batch.schema.get_field_index(name))
            return c.offsets.to_numpy(), c.values.to_numpy()

        (oa, va), (ob, vb) = column("sa"), column("sb")
        linked = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            a, b = va[oa[i]:oa[i + 1]], vb[ob[i]:ob[i + 1]]
            both = np.concatenate([a, b])
            both.sort()
            inter = int((both[1:] == both[:-1]).sum())
            linked[i] = 100 * inter >= threshold * (len(both) - inter)
        keep = pa.array(linked)
        yield {n: batch.column(batch.schema.get_field_index(n)).filter(keep) for n in ("a", "b")}
    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs ``(a, b)`` that are links, by their full sets.  ``b`` may be a hub
    that a third of all pairs name: they are dealt on by ``a``, and each deal gets
    the hub's set.  ``pairs`` is read more than once: give a written table."""
    deal = F.pmod(F.xxhash64("a"), F.lit(n_partitions(pairs.sparkSession))).cast("int")
    hubs = (pairs.select("b", deal.alias("deal")).distinct()
            .join(possible(sets, "node", pairs.select("b")).select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b"))
    full = (pairs.join(possible(sets, "node", pairs.select("a")).select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
            .withColumn("deal", deal).join(hubs, ["b", "deal"]).select("a", "b", "sa", "sb"))
    return map_batches(full, _agree(threshold), "a long, b long")


def _undecided(sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs ``(a, b)`` of different components that may still be links, of
    ``sets(node, n, component, shingles)``: an exact prefix filter with positions.

    In one order of all shingles the first shingle that two sets share leaves at
    most the rest of either set for the intersection.  So with it at place i, a set
    of n can only reach the threshold t with sets of up to (100 + t)/t (n - i) - n
    shingles.  Any order is exact.  Here shingles that only one component holds
    come first, as they can join no two components, and need not be posted; then the
    others, those with fewest holders first, counted over all sets.
    """
    each = sets.select("node", "n", "component", F.explode("shingles").alias("shingle"))
    across = (each.groupBy("shingle").agg(F.count("*").alias("holders"), F.min("component").alias("x"), F.max("component").alias("y"))
              .where("x < y").select("shingle", "holders"))
    kept = F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1     # length of the prefix
    mine = (each.select("node", "shingle").join(across, "shingle").groupBy("node")
            .agg(F.sort_array(F.collect_list(F.struct("holders", "shingle"))).alias("order"))
            .join(sets.select("node", "n", "component"), "node")
            .withColumn("before", F.col("n") - F.size("order"))
            .withColumn("order", F.slice("order", F.lit(1), F.greatest(F.lit(0), kept - F.col("before")).cast("int"))))
    posts = saved(mine.select("node", "n", "component", "before", F.posexplode("order").alias("at", "post"))
                  .select("node", "n", "component", F.col("post.shingle").alias("shingle"),
                          (F.floor((100 + threshold) * (F.col("n") - F.col("before") - F.col("at")) / threshold) - F.col("n"))
                          .alias("reach")), "posts")
    size_bin = lambda c: F.floor(F.log(c.cast("double")) / float(np.log(1.01))).cast("int")
    # The smaller of a linked pair reaches the larger, and the larger reaches the smaller.
    small = posts.where("reach >= n").select(
        "shingle", F.col("node").alias("a"), F.col("n").alias("na"), F.col("reach").alias("ra"),
        F.col("component").alias("ca"), size_bin(F.col("n")).alias("bin"))
    low, high = F.ceil(F.col("n") * threshold / 100), F.least("n", "reach")
    large = posts.where(high >= low).select(
        "shingle", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("reach").alias("rb"),
        F.col("component").alias("cb"), F.explode(F.sequence(size_bin(low), size_bin(high))).alias("bin"))
    return (small.join(large, ["shingle", "bin"])
            .where("ca <> cb AND na <= nb AND nb <= ra AND na <= rb AND (na < nb OR a < b)")
            .select("a", "b").distinct())


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs(doc_id,
    text)``; sets of a similarity of ``threshold`` hundredths or more are linked."""
    texts = text_of(docs)
    sketch = saved(map_batches(
        texts, _sketch, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"), "sketch")
    some = sketch.where("n_shingles > 0")
    same_set = ["s1", "s2", "n_shingles"]
    classes = some.groupBy(*same_set).agg(F.min("doc_id").alias("node"))

    # Buckets of more than one class.  A class is represented by the row of its smallest doc_id.
    reps = (some.join(classes.where("node IS NOT NULL").withColumn("doc_id", F.col("node")), [*same_set, "doc_id"])
            .select("node", "n_shingles", F.explode("bands").alias("band")))
    sizes = reps.groupBy("band").agg(F.count("*").alias("m"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    members = saved(reps.join(sizes.where("lo < hi").select("band", "m"), "band").distinct(), "members")
    degree = members.groupBy("node").agg(F.sum("m").alias("degree"))
    members = saved(members.join(degree, "node").select("band", "node", F.col("n_shingles").alias("n"), "degree"), "members")

    # Full sets of the classes that share a bucket.  The text of any other is not read again.
    wanted = saved(classes.join(members.select("node").distinct(), "node", "left_semi")
                   .select(F.col("node").alias("doc_id"), "s1", "s2"), "wanted")
    some_texts = possible(texts, "doc_id", wanted.select("doc_id"))
    sets = saved(map_batches(some_texts.join(wanted, "doc_id").select("doc_id", "text", "s1", "s2"), _sets,
                             "node long, shingles array<long>"), "sets")

    fits = f"100 * least(n, nb) >= {threshold} * greatest(n, nb)"
    hubs = (members.groupBy("band").agg(F.max(F.struct("degree", (-F.col("node")).alias("minus"), "n")).alias("hub"))
            .select("band", (-F.col("hub.minus")).alias("b"), F.col("hub.n").alias("nb")))
    star = saved(members.join(hubs, "band").where("node <> b").where(fits).select(F.col("node").alias("a"), "b").distinct(), "star")
    labels = components(saved(_confirmed(star, sets, threshold), "links"))

    # What the hubs have not settled: one bucket, different components.
    placed = saved(members.join(labels, "node", "left")
                   .select("band", "node", "n", F.coalesce("component", "node").alias("component")), "placed")
    open_bands = (placed.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"))
                  .where("x < y").select("band"))
    still = placed.join(open_bands, "band", "left_semi").select("node", "n", "component").distinct()
    undecided = saved(sets.join(still, "node").select("node", "n", "component", "shingles"), "undecided")
    rest = saved(_undecided(undecided, threshold), "rest")
    more = saved(_confirmed(rest, sets, threshold), "links")
    merged = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
                        .union(more.select("a", "b")))

    # Back to rows: a component is named by the smallest doc_id of its classes.
    named = (classes.join(merged, "node", "left")
             .select(*same_set, F.coalesce("component", "node").alias("component_id")))
    rows = (spread_join(sketch.select("doc_id", *same_set), saved(named, "named"), same_set, F.col("doc_id"))
            .withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id"))
                        .otherwise(F.col("component_id"))))
    return rows.select("doc_id", "n_shingles", "component_id",
                       F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
