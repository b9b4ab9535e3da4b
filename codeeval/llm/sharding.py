"""Operator 10: shards by vector bin packing.

A shard has a capacity in bytes, words and rows, an equal share of each,
weighted by ``WEIGHTS``.
Documents with equal texts form a group.  Units are placed in order of
falling size, each into the shard where the dot product of its vector with
what is left of the shard's capacity (both in shares of the capacity) is
highest.  Law ``bytes``: shard sizes come out near equal.

A unit is a group that fills over ``1 / FINE`` of a shard in some measure, or
else all smaller groups of one of ``shards * FINE`` hash buckets.  So there
are at most ``4 * shards * FINE`` units at any size of the data, and placing
them on the driver is bounded; everything else is aggregation and joins with
tables of that bound.  A group of over ``1 / WHOLE`` of a shard is split, by a
hash of doc_id, into pieces of about that size; smaller groups stay together.

Slots number a shard's rows from 0 without gaps: rows are counted by
``BLOCKS`` hash blocks per shard, and numbered within a block.

A null text has no bytes (16 with the row's own); null texts are one group.
Rows that repeat, doc_id included, are placed and numbered each.  Without rows
the result is empty.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .tables import map_batches, saved, text_of

FINE, WHOLE, BLOCKS = 256, 4, 1024
#: Of bytes, words and rows in the dot product: law `bytes` puts bytes first.
WEIGHTS = (64.0, 1.0, 1.0)
ROW_BYTES = 16


def _measures(batch: pa.RecordBatch):
    for row, buf, offs in W.chunks(batch.column(1)):
        w = W.split_words(buf, offs, W.SPACE_WORDS)
        texts = [buf[a:b] for a, b in zip(offs[:-1], offs[1:])]
        ids = np.array([np.frombuffer(hashlib.blake2b(t, digest_size=16).digest(), np.int64) for t in texts])
        yield {"doc_id": batch.column(0).slice(row, len(texts)),
               "size": pa.array(np.diff(offs) + ROW_BYTES, pa.int64()), "words": pa.array(w.counts(), pa.int64()),
               "text_crc32": pa.array([zlib.crc32(t) for t in texts], pa.int64()),
               "g1": pa.array(ids[:, 0]), "g2": pa.array(ids[:, 1])}


def place(vectors: np.ndarray, capacity: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unit."""
    v = vectors / np.maximum(capacity, 1e-12)
    weighted = v * np.array(WEIGHTS)
    left = np.ones((shards, v.shape[1]))
    where = np.zeros(len(v), np.int32)
    for i in np.argsort(-weighted.sum(1), kind="stable"):
        # words or rows over their capacity (one text may hold more than a shard's) do not repel bytes
        s = int(np.argmax(left[:, 0] * weighted[i, 0] + np.maximum(left[:, 1:], 0) @ weighted[i, 1:]))
        left[s] -= v[i]
        where[i] = s
    return where


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    rows = saved(map_batches(text_of(docs), _measures,
                             "doc_id long, size long, words long, text_crc32 long, g1 long, g2 long"), "measures")
    measures = [F.sum("size").alias("size"), F.sum("words").alias("words"), F.count("*").alias("rows")]
    total = np.array([x or 0 for x in rows.agg(*measures).first()], float)
    capacity = total / shards
    share = F.greatest(*[F.col(c) / float(max(capacity[i], 1e-12)) for i, c in enumerate(("size", "words", "rows"))])
    large = saved(rows.groupBy("g1", "g2").agg(*measures).where(share > 1 / FINE)
                  .select("g1", "g2", F.when(share > 1 / WHOLE, F.ceil(share * WHOLE)).otherwise(1)
                          .cast("long").alias("pieces")), "large")  # at most 3 * shards * FINE rows
    spread = F.xxhash64("doc_id", "text_crc32", "size")
    units = (rows.join(F.broadcast(large), ["g1", "g2"], "left")
             .withColumn("u1", F.when(F.col("pieces").isNull(), F.pmod(F.col("g1"), F.lit(shards * FINE))).otherwise(F.col("g1")))
             .withColumn("u2", F.when(F.col("pieces").isNull(), F.lit(0)).otherwise(F.col("g2")))
             .withColumn("piece", F.when(F.col("pieces").isNull(), F.lit(-1)).otherwise(F.pmod(spread, F.col("pieces")))))
    keys = ["u1", "u2", "piece"]
    sums = units.groupBy(*keys).agg(*measures).orderBy(*keys).toArrow()
    vectors = np.stack([sums.column(c).to_numpy().astype(float) for c in ("size", "words", "rows")], 1)
    where = place(vectors, capacity, shards)
    mapped = spark.createDataFrame(pa.table([*(sums.column(c).combine_chunks() for c in keys), pa.array(where)],
                                            names=[*keys, "shard"]))
    placed = saved(units.join(F.broadcast(mapped), keys)
                   .select("doc_id", "size", "text_crc32", "shard",
                           F.pmod(F.shiftright(spread, 20), F.lit(BLOCKS)).cast("int").alias("block")), "placed")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")
    blocks = saved(placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
                   .select("shard", "block", before.alias("before")), "blocks")  # shards * BLOCKS rows
    within = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size"))
    return (placed.withColumn("place", within).join(F.broadcast(blocks), ["shard", "block"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("before") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
