"""Operator 3: mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's size is its number of words.  Sources in code point order (null
last) weigh ``WEIGHTS``, repeating, and share the words of all documents; a
target stops at ``MAX_EPOCHS`` times its source's size and the excess is shared
again by weight until no target is above.

Each document is taken once per complete epoch, floor(target / source size).
The rest of a target is drawn without replacement: a document of quality
weight w gets the key u^(1/w), u a hash of doc_id and size, and documents are
taken by falling key until the words left are used up.  The document at the
edge is cut there (``whole_documents``: taken whole or not at all, whichever
is nearer), so taken words meet the target to the word.

The prefix sums of a hot source do not pass through one task: words are summed
by ``KEY_BLOCKS`` blocks of the key, the block at the edge is found from those
sums, and only its documents are put in order.

A null or empty text has size 0 and nothing taken.  A null source is one
source.  Without words all targets are 0.  Quality weights that are missing
count 1, others at least 1e-6.  Rows that repeat a doc_id are documents of their
own; which of two equal rows is at the edge does not show.  Other columns are
ignored, also where they carry the names of the results.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .tables import map_batches, saved

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
KEY_BLOCKS = 4096


def _sizes(batch: pa.RecordBatch):
    for row, buf, offs in W.chunks(batch.column(2)):
        w = W.split_words(buf, offs, W.SPACE_WORDS)
        n = len(offs) - 1
        yield {"doc_id": batch.column(0).slice(row, n), "source": batch.column(1).slice(row, n),
               "size": pa.array(w.counts(), pa.int64())}


def source_targets(sized: DataFrame) -> DataFrame:
    """``source, source_size, target`` from ``(source, size)`` rows."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # one row per source
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((rank - 1) % len(WEIGHTS) + 1).cast("int"))
    per = (per.withColumn("weight", weight).withColumn("cap", MAX_EPOCHS * F.col("source_size"))
           .withColumn("ratio", F.col("cap") / F.col("weight")))
    # Sources fill up in order of cap / weight; `level` is the share per weight if all before are full.
    by_ratio = Window.orderBy("ratio", "weight", F.col("source").asc_nulls_last())
    full = F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1))
    left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.partitionBy()
    per = per.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(full, F.lit(0))) / left)
    per = per.withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(whole)["level"])
    return per.select("source", "source_size",
                      F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, quality: DataFrame | None = None, seed: int = 17,
                whole_documents: bool = False) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of every row of
    ``docs(doc_id, text, source)``; ``quality(doc_id, weight)``, if given,
    weighs documents."""
    sized = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                    F.col("source").cast("string").alias("source"),
                                    F.col("text").cast("string").alias("text")),
                        _sizes, "doc_id long, source string, size long")
    if quality is None:
        sized = sized.withColumn("weight", F.lit(1.0))
    else:
        each = (quality.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("weight").cast("double").alias("weight"))
                .where("doc_id IS NOT NULL AND NOT isnan(weight)").groupBy("doc_id").agg(F.max("weight").alias("weight")))
        sized = sized.join(each, "doc_id", "left")
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                                        F.lit(":"), F.col("size").cast("string"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    key = 1 - F.pow(u, 1 / F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(1e-6)))  # rising: best first
    sized = saved(sized.select("doc_id", "source", "size", key.alias("key"))
                  .withColumn("block", F.least(F.floor(F.col("key") * KEY_BLOCKS), F.lit(KEY_BLOCKS - 1)).cast("int")),
                  "sized")

    targets = source_targets(sized)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = (targets.withColumn("epochs", epochs)
               .withColumn("rest", F.round("target").cast("long") - F.col("epochs") * F.col("source_size")))
    blocks = sized.groupBy("source", "block").agg(F.sum("size").alias("words"))
    so_far = F.sum("words").over(Window.partitionBy("source").orderBy("block"))
    edge = (blocks.withColumn("upto", so_far).alias("k")
            .join(targets.alias("t"), F.col("k.source").eqNullSafe(F.col("t.source")) & (F.col("upto") >= F.col("rest")))
            .groupBy(F.col("k.source").alias("source"))
            .agg(F.min_by(F.struct("block", (F.col("upto") - F.col("words")).alias("before")), "block").alias("edge")))
    targets = saved(targets.alias("t").join(edge.alias("e"), F.col("t.source").eqNullSafe(F.col("e.source")), "left")
                    .select(F.col("t.source").alias("s"), "source_size", "target", "epochs", "rest",
                            F.col("edge.block").alias("edge"), F.col("edge.before").alias("before")), "targets")

    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("s")))
    out = ["doc_id", "source", "size", "source_size", "target"]
    clear = rows.where("block <> edge").select(
        *out, (F.col("epochs") * F.col("size") + F.when(F.col("block") < F.col("edge"), F.col("size")).otherwise(0))
        .alias("taken"))
    upto = F.col("before") + F.sum("size").over(
        Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - (F.col("upto") - F.col("size"))))
    if whole_documents:
        part = F.when(2 * part >= F.col("size"), F.col("size")).otherwise(0)
    at_edge = rows.where("block = edge").withColumn("upto", upto).select(
        *out, (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))
    return clear.union(at_edge)
