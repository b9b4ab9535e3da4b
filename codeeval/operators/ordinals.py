"""Ordinals, keep-first and trailing windows that stay correct and balanced
when one key holds a large share of the rows.

* ``rank_within``   -- 0-based position of a row inside its group, ordered by
  an integer column that is unique per group.  Rows are cut into blocks of
  ``block`` consecutive order values, so a window never sees more than
  ``block`` rows; the per-block counts (``rows / block`` of them) are
  prefix-summed and joined back.
* ``running_sum_within`` -- the same blocking for a running sum.
* ``global_ordinal`` -- 0-based position of every distinct value of a column
  over the whole table (what ``zipWithIndex`` gives), computed from a
  range-partitioned, checkpointed copy of the key column plus a table of
  per-partition counts whose size is the number of partitions.
* ``rank_in_order`` -- ``rank_within`` for any order (e.g. time, id), blocked by
  range partitions instead of values.
* ``keep_first``     -- first row per key by an order column: an aggregate over
  the narrow columns, then a semi-join.
* ``trailing_mean``  -- mean of the current and ``width-1`` previous rows per
  group, evaluated per block with a halo of ``width-1`` rows copied from the
  previous block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 4096


def rank_within(df: DataFrame, part: list[str], order: str | list[str], out: str = "rank",
                block: int = DEFAULT_BLOCK, block_col: Column | None = None) -> DataFrame:
    """Add ``out`` = 0-based rank of a row within ``part`` by ``order``.

    By default ``order`` is one integral column, unique within ``part``, and
    blocks are runs of ``block`` consecutive values (so a window sees at most
    ``block`` rows).  ``block_col`` supplies another monotone block id -- e.g.
    a time bucket when ordering by ``(ts, id)``.
    """
    order = [order] if isinstance(order, str) else list(order)
    blk = block_col if block_col is not None else F.floor(F.col(order[0]) / F.lit(block))
    d = df.withColumn("_blk", blk.cast("long"))
    local = Window.partitionBy(*part, "_blk").orderBy(*order)
    d = d.withColumn("_local", (F.row_number().over(local) - 1).cast("long"))
    counts = d.groupBy(*part, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*part).orderBy("_blk") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*part, "_blk",
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_off"))
    return (d.join(offsets, part + ["_blk"])
             .withColumn(out, F.col("_off") + F.col("_local"))
             .drop("_blk", "_local", "_off"))


def running_sum_within(df: DataFrame, part: list[str], order: str, value: str, out: str,
                       inclusive: bool = True, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Add ``out`` = running sum of ``value`` within ``part`` in ``order``
    (``inclusive`` of the current row or not).  Same blocking as
    ``rank_within``: a window sees at most ``block`` rows, block totals are
    prefix-summed over a ``block``-times smaller table and joined back.
    ``order`` is integral and unique within ``part``."""
    d = df.withColumn("_blk", F.floor(F.col(order) / F.lit(block)).cast("long"))
    frame = Window.partitionBy(*part, "_blk").orderBy(order) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    d = d.withColumn("_local", F.coalesce(F.sum(value).over(frame), F.lit(0)))
    totals = d.groupBy(*part, "_blk").agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*part).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*part, "_blk", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    return (d.join(offsets, part + ["_blk"])
             .withColumn(out, F.col("_off") + F.col("_local"))
             .drop("_blk", "_local", "_off"))


def _ranged(df: DataFrame, order: list[str], partitions: int | None) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, checkpointed with its
    partition number ``__pid`` and a row number ``__row`` from 0 within it."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
           .withColumn("__pid", F.spark_partition_id()).withColumn("__mid", F.monotonically_increasing_id()))
    return (d.withColumn("__row", F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)).drop("__mid")
             .checkpoint(eager=True))


def global_ordinal(df: DataFrame, key: str | list[str], out: str = "ordinal",
                   partitions: int | None = None, unique: bool = False) -> DataFrame:
    """Distinct ``key`` tuples with their 0-based position in ascending order.

    The key columns are range-partitioned and sorted, then checkpointed to
    the shared checkpoint folder so both uses below see the same
    partitioning.  Only a ``(partition id, offset)`` table -- one row per
    partition -- is broadcast.  ``unique``: a key that occurs twice is an error
    (two rows would get one position).
    """
    keys_cols = [key] if isinstance(key, str) else list(key)
    keys = df.groupBy(*keys_cols).agg(F.count(F.lit(1)).alias("__n"))
    if unique:
        twice = F.concat(F.lit("ordering key occurs twice: "), F.to_json(F.struct(*keys_cols)))
        keys = keys.withColumn("__n", F.when(F.col("__n") > 1, F.raise_error(twice).cast("long")).otherwise(F.col("__n")))
        keys = keys.filter(F.col("__n") == 1)
    keys = _ranged(keys.select(*keys_cols), keys_cols, partitions)
    counts = keys.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    # one row per partition: a proven size bound, safe to broadcast
    return (keys.join(F.broadcast(offsets), "__pid")
                .select(*keys_cols, (F.col("__off") + F.col("__row")).cast("long").alias(out)))


def rank_in_order(df: DataFrame, part: list[str], order: list[str], out: str = "rank",
                  partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based rank within ``part`` by any sortable ``order``.

    Rows are range-partitioned by (part, order), so a group of any size is
    spread over as many partitions as it fills; a row's rank is its number in
    the partition's run of the group plus the rows of the group before that
    partition (a table of at most partitions + groups rows)."""
    d = _ranged(df, [*part, *order], partitions)
    runs = d.groupBy(*part, "__pid").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    before = Window.partitionBy(*part).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(*part, "__pid", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return (d.join(offsets, [*part, "__pid"])
             .withColumn(out, (F.col("__off") + F.col("__row") - F.col("__first")).cast("long"))
             .drop("__pid", "__row", "__first", "__off"))


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Row per ``key`` that is first by ``order`` (unique within a key).  Only
    key and order columns are aggregated (partially, so a hot key collapses
    before the shuffle); the rows themselves are picked by a semi-join."""
    first = (df.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first"))
               .select(*key, *[F.col(f"_first.{c}").alias(c) for c in order]))
    return df.join(first, [*key, *order], "left_semi").select(*df.columns)


def trailing_mean(df: DataFrame, part: list[str], step: str, value: str, width: int,
                  out: str = "smoothed", block: int = DEFAULT_BLOCK) -> DataFrame:
    """Mean of ``value`` over the current and previous ``width-1`` steps.

    ``step`` must be dense 1..n per group (as produced by ``rank_within``).
    Each block of ``block`` steps also receives the last ``width-1`` rows of
    the previous block (marked as halo) so its window is complete.
    """
    assert block >= width
    base = df.withColumn("_blk", F.floor((F.col(step) - 1) / F.lit(block)).cast("long")) \
             .withColumn("_halo", F.lit(False))
    pos = (F.col(step) - 1) % F.lit(block)
    halo = (base.filter(pos >= block - (width - 1))
                .withColumn("_blk", F.col("_blk") + 1)
                .withColumn("_halo", F.lit(True)))
    w = Window.partitionBy(*part, "_blk").orderBy(step).rowsBetween(-(width - 1), 0)
    return (base.unionByName(halo)
                .withColumn(out, F.avg(value).over(w))
                .filter(~F.col("_halo"))
                .drop("_blk", "_halo"))
