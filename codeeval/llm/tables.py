"""Steps that several operators share: tables written to the shared folder,
row identity and numbered partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under ``spark.checkpoint.dir`` and read back:
    later steps start from files that outlive any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` as long and ``text`` as string, whatever else the table holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` over record batches; ``fn`` yields dicts of Arrow arrays."""
    names = [f.name for f in df.sparkSession.createDataFrame([], schema).schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for out in fn(batch):
                    yield pa.RecordBatch.from_arrays([out[n] for n in names], names)

    return df.mapInArrow(run, schema)


def same(a: str, b: str, col: str = "doc_id") -> Column:
    return F.col(f"{a}.{col}").eqNullSafe(F.col(f"{b}.{col}"))


def n_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """``rows`` left-joined with ``table`` (unique by ``keys``) where one key may
    hold a third of all rows.  Rows are dealt on by ``by``; each of a key's deals
    gets the table's row first, so a key brings at most as many rows to one task
    as there are deals, and each deal only its own rows.  ``rows`` is read twice:
    give a written table."""
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64(by), F.lit(n_partitions(rows.sparkSession))).cast("int"))
    deals = dealt.select(*keys, "_deal").distinct().join(table, keys)
    return dealt.join(deals, [*keys, "_deal"], "left").drop("_deal")


#: Slots of the bit tables of ``maybe_in``: 1 MB, whatever the size of the data.
SLOTS = 1 << 23


def maybe_in(rows: DataFrame, column: str, ids: DataFrame, out: str) -> DataFrame:
    """``rows`` with a boolean ``out``: false only if ``column`` is not in the one column of
    ``ids``.  The executors set a bit for each id in a table of fixed size, kept as rows
    of 4 KB and broadcast; the more ids, the more others pass as well, so an exact join
    has to follow.  It spares the shuffle of rows that the join would drop."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)) + 1
    table = (ids.select(slot(ids.columns[0]).alias("_s")).groupBy(F.bitmap_bucket_number("_s").alias("_bucket"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_s")).alias("_bits")))      # at most SLOTS / 32768 rows
    at = F.bitmap_bit_position(slot(column))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1
    return (rows.withColumn("_bucket", F.bitmap_bucket_number(slot(column))).join(F.broadcast(table), "_bucket", "left")
            .select(*rows.columns, F.coalesce(bit, F.lit(False)).alias(out)))


def possible(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose ``column`` may be in the one column of ``ids``."""
    return maybe_in(rows, column, ids, "_may").where("_may").drop("_may")
