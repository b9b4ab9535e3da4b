"""R1/R2 while results arrive: running totals as a streaming aggregate.

Result rows land as parquet files.  The roll-up is the batch operator itself
(``operators.prompts.variation_rollup``) over the stream; its sums, counts and means are
the query's state, in its checkpoint.  Every run takes what is new, replaces the totals
and stops; a run after a failure goes on from the checkpoint, so the totals end equal to
those of a batch over all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

RESULTS_DDL = "variation_name string, bleu double, successful_runs long, total_runs long"


def rollup_once(spark: SparkSession, incoming: str, totals: str, checkpoint: str,
                rollup: Callable[[DataFrame], DataFrame], ddl: str = RESULTS_DDL) -> None:
    """Take all new files of ``incoming`` and write the totals so far under ``totals``:
    a folder a batch, replaced if the batch is run again."""
    def step(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{totals}/epoch={epoch}")

    q = (rollup(spark.readStream.schema(ddl).parquet(incoming)).writeStream.outputMode("complete").foreachBatch(step)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def current_totals(spark: SparkSession, totals: str) -> DataFrame:
    """The totals of the last batch."""
    every = spark.read.parquet(totals)
    last = every.agg(F.max("epoch").alias("epoch"))        # one row
    return every.join(F.broadcast(last), "epoch").drop("epoch")


def run_rollups(spark: SparkSession, runs: list[DataFrame], rollup: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Feed ``runs`` one after the other through a fresh stream; the totals after the last."""
    incoming, totals, checkpoint = (scratch_path(spark, f"rollup-{x}") for x in ("in", "totals", "state"))
    for run in runs:
        run.selectExpr(*(f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in RESULTS_DDL.split(", "))) \
            .write.mode("append").parquet(incoming)
        rollup_once(spark, incoming, totals, checkpoint, rollup)
    return current_totals(spark, totals)
