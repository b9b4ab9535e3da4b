"""J1 as a Structured Streaming job.

New snippets land as parquet files in an incoming folder; rows carry
``snippet_hash``.  ``dedup_stream_once`` keeps the hash ledger as the query's state:
an aggregate by hash holds the first row that had it, by run and then by ``(conv_id,
k)``, so within a run, too, the first pair in order is the one processed.  It is
evaluated by Spark's own streaming aggregate (no Python per row), and state and
progress live in the query's checkpoint (RocksDB for large ledgers).  An earlier
ledger can seed the state, and ``ledger_from_state`` reads the state back as a
ledger table.  Each run takes whatever is new (``availableNow``) as one micro-batch
and stops, so a second run over the same checkpoint emits only hashes it has never
seen.  ``dedup_stream_to_ledger`` is the form that keeps the ledger as a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

SNIPPET_DDL = "snippet_hash string, conv_id long, k long"


def seed_ledger(ledger: DataFrame, incoming: str) -> None:
    """Put the hashes of an earlier ledger into the stream's input: they are known
    from then on and never emitted, also if their first pair is in the same run."""
    (ledger.select("snippet_hash", F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("k"))
        .where("snippet_hash IS NOT NULL").distinct().write.mode("append").parquet(incoming))


def dedup_stream_once(spark: SparkSession, incoming: str, sink: str, checkpoint: str) -> None:
    """Process all files currently in ``incoming``; write the first row of every new
    hash to ``sink``.  Rows without a hash cannot be recognised and are left out.

    Every row of a micro-batch has the batch's time, which the checkpoint keeps, so a
    hash is new where the time of its first row is that of its last.  A batch writes
    a folder of its own and replaces it if it is run again."""
    seen = (spark.readStream.schema(SNIPPET_DDL).parquet(incoming).where("snippet_hash IS NOT NULL")
                 .withColumn("at", F.current_timestamp()).withColumn("paired", F.col("conv_id").isNotNull())
                 .groupBy("snippet_hash")
                 .agg(F.min(F.struct("at", "paired", "conv_id", "k")).alias("first"), F.max("at").alias("last")))

    def step(batch: DataFrame, epoch: int) -> None:
        (batch.where("first.at = last AND first.paired").select("snippet_hash", "first.conv_id", "first.k")
              .write.mode("overwrite").parquet(f"{sink}/epoch={epoch}"))

    q = (seen.writeStream.outputMode("update").foreachBatch(step)
             .option("checkpointLocation", checkpoint)
             .trigger(availableNow=True)
             .start())
    q.awaitTermination()


def ledger_from_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The ledger (D8) that a stream's state holds: every hash it has seen or was seeded with."""
    return spark.read.format("statestore").load(checkpoint).select("key.snippet_hash")


def run_ledger_batches(spark: SparkSession, batches: list[DataFrame], seed: DataFrame | None = None) -> DataFrame:
    """Several runs over one ledger table (I6, S5): each batch arrives as files,
    the stream picks up where the last run stopped, and the callback (F1) writes
    what was new.  ``seed`` is an earlier ledger.  Returns ``(conv_id, k,
    snippet_hash)`` of the pairs processed, the first of each hash."""
    from ..sources.writers import append_ledger
    incoming, ledger, checkpoint, sink = (scratch_path(spark, f"ledger-{x}") for x in ("in", "table", "state", "new"))
    if seed is not None:
        append_ledger(seed, ledger)
    for batch in batches:
        batch.select("snippet_hash", "conv_id", "k").write.mode("append").parquet(incoming)
        dedup_stream_to_ledger(spark, incoming, ledger, checkpoint,
                               on_new=lambda new, epoch: new.write.mode("append").parquet(sink))
    return spark.read.schema(SNIPPET_DDL).parquet(sink).select("conv_id", "k", "snippet_hash")


def run_dedup_stream(spark: SparkSession, runs: list[DataFrame], seed: DataFrame | None = None) -> tuple[DataFrame, str]:
    """Feed ``runs`` one after the other through a fresh stream, seeded from an earlier
    ledger.  Returns what it emitted, ``(snippet_hash, conv_id, k)``, and its checkpoint."""
    incoming, sink, checkpoint = (scratch_path(spark, f"dedup-{x}") for x in ("incoming", "sink", "checkpoint"))
    if seed is not None:
        seed_ledger(seed, incoming)
    for run in runs:
        run.select("snippet_hash", "conv_id", "k").write.mode("append").parquet(incoming)
        dedup_stream_once(spark, incoming, sink, checkpoint)
    return spark.read.schema(SNIPPET_DDL).parquet(sink).select("snippet_hash", "conv_id", "k"), checkpoint


def dedup_stream_to_ledger(spark: SparkSession, incoming: str, ledger_path: str, checkpoint: str,
                           on_new=None) -> None:
    """J1 with the ledger as a table (S5) instead of state: every micro-batch
    keeps the first row per hash within the batch, anti-joins the ledger,
    appends the new hashes, and passes the new rows to ``on_new(df, epoch)``
    (the per-snippet callback of the original, F1, as a DataFrame).

    Delivery is at-least-once for ``on_new`` and idempotent for the ledger:
    the ledger append is the last step of a batch, so a batch replayed after
    a failure either finds its hashes already in the ledger (append had
    committed -> nothing new) or re-runs the callback (append had not).
    Duplicate ledger rows are harmless; the ledger is read with ``distinct``.
    """
    from ..operators.dedup import dedup_ledger
    from ..sources.readers import read_ledger
    from ..sources.writers import append_ledger

    def step(batch: DataFrame, epoch: int) -> None:
        fresh = dedup_ledger(batch, read_ledger(spark, ledger_path), order=("conv_id", "k"))
        fresh = fresh.checkpoint(eager=True)          # evaluate once, before the ledger moves
        if on_new is not None:
            on_new(fresh, epoch)
        append_ledger(fresh, ledger_path)

    q = (spark.readStream.schema(SNIPPET_DDL).parquet(incoming)
              .writeStream.foreachBatch(step)
              .option("checkpointLocation", checkpoint)
              .trigger(availableNow=True)
              .start())
    q.awaitTermination()
