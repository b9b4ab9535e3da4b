"""Sinks.  Every writer is a distributed ``DataFrame.write``; only the
report (already aggregated to a few lines) is coalesced to one file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.formatting import rebuild_conversations


def write_conversations(messages: DataFrame, path: str, mode: str = "overwrite") -> None:
    """D1 records as JSON Lines, in ``conv_id`` order across part files."""
    (rebuild_conversations(messages).orderBy("conv_id").select("conversations")
        .write.mode(mode).json(path))


def write_conversations_array(messages: DataFrame, path: str, ascii_only: bool = True, mode: str = "overwrite") -> None:
    """S1 in the original's own form: one JSON array, indented by two, ASCII-escaped
    or UTF-8.  Many tasks write parts, in ``conv_id`` order (null first), and the parts'
    concatenation in order of their names is the array."""
    string = lambda c: T.json_string(c, ascii_only)
    nested = rebuild_conversations(messages).select("conv_id", "conversations")
    message = lambda m: F.concat(F.lit('      {\n        "from": '), string(m["from"]), F.lit(',\n        "value": '),
                                 string(m["value"]), F.lit("\n      }"))
    inner = F.when(F.size("conversations") > 0, F.concat(
        F.lit("[\n"), F.array_join(F.transform("conversations", message), ",\n"), F.lit("\n    ]"))).otherwise(F.lit("[]"))
    record = F.concat(F.lit('  {\n    "conversations": '), inner, F.lit("\n  }"))
    place = F.struct(F.col("conv_id").isNotNull().alias("known"), F.col("conv_id").alias("id"))
    ends = nested.agg(F.min(place).alias("first"), F.max(place).alias("last"))          # one row
    lines = nested.select("conv_id", record.alias("record"), place.alias("place")).crossJoin(F.broadcast(ends)).select(
        "conv_id", F.concat(F.when(F.col("place") == F.col("first"), "[\n").otherwise(""), F.col("record"),
                            F.when(F.col("place") == F.col("last"), "\n]").otherwise(",")).alias("value"))
    none = ends.where("first IS NULL").select(F.lit(None).cast("long").alias("conv_id"), F.lit("[]").alias("value"))
    (lines.union(none).repartitionByRange("conv_id").sortWithinPartitions("conv_id").select("value")
        .write.mode(mode).text(path))


def write_pairs_long(pairs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Pairs as ``(idx, kind, content)`` parquet partitioned by kind --
    instead of two files per pair.  ``idx`` numbering starts at 1."""
    long_form = pairs.select(F.col("idx"), F.inline(F.array(
        F.struct(F.lit("prompt").alias("kind"), F.col("prompt").alias("content")),
        F.struct(F.lit("code").alias("kind"), F.col("code").alias("content")))))
    long_form.write.mode(mode).partitionBy("kind").parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Evaluation results, documents or failing snippets as JSON Lines."""
    df.write.mode(mode).json(path)


def append_ledger(new_hashes: DataFrame, path: str) -> None:
    """Append only this batch's new hashes (never rewrite the ledger)."""
    new_hashes.select("snippet_hash").distinct().write.mode("append").parquet(path)


def write_report(lines: DataFrame, path: str) -> None:
    """The aggregated report lines as one text file, in order."""
    lines.orderBy("line_no").select("line").coalesce(1).write.mode("overwrite").text(path)


def append_registry(new_rows: DataFrame, path: str) -> None:
    """Append the rows that G2 found absent."""
    new_rows.write.mode("append").json(path)


def write_eval_document(scored: DataFrame, path: str, training_dataset_size: int,
                        timestamp: str, metric: str = "bleu") -> None:
    """S3 (D4): per-pair ``(reference, generated, bleu)`` rows as JSON Lines
    under ``detailed_results/`` and the average as a one-row sidecar under
    ``summary/`` -- the document's parts written in parallel instead of one
    object through one writer.  The average is taken from the written results,
    so that the rows are scored once."""
    scored.select("reference", "generated", metric).write.mode("overwrite").json(f"{path}/detailed_results")
    written = scored.sparkSession.read.schema(f"`{metric}` double").json(f"{path}/detailed_results")
    (written.agg(F.coalesce(F.avg(metric), F.lit(0.0)).alias(metric))
            .select(F.lit(timestamp).alias("timestamp"), F.struct(metric).alias("average_metrics"),
                    F.lit(training_dataset_size).alias("training_dataset_size"))
            .write.mode("overwrite").json(f"{path}/summary"))
