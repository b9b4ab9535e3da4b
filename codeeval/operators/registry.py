"""Run registry: config hash, append-if-absent, record assembly, and the
leaderboard / trend rollups over it.

Registry rows follow D9: model_hash, timestamp, model_type, batch_size,
gradient_accumulation_steps, learning_rate, num_train_epochs, max_steps,
warmup_steps, optimizer, weight_decay, lr_scheduler, lora_rank, lora_alpha,
lora_dropout, target_modules, use_gradient_checkpointing,
train_dataset_size, test_dataset_size, avg_bleu,
execution_check{successful_runs, total_snippets}; plus ``seq`` (file order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from .ordinals import global_ordinal, keep_first

REGISTRY_DDL = (
    "model_hash string, timestamp string, model_type string, batch_size int, "
    "gradient_accumulation_steps int, learning_rate double, num_train_epochs int, "
    "max_steps int, warmup_steps int, optimizer string, weight_decay double, "
    "lr_scheduler string, lora_rank int, lora_alpha int, lora_dropout double, "
    "target_modules array<string>, use_gradient_checkpointing string, "
    "train_dataset_size int, test_dataset_size int, avg_bleu double, "
    "execution_check struct<successful_runs:int,total_snippets:int>"
)


def config_hash(batch_size: Column, lr_text: Column, epochs: Column, max_steps: Column,
                train_size: Column, test_size: Column, lora_rank: Column, lora_alpha: Column,
                dropout_text: Column) -> Column:
    """G1: sha256 of the fine-tuned run key.  The learning rate and dropout
    are given as text exactly as the writer printed them (Spark prints
    doubles differently from Python, e.g. ``2.0E-4`` vs ``0.0002``)."""
    s = F.concat(F.lit("batch_size="), batch_size.cast("string"),
                 F.lit("-lr="), lr_text,
                 F.lit("-epochs="), epochs.cast("string"),
                 F.lit("-max_steps="), max_steps.cast("string"),
                 F.lit("-train_size="), train_size.cast("string"),
                 F.lit("-test_size="), test_size.cast("string"),
                 F.lit("-lora_rank="), lora_rank.cast("string"),
                 F.lit("-lora_alpha="), lora_alpha.cast("string"),
                 F.lit("-lora_dropout="), dropout_text)
    return F.sha2(s, 256)


def base_config_hash(train_size: Column, test_size: Column) -> Column:
    """G1, base-model form."""
    return F.sha2(F.concat(F.lit("base_model-train_size="), train_size.cast("string"),
                           F.lit("-test_size="), test_size.cast("string")), 256)


def registry_append(registry: DataFrame, new_records: DataFrame, seq: str = "seq") -> DataFrame:
    """Append records whose hash is absent; the first writer wins (within
    the batch by ``seq``, and an existing row is never updated).  New rows
    get ``seq`` after the registry's last; a ``seq`` that occurs twice in the
    batch is an error."""
    first = keep_first(new_records, ["model_hash"], [seq])
    fresh = first.join(registry.select("model_hash"), "model_hash", "left_anti")
    top = registry.agg(F.coalesce(F.max(seq), F.lit(-1)).alias("_top"))        # one row
    pos = global_ordinal(fresh.select(seq), seq, out="_pos", unique=True)
    fresh = (fresh.join(pos, seq).crossJoin(F.broadcast(top))
                  .withColumn(seq, F.col("_top") + 1 + F.col("_pos")).drop("_top", "_pos"))
    return registry.unionByName(fresh.select(*registry.columns))


def registry_record(runs: DataFrame, exec_stats: DataFrame, bleu: DataFrame,
                    key: str = "run_id") -> DataFrame:
    """Assemble D9 rows from a run-config table, the execution rollup
    and the BLEU average (M3), keyed by ``key``."""
    d = runs.join(exec_stats, key, "left").join(bleu, key, "left")
    finetuned = F.col("model_type") == "finetuned"
    return d.select(
        key, "seq",
        F.when(finetuned, config_hash(F.col("batch_size"), F.col("learning_rate_text"), F.col("num_train_epochs"),
                                      F.col("max_steps"), F.col("train_dataset_size"), F.col("test_dataset_size"),
                                      F.col("lora_rank"), F.col("lora_alpha"), F.col("lora_dropout_text")))
         .otherwise(base_config_hash(F.col("train_dataset_size"), F.col("test_dataset_size"))).alias("model_hash"),
        "model_type", "batch_size", "learning_rate", "num_train_epochs", "max_steps",
        "lora_rank", "lora_alpha", "lora_dropout", "train_dataset_size", "test_dataset_size",
        F.coalesce(F.col("avg_bleu"), F.lit(0.0)).alias("avg_bleu"),
        F.struct(F.coalesce(F.col("successful_runs"), F.lit(0)).cast("int").alias("successful_runs"),
                 F.coalesce(F.col("total_snippets"), F.lit(0)).cast("int").alias("total_snippets"))
         .alias("execution_check"))


def with_rate(registry: DataFrame) -> DataFrame:
    """X12 on registry rows: success rate, 0 for zero total snippets."""
    return registry.withColumn("success_rate", T.safe_rate(F.col("execution_check.successful_runs"),
                                                           F.col("execution_check.total_snippets")))


def size_statistics(registry: DataFrame) -> DataFrame:
    """Per training size -- number of runs, max / mean / min
    success rate -- sizes ascending."""
    r = with_rate(registry)
    return (r.groupBy(F.col("train_dataset_size"))
             .agg(F.count(F.lit(1)).alias("num_models"),
                  F.round(F.max("success_rate"), 6).alias("max_rate"),
                  F.round(F.avg("success_rate"), 6).alias("avg_rate"),
                  F.round(F.min("success_rate"), 6).alias("min_rate"))
             .orderBy("train_dataset_size"))


def best_series_by_size(registry: DataFrame) -> DataFrame:
    """Best mean BLEU and best success rate per size, sizes ascending."""
    r = with_rate(registry)
    return (r.groupBy("train_dataset_size")
             .agg(F.round(F.max("avg_bleu"), 6).alias("best_bleu"),
                  F.round(F.max("success_rate"), 6).alias("best_rate"))
             .orderBy("train_dataset_size"))


def best_run_per_size(registry: DataFrame, seq: str = "seq") -> DataFrame:
    """Per size, the run with the highest success rate, then BLEU; ties
    keep file order.  A max over a struct -- an aggregate, so a size holding
    most runs is still combined map-side."""
    r = with_rate(registry)
    best = F.max(F.struct(F.col("success_rate"), F.col("avg_bleu"), (-F.col(seq)).alias("_neg_seq"),
                          F.col("model_hash"))).alias("_b")
    return (r.groupBy("train_dataset_size").agg(best, F.count(F.lit(1)).alias("num_models"))
             .select("train_dataset_size", F.col("_b.model_hash").alias("model_hash"),
                     (-F.col("_b._neg_seq")).alias(seq),
                     F.round(F.col("_b.success_rate"), 6).alias("success_rate"),
                     F.round(F.col("_b.avg_bleu"), 6).alias("avg_bleu"), "num_models"))


def performance_trend(registry: DataFrame, seq: str = "seq") -> DataFrame:
    """Best rate per size; for consecutive sizes the size and rate deltas;
    ``is_best_size`` marks the size with the highest best rate (ties: the
    size that appears first in the registry).

    The lag window runs over the per-size aggregate -- one row per distinct
    training size -- not over runs.
    """
    r = with_rate(registry)
    per = r.groupBy("train_dataset_size").agg(F.max("success_rate").alias("best_rate"),
                                              F.min(seq).alias("_first"))
    w = Window.orderBy("train_dataset_size")
    top = per.agg(F.max(F.struct(F.col("best_rate"), (-F.col("_first")).alias("_nf"),
                                 F.col("train_dataset_size"))).alias("_t"))      # one row
    return (per.withColumn("prev_size", F.lag("train_dataset_size").over(w))
               .withColumn("_prev_rate", F.lag("best_rate").over(w))
               .crossJoin(F.broadcast(top))
               .select("train_dataset_size", F.round("best_rate", 6).alias("best_rate"), "prev_size",
                       (F.col("train_dataset_size") - F.col("prev_size")).alias("delta_size"),
                       F.round(F.col("best_rate") - F.col("_prev_rate"), 6).alias("delta_rate"),
                       (F.col("train_dataset_size") == F.col("_t.train_dataset_size")).alias("is_best_size")))


def trial_scores(trials: DataFrame) -> DataFrame:
    """score = 0.7 * execution rate + 0.3 * mean BLEU; missing counts
    default to 0 of 1, missing BLEU to 0."""
    ok = F.coalesce(F.col("execution_check.successful_runs"), F.lit(0))
    total = F.coalesce(F.col("execution_check.total_snippets"), F.lit(1))
    rate = F.when(total != 0, ok.cast("double") / total).otherwise(F.lit(0.0))
    bleu = F.coalesce(F.col("avg_bleu"), F.lit(0.0))
    return trials.withColumn("execution_rate", rate) \
                 .withColumn("score", F.lit(fixed.TRIAL_RATE_WEIGHT) * rate + F.lit(fixed.TRIAL_BLEU_WEIGHT) * bleu)


def trial_score_topk(trials: DataFrame, k: int = 1, seq: str = "seq") -> DataFrame:
    """The best ``k`` trials by score (ties: file order).  ``limit`` is
    the feature here; Spark plans it as a per-partition top-k merge."""
    s = trial_scores(trials)
    return (s.orderBy(F.col("score").desc(), F.col(seq).asc()).limit(k)
             .select("model_hash", seq, F.round("execution_rate", 6).alias("execution_rate"),
                     F.round("avg_bleu", 6).alias("avg_bleu"), F.round("score", 6).alias("score")))
