"""The registered queries of this subpackage: each operator over its whole
table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat, debruijn, decontaminate, epsjoin, lines, minhash, mixing, pii, quality, runs, sharding, topk,
               trie)
from .tables import table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents (operator 1)."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), 85)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents (operator 2)."""
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def quality_weights(labels: DataFrame) -> DataFrame:
    """``doc_id, weight``: documents labelled good count twice, bad a quarter of those without a label."""
    return labels.where("quality IN (0, 1)").select(
        "doc_id", F.when(F.col("quality") == 1, 2.0).otherwise(0.25).alias("weight"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to their sources' targets (operator 3)."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"), quality_weights(table(spark, sf_dir, "labels")))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages without their site's boilerplate lines (operator 4)."""
    return lines.drop_boilerplate(table(spark, sf_dir, "pages"))


def op5_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents removed (operator 5)."""
    return debruijn.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth (operator 6)."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), 10, 100)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, read back from the output; conversation -1
    holds control strings (operator 7)."""
    odd = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
                                "conv_id long, turn long, role string, text string")
    every = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(odd)
    return chat.digests(chat.format_chats(every))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents (operator 8)."""
    return pii.summary(pii.personal_data(table(spark, sf_dir, "documents")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents (operator 9)."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards (operator 10)."""
    return sharding.shard(table(spark, sf_dir, "documents"), 40)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, every tenth with planted ones (operator 11)."""
    return runs.digests(runs.periodic_runs(runs.with_planted_runs(table(spark, sf_dir, "documents"))))


def op12_epsjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all embeddings (operator 12)."""
    return epsjoin.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt to share prefixes (operator 13)."""
    return trie.prefix_trie(*trie.rebuilt(table(spark, sf_dir, "conversations")))


def all_queries() -> dict:
    return {f.__name__: f for f in (op1_minhash, op2_decontaminate, op3_mixing, op4_lines, op5_debruijn, op6_topk,
                                      op7_chat, op8_pii, op9_quality, op10_sharding, op11_runs, op12_epsjoin, op13_trie)}
