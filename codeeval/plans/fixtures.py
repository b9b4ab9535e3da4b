"""Stand-in inputs built from the driver tables.

The driver's tables hold no code-generation data, so each domain input is a
view over them.  These views only give rows in the schema the operators
expect; all of the operators' work happens in ``codeeval.operators``.  The
same views are written in SQL in ``plans.oracle``.

* messages        -- ``conversations`` with ``user`` read as ``human``.
* doc_snippets    -- one generated snippet per ``documents`` row: variation =
                     ``source``, prompt = the ``benchmark`` text of item
                     ``doc_id % items``, response = the text wrapped four ways
                     by ``doc_id % 4`` (plain, scala fence, fence +
                     end-of-text token, bare fence) so the cleaners see every
                     shape.
* generation log  -- the same snippets as answers of model ``lang`` to the
                     variation ``doc_id / items % 5`` of their prompt.
* text_pairs      -- documents as pairs (prompt = lang, code = text), four to a
                     conversation; exact copies repeat a hash.
* verdicts        -- build/run verdicts from ``labels`` by ``doc_id``:
                     ``toxic = 0`` builds, ``quality = 1`` runs; unlabelled
                     documents were not executed.
* transcripts     -- decoded model output around each P4 pair, in four
                     shapes by ``conv_id % 4`` (lower-case markers, upper-case
                     markers, no user part, no markers).
* main / new      -- J2/J3: even ``doc_id`` documents form the main dataset
                     (2-message conversations), odd ones are new snippets, two
                     to a conversation.  Prompt = source, language and length.
* ledger          -- hashes already processed: the first exchange (k = 0) of
                     every conversation, as an earlier run would have seen.
* run_configs     -- one training run per (source, lang) of ``documents``; it is
                     evaluated on the P4 pairs of the conversations whose id is
                     one of its documents (verdicts by that id).
* metric history  -- ``events``: run = ``user_id``, ordered by (ts, event_id),
                     loss = ``value``.
* test prompts    -- ``benchmark.text``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..operators import pairs as P
from ..sources.readers import read_table


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return P.normalize_roles(read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"))


def raw_messages(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """One row: how many benchmark items there are."""
    return read_table(spark, sf, "benchmark").agg(F.count(F.lit(1)).alias("n_items"))


def doc_snippets(spark: SparkSession, sf: str) -> DataFrame:
    items = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("prompt_index"), F.col("text").alias("prompt"))
    d = (read_table(spark, sf, "documents").select("doc_id", "text", "source", "lang", "n_chars")
         .crossJoin(F.broadcast(_items(spark, sf)))
         .withColumn("prompt_index", F.col("doc_id") % F.col("n_items"))
         .withColumn("variation_no", (F.floor(F.col("doc_id") / F.col("n_items")) % 5).cast("int"))
         .join(items, "prompt_index", "left"))
    shape = F.col("doc_id") % 4
    response = (F.when(shape == 0, F.col("text"))
                 .when(shape == 1, F.concat(F.lit("```scala\n"), F.col("text"), F.lit("\n```")))
                 .when(shape == 2, F.concat(F.lit("```scala\n"), F.col("text"), F.lit("\n```"),
                                            F.lit(fixed.END_OF_TEXT)))
                 .otherwise(F.concat(F.lit("```"), F.col("text"))))
    return d.select("doc_id", F.col("doc_id").alias("seq"), F.col("source").alias("variation_name"), "lang",
                    "prompt_index", "variation_no",
                    F.coalesce("prompt", F.lit("")).alias("prompt"), F.lit(fixed.BASE_SYSTEM_PROMPT).alias("system_prompt"),
                    response.alias("response"), (F.col("n_chars") / 1000.0).alias("time_taken"), "n_chars")


def text_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select(
        "doc_id", F.floor(F.col("doc_id") / 4).alias("conv_id"), (F.col("doc_id") % 4).alias("k"),
        F.col("lang").alias("prompt"), F.col("text").alias("code"))


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    lab = read_table(spark, sf, "labels")
    did = F.col("doc_id").cast("string")
    return lab.select(
        "doc_id",
        (F.col("toxic") == 0).alias("build_ok"),
        F.concat(F.lit("[error] Main.scala: compilation failed for snippet "), did,
                 F.lit("\n[error] (Compile / compileIncremental) Compilation failed\n")).alias("build_message"),
        (F.col("quality") == 1).alias("run_ok"),
        F.when(F.col("quality") == 1, F.lit("Run completed successfully"))
         .otherwise(F.concat(F.lit("[error] Nonzero exit code returned from runner: 1\n[error] snippet "), did,
                             F.lit(" failed"))).alias("run_message"))


def transcripts(pairs: DataFrame) -> DataFrame:
    shape = F.col("conv_id") % 4
    t = (F.when(shape == 0, F.concat(F.lit("user\n\n"), F.col("prompt"), F.lit("\nassistant\n\n"), F.col("code")))
          .when(shape == 1, F.concat(F.lit("USER \n\n"), F.col("prompt"), F.lit(" ASSISTANT\n\n"), F.col("code"),
                                     F.lit(fixed.END_OF_TEXT)))
          .when(shape == 2, F.concat(F.lit("assistant\n\n"), F.col("code")))
          .otherwise(F.col("code")))
    return pairs.withColumn("generated", t)


def _short_prompt() -> Column:
    return F.concat_ws("/", "source", "lang", F.col("n_chars").cast("string"))


def main_messages(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").filter(F.col("doc_id") % 2 == 0)
    return d.select(F.col("doc_id").alias("conv_id"), F.inline(F.array(
        F.struct(F.lit(0).cast("long").alias("turn"), F.lit(fixed.HUMAN).alias("role"), _short_prompt().alias("text")),
        F.struct(F.lit(1).cast("long").alias("turn"), F.lit(fixed.ASSISTANT).alias("role"), F.col("text").alias("text")))))


def new_pairs(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").filter(F.col("doc_id") % 2 == 1)
    return d.select(F.floor(F.col("doc_id") / 4).alias("conv_id"), (F.col("doc_id") % 4).alias("k"),
                    _short_prompt().alias("prompt"), F.col("text").alias("code"), "doc_id")


def ledger(context_pairs: DataFrame) -> DataFrame:
    return context_pairs.filter(F.col("k") == 0).select(T.snippet_hash("prompt", "code").alias("snippet_hash"))


def run_configs(spark: SparkSession, sf: str) -> DataFrame:
    """One run per (source, lang) of documents, with a training configuration
    derived from the group's names."""
    d = read_table(spark, sf, "documents")
    src = F.substring(F.col("source"), 4, 10).cast("int")
    rank = F.when(F.col("lang") == "en", 64).when(F.col("lang") == "de", 32) \
            .when(F.col("lang") == "fr", 16).otherwise(8)
    return (d.groupBy("source", "lang").agg(F.min("doc_id").alias("seq"))
             .select(F.concat(F.col("source"), F.lit("/"), F.col("lang")).alias("run_id"), "seq", "source", "lang",
                     F.when(F.col("lang") == "es", F.lit("base")).otherwise(F.lit("finetuned")).alias("model_type"),
                     F.lit(2).alias("batch_size"), F.lit(0.0002).alias("learning_rate"),
                     F.lit("0.0002").alias("learning_rate_text"),
                     (F.lit(1) + src % 3).alias("num_train_epochs"), F.lit(-1).alias("max_steps"),
                     (F.lit(50) * (F.lit(1) + src % 5)).alias("train_dataset_size"),
                     F.lit(17).alias("test_dataset_size"),
                     rank.alias("lora_rank"), (rank * 2).alias("lora_alpha"),
                     F.lit(0.0).alias("lora_dropout"), F.lit("0").alias("lora_dropout_text")))


def run_outputs(spark: SparkSession, sf: str, pairs: DataFrame) -> DataFrame:
    """Evaluation rows of each run: pairs with the decoded output of the run's model."""
    d = read_table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/"), "lang").alias("run_id"))
    return transcripts(pairs).withColumn("doc_id", F.col("conv_id")).join(d, "doc_id")


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events").select(F.col("user_id").alias("run_id"), "ts", "event_id",
                                                  F.col("value").alias("loss"))


def test_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "benchmark").select(F.col("item_id").alias("prompt_index"),
                                                     F.col("text").alias("prompt"))


def run_histories(spark: SparkSession, sf: str) -> DataFrame:
    """D10 as a run's trainer leaves it: one row a run, its logged losses and
    learning rates in order (the rate is logged at two of three events)."""
    rate = F.when(F.col("event_id") % 3 != 0, F.round(F.col("value") / 1000, 6))
    logged = read_table(spark, sf, "events").groupBy(F.col("user_id").alias("run_id")).agg(
        F.array_sort(F.collect_list(F.struct("ts", "event_id", "value", rate.alias("rate")))).alias("e"))

    def series(c: str) -> Column:
        return F.filter(F.transform("e", lambda x: x[c]), lambda v: v.isNotNull())

    return logged.select(F.col("run_id").cast("string").alias("run_id"), F.lit(60.0).alias("training_time_seconds"),
                         F.struct(series("value").alias("loss"), series("rate").alias("learning_rate")).alias("metrics_history"))
