"""Readers: conversation datasets, evaluation documents, generation logs,
prompt/code pair folders, the run registry, ledgers and metric history.

Schemas are always explicit (never inferred).  JSON Lines and single JSON arrays
are both split over tasks (the latter by ``sources.json_arrays``) and keep file order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import text as T
from ..operators.registry import REGISTRY_DDL
from .json_arrays import array_records

MESSAGE_DDL = "array<struct<`from`:string,value:string>>"
CONVERSATION_DDL = f"conversations {MESSAGE_DDL}"
EVAL_DOC_DDL = ("timestamp string, average_metrics struct<bleu:double>, "
                "detailed_results array<struct<reference:string,generated:string,bleu:double>>, "
                "training_dataset_size int")
GENERATION_LOG_DDL = ("variation_name string, prompt string, system_prompt string, "
                      "response string, time_taken double")
FAILING_DDL = ("idx long, prompt string, code string, error string, error_output string, "
               "error_cause string, run_output string")
LEDGER_DDL = "snippet_hash string"
HISTORY_DDL = ("run_id string, training_time_seconds double, "
               "metrics_history struct<loss:array<double>,learning_rate:array<double>>")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table (one parquet per table)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file_rank() -> list[Column]:
    """Sort columns that put part files in order of their number, however many
    digits it has, and other files in order of their path."""
    name = F.element_at(F.split(F.col("_file"), "/"), -1)
    number = F.regexp_extract(name, r"^part-([0-9]{1,18})", 1)
    return [F.regexp_replace("_file", r"[^/]*$", ""), F.when(number != "", number.cast("long")), F.length(name), name]


def _with_file_order(df: DataFrame, out: str = "conv_id") -> DataFrame:
    """Attach ``out`` = position of the record over all input files (files in
    order, then split start, then line order inside the split).

    No record moves for it: one aggregate gives each input split its first row
    id and row count, the splits (one row each) are prefix-summed in order and
    joined back.  Row ids come from ``monotonically_increasing_id``, which is
    deterministic for a given scan and increases in read order within a split.
    """
    d = (df.withColumn("_file", F.col("_metadata.file_path"))
           .withColumn("_start", F.col("_metadata.file_block_start"))
           .withColumn("_mid", F.monotonically_increasing_id()))
    splits = d.groupBy("_file", "_start").agg(F.min("_mid").alias("_m0"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(*_file_rank(), "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_file", "_start", "_m0",
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (d.join(splits, ["_file", "_start"])
             .withColumn(out, (F.col("_off") + F.col("_mid") - F.col("_m0")).cast("long"))
             .drop("_file", "_start", "_mid", "_m0", "_off"))


def read_conversations_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """I1 (JSON Lines): records ``{"conversations": [...]}``; ``conv_id`` is the
    record's position.  Corrupt lines are kept in ``_corrupt_record``."""
    df = (spark.read.schema(f"{CONVERSATION_DDL}, _corrupt_record string")
               .option("mode", "PERMISSIVE").json(path))
    return _with_file_order(df).select("conv_id", "conversations", "_corrupt_record")


def read_conversations_array(spark: SparkSession, path: str, one: bool = False) -> DataFrame:
    """I1 (legacy): one JSON array per file, of any size: a large file is read by many
    tasks (``sources.json_arrays``).  If the top level is an evaluation
    document, each detailed result becomes a one-message assistant
    conversation (I2's loader branch).  Returns ``(conv_id, conversations,
    _corrupt_record)``: positions run on over the files.  A record that does not
    parse, or what a broken file has after its last record, is one conversation
    without messages and its text in ``_corrupt_record``.  ``one``: the files are the
    parts of one array (``writers.write_conversations_array``)."""
    d = array_records(spark, path, f"{CONVERSATION_DDL}, generated string", _file_rank(), "conv_id", one)
    result = F.when(F.col("r.generated").isNotNull() & F.col("r.conversations").isNull(),
                    F.array(F.struct(F.lit("assistant").alias("from"), F.col("r.generated").alias("value"))))
    return d.select("conv_id", F.coalesce(F.col("r.conversations"), result, F.array().cast(MESSAGE_DDL)).alias("conversations"),
                    F.col("_value").alias("_corrupt_record"))


def read_eval_documents(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Evaluation documents -> one row per detailed result (``doc_no``, the
    document's position, and ``idx`` in it) with the transcript split into
    prompt and code (X2)."""
    docs = _with_file_order(spark.read.schema(EVAL_DOC_DDL).option("multiLine", multiline).json(path), "doc_no")
    return _eval_rows(docs.select("doc_no", "timestamp", "training_dataset_size",
                                  F.posexplode("detailed_results").alias("idx", "r")))


def _eval_rows(rows: DataFrame) -> DataFrame:
    return rows.select("doc_no", "timestamp", "training_dataset_size", F.col("idx").cast("long"),
                       F.col("r.reference").alias("reference"), F.col("r.generated").alias("generated"),
                       F.col("r.bleu").alias("bleu"),
                       T.transcript_prompt(F.col("r.generated")).alias("prompt"),
                       T.transcript_code(F.col("r.generated")).alias("code"))


def read_eval_folder(spark: SparkSession, path: str) -> DataFrame:
    """I2 for the folder that ``writers.write_eval_document`` writes: its result
    rows in order, with the document's timestamp and dataset size."""
    results = _with_file_order(spark.read.schema(
        "reference string, generated string, bleu double").json(f"{path}/detailed_results"), "idx")
    head = spark.read.schema("timestamp string, training_dataset_size int").json(f"{path}/summary")  # one row
    return _eval_rows(results.crossJoin(F.broadcast(head)).select(
        F.lit(0).cast("long").alias("doc_no"), "timestamp", "training_dataset_size", "idx",
        F.struct("reference", "generated", "bleu").alias("r")))


def read_generation_log(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Generation log rows (D5); ``variation_name`` is null in base mode."""
    return spark.read.schema(GENERATION_LOG_DDL).option("multiLine", multiline).json(path)


def read_pair_folder(spark: SparkSession, folder: str) -> DataFrame:
    """I4 (legacy text folder): files ``prompt_<n>.txt`` / ``code_<n>.txt``.

    Contents are stripped; the union of indices is kept (missing side = '');
    a pair is kept when either side is non-empty; ``idx`` is numeric.  One
    pivot aggregate is the full outer join of the two sides."""
    raw = spark.read.text(folder, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(prompt|code)_(\d+)\.txt$", 1).alias("kind"),
        F.regexp_extract(F.col("_metadata.file_name"), r"^(prompt|code)_(\d+)\.txt$", 2).alias("idx"),
        T.ustrip("value").alias("content"))
    return pairs_from_long(raw.filter(F.col("kind") != ""))


def pairs_from_long(long_form: DataFrame) -> DataFrame:
    """``(idx, kind, content)`` -> ``(idx, prompt, code)``."""
    wide = (long_form.groupBy(F.col("idx").cast("long").alias("idx"))
                     .pivot("kind", ["prompt", "code"]).agg(F.first("content")))
    return (wide.fillna("", subset=["prompt", "code"])
                .filter((F.col("prompt") != "") | (F.col("code") != ""))
                .select(F.col("idx"), "prompt", "code"))


def read_pairs_long(spark: SparkSession, path: str) -> DataFrame:
    """I4 for the S2 sink's layout (parquet partitioned by kind)."""
    return pairs_from_long(spark.read.parquet(path).select("idx", "kind", "content"))


def read_registry(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Run registry.

    ``multiline=True`` reads the legacy layout -- one JSON array per file --
    and sets ``seq`` to the record's position over all files (file order is
    the registry's order); a file that does not parse is an error.  ``multiline=False`` reads JSON Lines written by
    ``append_registry``, whose rows carry their own ``seq``.
    """
    if multiline:
        d = array_records(spark, path, REGISTRY_DDL, _file_rank(), "seq")
        bad = F.raise_error(F.concat(F.lit("not a registry: "), F.substring("_value", 1, 200)))
        return d.withColumn("seq", F.when(F.col("r").isNull(), bad.cast("long")).otherwise(F.col("seq"))) \
                .select("r.*", "seq")
    return spark.read.schema(REGISTRY_DDL + ", seq long").json(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Hash ledger; a missing ledger is an empty one.  Any other error is raised."""
    return _or_empty(spark, lambda: spark.read.schema(LEDGER_DDL).parquet(path), LEDGER_DDL)


def _or_empty(spark: SparkSession, read, ddl: str) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ddl)


def read_failing_snippets(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Failing snippets (superset schema), JSON arrays or lines; corrupt
    records are dropped, a missing file is empty."""
    return _or_empty(spark, lambda: spark.read.schema(FAILING_DDL).option("mode", "DROPMALFORMED")
                     .option("multiLine", multiline).json(path), FAILING_DDL)


def read_metric_history(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Per-run training metrics.  In the original layout every run
    folder holds one ``training_metrics.json`` object and the folder names
    the run: ``run_id`` is taken from the record when present, else from the
    parent folder of the file.  Runs without ``metrics_history`` are skipped.
    ``path`` may be a glob such as ``out/*/training_metrics.json``."""
    df = spark.read.schema(HISTORY_DDL).option("multiLine", multiline).json(path)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return (df.withColumn("run_id", F.coalesce(F.col("run_id"), folder))
              .filter(F.col("metrics_history").isNotNull()))
