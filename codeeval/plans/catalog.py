"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (through ``plans.fixtures``) and runs the
operator it is named after over the whole tables.  Floating results are
rounded to 6 places so the SQL oracle can compare them exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..operators import batched as B
from ..operators import dedup as D
from ..operators import edits as E
from ..operators import formatting as FM
from ..operators import history as H
from ..operators import metrics as M
from ..operators import pairs as P
from ..operators import prompts as PR
from ..operators import registry as G
from ..operators import search as S
from ..operators import verdicts as V
from ..session import scratch_path
from ..sources import named_files as N
from ..sources import readers as R
from ..sources import writers as W
from . import fixtures as X

#: Conversations in one legacy JSON array; more of them make more arrays, not longer ones.
ARRAY_SIZE = 1000
Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


# ---------------------------------------------------------------- shared plans
def _role_pairs(spark, sf):
    return P.pair_role_zip(X.messages(spark, sf))


def _context_pairs(spark, sf):
    return P.pair_role_zip_context(X.messages(spark, sf))


def _cleaned_snippets(spark, sf):
    return X.doc_snippets(spark, sf).withColumn("code", T.strip_backticks("response"))


def _verdicted_snippets(spark, sf):
    return V.apply_verdicts(_cleaned_snippets(spark, sf), X.verdicts(spark, sf), ["doc_id"], build=True, run=True)


def evaluation_results(spark, sf):
    """Prompt-evaluation results: X4-cleaned response, BLEU against the prompt
    (M4 wiring), verdict (J5) -> (seq, prompt, variation_name, bleu,
    successful_runs, total_runs).  Scoring reads the cleaned snippets
    directly -- it does not depend on the verdict join."""
    v = _verdicted_snippets(spark, sf)
    bleu = M.bleu_pairs(_cleaned_snippets(spark, sf).select("doc_id", "prompt", "code"), ["doc_id"],
                        reference="prompt", candidate="code")
    return (v.join(bleu, "doc_id")
             .select("doc_id", "seq", "prompt", "variation_name", "bleu",
                     F.coalesce(F.col("success"), F.lit(False)).cast("long").alias("successful_runs"),
                     F.col("executed").cast("long").alias("total_runs")))


def prompt_evaluation_results(spark, sf):
    """The prompt-evaluation flow: every test prompt (P7) in every variation
    (J4) joined to its answers in the generation log (I3), which are cleaned
    (X4), scored against the variant prompt (M1) and given verdicts (J5)."""
    variants = PR.prompt_variations(X.test_prompts(spark, sf)).select("prompt_index", "variation_no", "variation_name",
                                                                      "variant_prompt")
    log = _cleaned_snippets(spark, sf).select("doc_id", "seq", F.col("lang").alias("model"), "prompt_index",
                                              "variation_no", "code")
    answers = log.join(variants, ["prompt_index", "variation_no"])
    bleu = M.bleu_pairs(answers, ["doc_id"], reference="variant_prompt", candidate="code")
    v = V.apply_verdicts(answers, X.verdicts(spark, sf), ["doc_id"])
    return (v.join(bleu, "doc_id")
             .select("seq", "model", "prompt_index", "variation_name", "bleu",
                     F.coalesce(F.col("success"), F.lit(False)).cast("long").alias("successful_runs"),
                     F.col("executed").cast("long").alias("total_runs")))


def registry_rows(spark, sf):
    """D9 rows as a model evaluation makes them: each run's decoded outputs are
    split (X2) and cleaned (X3), scored against the reference code (M1, M3),
    given verdicts and counted (J5, R1), and assembled (G3, G1).  Pairs without
    a verdict count as not executed."""
    outputs = X.run_outputs(spark, sf, _role_pairs(spark, sf))
    cleaned = outputs.select("run_id", "doc_id", "conv_id", "k", T.clean_code(T.transcript_code("generated")).alias("code"))
    v = V.apply_verdicts(cleaned, X.verdicts(spark, sf), ["doc_id"])
    exec_stats = V.execution_rate(v, group=["run_id"]).select("run_id", "successful_runs", "total_snippets")
    scored = M.bleu_pairs(outputs, ["run_id", "conv_id", "k"], reference="code", candidate="generated")
    bleu = scored.groupBy("run_id").agg(F.avg("bleu").alias("avg_bleu"))
    return G.registry_record(X.run_configs(spark, sf), exec_stats, bleu)


# ---------------------------------------------------------------- sources / sinks
@query
def ingest_conversations(spark, sf):
    """The conversations written as JSON Lines (S1) and read back with
    positional ``conv_id``; flattened (P1)."""
    path = scratch_path(spark, "conversations-jsonl")
    W.write_conversations(X.raw_messages(spark, sf), path)
    return P.flatten_messages(R.read_conversations_jsonl(spark, path))


@query
def ingest_eval_results(spark, sf):
    """Evaluation documents (one per conversation, its transcripts as
    detailed results) written as JSON Lines and read back; X2 splits them."""
    t = X.transcripts(_role_pairs(spark, sf))
    docs = (t.groupBy("conv_id")
             .agg(F.array_sort(F.collect_list(F.struct("k", "code", "generated"))).alias("_r"))
             .select(F.lit("2025-01-01T00:00:00").alias("timestamp"),
                     F.struct(F.lit(0.0).alias("bleu")).alias("average_metrics"),
                     F.transform("_r", lambda r: F.struct(r["code"].alias("reference"),
                                                          r["generated"].alias("generated"),
                                                          F.lit(0.0).alias("bleu"))).alias("detailed_results"),
                     F.lit(17).alias("training_dataset_size"), "conv_id")
             .orderBy("conv_id").drop("conv_id"))
    path = scratch_path(spark, "eval-docs")
    W.write_json(docs, path)
    return R.read_eval_documents(spark, path).select("doc_no", "idx", "reference", "prompt", "code")


@query
def ingest_conversations_array(spark, sf):
    """I1, the legacy layout: conversations written as JSON arrays of
    ``ARRAY_SIZE`` each, one array a file, by many tasks in range order, and
    read back with positions over all files."""
    from ..operators.ordinals import global_ordinal
    messages = X.raw_messages(spark, sf)
    ords = global_ordinal(messages, "conv_id", out="_o").withColumnRenamed("conv_id", "_id")
    nested = FM.rebuild_conversations(messages).join(ords, F.col("conv_id").eqNullSafe(F.col("_id")))
    arrays = (nested.groupBy(F.floor(F.col("_o") / ARRAY_SIZE).alias("part"))
              .agg(F.sort_array(F.collect_list(F.struct("conv_id", F.struct("conversations").alias("r")))).alias("rs"))
              .select("part", F.to_json(F.transform("rs", lambda x: x["r"])).alias("value")))
    path = scratch_path(spark, "conversations-array")
    (arrays.repartitionByRange("part").sortWithinPartitions("part").select("value")
        .write.option("maxRecordsPerFile", 1).text(path))
    return P.flatten_messages(R.read_conversations_array(spark, path))


@query
def conversations_array_file(spark, sf):
    """All conversations as the one indented, ASCII-escaped array that the original
    tools open, written in parts by many tasks and read back."""
    path = scratch_path(spark, "conversations-one-array")
    W.write_conversations_array(X.raw_messages(spark, sf), path)
    return P.flatten_messages(R.read_conversations_array(spark, path, one=True))


@query
def eval_document_roundtrip(spark, sf):
    """Scored transcripts written as an evaluation document and read
    back, split into prompt and code."""
    t = X.transcripts(_role_pairs(spark, sf))
    scored = (t.join(M.bleu_pairs(t, ["conv_id", "k"], reference="code", candidate="generated"), ["conv_id", "k"])
              .select(F.col("code").alias("reference"), "generated", "bleu"))
    path = scratch_path(spark, "eval-document")
    W.write_eval_document(scored, path, 265, "2025-01-01T00:00:00")
    return R.read_eval_folder(spark, path).select("training_dataset_size", "reference", "prompt", "code",
                                                  F.round("bleu", 6).alias("bleu"))


@query
def generation_log(spark, sf):
    """The generation log written (S3) and read back."""
    path = scratch_path(spark, "generation-log")
    W.write_json(X.doc_snippets(spark, sf).select("variation_name", "prompt", "system_prompt", "response",
                                                   "time_taken"), path)
    return R.read_generation_log(spark, path).select("variation_name", "prompt", "system_prompt", "response",
                                                     F.round("time_taken", 6).alias("time_taken"))


@query
def pairs_long_form(spark, sf):
    """Pairs numbered from 1 in (conv_id, k) order, written long form."""
    from ..operators.ordinals import global_ordinal
    pr = _role_pairs(spark, sf)
    ords = global_ordinal(pr, ["conv_id", "k"], out="_o")
    numbered = pr.join(ords, ["conv_id", "k"]).withColumn("idx", F.col("_o") + 1)
    path = scratch_path(spark, "pairs-long")
    W.write_pairs_long(numbered, path)
    return spark.read.parquet(path).select(F.col("idx").cast("long"), "kind", "content")


@query
def pair_folder_join(spark, sf):
    """The long-form pairs read back into (idx, prompt, code)."""
    from ..operators.ordinals import global_ordinal
    pr = _role_pairs(spark, sf)
    ords = global_ordinal(pr, ["conv_id", "k"], out="_o")
    numbered = pr.join(ords, ["conv_id", "k"]).withColumn("idx", F.col("_o") + 1)
    path = scratch_path(spark, "pair-folder")
    W.write_pairs_long(numbered, path)
    return R.read_pairs_long(spark, path)


@query
def pair_folder_files(spark, sf):
    """I4/S2 in the original form: ``prompt_<n>.txt`` and ``code_<n>.txt`` written and read back."""
    from ..operators.ordinals import global_ordinal
    pr = _role_pairs(spark, sf)
    ords = global_ordinal(pr, ["conv_id", "k"], out="_o")
    path = scratch_path(spark, "pair-files")
    N.write_pair_files(pr.join(ords, ["conv_id", "k"]).withColumn("idx", F.col("_o") + 1), path)
    return N.read_pair_files(spark, path)


@query
def registry_scan(spark, sf):
    """Registry rows written as JSON Lines (S7) and read back."""
    path = scratch_path(spark, "registry")
    W.append_registry(registry_rows(spark, sf).drop("run_id"), path)
    r = R.read_registry(spark, path, multiline=False)
    return r.select("model_hash", "seq", "model_type", "train_dataset_size",
                    F.round("avg_bleu", 6).alias("avg_bleu"),
                    F.col("execution_check.successful_runs").cast("long").alias("successful_runs"),
                    F.col("execution_check.total_snippets").cast("long").alias("total_snippets"))


@query
def registry_scan_array(spark, sf):
    """I5, the legacy layout: the registry as one JSON array; ``seq`` is the
    record's position.  (One registry is one file by definition.)"""
    rows = registry_rows(spark, sf)
    record = F.struct(*[c for c in rows.columns if c not in ("run_id", "seq")])
    one = (rows.agg(F.sort_array(F.collect_list(F.struct("seq", record.alias("r")))).alias("rs"))
           .select(F.to_json(F.transform("rs", lambda x: x["r"])).alias("value")))
    path = scratch_path(spark, "registry-array")
    one.write.text(path)
    r = R.read_registry(spark, path)
    return r.select("model_hash", "seq", "model_type", "train_dataset_size", F.round("avg_bleu", 6).alias("avg_bleu"))


@query
def rebuild_conversations(spark, sf):
    """S1 shape: messages regrouped per conversation, serialised as JSON."""
    c = FM.rebuild_conversations(X.raw_messages(spark, sf))
    return c.select("conv_id", F.size("conversations").cast("long").alias("n_messages"),
                    F.to_json("conversations").alias("conversations_json"))


@query
def report_lines(spark, sf):
    """The final Markdown report of the prompt evaluation."""
    return PR.report_lines(evaluation_results(spark, sf))


# ---------------------------------------------------------------- pairing
@query
def flatten_messages(spark, sf):
    """Nested conversations flattened back to messages."""
    nested = FM.rebuild_conversations(X.raw_messages(spark, sf))
    return P.flatten_messages(nested)


@query
def pair_positional(spark, sf):
    return P.pair_positional(X.messages(spark, sf))


@query
def pair_role_zip(spark, sf):
    return _role_pairs(spark, sf)


@query
def pair_role_zip_context(spark, sf):
    return _context_pairs(spark, sf)


@query
def pair_first_of_role(spark, sf):
    return P.pair_first_of_role(X.messages(spark, sf))


@query
def multi_snippet_profile(spark, sf):
    return P.multi_snippet_profile(X.messages(spark, sf))


@query
def test_prompts(spark, sf):
    return P.first_messages(X.messages(spark, sf))


@query
def validate_pairs(spark, sf):
    return P.validate_pairs(_role_pairs(spark, sf))


@query
def keyword_search(spark, sf):
    return E.keyword_search(X.messages(spark, sf), " The ")


@query
def keyword_search_terms(spark, sf):
    """P9 for a table of terms: the first word, two and one characters of every benchmark item."""
    items = X.test_prompts(spark, sf)
    terms = items.select(F.explode(F.array(F.split("prompt", " ")[0], F.substring("prompt", 1, 2), F.substring("prompt", 1, 1))).alias("term"))
    return S.search_terms(X.messages(spark, sf), terms.where(T.ustrip("term") != ""))


@query
def preview_text(spark, sf):
    return P.preview_text(P.first_messages(X.messages(spark, sf))).select("conv_id", "preview")


@query
def batch_edits(spark, sf):
    """Delete conversations opened by a system message, rewrite
    conversations whose first message is shorter than 40 characters, add
    every page as (url, html)."""
    m = X.messages(spark, sf)
    deletes = m.filter((F.col("turn") == 0) & (F.col("role") == "system")).select("conv_id")
    pos = P.pair_positional(m)
    updates = pos.filter(F.length("prompt") < 40).select(
        "conv_id", F.concat(F.col("prompt"), F.lit(" (edited)")).alias("prompt"), F.col("reference").alias("response"))
    adds = R.read_table(spark, sf, "pages").select(F.col("page_id").alias("edit_seq"),
                                                   F.col("url").alias("prompt"), F.col("html").alias("response"))
    return E.batch_edits(m, adds=adds, updates=updates, deletes=deletes)


@query
def trim_first_n(spark, sf):
    return E.trim_first_n(X.messages(spark, sf), 15)


# ---------------------------------------------------------------- cleaning
@query
def extract_transcript(spark, sf):
    t = X.transcripts(_role_pairs(spark, sf))
    return t.select("conv_id", "k", T.transcript_prompt("generated").alias("prompt"),
                    T.transcript_code("generated").alias("code"))


@query
def clean_code(spark, sf):
    return X.doc_snippets(spark, sf).select("doc_id", T.clean_code("response").alias("code"))


@query
def strip_backticks(spark, sf):
    return X.doc_snippets(spark, sf).select("doc_id", T.strip_backticks("response").alias("code"))


@query
def after_marker(spark, sf):
    """X5 on model output = inference-form instruction text + the reference."""
    pos = P.pair_positional(X.messages(spark, sf))
    gen = FM.instruction_text(pos, prompt="prompt", response=None) \
        .withColumn("generated", F.concat("text", "reference", F.lit(fixed.END_OF_TEXT)))
    return gen.select("conv_id", T.after_marker("generated").alias("code"))


@query
def unescape_code(spark, sf):
    pr = _role_pairs(spark, sf).withColumn(
        "minified", F.replace(F.replace("code", F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")))
    return pr.select("conv_id", "k", T.unescape_code("minified").alias("code"))


@query
def snippet_hash(spark, sf):
    return D.with_snippet_hash(_context_pairs(spark, sf)).select("conv_id", "k", "snippet_hash")


@query
def chat_template_text(spark, sf):
    return FM.chat_template_text(X.messages(spark, sf))


@query
def batched_tokens(spark, sf):
    """a batched tokenizer (here: words between white space) over the rendered texts."""
    texts = FM.chat_template_text(X.messages(spark, sf)).select("conv_id", "text")
    t = B.map_text_batches(texts, B.whitespace_tokens, "text", "tokens", "array<string>")
    return t.select("conv_id", F.size("tokens").cast("long").alias("n_tokens"), F.get("tokens", F.lit(0)).alias("first_token"),
                    F.get("tokens", F.size("tokens") - 1).alias("last_token"))


@query
def response_spans(spark, sf):
    return FM.response_spans(X.messages(spark, sf))


@query
def instruction_text(spark, sf):
    return FM.instruction_text(P.pair_first_of_role(X.messages(spark, sf))).select("conv_id", "text")


@query
def run_label(spark, sf):
    c = X.run_configs(spark, sf)
    return c.select("run_id", T.run_label("lora_rank", "lora_alpha", "train_dataset_size").alias("run_label"),
                    T.result_prefix("train_dataset_size").alias("result_prefix"))


# ---------------------------------------------------------------- dedup / joins
@query
def dedup_ledger(spark, sf):
    pairs = D.with_snippet_hash(X.text_pairs(spark, sf))
    return D.dedup_ledger(pairs, X.ledger(pairs)).select("conv_id", "k", "snippet_hash")


def _stream_runs(spark, sf):
    """Two runs of the streaming J1, seeded with the ledger of an earlier one: the
    even conversations, then all."""
    from ..streaming.dedup import run_dedup_stream
    pairs = D.with_snippet_hash(X.text_pairs(spark, sf))
    return run_dedup_stream(spark, [pairs.filter(F.col("conv_id") % 2 == 0), pairs], X.ledger(pairs))


@query
def dedup_stream(spark, sf):
    """J1, streaming: each hash that the seed lacks once, by its first pair of the
    first run that has it."""
    return _stream_runs(spark, sf)[0].select("conv_id", "k", "snippet_hash")


@query
def ledger_from_state(spark, sf):
    """The ledger read back from the stream's state: the seed and all hashes seen."""
    from ..streaming.dedup import ledger_from_state
    return ledger_from_state(spark, _stream_runs(spark, sf)[1])


@query
def ledger_runs(spark, sf):
    """Two runs over one ledger.  The first sees the even
    conversations, the second all of them; each hash is processed once, by its
    first pair of the first run that has it."""
    from ..streaming.dedup import run_ledger_batches
    pairs = D.with_snippet_hash(X.text_pairs(spark, sf))
    return run_ledger_batches(spark, [pairs.filter(F.col("conv_id") % 2 == 0), pairs])


@query
def dedup_against_main(spark, sf):
    return D.dedup_against_main(X.new_pairs(spark, sf), X.main_messages(spark, sf)) \
        .select("conv_id", "k", "prompt", "code")


@query
def append_working(spark, sf):
    # two pairs to a conversation; passing ones are appended in (conv_id, k) order
    v = V.apply_verdicts(X.new_pairs(spark, sf), X.verdicts(spark, sf), ["doc_id"])
    passing = v.filter(F.col("success")).select("conv_id", "k", "prompt", "code")
    return D.append_working(X.main_messages(spark, sf), passing)


@query
def prompt_variations(spark, sf):
    return PR.prompt_variations(X.test_prompts(spark, sf)).select(
        "prompt_index", "variation_no", "variation_name", "variant_prompt", "system_prompt")


@query
def base_prompts(spark, sf):
    """J4 base mode: test prompts sent as is with the common system prompt."""
    return PR.base_prompts(X.test_prompts(spark, sf)).select(
        "prompt_index", "variation_name", "variant_prompt", "system_prompt")


@query
def apply_verdicts(spark, sf):
    return _verdicted_snippets(spark, sf).select("doc_id", "executed", "success", "message")


# ---------------------------------------------------------------- scoring
@query
def bleu_pairs(spark, sf):
    """M1 with the model-evaluation wiring: reference = the conversation's
    code, hypothesis = the whole decoded transcript."""
    t = X.transcripts(_role_pairs(spark, sf))
    b = M.bleu_pairs(t, ["conv_id", "k"], reference="code", candidate="generated")
    return b.select("conv_id", "k", F.round("bleu", 6).alias("bleu"))


@query
def chrf_pairs(spark, sf):
    t = X.transcripts(_role_pairs(spark, sf))
    c = M.chrf_pairs(t, ["conv_id", "k"], reference="code", candidate="generated")
    return c.select("conv_id", "k", F.round("chrf", 6).alias("chrf"))


@query
def bleu_average(spark, sf):
    t = X.transcripts(_role_pairs(spark, sf))
    b = M.bleu_pairs(t, ["conv_id", "k"], reference="code", candidate="generated")
    return M.average_metric(b).select("n_pairs", F.round("avg_bleu", 6).alias("avg_bleu"))


@query
def bleu_prompt_as_reference(spark, sf):
    """M4 prompt-evaluation wiring: reference = the prompt text, hypothesis =
    the X4-cleaned response."""
    snip = X.doc_snippets(spark, sf).withColumn("code", T.strip_backticks("response"))
    b = M.bleu_pairs(snip, ["doc_id"], reference="prompt", candidate="code")
    return b.select("doc_id", F.round("bleu", 6).alias("bleu"))


# ---------------------------------------------------------------- rollups
@query
def execution_rate(spark, sf):
    """R1 over the build-check flow: keep-first by snippet hash (J1, no
    ledger), verdicts for the kept snippets (J5); skipped duplicates still
    count in total_snippets."""
    return V.execution_rate_once(D.with_snippet_hash(X.text_pairs(spark, sf)), X.verdicts(spark, sf), ["doc_id"])


@query
def failing_snippets(spark, sf):
    return V.failing_snippets(_verdicted_snippets(spark, sf).withColumnRenamed("response", "raw"), idx="doc_id")


@query
def failing_snippets_file(spark, sf):
    """The failing snippets written in one overwrite and read back."""
    path = scratch_path(spark, "failing-snippets")
    W.write_json(failing_snippets(spark, sf), path)
    return R.read_failing_snippets(spark, path, multiline=False).select("idx", "prompt", "code", "error_output", "error_cause")


@query
def prompt_evaluation(spark, sf):
    """The whole prompt-evaluation flow (P7, J4, I3, X4, M1, J5), per prompt
    and variation of each model (R4)."""
    return PR.prompt_variation_summary(prompt_evaluation_results(spark, sf), model="model")


@query
def model_rollup(spark, sf):
    """The same flow rolled up per model and variation (R2)."""
    return PR.variation_rollup(prompt_evaluation_results(spark, sf), model="model")


@query
def running_totals(spark, sf):
    """R1/R2 while results arrive: two runs of the streaming roll-up, the second from the first's checkpoint."""
    from ..streaming.rollup import run_rollups
    results = evaluation_results(spark, sf)
    return run_rollups(spark, [results.where("doc_id % 3 = 0"), results.where("doc_id % 3 <> 0")], PR.variation_rollup)


@query
def variation_rollup(spark, sf):
    return PR.variation_rollup(evaluation_results(spark, sf))


@query
def prompt_variation_summary(spark, sf):
    return PR.prompt_variation_summary(evaluation_results(spark, sf), prompt_key="prompt")


@query
def dataset_size(spark, sf):
    return X.messages(spark, sf).agg(F.countDistinct("conv_id").alias("n_conversations"))


@query
def size_statistics(spark, sf):
    return G.size_statistics(registry_rows(spark, sf))


@query
def best_series_by_size(spark, sf):
    return G.best_series_by_size(registry_rows(spark, sf))


@query
def best_run_per_size(spark, sf):
    return G.best_run_per_size(registry_rows(spark, sf))


@query
def performance_trend(spark, sf):
    return G.performance_trend(registry_rows(spark, sf))


@query
def trial_score_topk(spark, sf):
    return G.trial_score_topk(registry_rows(spark, sf), k=1)


@query
def registry_hash(spark, sf):
    return registry_rows(spark, sf).select("run_id", "model_hash")


@query
def registry_record(spark, sf):
    r = registry_rows(spark, sf)
    return r.select("run_id", "seq", "model_hash", "model_type", "train_dataset_size",
                    F.round("avg_bleu", 6).alias("avg_bleu"),
                    F.col("execution_check.successful_runs").cast("long").alias("successful_runs"),
                    F.col("execution_check.total_snippets").cast("long").alias("total_snippets"))


@query
def registry_append(spark, sf):
    """The English runs are already registered; every other run arrives
    as a new batch in ``seq`` order.  Runs whose configuration hash is taken
    are not appended."""
    rows = registry_rows(spark, sf)
    existing = rows.filter(F.col("run_id").endswith("/en"))
    batch = rows.filter(~F.col("run_id").endswith("/en"))
    out = G.registry_append(existing, batch)
    return out.select("run_id", "model_hash", "seq")


# ---------------------------------------------------------------- history
def _history(spark, sf):
    return H.number_steps(X.event_log(spark, sf), "run_id", ["ts", "event_id"], "loss").select("run_id", "step", "loss")


@query
def loss_smoothing(spark, sf):
    s = H.loss_smoothing(_history(spark, sf))
    return s.select("run_id", "step", "loss", F.round("smoothed", 6).alias("smoothed"))


@query
def run_series(spark, sf):
    """The loss series of all runs, aligned by step."""
    return H.aligned_series(_history(spark, sf))


@query
def run_comparison(spark, sf):
    return H.run_comparison(_history(spark, sf))


def _read_histories(spark, sf):
    """Every run's ``training_metrics.json`` (I6) written and read back, long form."""
    path = scratch_path(spark, "metric-history")
    N.write_metric_history(X.run_histories(spark, sf), path)
    return H.history_from_arrays(R.read_metric_history(spark, f"{path}/*/training_metrics.json"))


@query
def metric_history(spark, sf):
    """Both series of every run, as the metric files hold them."""
    return _read_histories(spark, sf).select(F.col("run_id").cast("long").alias("run_id"), "step",
                                             F.round("loss", 6).alias("loss"), F.round("learning_rate", 6).alias("learning_rate"))


@query
def learning_rate_comparison(spark, sf):
    """The runs' learning rates, aligned by step."""
    c = H.run_comparison(_read_histories(spark, sf), value="learning_rate")
    return c.select("step", "n_runs", F.col("min_learning_rate"), "avg_learning_rate", "max_learning_rate",
                    F.col("best_run").cast("long").alias("best_run"))
