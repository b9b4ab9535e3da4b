"""Prompt variations and the prompt-engineering rollups / report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T


def variation_templates(spark: SparkSession) -> DataFrame:
    """The five named templates as a 5-row dimension table (fixed values)."""
    rows = [(i, name, tpl, fixed.BASE_SYSTEM_PROMPT)
            for i, (name, tpl) in enumerate(fixed.VARIATION_TEMPLATES)]
    return spark.createDataFrame(rows, "variation_no int, variation_name string, "
                                       "template string, system_prompt string")


def prompt_variations(prompts: DataFrame, templates: DataFrame | None = None,
                      prompt: str = "prompt") -> DataFrame:
    """Every prompt x every variation template.

    The built-in template table has five rows and is broadcast, so this is a
    map-side nested loop with no shuffle of the prompts; a caller's own table
    is left to Spark.  The placeholder is replaced in the template only; the
    inserted prompt is not re-scanned.
    """
    templates = F.broadcast(variation_templates(prompts.sparkSession)) if templates is None else templates
    return (prompts.crossJoin(templates)
                   .withColumn("variant_prompt",
                               F.replace(F.col("template"), F.lit(fixed.BASE_PLACEHOLDER), F.col(prompt)))
                   .drop("template"))


def variation_rollup(results: DataFrame, model: str | None = None) -> DataFrame:
    """R2: per variation mean BLEU, summed successes and totals, success rate
    in percent; the grand total row (``is_total``) comes from the same pass
    via ROLLUP.  Input: (variation_name, bleu, successful_runs, total_runs).
    With a ``model`` column all of that is per model."""
    keys = [model] if model else []
    grouped = (results.groupingSets([[*keys, "variation_name"], keys], *keys, "variation_name") if model
               else results.rollup("variation_name"))
    agg = (grouped
                  .agg(F.avg("bleu").alias("avg_bleu"),
                       F.sum("successful_runs").alias("successful_runs"),
                       F.sum("total_runs").alias("total_runs"),
                       F.count(F.lit(1)).alias("n_results"),
                       (F.grouping("variation_name") == 1).alias("is_total")))
    return agg.select(*keys, "variation_name", "is_total", "n_results",
                      F.round("avg_bleu", 6).alias("avg_bleu"),
                      "successful_runs", "total_runs",
                      F.round(T.safe_rate("successful_runs", "total_runs") * 100, 6).alias("success_rate_pct"))


def prompt_variation_summary(results: DataFrame, prompt_key: str = "prompt_index", seq: str = "seq",
                             model: str | None = None) -> DataFrame:
    """Per (prompt, variation) the BLEU of the first occurrence and the run
    counts of the last occurrence; plus the prompt's totals over all its
    results.  One pass: results are aggregated to one row per prompt and
    variation (map-side first), and totals are sums over those few rows."""
    keys = [*([model] if model else []), prompt_key]
    per = (results.groupBy(*keys, "variation_name")
                  .agg(F.min_by("bleu", seq).alias("bleu_first"),
                       F.max_by("successful_runs", seq).alias("successful_runs_last"),
                       F.max_by("total_runs", seq).alias("total_runs_last"),
                       F.sum("successful_runs").alias("_ok"), F.sum("total_runs").alias("_total")))
    of_prompt = Window.partitionBy(*keys)             # one row per variation
    return (per.withColumn("prompt_successful_runs", F.sum("_ok").over(of_prompt))
               .withColumn("prompt_total_snippets", F.sum("_total").over(of_prompt))
               .withColumn("success_rate_pct",
                           F.round(T.safe_rate("successful_runs_last", "total_runs_last") * 100, 6))
               .withColumn("bleu_first", F.round("bleu_first", 6)).drop("_ok", "_total"))


def report_lines(results: DataFrame, seq: str = "seq") -> DataFrame:
    """The Markdown final report as ordered ``(line_no, line)`` rows.

    One pass: results are aggregated to one row per variation, those few rows
    are gathered into one, and the lines are made from it.  Variations appear
    in order of their first result, as in an insertion-ordered dict.  Numbers
    are formatted exactly as Python's ``f"{x:.4f}"`` / ``f"{x:.2f}"``
    (``functions.text.format_fixed``).
    """
    per = (results.groupBy("variation_name")
                  .agg(F.min(seq).alias("_first"), F.avg("bleu").alias("_bleu"),
                       F.sum("successful_runs").alias("_ok"), F.sum("total_runs").alias("_total")))
    section = F.array(
        F.concat(F.lit("### "), F.col("variation_name")),
        F.concat(F.lit(fixed.REPORT_BLEU), T.format_fixed("_bleu", 4)),
        F.concat(F.lit(fixed.REPORT_RATE), T.format_fixed(T.safe_rate("_ok", "_total") * 100, 2), F.lit("% ("),
                 F.col("_ok").cast("string"), F.lit("/"), F.col("_total").cast("string"), F.lit(" snippets)")),
        F.lit(""))
    one = (per.select("_first", "_ok", "_total", section.alias("_lines"))
              .agg(F.sort_array(F.collect_list(F.struct("_first", "_lines"))).alias("_all"),
                   F.coalesce(F.sum("_ok"), F.lit(0)).alias("_ok"), F.coalesce(F.sum("_total"), F.lit(0)).alias("_total")))
    head = F.array(
        F.lit(fixed.REPORT_TITLE), F.lit(""), F.lit(fixed.REPORT_SUMMARY),
        F.concat(F.lit(fixed.REPORT_TOTAL), F.col("_ok").cast("string"), F.lit("/"), F.col("_total").cast("string")),
        F.lit(""), F.lit(fixed.REPORT_VARIATIONS), F.lit(""))
    return (one.select(F.posexplode(F.concat(head, F.flatten(F.transform("_all", lambda x: x["_lines"])))).alias("line_no", "line"))
               .select(F.col("line_no").cast("long"), "line"))


def base_prompts(prompts: DataFrame, prompt: str = "prompt") -> DataFrame:
    """J4, base mode: every prompt is sent unchanged with the common system
    prompt and no variation name (a narrow projection, no join)."""
    return prompts.select("*", F.lit(None).cast("string").alias("variation_name"),
                          F.col(prompt).alias("variant_prompt"),
                          F.lit(fixed.BASE_SYSTEM_PROMPT).alias("system_prompt"))
