"""Execution verdicts: attach them to pairs, roll them up, list failures.

The build/run harness itself is not part of this package; its verdicts are
an input table ``(key..., build_ok, build_message, run_ok, run_message)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T


def apply_verdicts(pairs: DataFrame, verdicts: DataFrame, keys: list[str],
                   build: bool = True, run: bool = True, code: str = "code") -> DataFrame:
    """Each pair gets ``(executed, success, message)``.

    Precedence: blank code -> fail ``No code provided``; build requested and
    failed -> ``Build failed: <message>``; run requested -> the run verdict;
    otherwise success ``Code written successfully``.  A pair with no
    verdict row was not executed: ``executed`` false, success/message null
    (blank code is decided without running, so it is still a failure).
    """
    v = verdicts.select(*keys, "build_ok", "build_message", "run_ok", "run_message",
                        F.lit(True).alias("_has"))
    # decided before the join, so the text need not move where it is not asked for
    d = pairs.withColumn("_blank", T.is_blank(code)).join(v, keys, "left")
    blank = F.col("_blank")
    has = F.col("_has").isNotNull()
    success = F.when(blank, F.lit(False))
    message = F.when(blank, F.lit(fixed.NO_CODE_MESSAGE))
    if build:
        failed_build = has & ~F.col("build_ok")
        success = success.when(failed_build, F.lit(False))
        message = message.when(failed_build, F.concat(F.lit(fixed.BUILD_FAILED_PREFIX), F.col("build_message")))
    if run:
        success = success.when(has, F.col("run_ok"))
        message = message.when(has, F.col("run_message"))
    else:
        success = success.when(has, F.lit(True))
        message = message.when(has, F.lit(fixed.WRITTEN_MESSAGE))
    return (d.withColumn("executed", blank | has)
             .withColumn("success", success)
             .withColumn("message", message)
             .drop("build_ok", "build_message", "run_ok", "run_message", "_has", "_blank"))


def execution_rate(verdicted: DataFrame, skipped: DataFrame | None = None,
                   group: list[str] | None = None, dataset: DataFrame | None = None) -> DataFrame:
    """Successful runs, total snippets (skipped pairs still count),
    executed snippets, conversations and the guarded rate.  One aggregate
    pass with partial aggregation.

    ``conversations`` counts the conversations seen among the pairs; pass
    the ``dataset`` (messages or conversations with ``conv_id``) to count
    every conversation processed, including those that yield no pair."""
    group = group or []
    d = verdicted.select(*group, "conv_id",
                         F.coalesce(F.col("success"), F.lit(False)).cast("long").alias("_ok"),
                         F.col("executed").cast("long").alias("_ex"))
    if skipped is not None:
        d = d.unionByName(skipped.select(*group, "conv_id", F.lit(0).cast("long").alias("_ok"),
                                         F.lit(0).cast("long").alias("_ex")))
    agg = d.groupBy(*group).agg(F.sum("_ok").alias("successful_runs"),
                                F.count(F.lit(1)).alias("total_snippets"),
                                F.sum("_ex").alias("executed_snippets"),
                                F.countDistinct("conv_id").alias("conversations"))
    if dataset is not None:
        conv = dataset.groupBy(*group).agg(F.countDistinct("conv_id").alias("conversations"))
        agg = agg.drop("conversations")
        # ungrouped: both sides are one row
        agg = agg.join(conv, group, "left") if group else agg.crossJoin(F.broadcast(conv))
    return agg.withColumn("success_rate", F.round(T.safe_rate("successful_runs", "total_snippets"), 6))


def execution_rate_once(pairs: DataFrame, verdicts: DataFrame, keys: list[str], code: str = "code",
                        order: tuple[str, ...] = ("conv_id", "k")) -> DataFrame:
    """R1 over the build-check flow in one pass of the pairs: of each
    ``snippet_hash`` the first pair is executed (J1, J5), the others count in
    ``total_snippets`` only.  Pairs without a hash are each executed.

    Every pair is counted under its hash and under its conversation in one
    aggregate over narrow columns, so nothing is read or joined twice."""
    narrow = pairs.select(*order, *[c for c in keys if c not in order], "snippet_hash",
                          T.is_blank(code).alias("_blank"))
    own = F.coalesce("snippet_hash", F.to_json(F.struct(*order)))
    tagged = narrow.select("*", F.explode(F.array(F.struct(F.lit("s").alias("what"), own.alias("id")),
                                                  F.struct(F.lit("c").alias("what"), F.col("conv_id").cast("string").alias("id")))).alias("t"))
    cols = [c for c in narrow.columns if c != "snippet_hash"]
    per = tagged.groupBy("t.what", "t.id").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(*cols)).alias("first"))
    v = verdicts.select(*keys, "build_ok", "run_ok", F.lit(True).alias("_has"))
    d = per.select("what", "copies", "first.*").join(v, keys, "left")
    snippet = F.col("what") == "s"
    ok = snippet & ~F.col("_blank") & F.col("build_ok") & F.col("run_ok")
    ran = snippet & (F.col("_blank") | F.col("_has").isNotNull())
    return (d.agg(F.coalesce(F.sum(F.when(ok, 1).otherwise(0)), F.lit(0)).cast("long").alias("successful_runs"),
                  F.coalesce(F.sum(F.when(snippet, F.col("copies"))), F.lit(0)).cast("long").alias("total_snippets"),
                  F.coalesce(F.sum(F.when(ran, 1).otherwise(0)), F.lit(0)).cast("long").alias("executed_snippets"),
                  F.coalesce(F.sum(F.when(snippet, 0).otherwise(1)), F.lit(0)).cast("long").alias("conversations"))
             .withColumn("success_rate", F.round(T.safe_rate("successful_runs", "total_snippets"), 6)))


def failing_snippets(verdicted: DataFrame, idx: str = "conv_id") -> DataFrame:
    """Failed pairs with both error-cause forms."""
    return (verdicted.filter(F.col("success") == F.lit(False))
                     .select(F.col(idx).alias("idx"), "prompt", "code",
                             F.col("message").alias("error_output"),
                             T.error_cause("message").alias("error_cause"),
                             T.error_cause_stripped("message").alias("error_cause_stripped")))
