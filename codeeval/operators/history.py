"""Training metric history: step numbering, loss smoothing, run comparison.

History rows are long form ``(run_id, step, loss)``; the nested
``metrics_history{loss[], learning_rate[]}`` form is exploded by
``history_from_arrays``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .ordinals import rank_in_order, trailing_mean

def history_from_arrays(runs: DataFrame, run_col: str = "run_id") -> DataFrame:
    """D10 -> long form.  Runs without ``metrics_history`` are skipped; the
    step is the 1-based position in the series."""
    h = runs.filter(F.col("metrics_history").isNotNull())
    loss = h.select(run_col, F.posexplode("metrics_history.loss").alias("_p", "loss"))
    lr = h.select(run_col, F.posexplode("metrics_history.learning_rate").alias("_p", "learning_rate"))
    return (loss.join(lr, [run_col, "_p"], "full")
                .select(run_col, (F.col("_p") + 1).cast("long").alias("step"), "loss", "learning_rate"))


def number_steps(log: DataFrame, run_col: str, order: list[str], value: str) -> DataFrame:
    """1-based step per run in ``order``; entries lacking the value add
    nothing to the series, so each series (loss, learning rate) is numbered on
    its own.  A run of any length is spread over range partitions."""
    d = log.filter(F.col(value).isNotNull())
    return rank_in_order(d, [run_col], order, out="_r").withColumn("step", F.col("_r") + 1).drop("_r")


def aligned_series(history: DataFrame, runs: list[str] | None = None, run_col: str = "run_id",
                   value: str = "loss") -> DataFrame:
    """``(step, run, value)`` of the chosen runs (default all), the series
    that a comparison lays over one another."""
    d = history.filter(F.col(value).isNotNull())
    if runs is not None:
        d = d.filter(F.col(run_col).isin(*runs))
    return d.select("step", run_col, value)


def loss_smoothing(history: DataFrame, run_col: str = "run_id", width: int = fixed.LOSS_SMOOTH_WINDOW,
                   value: str = "loss") -> DataFrame:
    """Trailing mean over the current and ``width-1`` previous steps,
    defined only for runs with more than ``width`` points (null otherwise).
    The run length comes from an aggregate, not a whole-run window."""
    n = history.groupBy(run_col).agg(F.count(F.lit(1)).alias("_n"))
    sm = trailing_mean(history, [run_col], "step", value, width, out="_sm")
    return (sm.join(n, run_col)
              .withColumn("smoothed", F.when(F.col("_n") > width, F.col("_sm")))
              .drop("_sm", "_n"))


def run_comparison(history: DataFrame, run_col: str = "run_id", value: str = "loss") -> DataFrame:
    """Runs aligned by step.  Per step: how many runs reached it, the
    min / mean / max of ``value`` and the run with the lowest (ties: lowest run
    id).  Runs without history simply contribute no rows."""
    return (history.filter(F.col(value).isNotNull())
                   .groupBy("step")
                   .agg(F.count(F.lit(1)).alias("n_runs"),
                        F.round(F.min(value), 6).alias(f"min_{value}"),
                        F.round(F.avg(value), 6).alias(f"avg_{value}"),
                        F.round(F.max(value), 6).alias(f"max_{value}"),
                        F.min(F.struct(F.col(value), F.col(run_col)))[run_col].alias("best_run")))
