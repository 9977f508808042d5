"""Experiment bookkeeping (M12, A19-A20, L13) over a metric history table
``(run, metric, epoch, value)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOWER_IS_BETTER = ("error", "loss", "coverage")


def lower_is_better(metric_col="metric"):
    c = F.col(metric_col)
    cond = F.lit(False)
    for word in LOWER_IS_BETTER:
        cond = cond | c.contains(word)
    return cond


def last_per_epoch(events: DataFrame, order_cols=("ts", "seq")) -> DataFrame:
    """Keep the last recorded value of each (run, metric, epoch)."""
    key = F.struct(*[F.col(c) for c in order_cols])
    return events.groupBy("run", "metric", "epoch").agg(F.max_by("value", key).alias("value"))


def summary(history: DataFrame) -> DataFrame:
    """Per (run, metric) the best value (min for error-like metrics,
    max otherwise), the earliest epoch reaching it, and the range."""
    low = lower_is_better()
    best_low = F.min_by("epoch", F.struct("value", "epoch"))
    best_high = F.min_by("epoch", F.struct((-F.col("value")).alias("v"), "epoch"))
    agg = history.groupBy("run", "metric").agg(
        F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        best_low.alias("epoch_low"), best_high.alias("epoch_high"))
    return agg.select(
        "run", "metric",
        F.when(low, F.col("min_value")).otherwise(F.col("max_value")).alias("best_value"),
        F.when(low, F.col("epoch_low")).otherwise(F.col("epoch_high")).alias("best_epoch"),
        (F.col("max_value") - F.col("min_value")).alias("value_range"))


def early_stopping(series: DataFrame, patience: int = 3) -> DataFrame:
    """Keras-style early stopping on (run, epoch, value), lower is
    better, min_delta 0: an epoch improves when its value is below every
    earlier value; training stops at the first epoch that is ``patience``
    epochs past the last improvement (else at the last epoch).

    Windows run per run over one row per epoch (bounded by the number of
    epochs, not by the data)."""
    w = Window.partitionBy("run").orderBy("epoch")
    prev = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    s = (series.withColumn("i", F.row_number().over(w))
         .withColumn("prev_best", F.min("value").over(prev)))
    s = s.withColumn("improved", F.col("prev_best").isNull() | (F.col("value") < F.col("prev_best")))
    s = s.withColumn("last_imp", F.max(F.when(F.col("improved"), F.col("i"))).over(upto))
    s = s.withColumn("wait", F.col("i") - F.col("last_imp"))
    return s.groupBy("run").agg(
        F.min_by("epoch", F.struct("value", "epoch")).alias("best_epoch"),
        F.min("value").alias("best_value"),
        F.coalesce(F.min(F.when(F.col("wait") >= patience, F.col("epoch"))),
                   F.max("epoch")).alias("stopped_epoch"),
        F.count(F.lit(1)).alias("n_epochs"))


def pivot_table(df: DataFrame, row: str, col: str, values, value: str, prefix: str) -> DataFrame:
    """Rows x fixed column values, one aggregated cell each; the
    column list is given so the schema does not depend on the data."""
    p = df.groupBy(row).pivot(col, list(values)).agg(F.round(F.avg(value), 6))
    return p.select(row, *[F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values])
