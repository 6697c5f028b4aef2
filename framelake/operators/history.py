"""Training histories: one row per (run, epoch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def selection_metric(auc, loss):
    """(name, value): AUC, or the negated loss where AUC is undefined."""
    undefined = auc.isNull() | F.isnan(auc)
    return F.when(undefined, F.struct(F.lit("neg_val_loss").alias("name"), (-loss).alias("value"))).otherwise(F.struct(F.lit("val_auc").alias("name"), auc.alias("value")))


def monitor_runs(history: DataFrame, patience: int = 5) -> DataFrame:
    """Adds best (running maximum of the finite metrics), is_new_best (strictly greater than before), since_best
    (epochs since the last new best) and stopped (that number has reached `patience` at or before this epoch)."""
    w = Window.partitionBy("run").orderBy("epoch")
    finite = F.when(F.col("metric").isNotNull() & ~F.isnan("metric"), F.col("metric"))
    before = F.max(finite).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(finite > before, finite.isNotNull())
    marked = history.withColumns({"best": F.max(finite).over(w), "is_new_best": new})
    last_best = F.max(F.when(F.col("is_new_best"), F.col("epoch"))).over(w)
    counted = marked.withColumn("since_best", F.col("epoch") - F.coalesce(last_best, F.lit(0)))
    return counted.withColumn("stopped", F.max(F.col("since_best") >= patience).over(w))


def best_epochs(history: DataFrame) -> DataFrame:
    """Per run the first epoch with the greatest finite metric."""
    usable = history.filter(F.col("metric").isNotNull() & ~F.isnan("metric"))
    return usable.groupBy("run").agg(F.max_by(F.struct("epoch", "metric"), F.struct("metric", -F.col("epoch"))).alias("_b")).select("run", F.col("_b.epoch").alias("best_epoch"), F.col("_b.metric").alias("best_metric"))
