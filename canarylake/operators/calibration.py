"""Calibration reports and operating points of probabilistic predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cv_metrics(predictions: DataFrame, fold_col: str = "fold_index") -> tuple[DataFrame, DataFrame]:
    """``(folds, summary)``: accuracy and macro F1 per fold; their mean and population deviation."""
    cells = predictions.groupBy(fold_col, "true_label", "predicted_label").agg(F.count(F.lit(1)).alias("n"))
    long = cells.select(fold_col, F.explode(F.array_distinct(F.array("true_label", "predicted_label"))).alias("label"), "true_label", "predicted_label", "n")
    t, p = F.col("true_label") == F.col("label"), F.col("predicted_label") == F.col("label")
    per = long.groupBy(fold_col, "label").agg(F.sum(F.when(t & p, F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(t & ~p, F.col("n")).otherwise(0)).alias("fn"), F.sum(F.when(~t & p, F.col("n")).otherwise(0)).alias("fp"))
    f1 = per.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))).groupBy(fold_col).agg(F.avg("f1").alias("macro_f1"))
    acc = cells.groupBy(fold_col).agg((F.sum(F.when(F.col("true_label") == F.col("predicted_label"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    folds = acc.join(f1, fold_col)
    return folds, folds.agg(F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy"), F.avg("macro_f1").alias("mean_macro_f1"), F.stddev_pop("macro_f1").alias("std_macro_f1"))


def confusion(predictions: DataFrame) -> DataFrame:
    """Counts of true and predicted labels over all folds."""
    return predictions.groupBy("true_label", "predicted_label").agg(F.count(F.lit(1)).alias("n"))


def calibration_bins(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """``(bin, lower, upper, count, mean_probability, positive_rate)``; the last is closed on the right, empty ones stay."""
    p = F.col("positive_probability")
    which = F.lit(0)
    for i in range(1, bins):
        which = F.when(p >= i / bins, i).otherwise(which)
    y = (F.col("true_label") == F.col("positive_label")).cast("int")
    got = predictions.groupBy(which.alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.avg(p).alias("mean_probability"), F.avg(y).alias("positive_rate"))
    every = predictions.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    met = every.join(got, "bin", "left")
    return met.select("bin", (F.col("bin") / bins).alias("lower"), ((F.col("bin") + 1) / bins).alias("upper"), F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("mean_probability", F.lit(0.0)).alias("mean_probability"), F.coalesce("positive_rate", F.lit(0.0)).alias("positive_rate"))


def calibration_report(predictions: DataFrame) -> DataFrame:
    """One row: count, accuracy, macro F1 of the positive label and the other, Brier score, log loss (clipped at 1e-9) and expected calibration error."""
    t, g = F.col("true_label") == F.col("positive_label"), F.col("predicted_label") == F.col("positive_label")
    p, y = F.col("positive_probability"), t.cast("int")
    c = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    f1 = lambda hit: F.coalesce(F.try_divide(2 * F.count_if(hit), 2 * F.count_if(hit) + F.count_if(t != g)), F.lit(0.0))
    plain = predictions.agg(
        F.count(F.lit(1)).alias("count"), F.avg((F.col("true_label") == F.col("predicted_label")).cast("int")).alias("accuracy"), ((f1(t & g) + f1(~t & ~g)) / 2).alias("macro_f1"),
        F.avg((p - y) * (p - y)).alias("brier"), F.avg(-(y * F.log(c) + (1 - y) * F.log(1 - c))).alias("log_loss"))
    ece = calibration_bins(predictions).agg((F.sum(F.col("count") * F.abs(F.col("mean_probability") - F.col("positive_rate"))) / F.sum("count")).alias("ece"))
    return plain.crossJoin(F.broadcast(ece))


def operating_points(predictions: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per threshold: counts, rates, F1 of both classes, macro F1; ``best`` and ``high_recall`` mark the chosen ones."""
    p, y = F.col("positive_probability"), F.col("true_label") == F.col("positive_label")
    each = predictions.select(p.alias("p"), y.alias("y"), F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    hit = F.col("p") >= F.col("threshold")
    n = each.groupBy("threshold").agg(F.count_if(hit & F.col("y")).alias("tp"), F.count_if(hit & ~F.col("y")).alias("fp"), F.count_if(~hit & ~F.col("y")).alias("tn"), F.count_if(~hit & F.col("y")).alias("fn"))
    z = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = n.withColumns({"precision": z(tp, tp + fp), "recall": z(tp, tp + fn), "specificity": z(tn, tn + fp), "fpr": z(fp, tn + fp), "fnr": z(fn, tp + fn), "accuracy": z(tp + tn, tp + fp + tn + fn), "f1": z(2 * tp, 2 * tp + fp + fn), "negative_f1": z(2 * tn, 2 * tn + fp + fn), "warned": tp + fp, "allowed": tn + fn})
    out = out.withColumn("macro_f1", (F.col("f1") + F.col("negative_f1")) / 2)
    top = lambda *c: F.row_number().over(Window.orderBy(*c)) == 1
    return out.withColumn("best", top(F.desc("macro_f1"), F.desc("recall"), "threshold")).withColumn("high_recall", top(F.desc("recall"), F.desc("precision"), "threshold"))
