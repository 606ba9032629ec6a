"""Slices of predictions, comparison of errors, adjudication queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .running import ranked


def family_errors(predictions: DataFrame) -> DataFrame:
    """Per family and true label: count, correct, errors, accuracy and counts of predicted labels."""
    per = predictions.groupBy("family", "true_label", "predicted_label").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("c"))
    return per.groupBy("family", "true_label").agg(F.sum("n").alias("count"), F.sum("c").alias("correct"), (F.sum("n") - F.sum("c")).alias("errors"), (F.sum("c") / F.sum("n")).alias("accuracy"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("predicted_label", "n")))).alias("predicted"))


def _sets(df: DataFrame, dims: list[str], rest: list[str]) -> DataFrame:
    """``df`` once for each dimension, as ``dimension`` and ``value``."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims]))
    return df.select(*rest, each.alias("__d")).select(*rest, "__d.dimension", "__d.value")


def error_slices(predictions: DataFrame, metadata: DataFrame, dims: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(slices, violations)``: counts per dimension, value and true label; predictions without metadata are violations."""
    met = predictions.join(metadata, "example_id", "left").withColumn("__n", F.coalesce(*[F.col(d).cast("string") for d in dims]))
    long = _sets(met.where("__n is not null"), dims, ["true_label", "is_correct"])
    out = long.groupBy("dimension", "value", "true_label").agg(F.count(F.lit(1)).alias("count"), F.count_if("is_correct").alias("correct"), F.count_if(~F.col("is_correct")).alias("errors"), F.avg(F.col("is_correct").cast("int")).alias("accuracy"))
    return out, met.where("__n is null").select("example_id", F.lit("missing_metadata").alias("violation"))


def selector_slices(predictions: DataFrame, dims: list[str], threshold: float = 0.5, radius: float = 0.1) -> DataFrame:
    """Per slice: FP, FN, near-threshold counts and errors, confident errors, mean probability, calibration gap and margin."""
    p, y = F.col("positive_probability"), F.col("true_label") == F.col("positive_label")
    hit = p >= threshold
    near, wrong = F.abs(p - threshold) <= radius, hit != y
    base = predictions.select(*dims, p.alias("p"), y.cast("int").alias("y"), (hit & ~y).alias("fp"), (~hit & y).alias("fn"), near.alias("near"), wrong.alias("wrong"), F.abs(p - threshold).alias("margin"))
    long = _sets(base, dims, ["p", "y", "fp", "fn", "near", "wrong", "margin"])
    return long.groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("count"), F.count_if("fp").alias("fp"), F.count_if("fn").alias("fn"), F.count_if("near").alias("near"), F.count_if(F.col("near") & F.col("wrong")).alias("near_errors"),
        F.count_if(~F.col("near") & F.col("wrong")).alias("confident_errors"), F.avg("p").alias("mean_probability"), (F.avg("p") - F.avg("y")).alias("calibration_gap"), F.avg("margin").alias("mean_margin"))


def error_rows(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Wrong predictions with their kind and signed margin, the widest margin first in ``rank``."""
    p, y = F.col("positive_probability"), F.col("true_label") == F.col("positive_label")
    wrong = predictions.withColumn("margin", p - threshold).where((p >= threshold) != y).withColumn("kind", F.when(p >= threshold, "false_positive").otherwise("false_negative"))
    return ranked(wrong.withColumn("width", F.abs("margin")), ["dataset_id"], "width", "example_id").drop("width")


def compare_errors(reference: DataFrame, candidate: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, families, violations)``: errors fixed, persistent and introduced by the candidate.

    Examples of only one side, and those whose label or family differ, are violations.
    """
    key = ["dataset_id", "example_id"]
    side = lambda df, s: df.select(*key, F.col("family").alias(f"family_{s}"), F.col("true_label").alias(f"label_{s}"), F.col("is_correct").alias(f"ok_{s}"))
    met = side(reference, "r").join(side(candidate, "c"), key, "full_outer")
    reason = F.when(F.col("ok_r").isNull(), "only_candidate").when(F.col("ok_c").isNull(), "only_reference").when(~F.col("label_r").eqNullSafe(F.col("label_c")), "label").when(~F.col("family_r").eqNullSafe(F.col("family_c")), "family")
    marked = met.withColumn("violation", reason)
    kind = F.when(~F.col("ok_r") & F.col("ok_c"), "fixed").when(~F.col("ok_r"), "persistent").when(~F.col("ok_c"), "introduced").otherwise("correct")
    rows = marked.where("violation is null").select(*key, F.col("family_r").alias("family"), kind.alias("kind"))
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("fixed", "persistent", "introduced", "correct")]
    return rows, rows.groupBy("dataset_id", "family").agg(*counts), marked.where("violation is not null").select(*key, "violation")


def error_suite(rows: DataFrame, by: list[str]) -> DataFrame:
    """Totals of compared errors by feature or variant, and by data set below it; net is introduced minus fixed."""
    k = F.col("kind")
    each = rows.groupBy(*by, "dataset_id").agg(F.count_if(k == "fixed").alias("fixed"), F.count_if(k == "introduced").alias("introduced"), F.count_if(k == "persistent").alias("persistent"), F.count_if(k.isin("correct", "fixed")).alias("right"), F.count(F.lit(1)).alias("n"))
    total = each.withColumn("accuracy", F.col("right") / F.col("n")).groupBy(*by).agg(F.sum("fixed").alias("fixed"), F.sum("introduced").alias("introduced"), (F.sum("persistent") + F.sum("introduced")).alias("errors"), (F.sum("introduced") - F.sum("fixed")).alias("net"), F.avg("accuracy").alias("mean_accuracy"), F.min("accuracy").alias("min_accuracy"))
    best = Window.orderBy("net", "introduced", "errors", F.desc("fixed"), F.desc("mean_accuracy"), *by)
    return total.withColumn("rank", F.row_number().over(best))


def adjudication_queue(errors: DataFrame, prompts: DataFrame, context: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(queue, violations)``: wrong cases with their text and other methods' predictions, all pending."""
    others = context.groupBy("example_id").agg(F.sort_array(F.collect_list(F.struct("method", "predicted_label"))).alias("context"))
    met = errors.join(prompts.select("example_id", "text"), "example_id", "left").join(others, "example_id", "left").withColumn("status", F.lit("pending"))
    return met.where("text is not null"), met.where("text is null").select("example_id", F.lit("missing_prompt").alias("violation"))
