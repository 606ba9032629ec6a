"""Residual features, score stacking and probability calibration over folds."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .fits import Model, fit_many, model_table, predict_many
from .probes import grouped_folds
from .running import running


def calibration_rows(rows: DataFrame, task_folds: DataFrame, fold: int, labels: list[str]) -> DataFrame:
    """Rows of the given labels, without task rows that are outside the fold's training part."""
    held = task_folds.where(F.col("fold") == fold).select("example_id")
    return rows.where(F.col("label").isin(*labels)).join(held, "example_id", "left_anti")


def fit_diagonal(features: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(by..., mean, variance)``: per dimension the mean and the population variance, as arrays."""
    by = by or ["feature_key"]
    x = array_to_vector(F.transform("vector", lambda v: v.cast("double")))
    s = features.groupBy(*by).agg(Summarizer.metrics("mean", "variance", "count").summary(x).alias("s"))
    n = F.col("s.count")
    return s.select(*by, vector_to_array("s.mean").alias("mean"), F.transform(vector_to_array("s.variance"), lambda v: v * (n - 1) / n).alias("variance"))


def late_keys(keys: list[str], share: float = 0.25) -> list[str]:
    """The last ``share`` of the keys by layer, at least one."""
    ordered = sorted(keys, key=lambda k: (int(k.rsplit("_", 1)[1]), k))
    return ordered[-max(1, int(len(ordered) * share)) :]


def _residual(kind: str, ridge: float):
    """An array of one kind from ``vector, mean, variance``."""
    gap = F.zip_with(F.transform("vector", lambda v: v.cast("double")), "mean", lambda a, m: a - m)
    r = F.zip_with(gap, "variance", lambda d, v: d / F.sqrt(v + ridge))
    return {"residual": r, "absolute": F.transform(r, F.abs), "diagonal_distance": F.array(F.sqrt(F.aggregate(r, F.lit(0.0), lambda a, v: a + v * v)))}[kind]


def _end_to_end(rows: DataFrame, by: list[str]) -> DataFrame:
    """``(by..., vector)``: the arrays ``v`` of all feature keys in order."""
    per = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("feature_key", "v"))).alias("all"))
    return per.select(*by, F.flatten(F.transform("all", lambda s: s["v"])).alias("vector"))


def residual_features(features: DataFrame, calibration: DataFrame, kind: str = "residual", ridge: float = 1e-6) -> DataFrame:
    """``(example_id, vector)`` over all feature keys in order.

    ``diagonal_distance``: one number per key, sqrt of the sum of (x - m)^2 / (v + ridge); ``residual``: (x - m) / sqrt(v + ridge)
    end to end; ``absolute``: its absolute values.
    """
    met = features.join(F.broadcast(calibration.select("feature_key", "mean", "variance")), "feature_key")
    return _end_to_end(met.select("example_id", "feature_key", _residual(kind, ridge).alias("v")), ["example_id"])


def residual_probe_cv(features: DataFrame, rows: DataFrame, calib_labels: list[str], k: int, positive: str, negative: str, kinds: tuple = ("diagonal_distance", "residual"), scale: bool = True, ridge: float = 1e-6) -> DataFrame:
    """Predictions per variant: in each fold the calibration, the features and the probe see only its training part.

    ``rows`` have ``example_id, label, target, fold``. The calibrations of all folds come from one aggregation, and all probes are fitted together.
    """
    others = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))
    chosen = rows.where(F.col("label").isin(*calib_labels)).select("example_id", F.explode(others).alias("calib"))
    calib = fit_diagonal(features.join(chosen, "example_id"), ["calib", "feature_key"])  # folds x keys rows
    met = features.join(F.broadcast(calib), "feature_key")
    made = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), _residual(kind, ridge).alias("v")) for n, kind in enumerate(kinds)])).alias("m")
    x = _end_to_end(met.select("example_id", "feature_key", "calib", made).select("example_id", "feature_key", "calib", "m.*"), ["example_id", "calib", "variant"])
    model = (F.col("calib") * len(kinds) + F.col("variant")).cast("int")
    x = x.join(rows.select("example_id", "target", "fold"), "example_id")
    mine, none = F.array(model), F.array().cast("array<int>")
    table = written(x.select("example_id", "target", "vector", F.when(F.col("fold") != F.col("calib"), mine).otherwise(none).alias("groups"), F.when(F.col("fold") == F.col("calib"), mine).otherwise(none).alias("asks")), "residual-rows")
    models = fit_many(table, [Model(m) for m in range(k * len(kinds))], positive, scale=scale)
    p = predict_many(table, models, keep=("example_id", "target"))
    name = F.get(F.array(*[F.lit(x) for x in kinds]), F.col("model") % len(kinds))
    label = F.when(F.col("positive_probability") >= 0.5, positive).otherwise(negative)
    out = p.select("example_id", name.alias("variant"), F.floor(F.col("model") / len(kinds)).cast("int").alias("fold_index"), F.col("target").alias("true_label"), "positive_probability", F.lit(positive).alias("positive_label"))
    return out.withColumn("predicted_label", label).withColumn("is_correct", F.col("true_label") == F.col("predicted_label"))


def auc(scores: DataFrame, by: list[str]) -> DataFrame:
    """``(by..., auc)`` of ``(score, is_positive)`` by rank sums with mean ranks for ties; 0.5 with one class only."""
    counts = scores.groupBy(*by, "score").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_positive").alias("p"))
    placed = running(counts, by, "score", {"upto": "n"}).withColumn("r", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2)
    s = placed.groupBy(*by).agg(F.sum(F.col("p") * F.col("r")).alias("s"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return s.select(*by, F.coalesce(F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))), F.lit(0.5)).alias("auc"))


def auc_layer_weights(scores: DataFrame) -> DataFrame:
    """Per fold and key: max(0, AUC - 0.5), normalised over the fold's keys; equal if all are 0."""
    per = auc(scores, ["fold", "feature_key"]).withColumn("g", F.greatest(F.col("auc") - 0.5, F.lit(0.0)))
    w = Window.partitionBy("fold")
    return per.withColumn("weight", F.when(F.sum("g").over(w) > 0, F.col("g") / F.sum("g").over(w)).otherwise(1 / F.count(F.lit(1)).over(w))).select("fold", "feature_key", "auc", "weight")


def learn_threshold(scores: DataFrame, by: list[str]) -> DataFrame:
    """``(by..., threshold, macro_f1, accuracy)``: the best cut by macro F1, then accuracy, then the lowest.

    Candidates are midpoints of neighbouring scores, both ends moved out by 1e-12, and 0.5. Counts come from one running sum.
    """
    counts = scores.groupBy(*by, "score").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_positive").alias("p"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("N"), F.sum("p").alias("P"))  # a row per group
    run = running(counts, by, "score", {"nb": "n", "pb": "p"}).withColumnRenamed("previous", "prev").drop("n", "p")
    run = run.join(F.broadcast(total), by) if by else run.crossJoin(F.broadcast(total))
    # a cut after a score leaves nb rows below it, pb of them positive
    cut = lambda t, nb, pb: F.struct(t.alias("t"), nb.alias("nb"), pb.alias("pb"))
    s, nb, pb = F.col("score"), F.col("nb"), F.col("pb")
    zero = F.lit(0).cast("long")
    cuts = F.array_compact(F.array(
        F.when(F.col("prev").isNull(), cut(s - 1e-12, zero, zero)), F.when(F.col("next").isNotNull(), cut((s + F.col("next")) / 2, nb, pb)).otherwise(cut(s + 1e-12, nb, pb)),
        F.when((s < 0.5) & (F.col("next").isNull() | (F.col("next") >= 0.5)), cut(F.lit(0.5), nb, pb)), F.when((s >= 0.5) & F.col("prev").isNull(), cut(F.lit(0.5), zero, zero))))
    each = run.select(*by, "N", "P", F.explode(cuts).alias("__cut")).select(*by, "N", "P", "__cut.*")
    tp, fn = F.col("P") - F.col("pb"), F.col("pb")
    tn = F.col("nb") - F.col("pb")
    fp = F.col("N") - F.col("P") - tn
    z = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    scored = each.withColumn("macro_f1", (z(2 * tp, 2 * tp + fp + fn) + z(2 * tn, 2 * tn + fp + fn)) / 2).withColumn("accuracy", (tp + tn) / F.col("N"))
    best = scored.groupBy(*by).agg(F.max(F.struct("macro_f1", "accuracy", (-F.col("t")).alias("m"))).alias("b")) if by else scored.agg(F.max(F.struct("macro_f1", "accuracy", (-F.col("t")).alias("m"))).alias("b"))
    return best.select(*by, (-F.col("b.m")).alias("threshold"), F.col("b.macro_f1").alias("macro_f1"), F.col("b.accuracy").alias("accuracy"))


def layer_head_cv(scores: DataFrame) -> DataFrame:
    """Fold predictions from per-key risk scores, weighted by AUC and cut at a learned threshold.

    ``scores(fold, role, feature_key, example_id, score, is_positive)``; weights and cuts come from role ``train``.
    """
    weights = auc_layer_weights(scores.where("role = 'train'"))
    mixed = scores.join(F.broadcast(weights.select("fold", "feature_key", "weight")), ["fold", "feature_key"]).groupBy("fold", "role", "example_id").agg(F.sum(F.col("weight") * F.col("score")).alias("score"), F.first("is_positive").alias("is_positive"))
    cuts = learn_threshold(mixed.where("role = 'train'"), ["fold"]).select("fold", "threshold")
    return mixed.where("role = 'test'").join(F.broadcast(cuts), "fold").withColumn("predicted_positive", F.col("score") >= F.col("threshold"))


def source_oof_scores(features: DataFrame, rows: DataFrame, keys: list[str], k: int, inner: int, positive: str, negative: str) -> DataFrame:
    """``(fold, role, feature_key, example_id, score, is_positive)``: out-of-fold train scores and outer test scores per key.

    ``rows`` have ``example_id, family, target, fold``; inner folds keep families whole too. The ``k * keys * (inner + 1)`` models are fitted together.
    """
    each = inner + 1  # of an outer fold: its inner models, and the one on all its training rows
    one = F.array(F.lit(0))
    parts = None
    for fold in range(k):
        train = grouped_folds(rows.where(F.col("fold") != fold).select("example_id", "family", "target"), inner, seed=fold)
        mine = F.col("fold") + fold * each
        others = F.filter(F.sequence(F.lit(fold * each), F.lit(fold * each + inner)), lambda m: m != mine)
        part = train.select("example_id", others.alias("groups"), F.array(mine).alias("asks"))
        part = part.unionByName(rows.where(F.col("fold") == fold).select("example_id", F.filter(one, lambda x: x > 0).alias("groups"), F.array(F.lit(fold * each + inner)).alias("asks")))
        parts = part if parts is None else parts.unionByName(part)
    roles = parts.groupBy("example_id").agg(F.flatten(F.collect_list("groups")).alias("groups"), F.flatten(F.collect_list("asks")).alias("asks"))
    roles = roles.join(rows.select("example_id", "target"), "example_id")
    shift = (F.array_position(F.array(*[F.lit(x) for x in keys]), F.col("feature_key")) - 1).cast("int") * (k * each)
    x = features.where(F.col("feature_key").isin(*keys)).join(roles, "example_id").withColumn("at", shift)
    moved = lambda c: F.transform(c, lambda g: g + F.col("at"))
    table = written(x.select("example_id", "target", "vector", moved("groups").alias("groups"), moved("asks").alias("asks")), "source-rows")
    models = fit_many(table, [Model(m) for m in range(len(keys) * k * each)], positive)
    p = predict_many(table, models, keep=("example_id", "target"))
    place = F.col("model") % (k * each)
    key = F.get(F.array(*[F.lit(x) for x in keys]), F.floor(F.col("model") / (k * each)).cast("int"))
    role = F.when(place % each == inner, "test").otherwise("train")
    return p.select(F.floor(place / each).cast("int").alias("fold"), role.alias("role"), key.alias("feature_key"), "example_id", F.col("positive_probability").alias("score"), (F.col("target") == positive).alias("is_positive"))


def _wide(scores: DataFrame, keys: list[str]) -> DataFrame:
    """``(fold, role, example_id, is_positive, vector)`` of the keys' scores in their order; examples without all of them are left out."""
    per = scores.where(F.col("feature_key").isin(*keys)).groupBy("fold", "role", "example_id", "is_positive").agg(F.sort_array(F.collect_list(F.struct("feature_key", "score"))).alias("s"))
    return per.where(F.size("s") == len(keys)).withColumn("vector", F.transform("s", lambda x: x["score"])).drop("s")


def meta_sweep(scores: DataFrame, sets: dict[str, list[str]], k: int, cs: tuple = (1.0,), learned: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(predictions, coefficients)`` of logistic regressions on source scores, for every set of sources, every C and every fold.

    The scores are read once for all: a fold's rows hold all sources, a set is some of their columns, and all models are
    fitted together. Cut at 0.5, or at a threshold learned on the fold's training scores. Predictions have ``source_set, c, fold``
    and are those of role ``test``; examples without all the sources that any set names are left out.
    """
    keys = sorted({x for named in sets.values() for x in named})
    names = list(sets)
    variants = [(fold, s, c) for fold in range(k) for s in names for c in cs]
    width = len(variants) // k
    mine = F.sequence(F.col("fold") * width, F.col("fold") * width + width - 1)
    test = F.col("role") == "test"
    asks = mine if learned else F.when(test, mine).otherwise(F.array().cast("array<int>"))
    wide = _wide(scores, keys).select("fold", "role", "example_id", "is_positive", F.col("is_positive").cast("int").cast("string").alias("target"), "vector", F.when(test, F.array().cast("array<int>")).otherwise(F.array("fold")).alias("groups"), asks.alias("asks"))
    table = written(wide, "meta-rows")
    columns = {s: tuple(keys.index(x) for x in sorted(sets[s])) for s in names}
    models = fit_many(table, [Model(fold, c, columns[s]) for fold, s, c in variants], "1")
    spark = scores.sparkSession
    named = spark.createDataFrame([(i, s, float(c)) for i, (_, s, c) in enumerate(variants)], "model int, source_set string, c double")
    p = predict_many(table, models, keep=("fold", "role", "example_id", "is_positive")).join(F.broadcast(named), "model").withColumnRenamed("positive_probability", "score")
    by = ["source_set", "c", "fold"]
    cut = p.where(test).withColumn("threshold", F.lit(0.5))
    if learned:
        best = learn_threshold(p.where("role = 'train'"), by).select(*by, "threshold")
        cut = p.where(test).join(F.broadcast(best), by)  # a row for each model
    out = cut.select(*by, "example_id", "is_positive", "score", "threshold").withColumn("predicted_positive", F.col("score") >= F.col("threshold"))
    found = model_table(spark, models, keys, {i: sorted(sets[s]) for i, (_, s, _) in enumerate(variants)})
    return out, found.drop("c").join(F.broadcast(named), "model").select("source_set", "c", F.col("group").alias("fold"), F.col("feature").alias("feature_key"), "mean", "scale", "coefficient")


def meta_head_cv(scores: DataFrame, keys: list[str], k: int, c: float = 1.0, learned: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(predictions, coefficients)`` of a logistic regression on the source scores per fold, cut at 0.5 or at a learned threshold."""
    p, coefs = meta_sweep(scores, {"keys": list(keys)}, k, (c,), learned)
    return p.drop("source_set", "c"), coefs.drop("source_set", "c")


def sweep_summary(predictions: DataFrame, baseline: DataFrame) -> DataFrame:
    """A row per ``source_set`` and ``c``: errors against those of ``baseline(example_id, is_correct)``, accuracy by fold, and the ``rank``.

    The best has the least net change of errors, then the fewest introduced, the fewest errors, the most fixed, the highest mean accuracy; ties go by name and C.
    """
    met = predictions.withColumn("good", F.col("predicted_positive") == F.col("is_positive")).join(baseline.select("example_id", F.col("is_correct").alias("was")), "example_id")
    by = ["source_set", "c"]
    per = met.groupBy(*by, "fold").agg(F.count_if(~F.col("was")).alias("r"), F.count_if(~F.col("good")).alias("e"), F.count_if(~F.col("was") & F.col("good")).alias("x"), F.count_if(F.col("was") & ~F.col("good")).alias("i"), F.avg(F.col("good").cast("int")).alias("a"))
    out = per.groupBy(*by).agg(F.sum("r").alias("reference_errors"), F.sum("e").alias("errors"), F.sum("x").alias("fixed"), F.sum("i").alias("introduced"), (F.sum("i") - F.sum("x")).alias("net"), F.avg("a").alias("mean_accuracy"), F.min("a").alias("min_accuracy"))
    # a row per variant
    return out.withColumn("rank", F.row_number().over(Window.orderBy("net", "introduced", "errors", F.desc("fixed"), F.desc("mean_accuracy"), "source_set", "c")))


def source_sets(keys: list[str]) -> dict[str, list[str]]:
    """Sets of sources for an ablation: all, without the last mean pool layers or the last final token layer, one pooling only; sets that repeat are named once."""
    pools: dict[str, list[str]] = {}
    for x in sorted(keys, key=lambda x: (int(x.rsplit("_", 1)[1]), x)):
        pools.setdefault(x.rsplit("_layer_", 1)[0], []).append(x)
    final, mean = pools.get("final_token", []), pools.get("mean_pool", [])
    if len(final) + len(mean) != len(keys) or not final or not mean:
        raise ValueError("sources are final_token and mean_pool layers, and there is one of each at least")
    named = {
        "full_dual_readout": final + mean, "drop_last_mean_pool": final + mean[:-1], "drop_last_two_mean_pool": final + mean[:-2], "drop_last_final_token": final[:-1] + mean,
        "drop_last_dual_readout_layer": final[:-1] + mean[:-1], "final_token_only": final, "mean_pool_only": mean,
    }
    out: dict[str, list[str]] = {}
    for name, some in named.items():
        if some and some not in out.values():
            out[name] = some
    return out


def combine_scores(scores: DataFrame, by: list[str]) -> DataFrame:
    """``(by..., rule, score, predicted_positive)`` for mean, max, mean of the top two, and share of votes at 0.5."""
    top = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "feature_key"))
    per = scores.withColumn("r", top).groupBy(*by).agg(F.avg("score").alias("mean"), F.max("score").alias("max"), F.avg(F.when(F.col("r") <= 2, F.col("score"))).alias("top_two"), F.avg((F.col("score") >= 0.5).cast("int")).alias("votes"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("score")) for r in ("mean", "max", "top_two", "votes")])).alias("x")
    return per.select(*by, rules).select(*by, "x.*").withColumn("predicted_positive", F.col("score") >= 0.5)


def clipped_logit(p, clip: float = 1e-4):
    """The log odds of a probability kept within ``clip`` of 0 and 1."""
    c = F.greatest(F.least(p, F.lit(1 - clip)), F.lit(clip))
    return F.log(c / (1 - c))


def _platt(scores: DataFrame, balanced: bool, scale: bool) -> DataFrame:
    """``scores`` mapped by a logistic fit of the score alone for each key and fold, on role ``train``; all fits are one."""
    kinds = [(r[0], r[1]) for r in scores.select("fold", "feature_key").distinct().orderBy("fold", "feature_key").collect()]  # folds x sources
    place = scores.sparkSession.createDataFrame([(*x, i) for i, x in enumerate(kinds)], "fold int, feature_key string, m int")
    met = scores.join(F.broadcast(place), ["fold", "feature_key"])
    table = written(met.select(*scores.columns, F.col("is_positive").cast("int").cast("string").alias("target"), F.array("score").alias("vector"), F.when(F.col("role") == "train", F.array("m")).otherwise(F.array().cast("array<int>")).alias("groups"), F.array("m").alias("asks")), "platt-rows")
    models = fit_many(table, [Model(i) for i in range(len(kinds))], "1", balanced, scale)
    out = predict_many(table, models, keep=tuple(scores.columns))
    return out.withColumn("score", F.col("positive_probability")).select(*scores.columns)


def transform_scores(scores: DataFrame, rule: str = "raw") -> DataFrame:
    """``scores`` as they are, as clipped log odds, or per key and fold through a balanced Platt fit of the standardised score on role ``train``."""
    if rule == "raw":
        return scores
    if rule == "logit":
        return scores.withColumn("score", clipped_logit(F.col("score")))
    if rule != "platt":
        raise ValueError(f"no rule {rule}")
    return _platt(scores, balanced=True, scale=True)


def interaction_scores(scores: DataFrame, rule: str = "family_means") -> DataFrame:
    """``scores`` with more sources: each pooling's mean (``family_means``), and their gap and its absolute value too (``family_mean_gaps``)."""
    if rule == "raw_scores":
        return scores
    if rule not in ("family_means", "family_mean_gaps"):
        raise ValueError(f"no rule {rule}")
    by = ["fold", "role", "example_id", "is_positive"]
    of = lambda pool: F.avg(F.when(F.col("feature_key").startswith(pool + "_layer_"), F.col("score")))
    per = scores.groupBy(*by).agg(of("final_token").alias("f"), of("mean_pool").alias("m"))
    gap = F.col("m") - F.col("f")
    more = {"final_token_mean": F.col("f"), "mean_pool_mean": F.col("m")}
    if rule == "family_mean_gaps":
        more |= {"mean_gap": gap, "absolute_mean_gap": F.abs(gap)}
    each = per.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("feature_key"), x.alias("score")) for n, x in more.items()])).alias("e"))
    return scores.unionByName(each.select("fold", "role", "e.feature_key", "example_id", "e.score", "is_positive"))


def family_means(scores: DataFrame, by: list[str]) -> DataFrame:
    """Mean score of each family of sources (the name before ``_layer_``), and their gap and absolute gap."""
    family = F.regexp_extract("feature_key", "^(.*)_layer_", 1)
    per = scores.groupBy(*by, family.alias("source")).agg(F.avg("score").alias("m")).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("source", "m"))).alias("s"))
    means = F.transform("s", lambda x: x["m"])
    return per.select(*by, F.map_from_entries("s").alias("means"), (F.array_max(means) - F.array_min(means)).alias("abs_gap"), (F.get(means, F.lit(0)) - F.get(means, F.size(means) - 1)).alias("gap"))


def logit_contributions(scores: DataFrame, coefficients: DataFrame, introduced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(per example, summary)``: standardised score times coefficient per key, summed up for the introduced errors."""
    met = scores.where("role = 'test'").join(F.broadcast(coefficients), ["fold", "feature_key"])
    each = met.select("fold", "example_id", "feature_key", "coefficient", ((F.col("score") - F.col("mean")) / F.col("scale") * F.col("coefficient")).alias("contribution"))
    mine = each.join(introduced.select("example_id").distinct(), "example_id", "left_semi")
    s = mine.groupBy("feature_key").agg(F.avg("contribution").alias("mean_contribution"), F.avg("coefficient").alias("mean_coefficient"), F.max(F.abs("contribution")).alias("max_abs"))
    return each, s.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("mean_contribution")), "feature_key")))


def nested_platt(features: DataFrame, rows: DataFrame, keys: list[str], k: int, inner: int, positive: str, negative: str) -> DataFrame:
    """Calibrated fold predictions per key: an unweighted logistic fit on inner out-of-fold probabilities, applied to the outer test."""
    scores = written(source_oof_scores(features, rows, keys, k, inner, positive, negative), "scores")
    fixed = _platt(scores, balanced=False, scale=False).where("role = 'test'")
    raw = scores.where("role = 'test'").select("fold", "feature_key", "example_id", F.col("score").alias("raw_probability"))
    p = F.col("score")
    return fixed.join(raw, ["fold", "feature_key", "example_id"]).select("feature_key", F.col("fold").alias("fold_index"), "example_id", F.when(F.col("is_positive"), positive).otherwise(negative).alias("true_label"), F.when(p >= 0.5, positive).otherwise(negative).alias("predicted_label"), F.lit(positive).alias("positive_label"), p.alias("positive_probability"), "raw_probability")
