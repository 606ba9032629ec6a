"""Calibration, thresholds, folds, residuals, comparison and policy text on hand cases."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from canarylake.operators import calibration, errors, generate, policytext, probes, residual
from canarylake.sources import io, lineage

PRED = "example_id string, true_label string, positive_label string, positive_probability double"


def preds(spark, rows):
    df = spark.createDataFrame([(str(i), t, "p", p) for i, (t, p) in enumerate(rows)], PRED)
    return df.withColumn("predicted_label", F.when(F.col("positive_probability") >= 0.5, "p").otherwise("n")).withColumn("is_correct", F.col("true_label") == F.col("predicted_label"))


def test_calibration_report_and_bins(spark):
    p = preds(spark, [("p", 1.0), ("n", 0.0), ("p", 0.3), ("n", 0.7)])
    r = calibration.calibration_report(p).first()
    assert r["count"] == 4 and r.accuracy == 0.5 and abs(r.brier - 0.98 / 4) < 1e-12 and abs(r.ece - 0.35) < 1e-12
    bins = {b.bin: b["count"] for b in calibration.calibration_bins(p).collect()}
    assert len(bins) == 10 and bins[9] == 1 and bins[3] == 1 and bins[7] == 1 and bins[5] == 0


def test_operating_points(spark):
    p = preds(spark, [("p", 0.9), ("p", 0.4), ("n", 0.6), ("n", 0.1)])
    rows = {r.threshold: r for r in calibration.operating_points(p, [0.3, 0.5, 0.8]).collect()}
    assert (rows[0.5].tp, rows[0.5].fp, rows[0.5].tn, rows[0.5].fn) == (1, 1, 1, 1)
    assert rows[0.3].high_recall and rows[0.3].recall == 1.0
    assert sum(r.best for r in rows.values()) == 1


def test_learn_threshold_equals_a_sweep(spark):
    rows = [("a", s, y) for s, y in ((0.1, False), (0.35, True), (0.35, False), (0.6, True), (0.62, False), (0.8, True))]
    got = residual.learn_threshold(spark.createDataFrame(rows, "k string, score double, is_positive boolean"), ["k"]).first()
    vals = sorted({s for _, s, _ in rows})
    cand = [vals[0] - 1e-12, vals[-1] + 1e-12, 0.5] + [(a + b) / 2 for a, b in zip(vals, vals[1:])]

    def score(t):
        tp = sum(y and s >= t for _, s, y in rows)
        fp = sum(not y and s >= t for _, s, y in rows)
        fn = sum(y and s < t for _, s, y in rows)
        tn = sum(not y and s < t for _, s, y in rows)
        f = lambda a, b, c: 2 * a / (2 * a + b + c) if a + b + c else 0.0
        return ((f(tp, fp, fn) + f(tn, fn, fp)) / 2, (tp + tn) / len(rows), -t)

    best = max(cand, key=score)
    assert abs(got.threshold - best) < 1e-9 and abs(got.macro_f1 - score(best)[0]) < 1e-12


def test_auc_with_ties(spark):
    rows = [(0, 0.2, False), (0, 0.5, True), (0, 0.5, False), (0, 0.9, True)]
    assert residual.auc(spark.createDataFrame(rows, "g int, score double, is_positive boolean"), ["g"]).first().auc == 0.875


def test_grouped_folds_keep_families_whole(spark):
    rows = [(str(i), f"f{i % 12}", "a" if i % 12 < 6 else "b") for i in range(120)]
    out = probes.grouped_folds(spark.createDataFrame(rows, "example_id string, family string, target string"), 3)
    assert out.groupBy("family").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    sizes = {(r.fold, r.target): r["count"] for r in out.groupBy("fold", "target").count().collect()}
    assert set(sizes.values()) == {20}
    with pytest.raises(ValueError):
        probes.grouped_folds(out.drop("fold"), 7)


def test_probe_learns_and_platt_calibrates(spark):
    rows = [(str(i), f"f{i % 8}", "p" if i % 3 == 0 else "n", [float((i % 3 == 0) * 2 + (i * 7 % 11) / 5), float(i % 5)]) for i in range(160)]
    df = spark.createDataFrame(rows, "example_id string, family string, target string, vector array<double>")
    folds = probes.grouped_folds(df, 2)
    p = probes.activation_probe_cv(folds, 2, "p", "n")
    assert p.where("is_correct").count() / p.count() > 0.75
    model = probes.train_linear_model(df, "p")
    assert probes.predict_linear_model(df, model).where("is_positive = (target = 'p')").count() > 120


def test_diagonal_uses_population_variance(spark):
    f = spark.createDataFrame([("1", "k", [1.0, 2.0]), ("2", "k", [3.0, 2.0])], "example_id string, feature_key string, vector array<double>")
    d = residual.fit_diagonal(f).first()
    assert list(d["mean"]) == [2.0, 2.0] and [round(v, 9) for v in d.variance] == [1.0, 0.0]


def test_compare_errors(spark):
    s = "dataset_id string, example_id string, family string, true_label string, is_correct boolean"
    a = spark.createDataFrame([("d", "1", "f", "p", False), ("d", "2", "f", "p", True), ("d", "3", "f", "p", False), ("d", "4", "f", "p", True)], s)
    b = spark.createDataFrame([("d", "1", "f", "p", True), ("d", "2", "f", "p", False), ("d", "3", "f", "n", False), ("d", "5", "f", "p", True)], s)
    rows, families, bad = errors.compare_errors(a, b)
    assert {(r.example_id, r.kind) for r in rows.collect()} == {("1", "fixed"), ("2", "introduced")}
    assert {(r.example_id, r.violation) for r in bad.collect()} == {("3", "label"), ("4", "only_reference"), ("5", "only_candidate")}
    assert families.first().fixed == 1


def test_bigrams(spark):
    c = generate.synthetic_corpus(spark, ["stripe-sk-live", "database-password"], 30, 2)
    t = generate.train_bigrams(c, epsilon=1.0, seed=1)
    assert t.groupBy("format", "state").agg(F.sum("prob").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    out = generate.sample_tokens(t, ["stripe-sk-live", "database-password"], 20, 3)
    from canarylake.functions.formats import validate_tokens

    assert validate_tokens(out).where("not valid").count() <= 1
    assert sorted(map(str, out.collect())) == sorted(map(str, generate.sample_tokens(t.repartition(3), ["stripe-sk-live", "database-password"], 20, 3).collect()))


def test_many_tokens_are_drawn(spark):
    """A step of the chain looks at its cells once; 40,000 tokens, all of their format, and the same again."""
    t = generate.train_bigrams(generate.synthetic_corpus(spark, ["stripe-sk-live"], 200, 1)).localCheckpoint()
    began = time.monotonic()
    got = generate.sample_tokens(t, ["stripe-sk-live"], 40_000, 1).agg(F.count_distinct("token"), F.count_if(F.col("token").rlike("^sk_live_[A-Za-z0-9]{24}$"))).first()
    assert time.monotonic() - began < 25 and tuple(got) == (40_000, 40_000)


def test_stored_models_fail_closed(spark, tmp_path):
    t = spark.createDataFrame([("stripe-sk-live", "<START>", "a", 0.6), ("stripe-sk-live", "<START>", "-", 0.6)], "format string, state string, next_char string, prob double")
    meta = spark.createDataFrame([("stripe-sk-live", 1.0, 0.0, 3, 1)], "format string, epsilon double, clip double, corpus_size int, train_seed int")
    lineage.write_transitions(t, meta, str(tmp_path / "m"))
    rows, bad = lineage.load_transitions(spark, str(tmp_path / "m"))
    assert rows.count() == 0 and {r.violation for r in bad.collect()} == {"row_sum", "alphabet", "clip"}
    with pytest.raises(Exception):
        lineage.write_transitions(t, meta, str(tmp_path / "m"))


def test_turns_from_json_lines(spark, tmp_path):
    good = '{"trace_id":"t","session_id":"s","turn_index":1,"capability_mode":"black_box","messages":[{"role":"user","content":"x"}]}'
    (tmp_path / "t.jsonl").write_text("\n".join([good, "", '{"trace_id":"","session_id":"s","turn_index":1,"capability_mode":"black_box","messages":[]}', "{broken", good.replace("black_box", "odd")]) + "\n")
    rows, bad = io.read_turns(spark, str(tmp_path / "t.jsonl"))
    assert rows.count() == 1 and sorted(r.violation for r in bad.collect()) == ["capability_mode", "corrupt", "trace_id"]


def test_policy_text(spark):
    texts = ['x\nTool payload: {"selected_field":"a","selected_mode":"m","selected_action":"copy"}', "Inline policy block: selected_field=b;selected_mode=n;selected_action=mask", "none"]
    good, bad = policytext.parse_policy(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert {(r.selected_field, r.policy_label, r.has_payload) for r in good.collect()} == {("a", "exfiltration_intent", True), ("b", "secret_present_safe", False)}
    assert bad.first().violation == "no_policy"
    got = policytext.parse_resolutions(spark.createDataFrame([('{"action":"mask"} copy',), ("please COPY",), ("copy mask",), ("",), (None,)], "text string")).collect()
    assert [r.resolution for r in got] == ["mask", "copy", "invalid", "invalid", "invalid"]


def test_policy_windows_search_a_text_once(spark):
    """A text of 40,000 tokens is searched once for each key, not once for each token; a repeated key is bad."""
    base = "lorem ipsum " * 13_333
    texts = [(base + "selected_field=a;selected_mode=b", "one"), ("selected_field=a selected_field=c selected_mode=b", "two")]
    offsets = lambda t: [(a, min(a + 4, len(t))) for a in range(0, len(t), 4)]
    rows = spark.createDataFrame([(t, i, offsets(t)) for t, i in texts], "text string, example_id string, offsets array<struct<start:int,end:int>>").localCheckpoint()
    began = time.monotonic()
    good, bad = policytext.policy_windows(rows)
    got = good.collect()
    assert time.monotonic() - began < 60
    a, b = len(base) // 4, (len(texts[0][0]) - 1) // 4
    assert [(r.example_id, r.window) for r in got] == [("one", list(range(a, b + 1)))]
    assert [(r.example_id, r.violation) for r in bad.collect()] == [("two", "assignments")]


def test_grouped_folds_of_many_families(spark):
    """So many families that none is dealt on the driver: folds within two percent of each other for both labels, families whole, also a null one."""
    n = 200_000
    h = F.xxhash64("id")
    df = spark.range(n).select("id", F.when(F.col("id") > 10, (F.floor(F.col("id") / (1 + F.pmod(F.floor(F.col("id") / 1000), F.lit(7))))).cast("string")).alias("family"), F.when(F.pmod(h, F.lit(10)) < 3, "a").otherwise("b").alias("target"))
    out = probes.grouped_folds(df, 4, seed=3).cache()
    assert out.count() == n
    assert out.groupBy("family").agg(F.count_distinct("fold").alias("k")).where("k > 1").count() == 0
    per = {}
    for r in out.groupBy("target", "fold").count().collect():
        per.setdefault(r["target"], []).append(r["count"])
    out.unpersist()
    assert all(len(c) == 4 and max(c) < 1.02 * min(c) for c in per.values()), per


def test_grouped_folds_of_few_large_families(spark):
    """One family holds a third of the rows; the rest go where it is not."""
    rows = [(i, "huge" if i % 3 == 0 else f"f{i % 50}", "a" if i % 2 else "b") for i in range(3000)]
    out = probes.grouped_folds(spark.createDataFrame(rows, "example_id long, family string, target string"), 3)
    sizes = sorted(r["count"] for r in out.groupBy("fold").count().collect())
    assert sum(sizes) == 3000 and sizes[-1] <= 1040


def brute_terms(text, kind):
    import re

    text = (text or "").lower()
    if kind == "word":
        w = re.findall(r"\b\w\w+\b", text)
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]
    out = []
    for w in text.split():
        w = f" {w} "
        for n in (3, 4, 5):
            out += [w[i : i + n] for i in range(len(w) - n + 1)]
    return out


@pytest.mark.parametrize("kind", ["word", "char"])
def test_tfidf_has_the_whole_vocabulary(spark, kind):
    import math
    from collections import Counter

    texts = ["The cat's été, the Ünï cat", "a dog a x1 y_2 dog dog", None, "", "cat dog\tbird  bird", "only here: zebra", "!!", "naïve Straße 12 3", "the the the"]
    rows = [(i, t, "p" if i % 2 else "n", i % 3) for i, t in enumerate(texts)]
    got, size = probes.tfidf(spark.createDataFrame(rows, "example_id long, text string, target string, fold int"), 3, kind)
    counts = {i: Counter(brute_terms(t, kind)) for i, t in enumerate(texts)}
    assert size == len({t for c in counts.values() for t in c})
    found = got.collect()
    assert len(found) == 3 * len(texts)
    for r in found:
        train = [c for i, c in counts.items() if i % 3 != r.model_fold]
        df = Counter(t for c in train for t in c)
        want = [n * (math.log((1 + len(train)) / (1 + df[t])) + 1) for t, n in counts[r.example_id].items() if t in df]
        norm = math.sqrt(sum(v * v for v in want))
        assert len(set(r.ids)) == len(r.ids) and all(0 <= x < size for x in r.ids)
        assert sorted(round(v, 9) for v in r["values"]) == sorted(round(v / norm, 9) for v in want)


def test_text_probe_with_three_targets(spark):
    words = {"x": "alpha beta gamma", "y": "delta epsilon zeta", "z": "eta theta iota"}
    rows = [(i, f"{words[t]} common word{i}", t, (i // 3) % 2) for i, t in enumerate("xyz" * 12)]
    p = probes.text_probe_cv(spark.createDataFrame(rows, "example_id long, text string, target string, fold int"), 2, "word").collect()
    assert len(p) == 36 and all(r.is_correct for r in p)


@pytest.mark.parametrize("names", ["ab", "abc"])
def test_text_probe_holds_a_number_for_each_text_only(spark, names, monkeypatch):
    """The fit's vectors are as long as there are texts, not terms, and its answers those of weights for each term."""
    import numpy as np

    from canarylake.operators import fits

    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        t = names[rng.integers(len(names))]
        rows.append((i, " ".join([f"{t}{x}" if rng.random() < 0.12 else f"w{x}" for x in rng.integers(0, 300, 30)]) if i else None, t, int(rng.integers(2))))
    df = spark.createDataFrame(rows, "example_id long, text string, target string, fold int")
    sizes = []
    step = fits._RowFit.told
    monkeypatch.setattr(fits._RowFit, "told", lambda self, *a: (sizes.append(self.x.shape[1]), step(self, *a)) and None)
    got = {r.example_id: r.predicted_label for r in probes.text_probe_cv(df, 2).collect()}
    assert set(sizes) == {(len(rows) + 1) * (1 if len(names) == 2 else 3)}
    table, size = probes.tfidf(df, 2)
    own, none = F.array("model_fold"), F.array().cast("array<int>")
    same = F.col("fold") == F.col("model_fold")
    table = table.withColumn("label", F.instr(F.lit(names), F.col("target")) - 1).withColumn("groups", F.when(same, none).otherwise(own)).withColumn("asks", F.when(same, own).otherwise(none)).localCheckpoint()
    weights = fits.fit_sparse(table, size, [0, 1], len(names))
    want = {r.example_id: names[r.prediction] for r in fits.classify_sparse(table, weights, ("example_id",)).collect()}
    assert got == want and len(set(want.values())) == len(names)


def test_tfidf_of_a_long_text(spark):
    """60,000 terms of one text are weighed in time that grows with their number, not with its square."""
    n = 30_000
    rows = [(0, " ".join(f"w{i}" for i in range(n)), "p", 0), (1, "w1 w2 w2", "n", 1)]
    df = spark.createDataFrame(rows, "example_id long, text string, target string, fold int")
    began = time.monotonic()
    table, size = probes.tfidf(df, 2)
    got = {(r.example_id, r.model_fold): len(r.ids) for r in table.collect()}
    assert time.monotonic() - began < 60
    assert size == 2 * n and got == {(0, 0): 3, (0, 1): 2 * n - 1, (1, 0): 4, (1, 1): 3}


def nested(spark, n=180):
    import numpy as np

    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, n)
    x = {"final_token_layer_01": y[:, None] + rng.standard_normal((n, 3)), "final_token_layer_02": 0.3 * y[:, None] + rng.standard_normal((n, 2)), "mean_pool_layer_01": 0.6 * y[:, None] + rng.standard_normal((n, 3)), "mean_pool_layer_02": rng.standard_normal((n, 3))}
    features = spark.createDataFrame([(str(i), k, [float(a) for a in v[i]]) for k, v in x.items() for i in range(n)], "example_id string, feature_key string, vector array<double>")
    rows = spark.createDataFrame([(str(i), f"f{i % 30}", "p" if y[i] else "n") for i in range(n)], "example_id string, family string, target string")
    return features, rows, list(x)


def test_nested_scores_and_the_sweep(spark):
    """Each example has a test score and out-of-fold scores; a sweep of one set and C is the meta head; the summary counts errors."""
    features, rows, keys = nested(spark)
    folds = probes.grouped_folds(rows, 3)
    s = residual.source_oof_scores(features, folds, keys, 3, 2, "p", "n").cache()
    per = s.groupBy("example_id", "feature_key").agg(F.count_if(F.col("role") == "test").alias("t"), F.count_if(F.col("role") == "train").alias("o"), F.count_distinct("fold").alias("f")).collect()
    assert len(per) == 180 * 4 and all((r.t, r.o, r.f) == (1, 2, 3) for r in per)
    # one source's test scores are those of a probe that its outer training rows fit
    one = probes.activation_probe_cv(features.where("feature_key = 'mean_pool_layer_01'").join(folds, "example_id"), 3, "p", "n")
    a = {r.example_id: r.score for r in s.where("role = 'test' and feature_key = 'mean_pool_layer_01'").collect()}
    assert all(abs(a[r.example_id] - r.positive_probability) < 1e-9 for r in one.collect())
    sets = residual.source_sets(keys)
    assert list(sets) == ["full_dual_readout", "drop_last_mean_pool", "drop_last_two_mean_pool", "drop_last_final_token", "drop_last_dual_readout_layer", "mean_pool_only"]
    p, coefs = residual.meta_sweep(s, sets, 3, (0.1, 10.0), learned=True)
    p = p.cache()
    assert p.count() == 6 * 2 * 180 and coefs.count() == 3 * 2 * sum(map(len, sets.values()))
    alone, _ = residual.meta_head_cv(s, sets["mean_pool_only"], 3, 10.0, learned=True)
    b = {r.example_id: (r.score, r.threshold) for r in p.where("source_set = 'mean_pool_only' and c = 10").collect()}
    assert all(abs(b[r.example_id][0] - r.score) < 1e-9 and abs(b[r.example_id][1] - r.threshold) < 1e-9 for r in alone.collect())
    base = s.where("role = 'test' and feature_key = 'mean_pool_layer_02'").select("example_id", ((F.col("score") >= 0.5) == F.col("is_positive")).alias("is_correct"))
    was = {r.example_id: r.is_correct for r in base.collect()}
    summary = {(r.source_set, r.c): r for r in residual.sweep_summary(p, base).collect()}
    for (name, c), r in summary.items():
        now = {x.example_id: x.predicted_positive == x.is_positive for x in p.where(f"source_set = '{name}' and c = {c}").collect()}
        assert r.errors == sum(not v for v in now.values()) and r.fixed == sum(now[e] and not was[e] for e in now) and r.introduced == sum(was[e] and not now[e] for e in now)
    best = min(summary.values(), key=lambda r: (r.net, r.introduced, r.errors, -r.fixed, -r.mean_accuracy, r.source_set, r.c))
    assert best["rank"] == 1
    s.unpersist()
    p.unpersist()


def test_platt_fits_are_unweighted_on_raw_probabilities(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    features, rows, keys = nested(spark)
    folds = probes.grouped_folds(rows, 2)
    got = residual.nested_platt(features, folds, keys[:1], 2, 2, "p", "n").collect()
    s = residual.source_oof_scores(features, folds, keys[:1], 2, 2, "p", "n").where("fold = 0 and role = 'train'")
    n = s.count()
    one = LogisticRegression(regParam=1.0 / n, standardization=False, maxIter=500, tol=1e-12).fit(s.select(array_to_vector(F.array("score")).alias("features"), F.col("is_positive").cast("double").alias("label")))
    import math

    for r in got:
        if r.fold_index == 0:
            z = one.coefficients[0] * r.raw_probability + one.intercept
            assert abs(r.positive_probability - 1 / (1 + math.exp(-z))) < 1e-5
    assert len(got) == 180
