"""Decoy cues, predictions of planted values, thresholds, bands, session tokens, and scans of crowded texts."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from canarylake.functions import formats
from canarylake.operators import accounting, generate, planted, runtime, scan
from canarylake.streaming import jobs


def test_cues(spark):
    values = ["sk-hny-q8Zr2LmX", "a Honey pot", "CANARY", "decoyed", "synthetic", "fakes", "latest", "abcdddde", "aaaaaaaaab", "q8Zr2LmXvB71", ""]
    got = {r.cue: r.canaries for r in accounting.beta_surrogate(spark.createDataFrame([(v,) for v in values], "value string")).collect()}
    assert got == {**{f"marker:{m}": 1 for m in accounting.MARKERS}, "low_realism:repeated_run": 2, "low_realism:entropy": 2, "any": 10}


def test_flags_go_before_words(spark):
    rows = [("a", None, True, "real", None), ("b", False, True, "planted", None), ("c", None, None, " Planted-Honeytoken\n", None), ("d", None, None, "so so", "REAL-SECRET"), ("e", None, None, "maybe", None), ("x", None, True, None, None)]
    p = spark.createDataFrame(rows, "token_id string, distinguished boolean, is_honeytoken boolean, prediction string, class string")
    can = spark.createDataFrame([(c,) for c in "abcdef"], "canary_id string")
    beta, bad = accounting.beta_from_predictions(p, can)
    assert (beta.first().n, beta.first().beta) == (4, 0.5)
    assert {(r.token_id, r.violation) for r in bad.collect()} == {("e", "unclear_label"), ("f", "missing_id"), ("x", "unknown_id")}


@pytest.mark.parametrize("bad", [1.5, -0.1, float("nan"), None])
def test_scores_outside_the_range_are_refused(spark, bad):
    rows = spark.createDataFrame([(0.5,), (bad,)], "score double")
    with pytest.raises(Exception, match="scores must lie"):
        accounting.conformal_threshold(rows, 0.1).collect()


def test_thresholds_equal_a_sort(spark):
    rng = random.Random(2)
    rows = [(g, round(rng.random() ** 3, rng.choice([1, 3, 6]))) for g in "abc" for _ in range(rng.randrange(1, 400))] + [("d", 1.0), ("d", 0.0)]
    got = {r.g: r for r in accounting.conformal_threshold(spark.createDataFrame(rows, "g string, score double").repartition(4), 0.1, by=["g"]).collect()}
    for g in "abcd":
        s = sorted(v for h, v in rows if h == g)
        rank = -(-(len(s) + 1) * 9 // 10)
        assert (got[g].m, got[g]["rank"], got[g].threshold) == (len(s), rank, s[rank - 1] if rank <= len(s) else float("inf"))


def test_band_profiles(spark):
    t = spark.createDataFrame([(k, k, 1, k, m) for k, m in (("a", "black_box"), ("b", "offline_eval"), ("c", "offline_eval"), ("d", "self_hosted_introspection"), ("e", "offline_eval"))], "trace_id string, session_id string, turn_index int, example_id string, capability_mode string")
    s = spark.createDataFrame([("b", 0.2), ("c", 0.9), ("d", 1.2)], "example_id string, score double")
    good, bad = runtime.banded_monitor(t, s, runtime.BandProfile("own", 0.1, 0.9, balanced_action="block"))
    assert {(r.trace_id, r.band, r.recommended_action, r.capability_status) for r in good.collect()} == {("a", "none", "allow", "unavailable"), ("b", "review", "warn", "active"), ("c", "balanced", "block", "active")}
    assert {(r.trace_id, r.violation) for r in bad.collect()} == {("d", "score_out_of_range"), ("e", "missing_score")}
    with pytest.raises(ValueError):
        runtime.BandProfile(review_threshold=0.8, balanced_threshold=0.5)


def test_session_tokens_follow_their_keys(spark):
    chain = generate.train_bigrams(generate.synthetic_corpus(spark, ["github-ghp", "stripe-sk-live"], 20, 1))
    slots = spark.createDataFrame([(s, n, k) for s in "ab" for n in "xy" for k in ("github_pat", "stripe_key")], "session_id string, slot_name string, credential_type string")
    kinds = {"github_pat": "github-ghp", "stripe_key": "stripe-sk-live"}
    one = generate.session_tokens(slots, chain, kinds, "stripe-sk-live").withColumnRenamed("value", "token")
    rows = formats.validate_tokens(one).collect()
    assert all(r.valid and kinds[r.credential_type] == r.format for r in rows) and len({r.token for r in rows}) == 8
    other = {r.value for r in generate.session_tokens(slots, chain, kinds, "stripe-sk-live", salt="other").collect()}
    assert not other & {r.token for r in rows}


def test_the_first_turn_plants_whenever_it_comes(spark, tmp_path):
    cols = "session_id string, slot_name string, credential_type string, turn_index int"
    for n, rows in enumerate(([("s", "a", "late", 5), ("s", "b", "only", 2)], [("s", "a", "early", 1)], [("s", "a", "later", 9)])):
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.stream_ledger(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda b, _: seen.extend(b.collect())).trigger(availableNow=True).start().awaitTermination()
    last = {(r.session_id, r.slot_name): (r.credential_type, r.turn_index) for r in seen}
    assert last == {("s", "a"): ("early", 1), ("s", "b"): ("only", 2)}


def test_a_registry_without_sessions_finds_the_same(spark):
    can = spark.createDataFrame([("c1", "s1", "sk-hny-q8Zr2LmXvB71pQwe9TyU", ""), ("c2", "s2", "k7w2x", ""), ("c3", "s3", "Zz9-Yy8-Xx7-Ww6-Vv5", "")], "canary_id string, session_id string, value string, sha256 string")
    cases = planted.attack_cases(can).withColumn("trace_id", F.concat_ws("-", "canary_id", "attack")).withColumn("turn_index", F.lit(1)).select(*planted.TURN, "text")
    one = {tuple(r) for r in planted.planted_exact_matches(cases, can).collect()}
    two = {tuple(r) for r in planted.planted_exact_matches(cases, can, by=None).collect()}
    assert one <= two and len(one) >= 30
    assert {r for r in two if r[0].startswith(r[3])} == one
    near = planted.gram_candidates(cases, can)
    met = {(r.trace_id, r.canary_id) for r in near.collect()}
    assert {("c1-partial_fuzzy", "c1"), ("c3-partial_fuzzy", "c3")} <= met


def test_scans_of_crowded_texts_equal_finditer(spark):
    rng = random.Random(5)

    def token(f):
        return "".join("".join(rng.choice(formats.SETS[s[0]]) for _ in range(s[1])) if isinstance(s, tuple) else "Ab3xYz" if s is formats.CHECKSUM else s for s in f.segments)

    texts = []
    for _ in range(300):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            parts.append(rng.choice([token(rng.choice(formats.FORMATS)), "plain words", "x" * rng.randrange(18, 30), "é", "AKIA" + "B" * 16]))
            parts.append(rng.choice([" ", "=", "==", "~", ":", ".", "/", "-", ",", "\n", "", "é", "="]))
        texts.append("".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {tuple(r) for r in scan.scan_registered(df).collect()}
    want = set()
    for i, t in enumerate(texts):
        for f in formats.FORMATS:
            if f.scannable and not f.checksummed:
                want |= {(i, f.slug, m.start(), m.end(), "medium") for m in re.finditer(formats.BEFORE + f.pattern + formats.AFTER, t)}
    assert {g for g in got if g[4] == "medium"} == want and len(want) > 100
    shape = formats.BEFORE + r"[A-Za-z0-9][A-Za-z0-9._~+/\-]{23,}={0,2}" + formats.AFTER
    near = {(i, m.start(), m.end()) for i, t in enumerate(texts) for m in re.finditer(shape, t)}
    found = {(r.doc_id, r.start, r.end) for r in scan.scan_unknown(df).collect()}
    assert found <= near and len(found) > 50
