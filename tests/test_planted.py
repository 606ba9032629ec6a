"""Planted values in every encoding, ledgers and audit safety."""

from __future__ import annotations

import base64
import time

from pyspark.sql import functions as F

from canarylake.functions.similarity import subsequence_length, substring_length
from canarylake.functions.text import base32, base32_decode
from canarylake.operators import accounting, ledger, planted, runtime

TURN = planted.TURN
VALUES = ["sk-hny-Ab3dEf6hIj9kLm2nOp", "postgresql://hny_u:Zx81kqTt@db.invalid:5432/app"]


def canaries(spark):
    return spark.createDataFrame([(f"c{i}", f"s{i}", v) for i, v in enumerate(VALUES)], "canary_id string, session_id string, value string").withColumn("sha256", F.sha2("value", 256))


def test_similarity_against_plain_dynamic_programming():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for a, b in (("abcde", "xaybzcd"), ("aaaa", "aa"), ("abc", ""), ("skhny123", "s1k2h3n4y123")):
        assert subsequence_length(a, b) == lcs(a, b)
    assert substring_length("abcdef", "xxcdexx") == 3 and substring_length("abc", "xyz") == 0


def test_all_attacks_are_caught(spark):
    can = canaries(spark)
    cases = planted.attack_cases(can).withColumn("trace_id", F.concat_ws("-", "canary_id", "attack")).withColumn("turn_index", F.lit(1)).cache()
    assert cases.count() == 24
    matches, scores = planted.scan_planted(cases.select(*TURN, "text"), can)
    benign = spark.createDataFrame([("b%d" % i, "s%d" % (i % 2), 1, t) for i, t in enumerate(["The weather is fine today.", "Totals rose in May.", "Hello there", "no secrets"] * 6)], "trace_id string, session_id string, turn_index int, text string")
    b_matches, b_scores = planted.scan_planted(benign, can)
    limit = accounting.conformal_threshold(b_scores, 0.05, score_col="fuzzy_score")
    table = accounting.detection_table(cases, matches, scores, b_scores, b_matches, limit, TURN).collect()
    assert len(table) == 12
    assert all(r.recall == 1.0 and r.precision == 1.0 for r in table), [r for r in table if r.recall < 1 or r.precision < 1]
    assert not any(v in str(r) for r in matches.collect() for v in VALUES), "no value in results"
    other = {(r.trace_id, r.channel) for r in planted.planted_exact_matches(cases, can, by=None).collect()}
    assert other == {(r.trace_id, r.channel) for r in planted.planted_exact_matches(cases, can).collect()}


def test_long_base32_runs_are_decoded_once(spark):
    """Runs of 4,000 letters, in time that grows with their length, not with its square."""
    texts = [bytes((i * j) % 26 + 97 for j in range(1, 2501)).decode() for i in range(1, 41)]
    rows = spark.createDataFrame([(t, base64.b32encode(t.encode()).decode()) for t in [*texts, "", "a", "abc", "\u00e9t\u00e9"]], "t string, e string")
    began = time.monotonic()
    got = rows.select("t", "e", base32(F.col("t")).alias("b"), base32_decode(F.lower(F.rtrim("e", F.lit("=")))).alias("d")).collect()
    assert time.monotonic() - began < 30
    assert all(r.b == r.e and (r.d or "") == r.t for r in got) and len(got) == 44


def test_boundaries_and_digits(spark):
    can = spark.createDataFrame([("c", "s", "secret7")], "canary_id string, session_id string, value string")
    import base64

    hexed = b"secret7".hex()
    texts = {"inside": "ff" + hexed + "00", "alone": hexed, "leet": "53cr37" + "7", "digit": "secre" + "tt", "b64": base64.b64encode(b"secret7").decode().rstrip("=")}
    outs = spark.createDataFrame([(k, "s", 1, v) for k, v in texts.items()], "trace_id string, session_id string, turn_index int, text string")
    got = {r.trace_id: r.channel for r in planted.planted_exact_matches(outs, can).collect()}
    assert got.get("alone") == "hex" and got.get("leet") == "leet_normalized" and got.get("b64") == "base64"
    assert "digit" not in got and got.get("inside") != "hex"


def test_canary_rules(spark):
    rows = [("a", "v", "x"), ("b", "", "x"), ("c", "w", "bad"), ("d", "z", "x"), ("d", "z2", "x")]
    df = spark.createDataFrame(rows, "canary_id string, value string, k string").withColumn("sha256", F.when(F.col("k") == "x", F.sha2("value", 256)).otherwise("0"))
    good, bad = planted.validate_canaries(df)
    assert [r.canary_id for r in good.collect()] == ["a"]
    assert sorted((r.canary_id, r.violation) for r in bad.collect()) == [("b", "empty_value"), ("c", "hash_mismatch"), ("d", "duplicate_id"), ("d", "duplicate_id")]


def test_detector_actions(spark):
    can = canaries(spark)
    v = VALUES[0]
    outs = spark.createDataFrame([("1", "s0", 1, f"x {v} y"), ("2", "s0", 2, v[:18]), ("3", "s0", 3, "hello"), ("4", "s0", 4, None)], "trace_id string, session_id string, turn_index int, text string")
    exact = {r.trace_id: r for r in planted.text_canary_detector(outs, can).collect()}
    assert [exact[k].recommended_action for k in "1234"] == ["escalate", "allow", "allow", "allow"] and exact["4"].capability_status == "degraded"
    part = {r.trace_id: r for r in planted.encoded_canary_detector(outs, can, 0.6).collect()}
    assert part["2"].recommended_action == "sanitize" and part["3"].recommended_action == "allow"


def test_ledger_spans_and_audit(spark):
    msg = [{"role": "user", "content": "use {{CREDENTIAL:db:type1}} then {{CREDENTIAL:db:type2}} and REAL"}]
    turns = spark.createDataFrame([("t1", "s", 1, msg), ("t2", "s", 2, [{"role": "user", "content": "again {{CREDENTIAL:db:type2}} or {{CREDENTIAL:api:k}}"}])], "trace_id string, session_id string, turn_index int, messages array<struct<role:string,content:string>>")
    led = ledger.plant(ledger.extract_placeholders(turns))
    rows = {r.slot_name: r for r in led.collect()}
    assert rows["db"].credential_type == "type1" and rows["db"].turn_planted == 1 and rows["api"].turn_planted == 2
    secrets = spark.createDataFrame([("s", "db", "REAL")], "session_id string, slot_name string, secret string")
    for r in ledger.inject(turns, led, secrets).collect():
        model, audit = r.model_messages[0].content, r.audit_messages[0].content
        assert "CREDENTIAL" not in model and "REAL" not in model
        assert not any(x.value in audit for x in rows.values()) and "[canary:hny_s_db]" in audit
        assert r.spans and all(model[s.start : s.end] == next(x.value for x in rows.values() if x.canary_id == s.canary_id) for s in r.spans)
        assert len(r.spans) == (3 if r.trace_id == "t1" else 2)


def test_policy_decision(spark):
    rows = [("t", "s", 1, "a", 0.9, "allow"), ("t", "s", 1, "b", 0.2, "block"), ("t", "s", 1, "c", 0.4, "block"), ("u", "s", 2, "a", 0.7, "allow")]
    res = spark.createDataFrame(rows, "trace_id string, session_id string, turn_index int, detector_name string, score double, recommended_action string")
    turns = spark.createDataFrame([("t", "s", 1), ("u", "s", 2), ("v", "s", 3)], "trace_id string, session_id string, turn_index int")
    got = {r.trace_id: (r.action, list(r.triggered_detectors), r.risk_score) for r in runtime.decide(res, turns).collect()}
    assert got == {"t": ("block", ["b", "c"], 0.4), "u": ("allow", [], 0.7), "v": ("allow", [], 0.0)}


def test_conformal_vectors(spark):
    t = accounting.conformal_threshold(spark.createDataFrame([(i / 10,) for i in range(10)], "score double"), 0.2).first()
    assert (t["rank"], t.threshold) == (9, 0.8)
    t = accounting.conformal_threshold(spark.createDataFrame([(0.1,), (0.2,), (0.3,)], "score double"), 0.05).first()
    assert t["rank"] == 4 and t.threshold == float("inf")
    flags = accounting.conformal_coverage(spark.createDataFrame([(0.6,), (0.61,)], "score double"), spark.createDataFrame([(0.6,)], "threshold double")).first()
    assert (flags.covered, flags.flagged) == (1, 1)
