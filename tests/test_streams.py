"""Streams: audits are written once, and keyed state survives a restart and expires when idle; staged evaluation on a hand case."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from canarylake.operators import runtime
from canarylake.streaming import jobs

T0 = dt.datetime(2026, 1, 1)


def fed(spark, folder, rows, schema, n):
    """One more file of a file stream."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{n}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)


def ran(df, folder):
    """What a stateful stream gives for all that is new."""
    got = []
    df.writeStream.outputMode("update").option("checkpointLocation", f"{folder}-state").foreachBatch(lambda b, _: got.extend(b.collect())).trigger(availableNow=True).start().awaitTermination()
    return got


def test_ledger_keeps_its_state_and_lets_idle_slots_go(spark, tmp_path):
    schema, folder = "session_id string, slot_name string, credential_type string, turn_index int, ts timestamp", str(tmp_path / "in")
    at = lambda minutes: T0 + dt.timedelta(minutes=minutes)
    run = lambda rows, n: sorted((r.session_id, r.slot_name, r.turn_index, r.credential_type) for r in ran(jobs.stream_ledger(fed(spark, folder, rows, schema, n), idle="60 minutes"), folder))
    assert run([("s", "a", "t3", 3, at(0)), ("s", "a", "t2", 2, at(1)), ("s", "b", "t1", 1, at(1)), ("u", "a", "t9", 9, at(2))], 1) == [("s", "a", 2, "t2"), ("s", "b", 1, "t1"), ("u", "a", 9, "t9")]
    # started again on its checkpoint: known slots stay, an earlier turn takes its place
    assert run([("s", "a", "t5", 5, at(20)), ("u", "a", "t4", 4, at(20))], 2) == [("u", "a", 4, "t4")]
    # two hours on, the slots are idle and go; the next planting is a new one
    run([("x", "a", "t1", 1, at(180))], 3)
    assert run([("s", "a", "t7", 7, at(181)), ("u", "a", "t8", 8, at(181)), ("x", "a", "t2", 2, at(182))], 4) == [("s", "a", 7, "t7"), ("u", "a", 8, "t8")]


def test_session_risk_goes_on_after_a_restart(spark, tmp_path):
    schema, folder = "session_id string, action string, risk_score double, ts timestamp", str(tmp_path / "in")
    run = lambda rows, n, idle=None: {r.session_id: (r.max_risk, round(r.total_risk, 6), r.gravest, r.turns) for r in ran(jobs.stream_session_risk(fed(spark, folder, rows, schema, n), idle=idle), folder)}
    assert run([("s", "warn", 0.4, T0), ("s", "allow", 0.1, T0), ("u", "block", 0.9, T0)], 1) == {"s": (0.4, 0.5, "warn", 2), "u": (0.9, 0.9, "block", 1)}
    assert run([("s", "escalate", 1.0, T0), ("s", "allow", 0.0, T0)], 2) == {"s": (1.0, 1.5, "escalate", 4)}


def test_a_replayed_batch_adds_no_rows(spark, tmp_path):
    schema = "trace_id string, session_id string, turn_index int, text string"
    can = spark.createDataFrame([("s", "c1", "sk-hny-aaaa"), ("s", "c2", "sk-hny-bbbb"), ("u", "c3", "sk-hny-cccc")], "session_id string, canary_id string, value string")
    detectors = [jobs.canary_detector(can), jobs.encoded_detector(can), jobs.shape_detector]
    rows = [("1", "s", 1, "it is sk-hny-bbbb"), ("2", "s", 2, "bbbb-ynh-ks"), ("3", "u", 1, "nothing"), ("4", "v", 1, "no canaries here"), ("5", "u", 2, "sk-hny-cccc and " + b"sk-hny-cccc".hex())]
    stream = fed(spark, str(tmp_path / "in"), rows, schema, 1)
    out = str(tmp_path / "audit")
    for place in ("one", "one", "two"):  # the last has lost its checkpoint: it judges the same batch again
        jobs.stream_guard(stream, detectors, out, str(tmp_path / place)).awaitTermination()
    audit = {r.trace_id: r for r in jobs.read_audit(spark, out).collect()}
    assert jobs.read_audit(spark, out).count() == 5
    assert {k: (r.action, r.triggered_detectors) for k, r in audit.items()} == {"1": ("escalate", ["canary"]), "2": ("block", ["encoded"]), "3": ("allow", []), "4": ("allow", []), "5": ("escalate", ["canary"])}
    assert [(x.detector_name, x.recommended_action) for x in audit["5"].results] == [("canary", "escalate"), ("encoded", "block"), ("shape", "allow")]
    assert audit["1"].released_text == "[withheld: escalate]" and audit["3"].released_text == "nothing"


def test_stages_read_what_was_decided_before(spark):
    turns = spark.createDataFrame([(f"t{i}", "s", i) for i in range(5)] + [("u0", "u", 0)], "trace_id string, session_id string, turn_index int")
    out = turns.where("trace_id <> 't4'").withColumn("text", F.concat(F.lit("text "), "trace_id"))
    pre = lambda t: runtime.result(t, "pre", F.when(F.col("turn_index") == 0, 0.6).otherwise(0.0), F.when(F.col("turn_index") == 0, "warn").otherwise("allow"))
    post = lambda t: runtime.result(t, "post", F.when(F.col("text").contains("t1"), 0.7).otherwise(0.0), F.when(F.col("text").contains("t1"), "sanitize").otherwise("allow"))
    got = {r.trace_id: r for r in runtime.evaluate_stages(turns, out, [pre], [post], [runtime.risk_budget(1.2), runtime.repeat_offender(1)]).collect()}
    assert {k: (r.action, r.triggered_detectors) for k, r in got.items()} == {
        "t0": ("warn", ["pre"]), "t1": ("block", ["risk_budget"]), "t2": ("block", ["risk_budget"]), "t3": ("block", ["risk_budget"]), "t4": ("block", ["risk_budget"]), "u0": ("warn", ["pre"])}
    assert [x.stage for x in got["t1"].results] == ["pre", "post", "session", "session"]
    assert got["t2"].results[3].recommended_action == "warn" and got["t1"].results[3].recommended_action == "allow"
    assert got["t4"].released_text == "[withheld: block]" and got["u0"].released_text == "text u0"
    alone = {r.trace_id: r.action for r in runtime.evaluate_stages(turns, out, [], [], [runtime.repeat_offender(1)]).collect()}
    assert set(alone.values()) == {"allow"} and len(alone) == 6
