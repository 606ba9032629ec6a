"""Streams of outputs, placeholders and decisions. File streams here; any source with the same columns will do."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.ledger import hash_token
from ..operators.runtime import ACTIONS, TURN, audit_rows, result
from ..operators.scan import findings

#: A detector of a batch: results (see :func:`..runtime.result`) of the turns of ``(trace_id, session_id, turn_index, text)``.
Detector = Callable[[DataFrame], DataFrame]


def canary_detector(canaries: DataFrame) -> Detector:
    """A verbatim canary of the output's own session escalates, one of another session blocks; ``canaries(session_id, canary_id, value)`` is static."""
    per = canaries.groupBy("session_id").agg(F.collect_list("value").alias("values"))

    def detect(outputs: DataFrame) -> DataFrame:
        hit = F.exists(F.coalesce("values", F.array().cast("array<string>")), lambda v: F.col("text").contains(v))
        return result(outputs.join(per, "session_id", "left"), "canary", F.when(hit, 1.0).otherwise(0.0), F.when(hit, "escalate").otherwise("allow"))

    return detect


def shape_detector(outputs: DataFrame) -> DataFrame:
    """A secret shape in the output sanitises, by the confidence of its best finding; unknown shapes only warn."""
    best = F.array_max(F.transform(findings(F.col("text")), lambda f: F.when(f["confidence"] == "high", 0.95).when(f["confidence"] == "medium", 0.65).otherwise(0.35)))
    score = F.coalesce(best, F.lit(0.0))
    return result(outputs.withColumn("__score", score), "shape", F.col("__score"), F.when(F.col("__score") >= 0.65, "sanitize").when(F.col("__score") > 0, "warn").otherwise("allow"))


def encoded_detector(canaries: DataFrame) -> Detector:
    """A reversed or hexadecimal canary of the session blocks."""
    per = canaries.groupBy("session_id").agg(F.collect_list("value").alias("values"))

    def detect(outputs: DataFrame) -> DataFrame:
        forms = lambda v: F.col("text").contains(F.reverse(v)) | F.lower("text").contains(F.lower(F.hex(v.cast("binary"))))
        hit = F.exists(F.coalesce("values", F.array().cast("array<string>")), forms)
        return result(outputs.join(per, "session_id", "left"), "encoded", F.when(hit, 0.9).otherwise(0.0), F.when(hit, "block").otherwise("allow"))

    return detect


def stream_guard(outputs: DataFrame, detectors: list[Detector], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Audit every streamed output once: the results of all detectors, the decision, and what is let through.

    Each batch is written under its own number and replaces what was there, so a batch that is run again after a
    failure adds no rows. Read the table with :func:`read_audit`.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.select(*TURN, "text")
        audit_rows(batch, [d(batch) for d in detectors]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return outputs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_audit(spark, path: str) -> DataFrame:
    """The audit rows of all batches."""
    return spark.read.option("basePath", path).parquet(path)


# ---------------------------------------------------------------- state by key


class _Idle(StatefulProcessor):
    """State of a key that goes once event time is ``idle`` milliseconds past the last row of the key (None: never)."""

    schema = ""

    def __init__(self, idle: int | None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema + ", until long")

    def later(self, old: tuple | None, rows: pd.DataFrame) -> int:
        """When the state may go, after these rows; a timer is set for then."""
        if self.idle is None:
            return 0
        until = max(int(rows["ts"].max().timestamp() * 1000) + self.idle, old[-1] if old else 0)
        self.handle.registerTimer(until)
        return until

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self.state.get()[-1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class _FirstPlanting(_Idle):
    """The planting of a session's slot: that of the earliest turn so far; a row is given when it changes."""

    schema = "turn_index int, credential_type string"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        old = self.state.get() if self.state.exists() else None
        first = min(batch[["turn_index", "credential_type"]].itertuples(index=False, name=None))
        first = (int(first[0]), first[1])
        best = min(first, tuple(old[:2])) if old else first
        self.state.update((*best, self.later(old, batch)))
        if old is None or best != tuple(old[:2]):
            yield pd.DataFrame({"session_id": [key[0]], "slot_name": [key[1]], "credential_type": [best[1]], "turn_index": [best[0]]})


class _Risk(_Idle):
    """A session's gravest action, its largest and its summed risk, and its turns so far."""

    schema = "max_risk double, total_risk double, top int, turns long"

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        old = self.state.get() if self.state.exists() else None
        m, s, t, n = old[:4] if old else (0.0, 0.0, 0, 0)
        top = max([t, *(ACTIONS.index(a) for a in batch["action"] if a in ACTIONS)])
        now = (float(max(m, batch["risk_score"].max())), float(s + batch["risk_score"].sum()), top, int(n + len(batch)))
        self.state.update((*now, self.later(old, batch)))
        yield pd.DataFrame({"session_id": [key[0]], "max_risk": [now[0]], "total_risk": [now[1]], "gravest": [ACTIONS[top]], "turns": [now[3]]})


def _stateful(rows: DataFrame, keys: list[str], processor, schema: str, idle: str | None, delay: str) -> DataFrame:
    spark = rows.sparkSession
    # keyed state with timers lives in RocksDB
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    if idle is None:
        return rows.groupBy(*keys).transformWithStateInPandas(processor(None), schema, "Update", "None")
    length = pd.Timedelta(idle)
    return rows.withWatermark("ts", delay).groupBy(*keys).transformWithStateInPandas(processor(int(length.total_seconds() * 1000)), schema, "Update", "EventTime")


def stream_ledger(placeholders: DataFrame, salt: str = "canary", idle: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """The first planting of each session and slot: that of its earliest turn, whichever batch brings it.

    Run it in update mode: a row comes when a slot is planted, and again only if an earlier turn comes in later. ``idle``, such as ``1 hour``: the
    state of a slot goes once the watermark of ``ts`` (``delay`` behind) is so far past its last row; what comes afterwards plants anew.
    """
    rows = placeholders.select("session_id", "slot_name", "credential_type", F.col("turn_index").cast("int").alias("turn_index"), *(["ts"] if idle else []))
    out = _stateful(rows, ["session_id", "slot_name"], _FirstPlanting, "session_id string, slot_name string, credential_type string, turn_index int", idle, delay)
    return out.withColumn("value", hash_token(salt))


def stream_session_risk(decisions: DataFrame, idle: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """Per session the gravest action, the largest and the summed risk so far; run it in update mode. ``idle`` and ``delay`` bound the state as in :func:`stream_ledger`."""
    rows = decisions.select("session_id", "action", F.col("risk_score").cast("double").alias("risk_score"), *(["ts"] if idle else []))
    return _stateful(rows, ["session_id"], _Risk, "session_id string, max_risk double, total_risk double, gravest string, turns long", idle, delay)
