"""Turns, detector results, policy decisions and audit rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN = ["trace_id", "session_id", "turn_index"]
#: Actions from the mildest to the gravest.
ACTIONS = ("allow", "warn", "sanitize", "block", "escalate")


def severity(action: Column) -> Column:
    """The action's place in :data:`ACTIONS`; null for others."""
    out = F.lit(None).cast("int")
    for i, a in enumerate(ACTIONS):
        out = F.when(action == a, i).otherwise(out)
    return out


def _action(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(a) for a in ACTIONS]), rank)


CHAT = "model string, trace_id string, session_id string, turn_index int, messages array<struct<role:string,content:string>>"


def normalize_chats(raw: DataFrame, body_col: str = "body") -> tuple[DataFrame, DataFrame]:
    """``(turns, bad)`` from JSON chat bodies.

    A body needs a model and messages, all with string content. Missing ids come from a hash of the body; the turn is 1 by default.
    """
    parsed = raw.withColumn("c", F.from_json(body_col, CHAT, {"mode": "PERMISSIVE"}))
    empty = F.coalesce(F.size("c.messages") <= 0, F.lit(True))
    reason = F.when(F.coalesce(F.length("c.model") == 0, F.lit(True)), "model").when(empty, "messages").when(F.exists("c.messages", lambda m: m["content"].isNull()), "content")
    marked = parsed.withColumn("violation", reason)
    key = F.sha2(F.col(body_col), 256)
    good = marked.where("violation is null").select(
        F.coalesce("c.trace_id", F.concat(F.lit("trace-"), F.substring(key, 1, 16))).alias("trace_id"), F.coalesce("c.session_id", F.concat(F.lit("session-"), F.substring(key, 1, 16))).alias("session_id"),
        F.coalesce("c.turn_index", F.lit(1)).alias("turn_index"), F.col("c.model").alias("model_id"), F.transform("c.messages", lambda m: F.struct(F.coalesce(m["role"], F.lit("user")).alias("role"), m["content"].alias("content"))).alias("messages"))
    return good, marked.where("violation is not null").select(body_col, "violation")


def attach_features(turns: DataFrame, features: DataFrame, source: str, key: str = "example_id") -> DataFrame:
    """``turns`` with ``feature_vector`` and ``feature_source``, in self-hosted and offline modes only."""
    met = turns.join(features.select(key, F.col("vector").alias("__v")), key, "left")
    on = F.col("capability_mode").isin("self_hosted_introspection", "offline_eval")
    return met.withColumn("feature_vector", F.when(on, F.col("__v"))).withColumn("feature_source", F.when(on & F.col("__v").isNotNull(), source)).withColumn("feature_size", F.when(F.col("feature_vector").isNotNull(), F.size("feature_vector"))).drop("__v")


def linear_score(turns: DataFrame, mean: list[float], scale: list[float], coef: list[float], intercept: float, threshold: float = 0.5, positive: bool = True) -> DataFrame:
    """A detector result per turn from a standardised linear model and the logistic function.

    The label is positive at or over the threshold. Other modes are ``unavailable``; a missing vector, or one of another width, is ``degraded``.
    """
    arr = lambda x: F.array(*[F.lit(float(v)) for v in x])
    scaled = F.zip_with(F.zip_with(F.transform("feature_vector", lambda v: v.cast("double")), arr(mean), lambda v, m: v - m), arr(scale), lambda d, s: d / F.when(s == 0, 1.0).otherwise(s))
    z = F.aggregate(F.zip_with(scaled, arr(coef), lambda a, b: a * b), F.lit(float(intercept)), lambda a, v: a + v)
    p = F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))
    p = p if positive else 1 - p
    mode = F.col("capability_mode").isin("self_hosted_introspection", "offline_eval")
    fits = F.coalesce(F.size("feature_vector") == len(coef), F.lit(False))
    status = F.when(~mode, "unavailable").when(~fits, "degraded").otherwise("active")
    score = F.when(mode & fits, p).otherwise(0.0)
    return turns.select(*TURN, F.lit("linear_probe").alias("detector_name"), score.alias("score"), F.when(mode & fits & (p >= threshold), "block").otherwise("allow").alias("recommended_action"), status.alias("capability_status"))


@dataclass(frozen=True)
class BandProfile:
    """Where the bands of a monitor begin, and what it asks for in each."""

    detector_name: str = "banded_monitor"
    review_threshold: float = 0.25
    balanced_threshold: float = 0.5
    low_action: str = "allow"
    review_action: str = "warn"
    balanced_action: str = "warn"
    capability: str = "self_hosted_introspection"

    def __post_init__(self):
        if not 0 <= self.review_threshold <= self.balanced_threshold <= 1:
            raise ValueError("thresholds must be in order within [0, 1]")


def banded_monitor(turns: DataFrame, scores: DataFrame, profile: BandProfile = BandProfile()) -> tuple[DataFrame, DataFrame]:
    """``(results, errors)``: bands allow, review and balanced by the profile's thresholds, with its actions.

    Turns of a mode without access to the model are ``unavailable`` and allowed; others without a score, or with one outside [0, 1], are errors.
    """
    met = turns.join(scores.select("example_id", F.col("score").alias("__s")), "example_id", "left")
    seen = F.col("capability_mode").isin("self_hosted_introspection", "offline_eval")
    s = F.col("__s")
    fine = F.coalesce(s.between(0.0, 1.0), F.lit(False))
    band = F.when(s >= profile.balanced_threshold, "balanced").when(s >= profile.review_threshold, "review").otherwise("allow")
    action = F.when(~seen, "allow").when(s >= profile.balanced_threshold, profile.balanced_action).when(s >= profile.review_threshold, profile.review_action).otherwise(profile.low_action)
    results = met.where(~seen | fine).select(*TURN, F.lit(profile.detector_name).alias("detector_name"), F.when(seen, s).otherwise(0.0).alias("score"), F.when(seen, band).otherwise("none").alias("band"), action.alias("recommended_action"), F.lit(profile.capability).alias("capability_required"), F.when(seen, "active").otherwise("unavailable").alias("capability_status"))
    return results, met.where(seen & ~fine).select(*TURN, "example_id", F.when(s.isNull(), "missing_score").otherwise("score_out_of_range").alias("violation"))


def decide(results: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """One decision per turn: the gravest recommended action, its detectors in order, and the best score among them.

    ``position`` orders detectors where results have it. Turns without results are allowed at risk 0.
    """
    pos = F.col("position") if "position" in results.columns else F.lit(0)
    ranked = results.withColumn("__sev", severity(F.col("recommended_action")))
    per = ranked.groupBy(*TURN).agg(F.max("__sev").alias("top"), F.max(F.struct("__sev", "score")).alias("best"), F.sort_array(F.collect_list(F.struct(pos.alias("p"), F.col("detector_name").alias("d"), F.col("__sev").alias("s")))).alias("all"))
    names = F.transform(F.filter("all", lambda r: (r["s"] == F.col("top")) & (F.col("top") > 0)), lambda r: r["d"])
    out = per.select(*TURN, _action(F.col("top")).alias("action"), names.alias("triggered_detectors"), F.col("best.score").alias("risk_score"))
    if turns is None:
        return out
    every = turns.select(*TURN).distinct().join(out, TURN, "left")
    return every.select(*TURN, F.coalesce("action", F.lit("allow")).alias("action"), F.coalesce("triggered_detectors", F.array().cast("array<string>")).alias("triggered_detectors"), F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"))


def result(turns: DataFrame, name: str, score: Column, action: Column, status: Column | None = None) -> DataFrame:
    """A detector's results: a row per turn with its score and the action that it asks for."""
    return turns.select(*TURN, F.lit(name).alias("detector_name"), score.cast("double").alias("score"), action.alias("recommended_action"), (F.lit("active") if status is None else status).alias("capability_status"))


def _positioned(detectors: list[DataFrame], stages: list[str] | None = None) -> DataFrame:
    """The results of all detectors with their ``position`` and their ``stage``."""
    out = None
    for i, d in enumerate(detectors):
        status = F.col("capability_status") if "capability_status" in d.columns else F.lit("active")
        part = d.select(*TURN, "detector_name", F.col("score").cast("double").alias("score"), "recommended_action", status.alias("capability_status"), F.lit(i).alias("position"), F.lit(stages[i] if stages else "post").alias("stage"))
        out = part if out is None else out.unionByName(part)
    return out


def withheld(action: Column) -> Column:
    """Whether an output is not let through as it is."""
    return action.isin("sanitize", "block", "escalate")


def _audit(turns: DataFrame, results: DataFrame) -> DataFrame:
    """Audit rows of ``turns(trace_id, session_id, turn_index, text)``."""
    decisions = decide(results, turns)
    listed = results.groupBy(*TURN).agg(F.sort_array(F.collect_list(F.struct("position", "stage", "detector_name", "score", "recommended_action", "capability_status"))).alias("results"))
    met = turns.select(*TURN, "text").join(listed, TURN, "left").join(decisions, TURN)
    shown = F.when(withheld(F.col("action")), F.concat(F.lit("[withheld: "), "action", F.lit("]"))).otherwise(F.col("text"))
    return met.select(*TURN, "results", "action", "triggered_detectors", "risk_score", shown.alias("released_text"))


def audit_rows(outputs: DataFrame, detectors: list[DataFrame]) -> DataFrame:
    """Audit rows of ``outputs(trace_id, session_id, turn_index, text)``: results of all detectors, the decision, and the output, replaced where it is not let through."""
    return _audit(outputs, _positioned(detectors))


def evaluate_turns(turns: DataFrame, outputs: DataFrame, detectors: list[DataFrame]) -> DataFrame:
    """:func:`audit_rows` of turns whose outputs may be missing."""
    return audit_rows(turns.select(*TURN).join(outputs.select(*TURN, "text"), TURN, "left"), detectors)


def evaluate_stages(turns: DataFrame, outputs: DataFrame, pre: list, post: list, session: list) -> DataFrame:
    """Audit rows of an evaluation in three stages; a stage is a list of functions from rows to a detector's results.

    ``pre`` sees the turns before there is an output, ``post`` the turns with ``text``, and ``session`` the turns with what the two before
    decided and the session's state in its order of turns: ``action, risk_score``, and over the turns up to this one ``max_risk, total_risk, gravest`` and
    ``earlier_withheld``, the number of turns before this one that were not let through. The decision is over the results of all stages.
    """
    met = turns.join(outputs.select(*TURN, "text"), TURN, "left")
    first = [f(turns) for f in pre] + [f(met) for f in post]
    names = ["pre"] * len(pre) + ["post"] * len(post)
    so_far = decide(_positioned(first, names), turns) if first else turns.select(*TURN, F.lit("allow").alias("action"), F.lit(0.0).alias("risk_score"))
    before = Window.partitionBy("session_id").orderBy("turn_index", "trace_id").rowsBetween(Window.unboundedPreceding, -1)
    state = session_risk(so_far).withColumn("earlier_withheld", F.coalesce(F.count_if(withheld(F.col("action"))).over(before), F.lit(0)))
    state = state.select(*TURN, "action", "risk_score", "max_risk", "total_risk", "gravest", "earlier_withheld")
    last = met.drop("action", "risk_score").join(state, TURN)
    return _audit(met, _positioned(first + [f(last) for f in session], names + ["session"] * len(session)))


def risk_budget(limit: float):
    """A session detector: once the summed risk of a session is over ``limit``, its turns are blocked."""
    return lambda rows: result(rows, "risk_budget", F.least(F.col("total_risk") / F.lit(limit), F.lit(1.0)), F.when(F.col("total_risk") > limit, "block").otherwise("allow"))


def repeat_offender(turns: int):
    """A session detector: after ``turns`` withheld turns, all that follow are warned of."""
    return lambda rows: result(rows, "repeat_offender", F.when(F.col("earlier_withheld") >= turns, 0.5).otherwise(0.0), F.when(F.col("earlier_withheld") >= turns, "warn").otherwise("allow"))


def capability_report(results: DataFrame, by: list[str]) -> DataFrame:
    """Active detectors, and unavailable or degraded ones with their status, per mode and model."""
    off = F.col("capability_status") != "active"
    return results.groupBy(*by).agg(F.array_sort(F.collect_set(F.when(~off, F.col("detector_name")))).alias("active"), F.array_sort(F.collect_set(F.when(off, F.concat_ws(":", "detector_name", "capability_status")))).alias("inactive"))


def session_risk(decisions: DataFrame) -> DataFrame:
    """Running maximum and sum of risk and the gravest action so far, in a session's order of turns."""
    so_far = Window.partitionBy("session_id").orderBy("turn_index", "trace_id").rowsBetween(Window.unboundedPreceding, 0)
    return decisions.select("*", F.max("risk_score").over(so_far).alias("max_risk"), F.sum("risk_score").over(so_far).alias("total_risk"), _action(F.max(severity(F.col("action"))).over(so_far)).alias("gravest"))
