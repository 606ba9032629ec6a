"""Honeytokens per session: placeholders, first planting, injection into messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import spans, splice

PLACEHOLDER = r"\{\{CREDENTIAL:([A-Za-z0-9_.-]+):([A-Za-z0-9_.-]+)\}\}"


def extract_placeholders(turns: DataFrame) -> DataFrame:
    """``(trace_id, session_id, turn_index, message, pos, slot_name, credential_type)`` in order."""
    each = turns.select("trace_id", "session_id", "turn_index", F.posexplode("messages").alias("message", "m"))
    found = each.select("trace_id", "session_id", "turn_index", "message", F.posexplode(spans(F.col("m.content"), PLACEHOLDER)).alias("pos", "s"))
    return found.select("trace_id", "session_id", "turn_index", "message", "pos", F.regexp_extract("s.hit", PLACEHOLDER, 1).alias("slot_name"), F.regexp_extract("s.hit", PLACEHOLDER, 2).alias("credential_type"))


def hash_token(salt: str) -> Column:
    """``sk-hny-`` and 32 base-62 characters from (salt, session, slot, type); a database URI for that type."""
    seed = F.concat_ws("|", F.lit(salt), "session_id", "slot_name", "credential_type")
    digest = F.sha2(seed, 256)
    letters = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.substring(F.lit(letters), (F.conv(F.substring(digest, i * 2 + 1, 2), 16, 10).cast("int") % 62 + 1).cast("int"), F.lit(1))), "")
    uri = F.concat(F.lit("postgresql://hny_"), F.substring(digest, 1, 8), F.lit(":"), F.substring(digest, 9, 24), F.lit("@db.invalid:5432/app"))
    return F.when(F.col("credential_type").isin("database_uri", "postgres", "database"), uri).otherwise(F.concat(F.lit("sk-hny-"), body))


def plant(placeholders: DataFrame, value: Column | None = None, salt: str = "canary") -> DataFrame:
    """One token per session and slot; its first use fixes type, value and turn.

    ``value`` is a Column over ``session_id, slot_name, credential_type``, by default :func:`hash_token`.
    """
    first = F.row_number().over(Window.partitionBy("session_id", "slot_name").orderBy("turn_index", "message", "pos"))
    one = placeholders.withColumn("__r", first).where("__r = 1").withColumn("value", hash_token(salt) if value is None else value)
    safe = lambda c: F.regexp_replace(c, "[^A-Za-z0-9_-]", "_")
    return one.select("session_id", "slot_name", "credential_type", F.concat(F.lit("hny_"), safe("session_id"), F.lit("_"), safe("slot_name")).alias("canary_id"), "value", F.sha2("value", 256).alias("sha256"), F.lit("ledger").alias("source"), F.col("turn_index").alias("turn_planted"))


def inject(turns: DataFrame, ledger: DataFrame, secrets: DataFrame | None = None) -> DataFrame:
    """``turns`` with ``model_messages``, ``audit_messages`` and ``spans``.

    Placeholders become their honeytokens; registered ``secrets(session_id, slot_name, secret)`` become their slot's
    honeytoken. Audit messages name the canary instead. ``spans`` are ``(canary_id, message, start, end)`` of
    the tokens in the model's messages, each once.
    """
    kind = "array<struct<slot_name:string,canary_id:string,value:string>>"
    per = ledger.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("slot_name", "canary_id", "value"))).alias("__l"))
    met = turns.join(per, "session_id", "left").withColumn("__l", F.coalesce("__l", F.array().cast(kind)))
    if secrets is None:
        met = met.withColumn("__s", F.array().cast("array<struct<n:int,secret:string,value:string,canary_id:string>>"))
    else:
        named = secrets.where(F.length("secret") > 0).join(ledger, ["session_id", "slot_name"]).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct(F.length("secret").alias("n"), "secret", "value", "canary_id")), asc=False).alias("__s"))
        met = met.join(named, "session_id", "left").withColumn("__s", F.coalesce("__s", F.array().cast("array<struct<n:int,secret:string,value:string,canary_id:string>>")))

    def written(content, field):
        def edit(s):
            slot = F.regexp_extract(s["hit"], PLACEHOLDER, 1)
            entry = F.get(F.filter("__l", lambda e: e["slot_name"] == slot), F.lit(0))
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.coalesce(entry["value"] if field == "value" else F.concat(F.lit("[canary:"), entry["canary_id"], F.lit("]")), s["hit"]).alias("value"))

        text = splice(content, F.transform(spans(content, PLACEHOLDER), edit))
        return F.aggregate("__s", text, lambda a, s: F.replace(a, s["secret"], s["value"] if field == "value" else F.concat(F.lit("[canary:"), s["canary_id"], F.lit("]"))))

    def rewrite(field):
        return lambda m: F.struct(m["role"].alias("role"), written(m["content"], field).alias("content"))

    out = met
    for name, field in (("model_messages", "value"), ("audit_messages", "id")):
        out = out.withColumn(name, F.transform("messages", rewrite(field)))

    def found(m, i):
        per_token = F.transform("__l", lambda e: F.transform(occurrences(m["content"], e["value"]), lambda s: F.struct(e["canary_id"].alias("canary_id"), i.alias("message"), s.alias("start"), (s + F.length(e["value"])).alias("end"))))
        return F.flatten(per_token)

    return out.withColumn("spans", F.array_distinct(F.flatten(F.transform("model_messages", found)))).drop("__l", "__s")


def occurrences(text: Column, value: Column) -> Column:
    """Starts of the non-overlapping occurrences of a value, in code points."""
    parts = F.split(text, F.concat(F.lit("\\Q"), value, F.lit("\\E")), -1)
    first = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out"))
    step = lambda a, p: F.struct((a["pos"] + F.length(p) + F.length(value)).alias("pos"), F.concat(a["out"], F.array(a["pos"] + F.length(p))).alias("out"))
    return F.aggregate(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), first, step)["out"]
