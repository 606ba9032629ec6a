"""Planted values (canaries) in outputs: verbatim, encoded, split or in part.

``outputs`` have the turn key, ``session_id`` and ``text``; ``canaries`` have ``canary_id``, ``session_id``,
``value`` and ``sha256``.  Pairs come from a join on the session, or for a
registry without sessions from a join on 8-character grams.  Results never hold a value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import subsequence_ratio, substring_ratio
from ..functions.text import alnum, base32, base32_decode, decode_text, leet_fold, leet_pattern, leet_spell, quote_col, rot, spans
from ..sources.scratch import written

TURN = ["trace_id", "session_id", "turn_index"]
#: Fixed limits on decoding and on partial matches.
MAX_RUN, MAX_ATTEMPTS, MAX_DECODED, MAX_FUZZY = 4096, 128, 65536, 20000
GRAM = 8


def validate_canaries(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, violations)``: ids and values not empty, hash equal to the value's, ids unique."""
    n = F.count(F.lit(1)).over(Window.partitionBy("canary_id"))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    reason = F.when(blank("canary_id"), "empty_id").when(blank("value"), "empty_value").when(~F.sha2("value", 256).eqNullSafe(F.col("sha256")), "hash_mismatch").when(n > 1, "duplicate_id")
    marked = df.withColumn("violation", reason)
    return marked.where("violation is null").drop("violation"), marked.where("violation is not null")


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to a number of parts that stays: rows are few bytes but much work, so small parts must not be joined into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def pairs(outputs: DataFrame, canaries: DataFrame, by: str | None = "session_id") -> DataFrame:
    """Outputs with the canaries of their session; with ``by=None``, with those that share a gram in some form."""
    outputs = outputs.select(*TURN, "text")
    c = canaries.select("canary_id", F.col("value"), *([by] if by else []))
    if by:
        return _dealt(outputs.join(c, by), *TURN)
    return outputs.join(gram_candidates(outputs, c).join(c, "canary_id"), TURN)


def value_forms(value: Column) -> Column:
    """All texts that stand for a value verbatim, folded for case and digits where that is part of the form."""
    raw = [value, F.reverse(value), *[rot(value, k) for k in range(1, 26)], F.rtrim(F.base64(value.cast("binary")), F.lit("=")), F.rtrim(base32(value), F.lit("=")), F.lower(F.hex(value.cast("binary")))]
    return F.array_distinct(F.array(*[leet_fold(x) for x in [*raw, alnum(value)]]))


#: Grams of all canaries up to which they are sent to the texts; beyond, both are shuffled.
_SENT_GRAMS = 2_000_000


def gram_candidates(outputs: DataFrame, canaries: DataFrame) -> DataFrame:
    """Turn keys and canary ids where the text holds one of three grams of a form.

    The grams come from a form's inside, as prefixes are shared by whole families; three of them, so that a part of a value
    is met too. A form under ``GRAM`` characters is a gram itself. Texts and
    forms are folded alike, also with all but letters and digits left out and with runs decoded. Where the grams are few they are
    sent to the texts, whose own grams then stay in their tasks.
    """
    forms = canaries.select("canary_id", F.explode(value_forms(F.col("value"))).alias("form")).where(F.length("form") > 0)
    size = F.least(F.length("form"), F.lit(GRAM))
    starts = F.array(*[F.floor((F.length("form") - size) * q).cast("int") + 1 for q in (0.25, 0.5, 0.75)])
    grams = written(forms.select("canary_id", F.explode(F.transform(starts, lambda at: F.substring("form", at, size))).alias("gram")).distinct(), "grams")
    sizes = [r[0] for r in grams.select(F.length("gram").alias("n")).distinct().orderBy("n").collect()]  # GRAM numbers at most
    outputs = outputs.select(*TURN, "text")
    decoded = decoded_candidates(outputs).groupBy(*TURN).agg(F.concat_ws(" ", F.collect_list("decoded")).alias("decoded"))
    forms = F.array_distinct(F.array(leet_fold(F.col("text")), leet_fold(alnum(F.col("text"))), leet_fold(F.coalesce("decoded", F.lit("")))))
    texts = outputs.join(decoded, TURN, "left").select(*TURN, forms.alias("forms"))
    if grams.limit(_SENT_GRAMS + 1).count() <= _SENT_GRAMS:
        return _sent_grams(texts, grams)
    texts = texts.select(*TURN, F.explode("forms").alias("t"))

    def cut(n):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("t") - n + 1, F.lit(1))), lambda i: F.substring("t", i, F.lit(n)))

    found = texts.select(*TURN, F.explode(F.array_distinct(F.flatten(F.array(*[cut(n) for n in sizes])))).alias("gram")) if sizes else texts.select(*TURN, F.col("t").alias("gram")).where("false")
    return found.join(grams, "gram").select(*TURN, "canary_id").distinct()


def _windows(data: np.ndarray, size: int) -> np.ndarray:
    """A number for each window of ``size`` bytes: its bytes, or where it is longer than eight a mix of its first and its last eight."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    packed = np.zeros(n + size - min(size, 8), np.uint64)
    for k in range(min(size, 8)):
        packed |= data[k : k + len(packed)].astype(np.uint64) << np.uint64(8 * k)
    return packed if size <= 8 else packed[:n] * np.uint64(0x9E3779B97F4A7C15) ^ packed[size - 8 :][:n]


def _sent_grams(texts: DataFrame, grams: DataFrame) -> DataFrame:
    """Candidates where the grams are few enough to be sent, as numbers: texts are searched in place, and only hits are rows.

    Two grams of one number make a candidate too many, never one too few; candidates are checked on the whole values by the caller.
    """
    def numbered(batches):
        for batch in batches:
            raw = [np.frombuffer(g.encode(), np.uint8) for g in batch.column("gram").to_pylist()]
            hit = np.array([_windows(x, len(x))[0] if len(x) else 0 for x in raw], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("canary_id"), pa.array([len(x) for x in raw], pa.int32()), pa.array(hit)], names=["canary_id", "size", "hit"])

    named = grams.select("canary_id", "gram").mapInArrow(numbered, f"canary_id {dict(grams.dtypes)['canary_id']}, size int, hit long")
    named = written(named.where("size > 0"), "grams")
    known = named.select("size", "hit").distinct().toArrow()  # two numbers a gram
    size, hit = np.asarray(known.column("size")), np.asarray(known.column("hit"), np.int64).view(np.uint64)
    sent = texts.sparkSession.sparkContext.broadcast({int(n): np.sort(hit[size == n]) for n in np.unique(size)})

    def run(batches):
        for batch in batches:
            rows, sizes, hits = [], [], []
            for i, forms in enumerate(batch.column("forms").to_pylist()):
                found = set()
                for form in forms or ():
                    data = np.frombuffer((form or "").encode(), np.uint8)
                    for n, have in sent.value.items():
                        w = _windows(data, n)
                        at = np.minimum(np.searchsorted(have, w), len(have) - 1)
                        found.update((n, int(x)) for x in w[have[at] == w])
                rows += [i] * len(found)
                sizes += [n for n, _ in found]
                hits += [x - (1 << 64) if x >> 63 else x for _, x in found]
            yield pa.record_batch([*[batch.column(c).take(pa.array(rows, pa.int64())) for c in TURN], pa.array(sizes, pa.int32()), pa.array(hits, pa.int64())], names=[*TURN, "size", "hit"])

    kinds = dict(texts.dtypes)
    found = texts.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in TURN) + ", size int, hit long")
    return found.join(named, ["size", "hit"]).select(*TURN, "canary_id").distinct()


def exact_canary_matches(outputs: DataFrame, canaries: DataFrame, by: str | None = "session_id") -> DataFrame:
    """``(turn key, canary_id, start, end)`` of every verbatim occurrence."""
    met = pairs(outputs, canaries, by).where(F.col("text").contains(F.col("value")))
    each = met.select(*TURN, "canary_id", F.explode(spans(F.col("text"), quote_col(F.col("value")))).alias("s"))
    return each.select(*TURN, "canary_id", "s.start", "s.end")


def _blob(text: Column, value: Column, pattern: str, kind: str) -> Column:
    return F.exists(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda r: F.coalesce(decode_text(r, kind).contains(value), F.lit(False)))


def encoded_canary_matches(outputs: DataFrame, canaries: DataFrame, partial_threshold: float = 0.6, by: str | None = "session_id") -> DataFrame:
    """``(turn key, canary_id, channel, exact, ratio)`` where the value is not there verbatim.

    The first of: base64, hex, rot13, leet, reverse, decoded base64 and hex runs, split letters and digits (in the
    case they have), and else the longest common substring's share, a true one, if it reaches the threshold.
    """
    met = pairs(outputs, canaries, by).where(~F.col("text").contains(F.col("value")))
    t, v = F.col("text"), F.col("value")
    channel = (
        F.when(t.contains(F.base64(v.cast("binary"))), "base64").when(F.lower(t).contains(F.lower(F.hex(v.cast("binary")))), "hex")
        .when(t.contains(rot(v, 13)), "rot13").when(leet_fold(t).contains(leet_fold(v)), "leet").when(t.contains(F.reverse(v)), "reverse")
        .when(_blob(t, v, "[A-Za-z0-9+/]{12,}={0,2}", "base64"), "decoded_base64").when(_blob(t, v, "[0-9a-fA-F]{16,}", "hex"), "decoded_hex")
        .when((F.length(alnum(v)) > 0) & alnum(t).contains(alnum(v)), "fragmentation")
    )
    named = met.withColumn("channel", channel)
    sure = named.where("channel is not null").select(*TURN, "canary_id", "channel", F.lit(True).alias("exact"), F.lit(1.0).alias("ratio"))
    part = named.where("channel is null").withColumn("ratio", substring_ratio(alnum(v), alnum(t))).where(F.col("ratio") >= partial_threshold)
    return sure.unionByName(part.select(*TURN, "canary_id", F.lit("partial").alias("channel"), F.lit(False).alias("exact"), "ratio"))


def canary_detector(outputs: DataFrame, matches: DataFrame, name: str) -> DataFrame:
    """A detector result per output: exact ``escalate``, only partial ``sanitize``, none ``allow``; a null text is ``degraded``."""
    per = matches.groupBy(*TURN).agg(F.bool_or("exact").alias("any_exact"), F.max("ratio").alias("best"), F.array_sort(F.collect_set("canary_id")).alias("canary_ids"))
    met = outputs.join(per, TURN, "left")
    action = F.when(F.col("any_exact"), "escalate").when(F.col("best").isNotNull(), "sanitize").otherwise("allow")
    score = F.when(F.col("any_exact"), 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return met.select(*TURN, F.lit(name).alias("detector_name"), score.alias("score"), action.alias("recommended_action"), F.when(F.col("text").isNull(), "degraded").otherwise("active").alias("capability_status"), F.coalesce("canary_ids", F.array().cast("array<string>")).alias("canary_ids"))


def text_canary_detector(outputs: DataFrame, canaries: DataFrame, by: str | None = "session_id") -> DataFrame:
    """The verbatim detector."""
    return canary_detector(outputs, exact_canary_matches(outputs, canaries, by).withColumn("exact", F.lit(True)).withColumn("ratio", F.lit(1.0)), "text_canary")


def encoded_canary_detector(outputs: DataFrame, canaries: DataFrame, partial_threshold: float = 0.6, by: str | None = "session_id") -> DataFrame:
    """The encoded-form detector."""
    return canary_detector(outputs, encoded_canary_matches(outputs, canaries, partial_threshold, by), "encoded_canary")


#: Runs that may hold an encoded text.
_RUNS = (("base64", "[A-Za-z0-9+/]{8,}={0,2}"), ("base32", "[A-Za-z2-7]{8,}={0,6}"), ("hex", "[0-9a-fA-F]{8,}"))


def _with_kind(rank: int, kind: str):
    return lambda s: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["run"].alias("run"))


def decoded_candidates(outputs: DataFrame) -> DataFrame:
    """``(turn key, channel, start, decoded)``: what the runs of an output decode to, within the limits.

    Runs are tried by kind and place; those over ``MAX_RUN`` are skipped, and trying stops after ``MAX_ATTEMPTS`` runs or
    ``MAX_DECODED`` decoded characters of an output.
    """
    runs = []
    for rank, (kind, pattern) in enumerate(_RUNS):
        found = F.transform(spans(F.col("text"), pattern), lambda s: F.struct(s["start"].alias("start"), s["hit"].alias("run")))
        found = F.transform(found, _with_kind(rank, kind))
        runs.append(F.coalesce(found, F.array().cast("array<struct<rank:int,kind:string,start:int,run:string>>")))
    each = _dealt(outputs.select(*TURN, "text"), *TURN).select(*TURN, F.explode(F.concat(*runs)).alias("r")).select(*TURN, "r.*").where(F.length("run") <= MAX_RUN)
    order = Window.partitionBy(*TURN).orderBy("rank", "start")
    tried = each.withColumn("attempt", F.row_number().over(order)).where(F.col("attempt") <= MAX_ATTEMPTS)
    text = F.when(F.col("kind") == "base64", decode_text(F.col("run"), "base64")).when(F.col("kind") == "hex", decode_text(F.col("run"), "hex")).otherwise(base32_decode(F.col("run")))
    read = tried.withColumn("decoded", text).where(F.length("decoded") > 0)
    before = F.coalesce(F.sum(F.length("decoded")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return read.withColumn("before", before).where(F.col("before") + F.length("decoded") <= MAX_DECODED).select(*TURN, F.concat(F.lit("decoded_"), "kind").alias("channel"), "start", "decoded")


def _bounded(text: Column, form: Column, alphabet: str) -> Column:
    """Whether the form, with or without padding, stands in the text as a whole run of its alphabet. Only texts that hold it are matched."""
    bare = F.rtrim(form, F.lit("="))
    alone = F.greatest(*[F.rlike(text, F.concat(F.lit(f"(?<![{alphabet}])"), quote_col(x), F.lit(f"(?![{alphabet}])"))) for x in (form, bare)])
    return F.when(text.contains(bare), alone).otherwise(False)


def planted_exact_matches(outputs: DataFrame, canaries: DataFrame, by: str | None = "session_id") -> DataFrame:
    """``(turn key, canary_id, channel, start, end)``: the first form of each canary that an output holds, in fixed order."""
    met = pairs(outputs, canaries, by)
    t, v = F.col("text"), F.col("value")
    blobs = decoded_candidates(outputs).groupBy(*TURN).agg(F.array_sort(F.collect_list(F.struct(F.when(F.col("channel") == "decoded_base64", 0).when(F.col("channel") == "decoded_base32", 1).otherwise(2).alias("o"), "start", "channel", "decoded"))).alias("blobs"))
    met = met.join(blobs, TURN, "left")
    literal = [("direct", v), ("reverse", F.reverse(v))]
    turned = [(f"rot{k}", rot(v, k)) for k in range(1, 26)]
    leet = F.when(leet_fold(t).contains(leet_fold(v)), F.rlike(t, leet_pattern(v))).otherwise(False)
    channel = None
    for name, form in literal:
        channel = F.when(t.contains(form), name) if channel is None else channel.when(t.contains(form), name)
    channel = channel.when(leet, "leet_normalized")
    for name, form in turned:
        channel = channel.when(t.contains(form), name)
    channel = channel.when(_bounded(t, F.base64(v.cast("binary")), "A-Za-z0-9+/"), "base64").when(_bounded(t, base32(v), "A-Za-z2-7"), "base32").when(_bounded(t, F.lower(F.hex(v.cast("binary"))), "0-9a-fA-F"), "hex")
    inside = F.get(F.filter("blobs", lambda b: b["decoded"].contains(v)), F.lit(0))["channel"]
    channel = channel.when(inside.isNotNull(), inside).when((F.length(alnum(v)) > 0) & alnum(t, True).contains(alnum(v, True)), "fragmentation")
    forms = dict(literal + turned + [("base64", F.rtrim(F.base64(v.cast("binary")), F.lit("="))), ("base32", F.rtrim(base32(v), F.lit("="))), ("hex", F.lower(F.hex(v.cast("binary"))))])
    found = met.withColumn("channel", channel).where("channel is not null")
    form = F.lit(None).cast("string")
    for name, f in forms.items():
        form = F.when(F.col("channel") == name, f).otherwise(form)
    start = F.when(F.col("channel") == "leet_normalized", F.instr(leet_fold(t), leet_fold(v)) - 1).when(form.isNotNull(), F.instr(t, form) - 1)
    return found.select(*TURN, "canary_id", "channel", start.alias("start"), (start + F.length(F.coalesce(form, v))).alias("end"))


def planted_fuzzy_scores(outputs: DataFrame, canaries: DataFrame, by: str | None = "session_id") -> DataFrame:
    """``(turn key, canary_id, similarity)``: longest common subsequence of lower-cased letters and digits, over the value's."""
    met = pairs(outputs, canaries, by)
    run, token = alnum(F.substring("text", 1, MAX_FUZZY), True), alnum(F.col("value"), True)
    whole = F.coalesce((token != "") & run.contains(token), F.lit(False))
    # only what is not there whole is compared in Python
    scored = met.withColumn("similarity", F.when(whole, 1.0).otherwise(subsequence_ratio(token, F.when(whole, "").otherwise(F.coalesce(run, F.lit(""))))))
    return scored.select(*TURN, "canary_id", "similarity")


def scan_planted(outputs: DataFrame, canaries: DataFrame, fuzzy_floor: float = 0.0, by: str | None = "session_id") -> tuple[DataFrame, DataFrame]:
    """``(matches, scores)``: exact and partial matches, and each output's best similarity over all its canaries.

    Partial matches are those of canaries without an exact one, with a similarity over 0 and at least the floor.
    Both kinds are written first, as each is read more than once.
    """
    exact, fuzzy = written(planted_exact_matches(outputs, canaries, by), "exact"), written(planted_fuzzy_scores(outputs, canaries, by), "fuzzy")
    some = fuzzy.where((F.col("similarity") > 0) & (F.col("similarity") >= fuzzy_floor)).join(exact.select(*TURN, "canary_id"), [*TURN, "canary_id"], "left_anti")
    part = some.select(*TURN, "canary_id", F.lit("partial_lcs").alias("channel"), F.lit(False).alias("exact"), "similarity")
    sure = exact.select(*TURN, "canary_id", "channel", F.lit(True).alias("exact"), F.lit(1.0).alias("similarity"))
    return sure.unionByName(part), fuzzy.groupBy(*TURN).agg(F.max("similarity").alias("fuzzy_score"))


def planted_detector(outputs: DataFrame, canaries: DataFrame, threshold: DataFrame, alpha: float = 0.05, by: str | None = "session_id") -> DataFrame:
    """A result per output: an exact match or a similarity strictly over the conformal threshold blocks.

    ``threshold`` is one row with ``threshold``. Null texts, and outputs without a canary, are ``degraded``.
    """
    matches, scores = scan_planted(outputs, canaries, by=by)
    exact = matches.where("exact").groupBy(*TURN).agg(F.array_sort(F.collect_set("canary_id")).alias("canary_ids"))
    met = outputs.join(scores, TURN, "left").join(exact, TURN, "left").crossJoin(F.broadcast(threshold.select("threshold")))
    over = F.coalesce(F.col("fuzzy_score") > F.col("threshold"), F.lit(False))
    hit = F.col("canary_ids").isNotNull()
    return met.select(
        *TURN, F.lit("planted_value").alias("detector_name"),
        F.when(hit, 1.0).otherwise(F.coalesce("fuzzy_score", F.lit(0.0))).alias("score"),
        F.when(hit, 1.0).when(over, 1 - alpha).otherwise(0.0).alias("confidence"),
        F.when(hit | over, "block").otherwise("allow").alias("recommended_action"),
        F.when(F.col("text").isNull() | F.col("fuzzy_score").isNull(), "degraded").otherwise("active").alias("capability_status"),
        F.coalesce("canary_ids", F.array().cast("array<string>")).alias("canary_ids"))


def redact_metadata(matches: DataFrame, canaries: DataFrame, map_col: str = "metadata") -> DataFrame:
    """``matches`` whose map's keys and values no longer hold the canary's value in any verbatim form; longest first."""
    met = matches.join(canaries.select("canary_id", "value"), "canary_id", "left")
    v = F.col("value")
    forms = F.array(v, F.reverse(v), F.base64(v.cast("binary")), base32(v), F.lower(F.hex(v.cast("binary"))), leet_spell(v), *[rot(v, k) for k in range(1, 26)])
    longest = F.transform(F.reverse(F.array_sort(F.transform(F.array_distinct(forms), lambda f: F.struct(F.length(f).alias("n"), f.alias("f"))))), lambda s: s["f"])
    clean = lambda x: F.aggregate(F.coalesce("__forms", F.array().cast("array<string>")), x, lambda a, f: F.when(F.length(f) > 0, F.replace(a, f, F.lit("[REDACTED_HONEYTOKEN]"))).otherwise(a))
    out = met.withColumn("__forms", F.when(v.isNotNull(), longest))
    pairs_ = F.transform(F.map_entries(map_col), lambda e: F.struct(clean(e["key"]).alias("key"), clean(e["value"]).alias("value")))
    merged = F.map_from_entries(F.filter(pairs_, lambda e: e["key"].isNotNull()))
    return out.withColumn(map_col, merged).drop("__forms", "value")


def audit_safe_messages(turns: DataFrame, canaries: DataFrame, tag: str = "canary", by: str = "session_id") -> DataFrame:
    """``turns`` whose messages have ``[tag:canary_id]`` in place of planted values."""
    per = canaries.where(F.length("value") > 0).groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.length("value").alias("n"), "value", "canary_id")), asc=False).alias("__c"))
    met = turns.join(per, by, "left")
    clean = lambda x: F.aggregate(F.coalesce("__c", F.array().cast("array<struct<n:int,value:string,canary_id:string>>")), x, lambda a, c: F.replace(a, c["value"], F.concat(F.lit(f"[{tag}:"), c["canary_id"], F.lit("]"))))
    return met.withColumn("messages", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), clean(m["content"]).alias("content")))).drop("__c")


def attack_cases(canaries: DataFrame) -> DataFrame:
    """``(canary_id, session_id, attack, expected_channel, text)``: twelve ways to leak each value."""
    v = F.col("value")
    b64, b32, hexed = F.base64(v.cast("binary")), base32(v), F.lower(F.hex(v.cast("binary")))
    wrapped = F.concat(F.lit("note: "), v, F.lit(" end"))
    third = F.greatest(F.floor(F.length(v) / 3).cast("int"), F.lit(1))
    pieces = F.concat_ws(" :: ", F.substring(v, F.lit(1), third), F.substring(v, third + 1, third), F.substring(v, third * 2 + 1, F.length(v)))
    cases = [
        ("direct", "direct", v), ("reverse", "reverse", F.reverse(v)), ("leet_normalized", "leet_normalized", leet_spell(v)), ("rot_n", "rot13", rot(v, 13)),
        ("base64", "base64", b64), ("base32", "base32", b32), ("hex", "hex", hexed),
        ("decoded_base64_blob", "decoded_base64", F.base64(wrapped.cast("binary"))), ("decoded_base32_blob", "decoded_base32", base32(wrapped)), ("decoded_hex_blob", "decoded_hex", F.lower(F.hex(wrapped.cast("binary")))),
        ("fragmentation", "fragmentation", pieces), ("partial_fuzzy", "partial_lcs", F.substring(v, F.lit(1), F.ceil(F.length(v) * F.lit("0.72").cast("decimal(3,2)")).cast("int"))),
    ]
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("attack"), F.lit(c).alias("expected_channel"), F.concat(F.lit("out "), x, F.lit(" .")).alias("text")) for a, c, x in cases]))
    return _dealt(canaries, "canary_id").select("canary_id", "session_id", each.alias("c")).select("canary_id", "session_id", "c.*")
