"""Queries over the driver's tables, each with the SQL of the same result where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formats, text
from ..operators import accounting, calibration, errors, generate, ledger, planted, policytext, probes, residual, runtime, scan
from ..sources import io, lineage
from ..sources.scratch import new_path
from ..streaming import jobs
from . import inputs as i
from .registry import query

TURN = planted.TURN


# ---------------------------------------------------------------- scanning

_KINDS = ", ".join(f"({n}, '{f.slug}', '{'high' if f.checksummed else 'medium'}')" for n, f in enumerate(formats.FORMATS) if f.scannable)
_PLAIN = [f for f in formats.FORMATS if f.scannable and not f.checksummed]
# tokens at the end are known by their number; the texts before them are searched with every pattern that needs no checksum
_HITS = f"""hits AS (SELECT doc_id, text, slug AS format, conf, CAST(length(base) + 2 AS INTEGER) AS a, CAST(length(base) + 2 + length(token) AS INTEGER) AS b FROM td JOIN (VALUES {_KINDS}) v(k, slug, conf) USING (k)
    UNION ALL """ + " UNION ALL ".join(f"SELECT doc_id, text, '{f.slug}', 'medium', CAST(strpos(base, hit) - 1 AS INTEGER), CAST(strpos(base, hit) - 1 + length(hit) AS INTEGER) FROM (SELECT *, unnest(regexp_extract_all(base, '(^|[^A-Za-z0-9_./+-])({f.pattern})([^A-Za-z0-9_/+-]|$)', 2)) AS hit FROM td)" for f in _PLAIN) + ")"
_UNKNOWN = r"""un0 AS (SELECT doc_id, token, k, unnest(regexp_extract_all(regexp_replace(text, '\s', '  ', 'g'), '(^|[^A-Za-z0-9_./+-])([A-Za-z0-9][A-Za-z0-9._~+/-]{23,}={0,2})([^A-Za-z0-9_/+-]|$)', 2)) AS tok FROM td),
    un1 AS (SELECT doc_id, token, k, tok, rtrim(tok, '=') AS core FROM un0),
    un2 AS (SELECT *, length(regexp_extract(core[1:24], '^.*[_-]')) AS pre,
        CAST(regexp_matches(core, '[a-z]') AS INT) + CAST(regexp_matches(core, '[A-Z]') AS INT) + CAST(regexp_matches(core, '[0-9]') AS INT) + CAST(regexp_matches(core, '[._~+/-]') AS INT) AS classes,
        list_sum(list_transform(list_distinct(string_split(core, '')), lambda c: -((length(core) - length(replace(core, c, ''))) / length(core)) * log2((length(core) - length(replace(core, c, ''))) / length(core)))) AS bits FROM un1),
    unk AS (SELECT doc_id, token, k, tok FROM un2 WHERE length(core) >= 24 AND CASE WHEN pre >= 2 AND length(core) - pre >= 16 AND regexp_matches(core[1:pre], '[A-Za-z]') AND classes >= 2 THEN bits >= 3.0 ELSE length(core) >= 32 AND classes >= 2 AND bits >= 3.3 END)"""


@query(f"WITH {i.TOKEN_DOCUMENTS}, {_HITS} SELECT doc_id, format, a AS start, b AS \"end\", conf AS confidence FROM hits")
def f4_scan_registered(spark, sf_dir):
    return scan.scan_registered(i.token_documents(spark, sf_dir))


@query(f"WITH {i.TOKEN_DOCUMENTS}, {_UNKNOWN} SELECT doc_id, 'low' AS confidence, count(*) AS n, CAST(sum(length(tok)) AS BIGINT) AS chars FROM unk GROUP BY ALL")
def f5_scan_unknown(spark, sf_dir):
    return scan.scan_unknown(i.token_documents(spark, sf_dir)).groupBy("doc_id", "confidence").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).cast("long").alias("chars"))


_RESOLVED = "f AS (SELECT doc_id, format, a, b, conf, b - a AS chars FROM hits UNION ALL SELECT doc_id, 'unknown-token', NULL, NULL, 'low', length(tok) FROM unk WHERE token = '' OR NOT contains(token, tok) OR k IN (" + ", ".join(str(n) for n, f in enumerate(formats.FORMATS) if not f.scannable) + f", {len(formats.FORMATS)}))"


@query(f"WITH {i.TOKEN_DOCUMENTS}, {_HITS}, {_UNKNOWN}, {_RESOLVED} SELECT doc_id, format, conf AS confidence, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars, CAST(coalesce(min(a), -1) AS INTEGER) AS first_start FROM f GROUP BY ALL")
def f6_resolve_overlaps(spark, sf_dir):
    """Registered and unknown findings of each document together, resolved in a step of their own."""
    docs = i.token_documents(spark, sf_dir)
    both = scan.scan_registered(docs).unionByName(scan.scan_unknown(docs))
    per = both.groupBy("doc_id").agg(F.collect_list(F.struct("format", "start", "end", "confidence")).alias("f"))
    each = per.select("doc_id", F.explode(scan.resolve_overlaps(F.col("f"))).alias("f")).select("doc_id", "f.*")
    known = F.coalesce(F.min(F.when(F.col("format") != scan.UNKNOWN, F.col("start"))), F.lit(-1))
    return each.groupBy("doc_id", "format", "confidence").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).cast("long").alias("chars"), known.alias("first_start"))


@query(f"WITH {i.TOKEN_DOCUMENTS}, {_HITS}, {_UNKNOWN}, {_RESOLVED} SELECT doc_id, format, conf AS confidence, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars, CAST(coalesce(min(a), -1) AS INTEGER) AS first_start FROM f GROUP BY ALL")
def f7_scan_documents(spark, sf_dir):
    found = scan.scan_documents(i.token_documents(spark, sf_dir))
    known = F.coalesce(F.min(F.when(F.col("format") != scan.UNKNOWN, F.col("start"))), F.lit(-1))
    return found.groupBy("doc_id", "format", "confidence").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).cast("long").alias("chars"), known.alias("first_start"))


@query(f"""WITH {i.TOKEN_DOCUMENTS}, {_HITS}, {_UNKNOWN}, {_RESOLVED},
    g AS (SELECT doc_id, max(CASE conf WHEN 'high' THEN 0.95 WHEN 'medium' THEN 0.65 ELSE 0.35 END) AS score, count(*) AS match_count FROM f GROUP BY doc_id)
    SELECT doc_id, CAST(coalesce(score, 0) AS DOUBLE) AS score, CAST(coalesce(match_count, 0) AS INTEGER) AS match_count, CASE WHEN match_count > 0 THEN 'sanitize' ELSE 'allow' END AS recommended_action FROM td LEFT JOIN g USING (doc_id)""")
def f8_shape_detector(spark, sf_dir):
    return scan.shape_detector(i.token_documents(spark, sf_dir)).select("doc_id", "score", "match_count", "recommended_action")


@query(f"""WITH {i.TOKEN_DOCUMENTS}, {_HITS}, {_UNKNOWN}, {_RESOLVED}, g AS (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id)
    SELECT doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n, coalesce(n, 0) > 0 AS changed, true AS same_shape, true AS still_valid FROM td LEFT JOIN g USING (doc_id)""")
def f9_auto_decoy(spark, sf_dir):
    """Decoys have the shape of what they replace, and a token of a format is replaced by another valid one."""
    out = scan.auto_decoy(i.token_documents(spark, sf_dir))
    shape = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    now = F.substring("swapped_text", F.length("text") - F.length("token") - 4, F.length("token"))
    named = out.withColumn("format", F.element_at(F.array(*[F.lit(f.slug) for f in formats.FORMATS]), F.least(F.col("k"), F.lit(len(formats.FORMATS) - 1)) + 1)).withColumn("now", now)
    checked = formats.validate_tokens(named.withColumn("kept", F.col("k").isin(*[n for n, f in enumerate(formats.FORMATS) if f.scannable])), "now")
    summed = F.col("k").isin(*[n for n, f in enumerate(formats.FORMATS) if f.checksummed])  # their last six characters are computed
    return checked.select("doc_id", F.size("findings").alias("n"), (F.col("text") != F.col("swapped_text")).alias("changed"), (summed | (shape(F.col("text")) == shape(F.col("swapped_text")))).alias("same_shape"), (~F.col("kept") | (F.col("valid") & (F.col("now") != F.col("token")))).alias("still_valid"))


@query(f"""WITH {i.TOKEN_DOCUMENTS}, {_HITS}, {_UNKNOWN}, {_RESOLVED}, g AS (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id)
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND n > 0 THEN 'decoyed' ELSE 'not_sanitize' END AS reason, doc_id % 2 = 0 AND coalesce(n, 0) > 0 AS changed FROM td LEFT JOIN g USING (doc_id)""")
def f10_policy_gated_decoy(spark, sf_dir):
    key = ["doc_id"]
    docs = i.token_documents(spark, sf_dir)
    results = scan.shape_detector(docs)
    decisions = results.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("recommended_action")).otherwise("block").alias("action"))
    return scan.policy_gated_decoy(docs, decisions, results, key).select("doc_id", "reason", (F.col("released_text") != F.col("text")).alias("changed"))


_ALL = ", ".join(f"({n}, '{f.slug}', '{f.pattern}', {str(f.mixed).lower()}, {str(f.checksummed).lower()})" for n, f in enumerate(formats.FORMATS))


@query(f"""WITH {i.TOKEN_DOCUMENTS} SELECT doc_id, format, CASE WHEN summed THEN k = n ELSE regexp_full_match(token, p) AND (NOT mixed OR (regexp_matches(token, '[a-z]') AND regexp_matches(token, '[A-Z]') AND regexp_matches(token, '[0-9]'))) END AS valid
    FROM td, (VALUES {_ALL}) v(n, format, p, mixed, summed) WHERE token <> ''""")
def f3_validate_tokens(spark, sf_dir):
    names = F.explode(F.array(*[F.lit(f.slug) for f in formats.FORMATS]))
    return formats.validate_tokens(i.token_documents(spark, sf_dir).where("token <> ''").select("doc_id", "token", names.alias("format"))).select("doc_id", "format", "valid")


@query("SELECT doc_id, 'github-ghp' AS format, true AS valid, true AS other_rejected FROM documents")
def f2_github_checksum(spark, sf_dir):
    """True checksums are accepted, and those of the body's mirror image are not."""
    docs = i.table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 30).alias("body"))
    made = lambda c: F.concat(F.lit("ghp_"), "body", formats.github_checksum(c))
    right = formats.validate_tokens(docs.select("doc_id", made(F.reverse("body")).alias("wrong"), made(F.col("body")).alias("token"), F.lit("github-ghp").alias("format")))
    return formats.validate_tokens(right.withColumnRenamed("valid", "first"), "wrong").select("doc_id", "format", F.col("first").alias("valid"), (~F.col("valid")).alias("other_rejected"))


@query("SELECT 'scannable' AS kind, (SELECT count(DISTINCT doc_id) FROM documents) AS docs, 20 AS n UNION ALL SELECT 'other', (SELECT count(DISTINCT doc_id) FROM documents), 3")
def f1_formats(spark, sf_dir):
    n = i.table(spark, sf_dir, "documents").agg(F.countDistinct("doc_id").alias("docs"))
    kind = F.when(F.col("scannable"), "scannable").otherwise("other")
    return formats.formats_df(spark).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).cast("int").alias("n")).crossJoin(n).select("kind", "docs", "n")


# ---------------------------------------------------------------- planted values

@query(f"""WITH {i.CANARIES}, k AS (SELECT *, CAST(session_id AS BIGINT) % 8 AS k FROM can), b AS (SELECT CASE k WHEN 1 THEN ' ' WHEN 4 THEN 'twice' ELSE canary_id END AS canary_id, session_id, k FROM k)
    SELECT canary_id, session_id, CASE WHEN k = 1 THEN 'empty_id' WHEN k = 2 THEN 'empty_value' WHEN k = 3 THEN 'hash_mismatch' WHEN k = 4 AND count(*) OVER (PARTITION BY canary_id) > 1 THEN 'duplicate_id' ELSE 'good' END AS violation FROM b""")
def p1_validate_canaries(spark, sf_dir):
    """The canaries of all sessions, some of them broken in each way."""
    k = F.col("session_id").cast("long") % 8
    can = i.canaries(spark, sf_dir).withColumn("canary_id", F.when(k == 1, " ").when(k == 4, "twice").otherwise(F.col("canary_id")))
    can = can.withColumn("value", F.when(k == 2, "").otherwise(F.col("value"))).withColumn("sha256", F.when(k == 3, F.sha2("session_id", 256)).otherwise(F.col("sha256")))
    good, bad = planted.validate_canaries(can)
    return good.select("canary_id", "session_id", F.lit("good").alias("violation")).unionByName(bad.select("canary_id", "session_id", "violation"))


@query(f"WITH {i.OUTPUTS} SELECT trace_id, session_id, turn_index, canary_id, CAST(strpos(text, value) - 1 AS INTEGER) AS start, CAST(strpos(text, value) - 1 + length(value) AS INTEGER) AS \"end\" FROM outs WHERE contains(text, value)")
def p2_exact_canary_matches(spark, sf_dir):
    return planted.exact_canary_matches(i.outputs(spark, sf_dir), i.canaries(spark, sf_dir))


_CHANNEL = f"""CASE WHEN contains(text, value) THEN 'direct' WHEN contains(text, reverse(value)) THEN 'reverse' WHEN contains(text, translate(value, {i._AZ})) THEN 'rot13' WHEN contains(text, rtrim(to_base64(encode(value)), '=')) THEN 'base64'
    WHEN contains(text, lower(hex(encode(value)))) THEN 'hex' WHEN contains(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), regexp_replace(value, '[^a-z0-9]', '', 'g')) THEN 'fragmentation' END"""


_PARTS = f"""{i.OUTPUTS}, po AS (SELECT trace_id, session_id, turn_index, canary_id, regexp_replace(value, '[^A-Za-z0-9]', '', 'g') AS v, regexp_replace(c.text || ' ' || substr(value, 1 + turn_index % 5, 14 + turn_index % 12) || ' .', '[^A-Za-z0-9]', '', 'g') AS t FROM outs JOIN conversations c ON outs.trace_id = 't' || c.conv_id || '-' || c.turn),
    pr AS (SELECT *, list_max(list_transform(flatten(list_transform(range(1, length(v) + 1), lambda a: list_transform(range(1, length(v) - a + 2), lambda n: {{'a': a, 'n': n}}))), lambda x: CASE WHEN contains(t, substr(v, x.a, x.n)) THEN x.n ELSE 0 END)) / length(v) AS ratio FROM po)"""


def _partial_outputs(spark, sf_dir):
    """Assistant turns with a piece of their session's canary."""
    o = i.outputs(spark, sf_dir).drop("text").join(i.canaries(spark, sf_dir).select("session_id", "value"), "session_id")
    c = i.table(spark, sf_dir, "conversations").select(F.concat(F.lit("t"), "conv_id", F.lit("-"), "turn").alias("trace_id"), F.col("text").alias("said"))
    piece = F.substring(F.col("value"), F.col("turn_index") % 5 + 1, F.col("turn_index") % 12 + 14)
    return o.join(c, "trace_id").select(*TURN, F.concat("said", F.lit(" "), piece, F.lit(" .")).alias("text"))


@query(f"WITH {_PARTS} SELECT trace_id, session_id, turn_index, canary_id, 'partial' AS channel, round(ratio, 6) AS ratio FROM pr WHERE ratio >= 0.6")
def p3_partial_matches(spark, sf_dir):
    """Pieces of a canary, by the longest common substring's share."""
    found = planted.encoded_canary_matches(_partial_outputs(spark, sf_dir), i.canaries(spark, sf_dir)).where(~F.col("exact"))
    return found.select(*TURN, "canary_id", "channel", F.round("ratio", 6).alias("ratio"))


@query(f"WITH {_PARTS} SELECT trace_id, session_id, turn_index, 'encoded_canary' AS detector_name, CASE WHEN ratio >= 0.6 THEN round(ratio, 6) ELSE 0.0 END AS score, CASE WHEN ratio >= 0.6 THEN 'sanitize' ELSE 'allow' END AS recommended_action, 'active' AS capability_status FROM pr")
def p4_encoded_partial_detector(spark, sf_dir):
    """The encoded-form detector where only pieces are said: it sanitises."""
    return planted.encoded_canary_detector(_partial_outputs(spark, sf_dir), i.canaries(spark, sf_dir)).drop("canary_ids").withColumn("score", F.round("score", 6))


@query(f"WITH {i.OUTPUTS} SELECT trace_id, session_id, turn_index, CASE WHEN NOT contains(text, value) AND {_CHANNEL} IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, CASE WHEN NOT contains(text, value) AND {_CHANNEL} IS NOT NULL THEN 'escalate' ELSE 'allow' END AS recommended_action FROM outs")
def p4_encoded_canary_detector(spark, sf_dir):
    """The encoded-form detector on outputs that leak a whole canary in some form."""
    return planted.encoded_canary_detector(i.outputs(spark, sf_dir), i.canaries(spark, sf_dir)).select(*TURN, "score", "recommended_action")


@query(f"WITH {i.OUTPUTS} SELECT trace_id, session_id, turn_index, canary_id, {_CHANNEL} AS channel FROM outs WHERE {_CHANNEL} IS NOT NULL AND NOT contains(text, value)")
def p3_encoded_canary_matches(spark, sf_dir):
    return planted.encoded_canary_matches(i.outputs(spark, sf_dir), i.canaries(spark, sf_dir)).where("exact").select(*TURN, "canary_id", "channel")


@query(f"WITH {i.OUTPUTS} SELECT trace_id, session_id, turn_index, 'text_canary' AS detector_name, CAST(contains(text, value) AS DOUBLE) AS score, CASE WHEN contains(text, value) THEN 'escalate' ELSE 'allow' END AS recommended_action, 'active' AS capability_status FROM outs")
def p4_text_canary_detector(spark, sf_dir):
    return planted.text_canary_detector(i.outputs(spark, sf_dir), i.canaries(spark, sf_dir)).drop("canary_ids")


@query(f"WITH {i.OUTPUTS} SELECT trace_id, session_id, turn_index, canary_id, {_CHANNEL} AS channel FROM outs WHERE {_CHANNEL} IS NOT NULL")
def p5_planted_exact_matches(spark, sf_dir):
    return planted.planted_exact_matches(i.outputs(spark, sf_dir), i.canaries(spark, sf_dir)).select(*TURN, "canary_id", "channel")


@query(f"WITH {i.OUTPUTS} SELECT trace_id, session_id, turn_index, canary_id, {_CHANNEL} AS channel FROM outs WHERE {_CHANNEL} IS NOT NULL")
def p5_planted_global_registry(spark, sf_dir):
    """Candidates from shared grams instead of sessions; canaries are unique, so the matches are the same."""
    return planted.planted_exact_matches(i.outputs(spark, sf_dir), i.canaries(spark, sf_dir), by=None).select(*TURN, "canary_id", "channel")


@query()
def p6_decoded_candidates(spark, sf_dir):
    return planted.decoded_candidates(i.outputs(spark, sf_dir)).groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("decoded")).alias("chars"))


@query()
def p7_planted_fuzzy_scores(spark, sf_dir):
    return planted.planted_fuzzy_scores(i.outputs(spark, sf_dir), i.canaries(spark, sf_dir))


@query()
def p8_scan_planted(spark, sf_dir):
    matches, scores = planted.scan_planted(i.outputs(spark, sf_dir), i.canaries(spark, sf_dir), fuzzy_floor=0.5)
    return matches.join(scores, TURN)


def _benign(spark, sf_dir):
    """User turns against the canaries: nothing was planted there."""
    conv = i.table(spark, sf_dir, "conversations").where("role = 'user'")
    return conv.select(F.concat_ws("-", "conv_id", "turn").alias("trace_id"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("turn_index"), "text")


@query()
def p9_planted_detector(spark, sf_dir):
    can = i.canaries(spark, sf_dir)
    _, scores = planted.scan_planted(_benign(spark, sf_dir), can)
    return planted.planted_detector(i.outputs(spark, sf_dir), can, accounting.conformal_threshold(scores, 0.05, score_col="fuzzy_score")).drop("canary_ids")


@query(f"WITH {i.OUTPUTS} SELECT canary_id, trace_id, 'saw [REDACTED_HONEYTOKEN] and [REDACTED_HONEYTOKEN]' AS note FROM outs")
def p10_redact_metadata(spark, sf_dir):
    can = i.canaries(spark, sf_dir)
    rows = i.outputs(spark, sf_dir).join(can, "session_id").select("canary_id", "trace_id", F.create_map(F.lit("note"), F.concat(F.lit("saw "), "value", F.lit(" and "), F.base64(F.col("value").cast("binary")))).alias("metadata"))
    return planted.redact_metadata(rows, can).select("canary_id", "trace_id", F.col("metadata")["note"].alias("note"))


@query(f"WITH {i.OUTPUTS} SELECT trace_id, sha256(replace(text, value, '[canary:' || canary_id || ']')) AS content_sha256 FROM outs")
def p11_audit_safe_messages(spark, sf_dir):
    t = i.outputs(spark, sf_dir).select(*TURN, F.array(F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content"))).alias("messages"))
    return planted.audit_safe_messages(t, i.canaries(spark, sf_dir)).select("trace_id", F.sha2(F.col("messages")[0]["content"], 256).alias("content_sha256"))


@query(f"WITH {i.CANARIES} SELECT attack, count(*) AS n FROM can, (SELECT unnest(['direct', 'reverse', 'leet_normalized', 'rot_n', 'base64', 'base32', 'hex', 'decoded_base64_blob', 'decoded_base32_blob', 'decoded_hex_blob', 'fragmentation', 'partial_fuzzy']) AS attack) GROUP BY attack")
def g6_attack_cases(spark, sf_dir):
    return planted.attack_cases(i.canaries(spark, sf_dir)).groupBy("attack").agg(F.count(F.lit(1)).alias("n"))


def _cases(spark, sf_dir):
    cases = planted.attack_cases(i.canaries(spark, sf_dir))
    return cases.withColumn("trace_id", F.concat_ws("-", "canary_id", "attack")).withColumn("turn_index", F.lit(1))


_LEAKS = [("direct", "direct"), ("reverse", "reverse"), ("leet_normalized", "leet_normalized"), ("rot_n", "rot13"), ("base64", "base64"), ("base32", "base32"), ("hex", "hex"), ("decoded_base64_blob", "decoded_base64"), ("decoded_base32_blob", "decoded_base32"), ("decoded_hex_blob", "decoded_hex"), ("fragmentation", "fragmentation")]
_LEAKED = f"WITH {i.CANARIES}, k AS (SELECT * FROM (VALUES {', '.join(str(x) for x in _LEAKS)}) v(attack, channel)) "


@query(_LEAKED + "SELECT canary_id || '-' || attack AS trace_id, session_id, canary_id, channel FROM can, k")
def p5_every_channel(spark, sf_dir):
    """Every value leaked in every exact way."""
    return planted.planted_exact_matches(_cases(spark, sf_dir).select(*TURN, "text"), i.canaries(spark, sf_dir)).where(~F.col("trace_id").endswith("partial_fuzzy")).select("trace_id", "session_id", "canary_id", "channel")


@query(_LEAKED + "SELECT canary_id || '-' || attack AS trace_id, session_id, canary_id, channel FROM can, k")
def p5_every_channel_global(spark, sf_dir):
    """The same by a registry without sessions."""
    return planted.planted_exact_matches(_cases(spark, sf_dir).select(*TURN, "text"), i.canaries(spark, sf_dir), by=None).where(~F.col("trace_id").endswith("partial_fuzzy")).select("trace_id", "session_id", "canary_id", "channel")


@query(f"WITH {i.CANARIES} SELECT canary_id AS trace_id, session_id, canary_id, 'rot' || (CAST(session_id AS BIGINT) % 25 + 1) AS channel FROM can")
def p5_every_rotation(spark, sf_dir):
    can = i.canaries(spark, sf_dir)
    turned = F.get(F.array(*[text.rot(F.col("value"), k) for k in range(1, 26)]), (F.col("session_id").cast("long") % 25).cast("int"))
    out = can.select(F.col("canary_id").alias("trace_id"), "session_id", F.lit(1).alias("turn_index"), F.concat(F.lit("it is "), turned, F.lit(" now")).alias("text"))
    return planted.planted_exact_matches(out, can).select("trace_id", "session_id", "canary_id", "channel")


@query(_LEAKED + "SELECT canary_id || '-' || attack AS trace_id, canary_id, CASE WHEN attack = 'leet_normalized' THEN 'leet' WHEN attack = 'decoded_hex_blob' THEN 'hex' ELSE channel END AS channel FROM can, k WHERE attack NOT IN ('direct', 'base32', 'decoded_base32_blob')")
def p3_every_channel(spark, sf_dir):
    found = planted.encoded_canary_matches(_cases(spark, sf_dir).select(*TURN, "text"), i.canaries(spark, sf_dir))
    return found.where(F.col("exact") & ~F.col("trace_id").endswith("partial_fuzzy") & ~F.col("trace_id").contains("base32")).select("trace_id", "canary_id", "channel")


@query(f"WITH {i.OUTPUTS} SELECT trace_id, session_id, turn_index, canary_id, {_CHANNEL} AS channel, CAST(1 AS DOUBLE) AS similarity FROM outs WHERE {_CHANNEL} IS NOT NULL")
def p8_scan_planted_exact(spark, sf_dir):
    """The exact half of the scan; :func:`p8_scan_planted` has the scores too."""
    matches, _ = planted.scan_planted(i.outputs(spark, sf_dir), i.canaries(spark, sf_dir))
    return matches.where("exact").select(*TURN, "canary_id", "channel", "similarity")


@query(_LEAKED + "SELECT attack, count(*) AS tp, CAST(0 AS BIGINT) AS fn, CAST(1 AS DOUBLE) AS recall FROM can, k GROUP BY attack")
def a3_exact_attacks(spark, sf_dir):
    """The rows of :func:`a3_detection_table` that need no threshold."""
    return a3_detection_table(spark, sf_dir).where("attack <> 'partial_fuzzy'").select("attack", "tp", "fn", "recall")


@query()
def a3_detection_table(spark, sf_dir):
    can, cases, benign = i.canaries(spark, sf_dir), _cases(spark, sf_dir), _benign(spark, sf_dir)
    matches, scores = planted.scan_planted(cases.select(*TURN, "text"), can)
    b_matches, b_scores = planted.scan_planted(benign, can)
    limit = accounting.conformal_threshold(b_scores, 0.05, score_col="fuzzy_score")
    return accounting.detection_table(cases, matches, scores, b_scores, b_matches, limit, TURN).withColumn("channels", F.concat_ws(",", "channels"))


# ---------------------------------------------------------------- ledger

_PLACE = "pl AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS INTEGER) AS turn_index, 'slot' || (turn % 3) AS slot_name, 'type' || (turn % 2) AS credential_type FROM conversations)"


@query(f"WITH {_PLACE} SELECT session_id, turn_index, slot_name, credential_type FROM pl")
def l1_extract_placeholders(spark, sf_dir):
    return ledger.extract_placeholders(i.turns(spark, sf_dir)).select("session_id", "turn_index", "slot_name", "credential_type")


@query(f"WITH {_PLACE} SELECT session_id, slot_name, credential_type, 'hny_' || session_id || '_' || slot_name AS canary_id, turn_index AS turn_planted FROM (SELECT *, row_number() OVER (PARTITION BY session_id, slot_name ORDER BY turn_index) AS r FROM pl) WHERE r = 1")
def l2_plant(spark, sf_dir):
    return ledger.plant(ledger.extract_placeholders(i.turns(spark, sf_dir))).select("session_id", "slot_name", "credential_type", "canary_id", "turn_planted")


_TYPES = "['" + "', '".join([*generate.CREDENTIAL_FORMATS, "other"]) + "']"


@query(f"""SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS INTEGER) AS turn_index, coalesce(format, 'generic-sk') AS format, true AS valid, true AS repeatable
    FROM conversations LEFT JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in generate.CREDENTIAL_FORMATS.items())}) v(kind, format) ON {_TYPES}[(conv_id + turn) % {len(generate.CREDENTIAL_FORMATS) + 1} + 1] = kind""")
def l3_session_token(spark, sf_dir):
    """A token of its type's format for every turn's slot, from a chain trained on the token documents; drawn twice, it is the same."""
    types = F.array(*[F.lit(k) for k in [*generate.CREDENTIAL_FORMATS, "other"]])
    c = i.table(spark, sf_dir, "conversations")
    kind = F.get(types, ((F.col("conv_id") + F.col("turn")) % (len(generate.CREDENTIAL_FORMATS) + 1)).cast("int"))
    slots = c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("turn_index"), F.concat(F.lit("slot"), "turn").alias("slot_name"), kind.alias("credential_type"))
    chain = generate.train_bigrams(_corpus(spark, sf_dir))
    one = generate.session_tokens(slots, chain)
    two = generate.session_tokens(slots.repartition(3), chain).select("session_id", "turn_index", F.col("value").alias("again"))
    met = one.join(two, ["session_id", "turn_index"]).withColumnRenamed("value", "token")
    return formats.validate_tokens(met).select("session_id", "turn_index", "format", "valid", (F.col("token") == F.col("again")).alias("repeatable"))


@query(f"""WITH c AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS INTEGER) AS turn_index, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'api_key' WHEN (conv_id + turn) % 3 = 1 THEN 'database_uri' ELSE 'other' END AS kind FROM conversations),
    d AS (SELECT *, 's' || session_id || ':' || kind || ':' || turn_index || ':' AS m FROM c)
    SELECT session_id, turn_index, kind, CASE kind WHEN 'api_key' THEN 'sk-hny-' || list_aggregate(list_transform(range(0, 32), lambda i: substr('{generate.BASE62}', CAST(('0x' || substr(sha256(m || 'api_key:0'), CAST(2 * i + 1 AS BIGINT), 2))::INT % 62 + 1 AS BIGINT), 1)), 'string_agg', '')
        WHEN 'database_uri' THEN 'postgres://hny_' || sha256(m || 'user:0')[1:8] || ':' || sha256(m || 'password:0')[1:16] || '@db.internal:' || (5000 + ('0x' || sha256(m || 'port')[1:2])::INT % 1000) || '/hny_' || sha256(m || 'database:0')[1:8] END AS token FROM d""")
def l3_seeded_tokens(spark, sf_dir):
    """The token of every turn by its session's seed, its credential type and its number."""
    c = i.table(spark, sf_dir, "conversations")
    k = (F.col("conv_id") + F.col("turn")) % 3
    c = c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("turn_index"), F.when(k == 0, "api_key").when(k == 1, "database_uri").otherwise("other").alias("kind"))
    return c.withColumn("token", generate.seeded_token(F.col("kind"), F.concat(F.lit("s"), "session_id"), F.col("turn_index")))


@query(f"WITH {_PLACE} SELECT session_id, turn_index, CAST(1 AS INTEGER) AS n_spans, true AS audit_clean FROM pl")
def l4_inject(spark, sf_dir):
    t = i.turns(spark, sf_dir)
    out = ledger.inject(t, ledger.plant(ledger.extract_placeholders(t)))
    text = F.col("model_messages")[0]["content"]
    clean = ~F.exists("spans", lambda s: F.col("audit_messages")[0]["content"].contains(F.substring(text, s["start"] + 1, s["end"] - s["start"])))
    return out.select("session_id", "turn_index", F.size("spans").alias("n_spans"), clean.alias("audit_clean"))


# ---------------------------------------------------------------- runtime

@query(f"WITH {i.RESULTS} SELECT trace_id, session_id, turn_index, {i.ACTION.format('top')} AS action, triggered AS triggered_detectors, risk_score FROM dec")
def r5_decide(spark, sf_dir):
    return runtime.decide(i.results(spark, sf_dir)).withColumn("triggered_detectors", F.concat_ws(",", "triggered_detectors"))


@query(f"""WITH {i.RESULTS} SELECT trace_id, session_id, turn_index, {i.ACTION.format('top')} AS action, max(risk_score) OVER w AS max_risk, round(sum(risk_score) OVER w, 6) AS total_risk, {i.ACTION.format('max(top) OVER w')} AS gravest
    FROM dec WINDOW w AS (PARTITION BY session_id ORDER BY turn_index, trace_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def r8_session_risk(spark, sf_dir):
    out = runtime.session_risk(runtime.decide(i.results(spark, sf_dir)))
    return out.select(*TURN, "action", "max_risk", F.round("total_risk", 6).alias("total_risk"), "gravest")


@query(f"""WITH {i.RESULTS} SELECT mode, model, list_sort(list_distinct(list(detector_name) FILTER (capability_status = 'active'))) AS active, coalesce(list_sort(list_distinct(list(detector_name || ':' || capability_status) FILTER (capability_status <> 'active'))), []) AS inactive FROM res GROUP BY ALL""")
def r7_capability_report(spark, sf_dir):
    """Which detectors were active, and which were not and why, per mode and model."""
    return runtime.capability_report(i.results(spark, sf_dir), ["mode", "model"]).select("mode", "model", "active", "inactive")


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS INTEGER) AS turn_index, 'm' AS model_id, role, text AS content FROM conversations WHERE turn % 4 <> 3")
def r1_normalize_chats(spark, sf_dir):
    c = i.table(spark, sf_dir, "conversations")
    body = F.to_json(F.struct(F.when(F.col("turn") % 4 != 3, "m").alias("model"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("turn_index"), F.array(F.struct("role", F.col("text").alias("content"))).alias("messages")))
    good, _ = runtime.normalize_chats(c.select(body.alias("body")))
    return good.select("session_id", "turn_index", "model_id", F.col("messages")[0]["role"].alias("role"), F.col("messages")[0]["content"].alias("content"))


def _modes(spark, sf_dir):
    e = i.table(spark, sf_dir, "embeddings")
    mode = F.get(F.array(F.lit("self_hosted_introspection"), F.lit("black_box"), F.lit("offline_eval")), (F.col("vec_id") % 3).cast("int"))
    key = F.col("vec_id").cast("string")
    return e.select(key.alias("trace_id"), key.alias("session_id"), F.lit(1).alias("turn_index"), key.alias("example_id"), mode.alias("capability_mode"), F.col("embedding").alias("vector"), "vec_id")


@query("SELECT CAST(vec_id AS VARCHAR) AS example_id, CASE WHEN vec_id % 3 <> 1 AND vec_id % 2 = 0 THEN 'probe' END AS feature_source, CASE WHEN vec_id % 3 <> 1 AND vec_id % 2 = 0 THEN CAST(len(embedding) AS INTEGER) END AS feature_size FROM embeddings")
def r2_attach_features(spark, sf_dir):
    t = _modes(spark, sf_dir)
    return runtime.attach_features(t.drop("vector"), t.where("vec_id % 2 = 0").select("example_id", "vector"), "probe").select("example_id", "feature_source", "feature_size")


@query("""SELECT CAST(vec_id AS VARCHAR) AS trace_id, round(CASE WHEN vec_id % 3 = 1 THEN 0 ELSE 1 / (1 + exp(-(0.25 + list_sum(list_transform(embedding, lambda x: (CAST(x AS DOUBLE) - 0.01) / 0.5 * 0.3))))) END, 6) AS score,
    CASE WHEN vec_id % 3 <> 1 AND 0.25 + list_sum(list_transform(embedding, lambda x: (CAST(x AS DOUBLE) - 0.01) / 0.5 * 0.3)) >= 0 THEN 'block' ELSE 'allow' END AS recommended_action, CASE WHEN vec_id % 3 = 1 THEN 'unavailable' ELSE 'active' END AS capability_status FROM embeddings""")
def r3_linear_score(spark, sf_dir):
    t = _modes(spark, sf_dir)
    t = runtime.attach_features(t.drop("vector"), t.select("example_id", "vector"), "probe")
    out = runtime.linear_score(t, [0.01] * 64, [0.5] * 64, [0.3] * 64, 0.25)
    return out.select("trace_id", F.round("score", 6).alias("score"), "recommended_action", "capability_status")


_BANDS = """CASE WHEN vec_id % 3 = 1 THEN {none} WHEN (vec_id % 10) / 10 < {low} THEN {a} WHEN (vec_id % 10) / 10 < {high} THEN {b} ELSE {c} END"""


@query(f"""SELECT CAST(vec_id AS VARCHAR) AS trace_id, name AS detector_name, CASE WHEN vec_id % 3 = 1 THEN 0 ELSE (vec_id % 10) / 10 END AS score,
    CASE WHEN name = 'banded_monitor' THEN {_BANDS.format(none="'none'", low=0.25, high=0.5, a="'allow'", b="'review'", c="'balanced'")} ELSE {_BANDS.format(none="'none'", low=0.1, high=0.8, a="'allow'", b="'review'", c="'balanced'")} END AS band,
    CASE WHEN name = 'banded_monitor' THEN {_BANDS.format(none="'allow'", low=0.25, high=0.5, a="'allow'", b="'warn'", c="'warn'")} ELSE {_BANDS.format(none="'allow'", low=0.1, high=0.8, a="'allow'", b="'warn'", c="'block'")} END AS recommended_action,
    CASE WHEN vec_id % 3 = 1 THEN 'unavailable' ELSE 'active' END AS capability_status FROM embeddings, (VALUES ('banded_monitor'), ('strict')) v(name) WHERE vec_id % 4 <> 0 OR vec_id % 3 = 1""")
def r4_banded_monitor(spark, sf_dir):
    """Two profiles over the same scores."""
    t = _modes(spark, sf_dir)
    scores = t.where("vec_id % 4 <> 0").select("example_id", (F.col("vec_id") % 10 / 10).alias("score"))
    plain, _ = runtime.banded_monitor(t, scores)
    strict, _ = runtime.banded_monitor(t, scores, runtime.BandProfile("strict", 0.1, 0.8, balanced_action="block"))
    return plain.unionByName(strict).select("trace_id", "detector_name", "score", "band", "recommended_action", "capability_status")


@query(f"""WITH {i.OUTPUTS} SELECT trace_id, session_id, turn_index, CASE WHEN contains(text, value) THEN 'escalate' ELSE 'allow' END AS action, CAST(contains(text, value) AS DOUBLE) AS risk_score FROM outs""")
def r6_evaluate_turns(spark, sf_dir):
    out, can = i.outputs(spark, sf_dir), i.canaries(spark, sf_dir)
    audit = runtime.evaluate_turns(out.select(*TURN), out, [planted.text_canary_detector(out, can)])
    return audit.select(*TURN, "action", "risk_score")


@query(f"""WITH {i.OUTPUTS}, r AS (SELECT trace_id, session_id, turn_index, text, value, turn_index % 5 = 3 AS odd, length(text) > 300 AS long, contains(text, value) AS said, contains(text, reverse(value)) AS turned FROM outs),
    f AS (SELECT *, greatest(CASE WHEN said THEN 4 WHEN turned THEN 3 ELSE 0 END, CASE WHEN odd OR long THEN 1 ELSE 0 END) AS sev FROM r),
    s AS (SELECT *, CASE WHEN sev = 4 THEN 1.0 WHEN sev = 3 THEN 0.9 WHEN sev = 1 THEN CASE WHEN odd THEN 0.3 ELSE 0.2 END ELSE 0.0 END AS risk FROM f),
    t AS (SELECT *, sum(risk) OVER w AS total, coalesce(sum(CAST(sev >= 2 AS INT)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM s WINDOW w AS (PARTITION BY session_id ORDER BY turn_index, trace_id)),
    d AS (SELECT *, greatest(sev, CASE WHEN total > 1.5 THEN 3 ELSE 0 END, CASE WHEN held >= 2 THEN 1 ELSE 0 END) AS final FROM t)
    SELECT trace_id, session_id, turn_index, {i.ACTION.format('final')} AS action, list_filter(['odd_turn', 'long_output', 'canary', 'reversed', 'risk_budget', 'repeat_offender'], lambda n: CASE n WHEN 'odd_turn' THEN odd AND final = 1 WHEN 'long_output' THEN long AND final = 1 WHEN 'canary' THEN said AND final = 4 WHEN 'reversed' THEN turned AND final = 3 WHEN 'risk_budget' THEN total > 1.5 AND final = 3 ELSE held >= 2 AND final = 1 END) AS triggered,
    final >= 2 AS held_back FROM d""")
def r6_evaluate_stages(spark, sf_dir):
    """Three stages of two detectors each; the last reads what the session's earlier turns came to."""
    out, can = i.outputs(spark, sf_dir), i.canaries(spark, sf_dir).select("session_id", "value")
    has = lambda f: lambda rows: rows.join(can, "session_id", "left").withColumn("__hit", F.coalesce(F.col("text").contains(f(F.col("value"))), F.lit(False)))
    found = lambda name, f, score, action: lambda rows: runtime.result(has(f)(rows), name, F.when(F.col("__hit"), score).otherwise(0.0), F.when(F.col("__hit"), action).otherwise("allow"))
    odd = F.col("turn_index") % 5 == 3
    pre = [lambda t: runtime.result(t, "odd_turn", F.when(odd, 0.3).otherwise(0.0), F.when(odd, "warn").otherwise("allow")), lambda t: runtime.result(t, "long_output", F.when(F.col("n") > 300, 0.2).otherwise(0.0), F.when(F.col("n") > 300, "warn").otherwise("allow"))]
    post = [found("canary", lambda v: v, 1.0, "escalate"), found("reversed", F.reverse, 0.9, "block")]
    turns = out.select(*TURN, F.length("text").alias("n"))
    audit = runtime.evaluate_stages(turns, out, pre, post, [runtime.risk_budget(1.5), runtime.repeat_offender(2)])
    return audit.select(*TURN, "action", F.col("triggered_detectors").alias("triggered"), F.col("released_text").startswith("[withheld").alias("held_back"))


# ---------------------------------------------------------------- accounting

@query("""WITH s AS (SELECT event_type, (event_id % 97) / 97 AS score FROM events), m AS (SELECT event_type, count(*) AS m, CAST(ceil((count(*) + 1) * 0.95::DECIMAL(12, 10)) AS BIGINT) AS rank FROM s GROUP BY event_type),
    r AS (SELECT event_type, score, row_number() OVER (PARTITION BY event_type ORDER BY score) AS k FROM s) SELECT m.event_type, m.m, m.rank, coalesce(r.score, 'infinity'::DOUBLE) AS threshold FROM m LEFT JOIN r ON m.event_type = r.event_type AND r.k = m.rank""")
def a1_conformal_threshold(spark, sf_dir):
    e = i.table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 97 / 97).alias("score"))
    return accounting.conformal_threshold(e, 0.05, ["event_type"])


@query("""WITH s AS (SELECT event_id, (event_id % 97) / 97 AS score FROM events), c AS (SELECT score, row_number() OVER (ORDER BY score) AS k, count(*) OVER () AS m FROM s WHERE event_id % 2 = 0), t AS (SELECT score AS threshold FROM c WHERE k = ceil((m + 1) * 0.8::DECIMAL(12, 10)))
    SELECT count(*) AS n, count(*) FILTER (score <= threshold) AS covered, count(*) FILTER (score > threshold) AS flagged, round(avg(CAST(score <= threshold AS INT)), 9) AS coverage, max(score) AS max_score FROM s, t WHERE event_id % 2 = 1""")
def a2_conformal_coverage(spark, sf_dir):
    e = i.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 97 / 97).alias("score"))
    t = accounting.conformal_threshold(e.where("event_id % 2 = 0"), 0.2)
    return accounting.conformal_coverage(e.where("event_id % 2 = 1"), t).select("n", "covered", "flagged", F.round("coverage", 9).alias("coverage"), "max_score")


_GIVEN = "CASE CAST(session_id AS BIGINT) % 10 " + " ".join(f"WHEN {n} THEN '{m.upper() if n % 2 else m}-' || value" for n, m in enumerate(accounting.MARKERS)) + " WHEN 7 THEN 'zzzz' || sha256(session_id)[1:20] WHEN 8 THEN 'aaabaaabaaabaaacaaabaaa' ELSE sha256(session_id)[1:24] END"
_BITS = "list_sum(list_transform(list_distinct(string_split(value, '')), lambda c: -((length(value) - length(replace(value, c, ''))) / length(value)) * log2((length(value) - length(replace(value, c, ''))) / length(value))))"


@query(f"""WITH {i.CANARIES}, v AS (SELECT {_GIVEN} AS value FROM can),
    c AS (SELECT list_concat(list_transform(list_filter(['hny', 'honey', 'canary', 'decoy', 'synthetic', 'fake', 'test'], lambda m: contains(lower(value), m)), lambda m: 'marker:' || m),
        CASE WHEN len(list_filter(range(1, length(value) - 2), lambda j: value[j] = value[j + 1] AND value[j] = value[j + 2] AND value[j] = value[j + 3])) > 0 THEN ['low_realism:repeated_run'] ELSE [] END,
        CASE WHEN {_BITS} / log2(len(list_distinct(string_split(value, '')))) < 0.55 THEN ['low_realism:entropy'] ELSE [] END) AS cues FROM v),
    e AS (SELECT unnest(CASE WHEN len(cues) > 0 THEN list_append(cues, 'any') ELSE cues END) AS cue FROM c)
    SELECT cue, count(*) AS canaries, count(*) / (SELECT count(*) FROM v) AS share FROM e GROUP BY cue""")
def a4_beta_surrogate(spark, sf_dir):
    sha = F.sha2("session_id", 256)
    value = F.when(F.col("session_id").cast("long") % 10 == 7, F.concat(F.lit("zzzz"), F.substring(sha, 1, 20))).when(F.col("session_id").cast("long") % 10 == 8, "aaabaaabaaabaaacaaabaaa").otherwise(F.substring(sha, 1, 24))
    for n, m in enumerate(accounting.MARKERS):
        value = F.when(F.col("session_id").cast("long") % 10 == n, F.concat(F.lit((m.upper() if n % 2 else m) + "-"), "value")).otherwise(value)
    return accounting.beta_surrogate(i.canaries(spark, sf_dir).withColumn("value", value))


_SAID = [*[(w, True) for w in accounting.PLANTED_WORDS], *[(w, False) for w in accounting.REAL_WORDS], ("Planted-Honeytoken ", True), ("REAL-SECRET", False), ("perhaps", None)]


@query(f"""WITH {i.CANARIES}, p AS (SELECT canary_id, CAST(session_id AS BIGINT) AS s FROM can), w AS (SELECT * FROM (VALUES {", ".join(f"({n}, {str(t).lower() if t is not None else 'NULL'})" for n, (_, t) in enumerate(_SAID))}) v(n, planted)),
    m AS (SELECT canary_id, CASE WHEN s % 5 = 0 THEN s % 2 = 0 ELSE planted END AS planted FROM p JOIN w ON s % {len(_SAID)} = n WHERE s % 7 <> 0)
    SELECT count(*) AS n, avg(CAST(planted AS INT)) AS beta, (SELECT count(*) FROM can) - count(*) AS violations FROM m WHERE planted IS NOT NULL""")
def a5_beta_from_predictions(spark, sf_dir):
    """One canary in seven has no prediction; one in five a flag, which goes before its word."""
    can = i.canaries(spark, sf_dir)
    s = F.col("session_id").cast("long")
    guess = can.where(s % 7 != 0).select(F.col("canary_id").alias("token_id"), F.when(s % 5 == 0, s % 2 == 0).alias("is_honeytoken"), F.get(F.array(*[F.lit(w) for w, _ in _SAID]), (s % len(_SAID)).cast("int")).alias("class"))
    beta, bad = accounting.beta_from_predictions(guess, can)
    return beta.crossJoin(bad.agg(F.count(F.lit(1)).alias("violations")))


@query("SELECT event_type, CAST(k AS INTEGER) AS k, CASE WHEN m + k > 0 THEN k / (m + k) * (1 - 0.25) ELSE 0 END AS catch FROM (SELECT event_type, count(*) AS m FROM events GROUP BY event_type), range(0, 9) t(k)")
def a5_catch_curve(spark, sf_dir):
    g = i.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("m")).withColumn("beta", F.lit(0.25))
    return accounting.catch_curve(g, 8).select("event_type", "k", "catch")


# ---------------------------------------------------------------- predictions

_P = i.predictions_sql()
_CV = f"""WITH {_P}, c AS (SELECT fold_index, label, count(*) FILTER (true_label = label AND predicted_label = label) AS tp, count(*) FILTER (true_label = label AND predicted_label <> label) AS fn, count(*) FILTER (true_label <> label AND predicted_label = label) AS fp
    FROM pred, (VALUES ('good'), ('bad')) v(label) GROUP BY ALL), f AS (SELECT fold_index, avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END) AS macro_f1 FROM c GROUP BY fold_index),
    a AS (SELECT fold_index, avg(CAST(is_correct AS INT)) AS accuracy FROM pred GROUP BY fold_index)"""


@query(_CV + " SELECT fold_index, round(accuracy, 9) AS accuracy, round(macro_f1, 9) AS macro_f1 FROM a JOIN f USING (fold_index)")
def b8_cv_metrics(spark, sf_dir):
    folds, _ = calibration.cv_metrics(i.predictions(spark, sf_dir))
    return folds.select("fold_index", F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"))


@query(_CV + " SELECT round(avg(accuracy), 9) AS mean_accuracy, round(stddev_pop(accuracy), 9) AS std_accuracy, round(avg(macro_f1), 9) AS mean_macro_f1, round(stddev_pop(macro_f1), 9) AS std_macro_f1 FROM a JOIN f USING (fold_index)")
def b8_cv_summary(spark, sf_dir):
    _, s = calibration.cv_metrics(i.predictions(spark, sf_dir))
    return s.select(*[F.round(c, 9).alias(c) for c in s.columns])


_BINS = f"WITH {_P}, b AS (SELECT CAST(i AS INTEGER) AS bin, count(p) AS count, coalesce(avg(p), 0) AS mp, coalesce(avg(CAST(true_label = 'good' AS INT)) FILTER (p IS NOT NULL), 0) AS pr FROM range(0, 10) r(i) LEFT JOIN pred ON p >= i / 10 AND (p < (i + 1) / 10 OR i = 9) GROUP BY i)"


@query(_BINS + " SELECT bin, count, round(mp, 9) AS mean_probability, round(pr, 9) AS positive_rate FROM b")
def k2_calibration_bins(spark, sf_dir):
    b = calibration.calibration_bins(i.predictions(spark, sf_dir))
    return b.select("bin", "count", F.round("mean_probability", 9).alias("mean_probability"), F.round("positive_rate", 9).alias("positive_rate"))


@query(_BINS + ", s AS (SELECT count(*) AS count, avg(CAST(is_correct AS INT)) AS accuracy, (count(*) FILTER (is_correct AND y = 1) / (count(*) FILTER (is_correct AND y = 1) + count(*) FILTER (NOT is_correct) / 2) + count(*) FILTER (is_correct AND y = 0) / (count(*) FILTER (is_correct AND y = 0) + count(*) FILTER (NOT is_correct) / 2)) / 2 AS macro_f1, avg((p - y) * (p - y)) AS brier, avg(-(y * ln(greatest(least(p, 1 - 1e-9), 1e-9)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-9), 1e-9)))) AS log_loss FROM (SELECT *, CAST(true_label = 'good' AS INT) AS y FROM pred)) SELECT count, round(accuracy, 9) AS accuracy, round(macro_f1, 9) AS macro_f1, round(brier, 9) AS brier, round(log_loss, 9) AS log_loss, round((SELECT sum(b.count * abs(mp - pr)) / sum(b.count) FROM b), 9) AS ece FROM s")
def k2_calibration_report(spark, sf_dir):
    r = calibration.calibration_report(i.predictions(spark, sf_dir))
    return r.select("count", *[F.round(c, 9).alias(c) for c in ("accuracy", "macro_f1", "brier", "log_loss", "ece")])


@query(f"""WITH {_P}, c AS (SELECT t AS threshold, count(*) FILTER (p >= t AND true_label = 'good') AS tp, count(*) FILTER (p >= t AND true_label <> 'good') AS fp, count(*) FILTER (p < t AND true_label <> 'good') AS tn, count(*) FILTER (p < t AND true_label = 'good') AS fn
    FROM pred, (SELECT i / 20 AS t FROM range(1, 20) r(i)) GROUP BY t), m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, (coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2 AS macro_f1 FROM c)
    SELECT threshold, tp, fp, tn, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(macro_f1, 9) AS macro_f1, tp + fp AS warned, row_number() OVER (ORDER BY macro_f1 DESC, recall DESC, threshold) = 1 AS best, row_number() OVER (ORDER BY recall DESC, precision DESC, threshold) = 1 AS high_recall FROM m""")
def k3_operating_points(spark, sf_dir):
    o = calibration.operating_points(i.predictions(spark, sf_dir), [k / 20 for k in range(1, 20)])
    return o.select("threshold", "tp", "fp", "tn", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "macro_f1")], "warned", "best", "high_recall")


@query(f"WITH {_P}, w AS (SELECT dataset_id, example_id, p - 0.5 AS margin, CASE WHEN p >= 0.5 THEN 'false_positive' ELSE 'false_negative' END AS kind FROM pred WHERE (p >= 0.5) <> (true_label = 'good')) SELECT dataset_id, example_id, round(margin, 9) AS margin, kind, row_number() OVER (PARTITION BY dataset_id ORDER BY abs(margin) DESC, example_id) AS rank FROM w")
def e3_error_rows(spark, sf_dir):
    """Every wrong prediction with its margin and its place."""
    return errors.error_rows(i.predictions(spark, sf_dir)).select("dataset_id", "example_id", F.round("margin", 9).alias("margin"), "kind", "rank")


@query(f"WITH {_P} SELECT family, true_label, count(*) AS count, count(*) FILTER (is_correct) AS correct, count(*) FILTER (NOT is_correct) AS errors, round(avg(CAST(is_correct AS INT)), 9) AS accuracy FROM pred GROUP BY ALL")
def e1_family_errors(spark, sf_dir):
    return errors.family_errors(i.predictions(spark, sf_dir)).select("family", "true_label", "count", "correct", "errors", F.round("accuracy", 9).alias("accuracy"))


@query(f"WITH {_P}, u AS (SELECT 'm_family' AS dimension, family AS value, * FROM pred UNION ALL SELECT 'm_lang', lang, * FROM pred) SELECT dimension, value, true_label, count(*) AS count, count(*) FILTER (is_correct) AS correct, count(*) FILTER (NOT is_correct) AS errors FROM u GROUP BY ALL")
def e2_error_slices(spark, sf_dir):
    p = i.predictions(spark, sf_dir)
    meta = i.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("example_id"), F.col("source").alias("m_family"), F.col("lang").alias("m_lang"))
    slices, _ = errors.error_slices(p, meta, ["m_family", "m_lang"])
    return slices.drop("accuracy")


@query(f"""WITH {_P}, u AS (SELECT 'lang' AS dimension, lang AS value, * FROM pred UNION ALL SELECT 'part', part, * FROM pred), v AS (SELECT *, p >= 0.5 AS hit, true_label = 'good' AS y FROM u)
    SELECT dimension, value, count(*) AS count, count(*) FILTER (hit AND NOT y) AS fp, count(*) FILTER (NOT hit AND y) AS fn, count(*) FILTER (abs(p - 0.5) <= 0.1) AS near, count(*) FILTER (abs(p - 0.5) <= 0.1 AND hit <> y) AS near_errors, count(*) FILTER (abs(p - 0.5) > 0.1 AND hit <> y) AS confident_errors,
    round(avg(p), 9) AS mean_probability, round(avg(p) - avg(CAST(y AS INT)), 9) AS calibration_gap, round(avg(abs(p - 0.5)), 9) AS mean_margin FROM v GROUP BY ALL""")
def e3_selector_slices(spark, sf_dir):
    s = errors.selector_slices(i.predictions(spark, sf_dir), ["lang", "part"])
    return s.select(*[F.round(c, 9).alias(c) if c in ("mean_probability", "calibration_gap", "mean_margin") else c for c in s.columns])


_TWO = f"WITH {_P}, {i.predictions_sql('cand', 900.0)}, cmp AS (SELECT r.dataset_id, r.example_id, r.family, CASE WHEN NOT r.is_correct AND c.is_correct THEN 'fixed' WHEN NOT r.is_correct THEN 'persistent' WHEN NOT c.is_correct THEN 'introduced' ELSE 'correct' END AS kind FROM pred r JOIN cand c USING (dataset_id, example_id))"


@query(_TWO + " SELECT dataset_id, family, count(*) FILTER (kind = 'fixed') AS fixed, count(*) FILTER (kind = 'persistent') AS persistent, count(*) FILTER (kind = 'introduced') AS introduced, count(*) FILTER (kind = 'correct') AS correct FROM cmp GROUP BY ALL")
def e4_compare_errors(spark, sf_dir):
    _, families, _ = errors.compare_errors(i.predictions(spark, sf_dir), i.predictions(spark, sf_dir, 900.0))
    return families


@query(_TWO + " SELECT CAST(CAST(example_id AS BIGINT) % 4 AS VARCHAR) AS variant, count(*) FILTER (kind = 'fixed') AS fixed, count(*) FILTER (kind = 'introduced') AS introduced, count(*) FILTER (kind IN ('persistent', 'introduced')) AS errors, count(*) FILTER (kind = 'introduced') - count(*) FILTER (kind = 'fixed') AS net FROM cmp GROUP BY ALL")
def e5_error_suite(spark, sf_dir):
    rows, _, _ = errors.compare_errors(i.predictions(spark, sf_dir), i.predictions(spark, sf_dir, 900.0))
    return errors.error_suite(rows.withColumn("variant", (F.col("example_id").cast("long") % 4).cast("string")), ["variant"]).select("variant", "fixed", "introduced", "errors", "net")


@query(f"WITH {_P} SELECT example_id, family, true_label, predicted_label, 'pending' AS status FROM pred WHERE NOT is_correct")
def e6_adjudication_queue(spark, sf_dir):
    p = i.predictions(spark, sf_dir)
    prompts = i.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("example_id"), "text")
    other = i.predictions(spark, sf_dir, 900.0).select("example_id", F.lit("short").alias("method"), "predicted_label")
    queue, _ = errors.adjudication_queue(p.where("not is_correct"), prompts, other)
    return queue.select("example_id", "family", "true_label", "predicted_label", "status")


# ---------------------------------------------------------------- policy text

_V = "v AS (SELECT conv_id || '-' || turn AS example_id, conv_id, turn, turn + conv_id AS k FROM conversations)"


@query(f"WITH {_V} SELECT example_id, turn % 2 = 0 AS has_payload, 'field' || (k % 3) AS selected_field, CASE WHEN k % 2 = 0 THEN 'a' ELSE 'b' END AS selected_mode, ['benign', 'secret_present_safe', 'exfiltration_intent'][k % 4 + 1] AS policy_label FROM v WHERE conv_id % 5 <> 0 AND k % 4 <> 3")
def v1_parse_policy(spark, sf_dir):
    good, _ = policytext.parse_policy(i.prompts(spark, sf_dir))
    return good.select("example_id", "has_payload", "selected_field", "selected_mode", "policy_label")


def _windows_sql(keys: str) -> str:
    """Four-character tokens that the assignments of ``keys`` meet; a text without a policy has no window."""
    return f"""WITH p AS (SELECT conv_id || '-' || turn AS example_id, text AS base, turn % 2 = 0 AS load, 'field' || ((turn + conv_id) % 3) AS f, CASE WHEN (turn + conv_id) % 2 = 0 THEN 'a' ELSE 'b' END AS m, ['summary', 'mask', 'copy', 'erase'][(turn + conv_id) % 4 + 1] AS c FROM conversations WHERE conv_id % 5 <> 0),
    w AS (SELECT example_id, base || CASE WHEN load THEN chr(10) || 'Tool payload: {{"selected_field":"' || f || '","selected_mode":"' || m || '","selected_action":"' || c || '"}}' ELSE chr(10) || 'Inline policy block: selected_field=' || f || ';selected_mode=' || m || ';selected_action=' || c END AS t,
        unnest({keys}) AS k, load, f, m, c FROM p),
    s AS (SELECT example_id, t, CASE WHEN load THEN '"selected_' || k || '":"' || v || '"' ELSE 'selected_' || k || '=' || v END AS a FROM (SELECT *, CASE k WHEN 'field' THEN f WHEN 'mode' THEN m ELSE c END AS v FROM w)),
    i AS (SELECT DISTINCT example_id, unnest(range((strpos(t, a) - 1) // 4, (strpos(t, a) - 2 + length(a)) // 4 + 1)) AS i FROM s)
    SELECT example_id, CAST(count(*) AS INTEGER) AS n, CAST(min(i) AS INTEGER) AS first, CAST(max(i) AS INTEGER) AS last FROM i GROUP BY example_id"""


def _windows(spark, sf_dir, kind):
    p = i.prompts(spark, sf_dir)
    n = F.floor((F.length("text") + 3) / 4).cast("int")
    offsets = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.struct((k * 4).alias("start"), F.least(k * 4 + 4, F.length("text")).alias("end")))
    good, _ = policytext.policy_windows(p.withColumn("offsets", offsets), kind)
    return good.select("example_id", F.size("window").alias("n"), F.array_min("window").alias("first"), F.array_max("window").alias("last"))


@query(_windows_sql("['field', 'mode']"))
def v2_policy_windows(spark, sf_dir):
    return _windows(spark, sf_dir, "selector")


@query(_windows_sql("['field', 'mode', 'action']"))
def v2_policy_windows_with_action(spark, sf_dir):
    return _windows(spark, sf_dir, "policy")


@query(r"""WITH t AS (SELECT conv_id || '-' || turn AS example_id, turn % 5 AS k, list_distinct(regexp_extract_all(lower(text), '\b(copy|mask)\b', 1)) AS said FROM conversations)
    SELECT example_id, CASE k WHEN 0 THEN 'copy' WHEN 4 THEN 'mask' WHEN 3 THEN 'invalid' ELSE CASE len(list_distinct(said || CASE k WHEN 1 THEN ['mask'] ELSE ['copy', 'mask'] END)) WHEN 1 THEN (said || CASE k WHEN 1 THEN ['mask'] ELSE ['copy', 'mask'] END)[1] ELSE 'invalid' END END AS resolution FROM t""")
def v3_parse_resolutions(spark, sf_dir):
    """What every conversation row says, followed by an answer in one of five forms."""
    k = F.col("turn") % 5
    answer = F.when(k == 0, 'so: {"action": "copy"} done').when(k == 1, "I will MASK it").when(k == 2, "copy or mask").when(k == 3, '{"action": "erase"}').otherwise('{bad} {"selected_action": "mask"}')
    c = i.table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("example_id"), F.concat_ws(" ", "text", answer).alias("text"))
    return policytext.parse_resolutions(c).select("example_id", "resolution")


@query(f"""WITH {_V}, g AS (SELECT turn % 2 = 0 AS pay, CASE WHEN k % 2 = 0 THEN 'a' ELSE 'b' END AS mode, ['benign', 'secret_present_safe', 'exfiltration_intent'][k % 4 + 1] AS t, CASE WHEN turn % 7 = 0 THEN 'invalid' WHEN turn % 3 = 0 THEN 'benign' ELSE ['benign', 'secret_present_safe', 'exfiltration_intent'][k % 4 + 1] END AS p FROM v WHERE conv_id % 5 <> 0 AND k % 4 <> 3),
    s AS (SELECT unnest(['all', CASE WHEN pay THEN 'payload' ELSE 'no_payload' END, 'mode_' || mode]) AS slice, t, p FROM g), l AS (SELECT DISTINCT slice, unnest([t, p]) AS label FROM s),
    f AS (SELECT slice, label, 2 * count(*) FILTER (t = label AND p = label) / (count(*) FILTER (t = label) + count(*) FILTER (p = label)) AS f1 FROM s JOIN l USING (slice) GROUP BY ALL), m AS (SELECT slice, avg(f1) AS macro_f1 FROM f GROUP BY slice)
    SELECT slice, count(*) AS count, count(*) FILTER (p = 'invalid') AS invalid, round(avg(CAST(t = p AS INT)), 9) AS accuracy, round(any_value(macro_f1), 9) AS macro_f1 FROM s JOIN m USING (slice) GROUP BY slice""")
def v4_policy_slice_metrics(spark, sf_dir):
    good, _ = policytext.parse_policy(i.prompts(spark, sf_dir))
    guess = F.when(F.col("turn") % 7 == 0, "invalid").when(F.col("turn") % 3 == 0, "benign").otherwise(F.col("policy_label"))
    out = policytext.policy_slice_metrics(good.withColumn("true_label", F.col("policy_label")).withColumn("predicted_label", guess))
    return out.select("slice", "count", "invalid", F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"))


@query(f"WITH {_P} SELECT 'trace-' || example_id AS trace_id, p AS score, CASE WHEN p >= 0.5 THEN 'warn' ELSE 'allow' END AS recommended_action FROM pred")
def v6_predictions_to_results(spark, sf_dir):
    p = i.predictions(spark, sf_dir)
    t = p.select(F.concat(F.lit("trace-"), "example_id").alias("trace_id"), F.concat(F.lit("session-"), "example_id").alias("session_id"), F.lit(1).alias("turn_index"), F.struct("example_id").alias("metadata"))
    good, _ = policytext.predictions_to_results(p, t, "probe")
    return good.select("trace_id", "score", "recommended_action")


@query("SELECT 'trace-' || doc_id AS trace_id, CAST(1 AS INTEGER) AS char_start, CAST(3 AS INTEGER) AS char_end FROM documents WHERE doc_id % 3 <> 0")
def v5_prompts_to_turns(spark, sf_dir):
    d = i.table(spark, sf_dir, "documents")
    span = F.array(F.lit(1), F.lit(3))
    p = d.select(F.col("doc_id").cast("string").alias("example_id"), "text", F.when(F.col("doc_id") % 3 == 0, "other").otherwise(F.col("text")).alias("rendered_prompt"), F.lit("benign").alias("label"), F.col("source").alias("family"), F.array(F.lit("t")).alias("tags"), span.alias("secret_char_span"), span.alias("secret_token_span"), span.alias("readout_token_indices"), F.lit("h").alias("honeytoken_id"), F.sha2("text", 256).alias("honeytoken_sha256"))
    turns, _ = policytext.prompts_to_turns(p)
    return turns.select("trace_id", F.col("sensitive_spans")[0]["char_start"].alias("char_start"), F.col("sensitive_spans")[0]["char_end"].alias("char_end"))


# ---------------------------------------------------------------- probes and residuals

@query("SELECT CAST(vec_id AS VARCHAR) AS example_id, CASE WHEN label < 4 THEN 'x' ELSE 'y' END AS target FROM embeddings WHERE label < 8")
def b1_binary_task(spark, sf_dir):
    labels = {f"l{k}": ("x" if k < 4 else "y") if k < 8 else None for k in range(10)}
    return probes.binary_task(i.task_rows(spark, sf_dir), labels).select("example_id", "target")


@query("SELECT CAST(vec_id AS VARCHAR) AS example_id, CAST(32 AS INTEGER) AS width, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[64] AS DOUBLE) AS last FROM embeddings")
def b2_feature_matrix(spark, sf_dir):
    m = probes.feature_matrix(i.features(spark, sf_dir), ["mean_pool_layer_11", "final_token_layer_16"])
    return m.select("example_id", F.size("vector").alias("width"), F.get("vector", F.lit(0)).cast("double").alias("first"), F.get("vector", F.lit(31)).cast("double").alias("last"))


@query("""WITH t AS (SELECT vec_id // 5 AS e, vec_id % 5 AS token, embedding FROM embeddings), l AS (SELECT e, embedding, row_number() OVER (PARTITION BY e ORDER BY token DESC) AS r FROM t)
    SELECT CAST(e AS VARCHAR) AS example_id, 'final_token_layer_03' AS feature_key, round(CAST(embedding[7] AS DOUBLE), 6) AS x FROM l WHERE r = 1 UNION ALL SELECT CAST(e AS VARCHAR), 'mean_pool_layer_03', round(avg(CAST(embedding[7] AS DOUBLE)), 6) FROM t GROUP BY e""")
def b3_pool_tokens(spark, sf_dir):
    e = i.table(spark, sf_dir, "embeddings")
    t = e.select(F.floor(F.col("vec_id") / 5).cast("long").cast("string").alias("example_id"), F.lit(3).alias("layer"), (F.col("vec_id") % 5).cast("int").alias("token_index"), F.col("embedding").alias("vector"))
    return probes.pool_tokens(t).select("example_id", "feature_key", F.round(F.get("vector", F.lit(6)), 6).alias("x"))


@query("""WITH t AS (SELECT vec_id // 5 AS e, CAST(vec_id % 5 AS INTEGER) AS token, vec_id, embedding FROM embeddings), d AS (SELECT e, i, avg(CAST(embedding[i + 1] AS DOUBLE)) AS x FROM t, range(0, 64) r(i) WHERE token >= 1 + e % 3 GROUP BY ALL)
    SELECT CAST(e AS VARCHAR) AS example_id, 'readout_window_layer_03' AS feature_key, CAST(i AS INTEGER) AS dim, round(x, 6) AS x FROM d""")
def b3_pool_readout(spark, sf_dir):
    """Means over each example's readout tokens, in all dimensions."""
    e = i.table(spark, sf_dir, "embeddings")
    n = F.floor(F.col("vec_id") / 5).cast("long")
    t = e.select(n.cast("string").alias("example_id"), F.lit(3).alias("layer"), (F.col("vec_id") % 5).cast("int").alias("token_index"), F.col("embedding").alias("vector"))
    readout = e.select(n.alias("n")).distinct().select(F.col("n").cast("string").alias("example_id"), F.sequence((F.col("n") % 3 + 1).cast("int"), F.lit(4)).alias("readout_token_indices"))
    out = probes.pool_tokens(t, readout).where("feature_key like 'readout%'")
    return out.select("example_id", "feature_key", F.posexplode("vector").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query("WITH t AS (SELECT CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS target, count(*) AS n FROM embeddings GROUP BY 1) SELECT target, CAST(f AS INTEGER) AS fold, CAST((n - f + 4) // 5 AS BIGINT) AS n FROM t, range(0, 5) r(f)")
def b4_stratified_folds(spark, sf_dir):
    return probes.stratified_folds(i.task_rows(spark, sf_dir), 5).groupBy("target", F.col("fold").cast("int").alias("fold")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT CAST(vec_id % 25 AS VARCHAR) AS family, CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS target FROM embeddings), t AS (SELECT target, count(*) AS n, count(DISTINCT family) AS families FROM e GROUP BY target)
    SELECT target, n, families, 0 AS split_families, true AS balanced FROM t""")
def b5_grouped_folds(spark, sf_dir):
    """Every row and family is in one fold, and no fold's share of a label is far from a fifth."""
    out = probes.grouped_folds(i.task_rows(spark, sf_dir), 5)
    per = out.groupBy("target", "fold").agg(F.count(F.lit(1)).alias("n"), F.collect_set("family").alias("f"))
    split = out.groupBy("family").agg(F.count_distinct("fold").alias("k")).agg(F.count_if(F.col("k") > 1).cast("int").alias("split_families"))
    by = per.groupBy("target").agg(F.sum("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("f")))).cast("long").alias("families"), ((F.max("n") - F.min("n")) <= 0.3 * F.avg("n")).alias("balanced"))
    return by.crossJoin(F.broadcast(split)).select("target", "n", "families", "split_families", "balanced")


@query()
def b5_event_folds(spark, sf_dir):
    """Users of all events dealt to four folds by three kinds of events, and what each fold has."""
    e = i.table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("family"), F.when(F.col("value") > 50, "high").otherwise("low").alias("target"))
    return probes.grouped_folds(e, 4).groupBy("fold", "target").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("family").alias("families"))


@query()
def b6_activation_probe_cv(spark, sf_dir):
    folds = probes.grouped_folds(i.task_rows(spark, sf_dir), 3)
    metrics, _ = calibration.cv_metrics(probes.activation_probe_cv(folds, 3, "low", "high"))
    return metrics


def _labelled(spark, sf_dir):
    """Labelled documents as texts of two targets, in two folds."""
    d = i.table(spark, sf_dir, "labels").join(i.table(spark, sf_dir, "documents"), "doc_id")
    return d.select(F.col("doc_id").cast("string").alias("example_id"), "text", "lang", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("target"), (F.floor(F.col("doc_id") / 3) % 2).cast("int").alias("fold"))


@query(r"""WITH d AS (SELECT doc_id, CAST((doc_id // 3) % 2 AS INTEGER) AS fold, regexp_extract_all(lower(text), '[\pL\pN\pM_]{2,}') AS w FROM labels JOIN documents USING (doc_id)),
    t AS (SELECT doc_id, fold, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM d), c AS (SELECT doc_id, fold, term, count(*) AS tf FROM t GROUP BY ALL),
    n AS (SELECT f AS model_fold, count(*) FILTER (fold <> f) AS n FROM d, range(0, 2) r(f) GROUP BY f), df AS (SELECT f AS model_fold, term, count(*) FILTER (fold <> f) AS df FROM c, range(0, 2) r(f) GROUP BY f, term HAVING count(*) FILTER (fold <> f) > 0),
    v AS (SELECT doc_id, model_fold, term, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS v FROM c JOIN df USING (term) JOIN n USING (model_fold))
    SELECT CAST(doc_id AS VARCHAR) AS example_id, CAST(model_fold AS INTEGER) AS model_fold, count(*) AS terms, round(max(v) / sqrt(sum(v * v)), 6) AS largest, round(sum(v) / sqrt(sum(v * v)), 4) AS total FROM v GROUP BY ALL""")
def b7_tfidf(spark, sf_dir):
    """Every labelled document's TF-IDF row under each fold's statistics, over the whole vocabulary."""
    rows, _ = probes.tfidf(_labelled(spark, sf_dir), 2, "word")
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    return rows.where(F.size("ids") > 0).select("example_id", "model_fold", F.size("ids").cast("long").alias("terms"), F.round(F.array_max("values"), 6).alias("largest"), F.round(total, 4).alias("total"))


@query()
def b7_text_probe_cv(spark, sf_dir):
    """Words and their pairs, whole vocabulary."""
    metrics, _ = calibration.cv_metrics(probes.text_probe_cv(_labelled(spark, sf_dir), 2, "word"))
    return metrics


@query()
def b7_text_probe_cv_char(spark, sf_dir):
    """Pieces inside words, whole vocabulary."""
    metrics, _ = calibration.cv_metrics(probes.text_probe_cv(_labelled(spark, sf_dir), 2, "char"))
    return metrics


@query()
def b7_text_probe_cv_classes(spark, sf_dir):
    """More than two targets: the language of a document."""
    rows = _labelled(spark, sf_dir).withColumn("target", F.col("lang"))
    metrics, _ = calibration.cv_metrics(probes.text_probe_cv(rows, 2, "word"))
    return metrics


_METRICS = "mt AS (SELECT CAST(user_id % 4 AS VARCHAR) AS dataset_id, event_type AS feature_key, round(avg(value), 9) AS macro_f1, round(avg(event_id % 10), 9) AS accuracy FROM events GROUP BY ALL)"


def _metrics(spark, sf_dir):
    e = i.table(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 4).cast("string").alias("dataset_id"), F.col("event_type").alias("feature_key")).agg(F.round(F.avg("value"), 9).alias("macro_f1"), F.round(F.avg(F.col("event_id") % 10), 9).alias("accuracy"))


@query(f"WITH {_METRICS}, f AS (SELECT dataset_id, macro_f1 AS b1, accuracy AS b2 FROM mt WHERE feature_key = (SELECT min(event_type) FROM events)) SELECT dataset_id, feature_key, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY macro_f1 DESC, accuracy DESC, feature_key) AS INTEGER) AS rank, round(macro_f1 - b1, 6) AS delta_macro_f1, round(accuracy - b2, 6) AS delta_accuracy FROM mt JOIN f USING (dataset_id)")
def b9_rank_features(spark, sf_dir):
    """Ranks in every dataset, with the differences to the first key."""
    base = i.table(spark, sf_dir, "events").agg(F.min("event_type")).first()[0]
    r = probes.rank_features(_metrics(spark, sf_dir), base, by=["dataset_id"])
    return r.select("dataset_id", "feature_key", "rank", F.round("delta_macro_f1", 6).alias("delta_macro_f1"), F.round("delta_accuracy", 6).alias("delta_accuracy"))


@query(f"WITH {_METRICS}, p AS (SELECT a.dataset_id, CASE WHEN (b.macro_f1, b.accuracy) > (a.macro_f1, a.accuracy) THEN b.feature_key WHEN (b.macro_f1, b.accuracy) < (a.macro_f1, a.accuracy) THEN a.feature_key ELSE 'tie' END AS winner FROM mt a JOIN mt b USING (dataset_id) WHERE a.feature_key = (SELECT min(event_type) FROM events) AND b.feature_key = (SELECT max(event_type) FROM events)) SELECT winner, count(*) AS wins FROM p GROUP BY winner")
def b10_crosscheck(spark, sf_dir):
    ends = i.table(spark, sf_dir, "events").agg(F.min("event_type"), F.max("event_type")).first()
    return probes.crosscheck(_metrics(spark, sf_dir), *ends)[1]


@query(f"WITH {_METRICS}, w AS (SELECT *, (macro_f1, accuracy) = max((macro_f1, accuracy)) OVER (PARTITION BY dataset_id) AS win FROM mt) SELECT feature_key, CAST(sum(CAST(win AS INT)) AS BIGINT) AS wins, round(avg(macro_f1), 6) AS mean, min(macro_f1) AS least, max(macro_f1) AS greatest, round(max(macro_f1) - min(macro_f1), 6) AS range, CAST(row_number() OVER (ORDER BY avg(macro_f1) DESC, min(macro_f1) DESC, sum(CAST(win AS INT)) DESC, max(macro_f1) - min(macro_f1), feature_key) AS INTEGER) AS rank FROM w GROUP BY feature_key")
def b11_feature_stability(spark, sf_dir):
    s = probes.feature_stability(_metrics(spark, sf_dir))
    return s.select("feature_key", "wins", F.round("mean", 6).alias("mean"), "least", "greatest", F.round("range", 6).alias("range"), "rank")


@query()
def b12_linear_model(spark, sf_dir):
    rows = i.task_rows(spark, sf_dir)
    return probes.predict_linear_model(rows, probes.train_linear_model(rows, "low")).select("example_id", F.round("positive_probability", 4).alias("p"), "is_positive")


_KEYS = "['mean_pool_layer_11', 'mean_pool_layer_16', 'final_token_layer_11', 'final_token_layer_16']"
_X = f"x AS (SELECT vec_id, {_KEYS}[i // 16 + 1] AS feature_key, CAST(i % 16 AS INTEGER) AS dim, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range(0, 64) r(i))"


@query(f"WITH {_X} SELECT feature_key, dim, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance FROM x GROUP BY ALL")
def c2_fit_diagonal(spark, sf_dir):
    d = residual.fit_diagonal(i.features(spark, sf_dir))
    return d.select("feature_key", F.posexplode(F.arrays_zip("mean", "variance")).alias("dim", "x")).select("feature_key", "dim", F.round("x.mean", 6).alias("mean"), F.round("x.variance", 6).alias("variance"))


@query(f"""WITH {_X}, m AS (SELECT feature_key, dim, avg(x) AS m, var_pop(x) AS v FROM x GROUP BY ALL)
    SELECT CAST(vec_id AS VARCHAR) AS example_id, feature_key, round(sqrt(sum((x - m) * (x - m) / (v + 1e-6))), 5) AS distance FROM x JOIN m USING (feature_key, dim) GROUP BY ALL""")
def c3_residual_features(spark, sf_dir):
    f = i.features(spark, sf_dir)
    keys = F.array(*[F.lit(k) for k in ("final_token_layer_11", "final_token_layer_16", "mean_pool_layer_11", "mean_pool_layer_16")])
    out = residual.residual_features(f, residual.fit_diagonal(f), "diagonal_distance")
    return out.select("example_id", F.explode(F.arrays_zip(keys.alias("k"), F.col("vector").alias("v"))).alias("e")).select("example_id", F.col("e.k").alias("feature_key"), F.round("e.v", 5).alias("distance"))


@query(f"""WITH {_X}, m AS (SELECT feature_key, dim, avg(x) AS m, var_pop(x) AS v FROM x GROUP BY ALL)
    SELECT CAST(vec_id AS VARCHAR) AS example_id, round(sum(abs((x - m) / sqrt(v + 1e-6))), 4) AS total, round(sum((x - m) / sqrt(v + 1e-6)), 4) AS signed FROM x JOIN m USING (feature_key, dim) GROUP BY ALL""")
def c3_residual_kinds(spark, sf_dir):
    """The other two kinds, summed up."""
    f = i.features(spark, sf_dir)
    c = residual.fit_diagonal(f)
    total = lambda kind, name: residual.residual_features(f, c, kind).select("example_id", F.round(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v), 4).alias(name))
    return total("absolute", "total").join(total("residual", "signed"), "example_id")


@query()
def c4_residual_probe_cv(spark, sf_dir):
    rows = probes.grouped_folds(i.task_rows(spark, sf_dir), 2).drop("vector")
    p = residual.residual_probe_cv(i.features(spark, sf_dir), rows, [f"l{k}" for k in range(10)], 2, "low", "high")
    return p.groupBy("variant", "fold_index").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("is_correct").cast("int")).alias("accuracy"))


def _scores(spark, sf_dir):
    """Risk scores of four sources in two folds, from single components of the embeddings."""
    e = i.table(spark, sf_dir, "embeddings")
    each = F.explode(F.array(*[F.struct(F.lit(f"{p}_layer_{n:02d}").alias("feature_key"), F.round((F.get("embedding", F.lit(k)).cast("double") + 1) / 2, 2).alias("score")) for k, (p, n) in enumerate((("mean_pool", 11), ("mean_pool", 16), ("final_token", 11), ("final_token", 16)))]))
    s = e.select((F.col("vec_id") % 2).cast("int").alias("fold"), F.when(F.floor(F.col("vec_id") / 2) % 4 == 0, "test").otherwise("train").alias("role"), F.col("vec_id").cast("string").alias("example_id"), (F.col("label") < 5).alias("is_positive"), each.alias("f"))
    return s.select("fold", "role", "f.feature_key", "example_id", "f.score", "is_positive")


_S = "sc AS (SELECT CAST(vec_id % 2 AS INTEGER) AS fold, CASE WHEN (vec_id // 2) % 4 = 0 THEN 'test' ELSE 'train' END AS role, CAST(vec_id AS VARCHAR) AS example_id, label < 5 AS y, ['mean_pool_layer_11', 'mean_pool_layer_16', 'final_token_layer_11', 'final_token_layer_16'][i] AS feature_key, round((CAST(embedding[i] AS DOUBLE) + 1) / 2, 2) AS score FROM embeddings, range(1, 5) r(i))"


@query(f"""WITH {_S}, r AS (SELECT fold, feature_key, y, (rank() OVER (PARTITION BY fold, feature_key ORDER BY score)) + (count(*) OVER (PARTITION BY fold, feature_key, score) - 1) / 2 AS rk FROM sc WHERE role = 'train')
    , a AS (SELECT fold, feature_key, (sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)) AS auc FROM r GROUP BY ALL)
    SELECT fold, feature_key, round(auc, 6) AS auc, round(CASE WHEN sum(greatest(auc - 0.5, 0)) OVER w > 0 THEN greatest(auc - 0.5, 0) / sum(greatest(auc - 0.5, 0)) OVER w ELSE 1 / count(*) OVER w END, 6) AS weight FROM a WINDOW w AS (PARTITION BY fold)""")
def c5_auc_layer_weights(spark, sf_dir):
    return residual.auc_layer_weights(_scores(spark, sf_dir).where("role = 'train'")).select("fold", "feature_key", F.round("auc", 6).alias("auc"), F.round("weight", 6).alias("weight"))


@query(f"""WITH {_S}, t AS (SELECT fold, feature_key, score AS s, y FROM sc WHERE role = 'train'), m AS (SELECT *, lead(s) OVER (PARTITION BY fold, feature_key ORDER BY s) AS nx FROM (SELECT DISTINCT fold, feature_key, s FROM t)),
    c AS (SELECT fold, feature_key, (s + nx) / 2 AS cut FROM m WHERE nx IS NOT NULL UNION SELECT fold, feature_key, min(s) - 1e-12 FROM m GROUP BY ALL UNION SELECT fold, feature_key, max(s) + 1e-12 FROM m GROUP BY ALL UNION SELECT fold, feature_key, 0.5::DOUBLE FROM m GROUP BY ALL),
    e AS (SELECT fold, feature_key, cut, count(*) FILTER (y AND s >= cut) AS tp, count(*) FILTER (NOT y AND s >= cut) AS fp, count(*) FILTER (y AND s < cut) AS fn, count(*) FILTER (NOT y AND s < cut) AS tn FROM c JOIN t USING (fold, feature_key) GROUP BY ALL),
    f AS (SELECT *, (coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2 AS macro_f1, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY fold, feature_key ORDER BY macro_f1 DESC, accuracy DESC, cut) AS k FROM f)
    SELECT fold, feature_key, round(cut, 9) AS threshold, round(macro_f1, 9) AS macro_f1, round(accuracy, 9) AS accuracy FROM r WHERE k = 1""")
def c6_learn_threshold(spark, sf_dir):
    out = residual.learn_threshold(_scores(spark, sf_dir).where("role = 'train'"), ["fold", "feature_key"])
    return out.select("fold", "feature_key", *[F.round(c, 9).alias(c) for c in ("threshold", "macro_f1", "accuracy")])


@query()
def c7_layer_head_cv(spark, sf_dir):
    return residual.layer_head_cv(_scores(spark, sf_dir)).groupBy("fold", "is_positive", "predicted_positive").agg(F.count(F.lit(1)).alias("n"))


_SOURCES = ["final_token_layer_11", "final_token_layer_16", "mean_pool_layer_11", "mean_pool_layer_16"]


def _oof(spark, sf_dir):
    """Nested scores of all four sources."""
    rows = probes.grouped_folds(i.task_rows(spark, sf_dir), 2).drop("vector")
    return residual.source_oof_scores(i.features(spark, sf_dir), rows, _SOURCES, 2, 2, "low", "high")


@query("""SELECT CAST(vec_id AS VARCHAR) AS example_id, feature_key, 1 AS trains, 1 AS tests, label < 5 AS is_positive, true AS in_range FROM embeddings, (SELECT unnest(['mean_pool_layer_11', 'mean_pool_layer_16', 'final_token_layer_11', 'final_token_layer_16']) AS feature_key)""")
def c8_source_oof_coverage(spark, sf_dir):
    """Every example has one score of each source in its own outer fold, and one out-of-fold score in the other."""
    s = _oof(spark, sf_dir)
    return s.groupBy("example_id", "feature_key", "is_positive").agg(F.count_if(F.col("role") == "train").cast("int").alias("trains"), F.count_if(F.col("role") == "test").cast("int").alias("tests"), F.min((F.col("score") > 0) & (F.col("score") < 1)).alias("in_range"))


@query()
def c8_source_oof_scores(spark, sf_dir):
    s = _oof(spark, sf_dir)
    return s.groupBy("fold", "role", "feature_key").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))


@query()
def c9_meta_head_cv(spark, sf_dir):
    """All four sources' nested scores, cut at a learned threshold."""
    p, _ = residual.meta_head_cv(_oof(spark, sf_dir), _SOURCES, 2, learned=True)
    return p.groupBy("fold", "is_positive", "predicted_positive").agg(F.count(F.lit(1)).alias("n"))


@query()
def c9_meta_sweep(spark, sf_dir):
    """Every set of sources at every C against the baseline source, the best first."""
    s = _oof(spark, sf_dir)
    p, _ = residual.meta_sweep(s, residual.source_sets(_SOURCES), 2, (0.1, 1.0, 10.0))
    base = s.where("role = 'test' and feature_key = 'mean_pool_layer_16'").select("example_id", ((F.col("score") >= 0.5) == F.col("is_positive")).alias("is_correct"))
    return residual.sweep_summary(p, base)


@query(f"""WITH {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY fold, example_id ORDER BY score DESC, feature_key) AS k FROM sc WHERE role = 'test'), c AS (SELECT fold, example_id, avg(score) AS mean, max(score) AS "max", avg(score) FILTER (k <= 2) AS top_two, avg(CAST(score >= 0.5 AS INT)) AS votes FROM r GROUP BY ALL)
    SELECT fold, example_id, rule, round(score, 6) AS score FROM (UNPIVOT c ON mean, "max", top_two, votes INTO NAME rule VALUE score)""")
def c10_combine_scores(spark, sf_dir):
    return residual.combine_scores(_scores(spark, sf_dir).where("role = 'test'"), ["fold", "example_id"]).select("fold", "example_id", "rule", F.round("score", 6).alias("score"))


@query(f"WITH {_S} SELECT fold, example_id, feature_key, round(ln(greatest(least(score, 1 - 1e-4), 1e-4) / (1 - greatest(least(score, 1 - 1e-4), 1e-4))), 6) AS score FROM sc")
def c11_transform_scores(spark, sf_dir):
    return residual.transform_scores(_scores(spark, sf_dir), "logit").select("fold", "example_id", "feature_key", F.round("score", 6).alias("score"))


@query(f"""WITH {_S}, m AS (SELECT fold, role, example_id, y, avg(score) FILTER (feature_key LIKE 'final%') AS f, avg(score) FILTER (feature_key LIKE 'mean%') AS m FROM sc GROUP BY ALL)
    SELECT fold, role, example_id, feature_key, round(score, 6) AS score FROM (SELECT fold, role, example_id, feature_key, score FROM sc UNION ALL SELECT fold, role, example_id, k, CASE k WHEN 'final_token_mean' THEN f WHEN 'mean_pool_mean' THEN m WHEN 'mean_gap' THEN m - f ELSE abs(m - f) END FROM m, (SELECT unnest(['final_token_mean', 'mean_pool_mean', 'mean_gap', 'absolute_mean_gap']) AS k))""")
def c11_interaction_scores(spark, sf_dir):
    """The sources, the means of each pooling, and their gaps."""
    s = residual.interaction_scores(_scores(spark, sf_dir), "family_mean_gaps")
    return s.select("fold", "role", "example_id", "feature_key", F.round("score", 6).alias("score"))


@query(f"""WITH {_S}, m AS (SELECT fold, role, example_id, split_part(feature_key, '_layer_', 1) AS source, avg(score) AS m FROM sc GROUP BY ALL)
    SELECT fold, role, example_id, round(max(m) - min(m), 6) AS abs_gap, round(max(m) FILTER (source = 'final_token') - max(m) FILTER (source = 'mean_pool'), 6) AS gap FROM m GROUP BY ALL""")
def c11_family_means(spark, sf_dir):
    m = residual.family_means(_scores(spark, sf_dir), ["fold", "role", "example_id"])
    return m.select("fold", "role", "example_id", F.round("abs_gap", 6).alias("abs_gap"), F.round("gap", 6).alias("gap"))


@query()
def c11_platt_scores(spark, sf_dir):
    """Every source's scores through a Platt fit of its fold."""
    s = residual.transform_scores(_scores(spark, sf_dir), "platt")
    return s.groupBy("fold", "role", "feature_key").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query()
def c12_logit_contributions(spark, sf_dir):
    s = _scores(spark, sf_dir)
    p, coefs = residual.meta_head_cv(s, _SOURCES, 2)
    wrong = p.where(F.col("predicted_positive") != F.col("is_positive"))
    return residual.logit_contributions(s, coefs, wrong)[1]


@query(f"WITH {_S} SELECT example_id, count(*) AS n FROM sc WHERE role = 'train' AND y GROUP BY ALL")
def c1_calibration_rows(spark, sf_dir):
    s = _scores(spark, sf_dir).withColumn("label", F.when(F.col("is_positive"), "p").otherwise("n"))
    folds = s.select("example_id", F.when(F.col("role") == "test", 0).otherwise(1).alias("fold")).distinct()
    return residual.calibration_rows(s, folds, 0, ["p"]).groupBy("example_id").agg(F.count(F.lit(1)).alias("n"))


@query()
def k1_nested_platt(spark, sf_dir):
    """Calibrated predictions of all four sources."""
    rows = probes.grouped_folds(i.task_rows(spark, sf_dir), 2).drop("vector")
    p = residual.nested_platt(i.features(spark, sf_dir), rows, _SOURCES, 2, 2, "low", "high")
    return p.groupBy("feature_key", "fold_index", "true_label", "predicted_label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("positive_probability"), 6).alias("mean_probability"))


# ---------------------------------------------------------------- sources

@query("SELECT feature_key, 'missing_example' AS violation, count(*) AS n FROM embeddings, (SELECT unnest(['mean_pool_layer_11', 'mean_pool_layer_16', 'final_token_layer_11', 'final_token_layer_16']) AS feature_key) WHERE vec_id % 10 = 0 GROUP BY ALL")
def s7_validate_features(spark, sf_dir):
    f = i.features(spark, sf_dir)
    return lineage.validate_features(f.where("cast(example_id as long) % 10 <> 0"), f.select("example_id"))


@query("SELECT doc_id FROM documents WHERE source <> 'src3'")
def s8_exclude_sealed(spark, sf_dir):
    d = i.table(spark, sf_dir, "documents").withColumn("tags", F.when(F.col("source") == "src3", F.array(F.lit("sealed_holdout"))).otherwise(F.array(F.lit("open"))))
    return io.exclude_sealed(d).select("doc_id")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def s4_recent_audit(spark, sf_dir):
    e = i.table(spark, sf_dir, "events").select(F.col("ts").alias("created_at"), F.col("event_id").alias("trace_id"), F.lit(1).alias("turn_index"))
    return io.newest(e, 25).select(F.col("trace_id").alias("event_id"))


@query("SELECT violation, count(*) AS n FROM (SELECT CASE WHEN turn % 6 = 0 THEN 'label' WHEN turn % 6 = 1 THEN 'tags' ELSE 'good' END AS violation FROM conversations) GROUP BY violation")
def s2_check_prompts(spark, sf_dir):
    k = F.col("turn") % 6
    c = i.table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.when(k == 0, "odd").otherwise("benign").alias("label"), F.lit("f").alias("family"), F.concat("text", F.lit(".")).alias("text"), F.when(k == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("t"))).alias("tags"))
    good, bad = io.check_prompts(c)
    return good.select(F.lit("good").alias("violation")).unionByName(bad.select("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT doc_id, doc_id % 9 AS k FROM documents)
    SELECT CASE k WHEN 1 THEN 'secret_char_span' WHEN 2 THEN 'query_token_span' WHEN 3 THEN 'payload_char_span' WHEN 4 THEN 'readout_order' WHEN 5 THEN 'readout_window' WHEN 6 THEN 'readout_order' ELSE 'good' END AS violation, count(*) AS n FROM p GROUP BY 1""")
def s2_structured_prompts(spark, sf_dir):
    """Structured prompts from documents, some with broken spans or readouts."""
    d = i.table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 9
    of = lambda *x: F.array(*[F.lit(v) for v in x])
    pay = F.when(k.isin(3, 7), of(9, 14))
    p = d.select(
        F.col("doc_id").cast("string").alias("id"), F.lit("benign").alias("label"), F.col("source").alias("family"), F.concat("text", F.lit(".")).alias("text"), F.array(F.col("lang")).alias("tags"),
        F.when(k == 1, of(5, 5)).otherwise(of(1, 5)).alias("secret_char_span"), of(6, 9).alias("query_char_span"), F.when(k == 3, of(14, 9)).otherwise(pay).alias("payload_char_span"), of(1, 3).alias("secret_token_span"),
        F.when(k == 2, of(-1, 4)).otherwise(of(3, 6)).alias("query_token_span"), F.when(k.isin(3, 7), of(6, 9)).alias("payload_token_span"),
        F.when(k == 4, of(5, 4)).when(k == 5, of(0, 1)).when(k == 6, F.array().cast("array<int>")).when(k == 7, of(6, 7, 8)).otherwise(of(3, 4, 5)).alias("readout_token_indices"))
    good, bad = io.check_prompts(p, structured=True)
    return good.select(F.lit("good").alias("violation")).unionByName(bad.select("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT turn) AS turns FROM conversations")
def s1_read_turns(spark, sf_dir):
    path = new_path(spark, "turns")
    t = i.turns(spark, sf_dir).withColumn("capability_mode", F.lit("black_box"))
    t.write.json(path)
    good, _ = io.read_turns(spark, path)
    return good.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("turn_index").alias("turns"))


@query("""WITH e AS (SELECT event_id, CAST(event_id - (event_id % 20 = 1)::INT AS VARCHAR) AS example_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS score FROM events), d AS (SELECT *, count(*) OVER (PARTITION BY example_id) AS k FROM e)
    SELECT CASE WHEN score IS NULL THEN 'score' WHEN k > 1 THEN 'duplicate_example_id' ELSE 'good' END AS violation, count(*) AS n, round(sum(score), 4) AS total FROM d GROUP BY 1""")
def s1_read_scores(spark, sf_dir):
    """Scores of all events as JSON lines: some without a score, some twice for one example."""
    path = new_path(spark, "scores")
    e = i.table(spark, sf_dir, "events")
    key = (F.col("event_id") - (F.col("event_id") % 20 == 1).cast("int")).cast("string")
    score = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    e.select(F.lit("t").alias("trace_id"), F.lit("s").alias("session_id"), F.lit(1).alias("turn_index"), key.alias("example_id"), F.struct(score.alias("score")).alias("detector_result")).write.json(path)
    good, bad = io.read_scores(spark, path)
    both = good.select(F.lit("good").alias("violation"), "detector_result.score").unionByName(bad.select("violation", "detector_result.score"))
    return both.groupBy("violation").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("total"))


@query(f"WITH {i.RESULTS} SELECT CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS component, session_id, turn_index, detector_name, round(score, 9) AS score, {i.ACTION.format('sev')} AS action, capability_status FROM res")
def s3_write_detector_results(spark, sf_dir):
    """All results written in a folder per component, and read back."""
    path = new_path(spark, "results")
    io.write_detector_results(i.results(spark, sf_dir).withColumn("component", F.when(F.col("position") % 2 == 0, "a").otherwise("b")), path)
    r = F.col("detector_result")
    return spark.read.parquet(path).select("component", "session_id", "turn_index", r["detector_name"].alias("detector_name"), F.round(r["score"], 9).alias("score"), r["recommended_action"].alias("action"), r["capability_status"].alias("capability_status"))


@query("SELECT 'dataset' AS kind, source AS id, 'hash_mismatch' AS violation FROM (SELECT DISTINCT source FROM documents) WHERE source = 'src1' UNION ALL SELECT 'dataset', source, 'missing_file' FROM (SELECT DISTINCT source FROM documents) WHERE source = 'src2'")
def s6_validate_lineage(spark, sf_dir):
    s = i.table(spark, sf_dir, "documents").select("source").distinct()
    data = s.select(F.col("source").alias("id"), F.col("source").alias("path"), F.sha2("source", 256).alias("sha256"))
    files = s.where("source <> 'src2'").select(F.col("source").alias("path"), F.when(F.col("source") == "src1", F.sha2(F.lit("x"), 256)).otherwise(F.sha2("source", 256)).alias("sha256"))
    none = data.where("false").withColumn("dataset_id", F.lit("")).withColumn("artifact_id", F.lit(""))
    return lineage.validate_lineage(data, none, none, files)


@query("""SELECT 'dataset' AS kind, CAST(conv_id AS VARCHAR) AS id, CASE WHEN conv_id % 10 = 3 THEN 'hash_mismatch' ELSE 'missing_file' END AS violation FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 10 IN (3, 7)
    UNION ALL SELECT 'report', 'r' || conv_id, 'unknown_dataset_id' FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 10 = 5""")
def s6_file_hashes(spark, sf_dir):
    """Every conversation as a file, against a manifest whose hashes come from the table: some files are not as claimed, some are not there; large ones are streamed."""
    c, path = i.table(spark, sf_dir, "conversations"), new_path(spark, "files")
    c.repartition("conv_id").sortWithinPartitions("conv_id", "turn").select("conv_id", "text").write.partitionBy("conv_id").text(path)
    files = lineage.file_hashes(spark, path, whole=2048)
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    claims = c.groupBy("conv_id").agg(F.concat(lines, F.lit("\n")).alias("content"))
    where = files.select(F.regexp_extract("path", r"conv_id=(\d+)/", 1).cast("long").alias("conv_id"), "path")
    data = claims.join(where, "conv_id").select(
        F.col("conv_id").cast("string").alias("id"), F.when(F.col("conv_id") % 10 == 7, F.lit("gone.txt")).otherwise(F.col("path")).alias("path"),
        F.sha2(F.when(F.col("conv_id") % 10 == 3, F.concat("content", F.lit("!"))).otherwise(F.col("content")), 256).alias("sha256"))
    none = data.where("false").withColumn("dataset_id", F.lit("")).withColumn("artifact_id", F.lit(""))
    reports = data.where("cast(id as long) % 10 not in (3, 7)").select(F.concat(F.lit("r"), "id").alias("id"), "path", "sha256", F.when(F.col("id").cast("long") % 10 == 5, "lost").otherwise(F.col("id")).alias("dataset_id"), F.lit(None).cast("string").alias("artifact_id"))
    return lineage.validate_lineage(data, none, reports, files)


# ---------------------------------------------------------------- generation

def _corpus(spark, sf_dir):
    sha = F.sha2(F.col("doc_id").cast("string"), 256)
    return i.table(spark, sf_dir, "documents").select(F.lit("stripe-sk-live").alias("format"), F.col("doc_id").alias("example_id"), F.concat(F.lit("sk_live_"), F.substring(sha, 1, 24)).alias("token"))


@query("""WITH b AS (SELECT doc_id, sha256(CAST(doc_id AS VARCHAR))[1:24] AS s FROM documents), c AS (SELECT doc_id, CASE WHEN i = 1 THEN '<START>' ELSE s[i - 1:i - 1] END AS state, s[i:i] AS next_char FROM b, range(1, 25) r(i)),
    n AS (SELECT state, next_char, sum(least(k, 2)) AS v FROM (SELECT doc_id, state, next_char, count(*) AS k FROM c GROUP BY ALL) GROUP BY ALL)
    SELECT 'stripe-sk-live' AS format, state, next_char, round(v / sum(v) OVER (PARTITION BY state), 9) AS prob FROM n""")
def g2_train_bigrams(spark, sf_dir):
    t = generate.train_bigrams(_corpus(spark, sf_dir), noise=False).where("prob > 0")
    return t.select("format", "state", "next_char", F.round("prob", 9).alias("prob"))


@query()
def g2_train_bigrams_private(spark, sf_dir):
    return generate.train_bigrams(_corpus(spark, sf_dir), epsilon=1.0, seed=3)


@query("SELECT 'stripe-sk-live' AS format, count(*) AS n, count(*) AS valid FROM documents")
def g3_sample_tokens(spark, sf_dir):
    """As many tokens as there are documents to plant them in."""
    n = i.table(spark, sf_dir, "documents").count()
    t = generate.sample_tokens(generate.train_bigrams(_corpus(spark, sf_dir)), ["stripe-sk-live"], n, 1)
    return formats.validate_tokens(t).groupBy("format").agg(F.count_distinct("token_id").alias("n"), F.count_if("valid").alias("valid"))


@query()
def g4_realism_report(spark, sf_dir):
    c = _corpus(spark, sf_dir)
    return generate.realism_report(c, generate.train_bigrams(c, noise=False))


@query()
def s5_load_transitions(spark, sf_dir):
    path = new_path(spark, "model")
    t = generate.train_bigrams(_corpus(spark, sf_dir))
    meta = t.select("format").distinct().select("format", F.lit(1.0).alias("epsilon"), F.lit(2.0).alias("clip"), F.lit(1).alias("corpus_size"), F.lit(0).alias("train_seed"))
    lineage.write_transitions(t, meta, path)
    good, bad = lineage.load_transitions(spark, path)
    return good.groupBy("format").agg(F.count(F.lit(1)).alias("cells")).crossJoin(bad.agg(F.count(F.lit(1)).alias("violations")))


@query(f"WITH {i.CANARIES} SELECT 't1-' || canary_id AS example_id, CAST(length('You help.') + 9 AS INTEGER) AS secret_start, CAST(length('You help.') + 9 + length(value) AS INTEGER) AS secret_end FROM can")
def g5_build_prompts(spark, sf_dir):
    can = i.canaries(spark, sf_dir)
    templates = spark.range(1).select(F.lit("t1").alias("template_id"), F.lit("You help.").alias("system"), F.lit("What is it?").alias("query"), F.lit(None).cast("string").alias("payload"))
    p = generate.build_prompts(templates, can)
    return p.select("example_id", F.get("secret_char_span", F.lit(0)).alias("secret_start"), F.get("secret_char_span", F.lit(1)).alias("secret_end"))


@query(f"""WITH {i.CANARIES}, p AS (SELECT item_id || '-' || canary_id AS example_id, CAST(session_id AS BIGINT) AS k, length(text) + 9 AS sa, length(text) + 9 + length(value) AS sb, length(text) + 9 + length(value) + 8 AS qa, length(text) + 17 + length(value) + 12 AS qb, item_id % 2 = 0 AS has, length(text) + 29 + length(value) + 15 AS pa, length(text) + 44 + length(value) + length('item ' || item_id) AS pb FROM benchmark, can),
    e AS (SELECT *, CASE WHEN has THEN pb ELSE qb END AS n, CASE k % 6 WHEN 0 THEN sa + 2 WHEN 1 THEN qa ELSE CASE WHEN has THEN pb ELSE qb END END AS cut FROM p),
    c AS (SELECT *, CASE WHEN cut < n THEN 4 * (cut // 4) ELSE n END AS upto FROM e),
    v AS (SELECT *, list_min(list_filter([CASE WHEN has AND pa >= upto THEN 'payload_not_covered' WHEN has AND pb > upto THEN 'payload_partially_covered' END, CASE WHEN qa >= upto THEN 'query_not_covered' WHEN qb > upto THEN 'query_partially_covered' END, CASE WHEN sa >= upto THEN 'secret_not_covered' WHEN sb > upto THEN 'secret_partially_covered' END], lambda x: x IS NOT NULL)) AS bad,
        sa // 4 + 1 AS s1, (sb - 1) // 4 + 2 AS s2, qa // 4 + 1 AS q1, (qb - 1) // 4 + 2 AS q2, pa // 4 + 1 AS p1, (pb - 1) // 4 + 2 AS p2 FROM c),
    w AS (SELECT *, CASE WHEN has THEN p2 ELSE q2 END AS stop, CASE WHEN has THEN greatest(p1, s2, q2, p2 - 4) ELSE greatest(q1, s2, q2 - 4) END AS beg FROM v)
    SELECT example_id, coalesce(bad, CASE WHEN beg >= stop THEN 'empty_readout' ELSE 'good' END) AS violation, CAST(CASE WHEN bad IS NULL AND beg < stop THEN s1 END AS INTEGER) AS secret_first, CAST(CASE WHEN bad IS NULL AND beg < stop THEN beg END AS INTEGER) AS readout_first, CAST(CASE WHEN bad IS NULL AND beg < stop THEN stop - beg END AS INTEGER) AS readout FROM w""")
def g5_token_spans(spark, sf_dir):
    """Every benchmark text with every canary, cut into tokens of four characters after a special one; for some sessions the tokens stop early."""
    can = i.canaries(spark, sf_dir)
    b = i.table(spark, sf_dir, "benchmark")
    templates = b.select(F.col("item_id").alias("template_id"), F.col("text").alias("system"), F.lit("what is it ?").alias("query"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("item "), F.col("item_id").cast("string"))).alias("payload"))
    p = generate.build_prompts(templates, can)
    k, n = F.substring("canary_id", 2, 20).cast("long") % 6, F.length("text")
    cut = F.when(k == 0, F.get("secret_char_span", F.lit(0)) + 2).when(k == 1, F.get("query_char_span", F.lit(0))).otherwise(n)
    each = p.select("example_id", n.alias("n"), cut.alias("cut"), F.explode(F.sequence(F.lit(0), F.ceil(n / 4).cast("int"))).alias("token_index"))
    end = F.least(F.col("token_index") * 4, F.col("n"))
    tokens = each.select("example_id", "token_index", F.when(F.col("token_index") == 0, 0).otherwise((F.col("token_index") - 1) * 4).alias("start"), F.when(F.col("token_index") == 0, 0).otherwise(end).alias("end"), "cut").where((F.col("token_index") == 0) | (F.col("end") <= F.col("cut")))
    good, bad = generate.add_token_spans(p, tokens)
    rows = good.select("example_id", F.lit("good").alias("violation"), F.get("secret_token_span", F.lit(0)).alias("secret_first"), F.get("readout_token_indices", F.lit(0)).alias("readout_first"), F.size("readout_token_indices").alias("readout"))
    none = F.lit(None).cast("int")
    return rows.unionByName(bad.select("example_id", "violation", none.alias("secret_first"), none.alias("readout_first"), none.alias("readout")))


@query()
def g1_synthetic_corpus(spark, sf_dir):
    """As many tokens of each format as there are sessions."""
    n = i.canaries(spark, sf_dir).count()
    return formats.validate_tokens(generate.synthetic_corpus(spark, [f.slug for f in formats.FORMATS], n, 1)).groupBy("format", "valid").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- streams

def _stream(spark, sf_dir, name, first=None):
    """The table as a stream of files, rows for which ``first`` holds in earlier batches; it is written to a folder first, as a stream cannot read a lone file."""
    rows, path = i.table(spark, sf_dir, name), new_path(spark, name)
    for part in [rows] if first is None else [rows.where(first), rows.where(~first)]:
        part.write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", len(rows.inputFiles()) if first is not None else 1000).parquet(path)


_GUARD = f"""{i.OUTPUTS}, g AS (SELECT trace_id, value, text, contains(text, value) AS said, contains(text, reverse(value)) OR contains(lower(text), lower(hex(encode(value)))) AS coded FROM outs)"""


@query(f"WITH {_GUARD} SELECT trace_id, CASE WHEN said THEN 'escalate' WHEN coded THEN 'block' ELSE 'other' END AS action, CASE WHEN said THEN 'canary' WHEN coded THEN 'encoded' ELSE '' END AS triggered, CAST(CASE WHEN said THEN 1.0 WHEN coded THEN 0.9 ELSE 0.0 END AS DOUBLE) AS risk, 1 AS rows FROM g")
def t1_stream_guard(spark, sf_dir):
    """Outputs arrive as a file stream and pass three detectors; each is audited once, also when the stream starts again. Shapes are judged in f8."""
    out, path = i.outputs(spark, sf_dir), new_path(spark, "outputs")
    out.write.parquet(path)
    can, audit, place = i.canaries(spark, sf_dir), new_path(spark, "audit"), new_path(spark, "guard")
    detectors = [jobs.canary_detector(can), jobs.encoded_detector(can), jobs.shape_detector]
    for _ in range(2):
        stream = spark.readStream.schema(out.schema).parquet(path)
        jobs.stream_guard(stream, detectors, audit, place).awaitTermination()
    rows = jobs.read_audit(spark, audit)
    hard = F.col("action").isin("escalate", "block")
    first = F.filter("triggered_detectors", lambda d: d != "shape")
    per = rows.groupBy("trace_id").agg(F.first("action").alias("action"), F.first(first).alias("t"), F.first("risk_score").alias("risk_score"), F.count(F.lit(1)).cast("int").alias("rows"))
    return per.select("trace_id", F.when(hard, F.col("action")).otherwise("other").alias("action"), F.when(hard, F.array_join("t", ",")).otherwise("").alias("triggered"), F.when(hard, F.col("risk_score")).otherwise(0.0).alias("risk"), "rows")


def _run(spark, df, *key):
    """The last row of each key that a stateful stream has given after it has read what there is; every batch is written as it comes."""
    path = new_path(spark, "batches")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    df.writeStream.outputMode("update").option("checkpointLocation", new_path(spark, "state")).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(path)
    every = [c for c in rows.columns if c not in (*key, "batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*every), "batch").alias("r")).select(*key, "r.*")


@query("""SELECT CAST(conv_id AS VARCHAR) AS session_id, 'slot' || (turn % 3) AS slot_name, CAST(min(turn) AS INTEGER) AS turn_index, 'type' || (min(turn) % 2) AS credential_type, true AS stable FROM conversations GROUP BY ALL""")
def t2_stream_ledger(spark, sf_dir):
    """The stream brings the first turns of all sessions last; they still plant."""
    c = _stream(spark, sf_dir, "conversations", F.col("turn") >= 2)
    p = c.select(F.col("conv_id").cast("string").alias("session_id"), F.concat(F.lit("slot"), (F.col("turn") % 3).cast("string")).alias("slot_name"), F.concat(F.lit("type"), (F.col("turn") % 2).cast("string")).alias("credential_type"), F.col("turn").cast("int").alias("turn_index"))
    out = _run(spark, jobs.stream_ledger(p), "session_id", "slot_name")
    return out.withColumn("stable", F.col("value") == ledger.hash_token("canary")).select("session_id", "slot_name", "turn_index", "credential_type", "stable")


@query("SELECT CAST(user_id AS VARCHAR) AS session_id, max((event_id % 101) / 101) AS max_risk, count(*) AS turns, ['allow', 'warn', 'sanitize', 'block', 'escalate'][max(event_id % 5) + 1] AS gravest FROM events GROUP BY user_id")
def t3_stream_session_risk(spark, sf_dir):
    e = _stream(spark, sf_dir, "events")
    action = F.get(F.array(*[F.lit(a) for a in ("allow", "warn", "sanitize", "block", "escalate")]), (F.col("event_id") % 5).cast("int"))
    d = e.select(F.col("user_id").cast("string").alias("session_id"), action.alias("action"), (F.col("event_id") % 101 / 101).alias("risk_score"))
    return _run(spark, jobs.stream_session_risk(d), "session_id").select("session_id", "max_risk", "turns", "gravest")
