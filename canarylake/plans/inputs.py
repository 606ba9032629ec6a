"""Inputs of the queries, derived from the driver's tables in Spark and, by the same rules, in SQL.

The tables hold no registered secrets and no canaries, so these are made from hashes of the rows' keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import CHECKSUM, FORMATS, Format, github_checksum
from ..functions.text import rot


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: One document in so many has no token, a token with a wrong checksum, or a token of each format.
_TURNS = len(FORMATS) + 3
_WRONG = len(FORMATS)
_CASE = {"upper_digits": "upper({})", "digits": "translate({}, 'abcdef', '012345')", "password": "upper({0}[1:5]) || {0}[6:]"}


def token_of(fmt: Format, stream: Column) -> Column:
    """A token of the format from a stream of hex digits, with a true checksum."""
    out, at = [], 1
    for s in fmt.segments:
        if s is CHECKSUM:
            out.append(github_checksum(F.substring(stream, 1, 30)))
        elif isinstance(s, str):
            out.append(F.lit(s))
        else:
            piece = F.substring(stream, at, s[1])
            piece = F.upper(piece) if s[0] == "upper_digits" else F.translate(piece, "abcdef", "012345") if s[0] == "digits" else piece
            if s[0] == "password":
                piece = F.concat(F.upper(F.substring(piece, 1, 5)), F.substring(piece, 6, s[1]))
            out.append(piece)
            at += s[1]
    return F.concat(*out)


def _token_sql(fmt: Format) -> str:
    """The same in SQL, but for checksums, which SQL has no function for: they are six z."""
    out, at = [], 1
    for s in fmt.segments:
        if s is CHECKSUM:
            out.append("'zzzzzz'")
        elif isinstance(s, str):
            out.append(f"'{s}'")
        else:
            piece = f"h[{at}:{at + s[1] - 1}]"
            out.append(_CASE.get(s[0], "{}").format(f"({piece})" if s[0] == "password" else piece))
            at += s[1]
    return " || ".join(out)


def token_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a token at the end: by their number, one of each format, one with a wrong checksum, or none."""
    stream, k = F.concat(F.sha2(F.col("doc_id").cast("string"), 256), F.sha2(F.concat(F.lit("x"), F.col("doc_id").cast("string")), 256)), F.pmod("doc_id", F.lit(_TURNS)).cast("int")
    tok = F.lit("")
    for n, f in enumerate(FORMATS):
        tok = F.when(k == n, token_of(f, stream)).otherwise(tok)
    tok = F.when(k == _WRONG, F.concat(F.lit("ghp_"), F.substring(stream, 1, 30), F.lit("zzzzzz"))).otherwise(tok)
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.col("text"), F.lit("  "), tok, F.lit("  end")).alias("text"), tok.alias("token"), k.alias("k"))


TOKEN_DOCUMENTS = f"""td AS (SELECT doc_id, source, k, tok AS token, text AS base, text || '  ' || tok || '  end' AS text FROM (
    SELECT *, CASE k {" ".join(f"WHEN {n} THEN {_token_sql(f)}" for n, f in enumerate(FORMATS))} WHEN {_WRONG} THEN 'ghp_' || h[1:30] || 'zzzzzz' ELSE '' END AS tok
    FROM (SELECT *, CAST(doc_id % {_TURNS} AS INTEGER) AS k, sha256(CAST(doc_id AS VARCHAR)) || sha256('x' || CAST(doc_id AS VARCHAR)) AS h FROM documents)))"""


def canaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One canary per conversation."""
    conv = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id")).distinct()
    value = F.concat(F.lit("sk-hny-"), F.substring(F.sha2("session_id", 256), 1, 24))
    return conv.select(F.concat(F.lit("c"), "session_id").alias("canary_id"), "session_id", value.alias("value")).withColumn("sha256", F.sha2("value", 256))


CANARIES = """can AS (SELECT 'c' || session_id AS canary_id, session_id, value, sha256(value) AS sha256 FROM (
    SELECT session_id, 'sk-hny-' || sha256(session_id)[1:24] AS value FROM (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS session_id FROM conversations)))"""


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns; six of seven leak their session's canary in some form."""
    conv = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.concat(F.lit("t"), "conv_id", F.lit("-"), "turn").alias("trace_id"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("turn_index"), "text")
    met = conv.join(canaries(spark, sf_dir).select("session_id", "value"), "session_id")
    v, k = F.col("value"), F.col("turn_index") % 7
    leak = F.when(k == 0, v).when(k == 1, F.reverse(v)).when(k == 2, F.lower(F.hex(v.cast("binary")))).when(k == 3, F.base64(v.cast("binary"))).when(k == 4, rot(v, 13)).when(k == 5, F.concat(F.substring(v, 1, 12), F.lit(" - "), F.substring(v, 13, 99))).otherwise("")
    return met.select("trace_id", "session_id", "turn_index", F.concat("text", F.lit(" "), leak, F.lit(" .")).alias("text"))


_AZ = "'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM'"
OUTPUTS = CANARIES + f""", outs AS (SELECT 't' || conv_id || '-' || turn AS trace_id, session_id, CAST(turn AS INTEGER) AS turn_index, value, canary_id, text || ' ' ||
    CASE turn % 7 WHEN 0 THEN value WHEN 1 THEN reverse(value) WHEN 2 THEN lower(hex(encode(value))) WHEN 3 THEN to_base64(encode(value)) WHEN 4 THEN translate(value, {_AZ}) WHEN 5 THEN value[1:12] || ' - ' || value[13:] ELSE '' END || ' .' AS text
    FROM conversations JOIN can ON can.session_id = CAST(conv_id AS VARCHAR) WHERE role = 'assistant')"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn per conversation row, whose message asks for a credential by slot."""
    conv = table(spark, sf_dir, "conversations")
    content = F.concat("text", F.lit(" use {{CREDENTIAL:slot"), (F.col("turn") % 3).cast("string"), F.lit(":type"), (F.col("turn") % 2).cast("string"), F.lit("}} now"))
    return conv.select(F.concat(F.lit("t"), "conv_id", F.lit("-"), "turn").alias("trace_id"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("turn_index"), F.array(F.struct("role", content.alias("content"))).alias("messages"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector results from events: three to a turn of a user's session."""
    e = table(spark, sf_dir, "events")
    action = F.get(F.array(*[F.lit(a) for a in ("allow", "warn", "sanitize", "block", "escalate")]), (F.col("event_id") % 5).cast("int"))
    return e.select(F.col("user_id").cast("string").alias("trace_id"), F.col("user_id").cast("string").alias("session_id"), F.floor(F.col("event_id") / 300).cast("int").alias("turn_index"), F.concat(F.lit("d"), "event_id").alias("detector_name"), (F.col("event_id") % 101 / 101).alias("score"), action.alias("recommended_action"), F.when(F.col("event_id") % 11 == 0, "degraded").otherwise("active").alias("capability_status"), F.col("event_type").alias("mode"), (F.col("event_id") % 2).cast("string").alias("model"), "ts", F.col("event_id").alias("position"))


RESULTS = """res AS (SELECT CAST(user_id AS VARCHAR) AS trace_id, CAST(user_id AS VARCHAR) AS session_id, CAST(floor(event_id / 300) AS INTEGER) AS turn_index, 'd' || event_id AS detector_name, event_id, (event_id % 101) / 101 AS score,
    CAST(event_id % 5 AS INTEGER) AS sev, CASE WHEN event_id % 11 = 0 THEN 'degraded' ELSE 'active' END AS capability_status, event_type AS mode, CAST(event_id % 2 AS VARCHAR) AS model FROM events),
    dec AS (SELECT r.trace_id, r.session_id, r.turn_index, max(top) AS top, max(score) AS risk_score, CASE WHEN max(top) > 0 THEN string_agg(detector_name, ',' ORDER BY event_id) ELSE '' END AS triggered
    FROM (SELECT *, max(sev) OVER (PARTITION BY trace_id, session_id, turn_index) AS top FROM res) r WHERE sev = top GROUP BY ALL)"""
ACTION = "['allow', 'warn', 'sanitize', 'block', 'escalate'][{} + 1]"


def predictions(spark: SparkSession, sf_dir: str, pivot: float = 1500.0, dataset: str = "d") -> DataFrame:
    """A quality guess per labelled document from its length, with the document's metadata."""
    met = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars"), "doc_id")
    p = F.col("n_chars") / (F.col("n_chars") + pivot)
    name = lambda c: F.when(c, "good").otherwise("bad")
    out = met.select(F.lit(dataset).alias("dataset_id"), F.col("doc_id").cast("string").alias("example_id"), F.col("source").alias("family"), "lang", F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")).alias("part"), (F.col("doc_id") % 5).cast("int").alias("fold_index"), name(F.col("quality") == 1).alias("true_label"), name(p >= 0.5).alias("predicted_label"), F.lit("good").alias("positive_label"), p.alias("positive_probability"))
    return out.withColumn("is_correct", F.col("true_label") == F.col("predicted_label"))


def predictions_sql(name: str = "pred", pivot: float = 1500.0) -> str:
    """The same as a common table expression."""
    return f"""{name} AS (SELECT *, true_label = predicted_label AS is_correct FROM (SELECT 'd' AS dataset_id, CAST(l.doc_id AS VARCHAR) AS example_id, source AS family, lang, 's' || (l.doc_id % 3) AS part, CAST(l.doc_id % 5 AS INTEGER) AS fold_index,
        CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS true_label, CASE WHEN n_chars / (n_chars + {pivot}::DOUBLE) >= 0.5 THEN 'good' ELSE 'bad' END AS predicted_label, 'good' AS positive_label, n_chars / (n_chars + {pivot}::DOUBLE) AS p
        FROM labels l JOIN documents USING (doc_id)))"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four feature keys of 16 dimensions per embedding."""
    e = table(spark, sf_dir, "embeddings")
    each = F.explode(F.array(*[F.struct(F.lit(f"{p}_layer_{n:02d}").alias("feature_key"), F.slice("embedding", i * 16 + 1, 16).alias("vector")) for i, (p, n) in enumerate((("mean_pool", 11), ("mean_pool", 16), ("final_token", 11), ("final_token", 16)))]))
    return e.select(F.col("vec_id").cast("string").alias("example_id"), each.alias("f")).select("example_id", "f.*")


def task_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as examples of two classes in 25 families, with whole vectors."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("example_id"), (F.col("vec_id") % 25).cast("string").alias("family"), F.when(F.col("label") < 5, "low").otherwise("high").alias("target"), F.concat(F.lit("l"), F.col("label").cast("string")).alias("label"), F.col("embedding").alias("vector"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy texts from conversation rows, as a payload or inline, some of them broken."""
    c = table(spark, sf_dir, "conversations")
    k = F.col("turn") + F.col("conv_id")
    action = F.get(F.array(F.lit("summary"), F.lit("mask"), F.lit("copy"), F.lit("erase")), (k % 4).cast("int"))
    field, mode = F.concat(F.lit("field"), (k % 3).cast("string")), F.when(k % 2 == 0, "a").otherwise("b")
    payload = F.concat(F.lit('\nTool payload: {"selected_field":"'), field, F.lit('","selected_mode":"'), mode, F.lit('","selected_action":"'), action, F.lit('"}'))
    inline = F.concat(F.lit("\nInline policy block: selected_field="), field, F.lit(";selected_mode="), mode, F.lit(";selected_action="), action)
    text = F.concat("text", F.when(F.col("conv_id") % 5 == 0, "").when(F.col("turn") % 2 == 0, payload).otherwise(inline))
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("example_id"), text.alias("text"), "conv_id", "turn")
