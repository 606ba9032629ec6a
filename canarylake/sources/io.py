"""Readers that split good rows from bad ones, and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPAN = "struct<kind:string,source:string,char_start:int,char_end:int,token_start:int,token_end:int,identifier:string,metadata:map<string,string>>"
TURN = (
    "trace_id string, session_id string, turn_index int, capability_mode string, model struct<provider:string,model_id:string,revision:string,selected_device:string>, "
    "messages array<struct<role:string,content:string>>, tool_calls array<struct<name:string,arguments:string>>, sensitive_spans array<" + SPAN + ">, "
    "metadata struct<example_id:string,eval:struct<label:string,family:string,tags:array<string>>,cift:struct<readout_token_indices:array<int>,feature_vectors:map<string,array<double>>>>"
)
SCORE = "trace_id string, session_id string, turn_index int, example_id string, detector_result struct<detector_name:string,component:string,score:double,confidence:double,recommended_action:string,capability_required:string,capability_status:string,latency_ms:double>"
MODES = ("self_hosted_introspection", "black_box", "sdk_embedded", "offline_eval")
LABELS = ("benign", "secret_present_safe", "exfiltration_intent")
PROMPT = "id string, label string, family string, text string, tags array<string>"
STRUCTURED = PROMPT + ", example_id string, rendered_prompt string, credential_type string, honeytoken_id string, honeytoken_sha256 string, secret_char_span array<int>, query_char_span array<int>, payload_char_span array<int>, secret_token_span array<int>, query_token_span array<int>, payload_token_span array<int>, readout_token_indices array<int>"


def blank(name: str):
    """Null, empty or white space only."""
    return F.coalesce(F.trim(F.col(name)) == "", F.lit(True))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema + ", _corrupt_record string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def split(df: DataFrame, reason) -> tuple[DataFrame, DataFrame]:
    """``(good, bad)`` by a reason column that is null for good rows."""
    marked = df.withColumn("violation", reason)
    return marked.where("violation is null").drop("violation", "_corrupt_record"), marked.where("violation is not null")


def read_turns(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Turns from JSON lines; ids, an index, a known mode and lists are needed. Blank lines are skipped."""
    df = _read(spark, path, TURN)
    reason = F.when(F.col("_corrupt_record").isNotNull(), "corrupt")
    for c in ("trace_id", "session_id"):
        reason = reason.when(blank(c), c)
    reason = reason.when(F.col("turn_index").isNull(), "turn_index").when(~F.coalesce(F.col("capability_mode").isin(*MODES), F.lit(False)), "capability_mode").when(F.col("messages").isNull(), "messages")
    return split(df, reason)


def read_scores(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Detector scores by example id; repeated ids are bad, all of them."""
    df = _read(spark, path, SCORE)
    n = F.count(F.lit(1)).over(Window.partitionBy("example_id"))
    reason = F.when(F.col("_corrupt_record").isNotNull(), "corrupt").when(blank("example_id"), "example_id").when(F.col("detector_result.score").isNull(), "score").when(n > 1, "duplicate_example_id")
    return split(df, reason)


def read_prompts(spark: SparkSession, path: str, structured: bool = False) -> tuple[DataFrame, DataFrame]:
    """Prompts with a known label, tags and unique ids; structured ones also with ordered spans and readout windows."""
    return check_prompts(_read(spark, path, STRUCTURED if structured else PROMPT), structured)


def check_prompts(df: DataFrame, structured: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rules of :func:`read_prompts` on a DataFrame."""
    n = F.count(F.lit(1)).over(Window.partitionBy("id"))
    corrupt = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in df.columns else F.lit(False)
    reason = F.when(corrupt, "corrupt").when(blank("id"), "id").when(~F.coalesce(F.col("label").isin(*LABELS), F.lit(False)), "label").when(blank("family"), "family").when(blank("text"), "text")
    reason = reason.when(F.coalesce(F.size("tags") <= 0, F.lit(True)), "tags").when(n > 1, "duplicate_id")
    if structured:
        span = lambda c: F.coalesce((F.size(c) == 2) & (F.get(c, F.lit(0)) >= 0) & (F.get(c, F.lit(0)) < F.get(c, F.lit(1))), F.lit(False))
        for c in ("secret_char_span", "query_char_span", "secret_token_span", "query_token_span"):
            reason = reason.when(~span(c), c)
        for c in ("payload_char_span", "payload_token_span"):
            reason = reason.when(F.col(c).isNotNull() & ~span(c), c)
        r = F.col("readout_token_indices")
        reason = reason.when(F.coalesce(F.size(r) <= 0, F.lit(True)) | (F.array_min(r) < 0) | (F.array_sort(F.array_distinct(r)) != r), "readout_order")
        end = lambda c: F.get(c, F.lit(1))
        seen = F.greatest(end("secret_token_span"), end("query_token_span"))
        late = F.when(F.col("payload_token_span").isNotNull(), (F.array_min(r) >= F.get("payload_token_span", F.lit(0))) & (F.array_max(r) < end("payload_token_span")) & (F.array_max(r) >= seen - 1)).otherwise(F.array_min(r) >= F.least(end("secret_token_span"), end("query_token_span")) - 1)
        reason = reason.when(~late, "readout_window")
    return split(df, reason)


def write_detector_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Rows ``(trace_id, session_id, turn_index, example_id, detector_result)``, in a folder per component."""
    rest = [c for c in df.columns if c not in ("trace_id", "session_id", "turn_index", "example_id", "component")]
    component = F.col("component") if "component" in df.columns else F.lit("unknown")
    out = df.select("trace_id", "session_id", "turn_index", F.col("example_id") if "example_id" in df.columns else F.lit(None).cast("string").alias("example_id"), F.struct(*rest).alias("detector_result"), component.alias("component"))
    out.write.partitionBy("component").mode("append").format(fmt).save(path)


def append_audit(df: DataFrame, path: str) -> None:
    """Append audit rows, stamped now where they have no time."""
    stamped = df if "created_at" in df.columns else df.withColumn("created_at", F.current_timestamp())
    stamped.write.mode("append").parquet(path)


def newest(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest audit rows."""
    if n <= 0:
        raise ValueError("n must be positive")
    return df.orderBy(F.desc("created_at"), F.desc("trace_id"), F.desc("turn_index")).limit(n)


def recent_audit(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The ``n`` newest rows of an audit table."""
    return newest(spark.read.parquet(path), n)


def exclude_sealed(df: DataFrame, allow: bool = False, tags_col: str = "tags") -> DataFrame:
    """``df`` without rows tagged ``sealed_holdout`` or read from a path with the word ``sealed``."""
    return df if allow else df.where(~sealed(tags_col))


def sealed(tags_col: str = "tags"):
    """Whether a row is sealed."""
    path = F.lower(F.input_file_name()).rlike(r"(^|[^a-z])sealed([^a-z]|$)")
    return F.coalesce(F.array_contains(tags_col, "sealed_holdout"), F.lit(False)) | path


def assert_unsealed(df: DataFrame, tags_col: str = "tags") -> DataFrame:
    """``df``, or an error if any row is sealed."""
    if not df.where(sealed(tags_col)).isEmpty():
        raise ValueError("sealed holdout rows")
    return df
