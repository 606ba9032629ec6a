"""Checks of files, features and stored models against what they claim."""

from __future__ import annotations

import hashlib
import re
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import BY_SLUG, SETS, formats_df


def validate_lineage(datasets: DataFrame, artifacts: DataFrame, reports: DataFrame, files: DataFrame) -> DataFrame:
    """``(kind, id, violation)`` of manifests against ``files(path, sha256)``: hashes, missing files, keys, repeated ids."""
    out = None
    for kind, df in (("dataset", datasets), ("artifact", artifacts), ("report", reports)):
        met = df.select("id", "path", F.col("sha256").alias("claimed")).join(files.select("path", "sha256"), "path", "left")
        bad = met.select("id", F.when(F.col("sha256").isNull(), "missing_file").when(F.lower("claimed") != F.col("sha256"), "hash_mismatch").alias("violation")).where("violation is not null")
        bad = bad.unionByName(df.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate_id").alias("violation")))
        bad = bad.select(F.lit(kind).alias("kind"), "id", "violation")
        out = bad if out is None else out.unionByName(bad)
    for kind, df, col, parent in (("artifact", artifacts, "dataset_id", datasets), ("report", reports, "dataset_id", datasets), ("report", reports, "artifact_id", artifacts)):
        lost = df.where(F.col(col).isNotNull()).join(parent.select(F.col("id").alias("pid")), F.col(col) == F.col("pid"), "left_anti")
        out = out.unionByName(lost.select(F.lit(kind).alias("kind"), "id", F.lit(f"unknown_{col}").alias("violation")))
    return out


#: Bytes that are read at a time of a file that does not go into a row.
_CHUNK = 8 << 20


def file_hashes(spark: SparkSession, path: str, whole: int = 64 << 20) -> DataFrame:
    """``(path, sha256)`` of every file below ``path``, relative to it, whatever the files' sizes.

    Files of up to ``whole`` bytes are read by Spark's reader, one to a row, from any store that Spark knows. Larger ones are dealt out by name and
    streamed through the hash in chunks, so a task holds one chunk; their store must be one that pyarrow can open too.
    Files without bytes are none to Spark's readers, and so are not listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.where(F.col("length") <= whole).select("path", F.sha2("content", 256).alias("sha256"))

    def run(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            yield pa.record_batch([batch.column(0), pa.array([_streamed(n) for n in names], pa.string())], names=["path", "sha256"])

    large = files.where(F.col("length") > whole).select("path").repartition("path").mapInArrow(run, "path string, sha256 string")
    plain = lambda p: re.sub(r"^\w+:/*", "/", p).rstrip("/")  # noqa: E731  a scheme is followed by one slash or more
    below = F.substring(F.regexp_replace("path", r"^\w+:/+", "/"), len(plain(path)) + 2, 1 << 20)
    return small.unionByName(large).select(below.alias("path"), "sha256")


def _streamed(name: str) -> str:
    """The SHA-256 of a file that is read in chunks."""
    local = re.match(r"^file:/+", name)  # the names that Spark gives are not encoded
    store, where = (fs.LocalFileSystem(), "/" + name[local.end() :]) if local else fs.FileSystem.from_uri(quote(name, safe=":/@"))
    total = hashlib.sha256()
    with store.open_input_stream(where) as stream:
        while chunk := stream.read(_CHUNK):
            total.update(chunk)
    return total.hexdigest()


def validate_features(features: DataFrame, rows: DataFrame) -> DataFrame:
    """``(feature_key, violation, n)``: widths that differ, and examples missing from or unknown to the row table."""
    per = features.groupBy("feature_key").agg(F.min(F.size("vector")).alias("lo"), F.max(F.size("vector")).alias("hi"))
    width = per.where("lo <> hi").select("feature_key", F.lit("width").alias("violation"), (F.col("hi") - F.col("lo")).cast("long").alias("n"))
    have = features.select("feature_key", "example_id").distinct()
    extra = have.join(rows.select("example_id"), "example_id", "left_anti").groupBy("feature_key").agg(F.count(F.lit(1)).alias("n")).select("feature_key", F.lit("unknown_example").alias("violation"), "n")
    wanted = rows.select("example_id").distinct().crossJoin(F.broadcast(per.select("feature_key")))
    missing = wanted.join(have, ["feature_key", "example_id"], "left_anti").groupBy("feature_key").agg(F.count(F.lit(1)).alias("n")).select("feature_key", F.lit("missing_example").alias("violation"), "n")
    return width.unionByName(extra).unionByName(missing)


MODEL_SCHEMA = "1"


def write_transitions(transitions: DataFrame, meta: DataFrame, path: str, force: bool = False) -> None:
    """Store a model: ``transitions(format, state, next_char, prob)`` and ``meta(format, epsilon, clip, corpus_size, train_seed)``."""
    mode = "overwrite" if force else "errorifexists"
    transitions.write.mode(mode).parquet(f"{path}/transitions")
    hashes = formats_df(meta.sparkSession).select("format", "spec_hash")
    meta.join(F.broadcast(hashes), "format", "left").withColumn("schema_version", F.lit(MODEL_SCHEMA)).write.mode(mode).parquet(f"{path}/meta")


def check_transitions(transitions: DataFrame, meta: DataFrame) -> DataFrame:
    """``(format, violation)`` of a stored model; any violation means that it must not be used."""
    spark = meta.sparkSession
    known = formats_df(spark).select("format", F.col("spec_hash").alias("want"))
    m = meta.join(F.broadcast(known), "format", "left")
    reasons = F.array_compact(F.array(
        F.when(~F.col("schema_version").eqNullSafe(F.lit(MODEL_SCHEMA)), "schema_version"), F.when(F.col("want").isNull(), "unknown_format"), F.when(~F.col("spec_hash").eqNullSafe(F.col("want")), "spec_hash"),
        F.when(~F.coalesce(F.col("epsilon") > 0, F.lit(False)), "epsilon"), F.when(~F.coalesce(F.col("clip") > 0, F.lit(False)), "clip")))
    bad = m.select("format", F.explode(reasons).alias("violation"))
    letters = [(s, c) for s, f in BY_SLUG.items() for c in sorted({c for seg in f.segments if isinstance(seg, tuple) for c in SETS[seg[0]]})]
    alphabet = spark.createDataFrame(letters, "format string, c string")
    p = F.col("prob")
    row_bad = transitions.where(p.isNull() | F.isnan(p) | (p < 0) | (p == float("inf"))).select("format", F.lit("probability").alias("violation"))
    sums = transitions.groupBy("format", "state").agg(F.sum("prob").alias("s")).where(~F.coalesce(F.abs(F.col("s") - 1) <= 1e-6, F.lit(False))).select("format", F.lit("row_sum").alias("violation"))
    target = transitions.select("format", F.col("next_char").alias("c")).join(F.broadcast(alphabet), ["format", "c"], "left_anti").select("format", F.lit("alphabet").alias("violation"))
    state = transitions.where("state <> '<START>'").select("format", F.col("state").alias("c")).join(F.broadcast(alphabet), ["format", "c"], "left_anti").select("format", F.lit("alphabet").alias("violation"))
    orphan = transitions.select("format").join(meta.select("format"), "format", "left_anti").select("format", F.lit("no_metadata").alias("violation"))
    out = bad
    for x in (row_bad, sums, target, state, orphan):
        out = out.unionByName(x)
    return out.distinct()


def load_transitions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(transitions, violations)``; the transitions are empty unless there are no violations."""
    transitions, meta = spark.read.parquet(f"{path}/transitions"), spark.read.parquet(f"{path}/meta")
    violations = check_transitions(transitions, meta)
    return (transitions if violations.isEmpty() else transitions.where("false")), violations
