"""A corpus pipeline of five stages; each works on all that the one before kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canarylake.llm import jaccard, mixing, packing, substring, toxicity
from canarylake.llm.common import materialize
from canarylake.llm.queries import tokenizer_paths

#: Rows of a batch that goes to Python, at most. A task holds batches outside of its heap, and its Python process holds them again.
BATCH_ROWS = 500
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(stage):
    """``stage`` in a session whose batches for Python have at most ``BATCH_ROWS`` rows.

    They stay so, as a stage's rows are made when they are written; results do not depend on it.
    """

    @functools.wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(_ROWS)) <= BATCH_ROWS:
            spark.conf.set(_ROWS, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return bounded


@small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose severity grade is over 0 go.

    Null and empty texts are clean; rows that repeat are judged alike and each stays or goes; other columns pass unread.
    """
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, linked by Jaccard >= 0.8 of five-word shingles, one document stays.

    A document is its doc_id and the hash of its text; the least of a group stays, null ids last, and one of the rows that repeat it.
    Texts without words are copies of each other. Other columns decide only between rows that repeat.
    """
    found = jaccard.near_copies(docs, shingle=5, least=0.8)
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("kept"))
    kept = first.select(F.col("kept.doc_id").alias("kept_id"), F.col("kept.text_key").alias("kept_key"))
    rows = docs.select(F.struct(*docs.columns).alias("row"))  # so that no column's name clashes
    keyed = rows.select("row", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64("row.text").alias("key"))
    left = keyed.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")), "left_semi")
    many = found.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("many_id"), F.col("text_key").alias("many_key"))
    if many.isEmpty():
        return left.select("row.*")
    same = F.col("id").eqNullSafe(F.col("many_id")) & (F.col("key") == F.col("many_key"))
    # of rows that repeat, the least as text stays: columns may be of kinds that have no order
    one = left.join(many, same, "left_semi").groupBy("id", "key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return left.join(many, same, "left_anti").select("row.*").unionByName(one.select("row.*"))


@small_batches
def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 20 words that start earlier elsewhere go; documents left without words go too.

    Null and empty texts, and all texts without such a window, stay as they are, and so do all other columns but ``n_chars`` of cut texts.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(*rest).alias("rest")) if rest else docs.select("doc_id", "text", F.lit(None).alias("rest"))
    cut = substring.remove_repeats(packed, carry=("rest",), join_all=False)
    cut = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("rest")["n_chars"])
    return cut.select(*[F.col(c) if c in ("doc_id", "text") else (n_chars if c == "n_chars" else F.col("rest")[c]).alias(c) for c in docs.columns])


@small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; documents without words take no part.

    Null ids and sources are values of their own; rows that repeat are each taken; ``n_chars`` is that of the text taken.
    """
    return mixing.mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@small_batches
def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of the mix; each piece has its ids and the hash of its text. Null texts count as empty; other columns are not read."""
    return packing.pack(docs, *tokenizer_paths())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: The fitted model, XXH64 and the tokenizer are beyond SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
