"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, cotrain, htmltext, lexical, mixing, packing, sharding, simhash, substring, topk, toxicity, urlfilter, variants

#: Fixed rules of the URL query: (verdict, host, path).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
SHARD_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_paths() -> tuple[str, str]:
    """The tokenizer file and the rank file of the same vocabulary, as the installed package names them."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are labelled through the document whose id ends their path; bad is low quality or toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels")
    bad = F.when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1))
    path = F.regexp_extract(F.col("url"), r"^[^?#]*", 0)
    doc = F.regexp_extract(path, r"/(\d{1,18})(?:\.html?|/)?$", 1).cast("long")
    marks = pages.select("page_id", doc.alias("doc")).join(labels.select(F.col("doc_id"), bad.alias("bad")), F.col("doc") == F.col("doc_id")).select("page_id", "bad")
    return urlfilter.judge_urls(pages, marks, RULES)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of four-word shingles, linked at four bits or fewer."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of at most ``SHARD_BYTES`` bytes of text."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every text once repeated windows of twenty words are gone, as a hash."""
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest vectors found of every twentieth."""
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens."""
    packed = packing.pack(table(spark, sf_dir, "documents"), *tokenizer_paths())
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity, grade and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_cotrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document from its text and its page."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages").select("url")
    return cotrain.classify(docs, table(spark, sf_dir, "labels"), pages)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return mixing.Mix(table(spark, sf_dir, "documents")).taken()


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents of the highest score for every item of the benchmark."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its spelling variants' form."""
    return variants.variants(table(spark, sf_dir, "documents"))


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page and its number of code points."""
    return htmltext.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_simhash, op3_sharding, op4_substring, op5_ann, op6_packing, op7_toxicity, op8_topk, op9_cotrain, op10_mixing, op11_lexical, op12_variants, op13_html)}

ORACLE_SQL = {
    "op3_sharding": sharding.oracle(SHARD_BYTES),
    "op4_substring": r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    s AS (SELECT doc_id, words, CAST(unnest(range(1, len(words) - 18)) AS BIGINT) AS i FROM w WHERE len(words) >= 20),
    k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(words[i:i + 19], ' ') ORDER BY doc_id, i) AS r FROM s),
    gone AS (SELECT DISTINCT doc_id, CAST(unnest(range(i, i + 20)) AS BIGINT) AS i FROM k WHERE r > 1),
    each AS (SELECT w.doc_id, w.words[p.i] AS word, p.i AS i FROM w, LATERAL (SELECT CAST(unnest(range(1, len(w.words) + 1)) AS BIGINT) AS i) p),
    kept AS (SELECT e.doc_id, count(*) AS n_kept, string_agg(e.word, ' ' ORDER BY e.i) AS text FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i WHERE g.i IS NULL GROUP BY e.doc_id)
    SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(len(w.words) - coalesce(kept.n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (doc_id)""",
    "op8_topk": topk.ORACLE,
    "op11_lexical": lexical.ORACLE,
    "op12_variants": variants.ORACLE,
    "op13_html": htmltext.ORACLE,
}
