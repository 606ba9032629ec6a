"""Sharding by extendible hashing: a directory over hash-prefix bits, deepened only where buckets are too large."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bits of the hash that the directory may use, and how many one pass looks at.
BITS, STEP = 60, 12


def hash_bits(key):
    """The first 60 bits of the key's MD5 as a whole number (null: of the empty string)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(h, depth):
    """The first ``depth`` bits."""
    return F.shiftright(h, F.lit(BITS) - depth) if isinstance(depth, int) else F.expr(f"shiftright({h}, {BITS} - {depth})")


def directory(cells: DataFrame, limit: int) -> DataFrame:
    """Shards ``(depth, prefix, shard_bytes, shard_docs)`` of weighted hashes ``(h, bytes, docs)``.

    All hashes begin in one bucket; only buckets over ``limit`` bytes split on another
    bit. A pass sums every prefix of the next ``STEP`` bits at once, and later passes look only
    at what still lies in oversized buckets. What shares all ``BITS`` bits stays together.
    """
    rest, base, parts = cells, 0, []
    while True:
        to = min(base + STEP, BITS)
        sums = rest.groupBy(F.shiftright("h", BITS - to).alias("p")).agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
        tree = sums.select(F.explode(F.sequence(F.lit(base), F.lit(to))).alias("depth"), "p", "bytes", "docs")
        tree = tree.groupBy("depth", F.expr(f"shiftright(p, {to} - depth)").alias("prefix")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
        fits = F.col("shard_bytes") <= limit
        nodes = materialize(tree.withColumn("fits", fits if to < BITS else fits | (F.col("depth") == BITS)), "directory")
        over = nodes.where("not fits").select(F.col("depth").alias("d"), F.col("prefix").alias("pre"))
        # a node is a shard if it fits and its parent does not; the root of a pass had to be split already
        parent_over = nodes.alias("n").join(over, (F.col("n.depth") == F.col("d") + 1) & (F.shiftright("n.prefix", 1) == F.col("pre")), "left_semi")
        top = nodes.where(F.col("depth") == base) if base == 0 else nodes.where("false")
        parts.append(parent_over.unionByName(top).where("fits").select("depth", "prefix", "shard_bytes", "shard_docs"))
        deep = over.where(F.col("d") == to)
        if to == BITS or deep.isEmpty():
            break
        rest = rest.join(deep, F.shiftright("h", BITS - to) == F.col("pre"), "left_semi")
        base = to
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return materialize(out, "shards")


def assign_shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, bytes, shard, part, depth, shard_bytes)`` for every row.

    ``shard`` is the bit string of the shard's prefix; ``shard_bytes`` sums the UTF-8 bytes of its texts (null: 0)
    and is at most ``limit``. Rows that share all bits (one key repeated) and exceed the
    limit together are cut into ``part`` 0, 1, ... by running size; a text over half the limit has a part of its own there.
    An empty table gives no shards. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes")).withColumn("h", hash_bits(F.col("doc_id")))
    rows = materialize(rows, "keys")
    shards = directory(rows.select("h", "bytes", F.lit(1).alias("docs")), limit)
    depths = sorted(r[0] for r in shards.select("depth").distinct().collect())  # at most BITS + 1 numbers
    keys = F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("h", BITS - d).alias("prefix")) for d in depths]) if depths else F.array()
    if not depths:
        return rows.select("doc_id", "bytes", F.lit("").alias("shard"), F.lit(0).alias("part"), F.lit(0).alias("depth"), F.col("bytes").alias("shard_bytes"))
    # the directory has at most two entries for each `limit` bytes of text; it is joined, not sent to all
    met = rows.withColumn("k", F.explode(keys)).select("doc_id", "bytes", "h", "k.depth", "k.prefix").join(shards, ["depth", "prefix"])
    name = F.substring(F.lpad(F.bin("prefix"), BITS, "0"), BITS + 1 - F.col("depth"), F.col("depth"))
    met = met.withColumn("shard", F.when(F.col("depth") == 0, "").otherwise(name))
    fine = met.where(F.col("shard_bytes") <= limit).withColumn("part", F.lit(0))
    # small rows by running size over half the limit, so that none exceeds it; larger rows have parts of their own
    run, every = Window.partitionBy("h").orderBy("bytes").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("h")
    small = F.col("bytes") * 2 <= limit
    ahead = F.floor(F.coalesce(F.max(F.when(small, F.col("ends") - F.col("bytes"))).over(every), F.lit(0)) * 2 / limit)
    over = met.where(F.col("shard_bytes") > limit).withColumn("ends", F.sum("bytes").over(run))
    over = over.withColumn("part", F.when(small, F.floor((F.col("ends") - F.col("bytes")) * 2 / limit)).otherwise(ahead + F.sum(F.when(small, 0).otherwise(1)).over(run)).cast("int"))
    over = over.withColumn("shard_bytes", F.sum("bytes").over(Window.partitionBy("h", "part")))
    return fine.unionByName(over.select(*fine.columns)).select("doc_id", "bytes", "shard", "part", "depth", "shard_bytes")


#: DuckDB SQL for :func:`assign_shards` where no key repeats.
def oracle(limit: int) -> str:
    return f"""
    WITH k AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
    t AS (SELECT k.doc_id, k.bytes, d.depth, k.h >> ({BITS} - d.depth) AS prefix FROM k, (SELECT CAST(unnest(range(0, 41)) AS INTEGER) AS depth) d),
    s AS (SELECT depth, prefix, CAST(sum(bytes) AS BIGINT) AS shard_bytes FROM t GROUP BY ALL),
    f AS (SELECT t.doc_id, t.bytes, t.depth, t.prefix, s.shard_bytes, row_number() OVER (PARTITION BY t.doc_id ORDER BY t.depth) AS r
          FROM t JOIN s USING (depth, prefix) WHERE s.shard_bytes <= {limit})
    SELECT doc_id, bytes, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(prefix), {BITS}, '0'), depth) END AS shard,
           CAST(0 AS INTEGER) AS part, depth, shard_bytes FROM f WHERE r = 1"""
