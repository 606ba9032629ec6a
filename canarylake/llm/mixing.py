"""Mixing sources to target weights, with DataFrame functions only.

Every source's documents, end to end, are cut into blocks of ``block_words``
words.  The mix is a row of slots, dealt to output shards of equal size.  Every shard draws its source
counts from a multinomial with the targets as weights: each of its slots draws a source for itself.
Counts are then corrected so that every source's total is the one that meets its target: of a source drawn too often the
slots beyond its total, in an order by hash, are given to the sources drawn too seldom, as a permutation deals them.
A source's k-th slot takes the block at place ``k mod n`` of a pseudorandom
permutation of its n blocks, a new one for each pass, so no block is taken
again before all others were; slots and blocks are joined by that index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Rounds of the swap-or-not shuffle; slots of a range that meet in a join; rows that are numbered in one task.
ROUNDS, PIECE, CHUNK = 18, 8192, 4096


def permute(x, n, *key):
    """The place of ``x`` in a pseudorandom permutation of 0..n-1 named by ``key``: the swap-or-not shuffle."""

    def swap(at, r):
        pivot = F.pmod(F.xxhash64(r, n, *key), n)
        other = F.pmod(pivot - at + n, n)
        coin = F.pmod(F.xxhash64(F.greatest(at, other), r, n, *key), F.lit(2))
        return F.when(coin == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), swap)


def source_targets(sized: DataFrame, most: float = 3.0) -> DataFrame:
    """``(source, source_size, weight, target)``: weights 1, 2, 3, repeating, by code point with null last.

    All targets add up to all sizes. A target stops at ``most`` times its source's size, and the
    excess goes to the others by weight: all sources whose ratio of cap to weight is under one
    water level are capped, and the level is found from running sums in the order of that ratio.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))  # a row per source from here on
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", ((rank - 1) % 3 + 1).cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    per = per.withColumn("level", level).withColumn("place", F.row_number().over(order))
    # the first place from which on the level drowns no cap; all before it are capped
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))
    per = per.withColumn("water", F.min(fits).over(every))
    open_ = F.col("place") >= F.col("water.place")
    return per.select("source", "source_size", "weight", F.when(open_, F.col("weight") * F.col("water.level")).otherwise(F.col("cap")).alias("target"))


def numbered(rows: DataFrame, by: list[str], n: str, name: str, order: str, count: int) -> DataFrame:
    """``rows`` with ``name``: the sum of ``n`` over the rows of the same ``by`` that come before.

    The order is by a chunk of the hash of ``order`` first, and by ``order`` in it, so that no ``by`` is sorted in one task;
    ``count`` is about the number of values of ``order``.
    """
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(F.col(order), *by), F.lit(max(1, -(-count // CHUNK)))))
    inside = Window.partitionBy(*by, "chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy(*by, "chunk").agg(F.sum(n).alias("sum"))
    # a row per chunk: a small part of the rows
    base = sums.select(*by, "chunk", (F.sum("sum").over(Window.partitionBy(*by).orderBy("chunk")) - F.col("sum")).alias("base"))
    placed = rows.withColumn(name, F.sum(n).over(inside) - F.col(n)).join(base, [*by, "chunk"])
    return placed.withColumn(name, F.col(name) + F.col("base")).drop("chunk", "base")


def cut_ranges(rows: DataFrame) -> DataFrame:
    """``rows`` with ``lo`` and ``hi``, once for each ``piece`` of ``PIECE`` numbers that the range meets."""
    return rows.where("hi > lo").withColumn("piece", F.explode(F.sequence((F.col("lo") / PIECE).cast("long"), ((F.col("hi") - 1) / PIECE).cast("long"))))


def ranges(plan: DataFrame, n: str) -> DataFrame:
    """``(s, lo, hi, piece)``: the sources' shares of 0..sum(n) end to end."""
    lo = F.coalesce(F.sum(n).over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut_ranges(plan.select("s", lo.alias("lo"), (lo + F.col(n)).alias("hi")))


def hits(numbers: DataFrame, cut: DataFrame, by: list[str]) -> DataFrame:
    """``numbers`` with a column ``r``, each with the one row of ``cut`` whose range holds it."""
    return numbers.withColumn("piece", (F.col("r") / PIECE).cast("long")).join(cut, [*by, "piece"]).where("r >= lo and r < hi")


def multinomial(plan: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """``(shard, s, n)``: source counts of every shard, drawn and corrected to the totals ``k`` of ``plan(s, k)``."""
    total = plan.agg(F.sum("k")).first()[0] or 0
    spark = plan.sparkSession
    shards = -(-total // shard_slots)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total >> 20)
    slot = spark.range(0, total, 1, tasks).select((F.col("id") / shard_slots).cast("long").alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed), F.lit("draw")), F.lit(max(1, total))).alias("r"))
    count = F.count(F.lit(1)).alias("n")
    drawn = materialize(hits(slot, ranges(plan, "k"), []).groupBy("shard", "s").agg(count), "drawn")
    sums = plan.select("s", "k").join(drawn.groupBy("s").agg(F.sum("n").alias("drawn")), "s", "left").select("s", "k", F.coalesce("drawn", F.lit(0)).alias("drawn"))
    # the slots that a source has too many, anywhere among its slots
    many = sums.where("drawn > k").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("drawn") - F.col("k") - 1)))
    places = cut_ranges(numbered(drawn, ["s"], "n", "lo", "shard", shards).withColumn("hi", F.col("lo") + F.col("n")).select("shard", "s", "lo", "hi"))
    gone = materialize(hits(many.select("s", permute(F.col("j"), F.col("drawn"), F.lit(seed), F.col("s")).alias("r")), places, ["s"]).groupBy("shard", "s").agg(count), "gone")
    out = drawn.unionByName(gone.withColumn("n", -F.col("n")))
    free = gone.groupBy("shard").agg(F.sum("n").alias("free")).withColumn("all", F.lit(1))
    over = free.agg(F.sum("free")).first()[0] or 0
    if over:
        place = numbered(free, ["all"], "free", "at", "shard", shards).withColumn("j", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("free") - 1)))
        x = place.select("shard", permute(F.col("j"), F.lit(over).cast("long"), F.lit(seed), F.lit("more")).alias("r"))
        few = sums.select("s", F.greatest(F.lit(0).cast("long"), F.col("k") - F.col("drawn")).alias("more"))
        out = out.unionByName(hits(x, ranges(few, "more"), []).groupBy("shard", "s").agg(count))
    return materialize(out.groupBy("shard", "s").agg(F.sum("n").alias("n")).where("n > 0"), "counts")


#: What tells a unit of the mix from others: a document, and a copy number where rows repeat it.
_UNIT = ("doc_id", "source", "text_key", "copy")


def _copies(sized: DataFrame) -> DataFrame:
    """A row for each of the rows that repeat a document."""
    return sized.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")


class Mix:
    """The parts of a mix, as DataFrames.

    Null ids, texts and sources are values of their own; texts that are null or have no words are of size 0 and are never taken;
    rows that repeat a doc_id, a source and a text count each and are taken each on its own, by a copy number; ties of all orders are broken by hashes; an
    empty table gives empty parts; very long texts are counted whole; other columns are not read. Texts are told apart by a 64-bit hash.

    sized: ``(doc_id, source, text_key, size, copies)``, a row for all that repeat a document; sources: see :func:`source_targets`;
    spans: ``(source, block, doc_id, text_key, copy, skip, words)``, the words of documents in blocks;
    slots: ``(shard, slot, source, block)``, the mix itself.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = 128, shard_slots: int = 4096, most: int = 3, seed: int = 17, chunk_rows: int = 2_000):
        base = docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.xxhash64(text_col).alias("text_key"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        )
        self.sized = materialize(base.groupBy("doc_id", "source", "text_key").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("copies")), "sized")
        per_row = self.sized.select("source", (F.col("size") * F.col("copies")).alias("size"))
        self.sources = materialize(source_targets(per_row, most), "targets")
        rows = self.sized.agg(F.sum("copies")).first()[0] or 0
        chunks = max(1, -(-rows // chunk_rows))
        # a source's stream runs chunk by chunk, so that no source has to be sorted in one task
        mine = _copies(self.sized.where("size > 0")).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_key", "copy"), F.lit(chunks)))
        sums = mine.groupBy("source", "chunk").agg(F.sum("size").alias("n"))
        ahead = sums.select("source", "chunk", (F.sum("n").over(Window.partitionBy("source").orderBy("chunk")) - F.col("n")).alias("base"))
        inside = Window.partitionBy("source", "chunk").orderBy("doc_id", "text_key", "copy").rowsBetween(Window.unboundedPreceding, 0)
        placed = mine.withColumn("at", F.sum("size").over(inside) - F.col("size")).join(ahead.withColumnRenamed("source", "s").withColumnRenamed("chunk", "c"), F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
        placed = placed.withColumn("at", F.col("at") + F.col("base"))
        width = F.lit(block_words)
        cut = placed.withColumn("block", F.explode(F.sequence((F.col("at") / width).cast("long"), ((F.col("at") + F.col("size") - 1) / width).cast("long"))))
        skip = F.greatest(F.lit(0), F.col("block") * width - F.col("at"))
        self.spans = cut.select(*_UNIT, "block", skip.alias("skip"), (F.least(F.col("size"), (F.col("block") + 1) * width - F.col("at")) - skip).alias("words"))
        # a source of n blocks has a slot for each n-th part of its size, and at most `most` for each block
        blocks = F.ceil(F.col("source_size") / width)
        plan = self.sources.where("source_size > 0").withColumn("n", blocks).withColumn("k", F.least(F.round(F.col("target") * F.col("n") / F.col("source_size")), F.col("n") * most).cast("long"))
        plan = materialize(plan.where("k > 0").withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))), "plan")
        counts = multinomial(plan.select("s", "k"), shard_slots, seed)
        kinds, total = plan.agg(F.count(F.lit(1)), F.sum("k")).first()
        first = numbered(counts, ["s"], "n", "i", "shard", -(-(total or 0) // shard_slots)).withColumnRenamed("n", "slots")
        ahead = F.sum("slots").over(Window.partitionBy("shard").orderBy("s")) - F.col("slots")
        first = first.withColumn("place", ahead).withColumn("size", F.sum("slots").over(Window.partitionBy("shard")))
        named = plan.select("s", "source", "n")
        met = first.join(F.broadcast(named) if kinds < 100_000 else named, "s")
        each = met.withColumn("e", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
        i = F.col("i") + F.col("e")
        self.slots = each.select(
            "shard", (F.col("shard") * shard_slots + permute(F.col("place") + F.col("e"), F.col("size"), F.lit(seed), F.col("shard"))).alias("slot"), "source",
            permute(i % F.col("n"), F.col("n"), F.lit(seed), F.coalesce(F.xxhash64("source"), F.lit(0)), (i / F.col("n")).cast("long")).alias("block"),
        )

    def shard_counts(self) -> DataFrame:
        """``(shard, source, slots)``: the sources' counts in every output shard."""
        return self.slots.groupBy("shard", "source").agg(F.count(F.lit(1)).alias("slots"))

    def takes(self) -> DataFrame:
        """``(doc_id, source, text_key, copy, block, skip, words, times)``: how often the mix takes each span."""
        # slots come from the few rows of the sources, so the planner would take their counts for small
        times = self.slots.groupBy("source", "block").agg(F.count(F.lit(1)).alias("times")).hint("merge")
        on = F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))
        return self.spans.join(times.withColumnRenamed("source", "s").withColumnRenamed("block", "b"), on).select(*_UNIT, "block", "skip", "words", "times")

    def taken(self) -> DataFrame:
        """Per document ``(doc_id, source, size, source_size, target, taken)``; taken counts repeats. Every row of the documents is there once."""
        none = F.lit(None).cast("long")
        every = _copies(self.sized).select(*_UNIT, "size", F.lit(0).cast("long").alias("got"))
        got = self.takes().select(*_UNIT, none.alias("size"), (F.col("words") * F.col("times")).alias("got"))
        out = every.unionByName(got).groupBy(*_UNIT).agg(F.max("size").alias("size"), F.sum("got").alias("taken"))
        named = self.sources.withColumnRenamed("source", "s")
        named = F.broadcast(named) if self.sources.count() < 100_000 else named
        return out.join(named, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as documents: a row for each time that any of a document is taken, up to three, with all its columns.

    The k-th row holds the words of the blocks taken at least k times; where that is the whole
    document its text stays as it is, else its words are joined by one space. Documents without
    words take no part. Of rows that repeat doc_id, source and text, each gets the blocks of one copy number;
    which of them gets which does not change what the mix holds. Other cases are those of :class:`Mix`.
    """
    mix = Mix(docs, id_col, text_col, source_col, **options)
    repeats = mix.sized.where("copies > 1")
    many = not repeats.isEmpty()
    spans = mix.takes().groupBy(*_UNIT).agg(F.sort_array(F.collect_list(F.struct("block", "skip", "words", "times"))).alias("spans"))
    row = F.struct(*docs.columns).alias("row")  # so that no column's name clashes
    left = docs.select(row).select("row", F.col("row")[id_col].cast("long").alias("d"), F.col("row")[source_col].cast("string").alias("s"), F.xxhash64(F.col("row")[text_col]).alias("t"))
    same = F.col("d").eqNullSafe(F.col("doc_id")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("t") == F.col("text_key"))

    def met(rows, spans, on):
        return rows.join(spans, on).select("row", "spans")

    if not many:
        found = met(left, spans, same)
    else:
        key = repeats.select("doc_id", "source", "text_key")
        again = materialize(left.join(key, same, "left_semi").withColumn("u", F.monotonically_increasing_id()).withColumn("one", F.lit(1).cast("long")), "repeats")
        n = again.count()
        # numbered in chunks by a number of their own, so that no group of repeated rows meets in one task
        place = numbered(again.select(F.xxhash64(F.col("d").isNull(), "d", F.col("s").isNull(), "s", "t").alias("g"), "u", "one"), ["g"], "one", "copy_", "u", n)
        placed = again.join(place.select("u", "copy_"), "u")
        found = met(left.join(key, same, "left_anti"), spans, same).unionByName(met(placed, spans, same & (F.col("copy_") == F.col("copy"))))
    each = found.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.array_max(F.transform("spans", lambda s: s["times"])))))
    text = F.col("row")[text_col]
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    each = each.withColumn("chosen", F.filter("spans", lambda s: s["times"] >= F.col("k"))).withColumn("words", words)
    size = F.aggregate("chosen", F.lit(0).cast("long"), lambda a, s: a + s["words"])
    cut = F.array_join(F.flatten(F.transform("chosen", lambda s: F.slice(F.col("words"), (s["skip"] + 1).cast("int"), s["words"].cast("int")))), " ")
    kept = F.when(size == F.size("words"), text).otherwise(cut)
    return each.select(*[kept.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
