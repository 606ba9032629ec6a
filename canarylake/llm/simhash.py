"""SimHash near-duplicates: fingerprints of word shingles, linked through BK-trees.

Fingerprints within ``radius`` bits agree on at least ``blocks - radius`` of
``blocks`` bit blocks.  Every fingerprint goes to one shard for each choice of
so many blocks, keyed by its bits there, so that each linked pair meets in a
shard.  In a shard the fingerprints form a BK-tree, whose children are keyed
by their Hamming distance to the parent; a search follows only edges within
the radius.  Shards over ``shard_size`` are cut into parts, and every pair of
parts meets, so nothing is dropped.  A tree travels to the tasks that search
it; what grows with the corpus is never broadcast.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize

_LANE = (np.arange(8) * 256).astype(np.int64)
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BLOCK = 1 << 16


def majority(blocks) -> int:
    """The 64-bit SimHash of hashes, given in arrays: a bit is set if it is set in over half of them; 0 for none."""
    counts, n = np.zeros((8, 8), np.int64), 0
    for h in blocks:
        lanes = np.ascontiguousarray(h, "<u8").view(np.uint8).reshape(-1, 8) + _LANE
        counts += np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS
        n += len(h)
    set_bits = (2 * counts.ravel() > n).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of one text; 0 where it has no words.

    A bit is set if it is set in over half of the shingles' XXH64 values.
    """
    words = (text or b"").lower().split()  # for bytes: A-Z, and the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n = max(1, len(words) - shingle + 1)
    last = end[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest

    def hashes():
        for at in range(0, n, _BLOCK):
            a, b = start[at : min(n, at + _BLOCK)].tolist(), last[at : min(n, at + _BLOCK)].tolist()
            yield np.fromiter([digest(joined[x:y], seed) for x, y in zip(a, b)], "<u8", len(a))

    return majority(hashes())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``(doc_id, fp)`` for every row; null and blank texts get 0. Other columns are not read."""

    def run(batches):
        for batch in batches:
            out = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None, shingle) for x in batch.column(1).cast(pa.large_binary())]
            yield pa.record_batch([batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """A BK-tree of 64-bit integers under Hamming distance."""

    def __init__(self):
        self.root: int | None = None
        self.children: dict[int, dict[int, int]] = {}

    def add(self, x: int) -> None:
        """Hang ``x`` below the node at whose distance no child hangs yet."""
        if self.root is None:
            self.root, self.children[x] = x, {}
            return
        at = self.root
        while at != x:
            d = (at ^ x).bit_count()
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = x
                self.children[x] = {}
                return
            at = below

    def within(self, x: int, radius: int) -> list[int]:
        """Every member at most ``radius`` bits from ``x``."""
        if self.root is None:
            return []
        found, stack = [], [self.root]
        while stack:
            at = stack.pop()
            d = (at ^ x).bit_count()
            if d <= radius:
                found.append(at)
            kids = self.children[at]
            if kids:
                lo, hi = d - radius, d + radius
                stack.extend([c for k, c in kids.items() if lo <= k <= hi])
        return found


def shard_links(members: list[int], probes: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links inside ``members``, or between them and ``probes`` if there are any.

    Links that join what earlier links already joined are left out, so a
    group of n near copies gives n - 1 edges.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p] if p in parent else p
            x = parent[x]
        return x

    tree, edges = BKTree(), []

    def search(x: int) -> None:
        for y in tree.within(x, radius):
            a, b = root(x), root(y)
            if a != b:
                parent[a] = b
                edges.append((x, y))

    if not probes:
        for x in members:
            search(x)
            tree.add(x)
    else:
        for x in members:
            tree.add(x)
        for x in probes:
            search(x)
    return edges


def link(prints: DataFrame, radius: int = 4, shard_size: int = 2048) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all pairs of distinct ``fp`` within ``radius`` bits."""
    n = prints.count()
    blocks = radius + 1
    while blocks < radius + 4 and n > 64 << (64 * (blocks - radius) // blocks):
        blocks += 1  # more, narrower shards for more fingerprints; every choice is complete
    cut = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cut, cut[1:])]
    masks = [sum(c) for c in combinations(parts, blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(signed)])).alias("s")).select("fp", "s.t", "s.k")
    sizes = keyed.groupBy("t", "k").count().where("count > 1").select("t", "k", F.ceil(F.col("count") / shard_size).cast("int").alias("cuts"))
    mine = keyed.join(sizes, ["t", "k"]).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
    met = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    groups = met.groupBy("t", "k", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q")).agg(
        F.collect_list(F.when(F.col("mine") <= F.col("other"), F.col("fp"))).alias("members"),
        F.collect_list(F.when(F.col("mine") > F.col("other"), F.col("fp"))).alias("probes"),
        F.first(F.col("mine") == F.col("other")).alias("same"),
    )

    def run(batches):
        for batch in batches:
            a, b = [], []
            for members, probes, same in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if same or (members and probes):
                    for x, y in shard_links(sorted(v & (2**64 - 1) for v in members), sorted(v & (2**64 - 1) for v in probes), radius):
                        a.append(x)
                        b.append(y)
            yield pa.record_batch([pa.array(np.array(v, np.uint64).view(np.int64)) for v in (a, b)], names=["a", "b"])

    return groups.select("members", "probes", "same").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row: components of texts whose SimHashes link.

    ``component_id`` is the least doc_id that links reach. Copies of one text, and
    repeated rows, share a fingerprint and a component. Null and blank texts
    share fingerprint 0. Rows with a null doc_id keep it; a component of only
    such rows has a null id. Columns beside the two are ignored.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    heads = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("head")), "heads")
    roots = components(link(heads, radius))
    rooted = heads.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "head", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("head").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
