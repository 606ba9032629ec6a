"""Exact top-k by integer inner product, on bit-sliced indexes of blocks of rows.

A block of rows is a set of bitmaps: one for each bit of each quantised
component.  A query's inner products with all rows of a block are added up as
bit slices: every set bit of a query component adds the component's slices,
shifted, with carry-save adders on bitmaps.  The top k are then chosen from the
most significant slice downward; rows that still tie at the boundary are
resolved by their ids, so the answer is exact.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Whole numbers under this fit 64 bits, differences included; larger ones are held as Python's.
_WIDE = 1 << 62


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``(vec_id, q)`` with ``floor(scale * x)`` per component, as doubles that are whole.

    Rows take no part whose id or vector is null or whose vector holds a null or non-finite component. A vector that is
    shorter than others counts as filled up with zeros, so an empty one scores 0 with all.
    """
    x = F.transform(F.col(vector_col), lambda v: v.cast("double") * F.lit(float(scale)))
    # from 2**53 on every double is whole, and floor would leave 64 bits
    whole = F.transform(x, lambda v: F.when(F.abs(v) < 2.0**53, F.floor(v).cast("double")).otherwise(v))
    good = F.col(id_col).isNotNull() & F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * F.lit(float(scale))) < float("inf")))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("q"))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of whole doubles as integers, filled up with zeros; Python's own where 64 bits could not hold them."""
    n = np.asarray(pa.compute.list_value_length(lists), np.int64)
    flat = np.asarray(lists.flatten(), np.float64)
    flat = flat.astype(np.int64) if not len(flat) or np.abs(flat).max() < _WIDE else np.array([int(v) for v in flat], object)
    out = np.zeros((len(n), max(1, int(n.max()) if len(n) else 1)), flat.dtype)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def slices(q: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Bit slices of a block: minima and bit counts per column, and the planes as packed 64-bit words.

    Column d's planes hold ``q[:, d] - low[d]``, least significant first, one after the other.
    """
    low = [int(v) for v in q.min(axis=0)]
    up = q - q.min(axis=0)
    bits = np.array([int(m).bit_length() for m in up.max(axis=0)], np.int64)
    width = -(-len(q) // 64) * 8
    planes = np.zeros((int(bits.sum()), width), np.uint8)
    at = 0
    for d, n in enumerate(bits):
        for b in range(n):
            packed = np.packbits(((up[:, d] >> b) & 1).astype(np.uint8), bitorder="little")
            planes[at, : len(packed)] = packed
            at += 1
    return low, bits, planes.view(np.uint64)


def add_slices(query: list[int], low: list[int], bits: np.ndarray, planes: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Slices of all rows' inner products with ``query``, least significant first, and what to add to them.

    A negative weight adds the complement of a column: ``-w * u = w * (full - u) - w * full``. Components that only one side has are zeros.
    """
    first = np.concatenate([[0], np.cumsum(bits)])
    plus: dict[int, list[int]] = {}
    minus: dict[int, list[int]] = {}
    base = 0
    for d, w in enumerate(query[: len(low)]):
        base += w * low[d]
        n = int(bits[d])
        if w < 0:
            base += w * ((1 << n) - 1)
        side, size, shift = (plus if w > 0 else minus), abs(w), 0
        while size:
            if size & 1:
                for b in range(n):
                    side.setdefault(shift + b, []).append(int(first[d]) + b)
            size >>= 1
            shift += 1
    out, carry, weight = [], [], 0
    top = max([*plus, *minus], default=-1)
    while weight <= top or carry:
        parts = carry
        if weight in plus:
            parts = [*parts, planes[plus[weight]]]
        if weight in minus:
            parts = [*parts, ~planes[minus[weight]]]
        x = np.concatenate(parts) if parts else np.zeros((0, planes.shape[1]), np.uint64)
        carry = []
        while len(x) > 2:  # full adders, as many at a time as there are triples
            k = len(x) // 3
            a, b, c = x[:k], x[k : 2 * k], x[2 * k : 3 * k]
            ab = a ^ b
            carry.append((a & b) | (ab & c))
            x = np.concatenate([ab ^ c, x[3 * k :]])
        if len(x) == 2:
            carry.append(x[:1] & x[1:])
            x = x[:1] ^ x[1:]
        out.append(x[0] if len(x) else np.zeros(planes.shape[1], np.uint64))
        weight += 1
    return out, base


def select_top(total: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k largest rows among ``allowed``, ties to the smaller index; all rows if fewer."""
    sure, tied = np.zeros_like(allowed), allowed
    have = 0
    for plane in reversed(total):
        high = tied & plane
        n = int(np.bitwise_count(high).sum())
        if have + n > k:
            tied = high
        else:
            sure, tied, have = sure | high, tied & ~plane, have + n
            if have == k:
                return _places(sure)
    return np.sort(np.concatenate([_places(sure), _places(tied)[: k - have]]))


def _places(bitmap: np.ndarray) -> np.ndarray:
    words = np.flatnonzero(bitmap)
    bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, col = np.nonzero(bits)
    return words[row] * 64 + col


def build_index(rows: DataFrame, block_rows: int = 16_384) -> DataFrame:
    """One row per block: ``(block, ids, low, bits, planes)``, packed; ids ascend."""
    n = max(1, -(-rows.count() // block_rows))

    def build(table: pa.Table) -> pa.Table:
        ids = np.asarray(table["vec_id"], dtype=np.int64)
        q = _matrix(table["q"].combine_chunks())
        order = np.argsort(ids, kind="stable")
        low, bits, planes = slices(q[order])
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "ids": [ids[order].tobytes()], "low": [",".join(map(str, low))], "bits": [bits.tobytes()], "planes": [planes.tobytes()]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "q"), F.lit(n)).cast("int"))
    return materialize(dealt.groupBy("block").applyInArrow(build, "block int, ids binary, low string, bits binary, planes binary"), "slices")


class _Block:
    """One block's slices, and the answers it has for queries."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.low, self.bits = [int(v) for v in row["low"].split(",")], np.frombuffer(row["bits"], np.int64)
        width = -(-len(self.ids) // 64)
        self.planes = np.frombuffer(row["planes"], np.uint64).reshape(-1, width)
        everyone = np.packbits(np.ones(len(self.ids), np.uint8), bitorder="little")
        self.everyone = np.pad(everyone, (0, width * 8 - len(everyone))).view(np.uint64)

    def top(self, vec_id: int, q: list[float], k: int) -> tuple[list[int], list[int]]:
        """Ids and scores of the k best rows with another id."""
        total, base = add_slices([int(v) for v in q], self.low, self.bits, self.planes)
        allowed = self.everyone.copy()
        for own in range(*np.searchsorted(self.ids, [vec_id, vec_id + 1])):
            allowed[own >> 6] &= ~np.uint64(1 << (own & 63))
        top = select_top(total, allowed, k)
        bits = [((plane[top >> 6] >> (top & 63).astype(np.uint64)) & np.uint64(1)).tolist() for plane in total]
        return self.ids[top].tolist(), [base + sum(b[i] << w for w, b in enumerate(bits)) for i in range(len(top))]


#: The largest score that is told from larger ones.
_LARGEST = 10**38 - 1


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block_rows: int = 16_384, batch: int = 128) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k highest integer inner products, ties to smaller ids.

    Queries are the rows whose id ``every`` divides; candidates are all rows with another id.
    Rows that repeat an id count as so many candidates, and the least of their vectors asks. A score beyond 64 bits ranks
    where it belongs (alike from 38 digits on) and is null. Rows outside :func:`quantised` take no part; other columns are ignored.

    Blocks are shuffled once, whatever the number of queries, and stay with a task while batches of queries pass; only where there
    are fewer blocks than tasks are they copied to some more.
    """
    rows = materialize(quantised(vectors, id_col, vector_col, scale), "quantised")
    index = build_index(rows, block_rows)
    n = index.count()
    salts = max(1, -(-2 * vectors.sparkSession.sparkContext.defaultParallelism // max(1, n)))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("q").alias("q"))
    parts = max(1, -(-asked.count() // batch))
    asked = asked.groupBy(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int").alias("part")).agg(F.collect_list(F.struct("vec_id", "q")).alias("queries"))
    numbers = lambda m: F.sequence(F.lit(0), F.lit(m - 1))
    blocks = index.select("block", F.explode(numbers(salts)).alias("salt"), F.struct("ids", "low", "bits", "planes").alias("slices"))
    # block numbers are 0 up to the number that the rows were dealt to; those without rows have no slices
    dealt = max(1, -(-rows.count() // block_rows))
    asked = asked.select(F.explode(numbers(dealt)).alias("block"), F.pmod("part", F.lit(salts)).cast("int").alias("salt"), "queries")
    both = blocks.withColumn("queries", F.lit(None).cast(asked.schema["queries"].dataType)).unionByName(asked, allowMissingColumns=True)
    both = both.repartition(dealt * salts, "block", "salt").sortWithinPartitions("block", "salt", F.col("slices").isNull())

    def search(batches):
        at, block = None, None
        for rb in batches:
            out: list[list] = [[], [], []]
            for i in range(rb.num_rows):
                row = rb.slice(i, 1).to_pylist()[0]
                if row["slices"] is not None:
                    at, block = row["block"], _Block(row["slices"])
                elif row["block"] == at:
                    for query in row["queries"]:
                        ids, scores = block.top(query["vec_id"], query["q"], k)
                        out[0] += [query["vec_id"]] * len(ids)
                        out[1] += ids
                        out[2] += [Decimal(max(-_LARGEST, min(_LARGEST, v))) for v in scores]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.decimal128(38, 0)))], names=["query_id", "vec_id", "score"])

    found = both.mapInArrow(search, "query_id long, vec_id long, score decimal(38,0)")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").try_cast("long").alias("score"))


ORACLE = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings),
    p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda t: t[1] * t[2])) AS BIGINT) AS score
          FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
