"""Shared helpers: written tables that cut lineage, connected components, word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and \t \n \v \f \r.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: The same as a regular expression for Spark and Python.
WORD = r"[^\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``; where that is unset, a local one, and only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="canarylake-")
    return "file://" + _own_dirs[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts the lineage.

    A lost executor then costs a reread, not a rerun of what came before.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/canarylake/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 999_983)).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges ``(a, b)``: rows ``(node, root)``, root the least node.

    Alternates the large-star and small-star rewrites until the edges stand
    still, which takes a number of rounds near the log of the longest path.
    Each round aggregates and joins; no component is gathered in one place.
    Nodes without edges do not appear.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(now, "edges")
    seen = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        state = _state(now)
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = state


# ---------------------------------------------------------------- words as arrays

_M64 = (1 << 64) - 1


def _splitmix(x: np.ndarray) -> np.ndarray:
    """Mix 64-bit integers so that every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE = _splitmix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
#: For features: every ASCII byte that is no letter or digit separates.
_IS_MARK = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])

_powers: dict[int, list] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base and of its inverse, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _powers[base] = out
    return have[0][:n], have[1][:n]


class Words:
    """Word spans of a batch of texts, as flat arrays.

    ``first[i]:first[i + 1]`` are the words of text ``i``; ``start`` and ``end`` are
    their byte spans in ``data``, the texts' UTF-8 bytes end to end. Null texts have none.
    """

    def __init__(self, texts: pa.Array, marks: bool = False, lower: bool = False):
        texts = texts.cast(pa.large_binary())
        if texts.null_count:
            texts = texts.fill_null(b"")
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.data = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and len(off) and off[-1] > off[0] else np.zeros(0, np.uint8)
        self.off = off - off[0]
        n = len(self.data)
        sep = (_IS_MARK if marks else _IS_SPACE)[self.data]
        begin, finish = np.empty(n, bool), np.empty(n, bool)
        if n:
            begin[1:], finish[:-1] = sep[:-1], sep[1:]
            full = self.off[1:] > self.off[:-1]
            begin[self.off[:-1][full]] = True
            finish[self.off[1:][full] - 1] = True
            begin &= ~sep
            finish &= ~sep
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.start, self.off)
        self._lower = lower
        self._sums = None

    def text_of(self) -> np.ndarray:
        """The text's index for each word."""
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.first))

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of byte spans, of the words unless others are given."""
        start, end = (self.start, self.end) if start is None else (start, end)
        up, down = _power(0xD6E8FEB86659FD93, len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((_LOWER if self._lower else _BYTE)[self.data] * up[:-1], out=self._sums[1:])
        h = (self._sums[end] - self._sums[start]) * down[start]
        return _splitmix(h + (end - start).astype(np.uint64) * _STEP)


def windows(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hashes of every ``size`` consecutive entries of ``words`` (across texts; the caller drops those)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power(0xA0761D6478BD642F, len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    w = _splitmix(words + np.uint64(salt) * _STEP) if salt else words
    np.cumsum(w * up, out=sums[1:])
    return _splitmix((sums[size:] - sums[:-size]) * down[:n])


def by_bytes(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Slices of a batch with about ``most`` bytes in ``column`` each, so that arrays stay small."""
    size = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0), dtype=np.int64) + 1
    total = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
