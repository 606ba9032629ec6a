"""Sparse text features by hashing, and the choice of the features that matter."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, by_bytes

#: Feature hashes have so many bits; a batch has fewer texts than the rest of 63 bits can count.
BITS = 48


class Chosen:
    """The chosen features: finds their places in arrays of hashes.

    Features are chained by their last ``SLOTS`` bits, so two that share these are both found.
    """

    SLOTS = 20

    def __init__(self, features: list[int]):
        features = np.array(features, np.int64).reshape(-1)
        slots = features & ((1 << self.SLOTS) - 1)
        self.place = np.argsort(slots, kind="stable")
        self.features = features[self.place]
        self.first = np.full(1 << self.SLOTS, -1, np.int32)
        at, start, self.length = np.unique(slots[self.place], return_index=True, return_counts=True)
        self.first[at] = start
        self.chain = int(self.length.max()) if len(at) else 0

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``h`` are chosen, in order, and their places."""
        start = self.first[h & ((1 << self.SLOTS) - 1)]
        maybe = np.flatnonzero(start >= 0)
        start, want = start[maybe], h[maybe]
        found = np.full(len(maybe), -1, np.int64)
        for k in range(self.chain):
            at = np.minimum(start + k, len(self.features) - 1)
            hit = self.features[at] == want
            found[hit] = self.place[at[hit]]
        hit = found >= 0
        return maybe[hit], found[hit]


def word_features(texts: pa.Array, stems: tuple = (4, 5, 7)) -> tuple[np.ndarray, np.ndarray]:
    """``(text, feature)`` for every lower-cased word of letters and digits, and for the words' first bytes."""
    w = Words(texts, marks=True, lower=True)
    text = w.text_of()
    out = [(text, w.hashes())]
    for n in stems:
        long = np.flatnonzero(w.end - w.start > n)
        out.append((text[long], w.hashes(w.start[long], w.start[long] + n) + np.uint64(n)))
    h = np.concatenate([x[1] for x in out]) >> np.uint64(64 - BITS)
    return np.concatenate([x[0] for x in out]), h.astype(np.int64)


#: Classes of bytes whose share of a text counts.
_SHARES = {"upper": range(65, 91), "digit": range(48, 58), "mark": [c for c in range(33, 127) if not chr(c).isalnum()], "space": (9, 10, 13, 32), "other": range(128, 256)}
_LOG_STEPS = 12


def shape_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(text, feature)`` for runs of marks, and for binned shares of kinds of bytes, word lengths and repeated words."""
    w = Words(texts)
    n = len(w.off) - 1
    size = np.maximum(1, np.diff(w.off))
    text = w.text_of()
    # the first two and the last two bytes of each word, where they are marks or digits
    is_mark = np.array([c < 128 and not chr(c).isalpha() for c in range(256)])
    out_t, out_h = [], []
    for at, back in ((w.start, 0), (w.end, 1)):
        ends = np.flatnonzero((w.end - w.start >= 2) & is_mark[w.data[np.maximum(at - back, 0)]]) if len(at) else np.zeros(0, np.int64)
        s = w.start[ends] if not back else w.end[ends] - 2
        out_t.append(text[ends])
        out_h.append(w.hashes(s, s + 2) + np.uint64(101 + back))
    table = np.zeros((len(_SHARES), 256), bool)
    for i, codes in enumerate(_SHARES.values()):
        table[i, list(codes)] = True
    shares = []
    for i in range(len(_SHARES)):
        sums = np.concatenate([[0], np.cumsum(table[i][w.data])])
        shares.append((sums[w.off[1:]] - sums[w.off[:-1]]) / size)
    words = np.diff(w.first)
    distinct = np.zeros(n)
    if len(text):
        pair = np.unique(text.astype(np.uint64) << np.uint64(40) ^ (w.hashes() >> np.uint64(24)))
        distinct = np.bincount((pair >> np.uint64(40)).astype(np.int64) % max(n, 1), minlength=n)[:n]
    shares.append(distinct / np.maximum(words, 1))
    values = [np.floor(-np.log2(np.maximum(s, 2.0**-_LOG_STEPS)) * 2) for s in shares]
    values += [np.floor(np.log2(size) * 2), np.floor(np.log2(words + 1) * 2), np.minimum(40, size // np.maximum(1, words))]
    for i, v in enumerate(values):
        out_t.append(np.arange(n))
        out_h.append((v.astype(np.uint64) + np.uint64(1000 * (i + 1))) * np.uint64(0x9E3779B97F4A7C15))
    h = np.concatenate(out_h) >> np.uint64(64 - BITS)
    return np.concatenate(out_t), h.astype(np.int64)


def listed(rows: DataFrame, kinds: tuple, id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, features)``, each feature once: the sparse row of every document of a training sample."""

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "text"):
                pairs = [k(part.column("text")) for k in kinds]
                text, h = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
                both = np.unique(text << BITS | h)
                text, h = both >> BITS, both & ((1 << BITS) - 1)
                cut = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.record_batch([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(cut), pa.array(h))], names=["doc_id", "features"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, features array<long>")


def choose(sample: DataFrame, most: int = 4096, least_docs: int = 4, only_for: bool = False, least_chi: float = 10.8) -> list[int]:
    """The features most unlike between the rows with ``y`` > 0 and the others, at most ``most``.

    They are ranked by the chi-square statistic of presence; counts are summed by Spark. ``only_for`` leaves
    out features that speak against ``y`` > 0. The cuts keep the fit on the bounded labelled sample from learning
    chance: features in under ``least_docs`` rows, or whose statistic is under ``least_chi`` (p = 0.001), are left out.
    """
    totals = sample.agg(F.count(F.lit(1)), F.sum((F.col("y") > 0).cast("int"))).first()
    n, pos = totals[0], totals[1] or 0
    if not n or pos in (0, n):
        return []
    each = sample.select(F.explode("features").alias("f"), (F.col("y") > 0).cast("int").alias("p"))
    counts = each.groupBy("f").agg(F.count(F.lit(1)).alias("c"), F.sum("p").alias("a")).where(F.col("c") >= least_docs)
    a, c = F.col("a").cast("double"), F.col("c").cast("double")
    chi = (a * n - c * pos) * (a * n - c * pos) / (c * pos * (n - c + 1e-9) * (n - pos)) * n
    if only_for:
        counts = counts.where(a * n > c * pos)
    top = counts.withColumn("chi", chi).where(F.col("chi") > least_chi).orderBy(F.desc("chi"), "f").limit(most)
    return [r[0] for r in top.select("f").collect()]


def matrix(places: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(row, column)`` from the packed places of :func:`narrowed`."""
    rows = np.repeat(np.arange(len(places), dtype=np.int32), [len(p) // 4 for p in places]) if len(places) else np.zeros(0, np.int32)
    return rows, np.frombuffer(b"".join(places), "<i4")


def narrowed(sample: DataFrame, chosen: dict[str, Chosen], *others: str) -> DataFrame:
    """``sample`` with, for each column of features in ``chosen``, the places of its chosen ones as packed 32-bit numbers.

    ``n_features`` is the number of the first column's features before. Numbers are packed, as the driver
    holds the sample while it fits.
    """

    def run(batches):
        for b in batches:
            out = []
            for i, c in enumerate(chosen.values()):
                lists = b.column(i)
                n = np.asarray(pa.compute.list_value_length(lists), np.int64)
                hit, place = c.find(np.asarray(lists.flatten(), np.int64))
                cut = np.searchsorted(np.repeat(np.arange(len(lists)), n)[hit], np.arange(len(lists) + 1))
                out.append(pa.array([place[x:y].astype("<i4").tobytes() for x, y in zip(cut, cut[1:])], pa.binary()))
                if not i:
                    size = pa.array(n)
            yield pa.record_batch([*out, size, *b.columns[len(chosen) :]], names=[*chosen, "n_features", *others])

    rows = sample.select(*chosen, *others)
    out = rows.withColumn("n_features", F.lit(0).cast("long")).withColumns({c: F.lit(None).cast("binary") for c in chosen}).select(*chosen, "n_features", *others).schema
    return rows.mapInArrow(run, out)


def linear_scores(texts: pa.Array, kinds: tuple, chosen: Chosen, weights: np.ndarray) -> np.ndarray:
    """Sums of the weights of the chosen features that each text has."""
    if not len(weights):
        return np.zeros(len(texts))
    pairs = [k(texts) for k in kinds]
    text, h = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
    hit, col = chosen.find(h)
    both = np.unique(text[hit] * len(weights) + col)
    return np.bincount(both // len(weights), weights=weights[both % len(weights)], minlength=len(texts))
