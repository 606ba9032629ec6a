"""Toxicity as a severity grade: cumulative-link ordinal regression on sparse text features.

``P(grade > k) = sigmoid(w . x - cut[k])`` with one weight vector for all cuts and cuts in order; the
expected severity is the sum of these over k.  The model is fitted on at most ``max_train`` labelled
documents; everything else is done for all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, materialize
from .features import Chosen, choose, linear_scores, listed, matrix, narrowed, word_features

KINDS = (word_features,)


@dataclass
class OrdinalModel:
    """Weights of the chosen features, and the ordered cuts between grades."""

    chosen: list[int]
    weights: np.ndarray
    cuts: np.ndarray

    def above(self, z: np.ndarray) -> np.ndarray:
        """``P(grade > k)`` per row and cut."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.cuts[None, :], -40, 40)))


def fit_ordinal(row: np.ndarray, col: np.ndarray, grade: np.ndarray, n_features: int, grades: int, l2: float = 3e-5, rounds: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the cumulative-link model by Adam: ``(weights, cuts)``.

    The first cut is free and the gaps to the next are exponentials, so the cuts stay in order. Each
    cut is a logistic regression of ``grade > k`` among rows of grade k or k + 1 and beyond, all with the same weights;
    the likelihood of a grade is the difference of two neighbouring cumulative probabilities.
    """
    n = len(grade)
    share = [max(1e-3, min(1 - 1e-3, float((grade > k).mean()))) for k in range(grades - 1)]
    cuts = np.maximum.accumulate(np.array([-np.log(s / (1 - s)) for s in share]) + np.arange(grades - 1) * 1e-3)
    theta = np.concatenate([np.zeros(n_features), [cuts[0]], np.log(np.maximum(1e-2, np.diff(cuts)))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    weight = np.full(n, 1 / max(1, n))  # not balanced, so that little evidence leaves a document clean

    def unpack(t):
        return t[:n_features], t[n_features] + np.concatenate([[0], np.cumsum(np.exp(t[n_features + 1 :]))])

    for step in range(1, rounds + 1):
        w, c = unpack(theta)
        z = np.bincount(row, weights=w[col], minlength=n) if len(row) else np.zeros(n)
        s = 1 / (1 + np.exp(-np.clip(z[:, None] - c[None, :], -40, 40)))  # P(grade > k)
        full = np.concatenate([np.ones((n, 1)), s, np.zeros((n, 1))], axis=1)
        p = np.maximum(1e-12, full[np.arange(n), grade] - full[np.arange(n), grade + 1])
        slope = np.concatenate([np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))], axis=1)
        up, down = slope[np.arange(n), grade], slope[np.arange(n), grade + 1]
        g = -weight * (up - down) / p
        grad_w = np.bincount(col, weights=g[row], minlength=n_features) + l2 * w
        grad_c = np.zeros(grades - 1)
        np.add.at(grad_c, np.clip(grade - 1, 0, None)[grade > 0], (weight * up / p)[grade > 0])
        np.add.at(grad_c, grade[grade < grades - 1], (-weight * down / p)[grade < grades - 1])
        tail = np.cumsum(grad_c[::-1])[::-1]
        grad = np.concatenate([grad_w, [tail[0]], tail[1:] * np.exp(theta[n_features + 1 :])])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return unpack(theta)


def out_of_fold(row: np.ndarray, col: np.ndarray, toxic: np.ndarray, n_features: int, rounds: int = 150) -> np.ndarray:
    """Each row's score by a two-grade model that was fitted on the other half of the rows."""
    half, score = np.arange(len(toxic)) % 2, np.zeros(len(toxic))
    for f in (0, 1):
        fit, place = np.flatnonzero(half != f), np.cumsum(half != f) - 1
        mine = half[row] != f
        weights, _ = fit_ordinal(place[row[mine]], col[mine], toxic[fit], n_features, 2, rounds=rounds)
        z = np.bincount(row[~mine], weights=weights[col[~mine]], minlength=len(toxic))
        score[half == f] = z[half == f]
    return score


def train(docs: DataFrame, labels: DataFrame, grade_col: str | None = None, grades: int = 4, max_train: int = 20_000, max_features: int = 4096) -> OrdinalModel:
    """Fit on at most ``max_train`` labelled documents, picked by a hash of their ids.

    ``grade_col`` of ``labels`` holds grades 0..grades-1. Where labels only say toxic or not, toxic
    rows are graded 1..grades-1 by their score under a model that was fitted on other labelled rows (:func:`out_of_fold`),
    in equal parts: grades then say how strongly the labels of other documents speak against one.
    Labels that are null, or have a null id, are left out; of several for a document the gravest counts. Rows of
    ``docs`` that repeat an id are all learnt from; null texts count as empty ones. Without labelled rows of
    both kinds the model finds nothing toxic. Columns beside ``doc_id`` and ``text`` are not read.
    """
    y = F.col(grade_col or "toxic").cast("int")
    graded = labels.where(y.isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(y).alias("y"))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(graded, F.col("doc_id") == F.col("label_id")).select("doc_id", "y").distinct()
    ids = materialize(named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train), "labelled")
    # at most max_train ids are sent to the texts, which are not shuffled
    asked = F.broadcast(ids.select(F.col("doc_id").alias("d"), "y"))
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(asked, F.col("doc_id") == F.col("d"))
    sample = materialize(listed(picked.select("doc_id", "text"), KINDS).join(asked, F.col("doc_id") == F.col("d")).select("doc_id", "features", "y"), "sample")
    chosen = choose(sample, max_features, only_for=True)
    lists = Chosen(chosen)
    rows = narrowed(sample, {"features": lists}, "y", "doc_id").orderBy("doc_id", "features").toPandas()
    if not len(rows) or not chosen or rows["y"].nunique() < 2:
        return OrdinalModel([], np.zeros(0), np.full(grades - 1, 40.0))
    row, col = matrix(rows["features"].tolist())
    grade = rows["y"].to_numpy().clip(0, grades - 1)
    if grade_col is None:
        toxic = (grade > 0).astype(np.int64)
        bad = np.flatnonzero(toxic)
        score = out_of_fold(row, col, toxic, len(chosen))
        ranks = np.argsort(np.argsort(score[bad], kind="stable"), kind="stable")
        grade = np.zeros(len(grade), np.int64)
        grade[bad] = 1 + ranks * (grades - 1) // len(bad)
    weights, cuts = fit_ordinal(row, col, grade, len(chosen), grades)
    return OrdinalModel(chosen, weights, cuts)


class _Judge:
    """Severity, grade and verdict of texts."""

    def __init__(self, model: OrdinalModel, least: float):
        self.model, self.least, self.table = model, least, Chosen(model.chosen)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        above = self.model.above(linear_scores(texts, KINDS, self.table, self.model.weights))
        full = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1)
        likeliest = np.argmax(full[:, :-1] - full[:, 1:], axis=1)
        toxic = above[:, 0] >= self.least
        return above.sum(axis=1), np.where(toxic, np.maximum(likeliest, 1), 0).astype(np.int32), toxic


def severity(docs: DataFrame, model: OrdinalModel, carry: tuple = (), least: float = 0.5) -> DataFrame:
    """``(doc_id, severity, grade, toxic)`` and the columns in ``carry``, for every row.

    ``severity`` is the expected grade, ``grade`` the likeliest, ``toxic`` whether a grade over 0 has
    at least the probability ``least``.
    Null and empty texts have no features and get the score of none; whole texts are read. Null and repeated ids stay as they are.
    Carried columns may not have the names of the results.
    """
    names = ["doc_id", *carry, "severity", "grade", "toxic"]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError("a carried column has the name of a result")
    judge = _Judge(model, least)

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "text"):
                value, grade, toxic = judge(part.column("text"))
                yield pa.record_batch([*(part.column(i) for i in range(1, part.num_columns)), pa.array(value), pa.array(grade), pa.array(toxic)], names=names)

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("__id"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)])
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry)
    return rows.mapInArrow(run, kept.withColumn("severity", F.lit(0.0)).withColumn("grade", F.lit(0)).withColumn("toxic", F.lit(False)).schema)


def keep_clean(docs: DataFrame, model: OrdinalModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that :func:`severity` does not call toxic, with all their columns, whatever their names.

    Texts go to Python and back once, in pieces, and rejected ones do not come back.
    """
    judge, names = _Judge(model, least), docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "text"):
                yield part.filter(pa.array(~judge(part.column(at))[2]))

    return docs.mapInArrow(run, docs.schema)
