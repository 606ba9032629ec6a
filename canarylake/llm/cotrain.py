"""A quality classifier by co-training of a text view and a page-metadata view.

Each view has its own logistic regression.  In every round each view scores all
documents, and the *other* view learns from those without a label that it is sure of: from a draw among them, over all
documents and anew in each round, of ``draw`` per view and class on average.  The views' scores are calibrated on held-out labelled
rows and added up in a last logistic regression.  Training takes at most ``max_train`` labelled documents; every document is scored.

Texts are read once: what is kept of them are the places of the chosen features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, materialize
from .features import BITS, Chosen, choose, listed, shape_features, word_features

TEXT = (word_features, shape_features)


def meta_names(docs: DataFrame, pages: DataFrame | None) -> DataFrame:
    """``docs`` with ``meta``: names of a document's metadata values.

    They are its source, language and size class, and the host, language folder, scheme and
    query of pages whose path ends in its id. Missing values have names too.
    """
    none = F.lit("-")
    size = F.coalesce(F.floor(F.log2(F.col("n_chars") + 1)).cast("string"), none)
    parts = [F.concat(F.lit("source="), F.coalesce(F.col("source"), none)), F.concat(F.lit("lang="), F.coalesce(F.col("lang"), none)), F.concat(F.lit("size="), size)]
    if pages is None:
        return docs.withColumn("meta", F.array(*parts))
    path = F.regexp_extract("url", r"^[^?#]*", 0)
    page = pages.select(F.regexp_extract(path, r"/(\d{1,18})(?:\.html?|/)?$", 1).cast("long").alias("page_doc"), "url").where("page_doc is not null")
    named = page.groupBy("page_doc").agg(F.min("url").alias("url"))
    met = docs.join(named, F.col("doc_id") == F.col("page_doc"), "left")
    parts += [F.concat(F.lit(k + "="), F.coalesce(F.nullif(F.regexp_extract("url", p, 1), F.lit("")), none)) for k, p in (("host", r"://([^/?#]*)"), ("folder", r"://[^/]*/([^/]*)/"), ("scheme", r"^(\w+):"), ("query", r"([?#]\w+)"))]
    return met.withColumn("meta", F.array(*parts)).drop("page_doc", "url")


def _meta_ids(col="meta"):
    return F.transform(col, lambda m: F.pmod(F.xxhash64(m), F.lit(1 << BITS)))


class Sparse:
    """A 0/1 matrix by rows and by columns, for products as segment sums."""

    def __init__(self, row, col, n_rows: int, n_cols: int):
        order = np.argsort(col, kind="stable")
        self.col, self.row = np.asarray(col, np.int32), np.asarray(row, np.int32)[order]
        self.row_cut, self.col_cut = np.searchsorted(row, np.arange(n_rows + 1)), np.searchsorted(np.asarray(col)[order], np.arange(n_cols + 1))

    def _sums(self, values, cut):
        total = np.concatenate([[0.0], np.cumsum(values)])
        return total[cut[1:]] - total[cut[:-1]]

    def dot(self, w):
        """Per row, the sum of the weights of its columns."""
        return self._sums(w[self.col], self.row_cut)

    def back(self, g):
        """Per column, the sum of the values of its rows."""
        return self._sums(g[self.row], self.col_cut)


def fit_logistic(x: Sparse, y, weight, theta: np.ndarray, l2: float = 1e-3, rounds: int = 200, rate: float = 0.1, small: float = 1e-3) -> np.ndarray:
    """Weights and, last, the intercept, by Adam on the weighted mean loss, from ``theta`` on, until no slope is over ``small``."""
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    weight = weight / weight.sum()
    for step in range(1, rounds + 1):
        z = x.dot(theta[:-1]) + theta[-1]
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        grad = np.append(x.back(g) + l2 * theta[:-1], g.sum())
        if np.abs(grad).max() < small:
            break
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta


@dataclass
class View:
    """One view's chosen features, its weights with the intercept last, and the scale and shift that calibrate it."""

    chosen: list[int]
    theta: np.ndarray
    scale: float = 1.0
    shift: float = 0.0


@dataclass
class CoModel:
    """Both views, and the weights ``(text, meta, constant)`` that join their calibrated log odds."""

    text: View
    meta: View
    joint: tuple[float, float, float]


def _logit_fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Newton's method for a small dense logistic regression; the constant comes last."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * len(x) * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + l2 * len(x) * w)
    return w


def _places(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(row, place)`` of packed 16-bit places."""
    raw = lists.to_pylist()
    return np.repeat(np.arange(len(raw)), [len(r) // 2 for r in raw]).astype(np.int64), np.frombuffer(b"".join(raw), "<u2").astype(np.int64)


def _packed(row: np.ndarray, place: np.ndarray, n: int, width: int) -> pa.Array:
    """The distinct places of each of n rows, packed."""
    both = np.unique(row * max(1, width) + place)
    row, place = both // max(1, width), (both % max(1, width)).astype("<u2")
    cut = np.searchsorted(row, np.arange(n + 1))
    return pa.array([place[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())


def read_texts(docs: DataFrame, chosen: list[int]) -> DataFrame:
    """``(doc_id, h, source, lang, n_chars, text)`` for every row: a hash of the row, and the places of the text's chosen features."""
    table = Chosen(chosen)
    names = ["doc_id", "h", "source", "lang", "n_chars", "text"]

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "text"):
                pairs = [k(part.column("text")) for k in TEXT]
                row, h = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
                hit, place = table.find(h)
                yield pa.record_batch([*(part.column(c) for c in names[:-1]), _packed(row[hit], place, part.num_rows, len(chosen))], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("h"), *[F.col(c).cast("string").alias(c) for c in ("source", "lang")], F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, h long, source string, lang string, n_chars long, text binary")


def _with_meta(read: DataFrame, pages: DataFrame | None, *columns: str) -> DataFrame:
    """``columns`` and ``meta``, the hashes of the metadata values; what is kept of texts is not shuffled unless it is among the columns."""
    few = read.select(*dict.fromkeys(("doc_id", "source", "lang", "n_chars", *columns)))
    return meta_names(few, pages).select(*columns, _meta_ids().alias("meta"))


def narrow_meta(rows: DataFrame, chosen: list[int], *columns: str) -> DataFrame:
    """``columns`` with ``meta``, the places of chosen metadata values in place of all their hashes."""
    table = Chosen(chosen)

    def run(batches):
        for b in batches:
            ids = b.column("meta")
            row = np.repeat(np.arange(len(ids)), np.asarray(pa.compute.list_value_length(ids)))
            hit, place = table.find(np.asarray(ids.flatten(), np.int64))
            yield pa.record_batch([*(b.column(c) for c in columns), _packed(row[hit], place, len(ids), len(chosen))], names=[*columns, "meta"])

    return rows.select(*columns, "meta").mapInArrow(run, rows.select(*columns).withColumn("meta", F.lit(None).cast("binary")).schema)


def _margin(column, theta: np.ndarray) -> np.ndarray:
    """A view's log odds for each row of packed places."""
    row, place = _places(column)
    return (np.bincount(row, weights=theta[:-1][place], minlength=len(column)) if len(row) else np.zeros(len(column))) + theta[-1]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def confident(rows: DataFrame, view: str, theta: np.ndarray, sure: float, draw: int, salt: int) -> DataFrame:
    """``(label, h, doc_id)`` of rows that a view is sure of: of all of ``rows``, about ``draw`` per class, as a hash picks them."""
    packed = rows.select("doc_id", "h", F.col(view).alias("x"))

    def sure_of(batch):
        p = _sigmoid(_margin(batch.column("x"), theta))
        return (1, np.flatnonzero(p > sure)), (0, np.flatnonzero(p < 1 - sure))

    def count(batches):
        for b in batches:
            found = sure_of(b)
            yield pa.record_batch([pa.array([c for c, _ in found], pa.int32()), pa.array([len(at) for _, at in found], pa.int64())], names=["label", "n"])

    counts = {r[0]: r[1] or 0 for r in packed.mapInArrow(count, "label int, n long").groupBy("label").agg(F.sum("n")).collect()}
    share = {c: min(1.0, draw / n) for c, n in counts.items() if n}

    def pick(batches):
        for b in batches:
            x = np.asarray(b.column("h"), np.int64).view(np.uint64)
            for c, at in sure_of(b):
                key = (x[at] + np.uint64(2 * salt + c)) * np.uint64(0x9E3779B97F4A7C15)
                some = b.take(pa.array(at[(key >> np.uint64(33)) < share.get(c, 0.0) * 2.0**31]))
                yield pa.record_batch([pa.array([c] * some.num_rows, pa.int32()), some.column("h"), some.column("doc_id")], names=["label", "h", "doc_id"])

    return packed.mapInArrow(pick, "label int, h long, doc_id long").dropDuplicates(["label", "h"])


def lessons(texts: DataFrame, metas: DataFrame, labels: DataFrame, thetas: list[np.ndarray], sure: float, draw: int, salt: int) -> list[list[tuple[bytes, int]]]:
    """What each view learns from the other: its packed places of rows that the other is sure of and that have no label, and their labels."""
    out = []
    for mine, mine_name, other, name, theta in ((texts, "text", metas, "meta", thetas[1]), (metas, "meta", texts, "text", thetas[0])):
        picks = materialize(confident(other, name, theta, sure, draw, salt), "picks")
        some = F.broadcast(picks)  # some 2 * draw rows
        known = F.broadcast(labels.join(F.broadcast(picks.select(F.col("doc_id").alias("label_id")).distinct()), "label_id", "left_semi").select(F.col("label_id").alias("doc_id")))
        rows = mine.select("h", F.col(mine_name).alias("x")).join(some, "h").join(known, "doc_id", "left_anti").dropDuplicates(["label", "h"]).orderBy("label", "h")
        out.append([(bytes(r.x), r.label) for r in rows.select("x", "label").collect()])
    return out


def _sparse(raw: list[bytes], width: int) -> Sparse:
    row, place = _places(pa.array(raw, pa.binary()))
    return Sparse(row.astype(np.int32), place, len(raw), width)


def co_train(labelled: tuple[list, list, np.ndarray], teach, widths: tuple[int, int], rounds: int = 3) -> tuple[list[np.ndarray], np.ndarray]:
    """Thetas of both views, and the rows of ``labelled`` held out for calibration.

    labelled: packed places of the text and the metadata view, and labels. ``teach(thetas, round)`` gives what the views learn from each other, at
    half weight; each round's draw takes the place of the last one's.
    """
    y = labelled[2]
    held = np.flatnonzero(np.arange(len(y)) % 4 == 3)
    fit = np.flatnonzero(np.arange(len(y)) % 4 != 3)
    thetas = [np.zeros(k + 1) for k in widths]
    taught: list[list[tuple[bytes, int]]] = [[], []]
    for step in range(rounds + 1):
        for i in (0, 1):
            x = _sparse([labelled[i][k] for k in fit] + [r for r, _ in taught[i]], widths[i])
            goal = np.append(y[fit], [float(c) for _, c in taught[i]])
            w = np.append(np.ones(len(fit)), np.full(len(taught[i]), 0.5))
            for c in (0, 1):  # both classes weigh the same
                w[goal == c] *= 0.5 / max(1e-9, w[goal == c].sum())
            thetas[i] = fit_logistic(x, goal, w, thetas[i])  # from the last round's weights on
        if step < rounds:
            taught = teach(thetas, step)
    return thetas, held


def _labels(labels: DataFrame) -> DataFrame:
    return labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min(F.col("quality").cast("int")).alias("y"))


_NOTHING = (0.0, 0.0, 0.0)


def _fit(docs: DataFrame, labels: DataFrame, pages: DataFrame | None, max_train: int, max_features: int, least_meta: int, rounds: int, draw: int, sure: float = 0.95) -> tuple[CoModel, DataFrame]:
    """The model, and what was read of all texts."""
    if max_features > 1 << 16:
        raise ValueError("places have 16 bits")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    known = every.join(_labels(labels), F.col("doc_id") == F.col("label_id")).select(F.col("doc_id").alias("d"), "y").orderBy(F.xxhash64("d"), "d").limit(max_train)
    # at most max_train ids are sent to the texts, which are not shuffled
    ids = F.broadcast(materialize(known, "cotrain_ids"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(ids, F.col("doc_id") == F.col("d"))
    sample = materialize(listed(texts.select("doc_id", "text"), TEXT).join(ids, F.col("doc_id") == F.col("d")).select("features", (1 - F.col("y")).alias("y")), "sample")
    chosen = choose(sample, max_features)
    read = materialize(read_texts(docs, chosen), "read")
    metas = materialize(_with_meta(read, pages, "doc_id", "h"), "metas")
    often = metas.select(F.explode("meta").alias("f")).groupBy("f").count().where(F.col("count") >= least_meta)
    chosen_meta = [r[0] for r in often.orderBy(F.desc("count"), "f").limit(max_features).select("f").collect()]
    metas = materialize(narrow_meta(metas, chosen_meta, "doc_id", "h"), "narrow")
    mine = read.join(ids, F.col("doc_id") == F.col("d")).groupBy("doc_id").agg(F.min(F.struct("h", "text", "y")).alias("r")).select("doc_id", "r.*")
    mine = materialize(mine, "mine")
    own = F.broadcast(mine.select("doc_id", "h"))  # at most max_train rows
    data = mine.join(metas.join(own, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]), ["doc_id", "h"]).orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "meta", "y").toPandas()
    y = data["y"].to_numpy(float) if len(data) else np.zeros(0)
    if len(y) < 8 or len(np.unique(y)) < 2:
        return CoModel(View(chosen, np.zeros(len(chosen) + 1)), View(chosen_meta, np.zeros(len(chosen_meta) + 1)), _NOTHING), read
    raw = [[bytes(v) for v in data[c]] for c in ("text", "meta")]
    widths = (len(chosen), len(chosen_meta))
    marked = _labels(labels).select("label_id")
    thetas, held = co_train((raw[0], raw[1], y), lambda thetas, step: lessons(read, metas, marked, thetas, sure, draw, step), widths, rounds)
    out = []
    for places, theta, names, k in zip(raw, thetas, (chosen, chosen_meta), widths):
        z = _sparse([places[i] for i in held], k).dot(theta[:-1]) + theta[-1]
        scale, shift = _logit_fit(z[:, None], y[held])
        out.append((View(names, theta, float(scale), float(shift)), z * scale + shift))
    joint = _logit_fit(np.column_stack([out[0][1], out[1][1]]), y[held])
    return CoModel(out[0][0], out[1][0], tuple(map(float, joint))), read


def train(docs: DataFrame, labels: DataFrame, pages: DataFrame | None = None, max_train: int = 10_000, max_features: int = 4096, least_meta: int = 20, rounds: int = 3, draw: int = 2500) -> CoModel:
    """Co-train on at most ``max_train`` labelled documents, picked by a hash of their ids, and on all others without labels.

    Null labels, and labels of null ids, count as none; of several for a document the lowest counts, and of rows that repeat an id one is learnt from.
    With under 8 labelled documents, or labels of one kind only, the model scores every document a half and so keeps it. Text features
    are the ``max_features`` most telling of the labelled sample; metadata values are the most frequent ones of all documents, of those with
    ``least_meta`` or more. ``draw``: documents per round, view and class on average, of which those without a label teach the other view. Columns beside doc_id, text, source, lang and n_chars are not read.
    """
    return _fit(docs, labels, pages, max_train, max_features, least_meta, rounds, draw)[0]


def _scored(read: DataFrame, model: CoModel, pages: DataFrame | None) -> DataFrame:
    m_table = Chosen(model.meta.chosen)
    names = ("doc_id", "source", "lang", "n_chars")

    def text(batches):
        for part in batches:
            yield pa.record_batch([*(part.column(c) for c in names), pa.array(_margin(part.column("text"), model.text.theta) * model.text.scale + model.text.shift)], names=[*names, "t"])

    def both(batches):
        for part in batches:
            ids, t = part.column("meta"), np.asarray(part.column("t"), np.float64)
            row = np.repeat(np.arange(len(ids)), np.asarray(pa.compute.list_value_length(ids)))
            hit, place = m_table.find(np.asarray(ids.flatten(), np.int64))
            m = _margin(_packed(row[hit], place, len(ids), len(model.meta.chosen)), model.meta.theta) * model.meta.scale + model.meta.shift
            p = _sigmoid(model.joint[0] * t + model.joint[1] * m + model.joint[2])
            yield pa.record_batch([part.column("doc_id"), pa.array(_sigmoid(t)), pa.array(_sigmoid(m)), pa.array(p), pa.array(p >= 0.5)], names=["doc_id", "text_score", "meta_score", "score", "keep"])

    scored = read.select(*names, "text").mapInArrow(text, "doc_id long, source string, lang string, n_chars long, t double")
    return _with_meta(scored, pages, "doc_id", "t").mapInArrow(both, "doc_id long, text_score double, meta_score double, score double, keep boolean")


def score(docs: DataFrame, model: CoModel, pages: DataFrame | None = None) -> DataFrame:
    """``(doc_id, text_score, meta_score, score, keep)`` for every row.

    Scores are probabilities of good quality: each view's calibrated one, and the joint one; ``keep`` is whether the
    joint one is at least a half. Null and empty texts are scored as texts without words, null ids as documents without a page. Rows that repeat are scored alike.
    """
    return _scored(read_texts(docs, model.text.chosen), model, pages)


def classify(docs: DataFrame, labels: DataFrame, pages: DataFrame | None = None, **options) -> DataFrame:
    """:func:`train` on documents and :func:`score` of the same ones; texts are read once for both."""
    defaults = dict(max_train=10_000, max_features=4096, least_meta=20, rounds=3, draw=2500)
    model, read = _fit(docs, labels, pages, **{**defaults, **options})
    return _scored(read, model, pages)
