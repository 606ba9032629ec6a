"""Exact removal of repeated word windows, found through difference-cover anchors.

``COVER`` is a difference cover modulo ``PERIOD``: for any two positions there
is a shift below the period after which both lie at cover positions.  Two
equal windows of ``window`` words thus share an aligned anchor of
``window - PERIOD + 1`` words at cover positions of both.  Only anchors are
hashed and dealt over the cluster; where one repeats, the windows around it
are hashed in full (96 bits) and dealt again, and each window but the first of
its kind marks the words it covers.

Hashes travel as packed arrays, one row for each (batch, bucket).  A hash that
repeats inside a batch is sent once, so the copies of a passage that many
documents hold never meet in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Words, by_bytes, windows

PERIOD = 13
#: A perfect difference set: every residue modulo 13 is a difference of two of these.
COVER = (0, 1, 3, 9)
#: Stands for a null doc_id, which comes after all others.
_LAST = np.iinfo(np.int64).max

#: Bytes of text that are hashed at a time.
_PART = 1 << 20

_IN_COVER = np.isin(np.arange(PERIOD), COVER)


_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
#: Columns of packed entries, and those that are stored as differences.
_TYPES = {"h": np.uint64, "low": np.uint64, "h2": np.uint32, "doc": np.int64, "tag": np.int32, "pos": np.int32}
_STEPS = ("doc", "tag", "pos")


def _squeeze(cols: dict) -> bytes:
    """Equally long columns as one compressed value; ``low`` keeps the low 40 bits only."""
    parts = [np.array([len(next(iter(cols.values())))], np.int64).tobytes()]
    for name, x in cols.items():
        if name in _STEPS:
            x = np.diff(x, prepend=x.dtype.type(0))
        raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)
        parts.append(np.ascontiguousarray(raw[:, :5] if name == "low" else raw).T.tobytes())
    return _ZIP.compress(b"".join(parts))


def _unsqueeze(blobs: list[bytes], names: tuple) -> list[np.ndarray]:
    """The columns of many values, end to end."""
    out: list[list] = [[np.zeros(0, _TYPES[n])] for n in names]
    for blob in blobs:
        data = np.frombuffer(_UNZIP.decompress(blob), np.uint8)
        n, at = int(data[:8].view(np.int64)[0]), 8
        for k, name in enumerate(names):
            size = np.dtype(_TYPES[name]).itemsize
            have = 5 if name == "low" else size
            raw = np.zeros((n, size), np.uint8)
            raw[:, :have] = data[at : at + n * have].reshape(have, n).T
            at += n * have
            x = raw.reshape(-1).view(_TYPES[name])
            out[k].append(np.cumsum(x, dtype=x.dtype) if name in _STEPS else x)
    return [np.concatenate(x) for x in out]


def _split(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by key, and where each of the keys 0..n-1 begins in it."""
    order = np.argsort(keys, kind="stable")
    return order, np.searchsorted(keys[order], np.arange(n + 1))


def _dealt(keys: np.ndarray, n: int, cols: dict) -> list[tuple[int, bytes]]:
    """``(key, packed columns)`` for each key that there is."""
    order, cuts = _split(keys, n)
    cols = {c: x[order] for c, x in cols.items()}
    return [(i, _squeeze({c: x[cuts[i] : cuts[i + 1]] for c, x in cols.items()})) for i in np.flatnonzero(np.diff(cuts)).tolist()]


def _ids(column) -> np.ndarray:
    return np.asarray(column.fill_null(_LAST), dtype=np.int64)


_ASKED = ("h", "h2", "doc", "tag", "pos")
_ASKED_LOW = ("low", "doc", "pos")
_TOLD = ("doc", "tag", "pos")
#: Packed bytes of known positions that are passed on together.
_TOLD_BYTES = 4 << 20
_DEAL = "bucket int, kind int, entries binary"


class _Deal:
    """Rows ``(bucket, kind, entries)`` in the making: kind 0 asks a bucket about hashes, kind 1 tells what is known.

    Entries gather over many parts of text before they are dealt, so that what a bucket gets at a time does not shrink much as buckets grow in number.
    """

    MANY = 1 << 20

    def __init__(self, buckets: int):
        self.n = buckets
        self.asked: list[dict] = []
        self.told: list[dict] = []
        self.size = 0

    def ask(self, h, **cols) -> None:
        """Entries whose other occurrences may be elsewhere, by their hash."""
        self.asked.append({"h": h, **cols})
        self.size += len(h)

    def tell(self, doc, tag, pos) -> None:
        """Positions that are known already."""
        if len(doc):
            self.told.append({"doc": doc, "tag": tag, "pos": pos})
            self.size += len(doc)

    @property
    def full(self) -> bool:
        return self.size >= self.MANY

    def batch(self) -> pa.RecordBatch:
        """What has gathered, which is then forgotten."""
        rows: list[tuple] = []
        if self.asked:
            cols = {c: np.concatenate([x[c] for x in self.asked]) for c in self.asked[0]}
            bucket = (cols["h"] >> np.uint64(40)).astype(np.int64) % self.n
            if "h2" not in cols:
                cols = {"low": cols.pop("h"), **cols}
            rows += [(i, 0, x) for i, x in _dealt(bucket, self.n, cols)]
        if self.told:
            cols = {c: np.concatenate([x[c] for x in self.told]) for c in ("doc", "tag", "pos")}
            rows.append((int(cols["doc"][0] % self.n), 1, _squeeze(cols)))
        self.asked, self.told, self.size = [], [], 0
        out = list(zip(*rows)) or [[]] * 3
        return pa.record_batch([pa.array(list(c), k) for c, k in zip(out, (pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "kind", "entries"])


def _anchors(batch: pa.RecordBatch, deal: _Deal, size: int) -> None:
    """Hash the anchors of a batch ``(doc, tag, text)``."""
    w = Words(batch.column(2))
    if len(w.start) < size:
        return
    text = w.text_of()
    at = np.arange(len(text) - size + 1)
    pos = (at - w.first[text[at]]).astype(np.int32)
    keep = (text[at] == text[at + size - 1]) & _IN_COVER[pos % PERIOD]
    h = windows(w.hashes(), size)[keep]
    text, pos = text[at][keep], pos[keep]
    doc = _ids(batch.column(0))[text]
    tag = np.zeros(len(doc), np.int32)
    _, first, where, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    one = count[where] == 1
    lead = np.zeros(len(h), bool)
    lead[first] = True
    # of a hash that repeats here, one goes on as a question: it has to tell others that it exists
    ask = lead
    deal.ask(h[ask], doc=doc[ask], pos=pos[ask])
    deal.tell(doc[~one], tag[~one], pos[~one])


def _windows(docs: list[pa.RecordBatch], flags: dict, deal: _Deal, size: int, anchor: int) -> None:
    """Hash the windows of the documents that hold a flagged anchor.

    flags: rows ``(doc, pos)``, sorted.
    """
    for batch in docs:
        hs, h2s, ds, ts, ps = [], [], [], [], []
        for part in by_bytes(batch, "text", _PART):
            w = Words(part.column("text"))
            ids, tags = _ids(part.column("doc")), np.asarray(part.column("tag"), dtype=np.int32)
            if len(w.start) < size:
                continue
            n_words = np.diff(w.first)
            lo, hi = np.searchsorted(flags["doc"], ids), np.searchsorted(flags["doc"], ids, side="right")
            take = np.repeat(np.arange(len(ids)), hi - lo)
            if not len(take):
                continue
            which = np.arange(len(take)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
            pos = flags["pos"][which].astype(np.int64)
            fits = n_words[take] >= size
            take, pos = take[fits], pos[fits]
            # windows that hold the whole anchor: those that start up to size - anchor words before it
            begin = w.first[take] + np.clip(pos - (size - anchor), 0, n_words[take] - size + 1)
            after = w.first[take] + np.clip(pos + 1, 0, n_words[take] - size + 1)
            step = np.zeros(len(w.start) + 1, np.int32)
            np.add.at(step, begin, 1)
            np.add.at(step, after, -1)
            at = np.flatnonzero(np.cumsum(step[:-1]) > 0)
            if not len(at):
                continue
            words = w.hashes()
            text = w.text_of()[at]
            hs.append(windows(words, size)[at])
            h2s.append((windows(words, size, salt=1)[at] >> np.uint64(32)).astype(np.uint32))
            ds.append(ids[text])
            ts.append(tags[text])
            ps.append((at - w.first[text]).astype(np.int32))
        if hs:
            h, h2, doc, tag, pos = map(np.concatenate, (hs, h2s, ds, ts, ps))
            lead, dup = _first(h, h2, doc, pos)
            deal.ask(h[lead], h2=h2[lead], doc=doc[lead], tag=tag[lead], pos=pos[lead])
            deal.tell(doc[dup], tag[dup], pos[dup])


def _first(h, h2, doc, pos) -> tuple[np.ndarray, np.ndarray]:
    """Of each hash, the first entry by (doc, pos); and the entries that come strictly later."""
    order = np.lexsort((pos, doc, h2, h))
    h, h2, d, p = h[order], h2[order], doc[order], pos[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else np.zeros(0, np.int64)
    later = (d != d[lead]) | (p != p[lead])
    return order[new | ~later] if len(h) else order, order[later]


def _emit(out: list, groups: int, doc, tag, pos) -> None:
    """Rows ``(g, entries)``, dealt to the groups that hold the documents."""
    out += _dealt(_group(doc, groups), groups, {"doc": doc, "tag": tag, "pos": pos})


_PRIME, _MULT = (1 << 31) - 1, 1_103_515_245


def _group(doc: np.ndarray, groups: int) -> np.ndarray:
    """The same as :func:`_group_col`."""
    return doc % _PRIME * _MULT % _PRIME % groups


def _group_col(doc, groups: int):
    return (F.pmod(doc, F.lit(_PRIME)) * F.lit(_MULT) % F.lit(_PRIME) % F.lit(groups)).cast("int")


_ROWS = "g int, entries binary"


def _rows(out: list) -> pa.Table:
    cols = list(zip(*out)) or [[]] * 2
    return pa.table([pa.array(list(c), k) for c, k in zip(cols, (pa.int32(), pa.binary()))], names=["g", "entries"])


def _answered(table: pa.Table, groups: int, out: list, names: tuple) -> list[np.ndarray]:
    """Pass on what is known; the bucket's questions are returned."""
    blobs = {k: table.filter(pa.compute.equal(table["kind"], k))["entries"].to_pylist() for k in (0, 1)}
    some, size = [], 0
    for i, blob in enumerate(blobs[1]):
        some.append(blob)
        size += len(blob)
        if size > _TOLD_BYTES or i == len(blobs[1]) - 1:
            _emit(out, groups, *_unsqueeze(some, _TOLD))
            some, size = [], 0
    return _unsqueeze(blobs[0], names)


def _texts(table: pa.Table) -> list[pa.RecordBatch]:
    """The documents of a group, as they were packed."""
    out = []
    for blob in table["docs"].to_pylist():
        with pa.ipc.open_stream(blob) as reader:
            out += list(reader)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, carry: tuple = (), join_all: bool = True, piece_bytes: int = 8 << 20) -> DataFrame:
    """Remove each word that a window covers whose word sequence also starts earlier.

    Earlier means in a smaller doc_id, or in the same document at an earlier word. Windows are
    judged on the input. Windows are held to be equal where two hashes of 96 bits together are. Returns ``id_col``, ``text_col`` with the kept words joined by one space
    (where nothing was removed the text stays as it is, unless ``join_all``), ``n_words``,
    ``n_removed`` and the columns in ``carry``; other columns are not read. Null texts have no words
    and stay null unless ``join_all``; a null doc_id comes after all others. Rows that repeat both
    doc_id and text are one document and get equal results; rows that share a doc_id only are told
    apart, and neither is earlier than the other at an equal start.

    piece_bytes: about how much text or packed hashes one task holds at a time.
    """
    if window < PERIOD + 1:
        raise ValueError(f"window must be over {PERIOD} words")
    anchor = window - PERIOD + 1
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(1, -(-total // piece_bytes))
    key = F.col(id_col).cast("long")
    base = docs.select(
        _group_col(F.coalesce(key, F.lit(int(_LAST))), n).alias("g"),
        key.alias("doc"),
        F.pmod(F.xxhash64(text_col), F.lit((1 << 31) - 1)).cast("int").alias("tag"),
        F.col(text_col).alias("text"),
        F.struct(F.col(id_col).alias("id"), *[F.col(c) for c in carry]).alias("rest"),
    )

    def pack_texts(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            order, cuts = _split(np.asarray(batch.column(0), np.int64), n)
            rows = batch.select(["doc", "tag", "text", "rest"])
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                part = rows.take(pa.array(order[cuts[i] : cuts[i + 1]]))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=options) as writer:
                    writer.write_batch(part)
                yield pa.record_batch([pa.array([i], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["g", "docs"])

    def hash_anchors(batches):
        deal = _Deal(n)
        for batch in batches:
            for part in by_bytes(batch, "text", 2 * _PART):
                _anchors(part, deal, anchor)
                if deal.full:
                    yield deal.batch()
        yield deal.batch()

    def repeated(table: pa.Table) -> pa.Table:
        out: list = []
        h, doc, pos = _answered(table, n, out, _ASKED_LOW)
        order = np.argsort(h, kind="stable")
        s = h[order]
        twice = np.zeros(len(s), bool)
        same = s[1:] == s[:-1]
        twice[1:] |= same
        twice[:-1] |= same
        hit = np.sort(order[twice])
        _emit(out, n, doc[hit], np.zeros(len(hit), np.int32), pos[hit])
        return _rows(out)

    def hash_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        deal = _Deal(n)
        doc, _, pos = _unsqueeze(right["entries"].to_pylist(), _TOLD)
        order = np.lexsort((pos, doc))
        if len(doc):
            _windows(_texts(left), {"doc": doc[order], "pos": pos[order]}, deal, window, anchor)
        return pa.Table.from_batches([deal.batch()])

    def later(table: pa.Table) -> pa.Table:
        out: list = []
        h, h2, doc, tag, pos = _answered(table, n, out, _ASKED)
        _, dup = _first(h, h2, doc, pos)
        dup = np.sort(dup)
        _emit(out, n, doc[dup], tag[dup], pos[dup])
        return _rows(out)

    rest_type = [(f.name, f.dataType) for f in base.schema["rest"].dataType.fields]

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, tag, pos = _unsqueeze(right["entries"].to_pylist(), _TOLD)
        order = np.lexsort((tag, doc))
        doc, tag, pos = doc[order], tag[order], pos[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
        begin = np.append(np.flatnonzero(new), len(doc)).tolist()
        where = {(int(doc[a]), int(tag[a])): (a, b) for a, b in zip(begin, begin[1:])}
        done = []
        for batch in _texts(left):
            texts, n_words, n_removed = [], [], []
            ids, tags = _ids(batch.column("doc")).tolist(), batch.column("tag").to_pylist()
            for i, t, text in zip(ids, tags, batch.column("text").cast(pa.large_binary())):
                raw = text.as_py()
                words = (raw or b"").split()
                at = where.get((i, t))
                gone = 0
                if at:
                    step = np.zeros(len(words) + 1, np.int32)
                    starts = pos[at[0] : at[1]]
                    np.add.at(step, starts, 1)
                    np.add.at(step, starts + window, -1)
                    kept = np.cumsum(step[:-1]) == 0
                    gone = len(words) - int(kept.sum())
                    raw = b" ".join([words[k] for k in np.flatnonzero(kept).tolist()])
                elif join_all:
                    raw = b" ".join(words)
                texts.append(raw)
                n_words.append(len(words))
                n_removed.append(gone)
            done.append(pa.record_batch([batch.column("rest"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=["rest", "text", "n_words", "n_removed"]))
        return pa.Table.from_batches(done) if done else empty

    packed = base.mapInArrow(pack_texts, "g int, docs binary")
    flags = base.select("doc", "tag", "text").mapInArrow(hash_anchors, _DEAL).groupBy("bucket").applyInArrow(repeated, _ROWS)
    found = packed.groupBy("g").cogroup(flags.groupBy("g")).applyInArrow(hash_windows, _DEAL)
    marks = found.groupBy("bucket").applyInArrow(later, _ROWS)
    out_type = base.select("rest", "text").withColumn("n_words", F.lit(0).cast("long")).withColumn("n_removed", F.lit(0).cast("long")).schema
    empty = to_arrow_schema(out_type).empty_table()
    done = packed.groupBy("g").cogroup(marks.groupBy("g")).applyInArrow(cut, out_type)
    names = [c for c, _ in rest_type[1:]]
    return done.select(F.col("rest.id").alias(id_col), F.col("text").alias(text_col), *[F.col("rest")[c].alias(c) for c in names], "n_words", "n_removed")
