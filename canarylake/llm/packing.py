"""Packing tokenised documents into fixed windows, with bounded space.

Each partition packs its documents as they come: full windows are cut off long
documents, and what remains goes best-fit into one of ``open_windows`` open
windows.  When none fits and no more may be opened, the fullest is emitted,
topped up with the piece's head so that nothing is padded.  At its end a
partition merges its open windows into full ones and at most one leftover;
leftovers of 64 partitions at a time are merged in the same way, until one is left.
"""

from __future__ import annotations

import base64
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Pieces are not cut below this many ids to fill a window; at most so many places stay empty instead.
MIN_CUT = 16
_MERGED = 1 << 62
_TREE = 64
_SCHEMA = "part int, sequence_id long, doc_id long, text_key long, start long, length long, offset long, doc_tokens long, ids binary, leftover boolean"


class ByteBPE:
    """Ids of the byte-level BPE in a tokenizers file.

    ranks: the same vocabulary as a rank file. Texts in Latin script without special tokens are then
    encoded from it, which gives the same ids in a quarter of the time.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.other = re.compile("|".join(["[^\x00-\u024f]", *map(re.escape, special)]))
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text."""
        out = [np.asarray(self.fast.encode_to_numpy(t, disallowed_special=()), "<u4") if self.fast and not self.other.search(t) else None for t in texts]
        slow = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(slow, self.tok.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False)):
            out[i] = np.array(e.ids, "<u4")
        return out


_tokenizers: dict[str, ByteBPE] = {}


def _tokenizer(path: str, ranks: str | None) -> ByteBPE:
    """One for each worker process, so that its cache lasts over tasks."""
    if path not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _tokenizers[path] = ByteBPE(path, ranks)
    return _tokenizers[path]


class Packer:
    """Open windows of one partition; finished pieces gather in ``rows``."""

    def __init__(self, size: int, open_windows: int, first_id: int, part: int):
        self.size, self.most, self.next, self.part = size, open_windows, first_id, part
        self.open: list[list] = []  # [used, [piece, ...]]
        self.rows: list[tuple] = []

    def _close(self, pieces: list[tuple], leftover: bool = False) -> None:
        at = 0
        for (doc, key), start, ids, n_doc in pieces:
            self.rows.append((self.part, self.next, doc, key, start, len(ids), at, n_doc, ids.tobytes(), leftover))
            at += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        """Place one document; ``doc`` is its id and the hash of its text."""
        n, at = len(ids), 0
        while n - at >= self.size:
            self._close([(doc, at, ids[at : at + self.size], n)])
            at += self.size
        if n > at:
            self._place((doc, at, ids[at:], n))

    def _place(self, piece: tuple) -> None:
        doc, start, ids, n = piece
        while True:
            length = len(ids)
            fit = [w for w in self.open if self.size - w[0] >= length]
            if fit:
                w = max(fit, key=lambda w: w[0])
                w[0] += length
                w[1].append((doc, start, ids, n))
                if w[0] == self.size:
                    self.open.remove(w)
                    self._close(w[1])
                return
            if len(self.open) < self.most:
                self.open.append([length, [(doc, start, ids, n)]])
                return
            w = max(self.open, key=lambda w: w[0])
            self.open.remove(w)
            gap = self.size - w[0]
            if gap >= MIN_CUT and length - gap >= MIN_CUT:
                w[1].append((doc, start, ids[:gap], n))
                start, ids = start + gap, ids[gap:]
            self._close(w[1])

    def finish(self, last: bool = False) -> None:
        """Merge the open windows, fullest first; the rest is a leftover unless this is the last merge."""
        now, used = [], 0
        for w in sorted(self.open, key=lambda w: -w[0]):
            for doc, start, ids, n in w[1]:
                while used + len(ids) >= self.size:
                    k = self.size - used
                    self._close([*now, (doc, start, ids[:k], n)])
                    now, used, start, ids = [], 0, start + k, ids[k:]
                if len(ids):
                    now.append((doc, start, ids, n))
                    used += len(ids)
        if now:
            self._close(now, not last)
        self.open = []

    def table(self) -> pa.RecordBatch:
        """The finished pieces, which are then forgotten."""
        kinds = [pa.int32(), *[pa.int64()] * 7, pa.binary(), pa.bool_()]
        cols = list(zip(*self.rows)) or [[]] * 10
        self.rows = []
        return pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in _SCHEMA.split(", ")])


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, open_windows: int = 64, end_id: int = 1) -> DataFrame:
    """Pieces ``(doc_id, text_key, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset)`` that tile all documents.

    ``ids`` are a piece's token ids, as little-endian unsigned 32-bit integers, and ``ids_crc32`` is their CRC; the ids of
    a ``sequence_id`` by ``offset`` are its window. ``text_key`` is the text's XXH64 in Spark, which tells apart the texts of one doc_id.

    A document is its text's ids and then ``end_id``; null texts count as empty and give one id.
    ``sequence_id`` is unique to a window of at most ``size`` ids, ``offset`` a piece's place there,
    gapless from 0. Every window but the last of all misses at most ``MIN_CUT`` places or so. Rows that repeat
    are packed once each; a null doc_id stays null; other columns are ignored.
    Memory: one batch of texts, and ``open_windows`` windows, whatever the number of documents.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        packer, end = Packer(size, open_windows, part << 32, part), np.array([end_id], "<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                texts = [x or "" for x in piece.column(2).to_pylist()]
                for doc, ids in zip(zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()), _tokenizer(tokenizer, ranks).encode(texts)):
                    packer.add(doc, np.append(ids, end))
                yield packer.table()
        packer.finish()
        yield packer.table()

    first = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _SCHEMA)
    level = materialize(first, "packed")
    done, depth = level.where("not leftover"), 0
    while True:
        left = level.where("leftover")
        top = left.agg(F.max("part")).first()[0]
        if top is None:
            break
        last = top < _TREE

        def merge(table: pa.Table) -> pa.Table:
            table = table.sort_by([("part", "ascending"), ("offset", "ascending")])
            group = table["part"][0].as_py() // _TREE
            packer = Packer(size, 0, _MERGED + (depth << 56) + (group << 20), group)
            pieces = [((d, k), s, np.frombuffer(i, "<u4"), n) for d, k, s, i, n in zip(*(table[c].to_pylist() for c in ("doc_id", "text_key", "start", "ids", "doc_tokens")))]
            packer.open = [[sum(len(p[2]) for p in pieces), pieces]]
            packer.finish(last)
            return pa.Table.from_batches([packer.table()])

        level = materialize(left.withColumn("grp", F.floor(F.col("part") / _TREE)).groupBy("grp").applyInArrow(merge, _SCHEMA), "merged")
        done = done.unionByName(level.where("not leftover"))
        if last:
            break
        depth += 1
    return done.select("doc_id", "text_key", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
