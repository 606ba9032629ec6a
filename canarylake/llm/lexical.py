"""Ranked lexical search by an Aho-Corasick scan of the documents, without an index of them.

Items (queries) are few, documents many.  All terms of the items, each between
two guarding spaces, become one automaton, which is broadcast; a scan of a
text whose separators were turned into spaces counts all terms at once, and
the automaton's outputs map to the items that hold them.  A first pass leaves
a small row of counts for each document, from which the statistics of all
documents come; a second pass over these rows scores them and keeps each item's best.
"""

from __future__ import annotations

import math
import uuid
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, by_bytes, materialize

#: A term: ASCII letters and digits, and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Constants of the score: scale of weights and of term frequencies, saturation, and the share of length in it (percent).
WEIGHT, SCALE, SATURATION, LENGTH = 1000, 1_000_000_000, 8, 90
#: Separators become spaces, A-Z becomes a-z; bytes beyond ASCII stay.
_PLAIN = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else 32 if c < 128 else c for c in range(256))
#: Stands for a null id, which comes after all others.
_LAST = np.iinfo(np.int64).max

_automata: dict = {}


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_id, term)``, each once; rows that share an id are one item."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.translate(F.col(text_col).cast("string"), upper, upper.lower())
    return items.select(F.col(id_col).alias("item_id"), F.explode(F.regexp_extract_all(plain, F.lit(TERM), F.lit(0))).alias("term")).distinct()


def _automaton(key: str, terms: list[str]):
    """The automaton of ``terms``, made once in a Python worker."""
    if key not in _automata:
        _automata.clear()
        made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, term in enumerate(terms):
            made.add_word(f" {term} ", i)
        made.make_automaton()
        _automata[key] = made
    return _automata[key]


def scan(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n, terms, tfs)`` of every document with a term: its number of terms, and which of ``terms`` it holds how often.

    The two lists are packed 32-bit numbers, places in ``terms`` and counts.
    """
    spark = docs.sparkSession
    sent, key = spark.sparkContext.broadcast(terms), uuid.uuid4().hex

    def run(batches):
        automaton = _automaton(key, sent.value)
        value = itemgetter(1)
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                n = np.diff(Words(batch.column("text"), marks=True).first)
                hits, tfs, rows = [], [], np.flatnonzero(n)
                for i in rows.tolist():
                    plain = batch.column("text")[i].as_py().encode().translate(_PLAIN).decode()
                    found = map(value, automaton.iter(f" {plain} ")) if len(automaton) else ()
                    hit, tf = np.unique(np.fromiter(found, np.int32), return_counts=True)
                    hits.append(hit.tobytes())
                    tfs.append(tf.astype(np.int32).tobytes())
                ids = batch.column("doc_id").take(pa.array(rows))
                yield pa.record_batch([ids, pa.array(n[rows], pa.int64()), pa.array(hits, pa.binary()), pa.array(tfs, pa.binary())], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms binary, tfs binary")


def document_counts(hits: DataFrame, terms: int) -> np.ndarray:
    """The number of documents that hold each of the ``terms``; only sums of batches are shuffled."""

    def run(batches):
        for b in batches:
            df = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int32), minlength=1)
            at = np.flatnonzero(df)
            yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(df[at].astype(np.int64))], names=["term", "df"])

    out = np.zeros(terms, np.int64)
    for term, df in hits.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df")).collect():
        out[term] = df
    return out


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """``floor(1000 ln((2N + 2) / (2 df + 1)))`` for each term."""
    return np.array([math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def _best(item: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each item's k best, ties to smaller documents."""
    order = np.lexsort((doc, -score, item))
    sorted_ = item[order]
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(order) else np.zeros(0, np.int64)
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[place < k]


def score(hits: DataFrame, weight: np.ndarray, of_term: list[np.ndarray], items: int, n_docs: int, all_terms: int, k: int) -> DataFrame:
    """``(item, doc, score)``: each task's k best documents of each item.

    of_term: the items that hold each term. A task keeps k rows for each item and what one batch adds.
    """
    size = np.array([len(x) for x in of_term], np.int64)
    flat = np.concatenate([*of_term, np.zeros(0, np.int64)]).astype(np.int64)
    sent = hits.sparkSession.sparkContext.broadcast((weight, size, np.cumsum(size) - size, flat))

    def run(batches):
        weight, size, first, flat = sent.value
        least = np.zeros(items, np.int64)  # the k-th best score of each item so far
        mine = [np.zeros(0, np.int64)] * 3

        def cut():
            nonlocal mine
            mine = [np.concatenate(x) for x in zip(*kept)]
            best = _best(*mine, k)
            mine = [x[best] for x in mine]
            full = np.bincount(mine[0], minlength=items) >= k
            worst = np.full(items, np.iinfo(np.int64).max)
            np.minimum.at(worst, mine[0], mine[2])
            least[full] = worst[full]

        for whole in batches:
            kept, pending = [mine], 0
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                raw = b.column(2).to_pylist()
                term, tf = (np.frombuffer(b"".join(x), np.int32).astype(np.int64) for x in (raw, b.column(3).to_pylist()))
                row = np.repeat(np.arange(b.num_rows), [len(x) // 4 for x in raw])
                n = np.asarray(b.column(1), np.int64)
                m = 100 - LENGTH + (LENGTH * n * n_docs) // all_terms
                part = weight[term] * ((SCALE * tf) // (1000 * tf + SATURATION * m[row]))
                good = part > 0
                term, row, part = term[good], row[good], part[good]
                each = size[term]
                total = int(each.sum())
                if not total:
                    continue
                starts = np.repeat(first[term] - (np.cumsum(each) - each), each)
                pair = np.repeat(row, each) * items + flat[starts + np.arange(total)]
                sums = np.zeros(b.num_rows * items, np.int64) if b.num_rows * items <= 16 * total else None
                if sums is not None:
                    np.add.at(sums, pair, np.repeat(part, each))
                    key = np.flatnonzero(sums)
                    sums = sums[key]
                else:
                    key, back = np.unique(pair, return_inverse=True)
                    sums = np.zeros(len(key), np.int64)
                    np.add.at(sums, back, np.repeat(part, each))
                item = key % items
                may = sums >= np.maximum(least[item], 1)
                doc = np.asarray(b.column(0).fill_null(_LAST), np.int64)[key[may] // items]
                kept.append([item[may], doc, sums[may]])
                pending += len(doc)
                if pending > 8 * k * items + 65536:
                    cut()
                    kept, pending = [mine], 0
            cut()
        yield pa.record_batch([pa.array(mine[0]), pa.array(mine[1]), pa.array(mine[2])], names=["item", "doc", "score"])

    return hits.select("doc_id", "n", "terms", "tfs").mapInArrow(run, "item long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", most_terms: int = 500_000) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's k documents of the highest score above 0, ties to smaller ids.

    Terms, weights and the score are those of integer arithmetic: a term of weight w that occurs tf times adds
    ``w * (10^9 tf div (1000 tf + 8 m))``, where m is 10 plus 90 times the document's length over the mean length.

    Items are searched in shares of about ``most_terms`` terms, so that neither the automaton nor what is broadcast
    grows beyond that; each share is one scan. Null texts have no terms; documents without terms count for nothing. A null doc_id
    comes last among equal scores; rows that repeat an id, or all of a row, are documents of their own. Rows that share an item id
    (null is one) are one item with the terms of all; items without terms, or an empty table of either kind, give no rows. Very long texts are
    scanned whole. Other columns are not read.
    """
    spark = docs.sparkSession
    held = materialize(item_terms(items, item_id_col, item_text_col), "item-terms")
    shares = max(1, -(-held.count() // most_terms))
    out = []
    for share in range(shares):
        rows = held.where(F.pmod(F.xxhash64("item_id"), F.lit(shares)) == share).collect()
        ids = list(dict.fromkeys(r["item_id"] for r in rows))
        terms = sorted({r["term"] for r in rows})
        place, at = {t: i for i, t in enumerate(terms)}, {x: i for i, x in enumerate(ids)}
        of_term: list[list[int]] = [[] for _ in terms]
        for r in rows:
            of_term[place[r["term"]]].append(at[r["item_id"]])
        hits = materialize(scan(docs, terms, id_col, text_col), "hits")
        n_docs, all_terms = hits.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs or not terms:
            continue
        weight = weights(document_counts(hits, len(terms)), n_docs)
        best = score(hits, weight, [np.array(x, np.int64) for x in of_term], len(ids), n_docs, all_terms, k)
        names = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], f"item long, item_id {dict(held.dtypes)['item_id']}")
        # tasks' rows meet in parts first, so that no item is ranked in one task however many tasks there are
        order = (F.desc("score"), F.asc("doc"))
        best = best.withColumn("part", F.spark_partition_id() % 64)
        best = best.withColumn("r", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("r") <= k)
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        out.append(best.join(names, "item").select("item_id", "rank", F.when(F.col("doc") != int(_LAST), F.col("doc")).alias("doc_id"), "score"))
    if not out:
        return held.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


#: The same rows in SQL.
ORACLE = r"""
    WITH words AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
    sized AS (SELECT row, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM words WHERE len(terms) > 0),
    totals AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sized),
    item AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    tf AS (SELECT row, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM sized) WHERE term IN (SELECT term FROM item) GROUP BY row, doc_id, n, term),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, totals GROUP BY term),
    scored AS (SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll)))) AS score FROM tf JOIN w USING (term) JOIN item USING (term), totals GROUP BY item_id, row, doc_id),
    ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 10"""
