"""Groups of spelling variants: words one edit apart, found with full-text (FM) indexes of the vocabulary.

A word pair one edit apart agrees exactly on one half of the query word: its front, or else its
back.  Words are dealt by their first letters for the one case and by their last for the other, so a word meets all
that can agree with it.  In a shard, the words between delimiters are one text with an FM-index for each
direction.  A search starts at a delimiter, matches the agreed half exactly, and goes on across the
other half with at most one error; its state is an interval of suffix ranks.  All queries of a shard take each
step together.  As each search goes one way only from the delimiter, the index of that direction is all it needs.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, materialize

#: Half of the shortest word that is searched: letters by which words are dealt.
DEAL = 3
#: Queries that take their steps together.
_BLOCK = 4096


class FMIndex:
    """An FM-index of ``words`` (arrays of symbols > 0), each between delimiters 0, read forwards.

    ``extend`` narrows intervals of suffix ranks by one more symbol to the right; inside, the text is held reversed, as an FM-index extends to the left.
    """

    def __init__(self, words: list[np.ndarray], symbols: int):
        self.count, self.symbols = len(words), symbols
        sizes = np.array([len(w) for w in words], np.int64)
        self.ends = np.cumsum(sizes + 1)
        text = np.zeros(int(self.ends[-1]) + 1 if len(words) else 1, np.int64)
        if len(words):
            inside = np.ones(len(text), bool)
            inside[0] = False
            inside[self.ends] = False
            text[inside] = np.concatenate([w[::-1] for w in words])
        order = self._suffixes(text)
        self.order = order
        bwt = text[order - 1]
        n = self.n = len(text)
        self.first = np.searchsorted(np.sort(text), np.arange(symbols + 1))
        # where each symbol stands in the transform: the rank of a symbol is a place in this list
        self.keys = np.sort(bwt * n + np.arange(n))
        self.bwt = bwt

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """The suffix array, by doubling."""
        n, rank, step = len(text), text.copy(), 1
        order = np.argsort(rank, kind="stable")
        while True:
            key = rank * (n + 1)
            key[: n - step] += rank[step:] + 1 if step < n else 0
            order = np.argsort(key, kind="stable")
            sorted_ = key[order]
            new = np.zeros(n, np.int64)
            new[order] = np.cumsum(np.r_[0, sorted_[1:] != sorted_[:-1]])
            rank, step = new, 2 * step
            if n == 0 or rank[order[-1]] == n - 1 or step >= n:
                return order

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The place in the sorted text that ``symbol`` before the suffix rank ``at`` leads to."""
        return np.searchsorted(self.keys, symbol * self.n + at)

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of what was read so far, then ``symbol``; those that nothing matches are empty."""
        return self.rank(symbol, lo), self.rank(symbol, hi)

    def branches(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(interval, symbol)``: the symbols but the delimiter that can follow each interval."""
        size = hi - lo
        which = np.repeat(np.arange(len(lo)), size)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + lo[which]
        pair = np.unique(which * self.symbols + self.bwt[at])
        pair = pair[pair % self.symbols > 0]
        return pair // self.symbols, pair % self.symbols

    def word(self, rank: np.ndarray) -> np.ndarray:
        """The word before the delimiter that the suffix rank begins with."""
        return np.searchsorted(self.ends, self.order[rank], side="right")


def one_error(index: FMIndex, queries: np.ndarray, size: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(query, word)``: words that begin with a query's first ``exact`` symbols and differ from it by exactly one edit, each pair once.

    queries: rows of symbols, filled up with zeros, of ``size`` symbols each.
    """
    n = len(queries)
    width = queries.shape[1]
    padded = np.hstack([queries, np.zeros((n, 2), queries.dtype)]).astype(np.int64)
    q, lo, hi = np.arange(n), np.zeros(n, np.int64), np.full(n, index.n, np.int64)
    lo, hi = index.extend(lo, hi, np.zeros(n, np.int64))  # the delimiter before a word
    errors = [np.zeros((4, 0), np.int64)]  # query, next place, interval
    out: list[np.ndarray] = [np.zeros((2, 0), np.int64)]

    for j in range(width + 2):
        # states with their error behind them, at place j: read on exactly, the closing delimiter included
        used = np.concatenate(errors, axis=1)
        now, later = used[:, used[1] == j], used[:, used[1] != j]
        errors = [later]
        # deletions: the symbol at j is left out; substitutions and insertions: another is read
        open_ = exact[q] <= j
        if open_.any():
            a, l, h = q[open_], lo[open_], hi[open_]
            ends = j >= size[a]
            errors.append(np.stack([a, np.full(len(a), j + 1), l, h])[:, ~ends])
            pair, back = np.unique(l * (index.n + 1) + h, return_inverse=True)
            l, h = pair // (index.n + 1), pair % (index.n + 1)
            which, symbol = index.branches(l, h)
            to_lo, to_hi = index.extend(l[which], h[which], symbol)
            # every query with the branches of its interval
            many = np.bincount(which, minlength=len(l))
            first = np.cumsum(many) - many
            each = many[back]
            row = np.repeat(np.arange(len(a)), each)
            br = np.repeat(first[back] - (np.cumsum(each) - each), each) + np.arange(len(row))
            s, l2, h2, who = symbol[br], to_lo[br], to_hi[br], a[row]
            own = padded[who, j] == s
            sub = (size[who] > j) & ~own
            errors.append(np.stack([who, np.full(len(who), j + 1), l2, h2])[:, sub])
            ins = np.stack([who, np.full(len(who), j), l2, h2])
            now = np.concatenate([now, ins], axis=1)
        if now.shape[1]:
            l, h = index.extend(now[2], now[3], padded[now[0], j])
            done = j == size[now[0]]
            full = l < h
            hit = done & full
            # a match is one word: all words of the index differ
            out.append(np.stack([now[0][hit], l[hit]]))
            errors.append(np.stack([now[0], np.full(len(l), j + 1), l, h])[:, full & ~done])
        keep = size[q] > j
        l, h = index.extend(lo[keep], hi[keep], padded[q[keep], j])
        q, lo, hi = q[keep], l, h
        full = lo < hi
        q, lo, hi = q[full], lo[full], hi[full]
    found = np.concatenate(out, axis=1)
    pair = np.unique(found[0] * index.n + found[1])
    return pair // index.n, index.word(pair % index.n)


def _symbols(words: list[str], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """``(code points from 1 on of all words, sizes, the same word by word)``."""
    size = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    flat = np.searchsorted(alphabet, codes) + 1
    return flat, size, np.split(flat, np.cumsum(size)[:-1]) if len(words) else []


def shard_neighbours(words: list[str], n: list[int], queries: list[str], back: bool) -> list[tuple]:
    """``(query, near words, the most frequent of them, its n)`` for the queries with any, of one shard and one direction.

    Searches read from the front with the first half exact, or (``back``) from the end with the second; the
    second kind leaves out what the first finds.
    """
    if not words or not queries:
        return []
    turned = [w[::-1] for w in words] if back else words
    asking = [w[::-1] for w in queries] if back else queries
    alphabet = np.unique(np.frombuffer("".join(turned + asking).encode("utf-32-le", "surrogatepass"), np.uint32)).astype(np.int64)
    index = FMIndex(_symbols(turned, alphabet)[2], len(alphabet) + 1)
    best_first = np.empty(len(words), np.int64)
    best_first[sorted(range(len(words)), key=lambda i: (-n[i], words[i]))] = np.arange(len(words))
    rows = []
    order = sorted(range(len(asking)), key=lambda i: len(asking[i]))  # blocks of words of like length
    for at in range(0, len(order), _BLOCK):
        mine = order[at : at + _BLOCK]
        _, size, split = _symbols([asking[i] for i in mine], alphabet)
        padded = np.zeros((len(mine), int(size.max())), np.int64)
        padded[np.arange(padded.shape[1])[None, :] < size[:, None]] = np.concatenate(split)
        half = size // 2
        who, hit = one_error(index, padded, size, size - half if back else half)
        if back:  # a pair whose fronts agree was found from the front
            known = np.array([words[h].startswith(queries[mine[w]][: len(queries[mine[w]]) // 2]) for w, h in zip(who.tolist(), hit.tolist())], bool)
            who, hit = who[~known], hit[~known]
        count = np.bincount(who, minlength=len(mine))
        best = np.full(len(mine), len(words), np.int64)
        np.minimum.at(best, who, best_first[hit])
        named = np.argsort(best_first)
        for i in np.flatnonzero(count).tolist():
            w = int(named[best[i]])
            rows.append((queries[mine[i]], int(count[i]), words[w], int(n[w])))
    return rows


def neighbours(words: DataFrame, shard_words: int = 16_384) -> DataFrame:
    """``(word, n_near, near, near_n)`` of the rows of ``words(word, n)`` with near words: how many, and the most frequent (ties: the least).

    Words are distinct, not null, and of twice :data:`DEAL` code points at least. Where more than ``shard_words`` words share their first (or last) letters, they are dealt to
    many indexes, and every such word asks all of these.
    """
    ends = F.array(F.struct(F.lit(False).alias("back"), F.substring("word", 1, DEAL).alias("letters")), F.struct(F.lit(True).alias("back"), F.expr(f"right(word, {DEAL})").alias("letters")))
    dealt = words.select("word", "n", F.explode(ends).alias("e")).select("word", "n", "e.back", "e.letters")
    sizes = dealt.groupBy("back", "letters").agg(F.count(F.lit(1)).alias("c"))
    shards = max(1, -(-words.count() // shard_words))
    cuts = sizes.select("back", "letters", F.ceil(F.col("c") / shard_words).cast("int").alias("cuts"))
    met = dealt.join(cuts, ["back", "letters"])
    part = F.pmod(F.xxhash64("word"), F.col("cuts")).cast("int")
    # small groups share a shard; a large group has indexes, and parts of queries, of its own
    shard = F.when(F.col("cuts") == 1, F.pmod(F.xxhash64("letters"), F.lit(shards)).cast("string")).otherwise(F.concat(F.lit("+"), "letters"))
    met = met.select("back", shard.alias("shard"), "cuts", part.alias("part"), "word", "n")
    both = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    index = both.select("back", "shard", F.col("part").alias("i"), F.col("other").alias("q"), "word", "n", F.lit(True).alias("held"))
    asks = both.select("back", "shard", F.col("other").alias("i"), F.col("part").alias("q"), "word", "n", F.lit(False).alias("held"))
    groups = index.unionByName(asks).groupBy("back", "shard", "i", "q").agg(
        F.collect_list(F.when(F.col("held"), F.struct("word", "n"))).alias("held"), F.collect_list(F.when(~F.col("held"), F.col("word"))).alias("asks")
    )

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                held = b.column(1)[r].values
                rows = shard_neighbours(held.field("word").to_pylist(), held.field("n").to_pylist(), b.column(2)[r].as_py(), b.column(0)[r].as_py())
                columns = zip(*rows) if rows else ([], [], [], [])
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["word", "n_near", "near", "near_n"])

    found = groups.select("back", "held", "asks").mapInArrow(run, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.m")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``forms(word, form)``, in which n grows from word to form: the last form of each word, by pointer doubling."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = materialize(now.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.drop("moved")


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_size: int = 6, least_n: int = 5, odd: int = 199) -> DataFrame:
    """``(word, n)``: runs of Latin letters (ASCII and U+00C0 to U+00FF), A-Z lower-cased, and how often they occur.

    Where ``odd`` divides the CRC-32 of ``doc_id:run``, one code point of the run is left out, at the CRC modulo its length. Of the results those
    of ``least_size`` code points and ``least_n`` occurrences or more are kept. Tasks send sums of their batches only.
    """

    def run(batches):
        for whole in batches:
            sums: Counter = Counter()
            for batch in by_bytes(whole, "text"):
                for doc, each in zip(batch.column("doc_id").to_pylist(), _runs(batch.column("text"), least_size)):
                    head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for word, n in each.items():
                        h = zlib.crc32(word, head)
                        if h % odd == 0:
                            text = word.decode()
                            at = h % len(text)
                            word = (text[:at] + text[at + 1 :]).encode()
                        sums[word] += n
                if len(sums) > 500_000:
                    yield _counted(sums, least_size)
                    sums.clear()
            yield _counted(sums, least_size)

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _counted(sums: Counter, least_size: int) -> pa.RecordBatch:
    words = [(w, n) for w, n in ((w.decode(), n) for w, n in sums.items()) if len(w) >= least_size]
    return pa.record_batch([pa.array([w for w, _ in words], pa.string()), pa.array([n for _, n in words], pa.int64())], names=["word", "n"])


_LETTER = np.array([chr(c).isascii() and chr(c).isalpha() for c in range(256)])
_SMALL = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _runs(texts: pa.Array, least_size: int):
    """For each text its runs as lower-cased UTF-8 and their numbers; runs of fewer code points are left out."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = bytes(memoryview(data)[off[0] : off[-1]]).translate(_SMALL) if data is not None and off[-1] > off[0] else b""
    off = off - off[0]
    b = np.frombuffer(raw, np.uint8)
    lead = b == 0xC3  # U+00C0 to U+00FF are C3 and one more byte
    on = _LETTER[b] | lead
    on[1:] |= lead[:-1]
    edge = np.flatnonzero(np.diff(np.r_[False, on, False].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    # texts that end in a letter run into the next
    cut = off[1:-1][on[off[1:-1] - 1] & on[np.minimum(off[1:-1], len(b) - 1)]] if len(b) and len(off) > 2 else np.zeros(0, np.int64)
    cut = np.unique(cut[(cut > 0) & (cut < len(b))])
    start, end = np.sort(np.r_[start, cut]), np.sort(np.r_[end, cut])
    two = np.r_[0, np.cumsum(lead)]
    long = end - start - (two[end] - two[start]) >= least_size
    start, end = start[long], end[long]
    first = np.searchsorted(start, off)
    start, end = start.tolist(), end.tolist()
    for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
        yield Counter([raw[s:e] for s, e in zip(start[a:z], end[a:z])])


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_size: int = 6, least_n: int = 5, times: int = 5, shard_words: int = 16_384) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of :func:`vocabulary`.

    Words are near if they differ by exactly one inserted, deleted or replaced code point. A word's form is its near word of the largest n
    (ties: the least in code-point order), if that is ``times`` its own or more, else null; root follows the forms to the last, and is the word itself without
    one. Null ids count as empty in the checksum; null, empty and letterless texts give no words; rows that repeat count each; very long
    texts and words are read whole; an empty table gives no rows; other columns are not read.
    """
    if least_size < 2 * DEAL:
        raise ValueError(f"words are dealt by {DEAL} letters of either end, so least_size can't be under {2 * DEAL}")
    words = materialize(vocabulary(docs, id_col, text_col, least_size, least_n), "words")
    near = materialize(neighbours(words, shard_words), "near")
    some = F.col("near_n") >= F.lit(times) * F.col("n")
    each = words.join(near, "word", "left").select("word", F.when(some, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(some, F.col("near_n")).alias("form_n"))
    each = materialize(each, "forms")
    last = roots(each.where("form is not null"))
    return each.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same rows in SQL.
ORACLE = r"""
    WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents WHERE text IS NOT NULL),
    each AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
    crcs AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce([CAST(b AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS c FROM (SELECT unnest(range(256)) AS b))),
    bytes AS (SELECT doc_id, run, n, list_concat([4294967295], flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) AS BIGINT) - 64] END))) AS b FROM each),
    sums AS (SELECT run, n, xor(list_reduce(b, lambda x, y: xor(x // 256, t[CAST(xor(x % 256, y) AS BIGINT) + 1])), 4294967295) AS h FROM bytes, crcs),
    spelt AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM sums),
    words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
    cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS BIGINT) AS i FROM words)),
    pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
    best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
    forms AS (SELECT w.word, CASE WHEN near_n >= 5 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)),
    up AS (SELECT word, word AS root, 0 AS step FROM forms UNION ALL SELECT up.word, forms.form, step + 1 FROM up JOIN forms ON up.root = forms.word WHERE forms.form IS NOT NULL),
    last AS (SELECT word, arg_max(root, step) AS root FROM up GROUP BY word)
    SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM forms JOIN last USING (word)"""
