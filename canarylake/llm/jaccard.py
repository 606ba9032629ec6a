"""Near copies by SimHash, confirmed and completed by the exact Jaccard similarity of word shingles.

Candidates come first from the BK-trees of :mod:`.simhash`.  A radius that trees can search finds only the
closest of the pairs that a similarity of ``least`` allows (at 0.8 two fingerprints differ in some ten of 64 bits), so a
prefix filter adds the rest: two sets with a Jaccard similarity of at least ``least`` share one of their
first ``n - ceil(least * n) + 1`` entries under any common order, so every such
pair meets under one of those keys.  The order puts shingles that a sample
shows to be common last; it decides only how many pairs are looked at, never
which are found.  Candidates of both kinds are confirmed on the whole sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, by_bytes, components, materialize, windows
from .simhash import link, majority

#: Longs of a set's signature; a bit that only one of two signatures has stands for an entry that only that set has.
_LONGS = 8
#: Sets to confirm up to which their keys are sent to the texts; beyond, texts and keys are shuffled.
_SENT = 1_000_000
#: Rounds, at most, in which each set is held against the likest that it meets, before those that stay apart are held against each other.
_ROUNDS = 6
#: Share of a round's pairs that are alike from which there is another round.
_WORTH = 0.2
#: Documents whose shingles are counted for the order, and shingles that it puts last, at most.
_SAMPLE, _COMMON = 5_000, 200_000
#: Times in the sample from which a key's sets are dealt to so many parts, at least.
_HOT, _PARTS = 8, 64
#: Sets of a key that are held against each other at a time, and bytes of their signatures at most.
_BLOCK, _LONGEST = 128, 128
#: Least keys of a set by which a pair that shares many keys is named under one of them.
_HEADS = 8
#: Bytes of text that are hashed at a time.
_PIECE = 1 << 18


def _rolled(texts: pa.Array, shingle: int):
    """The shingle hashes of each text, in order; a text of fewer words is one shingle."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    rolled = {k: windows(hashes, k) for k in {min(shingle, k) for k in np.unique(np.diff(words.first)).tolist()} - {0}}
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        k = min(shingle, b - a)
        yield rolled[k][a : b - k + 1] if k else np.zeros(0, np.uint64)


def _bits(entries: np.ndarray) -> np.ndarray:
    """The signature of a set: a bit for each entry's last digits."""
    on = np.zeros(64 * _LONGS, np.uint8)
    on[entries % np.uint64(64 * _LONGS)] = 1
    return np.packbits(on).view("<i8")


def _sig(entries: np.ndarray) -> bytes:
    """A signature of some four bits for each entry; the halves of one, joined, are that of half the length."""
    size = max(64, 1 << (4 * max(1, len(entries)) - 1).bit_length())
    on = np.zeros(size, np.uint8)
    on[entries % np.uint64(size)] = 1
    return np.packbits(on, bitorder="little").tobytes()


def _may_be(x: bytes, y: bytes, n: int, m: int, least: float) -> bool:
    """Whether sets of n and m entries with these signatures can be ``least`` alike: entries that only one has leave bits that only one has."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    both = least / (1 + least) * (n + m) - 1e-9
    return n - int(np.bitwise_count(a & ~b).sum()) >= both and m - int(np.bitwise_count(b & ~a).sum()) >= both


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``(doc_id, text_key, sid, n, fp, bits, sig, short, hashes)`` per row: the text's hash and SimHash, and its set's hash, size, signatures and 64-bit entries; sid is 0 without words."""

    def make(batch, sets, raw, sid, prints):
        fp, sigs = pa.array(np.array(prints, np.uint64).view(np.int64)), [_sig(s) for s in sets]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(sid), pa.array([len(s) for s in sets], pa.int32()), fp, pa.array([_bits(s) for s in sets], pa.list_(pa.int64())), pa.array(sigs, pa.binary()), pa.array([_short(s) for s in sigs], pa.binary()), pa.array(raw, pa.binary())], names=["doc_id", "text_key", "sid", "n", "fp", "bits", "sig", "short", "hashes"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    return _mapped(rows, shingle, make, "doc_id long, text_key long, sid long, n int, fp long, bits array<long>, sig binary, short binary, hashes binary", prints=True)


def _mapped(rows: DataFrame, shingle: int, make, schema: str, prints: bool = False) -> DataFrame:
    """What ``make(batch, sets, raw, sid)`` gives for small batches of ``rows``, whose text is the column ``text``; with ``prints`` it gets the SimHashes too."""

    def run(batches):
        for whole in batches:
            for batch in by_bytes(whole, "text", _PIECE):
                rolled = list(_rolled(batch.column("text"), shingle))
                sets = [np.unique(r) for r in rolled]
                raw = [s.tobytes() for s in sets]
                more = ([majority([r]) for r in rolled],) if prints else ()
                yield make(batch, sets, raw, np.array([xxhash.xxh64_intdigest(r) if r else 0 for r in raw], np.uint64).view(np.int64), *more)

    return rows.mapInArrow(run, schema)


def _common(docs: DataFrame, n: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of ``docs`` holds three times or more, sorted, and how often."""
    part = int(min(1.0, _SAMPLE / max(1, n)) * (1 << 20)) + 1
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < part).select("text")
    make = lambda batch, sets, raw, sid: pa.record_batch([pa.array(np.frombuffer(b"".join(raw), "<i8"))], names=["h"])
    often = _mapped(some, shingle, make, "h long").groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(_COMMON).toPandas()
    h = often["h"].to_numpy(np.int64).view(np.uint64)
    at = np.argsort(h)
    return h[at], often["count"].to_numpy(np.int64)[at]


def _keys(docs: DataFrame, n: int, shingle: int, least: float) -> DataFrame:
    """``(key, sid, part)``: the first entries of every row's set; the sets of keys that are frequent in the sample are dealt to parts from 1 on, others are in part 0."""
    common, often = _common(docs, n, shingle)

    def make(batch, sets, raw, sid):
        keys, parts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
        for h, s in zip(sets, sid.tolist()):
            times = np.zeros(len(h), np.int64)
            if len(h) and len(common):
                at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                times = np.where(common[at] == h, often[at], 0)
                order = np.argsort(times, kind="stable")
                h, times = h[order], times[order]
            some = len(h) - math.ceil(least * len(h) - 1e-9) + 1
            keys.append(h[:some])
            parts.append(np.where(times[:some] >= _HOT, s % _PARTS + 1, 0).astype(np.int32))
        return pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(sid, [len(k) for k in keys[1:]])), pa.array(np.concatenate(parts))], names=["key", "sid", "part"])

    return _mapped(docs.select("text"), shingle, make, "key long, sid long, part int")


def _shared(keys: DataFrame) -> DataFrame:
    """``(key, sid, b)``: keys that sets share, with their sets and the least of them.

    Frequent keys are looked at part by part first, and their parts' ends then meet; they are at most as many as the sample names.
    """
    by_part = Window.partitionBy("key", "part")
    ends = keys.withColumns({"b": F.min("sid").over(by_part), "top": F.max("sid").over(by_part)})
    met = materialize(ends.where((F.col("part") > 0) | (F.col("b") != F.col("top"))).distinct(), "keys")
    hot = met.where("part > 0").groupBy("key").agg(F.min("b").alias("b"), F.max("top").alias("top")).where("b <> top").select("key", "b")
    return met.where("part = 0").select("key", "sid", "b").unionByName(met.where("part > 0").select("key", "sid").join(F.broadcast(hot), "key").select("key", "sid", "b"))


def _ends(pairs: DataFrame) -> DataFrame:
    """``(sid)``: the sets of ``pairs``, each once."""
    return pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()


def _again(needed: DataFrame, sets: DataFrame, docs: DataFrame, shingle: int, *columns: str) -> DataFrame:
    """``(sid, columns...)`` of the sets in ``needed(sid)``, made anew from their texts."""
    needed = materialize(needed, "asked")
    send = F.broadcast if needed.count() <= _SENT else lambda df: df
    texts = sets.join(send(needed), "sid", "left_semi").groupBy("sid").agg(F.min("text_key").alias("k")).select("k")
    made = shingle_sets(docs.join(send(texts), F.xxhash64("text") == F.col("k"), "left_semi"), shingle=shingle)
    return materialize(made.groupBy("sid").agg(*[F.first(c).alias(c) for c in columns]), "again")


def _confirmed(pairs: DataFrame, sets: DataFrame, docs: DataFrame, shingle: int, least: float) -> DataFrame:
    """The ``(a, b)`` of ``pairs`` whose sets are at least ``least`` alike.

    Signatures as long as the sets need go first; only pairs that they leave are held against each other whole.
    """

    def met(rows, known, *columns):
        left, right = (known.select(F.col("sid").alias(side), *[F.col(c).alias(c + side) for c in columns]) for side in ("a", "b"))
        return rows.join(left, "a").join(right, "b").select("a", "b", *[c + side for c in columns for side in ("a", "b")])

    def kept(test):
        def run(batches):
            for batch in batches:
                good = [test(*row) for row in zip(*(c.to_pylist() for c in batch.columns[2:]))]
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        return run

    def alike(x, y):
        x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
        both = len(x) + len(y) - len(np.union1d(x, y))
        return both >= least * (len(x) + len(y) - both) - 1e-9

    near = met(pairs, _again(_ends(pairs), sets, docs, shingle, "sig", "n"), "sig", "n").mapInArrow(kept(lambda x, y, n, m: _may_be(x, y, n, m, least)), "a long, b long")
    near = materialize(near, "near")
    return met(near, _again(_ends(near), sets, docs, shingle, "hashes"), "hashes").mapInArrow(kept(alike), "a long, b long")


def _short(sig: bytes) -> bytes:
    """A signature folded to at most ``_LONGEST`` bytes."""
    x = np.frombuffer(sig, np.uint8)
    while len(x) > _LONGEST:
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    return x.tobytes()


def _folded(sig: bytes) -> dict[int, np.ndarray]:
    """A signature by length: as it is, and folded once more."""
    x = np.frombuffer(sig, np.uint8)
    half = len(x) // 2
    return {len(x): x, half: x[:half] | x[half:]}


def _block(sids: list[int], n: list[int], roots: list[int], sigs: list[bytes], side: list[bool], least: float):
    """``(i, js, alike)`` of a block: of its sets, which it names in an order of its own, those of other roots that can be ``least`` alike, and how much at most.

    Inside one side, or across two if there are two; each pair comes once. First comes the order, as indices of the block.
    """
    order = sorted(range(len(sids)), key=lambda i: n[i])
    yield order
    n, roots, side = (np.array([x[i] for i in order]) for x in (n, roots, side))
    sigs = [_folded(sigs[i]) for i in order]
    two = bool(side.any() and not side.all())
    for i in range(len(order)):
        to = int(np.searchsorted(n, n[i] / least + 1e-9, side="right"))
        js = np.arange(i + 1, to)
        js = js[(roots[js] != roots[i]) & ((side[js] != side[i]) | (not two))]
        if not len(js):
            continue
        size = min(max(sigs[j]) for j in [i, *js.tolist()])
        mine = sigs[i][size] if size in sigs[i] else None
        known = [j for j in js.tolist() if size in sigs[j]]
        if mine is None or len(known) < len(js):  # sizes further apart than signatures can tell
            yield i, js, n[i] / np.maximum(n[js], 1)
            continue
        theirs = np.stack([sigs[j][size] for j in known])
        both = least / (1 + least) * (n[i] + n[js]) - 1e-9
        only, others = np.bitwise_count(mine & ~theirs).sum(axis=1), np.bitwise_count(theirs & ~mine).sum(axis=1)
        most = np.minimum(n[i] - only.astype(np.int64), n[js] - others.astype(np.int64))
        good = most >= both
        if good.any():
            yield i, js[good], most[good] / np.maximum(n[i] + n[js][good] - most[good], 1)


def block_pairs(sids: list[int], n: list[int], roots: list[int], sigs: list[bytes], side: list[bool], least: float) -> list[tuple[int, int]]:
    """Pairs of sets of different roots that can be ``least`` alike by their sizes and signatures: inside one side, or across two if there are two."""
    order, *found = _block(sids, n, roots, sigs, side, least)
    return [(sids[order[i]], sids[order[j]]) for i, js, _ in found for j in js.tolist()]


def block_likest(sids: list[int], n: list[int], roots: list[int], sigs: list[bytes], least: float) -> dict[int, tuple[float, int]]:
    """For each set of a block the one of another root that it can be most alike, if ``least`` at all, after how much that is."""
    order, *found = _block(sids, n, roots, sigs, [False] * len(sids), least)
    best: dict[int, tuple[float, int]] = {}
    for i, js, alike in found:
        x = sids[order[i]]
        for j, much in zip(js.tolist(), alike.tolist()):
            y = sids[order[j]]
            best[x], best[y] = max(best.get(x, (0.0, y)), (much, y)), max(best.get(y, (0.0, x)), (much, x))
    return best


def _likest(rest: DataFrame, least: float, salt: int) -> DataFrame:
    """``(a, b)``: for each set of ``rest(key, sid, n, root, short, c)`` the likest of another root, by signatures, in the blocks to which its keys are dealt; one pair for a set at most."""
    block = F.pmod(F.xxhash64("sid", "key", F.lit(salt)), F.ceil(F.col("c") / _BLOCK))
    groups = rest.groupBy("key", block.alias("p")).agg(F.collect_list(F.struct("sid", "n", "root", "short")).alias("m"))

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                rows = batch.column(0)[r].as_py()
                best = block_likest(*([x[c] for x in rows] for c in ("sid", "n", "root", "short")), least)
                if best:
                    yield pa.record_batch([pa.array([list(best)], pa.list_(pa.int64())), pa.array([[y for _, y in best.values()]], pa.list_(pa.int64())), pa.array([[x for x, _ in best.values()]], pa.list_(pa.float64()))], names=["a", "b", "x"])

    found = groups.select("m").mapInArrow(run, "a array<long>, b array<long>, x array<double>")
    one = found.select(F.explode(F.arrays_zip("a", "b", "x")).alias("r")).groupBy("r.a").agg(F.max(F.struct("r.x", "r.b")).alias("best"))
    return one.select(F.greatest("a", "best.b").alias("a"), F.least("a", "best.b").alias("b")).distinct()


def _held(rest: DataFrame, least: float) -> DataFrame:
    """``(a, b)``: pairs of the sets of a key in ``rest(key, sid, n, root, short, c, top, big)`` that may be alike, of different roots.

    A key's sets are cut into blocks, and a task holds one block, or two, against each other at a time, however many sets share a key;
    what is left of a block's pairs is one row. The sets of a key's largest root have blocks of their own, which meet only the other sets' blocks.
    A pair is left out where both sets have a lesser key among their least, as it is looked at there.
    """
    heads = rest.groupBy("sid").agg(F.slice(F.sort_array(F.collect_list("key")), 1, _HEADS).alias("heads"))  # at most a fifth of a set's entries
    rest = rest.join(heads, "sid")
    few, own = F.col("c") <= _BLOCK, F.col("root") == F.col("top")
    cuts = lambda n: F.ceil(n / _BLOCK).cast("int")
    others, tops = F.when(few, 1).otherwise(cuts(F.col("c") - F.col("big"))), F.when(few, 0).otherwise(cuts(F.col("big")))
    at = lambda n: F.pmod(F.xxhash64("sid"), n).cast("int")
    mine = rest.withColumn("mine", F.when(own & ~few, others + at(tops)).otherwise(at(others)))
    met = mine.withColumn("other", F.explode(F.sequence(F.lit(0), others - 1 + F.when(own, 0).otherwise(tops))))
    p, q = F.least("mine", "other"), F.greatest("mine", "other")
    groups = met.groupBy("key", p.alias("p"), q.alias("q")).agg(F.collect_list(F.struct("sid", "n", "root", "short", (F.col("mine") > F.col("other")).alias("side"), (F.col("mine") == F.col("other")).alias("same"), "heads")).alias("m"))

    def run(batches):
        for batch in batches:
            for key, r in zip(batch.column(1).to_pylist(), range(batch.num_rows)):
                rows = batch.column(0)[r].as_py()
                less = {x["sid"]: {k for k in x["heads"] if k < key} for x in rows}
                two = not all(x["same"] for x in rows)
                pairs = [] if two and len({x["side"] for x in rows}) < 2 else block_pairs(*([x[c] for x in rows] for c in ("sid", "n", "root", "short", "side")), least)
                pairs = [(x, y) for x, y in pairs if less[x].isdisjoint(less[y])]
                a, b = ([max(x) for x in pairs], [min(x) for x in pairs])
                yield pa.record_batch([pa.array([a], pa.list_(pa.int64())), pa.array([b], pa.list_(pa.int64()))], names=["a", "b"])

    found = groups.select("m", "key").mapInArrow(run, "a array<long>, b array<long>")
    return found.select(F.explode(F.arrays_zip("a", "b")).alias("x")).select("x.a", "x.b").distinct()


def _hinted(sets: DataFrame, radius: int) -> DataFrame:
    """``(a, b)``: sets that the BK-trees of SimHashes link, each fingerprint by its least set."""
    prints = materialize(sets.select("fp", "sid").distinct(), "prints")
    heads = prints.groupBy("fp").agg(F.min("sid").alias("head"))
    same = prints.join(heads, "fp").select(F.col("sid").alias("a"), F.col("head").alias("b"))
    edges = link(heads.select("fp"), radius)
    left, right = heads.select(F.col("fp").alias("x"), F.col("head").alias("a")), heads.select(F.col("fp").alias("y"), F.col("head").alias("b"))
    close = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).join(left, "x").join(right, "y").select("a", "b")
    return same.unionByName(close).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, radius: int = 4) -> DataFrame:
    """``(doc_id, text_key, component)`` per row: components of texts linked by a Jaccard similarity of at least ``least``.

    Texts are compared as lower-case (ASCII) words between ASCII spaces; null and blank texts form one component.
    First come the pairs within ``radius`` bits of each other's SimHash and one other of all with which a set shares a prefix key; then, in rounds, for each set
    the likest of another component in the blocks of its keys. Only sets that then stay in different components are held against each other, in blocks, so a large group of near copies does not give all its pairs.
    Texts and sets are told apart by 64-bit hashes. Null ids, and rows that repeat, are rows like others; an empty table gives no rows; very long texts are read whole.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = materialize(shingle_sets(docs, shingle=shingle).drop("sig", "hashes"), "sets")
    keys = _shared(_keys(docs, sets.count(), shingle, least))
    each = sets.groupBy("sid").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("short").alias("short"))
    size = each.select("sid", "n")
    shared = materialize(keys.join(size, "sid"), "shared")
    only = lambda x, y: sum((F.bit_count(F.get(x, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(i))))) for i in range(_LONGS)), F.lit(0))
    both = least / (1 + least) * (F.col("n") + F.col("nb")) - 1e-9
    # what a pair of that similarity can't do without: sizes alike, and few enough entries that only one has
    may = (F.least("n", "nb") >= least * F.greatest("n", "nb") - 1e-9) & (F.col("n") - only("bits", "bb") >= both) & (F.col("nb") - only("bb", "bits") >= both)
    held = each.select("sid", "n", "bits")
    other = held.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))

    def checked(pairs, name):
        """The pairs that are alike, of those that may be."""
        pairs = pairs.distinct().join(held.withColumnRenamed("sid", "a"), "a").join(other, "b").where(may).select("a", "b")
        return materialize(_confirmed(materialize(pairs, name), sets, docs, shingle, least), "links")

    # a set and one other of all that it shares a key with, some rounds long: at most one pair for each set in a round
    one = shared.where(F.col("sid") != F.col("b")).groupBy(F.col("sid").alias("a")).agg(F.min("b").alias("b"))
    links = checked(one.unionByName(_hinted(sets, radius)), "stars")
    stars = lambda roots: roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    mark = lambda salt: F.sum(F.pmod(F.xxhash64("sid", F.lit(salt)), F.lit(1 << 40))).alias(f"m{salt}")

    def apart(roots):
        """``(key, sid, n, root, short, c, top, big)``: the sets of keys that have sets of several roots; ``c`` of a key's sets, of which ``big`` have the root ``top``."""
        rooted = materialize(shared.select("key", "sid", "n").join(roots, F.col("sid") == F.col("node"), "left").select("key", "sid", "n", F.coalesce("root", "sid").alias("root")), "rooted")
        by_root = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k"), mark(1), mark(2))
        split = by_root.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.sum("k").alias("c"), F.sum("m1").alias("m1"), F.sum("m2").alias("m2"), F.max(F.struct("k", "root")).alias("most")).where("many > 1")
        # keys with the same sets give the same pairs, so one of them is enough
        split = split.groupBy("c", "m1", "m2").agg(F.min_by(F.struct("key", "most"), "key").alias("one")).select("one.key", "c", F.col("one.most.root").alias("top"), F.col("one.most.k").alias("big"))
        rest = materialize(rooted.join(split, "key"), "rest")
        sigs = each.join(rest.select("sid").distinct(), "sid", "left_semi").select("sid", "short")
        return rest.join(sigs, "sid")

    roots = materialize(components(links), "roots")
    rest = apart(roots)
    for salt in range(_ROUNDS):
        asked = materialize(_likest(rest, least, salt), "likest")
        links = checked(asked, "stars")
        joined = links.count()
        if not joined:
            break
        roots = materialize(components(stars(roots).unionByName(links)), "roots")  # what is joined already is joined by one edge for each set
        rest = apart(roots)
        if joined < _WORTH * asked.count():
            break
    more = materialize(_held(rest, least), "more")
    more = _confirmed(more, sets, docs, shingle, least)
    found = components(stars(roots).unionByName(more))
    return sets.select("doc_id", "text_key", "sid").join(found, F.col("sid") == F.col("node"), "left").select("doc_id", "text_key", F.coalesce("root", "sid").alias("component"))
