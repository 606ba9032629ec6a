"""The pipeline, stage by stage, on the smallest tables and on odd input."""

from __future__ import annotations

import random
import re
from collections import Counter

import corpus_pipeline as cp
from pyspark.sql import functions as F

from .test_operators import DOCS, WORD, brute_repeats, random_docs


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    n = docs.count()
    for name, stage in cp.STAGES[:-1]:
        docs = cp.materialize(stage(spark, docs, sf), name)
        assert docs.columns == columns, name
    assert 0 < docs.select("doc_id").distinct().count() <= n
    packed = cp.STAGES[-1][1](spark, docs, sf)
    assert packed.agg(F.sum("length")).first()[0] > 0


def jaccard_components(rows):
    """A number per row: components of links of a Jaccard similarity of 0.8 or more."""
    sets = [five_words(r[1]) for r in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    return root


def test_near_copies_keep_one_of_each_group(spark):
    """The least id of each group of Jaccard 0.8 or more on five-word shingles stays; null ids come last."""
    rows = random_docs()
    kept = [r.doc_id for r in cp.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), "").collect()]
    least = {}
    for r, c in zip(rows, jaccard_components(rows)):
        key = 10**18 if r[0] is None else r[0]
        least[c] = min(least.get(c, key), key)
    assert Counter(10**18 if d is None else d for d in kept) == Counter(least.values())


def test_stages_take_clashing_names_and_long_texts(spark, sf):
    """Columns with the names of results pass through, and a text of half a million words goes whole through every stage."""
    rng = random.Random(3)
    long = " ".join("l%d" % rng.randrange(10**6) for _ in range(500_000))
    docs = spark.createDataFrame([*random_docs(30), (7000, long, "en", "a", len(long)), (7001, long, "en", "b", len(long))], DOCS)
    names = ("toxic", "grade", "severity", "n_words", "n_removed", "kept_id", "component", "rest", "row", "key", "id", "fp", "sid", "tmpl")
    docs = docs.select("*", *[F.lit(n).alias(n) for n in names], F.create_map(F.lit("k"), F.lit(1)).alias("tags"))
    for name, stage in cp.STAGES[:-1]:
        docs = cp.materialize(stage(spark, docs, sf), name)
        assert docs.where(" and ".join(f"{n} = '{n}'" for n in names)).count() == docs.count() > 0, name
    assert docs.where(F.length("text") > 2_000_000).select("doc_id").distinct().count() == 1
    packed = cp.pack_windows(spark, docs, sf)
    assert packed.where("doc_id >= 7000").agg(F.sum("length")).first()[0] > 1_000_000


def test_repeats_go_and_clean_documents_stay(spark):
    rows = random_docs()
    docs = spark.createDataFrame(rows, DOCS)
    out = cp.drop_repeats(spark, docs, "").collect()
    want = Counter((d, n - k) for d, n, k, _ in brute_repeats([(r[0], r[1]) for r in rows]) if not k or k < n)
    assert Counter((10**18 if r.doc_id is None else r.doc_id, len(re.findall(WORD, r.text or ""))) for r in out) == want


def test_empty_documents(spark, sf):
    docs = spark.createDataFrame([], DOCS)
    for name, stage in cp.STAGES:
        docs = cp.materialize(stage(spark, docs, sf), name)
        assert docs.count() == 0, name


def five_words(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def edited(n=40, seed=5):
    """Texts of unlike words with copies of a Jaccard similarity around 0.8 and over, one of them a chain, beside random documents."""
    rng = random.Random(seed)
    rows = [r for r in random_docs() if r[0] is not None]
    for i in range(n):
        words = ["v%d" % rng.randrange(5000) for _ in range(rng.choice([6, 40, 120, 400]))]
        for j in range(4):
            rows.append((10_000 + 10 * i + j, " ".join(words), "en", "a", None))
            for at in rng.sample(range(len(words)), rng.choice([0, 1, max(1, len(words) // 60), max(1, len(words) // 40)])):
                words[at] = "u%d" % rng.randrange(5000)
    return rows


def test_near_copies_equal_brute_force_jaccard(spark):
    rows = edited()
    root = jaccard_components(rows)
    least = {}
    for r, c in zip(rows, root):
        least[c] = min(least.get(c, r[0]), r[0])
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    assert Counter(r.doc_id for r in cp.drop_near_copies(spark, docs, "").collect()) == Counter(least.values())


def test_near_copies_with_a_key_in_all_texts(spark, monkeypatch):
    """Unlike texts that share much of their words, dealt to many blocks and parts, beside copies: as brute force has it."""
    from canarylake.llm import jaccard

    monkeypatch.setattr(jaccard, "_BLOCK", 7)
    monkeypatch.setattr(jaccard, "_HOT", 3)
    rng = random.Random(12)
    shared = ["s%d" % i for i in range(60)]
    rows = []
    for i in range(70):
        words = shared[:]
        for at in rng.sample(range(60), rng.choice([1, 2, 3, 5])):
            words[at] = "d%d" % rng.randrange(40)
        rows.append((i, " ".join(words), "en", "a", 1))
    rows += [(100 + i, rows[i][1].upper(), "en", "b", 1) for i in range(10)]
    least = {}
    for r, c in zip(rows, jaccard_components(rows)):
        least[c] = min(least.get(c, r[0]), r[0])
    assert 1 < len(least) < 70
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert Counter(r.doc_id for r in cp.drop_near_copies(spark, docs, "").collect()) == Counter(least.values())


def test_near_copies_of_one_text_give_few_pairs(spark, monkeypatch):
    """Many near copies of a text, beside more texts that hold half of it, are joined by some pairs for each, not by all their pairs; as brute force has it."""
    from canarylake.llm import jaccard

    pairs = []
    confirmed = jaccard._confirmed
    monkeypatch.setattr(jaccard, "_confirmed", lambda p, *rest: (pairs.append(p.count()), confirmed(p, *rest))[1])
    rng = random.Random(21)
    base = ["b%d" % i for i in range(200)]
    rows = []
    for i in range(120):
        words = base[:]
        for at in rng.sample(range(200), rng.choice([1, 2, 3, 3, 4])):
            words[at] = "e%d" % rng.randrange(10**6)
        rows.append((i, " ".join(words), "en", "a", 1))
    for i in range(360):
        at, keep = rng.randrange(101), rng.choice([90, 95, 100])
        words = ["h%d" % rng.randrange(10**6) for _ in range(100)]
        rows.append((1000 + i, " ".join(words[:50] + base[at : at + keep] + words[50:]), "en", "b", 1))
    least = {}
    for r, c in zip(rows, jaccard_components(rows)):
        least[c] = min(least.get(c, r[0]), r[0])
    assert 360 <= len(least) < 400
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    assert Counter(r.doc_id for r in cp.drop_near_copies(spark, docs, "").collect()) == Counter(least.values())
    assert max(pairs) <= 2 * len(rows), pairs


def test_sets_of_other_roots_meet_in_all_blocks(spark, monkeypatch):
    """Each pair of different roots is named once, whether a key's sets are in one block or in many, some of them of its largest root."""
    import numpy as np
    from canarylake.llm import jaccard

    sig = bytearray(jaccard._short(jaccard._sig(np.arange(40, dtype=np.uint64))))  # the same for all: every pair may be alike
    monkeypatch.setattr(jaccard, "_BLOCK", 16)
    for n, others in ((12, 5), (90, 30), (200, 3), (60, 60)):
        root = [100 + i % 7 if i < others else 1 for i in range(n)]
        top, big = Counter(root).most_common(1)[0]
        rest = spark.createDataFrame([(5, i, 40, r, sig, n, top, big) for i, r in enumerate(root)], "key long, sid long, n int, root long, short binary, c long, top long, big long")
        got = Counter((r.a, r.b) for r in jaccard._held(rest, 0.8).collect())
        assert got == Counter((i, j) for i in range(n) for j in range(i) if root[i] != root[j])


def test_blocks_lose_no_pair():
    """Sizes and signatures keep every pair of a similarity of 0.8 or more, inside a block and across two."""
    import numpy as np
    from canarylake.llm import jaccard

    rng = np.random.default_rng(3)
    sets = []
    for n in (1, 4, 5, 30, 130, 700):
        base = rng.integers(1, 2**63, n).astype(np.uint64)
        for k in range(5):
            some = base.copy()
            for at in rng.integers(0, n, k * max(1, n // 45)):
                some[at] = rng.integers(1, 2**63)
            sets.append(np.unique(some[: max(1, n - rng.integers(0, 1 + n // 10))]))
    want = {(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    sizes, sigs, roots = [len(x) for x in sets], [jaccard._short(jaccard._sig(x)) for x in sets], list(range(len(sets)))
    inside = {tuple(sorted(p, reverse=True)) for p in jaccard.block_pairs(roots, sizes, roots, sigs, [False] * len(sets), 0.8)}
    assert want <= inside and len(inside) < 5 * len(want) + 20
    side = [i % 2 == 0 for i in roots]
    across = {tuple(sorted(p, reverse=True)) for p in jaccard.block_pairs(roots, sizes, roots, sigs, side, 0.8)}
    assert {p for p in want if side[p[0]] != side[p[1]]} <= across and all(side[a] != side[b] for a, b in across)


def test_null_and_repeated_ids_keep_clean_documents(spark):
    rng = random.Random(8)
    texts = [" ".join("q%d" % rng.randrange(10**6) for _ in range(30)) for _ in range(8)]
    ids = [None, None, None, 5, 5, 6, None, 7]
    rows = [(d, t, "en", "a", len(t)) for d, t in zip(ids, texts)]
    copy, again = (None, texts[5], "en", "a", None), (None, texts[6], "en", "a", len(texts[6]))
    docs = spark.createDataFrame([copy, *rows, again], DOCS).repartition(3)
    out = cp.drop_near_copies(spark, docs, "").collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(zip(ids, texts))


def test_pieces_give_back_their_texts(spark):
    import numpy as np
    from canarylake.llm import packing, queries

    tokenizer, ranks = queries.tokenizer_paths()
    rows = [(1, "alpha beta gamma delta", "en", "a", 1), (1, "alpha beta", "en", "a", 1), (None, "some other words", "en", "a", 1), (2, " ".join("n%d" % i for i in range(3000)), "en", "b", 1), (3, None, "en", "b", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    key = {r.k: (r.doc_id, r.text) for r in docs.select("doc_id", "text", F.xxhash64("text").alias("k")).collect()}
    parts, places = {}, {}
    for p in cp.pack_windows(spark, docs, "").collect():
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length and key[p.text_key][0] == p.doc_id
        parts.setdefault(p.text_key, {})[p.start] = ids
        places.setdefault(p.sequence_id, {})[p.offset] = ids
    encode = packing.ByteBPE(tokenizer).encode
    for k, (_, text) in key.items():
        assert [i for at in sorted(parts[k]) for i in parts[k][at]] == [*encode([text or ""])[0].tolist(), 1]
    assert all(at == sum(len(x) for b, x in w.items() if b < at) for w in places.values() for at in w)


def test_batches_for_python_are_bounded(spark, sf, monkeypatch):
    """A task of any number of rows sends them to Python in small batches, also where a stage's rows are made after it returned."""
    from canarylake.llm import jaccard, toxicity
    from canarylake.llm.common import by_bytes

    most = cp.BATCH_ROWS

    def strict(batch, column, size=1 << 20):
        assert batch.num_rows <= most
        return by_bytes(batch, column, size)

    monkeypatch.setattr(jaccard, "by_bytes", strict)
    monkeypatch.setattr(toxicity, "by_bytes", strict)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.union(docs).union(docs).coalesce(1)
    assert docs.count() > most
    old = spark.conf.get(cp._ROWS)
    try:
        for stage in (cp.drop_toxic, cp.drop_near_copies):
            spark.conf.set(cp._ROWS, 10_000)
            assert stage(spark, docs, sf).count() > 0
    finally:
        spark.conf.set(cp._ROWS, old)
