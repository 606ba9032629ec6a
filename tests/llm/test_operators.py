"""The first ten operators against brute force on small tables, and on odd input."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from canarylake.llm import ann, cotrain, mixing, packing, queries, sharding, simhash, substring, topk, toxicity, urlfilter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def random_docs(n=120, seed=3):
    """Texts with copies, near copies, shared passages, empty and null texts, and a repeated row."""
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)] + ["the", "of", "Ä", "ÉÀ", "x" * 60]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 19, 20, 21, 80, 300]))]
        kind = rng.random()
        if kind < 0.2:
            at = rng.randrange(len(words) + 1)
            a, b = sorted(rng.sample(range(60), 2))
            words[at:at] = passage[a:b]
        elif kind < 0.35 and rows:
            words = (rng.choice(rows)[1] or "").split()
            if words and rng.random() < 0.6:
                words[rng.randrange(len(words))] = "CHANGED"
        elif kind < 0.4:
            words = words[:40] * 3
        text = None if i == 7 else rng.choice([" ", "\n", "\t "]).join(words)
        rows.append((i * 3 - 20, text, "en", rng.choice(["a", "b", "c", None]), len(text or "")))
    rows += [rows[11], (None, rows[12][1], None, None, None), (10**15, "  \n ", "de", "z", 4)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(random_docs(), DOCS).withColumn("n_words", F.lit("clash")).withColumn("component_id", F.lit(1)).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# ------------------------------------------------------------------ 2

def brute_fingerprint(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=4):
    """prints: (doc_id, fp) pairs; the least id that each reaches."""
    fps = sorted({f for _, f in prints})
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return sorted((d if d is not None else 10**18, f, least.get(root(f))) for d, f in prints)


def test_simhash_equals_brute_force(docs):
    got = [(r.doc_id if r.doc_id is not None else 10**18, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    want = brute_components([(r[0], brute_fingerprint(r[1])) for r in random_docs()])
    assert sorted(got) == want


@pytest.mark.parametrize("shard", [2048, 3])
def test_links_span_all_close_pairs(spark, shard):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(7))) for b in base for _ in range(6)} | {0, 2**64 - 1}
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    edges = simhash.link(spark.createDataFrame([(f,) for f in signed], "fp long"), shard_size=shard).collect()
    from_edges = [(e.a & (2**64 - 1), e.b & (2**64 - 1)) for e in edges]
    assert all((a ^ b).bit_count() <= 4 for a, b in from_edges)
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in from_edges:
        parent[root(a)] = root(b)
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 4:
                assert root(a) == root(b)


def test_simhash_of_no_rows(none):
    assert simhash.near_duplicates(none).count() == 0


# ------------------------------------------------------------------ 3

def test_shards_fit_and_are_minimal(docs, none):
    limit = 4000
    rows = sharding.assign_shards(docs, limit).collect()
    assert len(rows) == docs.count()
    sums = Counter()
    for r in rows:
        sums[(r.shard, r.part)] += r.bytes
        assert r.shard_bytes <= limit
    assert all(sums[(r.shard, r.part)] == r.shard_bytes for r in rows)
    names = {r.shard for r in rows}
    assert not any(a != b and b.startswith(a) for a in names for b in names), "shards are prefix-free"
    by = Counter()
    for r in rows:
        for d in range(len(r.shard)):
            by[r.shard[:d]] += r.bytes
    assert all(by[n[:-1]] > limit for n in names if n), "only oversized buckets split"
    assert sharding.assign_shards(none, limit).count() == 0


def test_one_key_over_the_limit_goes_to_parts(spark):
    same = spark.createDataFrame([(5, "x" * 60)] * 10 + [(6, "y" * 500), (7, None)], "doc_id long, text string")
    rows = sharding.assign_shards(same, 200).collect()
    sums = Counter()
    for r in rows:
        sums[(r.shard, r.part)] += r.bytes
    assert len(rows) == 12 and all(v <= 200 or v == 500 for v in sums.values())


# ------------------------------------------------------------------ 4

def brute_repeats(rows, window=20):
    first = {}
    rank = lambda d: 10**18 if d is None else d
    split = [(rank(d), WORD.findall(t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d, i):
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("piece", [16 << 20, 3000])
def test_substring_removal_equals_brute_force(docs, none, piece):
    got = substring.remove_repeats(docs, carry=("lang",), piece_bytes=piece).select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h")).collect()
    assert sorted((10**18 if r[0] is None else r[0], r[1], r[2], r[3]) for r in got) == brute_repeats([(r[0], r[1]) for r in random_docs()])
    assert substring.remove_repeats(none).count() == 0


def test_cover_is_a_difference_cover():
    for d in range(substring.PERIOD):
        assert any((i + d) % substring.PERIOD in substring.COVER for i in substring.COVER)


# ------------------------------------------------------------------ 5, 8

def vectors(spark, n=1500, dims=24, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[50:130] = x[49]
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]
    rows[20] = (20, None, 0)
    rows[21] = (21, [0.0] * dims, 0)
    rows[22] = (22, [float("nan")] * dims, 0)
    rows[23] = (23, [None] * dims, 0)
    rows[24] = (24, [1.0], 0)
    return spark.createDataFrame(rows + [(None, rows[3][1], 0)], "vec_id long, embedding array<float>, label int"), rows, x


def usable(rows, dims, zero):
    return [(i, list(v) + [0.0] * (dims - len(v))) for i, v, _ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v) and (zero or any(v))]


def test_bit_slices_add_and_select():
    rng = np.random.default_rng(0)
    q = rng.integers(-300, 300, (1000, 9))
    low, bits, planes = topk.slices(q)
    for w in (rng.integers(-200, 200, 9), np.zeros(9, np.int64), np.full(9, -1)):
        total, base = topk.add_slices(w, low, bits, planes)
        got = np.full(1000, base)
        every = np.arange(1000)
        for k, p in enumerate(total):
            got += ((p[every >> 6] >> (every & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << k
        assert (got == q @ w).all()
        mask = np.pad(np.packbits(np.ones(1000, np.uint8), bitorder="little"), (0, planes.shape[1] * 8 - 125)).view(np.uint64)
        want = np.lexsort((every, -(q @ w)))[:7]
        assert topk.select_top(total, mask, 7).tolist() == sorted(want.tolist())


def test_top_k_equals_brute_force(spark):
    df, rows, _ = vectors(spark)
    good = usable(rows, 24, zero=True)
    ids = np.array([i for i, _ in good])
    q = np.floor(256 * np.array([v for _, v in good], np.float64)).astype(np.int64)
    want = []
    for a, i in enumerate(ids):
        if i % 50 == 0:
            s = q @ q[a]
            order = [b for b in np.lexsort((ids, -s)) if b != a][:5]
            want += [(int(i), r + 1, int(ids[b]), int(s[b])) for r, b in enumerate(order)]
    got = topk.top_k(df, block_rows=400, batch=7).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert topk.top_k(df.where("false")).count() == 0


def test_neighbours_recall(spark):
    df, rows, _ = vectors(spark)
    good = usable(rows, 24, zero=False)
    ids = np.array([i for i, _ in good])
    x = np.array([v for _, v in good], np.float64)
    got = defaultdict(list)
    for r in ann.nearest(df, graph_options={"leaf": 128, "trees": 8, "k": 24}).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for a, i in enumerate(ids):
        if i % 20:
            continue
        s = x @ x[a]
        want = [int(ids[b]) for b in np.lexsort((ids, -np.round(s, 12))) if b != a][:20]
        mine = sorted(got[int(i)])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert all(abs(m[2] - float(x[np.flatnonzero(ids == m[1])[0]] @ x[a])) < 1e-9 for m in mine)
        hit += len({m[1] for m in mine} & set(want))
        total += 20
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    assert hit / total > 0.95
    assert ann.nearest(df.where("false")).count() == 0


@pytest.mark.parametrize("graph", [{}, {"k": 24}])
def test_neighbours_with_outliers_and_odd_lengths(spark, graph):
    """A row far larger than all others, shorter rows, and repeated ids change nothing for the others."""
    df, rows, x = vectors(spark, n=400)
    more = [(1000, [1e30] + [0.0] * 23, 0), (1020, [0.5, 0.25], 0), (40, [0.125] * 24, 0), (40, [0.5] * 24, 0)]
    both = df.where("vec_id <> 40").unionByName(spark.createDataFrame(more, df.schema))
    good = [(i, np.pad(np.array(v, np.float64), (0, 24 - len(v)))) for i, v, _ in [r for r in rows if r[0] != 40] + more if v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    good += [(24, np.pad([1.0], (0, 23)))] if not any(i == 24 for i, _ in good) else []
    ids, m = np.array([i for i, _ in good]), np.array([v for _, v in good])
    got = defaultdict(list)
    for r in ann.nearest(both, graph_options=graph).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for q in sorted({int(i) for i in ids if i % 20 == 0}):
        me = np.array(min(m[ids == q].tolist()))
        s = m @ me
        s[ids == q] = -np.inf
        want = [int(ids[b]) for b in np.lexsort((ids, -s))[:20]]
        assert [r for r, _, _ in sorted(got[q])] == list(range(1, 21))
        hit += len({v for _, v, _ in got[q]} & set(want))
        total += 20
    assert 1020 in got and hit / total > 0.95


def test_neighbours_of_equal_vectors(spark):
    """Other ids with the vector of a query are its nearest, in groups larger than k and in a table of one vector too."""
    schema = "vec_id long, embedding array<float>"
    one = spark.createDataFrame([(i, [0.5, 0.25, 0.0]) for i in range(41)], schema)
    got = defaultdict(list)
    for r in ann.nearest(one).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    for q in (0, 20, 40):
        assert sorted(got[q]) == [(i + 1, v, 0.3125) for i, v in enumerate([v for v in range(41) if v != q][:20])]
    assert ann.nearest(one.where("vec_id = 20")).count() == 0
    few = ann.nearest(one.where("vec_id in (20, 33)")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(20, 1, 33)]
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 16)).astype(np.float32)
    x[40:75] = x[40]  # a group larger than k, with two queries
    x[100:103] = x[100]
    got = defaultdict(set)
    for r in ann.nearest(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], schema)).collect():
        got[r.query_id].add(r.vec_id)
    hit, d = 0, x.astype(np.float64)
    for q in range(0, 300, 20):
        s = d @ d[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.lexsort((np.arange(300), -np.round(s, 9)))[:20].tolist()))
    assert hit / (20 * 15) > 0.95


def test_neighbours_with_the_settings_of_the_query(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.select("vec_id", "embedding").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.array(rows["embedding"].tolist(), np.float64)
    got = queries.op5_ann(spark, "/root/testdata/sf0.1").toPandas().groupby("query_id")["vec_id"].apply(set)
    hit = 0
    for a in np.flatnonzero(ids % 20 == 0):
        s = x @ x[a]
        s[a] = -np.inf
        hit += len(got[ids[a]] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert hit / (20 * len(got)) > 0.95


def test_top_k_with_large_components_and_odd_lengths(spark):
    rows = [(0, [1.0, 2.0]), (1, [1e6, 0.5]), (2, [0.5, 0.25]), (3, [-1e15, 3.0]), (4, [1e30, 0.0]), (5, [2.0]), (6, []), (7, None), (8, [None, 1.0]), (9, [float("inf"), 1.0]), (50, [4.0, 0.5, -1.0]), (50, [3.0]), (100, [1e17, 1e17])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    full = [(i, [int(np.floor(256 * c)) if abs(256 * c) < 2**53 else int(256 * c) for c in v] + [0] * (3 - len(v))) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    want = []
    for q in (0, 50, 100):
        me = min(v for i, v in full if i == q)
        best = sorted(((-sum(a * b for a, b in zip(me, v)), i) for i, v in full if i != q))[:5]
        want += [(q, r + 1, i, -s if abs(s) < 2**63 else None) for r, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in topk.top_k(df, block_rows=4, batch=2).collect()) == sorted(want)


# ------------------------------------------------------------------ 6

def test_packing_tiles_every_document(spark, docs, none):
    path, ranks = queries.tokenizer_paths()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    long = spark.createDataFrame([(500, "word " * 9000 + "<|endoftext|> 漢字"), (501, "")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(long)
    want = Counter()
    for r in rows.collect():
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        want[(r.doc_id, len(ids), zlib.crc32(ids.tobytes()))] += 1
        if r.doc_id == 500:
            big = ids
    out = packing.pack(rows, path, ranks, size=256, open_windows=4).collect()
    seqs, pieces = defaultdict(list), defaultdict(list)
    for r in out:
        seqs[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at and n > 0
            at += n
        assert at <= 256
    short = [s for s in seqs.values() if sum(n for _, n in s) < 256 - packing.MIN_CUT]
    assert len(short) <= 1
    assert sum(r.length for r in out) == sum(n * c for (_, n, _), c in want.items())
    for p in pieces[500]:
        assert p.ids_crc32 == zlib.crc32(big[p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(big)
    whole = Counter((r.doc_id, r.length, r.ids_crc32) for r in out if r.length == r.doc_tokens)
    assert not whole - want
    assert packing.pack(none, path, ranks).count() == 0


# ------------------------------------------------------------------ 10

def brute_targets(sizes, most=3):
    """Reshare by weight until no target is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped = {}
    while True:
        rest = [s for s in names if s not in capped]
        left = sum(sizes.values()) - sum(capped.values())
        target = {s: left * weight[s] / sum(weight[t] for t in rest) for s in rest}
        over = [s for s in rest if target[s] > most * sizes[s]]
        if not over:
            return {**capped, **target}
        capped.update({s: most * sizes[s] for s in over})


def test_mixing_meets_its_targets(docs, none):
    rows = mixing.Mix(docs, block_words=16).taken().collect()
    texts = random_docs()
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter((t[0], t[3], len(WORD.findall(t[1] or ""))) for t in texts)
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = brute_targets(dict(sizes))
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 40 + 0.02 * want[s]
    again = mixing.Mix(docs.repartition(3), block_words=16).taken().collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert mixing.Mix(none).taken().count() == 0


def test_shards_draw_multinomial_counts(spark):
    k = {1: 20_000, 2: 9_000, 3: 700, 4: 300}
    plan = spark.createDataFrame(list(k.items()), "s int, k long")
    rows = mixing.multinomial(plan, 500, 17).collect()
    per, total = defaultdict(Counter), Counter()
    for r in rows:
        per[r.shard][r.s] += r.n
        total[r.s] += r.n
    assert dict(total) == k and len(per) == 60 and all(sum(c.values()) == 500 for c in per.values())
    for s, n in k.items():
        p = n / 30_000
        spread = np.array([per[d][s] for d in per]).var() / (500 * p * (1 - p))
        assert 0.5 < spread < 1.7, "as wide as a multinomial's"


def held_by(spans):
    """Words that the mix takes of each unit, from its parts."""
    got = Counter()
    for r in spans:
        got[(r.doc_id, r.source, r.text_key, r.copy)] += r.words * r.times
    return got


def test_mixed_documents_hold_what_is_taken(docs):
    """Repeated rows are there, inside a source: what each document holds in the mix is what its rows take together."""
    rows = mixing.Mix(docs, block_words=16).taken().collect()
    want, got = Counter(), Counter()
    for r in rows:
        want[(r.doc_id, r.source, r.size)] += r.taken
    size = {(r.doc_id, r.source, r.text): len(WORD.findall(r.text or "")) for r in docs.collect()}
    per_id = defaultdict(set)
    for (d, s, _), n in size.items():
        per_id[(d, s)].add(n)
    for r in mixing.mixed_documents(docs, block_words=16).collect():
        got[(r.doc_id, r.source)] += len(WORD.findall(r.text))
    sums = Counter()
    for (d, s, _), n in want.items():
        sums[(d, s)] += n
    assert {k: v for k, v in sums.items() if v} == dict(got)


def test_mixing_of_repeated_rows(spark):
    """One text and id under two sources, and many times under one: every source meets its target, no row is taken over three times."""
    rng = random.Random(1)
    text = " ".join(f"t{i}" for i in range(1280))
    rows = [(1, text, "a"), (1, text, "b"), (None, text, "b"), (None, text, None), (None, text, None)]
    rows += [(i, " ".join(f"v{rng.randrange(99)}" for _ in range(rng.randrange(1, 90))), rng.choice(["a", "b", "c"])) for i in range(10, 200)]
    rows += [(7, "seven words are here seven times over", "c")] * 50 + [(8, "", "a")] * 3
    # names that a join or a window could take for its own
    df = spark.createDataFrame([(d, t, s, i, 1, 2, {"x": 1}) for i, (d, t, s) in enumerate(rows)], "doc_id long, text string, source string, copy int, d int, spans int, k map<string,int>")
    mix = mixing.Mix(df, block_words=16)
    taken = mix.taken().collect()
    assert Counter((r.doc_id, r.source, r.size) for r in taken) == Counter((d, s, len(WORD.findall(t))) for d, t, s in rows)
    sizes, sums = Counter(), Counter()
    for r in taken:
        sizes[r.source] += r.size
        sums[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = brute_targets(dict(sizes))
    for s in sizes:
        assert abs(sums[s] - want[s]) <= 40 + 0.02 * want[s], s
    # what the slots take is what the rows take
    assert sum(sums.values()) == sum(held_by(mix.takes().collect()).values())
    out = mixing.mixed_documents(df, block_words=16).collect()
    got, most = Counter(), Counter()
    for r in out:
        got[r.source] += len(WORD.findall(r.text))
        most[r["copy"]] += len(WORD.findall(r.text))
        assert r.k == {"x": 1} and r.d == 1 and r.spans == 2
    assert got == +sums
    assert all(n <= 3 * len(WORD.findall(rows[i][1])) for i, n in most.items())
    words = Counter((d, s) for d, _, s in rows)
    assert all(words[(r.doc_id, r.source)] for r in out)


def test_permutation(spark):
    for n in (1, 2, 97, 1000):
        out = spark.range(n).select(mixing.permute(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p")).collect()
        assert sorted(r.p for r in out) == list(range(n))


# ------------------------------------------------------------------ 1

def test_url_rules_and_parts(spark):
    urls = {1: "HTTP://Www.Example.COM/en/7?x", 2: "https://a.example.com/en/8#t", 3: "https://xexample.com/en/7", 4: "https://b.example.net/de/81", 5: "http://c.net/de/", 6: "https://d.org/es/1", 7: None, 8: "nothing", 9: "ftp://com/en/", 10: "http://host?x://y/z", 11: "http://k.org/p/1/2/3/4/5/6/7/8"}
    pages = spark.createDataFrame([(k, v, "x") for k, v in urls.items()] + [(1, urls[1], "x")], "page_id long, url string, host string")
    out = urlfilter.judge_urls(pages, spark.createDataFrame([], "page_id long, bad boolean"), queries.RULES).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}
    assert len(out) == 12
    assert got[1] == ("www.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[2] == ("a.example.com", "/en/8", "com/en/", "block")
    assert got[3][2:] == ("com/en/", "block")
    assert got[4][2:] == ("example.net/de/8", "block")
    assert got[5][2:] == ("net/de/", "allow")
    assert got[6][2:] == ("org/es/", "block")
    assert got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow")
    assert got[9] == ("com", "/en/", "com/en/", "block")
    assert got[10] == ("host", "", None, "allow")
    assert urlfilter.judge_urls(pages.where("false"), spark.createDataFrame([], "page_id long, bad boolean")).count() == 0


ID = re.compile(r"^(?:\d+|[0-9a-f]{8,}|[0-9a-f]{8}-[0-9a-f-]{27}|\d{4}-\d{2}-\d{2})(?:\.\w{1,5})?$")


def brute_templates(paths):
    """paths: {path: n} of one host; the template of each, node by node from the root."""
    out = {}

    def go(prefix, d, members):
        here = [(p, s) for p, s in members if len(s) > d]
        out.update({p: prefix for p, s in members if len(s) <= d})
        names = {p: "*" if ID.match(s[d]) else s[d] for p, s in here}
        if len(here) == 1:
            p, s = here[0]
            out[p] = prefix + tuple("*" if ID.match(x) else x for x in s[d:])
            return
        kinds = {n for n in names.values() if n != "*"}
        visits = sum(paths[p] for p, n in names.items() if n != "*")
        wild = len(kinds) >= 16 and len(kinds) >= 0.5 * visits
        kids = defaultdict(list)
        for p, s in here:
            kids["*" if wild else names[p]].append((p, s))
        for n, m in kids.items():
            go(prefix + (n,), d + 1, m)

    go((), 0, [(p, [x for x in p.split("/") if x]) for p in paths])
    return out


def brute_merge(labels):
    """labels: {template: [labelled, bad]}; the branch of each template."""
    to = {t: t for t in labels}
    for d in range(max(map(len, labels), default=0) - 1, -1, -1):
        sums, pools = defaultdict(lambda: [0, 0]), defaultdict(list)
        for t, (n, b) in labels.items():
            if len(to[t]) > d:
                sums[to[t]][0] += n
                sums[to[t]][1] += b
        for m in sums:
            pools[m[:d] + ("*",) + m[d + 1 :]].append(m)
        now = {}
        for w, ms in pools.items():
            n, b = (sum(sums[m][k] for m in ms) for k in (0, 1))
            share = (b + 1) / (n + 2)
            for m in ms:
                mine = sums[m]
                close = mine[0] == 0 or abs(mine[1] / mine[0] - share) <= 1.96 * (share * (1 - share) / mine[0]) ** 0.5
                now[m] = w if close and len(ms) > 1 else m
        to = {t: now.get(m, m) for t, m in to.items()}
    return to


def test_url_verdicts_equal_brute_force(spark):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(900):
        host = rng.choice(["hot.example"] * 4 + ["b.example", "c.example"])
        kind = rng.choice(["a", "b", "c", "post", "tag"])
        deep = ["x", "y"][: rng.randrange(3)] + rng.choice([[], ["d1", "d2", "d3", "d4", "d5", "d6", rng.choice(["good", "bad"]), "p%d" % i]])
        path = "/" + "/".join([kind, *deep, rng.choice(["item%d" % rng.randrange(60), str(i), "same", "2024-01-%02d" % rng.randrange(1, 29)])])
        rows.append((i, f"http://{host}{path}" + rng.choice(["", "?q=1"]), host, path))
        if rng.random() < 0.6:
            marks.append((i, "bad" in deep or (kind == "tag" and rng.random() < 0.9) or rng.random() < 0.1))
    got = {r.page_id: (r.template, round(r.purity, 9), r.verdict) for r in urlfilter.judge_urls(spark.createDataFrame([r[:2] for r in rows], "page_id long, url string").repartition(4), spark.createDataFrame(marks, "page_id long, bad boolean")).collect()}
    bad = dict(marks)
    overall = 1 - sum(bad.values()) / len(bad)
    for host in {r[2] for r in rows}:
        mine = [r for r in rows if r[2] == host]
        tmpl = brute_templates(Counter(r[3] for r in mine))
        labels = {t: [0, 0] for t in tmpl.values()}
        for r in mine:
            if r[0] in bad:
                labels[tmpl[r[3]]][0] += 1
                labels[tmpl[r[3]]][1] += bad[r[0]]
        to, sums = brute_merge(labels), defaultdict(lambda: [0, 0])
        for t, (n, b) in labels.items():
            sums[to[t]][0] += n
            sums[to[t]][1] += b
        for r in mine:
            m = to[tmpl[r[3]]]
            n, b = sums[m]
            purity = (n - b + 4 * overall) / (n + 4)
            assert got[r[0]] == (host + "/" + "/".join(m), round(purity, 9), "block" if purity < 0.5 else "allow")
    assert {v for _, _, v in got.values()} == {"allow", "block"}


def test_very_long_urls_take_no_more_rounds(spark, monkeypatch):
    """Paths of thousands of segments, alone, and two that part at their ends, are judged in as many steps as short ones."""
    steps = []
    real = urlfilter.materialize
    monkeypatch.setattr(urlfilter, "materialize", lambda df, name: steps.append(name) or real(df, name))
    none = spark.createDataFrame([], "page_id long, bad boolean")
    short = [(i, f"http://h.example/a/{i % 3}x/p{i % 2}") for i in range(12)]
    urlfilter.judge_urls(spark.createDataFrame(short, "page_id long, url string"), none).count()
    few = len(steps)
    steps.clear()
    deep = "/".join("s%d" % i for i in range(2000))
    more = [(100, "http://h.example/" + deep), (101, f"http://g.example/{deep}/x"), (102, f"http://g.example/{deep}/y"), (103, f"http://g.example/{deep}/y/12")]
    got = {r.page_id: r.template for r in urlfilter.judge_urls(spark.createDataFrame(short + more, "page_id long, url string"), none).collect()}
    assert len(steps) <= few + 6
    assert got[100] == "h.example/" + deep and got[101] == got[102] == f"g.example/{deep}/*" and got[103] == f"g.example/{deep}/y/*"


def test_bad_templates_are_rejected(spark):
    rows, labels = [], []
    for i in range(400):
        kind = "tag" if i % 2 else "post"
        rows.append((i, f"http://h.example/{kind}/item-{i}/view"))
        labels.append((i, kind == "tag"))
    pages, marks = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad boolean")
    out = urlfilter.judge_urls(pages, marks).collect()
    assert {(r.template, r.verdict) for r in out} == {("h.example/tag/*/view", "block"), ("h.example/post/*/view", "allow")}
    same = urlfilter.judge_urls(pages, marks.withColumn("bad", F.col("page_id") % 7 == 0)).collect()
    assert {r.template for r in same} == {"h.example/*/*/view"}


# ------------------------------------------------------------------ 7, 9

def test_chosen_features_that_share_a_slot_are_both_found():
    from canarylake.llm.features import Chosen

    many = [5, 5 + (1 << 20), 5 + (3 << 20), 7, *range(100_000, 150_000)]
    hit, place = Chosen(many).find(np.array([7, 5 + (2 << 20), 5, 5 + (3 << 20), 149_999, 8]))
    assert hit.tolist() == [0, 2, 3, 4] and [many[p] for p in place] == [7, 5, 5 + (3 << 20), 149_999]
    assert len(Chosen([]).find(np.array([1, 2]))[0]) == 0


def test_severity_equals_brute_force(spark, docs):
    """Scores of a given model, text by text, from the hashes of its words."""
    from canarylake.llm.features import word_features
    import pyarrow as pa

    texts = [r[1] or "" for r in random_docs()]
    row, h = word_features(pa.array(texts))
    chosen = sorted(set(h.tolist()))[::7]
    weights = np.linspace(-1, 1, len(chosen))
    model = toxicity.OrdinalModel(chosen, weights, np.array([0.1, 0.4, 1.2]))
    at = {f: w for f, w in zip(chosen, weights)}
    want = []
    for i, r in enumerate(random_docs()):
        z = sum(at[f] for f in set(h[row == i].tolist()) if f in at)
        above = [1 / (1 + np.exp(-(z - c))) for c in (0.1, 0.4, 1.2)]
        share = [a - b for a, b in zip([1, *above], [*above, 0])]
        toxic = above[0] >= 0.5
        want.append((r[0], round(sum(above), 9), max(1, int(np.argmax(share))) if toxic else 0, toxic))
    got = [(r.doc_id, round(r.severity, 9), r.grade, r.toxic) for r in toxicity.severity(docs, model).collect()]
    assert Counter(got) == Counter(want)
    kept = toxicity.keep_clean(docs.withColumn("toxic", F.lit("clash")), model)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(w[0] for w in want if not w[3])


def test_classification_equals_training_and_scoring(spark, none):
    """Texts read once or twice give the same scores, and views learn from each other: a source without labels is told apart."""
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(1500):
        good = i % 3 > 0
        source = ("g1" if good else "b1") if i % 2 else ("g2" if good else "b2")
        text = " ".join(rng.choice(["alpha", "beta", "gamma"] if good else ["zeta", "eta", "theta"]) + rng.choice(["", "x"]) for _ in range(20))
        rows.append((i, text, "en", source, len(text)))
        if source in ("g1", "b1") and i % 4 < 2:
            labels.append((i, int(good), 0))
    docs = spark.createDataFrame([*rows, (None, rows[0][1], "en", "g2", 3), (1, rows[1][1], "en", "b1", None), (9000, "", None, None, None), (9001, None, "en", "g1", 0)], DOCS).repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one = {(r.doc_id, round(r.score, 9), r.keep) for r in cotrain.classify(docs, marks).collect()}
    model = cotrain.train(docs, marks)
    assert one == {(r.doc_id, round(r.score, 9), r.keep) for r in cotrain.score(docs, model).collect()}
    kept = {d: k for d, _, k in one}
    assert sum(kept[r[0]] == (r[0] % 3 > 0) for r in rows) > 0.98 * len(rows)
    names = dict(zip(model.meta.chosen, model.meta.theta))
    ids = {s: spark.range(1).select(F.pmod(F.xxhash64(F.lit("source=" + s)), F.lit(1 << 48))).first()[0] for s in ("g2", "b2")}
    assert names[ids["g2"]] > 0.1 > -0.1 > names[ids["b2"]], "learnt from the text view alone"
    assert cotrain.classify(none, marks).count() == 0


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"  # 4,000 labels; the 400 of sf0.01 do not hold most of the words
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where("doc_id % 3 <> 0"))
    assert (np.diff(model.cuts) > 0).all()
    got = toxicity.severity(docs, model, carry=("lang",)).join(labels.where("doc_id % 3 = 0").select("doc_id", F.col("toxic").alias("truth")), "doc_id").select("toxic", "doc_id", "truth").toPandas()
    assert len(got) > 100
    truth = got["truth"] == 1
    assert got["toxic"][truth].mean() > 0.6 and got["toxic"][~truth].mean() < 0.02


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(0)
    n = 2000
    x = rng.random((n, 6)) < 0.4
    z = x @ np.array([2.0, 1.5, 1.0, 0, 0, -1.0])
    grade = np.clip(np.floor(z + rng.normal(0, 0.3, n)), 0, 3).astype(int)
    row, col = np.nonzero(x)
    w, c = toxicity.fit_ordinal(row, col, grade, 6, 4)
    model = toxicity.OrdinalModel(list(range(6)), w, c)
    expected = model.above(x @ w).sum(axis=1)
    assert np.corrcoef(expected, grade)[0, 1] > 0.85 and (np.diff(c) > 0).all()


def test_classifiers_on_odd_input(spark, docs, none):
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (4, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert toxicity.severity(docs, model).count() == docs.count()
    assert toxicity.severity(none, model).count() == 0
    joint = cotrain.train(docs, labels)
    assert cotrain.score(docs, joint).count() == docs.count()
    assert cotrain.score(none, joint).count() == 0


def test_co_training_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels, pages = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "pages"))
    model = cotrain.train(docs, labels.where("doc_id % 3 <> 0"), pages.select("url"))
    got = cotrain.score(docs, model, pages.select("url"))
    assert got.count() == docs.count()
    held = got.join(labels.where("doc_id % 3 = 0"), "doc_id").select("keep", "quality").toPandas()
    good = held["quality"] == 1
    assert held["keep"][good].mean() > 0.95 and held["keep"][~good].mean() < 0.5


def test_queries_have_oracles_with_their_names():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert [int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES] == list(range(1, 14))
