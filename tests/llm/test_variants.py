"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from canarylake.llm import variants
from canarylake.llm.variants import FMIndex, one_error, shard_neighbours

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(docs, least_n=5):
    n = Counter()
    for doc, text in docs:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= least_n}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def made(seed=3, n=400):
    rng = random.Random(seed)
    letters = "abcdeéÿ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "ababab", "bababa", "aaaaaaab", "Straße÷x", "NAÏVEté"]

    def spelt(w):
        k, i, c = rng.random(), rng.randrange(len(w)), rng.choice(letters)
        return w if k < 0.6 else w[:i] + c + w[i:] if k < 0.7 else w[:i] + w[i + 1 :] if k < 0.8 else w[:i] + c + w[i + 1 :]

    pick = [w for i, w in enumerate(base) for _ in range(1 + 200 // (i + 1))]
    docs = [(i, rng.choice([" ", ", ", "1", "Ā", "\n"]).join(rng.choice([str.upper, str.lower, str.title])(spelt(rng.choice(pick))) for _ in range(rng.choice([0, 1, 30, 120])))) for i in range(n)]
    return docs + [(None, "aaaaaa " * 7), (None, None), (5, ""), (6, docs[6][1]), (6, docs[6][1]), (900, "abcdef" * 9000), (901, ("bcdefa" * 3000 + " ") * 6), (902, ("bcdefa" * 3000 + "x ") * 40), (903, "endsin"), (904, "letters"), (905, "日本語日本語日本語"), (906, "qqqqqq " * 5 + "qqqqqqw " * 25 + "qqqqqqwe " * 125)]


@pytest.mark.parametrize("shard_words", [16_384, 20])
def test_variants_equal_brute_force(spark, shard_words):
    """Ties, chains of forms, repeated rows, null ids and very long words; with shards of all words, and with groups dealt to many indexes."""
    docs = made()
    rows = spark.createDataFrame([(d, t, "w", 0) for d, t in docs], "doc_id long, text string, word string, n int").repartition(6)
    got = variants.variants(rows, shard_words=shard_words)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in got.collect()]
    want = brute(docs)
    assert len(got) == len(want) and set(got) == want
    assert any(r[1] and r[2] != r[1] for r in got), "no chain of forms"


def test_variants_of_empty_tables(spark):
    rows = spark.createDataFrame([(1, "short words"), (2, None), (3, "")], "doc_id long, text string")
    assert variants.variants(rows).count() == 0
    assert variants.variants(rows.where("false")).count() == 0
    with pytest.raises(ValueError):
        variants.variants(rows, least_size=5)


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abc", min_size=6, max_size=9), min_size=1, max_size=40))
def test_both_searches_find_each_pair_once(words):
    """Together, the search from the front and the one from the back find every pair, and none twice."""
    words = sorted(words)
    want = Counter({w: sum(one_edit(w, v) for v in words) for w in words})
    got: Counter = Counter()
    for back in (False, True):
        for word, n, best, _ in shard_neighbours(words, [1] * len(words), words, back):
            got[word] += n
            assert one_edit(word, best)
    assert got == +want


def test_index_finds_all_that_begin_alike():
    words = ["abab", "abba", "baab", "a", "ab"]
    index = FMIndex([np.array([ord(c) - 96 for c in w]) for w in words], 3)
    lo, hi = np.array([0]), np.array([index.n])
    for symbol in (0, 1, 2):  # the delimiter, a, b
        lo, hi = index.extend(lo, hi, np.array([symbol]))
    assert sorted(words[i] for i in index.word(np.arange(lo[0], hi[0]))) == ["ab", "abab", "abba"]
    who, hit = one_error(index, np.array([[1, 2, 2, 2]]), np.array([4]), np.array([2]))
    assert [(q, words[w]) for q, w in zip(who.tolist(), sorted(hit.tolist()))] == [(0, "abab"), (0, "abba")]
    who, hit = one_error(index, np.array([[1, 2, 2, 0]]), np.array([3]), np.array([1]))
    assert sorted(words[w] for w in hit.tolist()) == ["ab", "abab", "abba"]
