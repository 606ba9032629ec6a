"""Ranked lexical search against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from canarylake.llm import lexical

TERM = re.compile(lexical.TERM)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, k):
    """``{item: [(doc, score), ...]}`` by the definition, rows of documents each on their own."""
    counts = [(d, Counter(TERM.findall(lower(t)))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, length = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    terms = defaultdict(set)
    for item, text in items:
        terms[item] |= set(TERM.findall(lower(text)))
    out = {}
    for item, ts in terms.items():
        scored = []
        for d, c, n in counts:
            m = 10 + (90 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if s > 0:
                scored.append((-s, d is None, d))
        if scored:
            out[item] = [(d, -s) for s, _, d in sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k]]
    return out


def found(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        assert r["rank"] == len(out[r["item_id"]]) + 1
        out[r["item_id"]].append((r["doc_id"], r["score"]))
    return dict(out)


def tables(spark):
    rng = random.Random(5)
    vocab = ["w%d" % i for i in range(60)] + ["Straße", "été", "ÉTÉ", "a", "an", "ana", "x-y", "don't", "漢字"]
    docs = []
    for i in range(250):
        words = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 5, 30, 200]))]
        docs.append((i, rng.choice([" ", ", ", "\n", "--", "\x00"]).join(w.upper() if rng.random() < 0.2 else w for w in words)))
    docs += [(300, None), (301, ""), (302, " .,; "), (7, docs[7][1]), (7, docs[7][1]), (None, docs[9][1]), (None, docs[8][1]), (303, "w1 " * 60000), (304, "ana an a"), (305, "\x7fana")]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(12))) for i in range(30)]
    items += [(40, None), (41, "?!"), (42, "nowhere"), (43, "W1 w1 w1"), (44, "ana"), (None, "w2"), (45, "w3"), (45, "w4, w5")]
    left = spark.createDataFrame([(d, t, "item", 1) for d, t in docs], "doc_id long, text string, item_id string, score int")
    return docs, items, left, spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")


@pytest.mark.parametrize("k, most", [(10, 500_000), (3, 80)])
def test_search_equals_brute_force(spark, k, most):
    """Ties, repeated rows, null ids, odd separators and a very long text; in one share of the items and in many."""
    docs, items, left, right = tables(spark)
    got = lexical.search(left.repartition(7), right, k=k, most_terms=most)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert found(got.collect()) == brute(docs, items, k)


def test_search_of_empty_tables(spark):
    _, _, left, right = tables(spark)
    assert lexical.search(left.where("false"), right).count() == 0
    assert lexical.search(left, right.where("false")).count() == 0
    assert lexical.search(left, right.where("item_id = 42")).count() == 0
    assert lexical.search(left.where("doc_id in (300, 301, 302)"), right).count() == 0
