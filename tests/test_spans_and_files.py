"""Token spans against brute force, readout windows, and hashes of files of any size."""

from __future__ import annotations

import hashlib
import os
import random

import pytest

from canarylake.operators import generate
from canarylake.sources import lineage


def test_token_spans_equal_brute_force(spark):
    rng = random.Random(2)
    tokens, spans, want = [], [], {}
    for e in range(40):
        at, offs = 0, [(0, 0, 0)]
        for k in range(1, rng.randrange(2, 400)):
            at += rng.choice([0, 0, 1, 3])  # gaps that no token covers
            n = rng.choice([1, 2, 5, 900]) if k == 7 else rng.choice([1, 2, 5])
            offs.append((k, at, at + n))
            at += n
        tokens += [(f"e{e}", *o) for o in offs]
        for s in ("secret", "query", "payload"):
            a = rng.randrange(0, at + 20)
            b = a + rng.choice([1, 4, 40, 1000])
            spans.append((f"e{e}", s, a, b))
            hit = [o for o in offs if o[2] > o[1] and o[2] > a and o[1] < b]
            if not hit:
                want[f"e{e}", s] = (None, None, "not_covered")
            elif hit[0][1] > a or hit[-1][2] < b:
                want[f"e{e}", s] = (None, None, "partially_covered")
            else:
                want[f"e{e}", s] = (hit[0][0], hit[-1][0] + 1, None)
    t = spark.createDataFrame(tokens, "example_id string, token_index int, start int, end int").repartition(5)
    s = spark.createDataFrame(spans, "example_id string, section string, start int, end int")
    for bucket in (1, 16, 256):
        got = {(r["example_id"], r["section"]): (r["first"], r["last"], r["violation"]) for r in generate.token_spans(s, t, bucket).collect()}
        assert got == want
    assert {v[2] for v in want.values()} == {None, "not_covered", "partially_covered"}


def test_readout_begins_where_all_sections_are_read(spark):
    schema = "example_id string, secret_char_span array<int>, query_char_span array<int>, payload_char_span array<int>"
    rows = [("plain", [0, 3], [3, 9], None), ("payload", [0, 3], [3, 5], [5, 9]), ("early", [4, 9], [0, 4], None), ("first", [3, 5], [5, 9], [0, 3]), ("lost", [0, 3], [3, 40], None)]
    tokens = spark.createDataFrame([(r[0], i, i, i + 1) for r in rows for i in range(10)], "example_id string, token_index int, start int, end int")
    good, bad = generate.add_token_spans(spark.createDataFrame(rows, schema), tokens, width=4)
    assert {r.example_id: r.readout_token_indices for r in good.collect()} == {"plain": [5, 6, 7, 8], "payload": [5, 6, 7, 8]}
    assert {r.example_id: r.violation for r in bad.collect()} == {"early": "empty_readout", "first": "empty_readout", "lost": "query_partially_covered"}
    with pytest.raises(ValueError):
        generate.build_prompts(spark.range(5).selectExpr("id as template_id", "'s' as system", "'q' as query", "null as payload"), spark.createDataFrame([("c", "v")], "canary_id string, value string"), most=4)


def test_file_hashes_of_small_and_large_files(spark, tmp_path):
    names = {"a.bin": 10, "b c.txt": 3000, "sub/d.bin": 20_000_000, "sub/f%g.bin": 5000}
    want = {}
    for name, size in names.items():
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        data = os.urandom(size)
        (tmp_path / name).write_bytes(data)
        want[name] = hashlib.sha256(data).hexdigest()
    for whole in (1000, 64 << 20):
        for path in (str(tmp_path), f"file://{tmp_path}/"):
            got = {r["path"]: r["sha256"] for r in lineage.file_hashes(spark, path, whole).collect()}
            assert got == want, (whole, path)


def test_seeded_tokens(spark):
    """As the digests have it, byte by byte."""
    from pyspark.sql import functions as F

    letters = "abcdefghijklmnopqrstuvwxyz"
    letters += letters.upper() + "0123456789"
    d = lambda s, k, i, p: hashlib.sha256(f"{s}:{k}:{i}:{p}".encode())
    rows = [("s1", "api_key", 0), ("s1", "api_key", 7), ("x", "database_uri", 3), ("x", "other", 3), ("", "api_key", 1), ("x", "api_key", -1)]
    got = spark.createDataFrame(rows, "seed string, kind string, i int").withColumn("t", generate.seeded_token(F.col("kind"), F.col("seed"), F.col("i"))).collect()
    for r in got:
        s, k, i = r.seed, r.kind, r.i
        if not s or i < 0 or k == "other":
            assert r.t is None
        elif k == "api_key":
            assert r.t == "sk-hny-" + "".join(letters[b % 62] for b in d(s, k, i, "api_key:0").digest())
        else:
            assert r.t == f"postgres://hny_{d(s, k, i, 'user:0').hexdigest()[:8]}:{d(s, k, i, 'password:0').hexdigest()[:16]}@db.internal:{5000 + d(s, k, i, 'port').digest()[0] % 1000}/hny_{d(s, k, i, 'database:0').hexdigest()[:8]}"
