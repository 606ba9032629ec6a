"""Running sums and ranks against a plain sort."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from canarylake.operators.running import ranked, running


@pytest.mark.parametrize("ranges", [2, 7, 64])
def test_running_and_ranks_equal_a_sort(spark, ranges):
    """Values of any range, infinite ones, one that most rows have, tiny groups."""
    rng = random.Random(4)
    rows = [(g, v, rng.randrange(9)) for g, vs in {"a": [rng.gauss(0, 1e9) for _ in range(400)] + [float("inf"), -1e300], "b": [5.0], "c": [0.1 * i for i in range(50)], "d": [-3.0, 7.0]}.items() for v in dict.fromkeys(vs)]
    df = spark.createDataFrame(rows, "g string, v double, n long").repartition(6)
    got = {(r.g, r.v): (r.previous, r.next, r.s) for r in running(df, ["g"], "v", {"s": "n"}, ranges).collect()}
    for g in "abcd":
        mine, s = sorted(r for r in rows if r[0] == g), 0
        for i, (_, v, n) in enumerate(mine):
            s += n
            assert got[g, v] == (mine[i - 1][1] if i else None, mine[i + 1][1] if i + 1 < len(mine) else None, s)
    assert running(df.where("g = 'a'").drop("g"), [], "v", {"s": "n"}, ranges).agg(F.max("s")).first()[0] == sum(n for g, _, n in rows if g == "a")
    many = [("x", rng.choice([1.0, 1.0, 2.5, -4.0, float(i)]), i) for i in range(300)] + [("y", 0.0, 1), ("y", None, 0)]
    df = spark.createDataFrame(many, "g string, v double, i long").repartition(5)
    out = {(r.g, r.i): r["rank"] for r in ranked(df, ["g"], "v", "i", ranges=ranges).collect()}
    for g in "xy":
        mine = sorted((r for r in many if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        assert [out[g, r[2]] for r in mine] == list(range(1, len(mine) + 1))
