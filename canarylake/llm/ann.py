"""Approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors become one node.  A few random projection trees with small leaves give
every node a list to start from.  A round of NN-descent lets every node
introduce its neighbours, both ways, to each other (neighbours of
neighbours, by joins on node ids); pairs better than a node's worst neighbour go
to its list.  Rounds and searches work on vectors rounded to a byte per component, each by its own scale.
A query starts at its own node, repeatedly takes the best nodes it has not
opened and looks at their neighbours, both ways; its best candidates are scored on the original vectors.

How many rounds and steps there are follows from recall: a fixed number of queries is
held against all vectors, and the graph and the searches go on until they find the wanted share of these
queries' true neighbours, whatever the number of vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

_EDGE = "u long, v long, sim double"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, x)`` without null ids and null, zero or non-finite vectors."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    good = F.col(id_col).isNotNull() & F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf")))) & F.exists(vector_col, lambda v: v != 0)
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))


def _filled(lists: pa.Array, dims: int) -> np.ndarray:
    """Rows of doubles, filled up with zeros to ``dims``."""
    n = np.asarray(pa.compute.list_value_length(lists), np.int64)
    flat = np.asarray(lists.flatten(), np.float64)
    if len(flat) == len(n) * dims:
        return flat.reshape(len(n), dims)
    out = np.zeros((len(n), dims))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _codes(x: np.ndarray) -> list[bytes]:
    """Each row as its scale, a double, and a byte per component."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    small = np.rint(x / scale[:, None]).astype(np.int8)
    return [s.tobytes() + c.tobytes() for s, c in zip(scale, small)]


def _decoded(column) -> tuple[np.ndarray, np.ndarray]:
    """``(components, scales)`` of codes; the inner product of two rows is that of the components, by both scales."""
    rows = column.to_pylist()
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    return raw[:, 8:].view(np.int8).astype(np.float32), np.ascontiguousarray(raw[:, :8]).view(np.float64).ravel()


def _top(sim: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest entries of each row."""
    k = min(k, sim.shape[1])
    return np.argpartition(-sim, k - 1, axis=1)[:, :k] if k < sim.shape[1] else np.tile(np.arange(k), (len(sim), 1))


def _batch(cols: tuple, names: tuple, kinds: tuple) -> pa.RecordBatch:
    """Lists of arrays, end to end, as one batch."""
    return pa.record_batch([pa.array(np.concatenate(c) if c else np.zeros(0, k)) for c, k in zip(cols, kinds)], names=list(names))


def _encode(nodes: DataFrame, trees: int, depth: int, dims: int, seed: int) -> DataFrame:
    """``(id, code, cells)``: vectors in bytes, and the leaf of each tree as the signs of random projections."""
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((trees, max(depth, 1), dims))
    weights = 1 << np.arange(max(depth, 1))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _filled(b.column(1), dims)
            bits = np.einsum("nd,tpd->tnp", x / np.abs(x).max(axis=1)[:, None], planes) > 0
            cells = (bits * weights).sum(axis=2).T if depth else np.zeros((b.num_rows, trees), np.int64)
            yield pa.record_batch([b.column(0), pa.array(_codes(x), pa.binary()), pa.array(cells.tolist(), pa.list_(pa.int64()))], names=["id", "code", "cells"])

    return nodes.mapInArrow(run, "id long, code binary, cells array<long>")


def _leaf_graph(coded: DataFrame, k: int, leaf: int) -> DataFrame:
    """The k best of every node in its leaf of every tree; leaves over twice ``leaf`` are cut at random."""
    rows = coded.select("id", "code", F.posexplode("cells").alias("tree", "cell"))
    sizes = rows.groupBy("tree", "cell").count().select("tree", "cell", F.ceil(F.col("count") / (2 * leaf)).cast("int").alias("cuts"))
    rows = rows.join(sizes, ["tree", "cell"]).withColumn("cut", F.pmod(F.xxhash64("id", "tree"), F.col("cuts")))
    leaves = rows.groupBy("tree", "cell", "cut").agg(F.collect_list(F.struct("id", "code")).alias("n"))

    def run(batches):
        for b in batches:
            us, vs, ss = [], [], []
            for rows_ in b.column(0):
                f = rows_.values
                ids = np.asarray(f.field("id"))
                if len(ids) < 2:
                    continue
                x, scale = _decoded(f.field("code"))
                sim = (x @ x.T) * scale[:, None] * scale[None, :]
                np.fill_diagonal(sim, -np.inf)
                top = _top(sim, min(k, len(ids) - 1))
                us.append(np.repeat(ids, top.shape[1]))
                vs.append(ids[top].ravel())
                ss.append(np.take_along_axis(sim, top, 1).ravel())
            yield _batch((us, vs, ss), ("u", "v", "sim"), (np.int64, np.int64, np.float64))

    return leaves.select("n").mapInArrow(run, _EDGE)


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k best distinct neighbours of each node, as one row ``(u, vs, sims, fresh)``, best first.

    Edges have ``old``, whether a node had the neighbour before.
    """

    def run(batches):
        for b in batches:
            us, vs, ss, fs = [], [], [], []
            for u, rows in zip(b.column(0).to_pylist(), b.column(1)):
                f = rows.values
                v, s, old = np.asarray(f.field("v")), np.asarray(f.field("sim")), np.asarray(f.field("old").cast(pa.int8()))
                order = np.lexsort((v, -s))
                v, s = v[order], s[order]
                _, first = np.unique(v, return_index=True)
                first = np.sort(first)[:k]
                us.append(u)
                vs.append(v[first])
                ss.append(s[first])
                fs.append(~np.isin(v[first], np.asarray(f.field("v"))[old == 1]))
            yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.list_(pa.int64())), pa.array(ss, pa.list_(pa.float64())), pa.array(fs, pa.list_(pa.bool_()))], names=["u", "vs", "sims", "fresh"])

    gathered = edges.groupBy("u").agg(F.collect_list(F.struct("v", "sim", "old")).alias("e"))
    return gathered.mapInArrow(run, "u long, vs array<long>, sims array<double>, fresh array<boolean>")


def _descend(graph: DataFrame, coded: DataFrame, k: int) -> DataFrame:
    """One round: candidate edges ``(u, v, sim)`` better than u's worst, from pairs of neighbours of one node.

    A pair of which both were neighbours of the node before was looked at then.
    """
    listed = graph.select("u", F.explode(F.arrays_zip("vs", "fresh")).alias("e")).select("u", F.col("e.vs").alias("v"), F.col("e.fresh").alias("fresh"))
    forward = listed.select(F.col("u").alias("w"), F.col("v").alias("x"), "fresh")
    # a node that many list keeps k of them, fresh ones first, as a hash picks them
    back = listed.select(F.col("v").alias("w"), F.col("u").alias("x"), "fresh")
    back = back.withColumn("r", F.row_number().over(Window.partitionBy("w").orderBy(F.desc("fresh"), F.xxhash64("x", "w")))).where(F.col("r") <= k).drop("r")
    met = forward.unionByName(back)
    worst = graph.select(F.col("u").alias("x"), F.when(F.size("sims") >= k, F.element_at("sims", -1)).otherwise(F.lit(float("-inf"))).alias("worst"))
    known = coded.select(F.col("id").alias("x"), "code").join(worst, "x")
    groups = met.join(known, "x").groupBy("w").agg(F.collect_list(F.struct("x", "fresh", "worst", "code")).alias("n"), F.bool_or("fresh").alias("any")).where("any")

    def run(batches):
        for b in batches:
            us, vs, ss = [], [], []
            for rows in b.column(0):
                f = rows.values
                ids, first = np.unique(np.asarray(f.field("x")), return_index=True)
                fresh, worst_of = np.asarray(f.field("fresh").cast(pa.int8())) > 0, np.asarray(f.field("worst"))
                fresh = np.isin(ids, np.asarray(f.field("x"))[fresh])  # a neighbour both ways is fresh if it is in one
                x, scale = _decoded(f.field("code").take(pa.array(first)))
                sim = (x @ x.T) * scale[:, None] * scale[None, :]
                good = (sim > worst_of[first][:, None]) & (fresh[:, None] | fresh[None, :])
                np.fill_diagonal(good, False)
                i, j = np.nonzero(good)
                us.append(ids[i])
                vs.append(ids[j])
                ss.append(sim[i, j])
            yield _batch((us, vs, ss), ("u", "v", "sim"), (np.int64, np.int64, np.float64))

    return groups.select("n").mapInArrow(run, _EDGE)


def truth(nodes: DataFrame, starts: DataFrame, probes: int = 64, near: int = 20) -> DataFrame:
    """``(q, c)``: the ``near`` best nodes of ``probes`` of ``starts``, held against all nodes.

    The probes, a number that does not grow, are what is sent to the tasks.
    """
    picked = starts.orderBy(F.xxhash64("q"), "q").limit(probes).join(nodes, F.col("q") == F.col("id")).select("q", "x").toPandas()
    ids = picked["q"].to_numpy(np.int64)
    dims = max([len(x) for x in picked["x"]], default=1)
    asked = np.array([np.pad(np.asarray(x, np.float64), (0, dims - len(x))) for x in picked["x"]]).reshape(len(ids), dims)

    def run(batches):
        for b in batches:
            if not b.num_rows or not len(ids):
                continue
            c = np.asarray(b.column(0))
            wide = max(dims, int(pa.compute.max(pa.compute.list_value_length(b.column(1))).as_py()))
            sim = asked @ _filled(b.column(1), wide)[:, :dims].T
            sim[ids[:, None] == c[None, :]] = -np.inf
            top = _top(sim, near)
            yield pa.record_batch([pa.array(np.repeat(ids, top.shape[1])), pa.array(c[top].ravel()), pa.array(np.take_along_axis(sim, top, 1).ravel())], names=["q", "c", "sim"])

    best = nodes.select("id", "x").mapInArrow(run, "q long, c long, sim double").where(F.col("sim") > float("-inf"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "c"))
    return materialize(best.withColumn("r", rank).where(F.col("r") <= near).select("q", "c"), "truth")


def probed(rows: DataFrame, true: DataFrame, q: str = "q") -> DataFrame:
    """The rows of the probes, which are as few as they always are."""
    return rows.join(F.broadcast(true.select(F.col("q").alias(q)).distinct()), q, "left_semi")


def recall(found: DataFrame, true: DataFrame) -> float:
    """The share of the rows of ``true`` that ``found`` has; both hold distinct ``(q, c)``."""
    hit = true.join(found, ["q", "c"], "left_semi").count()
    return hit / max(1, true.count())


def build_graph(nodes: DataFrame, true: DataFrame | None = None, k: int = 48, trees: int = 4, leaf: int = 128, rounds: int = 16, enough: float = 0.65, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(graph, coded)``: rows ``(u, vs, sims, fresh)`` of each node's k neighbours, and the nodes' byte vectors.

    Rounds end once the lists hold the share ``enough`` of ``true``, or hardly change any more.
    """
    stats = nodes.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    n, dims = stats[0], stats[1] or 1
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))
    coded = materialize(_encode(nodes.select("id", "x"), trees if depth else 1, depth, dims, seed), "coded")
    graph = materialize(_best(_leaf_graph(coded, k, leaf).withColumn("old", F.lit(False)), k), "graph")
    for _ in range(rounds):
        new = _descend(graph, coded, k)
        old = graph.select("u", F.explode(F.arrays_zip("vs", "sims")).alias("e")).select("u", F.col("e.vs").alias("v"), F.col("e.sims").alias("sim"), F.lit(True).alias("old"))
        graph = materialize(_best(old.unionByName(new.withColumn("old", F.lit(False))), k), "graph")
        moved = graph.agg(F.sum(F.size(F.filter("fresh", lambda f: f))), F.sum(F.size("vs"))).first()
        if (moved[0] or 0) < 0.01 * (moved[1] or 1):
            break
        if true is not None and recall(probed(graph, true, "u").select(F.col("u").alias("q"), F.explode("vs").alias("c")), true) >= enough:
            break
    return graph, coded


def both_ways(graph: DataFrame, coded: DataFrame, k: int) -> DataFrame:
    """``(o, ids, codes)``: each node's neighbours and up to k of those that list it, the nearest first, packed with their vectors."""
    edges = graph.select("u", F.explode(F.arrays_zip("vs", "sims")).alias("e")).select("u", F.col("e.vs").alias("v"), F.col("e.sims").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))
    back = edges.withColumn("r", rank).where(F.col("r") <= k).select(F.col("v").alias("o"), F.col("u").alias("c"))
    every = edges.select(F.col("u").alias("o"), F.col("v").alias("c")).unionByName(back)
    lists = every.join(coded.select(F.col("id").alias("c"), "code"), "c").groupBy("o").agg(F.collect_list(F.struct("c", "code")).alias("n"))

    def run(batches):
        for b in batches:
            ids, codes = [], []
            for rows in b.column(1):
                f = rows.values
                c, first = np.unique(np.asarray(f.field("c")), return_index=True)
                ids.append(c.tobytes())
                codes.append(b"".join(f.field("code").take(pa.array(first)).to_pylist()))
            yield pa.record_batch([b.column(0), pa.array(ids, pa.binary()), pa.array(codes, pa.binary())], names=["o", "ids", "codes"])

    return materialize(lists.mapInArrow(run, "o long, ids binary, codes binary"), "lists")


_POOL = "q long, mine binary, ids binary, sims binary, opened binary, todo array<long>"


def _pooled(q: int, mine: bytes, ids, sims, opened, pool: int, width: int) -> tuple:
    """One row of pools: the ``pool`` best candidates, of which the ``width`` best not opened yet are to be opened next."""
    order = np.lexsort((ids, -sims))[:pool]
    ids, sims, opened = ids[order], sims[order], opened[order].copy()
    next_ = np.flatnonzero(~opened)[:width]
    opened[next_] = True
    return q, mine, ids.tobytes(), sims.tobytes(), opened.tobytes(), ids[next_].tolist()


def _pool_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), *[pa.binary()] * 4, pa.list_(pa.int64()))
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=["q", "mine", "ids", "sims", "opened", "todo"])


def search(graph: DataFrame, coded: DataFrame, starts: DataFrame, true: DataFrame | None = None, k: int = 48, pool: int = 256, width: int = 32, steps: int = 16, enough: float = 0.97) -> DataFrame:
    """``(q, c)``: the ``pool`` best nodes that a greedy search from each node ``q`` of ``starts`` finds, and ``q`` itself.

    A step opens the ``width`` best nodes not opened yet, and looks at all their neighbours, both ways. A query is one row with its
    pool. Steps end once the pools hold the share ``enough`` of ``true``, or nothing is left to open.
    """
    lists = both_ways(graph, coded, k)
    # a node without neighbours has no row in the graph, and yet asks: other ids may have its vector
    own = starts.join(graph, starts.q == graph.u, "left").join(coded.select("id", F.col("code").alias("mine")), F.col("q") == F.col("id"))

    def begin(batches):
        for b in batches:
            rows = []
            for q, mine, vs, sims in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                ids, sims = (np.asarray(x.values if x.is_valid else [], kind) for x, kind in ((vs, np.int64), (sims, np.float64)))
                rows.append(_pooled(q, mine, ids, sims, np.zeros(len(ids), bool), pool, width))
            yield _pool_batch(rows)

    def step(batches):
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                q, mine, ids, sims, opened = (b.column(j)[i].as_py() for j in range(5))
                ids, sims, opened = np.frombuffer(ids, np.int64), np.frombuffer(sims, np.float64), np.frombuffer(opened, bool)
                f = b.column(5)[i].values
                if f is not None and len(f):
                    near = np.frombuffer(b"".join(f.field("ids").to_pylist()), np.int64)
                    raw = np.frombuffer(b"".join(f.field("codes").to_pylist()), np.uint8).reshape(len(near), -1)
                    near, first = np.unique(near, return_index=True)
                    new = ~np.isin(near, ids) & (near != q)
                    raw = raw[first[new]]
                    me = np.frombuffer(mine, np.uint8)
                    sim = raw[:, 8:].view(np.int8).astype(np.float32) @ me[8:].view(np.int8).astype(np.float32)
                    sim = sim * np.ascontiguousarray(raw[:, :8]).view(np.float64).ravel() * me[:8].view(np.float64)[0]
                    ids, sims, opened = np.concatenate([ids, near[new]]), np.concatenate([sims, sim]), np.concatenate([opened, np.zeros(len(sim), bool)])
                rows.append(_pooled(q, mine, ids, sims, opened, pool, width))
            yield _pool_batch(rows)

    def named(batches):
        for b in batches:
            own = np.asarray(b.column(0))
            ids = [np.append(np.frombuffer(x, np.int64), q) for x, q in zip(b.column(1).to_pylist(), own)]
            q = np.repeat(own, [len(x) for x in ids])
            yield pa.record_batch([pa.array(q), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64))], names=["q", "c"])

    pools = materialize(own.select("q", "mine", "vs", "sims").mapInArrow(begin, _POOL), "pools")
    for _ in range(steps):
        found = pools.select("q", F.explode("todo").alias("o")).join(lists, "o").groupBy("q").agg(F.collect_list(F.struct("ids", "codes")).alias("n"))
        pools = materialize(pools.drop("todo").join(found, "q", "left").mapInArrow(step, _POOL), "pools")
        if true is not None and recall(probed(pools.select("q", "ids"), true).mapInArrow(named, "q long, c long"), true) >= enough:
            break  # the best of a pool are found on the original vectors
        if pools.where(F.size("todo") > 0).isEmpty():
            break
    return pools.select("q", "ids").mapInArrow(named, "q long, c long")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", probes: int = 64, graph_options: dict | None = None, search_options: dict | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found by inner product, ties to smaller ids.

    Queries are the rows whose id ``every`` divides, candidates all rows with another id. The score is the inner
    product in double precision on the original vectors, of which a shorter one counts as filled up with zeros. Vectors
    that are null, zero, or hold null or non-finite components take no part. Copies of a vector are all found with it.
    Of rows that repeat a query's id, the least vector asks; as candidates they count as so many rows. Other columns are ignored.

    probes: so many queries are held against all vectors, to tell when graph and searches are good enough.
    """
    rows = materialize(usable(vectors, id_col, vector_col), "vectors")
    nodes = materialize(rows.groupBy("x").agg(F.min("vec_id").alias("id")).groupBy("id").agg(F.sort_array(F.collect_list("x")).alias("xs")).select(F.posexplode("xs").alias("p", "x"), F.col("id").alias("least")).select(F.when(F.col("p") == 0, F.col("least")).otherwise(F.xxhash64("least", "p", F.lit("again"))).alias("id"), "x"), "nodes")
    # no answer needs more than the k + 1 least ids of equal vectors, nor one of them more than k times
    counted = rows.groupBy("x", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))
    first = counted.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    members = first.join(nodes, "x").select("id", "vec_id", "n")
    asking = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
    asked = materialize(asking.join(nodes, "x").select(F.col("vec_id").alias("query_id"), F.col("id").alias("q")), "queries")
    starts = asked.select("q").distinct()
    true = truth(nodes, starts, probes, k)
    graph, coded = build_graph(nodes, true, **(graph_options or {}))
    found = search(graph, coded, starts, true, **(search_options or {}))
    left, right = nodes.select(F.col("id").alias("q"), F.col("x").alias("a")), nodes.select(F.col("id").alias("c"), F.col("x").alias("b"))
    product = F.aggregate(F.zip_with("a", "b", lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    scored = found.join(right, "c").join(left, "q").select("q", "c", product.alias("score"))
    spread = scored.join(members, F.col("c") == F.col("id")).groupBy("q", "vec_id").agg(F.collect_list(F.struct("score", "n")).alias("scores"), F.max("score").alias("top"))
    best = spread.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("top"), "vec_id"))).where(F.col("r") <= k + 1)
    lists = best.groupBy("q").agg(F.collect_list(F.struct("vec_id", "scores")).alias("best"))
    others = F.filter("best", lambda e: e["vec_id"] != F.col("query_id"))
    each = F.flatten(F.transform(others, lambda e: F.flatten(F.transform(e["scores"], lambda s: F.array_repeat(F.struct((-s["score"]).alias("s"), e["vec_id"].alias("vec_id")), s["n"])))))
    kept = asked.join(lists, "q").select("query_id", F.posexplode(F.slice(F.array_sort(each), 1, k)).alias("p", "e"))
    return kept.select("query_id", (F.col("p") + 1).alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.s")).alias("score"))
