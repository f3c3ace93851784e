"""Largest inner products by robust-pruned directed graphs, one for each shard.

Distinct vectors are dealt into shards of bounded size, larger ones the more there are.  In a shard, greedy beam
searches propose neighbours and relaxed distance pruning keeps edges in diverse
directions; nodes that cannot be reached get an edge.  Every block of queries
meets every shard, walks its graph from the medoid and returns the nearest
found, scored anew in double precision.

Vectors get one more component, which makes all of a shard equally long, so that
the nearest in the graph's distance has the largest inner product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from scholion.llm.common import materialize

#: Vectors of a shard: as many as make ``SHARDS`` shards, but no fewer and no more than these; every query meets every shard.
SHARD, MOST = 4096, 65536
SHARDS = 64
QUERIES = 4096
DEGREE = 32
BEAM = 48
SEARCH = 96
#: Nodes that a step of a search expands, and searches that run side by side.
STEP, SIDE = 4, 512
#: Relaxations of the two passes.
ALPHAS = (1.0, 1.2)


def _distances(x: np.ndarray, own: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances, less the query's own square, of x[ids] (m, k) to q (m, d)."""
    return own[ids] - 2 * np.einsum("mkd,md->mk", x[ids], q)


def beam_search(x: np.ndarray, own: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each query the nearest found (m, beam), nearest first, and their distances; -1 where there are fewer."""
    m, n = len(q), len(x)
    beam = min(beam, n)
    row = np.arange(m)[:, None]
    ids = np.full((m, beam), -1)
    dist = np.full((m, beam), np.inf, np.float32)
    done = np.ones((m, beam), bool)
    seen = np.zeros((m, n), bool)
    ids[:, 0], done[:, 0], seen[:, start] = start, False, True
    dist[:, 0] = _distances(x, own, ids[:, :1], q)[:, 0]
    while not done.all():
        pick = np.argsort(np.where(done, np.inf, dist), axis=1, kind="stable")[:, :STEP]
        live = ~np.take_along_axis(done, pick, 1)
        np.put_along_axis(done, pick, True, 1)
        new = np.where(live[:, :, None], graph[np.take_along_axis(ids, pick, 1)], -1).reshape(m, -1)
        new = np.sort(new, axis=1)
        fresh = (new >= 0) & ~seen[row, new]
        fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
        r, c = np.nonzero(fresh)
        seen[r, new[r, c]] = True
        far = np.full(new.shape, np.inf, np.float32)
        width = int(fresh.sum(axis=1).max(initial=0))
        if not width:
            continue
        order = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
        new, fresh = np.take_along_axis(new, order, 1), np.take_along_axis(fresh, order, 1)
        far = np.where(fresh, _distances(x, own, np.maximum(new, 0), q), np.inf)
        ids, dist, done = np.hstack([ids, new]), np.hstack([dist, far]), np.hstack([done, ~fresh])
        best = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        ids, dist, done = (np.take_along_axis(a, best, 1) for a in (ids, dist, done))
    return np.where(np.isinf(dist), -1, ids), dist


def robust_prune(x: np.ndarray, own: np.ndarray, nodes: np.ndarray, near: np.ndarray, alpha: float) -> np.ndarray:
    """At most DEGREE of the candidates (m, k) of each node: a candidate goes once one that is kept is much closer to it than the node."""
    m = len(nodes)
    near = np.sort(np.where(near == nodes[:, None], -1, near), axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    dist = np.where(near < 0, np.inf, _distances(x, own, np.maximum(near, 0), x[nodes]) + own[nodes][:, None])
    each, norm = x[np.maximum(near, 0)], own[np.maximum(near, 0)]
    out = np.full((m, DEGREE), -1)
    row, left = np.arange(m), dist.copy()
    for k in range(DEGREE):
        best = np.argmin(left, axis=1)
        ok = np.isfinite(left[row, best])
        if not ok.any():
            break
        out[:, k] = np.where(ok, near[row, best], -1)
        between = norm + norm[row, best][:, None] - 2 * np.einsum("mkd,md->mk", each, each[row, best])
        left[(alpha * alpha * between <= dist) | ~ok[:, None]] = np.inf
        left[row, best] = np.inf
    return out


def _add_back(x: np.ndarray, own: np.ndarray, graph: np.ndarray, nodes: np.ndarray, alpha: float) -> None:
    """An edge back from each new neighbour; a list that overflows is pruned."""
    to, frm = graph[nodes].ravel(), np.repeat(nodes, DEGREE)
    to, frm = to[to >= 0], frm[to >= 0]
    order = np.argsort(to, kind="stable")
    to, frm = to[order], frm[order]
    heads, first = np.unique(to, return_index=True)
    full, wide = [], []
    for h, more in zip(heads, np.split(frm, first[1:]), strict=True):
        have = graph[h][graph[h] >= 0]
        both = np.concatenate([have, np.setdiff1d(more, have)])
        if len(both) <= DEGREE:
            graph[h, : len(both)] = both
        else:
            full.append(h), wide.append(both)
    for i in range(0, len(full), SIDE):
        part = wide[i : i + SIDE]
        near = np.full((len(part), max(map(len, part))), -1)
        for k, w in enumerate(part):
            near[k, : len(w)] = w
        graph[full[i : i + SIDE]] = robust_prune(x, own, np.array(full[i : i + SIDE]), near, alpha)


def build(x: np.ndarray) -> tuple[np.ndarray, int]:
    """The graph (n, degree or a little more; -1 where no edge is) and the node to start from."""
    n = len(x)
    own = (x**2).sum(axis=1)
    rng = np.random.default_rng(n)
    graph = np.full((n, DEGREE), -1)
    few = min(DEGREE, n - 1)
    if few:
        graph[:, :few] = (np.arange(n)[:, None] + 1 + rng.integers(0, n - 1, (n, few))) % n
    start = int(np.argmin(own - 2 * x @ x.mean(axis=0)))
    for alpha in ALPHAS if n > 1 else ():
        for nodes in np.array_split(rng.permutation(n), -(-n // SIDE)):
            found, _ = beam_search(x, own, graph, start, x[nodes], BEAM)
            graph[nodes] = robust_prune(x, own, nodes, np.hstack([found, graph[nodes]]), alpha)
            _add_back(x, own, graph, nodes, alpha)
    return _reachable(x, own, graph, start), start


def _reachable(x: np.ndarray, own: np.ndarray, graph: np.ndarray, start: int) -> np.ndarray:
    """An edge, from the nearest node that is reached, to each that isn't."""
    seen = np.zeros(len(x), bool)
    front = np.array([start])
    extra: dict[int, list[int]] = {}
    while True:
        while len(front):
            seen[front] = True
            front = np.unique(graph[front])
            front = front[(front >= 0) & ~seen[front]]
        lost = np.flatnonzero(~seen)
        if not len(lost):
            break
        on = np.flatnonzero(seen)
        best = on[np.argmin(own[on] - 2 * (x[on] @ x[lost[0]]))]
        extra.setdefault(int(best), []).append(int(lost[0]))
        front = lost[:1]
    more = np.full((len(x), max(map(len, extra.values()), default=0)), -1)
    for k, v in extra.items():
        more[k, : len(v)] = v
    return np.hstack([graph, more]).astype(np.int32)


def usable(vector: str) -> Column:
    """Not null, not zero, of finite components only."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.col(vector).isNotNull() & finite & F.exists(vector, lambda v: v != 0)


def _indexed(part: pd.DataFrame) -> pd.DataFrame:
    vectors = np.array([np.asarray(v, np.float32) for v in part["vector"]])
    square = (vectors.astype(np.float64) ** 2).sum(axis=1)
    longer = np.sqrt(np.maximum(square.max() - square, 0)).astype(np.float32)
    graph, start = build(np.hstack([vectors, longer[:, None]]))
    return pd.DataFrame({
        "dim": part["dim"].iloc[:1], "shard": part["shard"].iloc[:1], "start": [start], "width": [graph.shape[1]],
        "vectors": [vectors.tobytes()], "longer": [longer.tobytes()], "graph": [graph.tobytes()], "ids": [list(part["ids"])],
    })


def _searched(k: int):
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(index) and len(queries):
            r = index.iloc[0]
            vectors = np.frombuffer(r["vectors"], np.float32).reshape(-1, r["dim"])
            x = np.hstack([vectors, np.frombuffer(r["longer"], np.float32)[:, None]])
            own, graph = (x**2).sum(axis=1), np.frombuffer(r["graph"], np.int32).reshape(-1, r["width"])
            asked = np.array([np.asarray(v, np.float32) for v in queries["vector"]])
            exact = vectors.astype(np.float64)
            for i in range(0, len(asked), SIDE):
                q = asked[i : i + SIDE]
                found, _ = beam_search(x, own, graph, r["start"], np.hstack([q, np.zeros((len(q), 1), np.float32)]), max(SEARCH, 2 * k))
                for name, near, vector in zip(queries["query_id"].iloc[i : i + SIDE], found, q.astype(np.float64), strict=True):
                    near = near[near >= 0]
                    score = exact[near] @ vector
                    last = np.sort(score)[::-1][min(k, len(score) - 1)] if len(score) else 0.0
                    best = np.flatnonzero(score >= last)  # all that tie with the last go on, so that ids decide
                    rows = [(-s, v) for s, at in zip(score[best], near[best], strict=True) for v in r["ids"][at] if v != name]
                    out += [(name, v, -s) for s, v in sorted(rows)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each query the ``k`` rows found with the largest inner products.

    A query's own id is no candidate; ties go to the smaller id; fewer
    candidates than ``k`` make fewer rows.  Ids are integers.  Vectors that are
    null, zero or not finite, and rows without an id, take no part; vectors of
    different lengths do not meet.  Rows equal in id and vector count once.
    Copies of a vector are one node of a graph, which keeps the k + 1 smallest
    ids: no others can be among a query's k.  Only the two columns are read.
    """

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))
        return df.where(F.col("id").isNotNull() & usable("vector")).withColumn("dim", F.size("vector"))

    order = Window.partitionBy("vector").orderBy("id")
    # ties are cut before the shuffle too, so that copies without number never meet
    few = clean(rows).withColumn("n", F.dense_rank().over(order)).where(F.col("n") <= k + 1)
    few = few.groupBy("dim", "vector").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    few = materialize(few, "vectors")
    count = few.count()
    shards = max(1, -(-count // min(MOST, max(SHARD, -(-count // SHARDS)))))
    dealt = few.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int")).repartition(shards, "dim", "shard")
    index = dealt.groupBy("dim", "shard").applyInPandas(_indexed, "dim int, shard int, start int, width int, vectors binary, longer binary, graph binary, ids array<array<bigint>>")
    index = materialize(index, "graphs")
    asked = materialize(clean(queries).dropDuplicates(["id", "vector"]), "queries")
    blocks = max(1, -(-asked.count() // QUERIES))
    asked = asked.select(F.col("id").alias("query_id"), "vector", "dim", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["dim", "shard", "block"]
    found = index.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(_searched(k), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
