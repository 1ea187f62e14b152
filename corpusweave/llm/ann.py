"""Approximate nearest neighbours by cosine, with a robust-pruned directed graph for each shard.

Equal vectors become one node, of which only the k + 1 smallest ids can ever be wanted. Nodes are
dealt out to shards by a hash of the vector; a shard has about `shard_rows` of them, or four times
the square root of their number where that is more, so that queries, which search every shard, meet
no more shards than that root. In a shard, nodes enter the graph
in batches: a greedy beam search from the medoid proposes neighbours, and relaxed distance pruning
keeps the nearest one, drops every candidate that is `alpha` times nearer to it than to the node,
and goes on with the next, so that kept edges are diverse; reverse edges are pruned the same way.
Every query is beam-searched in every shard, in blocks of queries; a shard's best are scored exactly
in double precision on the original vectors, and the best of all shards remain.

Vectors that are null, zero, or hold null or non-finite components take no part; vectors of another
length are never neighbours. Rows that repeat (vec_id, vector) count once; a query's own vec_id is
never its neighbour. Fewer candidates than k give fewer rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusweave.llm.store import written

SHARD_ROWS = 8192
QUERY_BLOCK = 8192
DEGREE, BEAM, ALPHA = 32, 64, 1.2
SEARCH_BEAM = 96


class Graph:
    """A directed graph over unit vectors x (float32): out is (n, degree), -1 where unused."""

    def __init__(self, x: np.ndarray, out: np.ndarray, start: int) -> None:
        self.x, self.out, self.start = x, out, start

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of q, the `beam` nodes that a greedy search keeps, nearest first, with their
        distances (1 - cosine); -1 and inf where there are fewer."""
        n, b = len(self.x), len(q)
        rows = np.arange(b)
        ids = np.full((b, beam), -1, np.int32)
        far = np.full((b, beam), np.inf, np.float32)
        seen, done = np.zeros((b, n), bool), np.zeros((b, beam), bool)
        ids[:, 0], far[:, 0] = self.start, 1 - q @ self.x[self.start]
        seen[:, self.start] = True
        live = rows
        while len(live):
            open_far = np.where(done[live] | (ids[live] < 0), np.inf, far[live])
            at = open_far.argmin(1)
            has = open_far[np.arange(len(live)), at] < np.inf
            live, at = live[has], at[has]
            if not len(live):
                break
            done[live, at] = True
            near = self.out[ids[live, at]]
            new = (near >= 0) & ~seen[live[:, None], near]
            seen[live[:, None].repeat(near.shape[1], 1)[new], near[new]] = True
            dist = np.where(new, 1 - np.einsum("brd,bd->br", self.x[near], q[live]), np.inf).astype(np.float32)
            all_ids, all_far = np.concatenate([ids[live], near], 1), np.concatenate([far[live], dist], 1)
            all_done = np.concatenate([done[live], np.zeros_like(new)], 1)
            order = np.argsort(all_far, 1, kind="stable")[:, :beam]
            far[live] = np.take_along_axis(all_far, order, 1)
            ids[live] = np.where(np.isinf(far[live]), -1, np.take_along_axis(all_ids, order, 1))
            done[live] = np.take_along_axis(all_done, order, 1)
        return ids, far


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """The out-neighbours (len(nodes), degree) that pruning keeps of each node's candidates (-1: none)."""
    out = np.full((len(nodes), degree), -1, np.int32)
    v = x[candidates]
    near = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("bcd,bd->bc", v, x[nodes])))
    left = np.where((candidates < 0) | (candidates == nodes[:, None]), np.inf, near)
    rows = np.arange(len(nodes))
    for k in range(degree):
        best = left.argmin(1)
        has = left[rows, best] < np.inf
        if not has.any():
            break
        out[has, k] = candidates[rows, best][has]
        between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("bcd,bd->bc", v, v[rows, best])))
        left = np.where(alpha * between <= near, np.inf, left)
        left[rows, best] = np.inf
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 7) -> Graph:
    n = len(x)
    start = int((x @ x.mean(0)).argmax())
    graph = Graph(x, np.full((n, degree), -1, np.int32), start)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    i = 1
    while i < n:
        batch = order[i : i + max(1, min(256, i))]
        i += len(batch)
        found, _ = graph.search(x[batch], beam)
        if len(batch) > 1:  # those of one batch are no less near to each other
            own = np.argsort(-(x[batch] @ x[batch].T), 1)[:, : min(len(batch), 9)]
            found = np.concatenate([found, batch[own]], 1)
        graph.out[batch] = robust_prune(x, batch, found.astype(np.int32), degree, alpha)
        to = graph.out[batch].ravel()
        by = np.repeat(batch, degree)[to >= 0].astype(np.int32)
        to = to[to >= 0]
        sort = np.argsort(to, kind="stable")
        to, by = to[sort], by[sort]
        target, first, count = np.unique(to, return_index=True, return_counts=True)
        added = np.full((len(target), int(count.max())), -1, np.int32)
        added[np.repeat(np.arange(len(target)), count), np.arange(len(to)) - np.repeat(first, count)] = by
        both = np.concatenate([graph.out[target], added], 1)
        both = np.where((both[:, :, None] == both[:, None, :]).argmax(2) == np.arange(both.shape[1]), both, -1) if both.shape[1] <= 256 else both
        full = (both >= 0).sum(1) > degree
        if full.any():
            graph.out[target[full]] = robust_prune(x, target[full], both[full], degree, alpha)
        room = ~full
        packed = np.argsort(both[room] < 0, 1, kind="stable")[:, :degree]
        graph.out[target[room]] = np.take_along_axis(both[room], packed, 1)
    return graph


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def _scaled(v: np.ndarray) -> np.ndarray:
    """The rows by powers of two so that squares neither overflow nor vanish; cosines stay."""
    exponent = np.frexp(np.abs(v).max(1, keepdims=True))[1]
    return np.ldexp(v, -exponent)


def _unit(v: np.ndarray) -> np.ndarray:
    v = _scaled(v)
    return (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)


def _build(degree: int, beam: int, alpha: float):
    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        table = table.sort_by("vector")
        graph = build(_unit(_matrix(table.column("vector"), dim)), degree, beam, alpha)
        first = np.zeros(table.num_rows, bool)
        first[graph.start] = True
        return pa.Table.from_arrays(
            [*(table.column(c) for c in ("dim", "shard", "vector", "ids")), pa.array(np.arange(table.num_rows)), pa.array(first), pa.array([r.tobytes() for r in graph.out], pa.binary())],
            names=["dim", "shard", "vector", "ids", "node", "start", "out"],
        )

    return run


def _search(k: int, beam: int, step: int = 128):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        ask, hit, score = [], [], []
        if index.num_rows and queries.num_rows:
            dim = index.column("dim")[0].as_py()
            index = index.sort_by("node")
            v, ids = _scaled(_matrix(index.column("vector"), dim)), index.column("ids").to_pylist()
            out = np.frombuffer(b"".join(index.column("out").to_pylist()), np.int32).reshape(len(v), -1)
            graph = Graph(_unit(v), out, int(index.column("start").to_numpy().argmax()))
            names, q = queries.column("query_id").to_numpy(), _scaled(_matrix(queries.column("vector"), dim))
            norms = np.sqrt((v * v).sum(1))
            for a in range(0, len(q), step):
                found, _ = graph.search(_unit(q[a : a + step]), min(beam, max(k + 1, len(v))))
                for r, mine in enumerate(found, a):
                    mine = mine[mine >= 0]
                    exact = (v[mine] @ q[r]) / (norms[mine] * np.sqrt((q[r] * q[r]).sum()))
                    near = sorted((-s, i) for s, m in zip(exact.tolist(), mine.tolist(), strict=True) for i in ids[m] if i != names[r])[:k]
                    ask += [names[r]] * len(near)
                    hit += [i for _, i in near]
                    score += [-s for s, _ in near]
        return pa.Table.from_arrays([pa.array(ask, pa.int64()), pa.array(hit, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def _prepare(batches):
    """The vectors that take part, as binaries of doubles."""
    for batch in batches:
        ids, dims, vectors = [], [], []
        for i, e in zip(batch.column("vec_id").to_pylist(), batch.column("v"), strict=True):
            if i is None or not e.is_valid or e.values.null_count or not len(e.values):
                continue
            v = e.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
            if np.isfinite(v).all() and v.any():
                ids.append(i)
                dims.append(len(v))
                vectors.append(v.astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(vectors, pa.binary())], names=["vec_id", "dim", "vector"])


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, shard_rows: int = SHARD_ROWS, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, search_beam: int = SEARCH_BEAM, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """The k nearest rows found for each query row of vectors(vec_id, embedding): query_id, rank
    (from 1), vec_id, score. is_query is a condition on vec_id; every row is a candidate."""
    spark = vectors.sparkSession
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).mapInArrow(_prepare, "vec_id long, dim int, vector binary")
    whole = written(whole, "vectors")
    smallest = Window.partitionBy("dim", "vector").orderBy("vec_id")
    nodes = whole.distinct().withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1).groupBy("dim", "vector").agg(F.collect_list("vec_id").alias("ids"))
    nodes = written(nodes, "nodes")
    count = nodes.count()
    shards = max(1, -(-count // max(shard_rows, 4 * math.isqrt(count))))
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)))
    index = written(nodes.groupBy("dim", "shard").applyInArrow(_build(degree, beam, alpha), "dim int, shard long, vector binary, ids array<long>, node long, start boolean, out binary"), "graphs")
    queries = whole.where(is_query).distinct().withColumnRenamed("vec_id", "query_id")
    blocks = max(1, -(-queries.count() // query_block))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    asked = queries.join(index.select("dim", "shard").distinct(), "dim").select(F.col("dim").alias("q_dim"), F.col("shard").alias("q_shard"), F.col("block").alias("q_block"), "query_id", "vector")
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = index.groupBy("dim", "shard", "block").cogroup(asked.groupBy("q_dim", "q_shard", "q_block")).applyInArrow(_search(k, search_beam), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
