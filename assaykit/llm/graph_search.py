"""Nearest neighbours by inner product over robust-pruned directed graphs, one per shard of vectors of like length, searched by beam."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import prepare, stored
from assaykit.operators.hotkeys import top_k

SHARD_ROWS = 5000
QUERY_BLOCK = 2048
DEGREE = 32
BEAM = 64
ALPHA = 1.2
# Lengths in one shard differ by at most this factor, so that lifting adds little to the distances the graph is built on.
BAND = 1.05
# A graph that finds less than this of what its own sampled nodes should find is not used: its shard is scanned.
TRUSTED, SAMPLED = 0.95, 48


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors with one more component, so that all have one length and the nearest is the one of largest inner product."""
    squares = (vectors.astype(np.float64) ** 2).sum(1)
    return np.concatenate([vectors, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]], axis=1).astype(np.float32)


def beam_search(graph: np.ndarray, data: np.ndarray, queries: np.ndarray, start: int, width: int) -> np.ndarray:
    """Best ``width`` nodes found for each query, nearest first, -1 where fewer were reached.

    All queries step together: each expands its nearest node not yet expanded, scores that node's unseen neighbours and keeps the
    best ``width``; it stops when all it keeps are expanded.
    """
    n = len(queries)
    seen = np.zeros((n, len(data) + 1), bool)
    seen[:, -1] = seen[:, start] = True
    ids = np.full((n, width), -1)
    ids[:, 0] = start
    scores = np.full((n, width), -np.inf, np.float32)
    scores[:, 0] = queries @ data[start]
    done = np.ones((n, width), bool)
    done[:, 0] = False
    while len(active := np.flatnonzero(~done.all(1))):
        open_scores = np.where(done[active], -np.inf, scores[active])
        at = open_scores.argmax(1)
        done[active, at] = True
        near = graph[ids[active, at]]
        fresh = ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        found = np.einsum("qrd,qd->qr", data[near], queries[active])
        all_scores = np.concatenate([scores[active], np.where(fresh, found, -np.inf)], axis=1)
        best = np.argsort(-all_scores, axis=1, kind="stable")[:, :width]
        pick = active[:, None], np.arange(width)[None, :]
        all_done = np.concatenate([done[active], ~fresh], axis=1)
        all_ids = np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1)
        scores[pick] = np.take_along_axis(all_scores, best, 1)
        ids[pick] = np.take_along_axis(all_ids, best, 1)
        done[pick] = np.take_along_axis(all_done, best, 1)
    return ids


def robust_prune(data: np.ndarray, nodes: np.ndarray, proposed: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` neighbours for each node out of its proposals (-1 for none).

    Repeatedly takes the nearest proposal left and drops those that are, ``alpha`` times over, nearer to it than to the node:
    short edges stay where they are needed and long ones survive to keep the graph connected.
    """
    proposed = np.sort(proposed, axis=1)
    proposed[:, 1:][proposed[:, 1:] == proposed[:, :-1]] = -1
    alive = (proposed >= 0) & (proposed != nodes[:, None])
    points = data[proposed]
    length = float(data[0] @ data[0])
    own = length - np.einsum("bcd,bd->bc", points, data[nodes])
    rows, out = np.arange(len(nodes)), np.full((len(nodes), degree), -1)
    for slot in range(degree):
        if not alive.any():
            break
        at = np.where(alive, own, np.inf).argmin(1)
        has = alive[rows, at]
        out[:, slot] = np.where(has, proposed[rows, at], -1)
        between = length - np.einsum("bcd,bd->bc", points, points[rows, at])
        alive &= ~((alpha * alpha * between <= own) & has[:, None])
        alive[rows, at] = False
    return out


def build_graph(data: np.ndarray, degree: int = DEGREE, width: int = BEAM, alpha: float = ALPHA, seed: int = 5) -> tuple[np.ndarray, int]:
    """Out-neighbours of every node (-1 padded) and the start node, the one nearest to the mean.

    Nodes join in a fixed random order, in batches that double up to 512: a beam search over the graph so far proposes
    neighbours, robust pruning picks among them, and each gets the edge back, pruned again where its list overflows. A second
    round repeats this over the whole graph.
    """
    n = len(data)
    graph = np.full((n, degree), -1)
    start = int((data @ data.mean(0)).argmax())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    batches, at, size = [], 1, 16
    while at < n:
        batches.append(order[at : at + size])
        at, size = at + size, min(512, size * 2)
    batches += [order[i : i + 512] for i in range(0, n, 512)]
    for nodes in batches:
        proposed = np.concatenate([beam_search(graph, data, data[nodes], start, width), graph[nodes]], axis=1)
        graph[nodes] = robust_prune(data, nodes, proposed, degree, alpha)
        _link_back(graph, data, nodes, degree, alpha)
    return graph, start


def _link_back(graph: np.ndarray, data: np.ndarray, nodes: np.ndarray, degree: int, alpha: float) -> None:
    source, target = np.repeat(nodes, degree), graph[nodes].ravel()
    source, target = source[target >= 0], target[target >= 0]
    known = (graph[target] == source[:, None]).any(1)
    source, target = source[~known], target[~known]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    to, first, count = np.unique(target, return_index=True, return_counts=True)
    for lo in range(0, len(to), 512):
        some, base, n = to[lo : lo + 512], first[lo : lo + 512], count[lo : lo + 512]
        added = np.full((len(some), n.max()), -1)
        cols = np.arange(n.max())
        inside = cols[None, :] < n[:, None]
        added[inside] = source[(base[:, None] + cols)[inside]]
        proposed = np.concatenate([graph[some], added], axis=1)
        full = (proposed >= 0).sum(1) > degree
        packed = -np.sort(-proposed[~full], axis=1)[:, :degree]
        graph[some[~full]] = packed
        if full.any():
            graph[some[full]] = robust_prune(data, some[full], proposed[full], degree, alpha)


def usable(vector: Column) -> Column:
    """Not null or empty, all components finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def graph_recall(graph: np.ndarray, data: np.ndarray, plain: np.ndarray, start: int, width: int, k: int = 20) -> float:
    """Share of the ``k`` largest inner products of ``SAMPLED`` evenly chosen nodes that a beam search finds."""
    some = np.unique(np.linspace(0, len(plain) - 1, SAMPLED).astype(int))
    queries = np.concatenate([plain[some], np.zeros((len(some), 1))], axis=1).astype(np.float32)
    found = beam_search(graph, data, queries, start, width)
    scores = plain[some] @ plain.T
    best = -np.sort(-scores, axis=1)[:, : min(k, len(plain))]
    hits = np.take_along_axis(scores, np.maximum(found, 0), 1) * (found >= 0) + np.where(found >= 0, 0, -np.inf)
    return float((hits >= best[:, -1:] - 1e-12 * np.abs(best[:, :1])).sum(1).clip(max=best.shape[1]).sum() / best.size)


INDEX = "dim int, band int, shard int, start int, groups array<array<long>>, vectors binary, graph binary"


def build_index(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One stored row per shard: start node, ids of each node, its vectors (doubles) and the graph.

    Equal vectors are one node with the ``k + 1`` smallest of their ids: no further one can be among the k nearest of
    anything. Shards are bands of like length, split by hash of the vector to about ``shard_rows`` nodes, so each is built by one
    task within bounds. A graph is tried on some of its own nodes; where it finds too little, none is kept and the shard is
    scanned exactly.
    """
    ids = top_k(vectors.select("_id", "_v"), ["_v"], [F.col("_id")], k + 1)
    nodes = ids.groupBy("_v").agg(F.sort_array(F.collect_list("_id")).alias("_ids"))
    length = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    # the length as a power of the band's width; sums that leave the range of doubles share the outermost bands
    power = F.log(F.greatest(F.least(length, F.lit(1e300)), F.lit(1e-300))) / math.log(BAND)
    nodes = stored(nodes.withColumn("dim", F.size("_v")).withColumn("band", F.round(power).cast("int")), "vector-nodes")
    sizes = nodes.groupBy("dim", "band").agg(F.count("*").alias("n")).select(
        "dim", "band", F.greatest(F.lit(1), F.ceil(F.col("n") / shard_rows)).cast("int").alias("parts"))
    # one row per length that occurs, by steps of a twentieth
    keyed = nodes.join(F.broadcast(sizes), ["dim", "band"]).select(
        "dim", "band", F.pmod(F.xxhash64("_v"), F.col("parts")).cast("int").alias("shard"), "_ids", "_v")
    shards = sizes.agg(F.coalesce(F.sum("parts"), F.lit(0))).first()[0]
    keyed = keyed.repartition(max(1, shards), "dim", "band", "shard")

    def build(key: tuple, part: pa.Table) -> pa.Table:
        groups = part.column("_ids").to_pylist()
        order = sorted(range(len(groups)), key=lambda i: groups[i])
        plain = part.column("_v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(groups), -1)[order]
        data = lifted(plain)
        graph, start = build_graph(data)
        if graph_recall(graph, data, plain, start, max(BEAM, 2 * k)) < TRUSTED:
            graph = graph[:0]
        return pa.table({
            "dim": pa.array([key[0].as_py()], pa.int32()), "band": pa.array([key[1].as_py()], pa.int32()),
            "shard": pa.array([key[2].as_py()], pa.int32()),
            "start": pa.array([start], pa.int32()), "groups": pa.array([[groups[i] for i in order]], pa.list_(pa.list_(pa.int64()))),
            "vectors": pa.array([plain.astype("<f8").tobytes()], pa.binary()),
            "graph": pa.array([graph.astype("<i4").tobytes()], pa.binary())})

    return stored(keyed.groupBy("dim", "band", "shard").applyInArrow(build, INDEX), "vector-index")


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = 20,
            shard_rows: int = SHARD_ROWS, width: int = BEAM) -> DataFrame:
    """The ``k`` nearest rows by inner product of every row that ``queries`` selects: query_id, rank, vec_id, score.

    Scores are exact, in double precision, on the original vectors; ties go to the smaller id. Each shard's graph is searched for
    all queries, in blocks of about ``QUERY_BLOCK``, and the best of all shards are merged. Vectors that are null, empty, zero
    or hold null or non-finite components take no part, nor do null ids; only vectors of equal length are compared; a row
    that repeats with id and vector counts once, and no row finds its own id. Fewer than k candidates give fewer rows. Other
    columns are not read; an empty table gives an empty table.
    """
    prepare(vectors.sparkSession)
    rows = vectors.withColumn("_q", queries).select(F.col(id_col).cast("long").alias("_id"), "_q",
                                                    F.col(vector).cast("array<double>").alias("_v"))
    rows = rows.where(usable(F.col("_v")) & F.col("_id").isNotNull()).groupBy("_id", "_v").agg(F.bool_or("_q").alias("_q"))
    rows = stored(rows, "vectors")
    index = build_index(rows, k, shard_rows)
    asked = rows.where("_q")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    packed = asked.groupBy(F.size("_v").alias("dim"), F.pmod(F.xxhash64("_id"), F.lit(blocks)).alias("block")).agg(
        F.collect_list(F.struct("_id", "_v")).alias("asked"))
    key = ["dim", "band", "shard"]
    tasks = index.join(index.select(*key).join(packed, "dim"), key)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield _search(*(batch.column(c)[row] for c in ("dim", "start", "groups", "vectors", "graph", "asked")), k, width)

    found = tasks.select("dim", "start", "groups", "vectors", "graph", "asked").mapInArrow(
        search, "query_id long, vec_id long, score double")
    best = top_k(found, ["query_id"], [F.desc("score"), F.col("vec_id")], k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(dim, start, groups, vectors, graph, asked, k: int, width: int) -> pa.RecordBatch:
    dim, groups = dim.as_py(), groups.as_py()
    plain = np.frombuffer(vectors.as_buffer(), "<f8").reshape(-1, dim)
    links = np.frombuffer(graph.as_buffer(), "<i4")
    links = links.reshape(len(plain), -1) if len(links) else None
    query_ids = asked.values.field("_id").to_numpy()
    queries = asked.values.field("_v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    data = lifted(plain)
    lifted_queries = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
    out_q, out_v, out_s = [], [], []
    for lo in range(0, len(queries), 512):
        some = slice(lo, lo + 512)
        if links is None:
            ids = np.argsort(-(queries[some] @ plain.T), axis=1, kind="stable")[:, : max(width, 2 * k)]
        else:
            ids = beam_search(links, data, lifted_queries[some], start.as_py(), max(width, 2 * k))
        scores = np.einsum("qrd,qd->qr", plain[ids], queries[some])
        for query, found, values in zip(query_ids[some].tolist(), ids.tolist(), scores.tolist(), strict=True):
            rows = [(-s, v) for i, s in zip(found, values, strict=True) if i >= 0 for v in groups[i] if v != query]
            for s, v in sorted(rows)[:k]:
                out_q.append(query)
                out_v.append(v)
                out_s.append(-s)
    return pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())],
                                      names=["query_id", "vec_id", "score"])
