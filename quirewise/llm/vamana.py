"""Approximate nearest neighbours on robust-pruned directed graphs.

Distinct vectors are dealt to shards of bounded size. In each shard, greedy searches from an entry node
propose neighbours for a batch of nodes at a time, relaxed distance pruning keeps diverse edges, and
edges back are added and pruned alike. Blocks of queries then run a beam search in every shard, and the
shards' answers are merged on exact distances: in each task first, so that only its nearest go out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

DEGREE, BEAM, ALPHA = 28, 64, 1.2
ENTRIES, SEARCH_BEAM = 31, 96
SHARD = 3000
#: Queries that a copy of a shard serves.
QUERY_BLOCK = 2048
#: Bytes of gathered vectors that a search works on at a time, and answers that a task holds to merge them.
WORK_BYTES, HELD = 1 << 25, 1 << 20


def _squares(points: np.ndarray, a: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances from each row of a to points[ids[row]]."""
    gap = points[ids] - a[:, None]  # of differences: the expanded form cancels where vectors are close
    return np.einsum("qrd,qrd->qr", gap, gap)


def _frame(exact: np.ndarray):
    """What brings a shard's vectors into float32 for the walk: scaled, so that huge or tiny values don't
    overflow it, then centred and scaled again, so that close vectors stay apart."""
    scale = np.abs(exact).max()
    center = (exact / scale).mean(0)
    spread = np.abs(exact / scale - center).max() or 1.0
    return lambda v: ((v / scale - center) / spread).astype(np.float32)


def beam_search(points: np.ndarray, graph: np.ndarray, entry: np.ndarray, queries: np.ndarray, beam: int, keep_seen: bool = False):
    """Best ``beam`` nodes of each query, all queries in step: (ids, squared distances[, nodes expanded]).

    graph has -1 for no edge. Each step opens every query's nearest unopened node of its beam; a query is
    done when all of its beam is open.
    """
    n, q = len(points), len(queries)
    ids = np.full((q, beam), -1, np.int64)
    dist = np.full((q, beam), np.inf, np.float32)
    opened = np.ones((q, beam), bool)
    seen = np.zeros((q, n), bool)
    m = min(len(entry), beam)
    ids[:, :m], opened[:, :m] = entry[:m], False
    dist[:, :m] = _squares(points, queries, np.broadcast_to(entry[:m], (q, m)))
    seen[:, entry[:m]] = True
    trail_ids, trail_dist = [], []
    live = np.arange(q)
    while len(live):
        d = np.where(opened[live], np.inf, dist[live])
        slot = d.argmin(1)
        going = np.isfinite(d[np.arange(len(live)), slot])
        live, slot = live[going], slot[going]
        if not len(live):
            break
        opened[live, slot] = True
        node = ids[live, slot]
        if keep_seen:
            for store, x, blank in ((trail_ids, node, -1), (trail_dist, dist[live, slot], np.inf)):
                column = np.full(q, blank, np.float32 if blank else np.int64) if blank != -1 else np.full(q, -1, np.int64)
                column[live] = x
                store.append(column)
        near = graph[node]
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        rows, cols = np.nonzero(fresh)
        seen[live[rows], near[rows, cols]] = True
        d_new = np.where(fresh, _squares(points, queries[live], np.maximum(near, 0)), np.inf).astype(np.float32)
        all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], 1)
        all_dist = np.concatenate([dist[live], d_new], 1)
        all_open = np.concatenate([opened[live], ~fresh], 1)
        best = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam] if all_dist.shape[1] > beam else np.argsort(all_dist, 1)
        row = np.arange(len(live))[:, None]
        ids[live], dist[live], opened[live] = all_ids[row, best], all_dist[row, best], all_open[row, best]
    order = np.argsort(dist, axis=1, kind="stable")
    row = np.arange(q)[:, None]
    out = ids[row, order], dist[row, order]
    return (*out, np.stack(trail_ids, 1), np.stack(trail_dist, 1)) if keep_seen else out


def robust_prune(points: np.ndarray, nodes: np.ndarray, cand: np.ndarray, dist: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Out-edges of each node from its candidates (-1: none): the nearest stays and removes every candidate
    that it is alpha times nearer to than the node is; again until degree edges stand."""
    dist = np.where((cand < 0) | (cand == nodes[:, None]), np.inf, dist)
    order = np.argsort(dist, axis=1, kind="stable")[:, : 4 * degree]
    row = np.arange(len(nodes))[:, None]
    cand, dist = cand[row, order], dist[row, order].copy()
    got = points[np.maximum(cand, 0)]
    out = np.full((len(nodes), degree), -1, np.int64)
    every = np.arange(len(nodes))
    for k in range(degree):
        best = dist.argmin(1)
        ok = np.isfinite(dist[every, best])
        if not ok.any():
            break
        out[ok, k] = cand[every, best][ok]
        pick = got[every, best]
        gap = got - pick[:, None]
        between = np.einsum("qcd,qcd->qc", gap, gap)
        dist[alpha * alpha * between <= dist] = np.inf
        dist[every, best] = np.inf
        dist[cand == cand[every, best][:, None]] = np.inf
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 5, batch: int = 256):
    """(graph, entry nodes) over float32 points: random edges, then a pass with alpha 1 and one with alpha."""
    n = len(points)
    rng = np.random.default_rng(seed)
    center = points.mean(0)
    far = ((points - center) ** 2).sum(1)
    # searches start at the middle and all over: from a dense cluster alone they might not get out
    entry = np.unique(np.append(int(far.argmin()), rng.choice(n, min(n, ENTRIES), replace=False)))
    graph = np.full((n, degree), -1, np.int64)
    if n <= 1:
        return graph, entry
    m = min(degree, n - 1)
    graph[:, :m] = (np.arange(n)[:, None] + 1 + np.argsort(rng.random((n, min(n - 1, 4 * m))), 1)[:, :m]) % n if n - 1 <= 4 * m else (np.arange(n)[:, None] + 1 + rng.integers(0, n - 1, (n, m))) % n
    for a in (1.0, alpha):
        todo = rng.permutation(n)
        for lo in range(0, n, batch):
            nodes = todo[lo : lo + batch]
            _, _, ids, dist = beam_search(points, graph, entry, points[nodes], beam, keep_seen=True)
            own = graph[nodes]
            cand = np.concatenate([ids, own], 1)
            dist = np.concatenate([dist, np.where(own >= 0, _squares(points, points[nodes], np.maximum(own, 0)), np.inf)], 1)
            # the same node twice is a duplicate at distance 0 of itself: pruned by the first
            graph[nodes] = robust_prune(points, nodes, cand, dist, degree, a)
            _back(points, graph, nodes, degree, a)
    return graph, entry


def _back(points, graph, nodes, degree, alpha):
    """Add each new edge's reverse; a node with more than degree edges is pruned."""
    src = np.repeat(nodes, degree)
    dst = graph[nodes].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    targets, first, counts = np.unique(dst, return_index=True, return_counts=True)
    wide = int(counts.max()) if len(counts) else 0
    if not wide:
        return
    extra = np.full((len(targets), wide), -1, np.int64)
    extra[np.repeat(np.arange(len(targets)), counts), np.arange(len(dst)) - np.repeat(first, counts)] = src
    cand = np.concatenate([graph[targets], extra], 1)
    for lo in range(0, len(targets), 256):
        t, c = targets[lo : lo + 256], cand[lo : lo + 256]
        d = np.where(c >= 0, _squares(points, points[t], np.maximum(c, 0)), np.inf)
        fits = (c >= 0).sum(1) <= degree
        pruned = robust_prune(points, t, c, d, degree, alpha)
        for i in np.flatnonzero(fits):
            own = np.unique(c[i][c[i] >= 0])
            pruned[i] = -1
            pruned[i, : len(own)] = own
        graph[t] = pruned


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows (vec_id, v) whose vector is not null, empty or zero and holds finite components only."""
    v = F.col("v")
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors[column].cast("array<double>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0))


def build_index(rows: DataFrame, keep: int, shard: int = SHARD) -> DataFrame:
    """(shard, dim, n, ids, vectors, graph, entry): a row a shard of about ``shard`` distinct vectors.

    Rows with the same vector share a node that carries their ``keep`` least ids, in order; no more of them
    can be among the ``keep - 1`` nearest of anything but itself.
    """
    keyed = rows.withColumn("key", F.xxhash64("v"))
    least = keyed.withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("at") <= keep)
    nodes = materialize(least.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "nodes")
    shards = max(1, -(-nodes.count() // shard))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))

    def build(pdf):
        import pandas as pd

        out = []
        for dim, part in pdf.groupby(pdf["v"].map(len)):
            exact = np.array(part["v"].tolist(), np.float64)
            order = np.lexsort(exact.T[::-1])
            exact = exact[order]
            graph, entry = build_graph(_frame(exact)(exact))
            ids = np.full((len(part), keep), -1, np.int64)
            for i, own in enumerate(part["ids"].iloc[order]):
                ids[i, : len(own)] = own
            out.append((int(part["shard"].iloc[0]), dim, len(part), ids.tobytes(), exact.tobytes(), graph.astype(np.int32).tobytes(), entry.astype(np.int32).tobytes()))
        return pd.DataFrame(out, columns=["shard", "dim", "n", "ids", "vectors", "graph", "entry"])

    return materialize(dealt.groupBy("shard").applyInPandas(build, "shard int, dim int, n int, ids binary, vectors binary, graph binary, entry binary"), "graphs")


def _best(who: np.ndarray, near: np.ndarray, score: np.ndarray, k: int):
    """The k nearest different ids of each query, ties to the smaller id: (who, near, score)."""
    order = np.lexsort((score, near, who))
    who, near, score = who[order], near[order], score[order]
    once = np.append(True, (who[1:] != who[:-1]) | (near[1:] != near[:-1]))[: len(who)]
    who, near, score = who[once], near[once], score[once]
    order = np.lexsort((near, score, who))
    who, near, score = who[order], near[order], score[order]
    top = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[top], near[top], score[top]


def _search_shard(r: dict, beam: int, k: int):
    """Yield (who, near, score) of a shard's nearest ids of slices of a block of queries."""
    n, dim = r["n"], r["dim"]
    ids = np.frombuffer(r["ids"], np.int64).reshape(n, -1)
    exact = np.frombuffer(r["vectors"], np.float64).reshape(n, dim)
    graph = np.frombuffer(r["graph"], np.int32).reshape(n, -1).astype(np.int64)
    entry = np.frombuffer(r["entry"], np.int32).astype(np.int64)
    every, asked = np.frombuffer(r["asked"], np.int64), np.frombuffer(r["points"], np.float64).reshape(-1, dim)
    frame = _frame(exact)
    walked = frame(exact)
    step = max(1, WORK_BYTES // (8 * dim * max(beam, graph.shape[1], len(entry))))
    for lo in range(0, len(every), step):
        who, points = every[lo : lo + step], asked[lo : lo + step]
        found, dist = beam_search(walked, graph, entry, frame(points), beam)
        row, col = np.nonzero((found >= 0) & np.isfinite(dist))
        node = found[row, col]
        gap = exact[node]
        gap -= points[row]
        near = ids[node]
        a, b = np.nonzero((near >= 0) & (near != who[row][:, None]))
        yield _best(who[row][a], near[a, b], np.sqrt(np.square(gap, out=gap).sum(1))[a], k)


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, column: str = "embedding", beam: int = SEARCH_BEAM, shard: int = SHARD) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest found of each query, smallest Euclidean distance
    first, then smallest id; all candidates if fewer.

    ``queries`` has vec_id and the vector; by default rows whose vec_id is divisible by 100. A row of the
    query's own id is no candidate. Null, empty, zero and non-finite vectors and null ids take no part;
    vectors of another length are no candidates; ids repeated with the same vector count once, with
    different ones as rows of their own; an empty table gives no rows; other columns are ignored.
    """
    # one index row and one query block make a row of a few MB: few of them go to Python at once
    small_batches(vectors.sparkSession)
    rows = materialize(usable(vectors, column).distinct(), "vectors")
    asked = rows.where(F.col("vec_id") % 100 == 0) if queries is None else usable(queries, column).distinct()
    index = build_index(rows, k + 1, shard)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    def pack(pdf):
        import pandas as pd

        out = []
        for dim, part in pdf.groupby(pdf["v"].map(len)):
            out += [(dim, part["vec_id"].to_numpy(np.int64)[lo : lo + QUERY_BLOCK].tobytes(), np.array(part["v"].tolist(), np.float64)[lo : lo + QUERY_BLOCK].tobytes()) for lo in range(0, len(part), QUERY_BLOCK)]
        return pd.DataFrame(out, columns=["asked_dim", "asked", "points"])

    packed = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).groupBy("block").applyInPandas(pack, "asked_dim int, asked binary, points binary")
    # every block meets every shard of its length; no key, so neither shards nor blocks are shuffled
    work = index.join(materialize(packed, "queries"), F.expr("dim - asked_dim = 0"))

    def search(batches):
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in ("dim", "n", "ids", "vectors", "graph", "entry", "asked", "points")}
                for found in _search_shard(r, max(beam, k + 1), k):
                    held.append(found)
                    size += len(found[0])
                    if size > HELD:
                        held = [_best(*map(np.concatenate, zip(*held)), k)]
                        size = len(held[0][0])
                        if size > HELD // 2:
                            yield from _batches(*held[0])
                            held, size = [], 0
        if held:
            yield from _batches(*_best(*map(np.concatenate, zip(*held)), k))

    def _batches(*columns, rows=1 << 16):
        for lo in range(0, len(columns[0]), rows):
            yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + rows]) for c in columns], names=["query_id", "vec_id", "score"])

    found = work.select("dim", "n", "ids", "vectors", "graph", "entry", "asked", "points").mapInArrow(search, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
