"""Approximate nearest neighbours by cosine over low-dimensional stable projections.

Unit vectors are projected on ``PROJECTIONS`` random normal directions; for a pair at distance d the
squared projected distance is d**2 times a chi-square variable. Each shard indexes the projected
points of every row in a kd-tree. A query visits boxes by growing projected distance, verifies the
points in them on the original vectors, and stops when the chi-square test holds: with t the distance
of the next box and d the k-th verified distance, the probability that a nearer point projects
below t is at least ``CONFIDENCE``. There is no cap on verified points.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no
part; a query meets vectors of its own length only; every row with the query's id is left out;
equal scores go to the smaller id and repeated rows count each; fewer than k rows give all of them;
other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftleaf.llm.sharded import grow_tree, merge, search_shards, usable

K, LEAF_ROWS, PROJECTIONS, CONFIDENCE, SEED = 5, 256, 8, 0.95, 17


def chi_square_cdf(x: float, freedom: int) -> float:
    """For even degrees of freedom."""
    half, term, total = x / 2, 1.0, 0.0
    for i in range(freedom // 2):
        total += term
        term *= half / (i + 1)
    return 1 - math.exp(-half) * total


def chi_square_point(share: float, freedom: int) -> float:
    """The x where the distribution reaches ``share``, by bisection."""
    low, high = 0.0, 1.0
    while chi_square_cdf(high, freedom) < share:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, freedom) < share else (low, middle)
    return high


def unit_rows(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled by their largest component, which keeps squares in range, and their lengths."""
    points = points / np.abs(points).max(1, keepdims=True)
    return points, np.sqrt((points * points).sum(1))


def search_projected(
    ids, points, query_ids, query_points, floors,
    k=K, leaf_rows=LEAF_ROWS, projections=PROJECTIONS, confidence=CONFIDENCE, seed=SEED,
):
    points, lengths = unit_rows(points)
    query_points, query_lengths = unit_rows(query_points)
    stable = np.random.default_rng(seed).standard_normal((points.shape[1], projections))
    tree = grow_tree((points / lengths[:, None]) @ stable, ids, leaf_rows)
    points, lengths, ids = points[tree.order], lengths[tree.order], ids[tree.order]
    enough = chi_square_point(confidence, projections)
    out_query, out_id, out_score = [], [], []
    shadows = (query_points / query_lengths[:, None]) @ stable
    for row, query in enumerate(query_points):
        own, floor, last_id = query_ids[row], floors[row], np.inf
        outside = np.maximum(np.maximum(tree.low - shadows[row], shadows[row] - tree.high), 0)
        gap = (outside * outside).sum(1).tolist()
        best = (np.zeros(0), np.zeros(0, np.int64))
        heap = [(gap[0], 0)]
        while heap:
            near, node = heapq.heappop(heap)
            if floor > -np.inf and near > enough * max(0.0, 2 - 2 * floor):
                break
            if floor >= 1 and tree.first_id[node] > last_id:
                continue
            child = tree.left[node]
            if child >= 0:
                heapq.heappush(heap, (gap[child], child))
                heapq.heappush(heap, (gap[child + 1], child + 1))
                continue
            a, b = tree.start[node], tree.stop[node]
            scores = (points[a:b] * query).sum(1) / (lengths[a:b] * query_lengths[row])
            good = np.flatnonzero((scores >= floor) & (ids[a:b] != own))
            if good.size:
                best = merge(best, ids[a:b][good], scores[good], k)
                if len(best[0]) == k and best[0][-1] >= floor:
                    floor, last_id = best[0][-1], best[1][-1]
        out_query.append(np.full(len(best[0]), own))
        out_id.append(best[1])
        out_score.append(best[0])
    return np.concatenate(out_query), np.concatenate(out_id), np.concatenate(out_score)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, **sizes: int) -> DataFrame:
    """(query_id, rank, vec_id, score) for vectors ``(vec_id, vec)``; score is the cosine."""
    searcher = lambda *arrays: search_projected(*arrays, k=k)
    return search_shards(vectors, queries, searcher, k, "double", **sizes)


def op7_nearest(embeddings: DataFrame, k: int = K, every: int = 50) -> DataFrame:
    rows = usable(embeddings, "embedding").where(
        F.col("vec_id").isNotNull() & F.exists("vec", lambda x: x != 0)
    )
    return nearest(rows, rows.where(F.pmod("vec_id", F.lit(every)) == 0), k)
