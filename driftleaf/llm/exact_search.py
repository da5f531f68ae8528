"""Exact top-k search by inner product with a kd-tree per shard.

Trees split at medians and keep tight bounding boxes. For a query q no point of a box scores more
than the sum over axes of ``max(q * low, q * high)``. Nodes are visited best bound first and the
search of a shard ends when the next bound is below the k-th score known so far, which starts at
the one handed on from another shard.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part,
as rows or as queries; a query meets vectors of its own length only; every row with the query's id
is left out; equal scores go to the smaller id and repeated rows count each; fewer than k rows give
all of them; other columns are ignored. Components are whole numbers; scores must fit a long and are
exact up to 2**53.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftleaf.llm.sharded import grow_tree, merge, search_shards, usable

K, LEAF_ROWS = 5, 256


def search_tree(ids, points, query_ids, query_points, floors, k=K, leaf_rows=LEAF_ROWS):
    """Best-first search of one shard for a group of queries."""
    tree = grow_tree(points, ids, leaf_rows)
    points, ids = points[tree.order], ids[tree.order]
    bounds = np.maximum(query_points, 0) @ tree.high.T + np.minimum(query_points, 0) @ tree.low.T
    out_query, out_id, out_score = [], [], []
    for row, query in enumerate(query_points):
        bound, own = bounds[row].tolist(), query_ids[row]
        floor, last_id = floors[row], np.inf
        best = (np.zeros(0), np.zeros(0, np.int64))
        heap = [(-bound[0], 0)]
        while heap:
            reach, node = heapq.heappop(heap)
            if -reach < floor:
                break
            if -reach == floor and tree.first_id[node] > last_id:
                continue
            child = tree.left[node]
            if child >= 0:
                for c in (child, child + 1):
                    if bound[c] >= floor:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            a, b = tree.start[node], tree.stop[node]
            scores = points[a:b] @ query
            good = np.flatnonzero((scores >= floor) & (ids[a:b] != own))
            if good.size:
                best = merge(best, ids[a:b][good], scores[good], k)
                if len(best[0]) == k and best[0][-1] >= floor:
                    floor, last_id = best[0][-1], best[1][-1]
        out_query.append(np.full(len(best[0]), own))
        out_id.append(best[1])
        out_score.append(best[0])
    return np.concatenate(out_query), np.concatenate(out_id), np.concatenate(out_score)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, **sizes: int) -> DataFrame:
    """(query_id, rank, vec_id, score) for whole-number vectors ``(vec_id, vec)``."""
    searcher = lambda *arrays: search_tree(*arrays, k=k)
    return search_shards(vectors, queries, searcher, k, "long", **sizes)


def op3_exact_search(embeddings: DataFrame, k: int = K, every: int = 50) -> DataFrame:
    whole = usable(embeddings, "embedding").select(
        "vec_id", F.transform("vec", lambda x: F.floor(x * 256).cast("double")).alias("vec")
    )
    whole = whole.where(F.col("vec_id").isNotNull())
    return top_k(whole, whole.where(F.pmod("vec_id", F.lit(every)) == 0), k)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.vec, v.vec) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND len(q.vec) = len(v.vec)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
