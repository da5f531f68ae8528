"""What both vector searches share: numeric vectors, kd-trees by median splits, and the two rounds
of a search over shards.

Vectors are dealt to shards by a hash, queries are packed into groups, and a task holds one shard
and one group. In the first round a query is searched in one shard only; its k-th score there
bounds the global one and is handed to the second round, which searches every shard.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftleaf.session import materialise, ship_package

FOUND = "query_id long, vec_id long, score {kind}"


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """(vec_id, vec) of the vectors that are not null or empty and hold only finite numbers."""
    x = F.col(column)
    ill = lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf"))
    return vectors.where(x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, ill)).select(
        F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("vec")
    )


@dataclass
class Tree:
    """Nodes by number; ``order`` lists rows so that a node covers one range of it."""

    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    start: list[int]
    stop: list[int]
    left: list[int]
    first_id: list[int]


def grow_tree(points: np.ndarray, ids: np.ndarray, leaf_rows: int) -> Tree:
    """Median splits of the widest side; boxes are tight. A leaf of equal points stays whole."""
    order = np.arange(len(points))
    low, high, start, stop, left, first_id = [], [], [], [], [], []

    def add(a: int, b: int) -> int:
        rows = points[order[a:b]]
        low.append(rows.min(0))
        high.append(rows.max(0))
        start.append(a)
        stop.append(b)
        left.append(-1)
        first_id.append(int(ids[order[a:b]].min()))
        return len(start) - 1

    open_nodes = [add(0, len(points))]
    while open_nodes:
        node = open_nodes.pop()
        a, b = start[node], stop[node]
        sides = high[node] - low[node]
        axis = int(sides.argmax())
        if b - a <= leaf_rows or not sides[axis] > 0:
            continue
        middle = (a + b) // 2
        part = np.argpartition(points[order[a:b], axis], middle - a)
        order[a:b] = order[a:b][part]
        left[node] = add(a, middle)
        add(middle, b)
        open_nodes += [left[node], left[node] + 1]
    return Tree(order, np.array(low), np.array(high), start, stop, left, first_id)


def merge(best: tuple[np.ndarray, np.ndarray], ids: np.ndarray, scores: np.ndarray, k: int):
    """The k best (scores, ids); equal scores by smaller id."""
    scores, ids = np.concatenate([best[0], scores]), np.concatenate([best[1], ids])
    keep = np.lexsort((ids, -scores))[:k]
    return scores[keep], ids[keep]


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


Searcher = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple]


def search_shards(
    vectors: DataFrame,
    queries: DataFrame,
    searcher: Searcher,
    k: int,
    kind: str,
    shard_rows: int = 8192,
    group_rows: int = 2048,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best per query, ties to the smaller id.

    ``searcher(ids, matrix, query_ids, query_matrix, floors)`` returns three arrays: query ids,
    ids, scores; ``floors`` are scores that k rows are known to reach. Only vectors as long as the
    query are compared.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    vectors, queries = materialise(vectors, "vectors"), materialise(queries, "queries")
    shards = max(1, -(-vectors.count() // shard_rows))
    groups = max(1, -(-queries.count() // group_rows))
    number_type = pa.int64() if kind == "long" else pa.float64()
    schema = FOUND.format(kind=kind)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            floors = right.column("floor").combine_chunks().to_numpy(zero_copy_only=False)
            out = searcher(
                left.column("vec_id").to_numpy(), matrix(left.column("vec")),
                right.column("vec_id").to_numpy(), matrix(right.column("vec")),
                np.where(np.isnan(floors), -np.inf, floors),
            )
        else:
            out = (np.zeros(0, np.int64),) * 3
        return pa.table(
            {
                "query_id": pa.array(out[0], pa.int64()),
                "vec_id": pa.array(out[1], pa.int64()),
                "score": pa.array(out[2].astype(number_type.to_pandas_dtype()), number_type),
            }
        )

    def dealt(count: int, *by: str) -> Column:
        return F.pmod(F.xxhash64(*by), F.lit(count)).cast("int")

    size = F.size("vec").alias("width")
    placed = vectors.select("vec_id", "vec", size, dealt(shards, "vec_id", "vec").alias("shard"))
    asked = queries.select("vec_id", "vec", size, dealt(groups, "vec_id").alias("group"))
    home = asked.select(
        "vec_id", "vec", "width", F.lit(None).cast("double").alias("floor"), "group",
        dealt(shards, "vec_id", "group").alias("shard"),
    )
    keys = ["width", "shard", "group"]

    def answers(asked_rows: DataFrame) -> DataFrame:
        wanted = asked_rows.select(*[F.col(c).alias(c) for c in keys]).distinct()
        rows = placed.join(wanted, ["width", "shard"]).select("vec_id", "vec", *keys)
        return rows.groupBy(*keys).cogroup(asked_rows.groupBy(*keys)).applyInArrow(run, schema)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    seed = answers(home).withColumn("rank", F.row_number().over(best))
    floors = materialise(
        seed.where(F.col("rank") == k).select(
            F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor")
        ),
        "floors",
    )
    everywhere = (
        asked.join(floors, "vec_id", "left")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        .select("vec_id", "vec", "width", "floor", "group", "shard")
    )
    return (
        answers(everywhere)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
