"""Lower bounds by descent: from the root of the split tree down, a level at a time, and below a node only
if the node's own bound does not exceed the distance to beat.

A tree that fits the broadcast budget is shipped, and each task walks its queries down. Otherwise the
frontier, rows of (query, node), meets the next level of the node table in a join; levels near the
root are few rows and are shipped, deeper ones have many keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftleaf.functions.series import lower_bound_squared
from driftleaf.operators.bounds import SLACK, BOUND_SCHEMA
from driftleaf.operators.scan import to_matrix
from driftleaf.session import broadcast_if_small, materialise

MET_SCHEMA = "query_id long, met long"
# Pairs of a query and a node that a task holds at most, unless one query has more.
_HELD = 1 << 20


def _capped(batch: pa.RecordBatch) -> np.ndarray:
    limit = batch.column("kth").to_numpy(zero_copy_only=False).astype(float)
    return np.where(np.isnan(limit), np.inf, limit) * (1 + SLACK) + SLACK


def descend(queries: DataFrame, shared: Broadcast) -> DataFrame:
    """(query_id, leaf_id, lb) of the leaves whose bound, and that of every node above, does not exceed
    ``kth`` of (query_id, values, kth); NULL means no limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, min(512, _HELD // len(shared.value.node_ids)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = part.column("query_id").to_numpy(zero_copy_only=False)
                row, node, lb, _ = shared.value.descend(to_matrix(part.column("values")), _capped(part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row], pa.int64()), pa.array(shared.value.node_ids[node], pa.int64()), pa.array(lb)],
                    names=["query_id", "leaf_id", "lb"],
                )

    return queries.select("query_id", "values", "kth").mapInArrow(run, BOUND_SCHEMA)


def nodes_met(queries: DataFrame, shared: Broadcast) -> DataFrame:
    """(query_id, met): how many nodes' bounds each query was compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(512, _HELD // len(shared.value.node_ids)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                met = shared.value.descend(to_matrix(part.column("values")), _capped(part))[-1]
                ids = part.column("query_id")
                yield pa.RecordBatch.from_arrays([ids, pa.array(met, pa.int64())], names=["query_id", "met"])

    return queries.select("query_id", "values", "kth").mapInArrow(run, MET_SCHEMA)


def expanded_levels(queries: DataFrame, nodes: DataFrame) -> Iterator[DataFrame]:
    """For each level (query_id, node_id, is_leaf, lb) of the nodes met whose bound does not exceed the
    limit; the next level holds children of these alone."""
    frontier = queries.select("query_id", "values", "kth", F.lit(None).cast("long").alias("above"))
    depth = 0
    while True:
        level = nodes.where(F.col("depth") == depth).select("node_id", "parent_id", "is_leaf", "seg")
        level = broadcast_if_small(level, "level", 256)
        met = frontier.join(level, F.col("parent_id").eqNullSafe(F.col("above")))
        lb = F.sqrt(lower_bound_squared(F.col("values"), F.col("seg")))
        near = F.col("kth").isNull() | (F.col("lb") <= F.col("kth") * (1 + SLACK) + SLACK)
        kept = met.select("query_id", "values", "kth", "node_id", "is_leaf", lb.alias("lb")).where(near)
        kept = materialise(kept, "frontier")
        yield kept.select("query_id", "node_id", "is_leaf", "lb")
        frontier = kept.where(~F.col("is_leaf")).select("query_id", "values", "kth", F.col("node_id").alias("above"))
        if frontier.isEmpty():
            return
        depth += 1


def descend_by_join(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same rows as ``descend`` for a tree of any size."""
    leaves = [
        level.where("is_leaf").select("query_id", F.col("node_id").alias("leaf_id"), "lb")
        for level in expanded_levels(queries, nodes)
    ]
    return reduce(DataFrame.unionByName, leaves)
