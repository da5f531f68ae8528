"""Lower bounds between queries and leaves, over whole tables of both."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftleaf.functions.series import lower_bound_squared
from driftleaf.operators.scan import to_matrix
from driftleaf.operators.tree import summaries
from driftleaf.session import share
from driftleaf.settings import QUERY_BLOCK_ROWS, broadcast_budget

BOUND_SCHEMA = "query_id long, leaf_id long, lb double"
_BOUND_ARROW = pa.schema(
    [("query_id", pa.int64()), ("leaf_id", pa.int64()), ("lb", pa.float64())]
)
# Bounds are compared with distances that are rounded differently in the last digits.
SLACK = 1e-7
# Pairs of a query and a leaf, and terms of their bounds, that a task holds at once, however many leaves there are.
_PAIRS, _TERMS = 1 << 19, 1 << 18


class _Leaves:
    """Envelopes of all leaves, flattened to one row per leaf and segment."""

    def __init__(self, table: pa.Table) -> None:
        self.leaf_ids = table.column("leaf_id").to_numpy().astype(np.int64)
        if not len(self.leaf_ids):
            return
        seg = table.column("seg").combine_chunks()
        if isinstance(seg, pa.ChunkedArray):
            seg = seg.combine_chunks()
        widths = pa.compute.list_value_length(seg).to_numpy(zero_copy_only=False)
        flat = seg.flatten()
        part = {name: flat.field(name).to_numpy(zero_copy_only=False) for name in (
            "off", "len", "min_mean", "max_mean", "min_std", "max_std")}
        keys = list(zip(part["off"].tolist(), part["len"].tolist()))
        self.segments = sorted(set(keys))
        slot = {key: i for i, key in enumerate(self.segments)}
        self.slot = np.array([slot[key] for key in keys], dtype=np.int64)
        self.part = part
        self.starts = np.r_[0, np.cumsum(widths)[:-1]].astype(np.int64)

    def only(self, leaf_ids: np.ndarray) -> _Leaves:
        """The envelopes of the given leaves, in that order."""
        order = np.argsort(self.leaf_ids)
        at = order[np.searchsorted(self.leaf_ids, leaf_ids, sorter=order)]
        widths = np.diff(np.r_[self.starts, len(self.slot)])[at]
        out = object.__new__(_Leaves)
        out.leaf_ids, out.starts = leaf_ids, np.r_[0, np.cumsum(widths)[:-1]].astype(np.int64)
        rows = np.repeat(self.starts[at] - out.starts, widths) + np.arange(widths.sum())
        used, out.slot = np.unique(self.slot[rows], return_inverse=True)
        out.segments = [self.segments[i] for i in used]
        out.part = {name: values[rows] for name, values in self.part.items()}
        return out

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """Matrix of bounds, one row per series of ``x`` and one column per leaf."""
        means, stds = summaries(x, self.segments)
        out = np.empty((len(x), len(self.leaf_ids)))
        step = max(1, _TERMS // max(1, len(self.slot)))
        p = self.part
        for lo in range(0, len(x), step):
            m, s = means[lo : lo + step, self.slot], stds[lo : lo + step, self.slot]
            dm = np.maximum(np.maximum(p["min_mean"] - m, m - p["max_mean"]), 0.0)
            ds = np.maximum(np.maximum(p["min_std"] - s, s - p["max_std"]), 0.0)
            terms = p["len"] * (dm * dm + ds * ds)
            out[lo : lo + step] = np.add.reduceat(terms, self.starts, axis=1)
        return np.sqrt(out)


def _fits(leaf: DataFrame) -> pa.Table | None:
    """The envelopes, if they fit the broadcast budget."""
    budget = broadcast_budget(leaf.sparkSession)
    # Each leaf has at least one segment of 48 bytes and its id.
    table = leaf.select("leaf_id", "seg").limit(budget // 64 + 1).toArrow()
    return table if table.num_rows <= budget // 64 and table.nbytes <= budget else None


def ship_leaves(leaf: DataFrame) -> Broadcast | None:
    """The envelopes in the tasks' memory, if they fit the broadcast budget."""
    table = _fits(leaf)
    return None if table is None else share(leaf.sparkSession, _Leaves(table.combine_chunks()))


def leaf_bounds(
    queries: DataFrame,
    leaf: DataFrame,
    limit_column: str | None = None,
    shipped: Broadcast | None = None,
) -> DataFrame:
    """(query_id, leaf_id, lb) for every query and leaf; with ``limit_column``, only leaves whose
    bound does not exceed that column of the query (NULL means no limit).

    Envelopes that fit the budget are shipped and the queries are mapped in place. Otherwise
    blocks of queries meet the leaves in an equi-join on the block number, so that the larger
    side is neither collected nor paired in one task."""
    columns = ["query_id", "values"] + ([limit_column] if limit_column else [])
    shared = shipped or ship_leaves(leaf)
    if shared is None:
        return _joined_bounds(queries.select(*columns), leaf, limit_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves = shared.value
        for batch in batches:
            if not batch.num_rows or not len(leaves.leaf_ids):
                continue
            ids = batch.column("query_id").to_numpy(zero_copy_only=False)
            x = to_matrix(batch.column("values"))
            limit = None
            if limit_column:
                limit = batch.column(limit_column).to_numpy(zero_copy_only=False).astype(float)
                limit = np.where(np.isnan(limit), np.inf, limit)
            step = max(1, _PAIRS // len(leaves.leaf_ids))
            for lo in range(0, len(x), step):
                lb = leaves.bounds(x[lo : lo + step])
                if limit is None:
                    row, col = np.divmod(np.arange(lb.size), lb.shape[1])
                else:
                    cap = limit[lo : lo + step, None]
                    row, col = np.nonzero(lb <= cap * (1 + SLACK) + SLACK)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[lo : lo + step][row]),
                        pa.array(leaves.leaf_ids[col]),
                        pa.array(lb[row, col]),
                    ],
                    schema=_BOUND_ARROW,
                )

    return queries.select(*columns).mapInArrow(run, BOUND_SCHEMA)


def _joined_bounds(queries: DataFrame, leaf: DataFrame, limit_column: str | None) -> DataFrame:
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK_ROWS))
    blocked = queries.withColumn(
        "block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int")
    )
    packed = blocked.groupBy("block").agg(F.collect_list(F.struct(*queries.columns)).alias("qs"))
    pairs = (
        leaf.select("leaf_id", "seg")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        .join(packed, "block")
        .withColumn("q", F.explode("qs"))
        .select(
            "q.query_id",
            "leaf_id",
            F.sqrt(lower_bound_squared(F.col("q.values"), F.col("seg"))).alias("lb"),
            (F.col(f"q.{limit_column}") if limit_column else F.lit(None).cast("double")).alias(
                "cap"
            ),
        )
    )
    if limit_column:
        pairs = pairs.where(
            F.col("cap").isNull() | (F.col("lb") <= F.col("cap") * (1 + SLACK) + SLACK)
        )
    return pairs.drop("cap")
