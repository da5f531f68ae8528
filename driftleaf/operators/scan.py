"""Distance scans of a set of queries over leaf members.

Two physical strategies give the same rows:

* queries that fit the broadcast budget are shipped to the tasks, the members are read once and
  never shuffled, and each task keeps only the k nearest per query (or per query and leaf);
* larger query sets are packed into blocks and meet packed member blocks in an equi-join on
  (leaf, part). Parts split a leaf that holds many members, and query blocks split a leaf that
  many queries want, so that no task holds a whole hot leaf.

Inside a task the distances of a batch come from one matrix product; every pair that could be
among the nearest is then recomputed from the differences, so the answers do not suffer from
cancellation.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftleaf.session import (
    broadcast_if_small,
    materialise,
    pinned_table,
    series_bytes,
    share,
    ship_package,
)
from driftleaf.settings import BLOCK_ROWS, QUERY_BLOCK_ROWS

SCAN_SCHEMA = "query_id long, leaf_id long, series_id long, dist2 double"
ARROW_SCHEMA = pa.schema(
    [
        ("query_id", pa.int64()),
        ("leaf_id", pa.int64()),
        ("series_id", pa.int64()),
        ("dist2", pa.float64()),
    ]
)
# Rows a task holds before it keeps the nearest alone.
_STATE_ROWS = 1 << 18
_PAIR_CHUNK = 1 << 16


def to_matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a float64 matrix."""
    if column.null_count:
        raise ValueError("a series is NULL")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("a series has a NULL element")
    data = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(column) == 0:
        return data.reshape(0, 0)
    if data.size % len(column) or pa.compute.count_distinct(
        pa.compute.list_value_length(column)
    ).as_py() > 1:
        raise ValueError("series differ in length")
    return data.reshape(len(column), -1)


def exact_squares(q: np.ndarray, x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows))
    for lo in range(0, len(rows), _PAIR_CHUNK):
        diff = q[rows[lo : lo + _PAIR_CHUNK]] - x[cols[lo : lo + _PAIR_CHUNK]]
        out[lo : lo + _PAIR_CHUNK] = np.einsum("ij,ij->i", diff, diff)
    return out


def keep_k(group: np.ndarray, dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest (distance, id) of each group."""
    order = np.lexsort((ids, dist, group))
    sorted_group = group[order]
    starts = np.flatnonzero(np.r_[True, sorted_group[1:] != sorted_group[:-1]])
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < k]


def nearest(
    q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, member row, squared distance) of the k nearest members per query row."""
    parts = []
    x_sq = np.einsum("ij,ij->i", x, x)
    for lo in range(0, len(q), 128):
        block = q[lo : lo + 128]
        q_sq = np.einsum("ij,ij->i", block, block)
        if len(x) > k:
            rough = q_sq[:, None] + x_sq[None, :] - 2.0 * (block @ x.T)
            kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
            slack = 1e-9 * (q_sq + x_sq.max() + 1e-30)
            rows, cols = np.nonzero(rough <= (kth + slack)[:, None])
        else:
            rows = np.repeat(np.arange(len(block)), len(x))
            cols = np.tile(np.arange(len(x)), len(block))
        dist = exact_squares(block, x, rows, cols)
        keep = keep_k(rows, dist, ids[cols], k)
        parts.append((rows[keep] + lo, cols[keep], dist[keep]))
    if not parts:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, np.empty(0)
    return tuple(np.concatenate(p) for p in zip(*parts))  # type: ignore[return-value]


class _Best:
    """The k nearest seen so far, per query row and, if asked, per leaf."""

    def __init__(self, k: int, per_leaf: bool) -> None:
        self.k, self.per_leaf = k, per_leaf
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = self.kept = 0

    def add(self, row: np.ndarray, leaf: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        self.parts.append((row, leaf, ids, dist))
        self.rows += len(row)
        if self.rows > max(_STATE_ROWS, 2 * self.kept):  # so that what stays is not sorted at every call
            self.shrink()

    def shrink(self) -> None:
        if not self.parts:
            return
        row, leaf, ids, dist = (np.concatenate(p) for p in zip(*self.parts))
        if self.per_leaf:
            _, leaf_no = np.unique(leaf, return_inverse=True)
            group = row * (leaf_no.max() + 1 if len(leaf_no) else 1) + leaf_no
        else:
            group = row
        keep = keep_k(group, dist, ids, self.k)
        self.parts = [(row[keep], leaf[keep], ids[keep], dist[keep])]
        self.rows = self.kept = len(keep)

    def drain(self, query_ids: np.ndarray) -> pa.RecordBatch | None:
        self.shrink()
        if not self.parts or not self.rows:
            return None
        row, leaf, ids, dist = self.parts[0]
        self.parts, self.rows, self.kept = [], 0, 0
        return pa.RecordBatch.from_arrays(
            [pa.array(query_ids[row]), pa.array(leaf), pa.array(ids), pa.array(dist)],
            schema=ARROW_SCHEMA,
        )


def _by_leaf(leaf: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(leaf, kind="stable")
    bounds = np.flatnonzero(np.r_[True, leaf[order][1:] != leaf[order][:-1]])
    for part in np.split(order, bounds[1:]):
        if len(part):
            yield int(leaf[part[0]]), part


def _broadcast_scan(
    members: DataFrame, query_ids: np.ndarray, queries: np.ndarray, wanted, k: int, per_leaf: bool
) -> DataFrame:
    """``wanted`` maps a leaf to the query rows that want it; None means every query."""
    shared = share(members.sparkSession, (query_ids, queries, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_q, q, pairs = shared.value
        best = _Best(k, per_leaf)
        everyone = np.arange(len(q))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("series_id").to_numpy(zero_copy_only=False)
            leaf = batch.column("leaf_id").to_numpy(zero_copy_only=False)
            x = to_matrix(batch.column("values"))
            for lo in range(0, len(x), 2048):
                cut = slice(lo, lo + 2048)
                if pairs is None and not per_leaf:
                    groups = [(None, np.arange(len(x[cut])))]
                else:
                    groups = list(_by_leaf(leaf[cut]))
                for leaf_id, pos in groups:
                    want = everyone if pairs is None else pairs.get(leaf_id)
                    if want is None:
                        continue
                    at = pos + lo
                    row, col, dist = nearest(q[want], x[at], ids[at], k)
                    best.add(want[row], leaf[at][col], ids[at][col], dist)
            if per_leaf and best.rows > _STATE_ROWS // 2:
                out = best.drain(ids_q)
                if out is not None:
                    yield out
        out = best.drain(ids_q)
        if out is not None:
            yield out

    return members.select("series_id", "leaf_id", "values").mapInArrow(run, SCAN_SCHEMA)


def _block_scan(blocks: DataFrame, k: int, per_leaf: bool) -> DataFrame:
    """``blocks`` rows: leaf_id, query_ids, queries, series_ids, matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                def cell(name: str) -> pa.Array:
                    return batch.column(name).slice(i, 1).flatten()

                ids_q = cell("query_ids").to_numpy(zero_copy_only=False)
                ids = cell("series_ids").to_numpy(zero_copy_only=False)
                leaf_id = batch.column("leaf_id")[i].as_py()
                q, x = to_matrix(cell("queries")), to_matrix(cell("matrix"))
                best = _Best(k, per_leaf)
                for lo in range(0, len(x), 2048):
                    row, col, dist = nearest(q, x[lo : lo + 2048], ids[lo : lo + 2048], k)
                    best.add(row, np.full(len(row), leaf_id), ids[lo + col], dist)
                out = best.drain(ids_q)
                if out is not None:
                    yield out

    return blocks.mapInArrow(run, SCAN_SCHEMA)


def _block_join(
    members: DataFrame, queries: DataFrame, pairs: DataFrame | None, k: int, per_leaf: bool
) -> DataFrame:
    spark = members.sparkSession
    ship_package(spark)
    if pairs is not None:
        pairs = materialise(pairs.select("query_id", "leaf_id"), "pairs")
    sizes = members.groupBy("leaf_id").agg(
        F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("parts")
    )
    sizes = broadcast_if_small(sizes, "sizes")
    member_blocks = (
        members.select("leaf_id", "series_id", "values")
        .join(sizes, "leaf_id")
        .withColumn("part", F.pmod(F.xxhash64("series_id"), "parts").cast("int"))
        .groupBy("leaf_id", "part")
        .agg(F.collect_list(F.struct("series_id", "values")).alias("rows"))
        .select(
            "leaf_id",
            "part",
            F.col("rows.series_id").alias("series_ids"),
            F.col("rows.values").alias("matrix"),
        )
    )
    q = queries.select("query_id", F.col("values").alias("q_values"))
    if pairs is None:
        pairs = sizes.select("leaf_id")
        wanted = _with_query_blocks_for_all(q, pairs)
    else:
        demand = pairs.groupBy("leaf_id").agg(
            F.ceil(F.count("*") / F.lit(QUERY_BLOCK_ROWS)).cast("int").alias("chunks")
        )
        wanted = (
            pairs.select("query_id", "leaf_id")
            .join(demand, "leaf_id")
            .withColumn("chunk", F.pmod(F.xxhash64("query_id"), "chunks").cast("int"))
            .join(q, "query_id")
            .groupBy("leaf_id", "chunk")
            .agg(F.collect_list(F.struct("query_id", "q_values")).alias("qs"))
        )
    blocks = (
        wanted.join(sizes, "leaf_id")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .join(member_blocks, ["leaf_id", "part"])
        .select(
            "leaf_id",
            F.col("qs.query_id").alias("query_ids"),
            F.col("qs.q_values").alias("queries"),
            "series_ids",
            "matrix",
        )
    )
    return _block_scan(blocks, k, per_leaf)


def _with_query_blocks_for_all(q: DataFrame, leaves: DataFrame) -> DataFrame:
    """One row per (leaf, query block): blocks are packed once and then sent to the leaves that
    ask for them through an equi-join on the block number."""
    n = q.count()
    n_blocks = max(1, -(-n // QUERY_BLOCK_ROWS))
    packed = (
        q.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int"))
        .groupBy("chunk")
        .agg(F.collect_list(F.struct("query_id", "q_values")).alias("qs"))
    )
    asked = leaves.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    return asked.join(packed, "chunk")


def bounded_queries(queries: DataFrame) -> pa.Table | None:
    """The query rows, when they fit the broadcast budget; None when they do not."""
    width = 1 if hasattr(queries, "_held") else series_bytes(queries)
    return pinned_table(queries, ["query_id", "values"], width)


def _query_arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    table = table.combine_chunks()
    ids = table.column("query_id").to_numpy()
    if not len(ids):
        return ids.astype(np.int64), np.empty((0, 0))
    return ids, to_matrix(table.column("values").combine_chunks())


def leaf_ranges(leaves: list[int], most: int = 32) -> Column:
    """A few ranges that cover the wanted leaves. Members are stored in leaf order, so the file
    reader skips files and row groups outside them."""
    if not leaves:
        return F.lit(False)
    gaps = sorted(range(1, len(leaves)), key=lambda i: leaves[i - 1] - leaves[i])[: most - 1]
    cuts = [0, *sorted(gaps), len(leaves)]
    ranges = [F.col("leaf_id").between(leaves[a], leaves[b - 1]) for a, b in zip(cuts, cuts[1:])]
    return reduce(lambda a, b: a | b, ranges)


def scan(
    members: DataFrame,
    queries: DataFrame,
    k: int,
    pairs: DataFrame | None = None,
    per_leaf: bool = False,
) -> DataFrame:
    """Partial answers (query_id, leaf_id, series_id, dist2): at least the k nearest members per
    query, or per query and leaf; the caller merges them. ``pairs`` restricts the leaves that a
    query visits."""
    spark = members.sparkSession
    if "leaf_id" not in members.columns:
        members = members.withColumn("leaf_id", F.lit(0).cast("long"))
    table = bounded_queries(queries)
    wanted = None
    small = table is not None
    if small and pairs is not None:
        pair_table = pinned_table(pairs, ["query_id", "leaf_id"], 16)
        small = pair_table is not None
        if small:
            ids, _ = _query_arrays(table)
            order = np.argsort(ids)
            q_of = pair_table.column("query_id").to_numpy()
            row = order[np.searchsorted(ids[order], q_of)] if len(q_of) else q_of
            leaf = pair_table.column("leaf_id").to_numpy()
            wanted = {key: row[pos] for key, pos in _by_leaf(leaf)} if len(leaf) else {}
    if not small:
        return _block_join(members, queries, pairs, k, per_leaf)
    ids, matrix = _query_arrays(table)
    if wanted is not None:
        leaves = spark.createDataFrame([(int(x),) for x in wanted], "leaf_id long")
        members = members.where(leaf_ranges(sorted(wanted))).join(
            F.broadcast(leaves), "leaf_id", "left_semi"
        )
    return _broadcast_scan(members, ids, matrix, wanted, k, per_leaf)


def top_k(partial: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """Merge partial answers: (by..., rank, ..., dist). Ties go to the smaller series id."""
    by = by or ["query_id"]
    order = Window.partitionBy(*by).orderBy("dist2", "series_id")
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .withColumn("dist", F.sqrt("dist2"))
    )


def leaf_nn_distance(members: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, leaf_id, lnn): distance to the nearest member of every leaf."""
    return (
        scan(members, queries, 1, per_leaf=True)
        .groupBy("query_id", "leaf_id")
        .agg(F.sqrt(F.min("dist2")).alias("lnn"))
    )
