"""Nearest members of many queries at once, without a table of (query, leaf) pairs.

When bounds prune little, the pairs of queries and leaves outgrow both tables by far. Here a task holds
queries with the distance each has to beat and meets members in leaf order: it takes the bounds of
those leaves itself, and the distance of a query falls as nearer members are found. Queries that fit the
broadcast budget are shipped and members are read once; larger query sets meet the members in
cells of a grid, a task a cell, each of at most ``CELL_BYTES`` of queries and of members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftleaf.operators.bounds import SLACK
from driftleaf.operators.scan import ARROW_SCHEMA, SCAN_SCHEMA, exact_squares, keep_k, to_matrix
from driftleaf.session import pinned_table, series_bytes, share, ship_package

CELL_BYTES = 32 << 20
_QUERIES, _MEMBERS, _BUFFER = 1024, 2048, 16_384
# Above this share of wanted (query, leaf) pairs one product for many leaves is cheaper than one a leaf.
_DENSE = 0.3


class _Within:
    """The k nearest members seen so far of every query, and the squared distance to beat."""

    def __init__(self, q: np.ndarray, kth: np.ndarray, k: int) -> None:
        self.q, self.k = q, k
        self.q_sq = np.einsum("ij,ij->i", q, q)
        self.limit = np.where(np.isnan(kth), np.inf, kth * kth)
        self.dist = np.full((len(q), k), np.inf)
        self.ids = np.full((len(q), k), np.iinfo(np.int64).max)
        self.leaf = np.zeros((len(q), k), np.int64)

    def visit(self, leaves, x: np.ndarray, leaf: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(leaf, kind="stable")
        x, leaf, ids = x[order], leaf[order], ids[order]
        here, starts = np.unique(leaf, return_index=True)
        stops = np.r_[starts[1:], len(leaf)]
        envelopes = leaves.only(here)
        for lo in range(0, len(self.q), _QUERIES):
            part = slice(lo, lo + _QUERIES)
            cap = np.sqrt(self.limit[part]) * (1 + SLACK) + SLACK
            want = envelopes.bounds(self.q[part]) <= cap[:, None]
            if want.mean() > _DENSE:
                for a in range(0, len(x), _MEMBERS):
                    b = min(a + _MEMBERS, len(x))
                    first, last = np.searchsorted(here, [leaf[a], leaf[b - 1]])
                    self._add(lo + np.flatnonzero(want[:, first : last + 1].any(1)), x[a:b], leaf[a:b], ids[a:b])
                continue
            for at in np.flatnonzero(want.any(0)):
                rows = lo + np.flatnonzero(want[:, at])
                for a in range(starts[at], stops[at], _MEMBERS):
                    b = min(a + _MEMBERS, stops[at])
                    self._add(rows, x[a:b], leaf[a:b], ids[a:b])

    def _add(self, rows: np.ndarray, x: np.ndarray, leaf: np.ndarray, ids: np.ndarray) -> None:
        if not len(rows):
            return
        q, k, x_sq = self.q[rows], self.k, np.einsum("ij,ij->i", x, x)
        rough = q @ x.T
        rough *= -2.0
        rough += self.q_sq[rows][:, None]
        rough += x_sq[None, :]
        slack = 1e-9 * (self.q_sq[rows] + x_sq.max() + 1e-30)
        cap = self.limit[rows] + slack
        near = np.flatnonzero(rough <= cap[:, None])
        if len(near) > 4 * k * len(rows) and len(x) > k:
            kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
            near = np.flatnonzero(rough <= np.minimum(cap, kth + slack)[:, None])
        if not len(near):
            return
        row, col = np.divmod(near, len(x))
        dist = exact_squares(q, x, row, col)
        touched, group = np.unique(row, return_inverse=True)
        own = rows[touched]
        # Each group holds the k so far, so exactly k remain of it.
        group = np.r_[group, np.repeat(np.arange(len(own)), k)]
        dist = np.r_[dist, self.dist[own].ravel()]
        found, home = np.r_[ids[col], self.ids[own].ravel()], np.r_[leaf[col], self.leaf[own].ravel()]
        keep = keep_k(group, dist, found, k)
        self.dist[own] = dist[keep].reshape(-1, k)
        self.ids[own] = found[keep].reshape(-1, k)
        self.leaf[own] = home[keep].reshape(-1, k)
        self.limit[own] = np.minimum(self.limit[own], self.dist[own, k - 1])

    def rows(self, query_ids: np.ndarray) -> pa.Table:
        row, col = np.nonzero(np.isfinite(self.dist))
        columns = [query_ids[row], self.leaf[row, col], self.ids[row, col], self.dist[row, col]]
        return pa.table([pa.array(c) for c in columns], schema=ARROW_SCHEMA)


def _arrays(table: pa.Table, id_column: str, *others: str) -> list[np.ndarray]:
    table = table.combine_chunks()
    values = table.column("values")
    matrix = to_matrix(values.combine_chunks() if values.num_chunks != 1 else values.chunk(0))
    return [matrix, *[table.column(c).to_numpy().copy() for c in (id_column, *others)]]


def member_cells(queries: DataFrame, n_members: int) -> int:
    return max(1, -(-n_members * series_bytes(queries) // CELL_BYTES))


def scan_within(members: DataFrame, limited: DataFrame, k: int, leaves: Broadcast, n_queries: int, n_members: int) -> DataFrame:
    """(query_id, leaf_id, series_id, dist2): among others the k nearest members of every query. ``limited``
    has (query_id, values, kth): k members are known within ``kth``, or it is NULL."""
    ship_package(members.sparkSession)
    asked = limited.select("query_id", "values", F.col("kth").cast("double").alias("kth"))
    members = members.select("series_id", "leaf_id", "values")
    table = pinned_table(asked, ["query_id", "values", "kth"], series_bytes(asked) + 8)
    if table is not None:
        return _shipped(members, table, k, leaves)
    return _cells(members, asked, k, leaves, n_queries, n_members)


def _shipped(members: DataFrame, table: pa.Table, k: int, leaves: Broadcast) -> DataFrame:
    shared = share(members.sparkSession, _arrays(table, "query_id", "kth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, query_ids, kth = shared.value
        best, held, n = _Within(q, kth.astype(float), k), [], 0

        def flush() -> None:
            x, ids, leaf = _arrays(pa.Table.from_batches(held), "series_id", "leaf_id")
            for a in range(0, len(x), _BUFFER):
                best.visit(leaves.value, x[a : a + _BUFFER], leaf[a : a + _BUFFER], ids[a : a + _BUFFER])
            held.clear()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= _BUFFER:
                flush()
                n = 0
        if held:
            flush()
        yield from best.rows(query_ids).to_batches(max_chunksize=1 << 16)

    return members.mapInArrow(run, SCAN_SCHEMA)


def _cells(members: DataFrame, asked: DataFrame, k: int, leaves: Broadcast, n_queries: int, n_members: int) -> DataFrame:
    down, across = member_cells(asked, n_queries), member_cells(asked, n_members)

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    q = asked.withColumn("_down", F.pmod(F.xxhash64("query_id"), F.lit(down)).cast("int")).withColumn("_across", every(across))
    # A leaf stays together unless it is large: its members are drawn from a run of neighbouring cells.
    own = F.xxhash64("leaf_id") + F.pmod(F.xxhash64("series_id"), F.ceil(F.col("_n") * series_bytes(asked) / F.lit(CELL_BYTES)))
    sizes = members.groupBy("leaf_id").agg(F.count("*").alias("_n"))
    m = members.join(sizes, "leaf_id").withColumn("_across", F.pmod(own, F.lit(across)).cast("int")).withColumn("_down", every(down)).drop("_n")
    keys = ["_down", "_across"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return ARROW_SCHEMA.empty_table()
        q, query_ids, kth = _arrays(left, "query_id", "kth")
        x, ids, leaf = _arrays(right, "series_id", "leaf_id")
        order = np.argsort(leaf, kind="stable")
        best = _Within(q, kth.astype(float), k)
        for a in range(0, len(x), _BUFFER):
            at = order[a : a + _BUFFER]
            best.visit(leaves.value, x[at], leaf[at], ids[at])
        return best.rows(query_ids)

    return q.groupBy(*keys).cogroup(m.groupBy(*keys)).applyInArrow(run, SCAN_SCHEMA)
