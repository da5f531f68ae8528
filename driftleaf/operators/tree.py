"""The split tree: scoring of candidate splits, growth, routing and envelopes.

The tree is a table with one row a node, and ``parent_id`` links it. Its top is grown level by level
over all series and shipped; below a node that is small enough for one task the tree grows inside
the task that holds the node's series (``grow_subtree``), so the driver holds the top alone and a
path may have any length. Ids are sequential: 1, 2, ... in the top, and in the subtree of top node s
from ``s << NODE_BITS``. Tasks route whole batches with array lookups and reduce their rows to
minima and maxima before anything is shuffled.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftleaf.functions.series import segmentation
from driftleaf.operators.scan import to_matrix
from driftleaf.session import pin, share
from driftleaf.settings import IndexOptions

Segment = tuple[int, int]
ROOT = 1
NODE_BITS = 24
LEAST_SCORE = 1e-12
# Pairs of a row and a node whose bounds a task takes at once; each has a term a segment.
_MET = 1 << 15

SEGMENT_SCHEMA = (
    "struct<off:int,len:int,min_mean:double,max_mean:double,min_std:double,max_std:double>"
)
NODE_SCHEMA = (
    "node_id long, parent_id long, depth int, is_leaf boolean, n long, off int, len int, "
    "stat string, breakpoints array<double>, vertical boolean, first_child long, "
    f"seg array<{SEGMENT_SCHEMA}>"
)
_SEGMENT_FIELDS = ("off", "len", "min_mean", "max_mean", "min_std", "max_std")

STATS_SCHEMA = (
    "node_id long, ord int, off int, len int, vertical boolean, n long, "
    "min_mean double, max_mean double, min_std double, max_std double"
)
_STATS_ARROW = pa.schema(
    [
        ("node_id", pa.int64()),
        ("ord", pa.int32()),
        ("off", pa.int32()),
        ("len", pa.int32()),
        ("vertical", pa.bool_()),
        ("n", pa.int64()),
        ("min_mean", pa.float64()),
        ("max_mean", pa.float64()),
        ("min_std", pa.float64()),
        ("max_std", pa.float64()),
    ]
)


def summaries(x: np.ndarray, segments: list[Segment]) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations of every row for every segment."""
    means = np.empty((len(x), len(segments)))
    stds = np.empty_like(means)
    for i, (off, n) in enumerate(segments):
        part = x[:, off : off + n]
        means[:, i] = part.mean(axis=1)
        stds[:, i] = np.sqrt(np.mean((part - means[:, i : i + 1]) ** 2, axis=1))
    return means, stds


@dataclass
class Split:
    off: int
    len: int
    stat: str
    breakpoints: list[float]
    vertical: bool


def child_segments(parent: list[Segment], split: Split, n_subsegments: int) -> list[Segment]:
    child = []
    for off, n in parent:
        if split.vertical and off <= split.off < off + n:
            child += [(off + o, m) for o, m in segmentation(n, n_subsegments)]
        else:
            child.append((off, n))
    return child


def regions(segments: list[Segment], n_subsegments: int) -> list[tuple[int, int, int, bool]]:
    """(order, off, len, vertical) of every segment and of its parts long enough to split."""
    out, order = [], 0
    for off, n in segments:
        out.append((order, off, n, False))
        for i, (o, m) in enumerate(segmentation(n, n_subsegments)):
            if m >= 2 * n_subsegments:
                out.append((order + 1 + i, off + o, m, True))
        order += 1 + n_subsegments
    return out


@dataclass
class Tree:
    """The top of a tree while it grows; children of a node have consecutive ids."""

    length: int
    n_children: int = 2
    n_subsegments: int = 2
    segments: dict[int, list[Segment]] = field(default_factory=dict)
    splits: dict[int, Split] = field(default_factory=dict)
    first_child: dict[int, int] = field(default_factory=dict)
    parent: dict[int, int | None] = field(default_factory=dict)
    depth: dict[int, int] = field(default_factory=dict)
    facts: dict[int, tuple[int, list]] = field(default_factory=dict)  # n and envelope
    next_id: int = ROOT + 1

    @staticmethod
    def root(length: int, options: IndexOptions) -> Tree:
        tree = Tree(length, options.n_children, options.n_subsegments)
        tree.segments[ROOT] = [(0, length)]
        tree.parent[ROOT], tree.depth[ROOT] = None, 0
        return tree

    def leaves(self) -> list[int]:
        return [node for node in self.segments if node not in self.splits]

    def add_split(self, node: int, split: Split) -> list[int]:
        if self.next_id + self.n_children >= 1 << NODE_BITS:
            raise ValueError("the top of the tree has too many nodes; let subtrees be larger")
        self.splits[node], self.first_child[node] = split, self.next_id
        children = list(range(self.next_id, self.next_id + self.n_children))
        self.next_id += self.n_children
        for child in children:
            self.segments[child] = child_segments(self.segments[node], split, self.n_subsegments)
            self.parent[child], self.depth[child] = node, self.depth[node] + 1
        return children

    def regions(self, node: int) -> list[tuple[int, int, int, bool]]:
        return regions(self.segments[node], self.n_subsegments)

    def row(self, node: int) -> tuple:
        """The node as a row of ``NODE_SCHEMA``."""
        n, seg = self.facts.get(node, (0, no_members(self.segments[node])))
        return node_row(node, self.parent[node], self.depth[node], n, seg, self.splits.get(node),
                        self.first_child.get(node))

    def compile(self) -> Router:
        nodes = sorted(self.segments)
        empty = Split(0, 0, "", [np.inf] * (self.n_children - 1), False)
        splits = [self.splits.get(node, empty) for node in nodes]
        return Router(
            np.array(nodes, np.int64),
            np.array([self.first_child.get(node, -1) for node in nodes], np.int64),
            [(s.off, s.len) for s in splits],
            np.array([s.stat == "STD" for s in splits]),
            np.array([s.breakpoints for s in splits], float).reshape(len(nodes), -1),
        )


def no_members(segments: list[Segment]) -> list[tuple]:
    """The envelope of a node without members, which no series is near."""
    inf = float("inf")
    return [(off, n, inf, -inf, inf, -inf) for off, n in segments]


def node_row(
    node: int, parent: int | None, depth: int, n: int, seg: list, split: Split | None,
    first_child: int | None,
) -> tuple:
    s = split or Split(0, 0, None, None, None)
    return (node, parent, depth, split is None, n, s.off, s.len, s.stat, s.breakpoints, s.vertical,
            first_child, seg)


class Router:
    """Nodes as arrays, for routing a whole batch level by level. A node whose children are not among
    them ends a path."""

    def __init__(
        self, ids: np.ndarray, first_child: np.ndarray, split_at: list[Segment],
        is_std: np.ndarray, breakpoints: np.ndarray,
    ) -> None:
        self.node_ids = ids
        self.fan = breakpoints.shape[1] + 1
        at = np.minimum(np.searchsorted(ids, first_child), len(ids) - 1)
        inner = (first_child >= 0) & (ids[at] == first_child)
        self.first_at = np.where(inner, at, -1)
        self.segments = sorted({seg for seg, has in zip(split_at, inner) if has})
        slot = {seg: i for i, seg in enumerate(self.segments)}
        self.slot = np.array([slot[s] if has else -1 for s, has in zip(split_at, inner)], np.int64)
        self.is_std = is_std
        self.breakpoints = breakpoints

    def route(self, x: np.ndarray) -> np.ndarray:
        """Index into ``node_ids`` of the end of every row's path."""
        at = np.zeros(len(x), dtype=np.int64)
        if not self.segments:
            return at
        means, stds = summaries(x, self.segments)
        live = np.arange(len(x))
        while True:
            live = live[self.slot[at[live]] >= 0]
            if not len(live):
                return at
            node = at[live]
            slot = self.slot[node]
            value = np.where(self.is_std[node], stds[live, slot], means[live, slot])
            child = (value[:, None] >= self.breakpoints[node]).sum(axis=1)
            at[live] = self.first_at[node] + child


class Nodes:
    """Rows of a node table as arrays: routing, descent by bounds, and statistics along paths. The
    rows hold one topmost node and all nodes between it and where they end."""

    def __init__(self, table: pa.Table, fan: int) -> None:
        table = table.sort_by("node_id").combine_chunks()
        ids = table.column("node_id").to_numpy().astype(np.int64)
        first = table.column("first_child").fill_null(-1).to_numpy().astype(np.int64)
        off, length = (table.column(c).to_numpy().tolist() for c in ("off", "len"))
        points = np.full((len(ids), fan - 1), np.inf)
        for i, row in enumerate(table.column("breakpoints").to_pylist()):
            if row:
                points[i] = row
        stat = np.array([s == "STD" for s in table.column("stat").to_pylist()], bool)
        self.router = Router(ids, first, list(zip(off, length)), stat, points)
        self.node_ids, self.fan = ids, fan
        self.is_leaf = table.column("is_leaf").to_numpy(zero_copy_only=False).astype(bool)
        parent = table.column("parent_id").fill_null(-1).to_numpy().astype(np.int64)
        at = np.minimum(np.searchsorted(ids, parent), len(ids) - 1)
        self.parent_at = np.where(ids[at] == parent, at, -1)
        self.top = int(np.flatnonzero(self.parent_at < 0)[0])
        if self.top:
            raise ValueError("the topmost node has to have the smallest id")
        seg = table.column("seg").combine_chunks()
        seg = seg.combine_chunks() if isinstance(seg, pa.ChunkedArray) else seg
        width = pa.compute.list_value_length(seg).to_numpy(zero_copy_only=False)
        self.width = np.nan_to_num(width.astype(float)).astype(np.int64)
        self.start = np.cumsum(self.width) - self.width
        flat = seg.flatten()
        self.part = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in _SEGMENT_FIELDS}
        keys = list(zip(self.part["off"].tolist(), self.part["len"].tolist()))
        self.segments = sorted(set(keys))
        slot = {key: i for i, key in enumerate(self.segments)}
        self.slot = np.array([slot[key] for key in keys], np.int64)

    def route(self, x: np.ndarray) -> np.ndarray:
        return self.router.route(x)

    def _entries(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``node``, segment entry) of all segments of the given nodes."""
        width = self.width[node]
        row = np.repeat(np.arange(len(node)), width)
        step = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)
        return row, self.start[node][row] + step

    def bounds(self, means: np.ndarray, stds: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Lower bound of each (row, node)."""
        out = np.empty(len(node))
        p = self.part
        for lo in range(0, len(node), _MET):
            at = node[lo : lo + _MET]
            pos, entry = self._entries(at)
            of = row[lo : lo + _MET][pos]
            m, s = means[of, self.slot[entry]], stds[of, self.slot[entry]]
            dm = np.maximum(np.maximum(p["min_mean"][entry] - m, m - p["max_mean"][entry]), 0.0)
            ds = np.maximum(np.maximum(p["min_std"][entry] - s, s - p["max_std"][entry]), 0.0)
            total = np.bincount(pos, p["len"][entry] * (dm * dm + ds * ds), len(at))
            out[lo : lo + _MET] = np.sqrt(total)
        return out

    def descend(self, x: np.ndarray, cap: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, node index, bound) where paths end and no node above has a bound over the row's
        ``cap``, and how many nodes were met by each row. A level at a time; the children of a
        node are met only if the node's own bound does not exceed the cap."""
        means, stds = summaries(x, self.segments)
        row, node = np.arange(len(x)), np.full(len(x), self.top)
        met = np.zeros(len(x), np.int64)
        found = []
        while len(row):
            met += np.bincount(row, minlength=len(x))
            lb = self.bounds(means, stds, row, node)
            near = lb <= cap[row]
            row, node, lb = row[near], node[near], lb[near]
            first = self.router.first_at[node]
            ends = first < 0
            found.append((row[ends], node[ends], lb[ends]))
            row, first = row[~ends], first[~ends]
            node = (first[:, None] + np.arange(self.fan)).ravel()
            row = np.repeat(row, self.fan)
        parts = zip(*found) if found else ((np.zeros(0, np.int64),) * 2 + (np.zeros(0),))
        return (*[np.concatenate(p) if found else p for p in parts], met)

    def path_stats(self, x: np.ndarray, ends: bool = True) -> Iterator[pa.RecordBatch]:
        """Minima and maxima of the rows, for every node on their paths and each of its segments;
        without ``ends`` only the nodes above those that continue elsewhere."""
        means, stds = summaries(x, self.segments)
        at, live = self.route(x), np.arange(len(x))
        if not ends:
            at = np.where(self.is_leaf[at], at, self.parent_at[at])
        while True:
            live = live[at[live] >= 0]
            if not len(live):
                return
            order = live[np.argsort(at[live], kind="stable")]
            node = at[order]
            cuts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            node, count = node[cuts], np.diff(np.r_[cuts, len(order)])
            low_m, high_m = (f.reduceat(means[order], cuts) for f in (np.minimum, np.maximum))
            low_s, high_s = (f.reduceat(stds[order], cuts) for f in (np.minimum, np.maximum))
            pos, entry = self._entries(node)
            slot = self.slot[entry]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(self.node_ids[node][pos]),
                    pa.array(self.part["off"][entry].astype(np.int32)),
                    pa.array(self.part["len"][entry].astype(np.int32)),
                    pa.array(count[pos].astype(np.int64)),
                    pa.array(low_m[pos, slot]), pa.array(high_m[pos, slot]),
                    pa.array(low_s[pos, slot]), pa.array(high_s[pos, slot]),
                ],
                names=["node_id", "off", "len", "n", "min_mean", "max_mean", "min_std", "max_std"],
            )
            at[live] = self.parent_at[at[live]]


def node_stats(data: DataFrame, tree: Tree, nodes: list[int], vertical: bool = True) -> DataFrame:
    """Minima and maxima of segment means and deviations, per node and region, over the rows that
    route to ``nodes``. Tasks reduce their own rows first, so a node that holds most of the data
    costs no more than any other."""
    router = tree.compile()
    distinct: dict[Segment, int] = {}
    at_of = {node: i for i, node in enumerate(router.node_ids.tolist())}
    regions: dict[int, list[tuple[int, int, int, bool]]] = {}
    for node in nodes:
        kept = [r for r in tree.regions(node) if vertical or not r[3]]
        regions[at_of[node]] = kept
        for _, off, n, _ in kept:
            distinct.setdefault((off, n), len(distinct))
    starts = np.zeros(len(router.node_ids) + 1, dtype=np.int64)
    for i, kept in regions.items():
        starts[i + 1] = len(kept)
    starts = np.cumsum(starts)
    flat = [r for i in sorted(regions) for r in regions[i]]
    flat_ord = np.array([r[0] for r in flat], dtype=np.int32)
    flat_off = np.array([r[1] for r in flat], dtype=np.int32)
    flat_len = np.array([r[2] for r in flat], dtype=np.int32)
    flat_vertical = np.array([r[3] for r in flat], dtype=bool)
    flat_slot = np.array([distinct[(r[1], r[2])] for r in flat], dtype=np.int64)
    plan = share(
        data.sparkSession,
        (router, list(distinct), starts, flat_ord, flat_off, flat_len, flat_vertical, flat_slot),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        route, segs, first, r_ord, r_off, r_len, r_vertical, r_slot = plan.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = to_matrix(batch.column("values"))
            at = route.route(x)
            mine = np.flatnonzero(first[at + 1] > first[at])
            if not len(mine):
                continue
            mine = mine[np.argsort(at[mine], kind="stable")]
            at = at[mine]
            means, stds = summaries(x[mine], segs)
            cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            node = at[cuts]
            count = np.diff(np.r_[cuts, len(at)])
            low_m, high_m = np.minimum.reduceat(means, cuts), np.maximum.reduceat(means, cuts)
            low_s, high_s = np.minimum.reduceat(stds, cuts), np.maximum.reduceat(stds, cuts)
            width = first[node + 1] - first[node]
            row = np.repeat(np.arange(len(node)), width)
            step = np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)
            pos = first[node][row] + step
            slot = r_slot[pos]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(route.node_ids[node][row]),
                    pa.array(r_ord[pos]),
                    pa.array(r_off[pos]),
                    pa.array(r_len[pos]),
                    pa.array(r_vertical[pos]),
                    pa.array(count[row].astype(np.int64)),
                    pa.array(low_m[row, slot]),
                    pa.array(high_m[row, slot]),
                    pa.array(low_s[row, slot]),
                    pa.array(high_s[row, slot]),
                ],
                schema=_STATS_ARROW,
            )

    return (
        data.select("values")
        .mapInArrow(run, STATS_SCHEMA)
        .groupBy("node_id", "ord", "off", "len", "vertical")
        .agg(
            F.sum("n").alias("n"),
            F.min("min_mean").alias("min_mean"),
            F.max("max_mean").alias("max_mean"),
            F.min("min_std").alias("min_std"),
            F.max("max_std").alias("max_std"),
        )
    )


def split_scores(stats: DataFrame, n_children: int = 2, vertical_factor: float = 2.0) -> DataFrame:
    """Two scored candidates, MEAN and STD, per node and region. The score is the range that a
    split saves; a split that also cuts the segment must save ``vertical_factor`` times more."""
    width = F.col("max_mean") - F.col("min_mean")
    spread = F.col("max_std")
    step = (F.col("max_std") - F.col("min_std")) / n_children
    mean_gain = F.col("len") * width * width * (1.0 - 1.0 / (n_children * n_children))
    kept = [(spread - i * step) * (spread - i * step) for i in range(n_children)]
    std_gain = F.col("len") * (spread * spread - sum(kept[1:], kept[0]) / n_children)
    candidates = F.array(
        F.struct(
            F.lit("MEAN").alias("stat"),
            (F.col("ord") * 2).alias("seq"),
            mean_gain.alias("gain"),
            F.col("min_mean").alias("low"),
            (width / n_children).alias("step"),
        ),
        F.struct(
            F.lit("STD").alias("stat"),
            (F.col("ord") * 2 + 1).alias("seq"),
            std_gain.alias("gain"),
            F.col("min_std").alias("low"),
            step.alias("step"),
        ),
    )
    divisor = F.when(F.col("vertical"), F.lit(vertical_factor)).otherwise(F.lit(1.0))
    return (
        stats.withColumn("c", F.explode(candidates))
        .select("node_id", "n", "off", "len", "vertical", "c.*")
        .withColumn("score", F.col("gain") / divisor)
    )


def best_splits(scores: DataFrame, n_children: int = 2) -> DataFrame:
    """The best candidate per node; among equals the first in region order."""
    points = F.transform(
        F.sequence(F.lit(1), F.lit(n_children - 1)), lambda i: F.col("b.low") + F.col("b.step") * i
    )
    return (
        scores.groupBy("node_id", "n")
        .agg(
            F.max_by(
                F.struct("off", "len", "vertical", "stat", "low", "step", "score"),
                F.struct(F.col("score"), -F.col("seq")),
            ).alias("b")
        )
        .select(
            "node_id",
            "n",
            "b.off",
            "b.len",
            "b.vertical",
            "b.stat",
            "b.score",
            points.alias("breakpoints"),
        )
    )


def child_of(value, breakpoints):
    """Child number of a statistic: how many breakpoints it has reached."""
    return F.size(F.filter(breakpoints, lambda b: b <= value))


def depth_of(node: Column, n_children: int) -> Column:
    """Level of a heap id, in whole numbers."""
    powers, p = [], n_children
    while p < 1 << 62:
        powers.append(F.lit(p).cast("long"))
        p *= n_children
    return F.size(F.filter(F.array(*powers), lambda x: x <= node))


def grow(data: DataFrame, tree: Tree, limit: float, options: IndexOptions) -> None:
    """Split leaves of ``tree`` above ``limit`` rows on the statistics of ``data``, one job per
    level, until none is left. Leaves whose members cannot be told apart stay as they are."""
    open_nodes = tree.leaves()
    while open_nodes:
        stats = pin(node_stats(data, tree, open_nodes), "node-stats", 128)
        scores = split_scores(stats, options.n_children, options.vertical_factor)
        best = best_splits(scores, options.n_children).drop("n")
        level = pack_envelopes(stats.where(~F.col("vertical")).withColumnRenamed("node_id", "leaf_id"))
        # One row for each node of a level of the top.
        rows = level.join(best, level["leaf_id"] == best["node_id"]).collect()
        open_nodes = []
        for row in sorted(rows, key=lambda r: r["node_id"]):
            node = row["node_id"]
            tree.facts[node] = (row["n"], [tuple(s) for s in row["seg"]])
            if row["n"] > limit and row["score"] > LEAST_SCORE:
                points = list(row["breakpoints"])
                split = Split(row["off"], row["len"], row["stat"], points, row["vertical"])
                open_nodes += tree.add_split(node, split)


def _best_split(
    n_children: int, factor: float, parts: list[tuple[int, int, int, bool]],
    low_m: np.ndarray, high_m: np.ndarray, low_s: np.ndarray, high_s: np.ndarray,
) -> tuple[float, int, Split | None]:
    """Score, region and split of the best candidate; among equals the first in region order."""
    top: tuple[float, int, Split | None] = (-1.0, 0, None)
    for i, (_, off, n, vertical) in enumerate(parts):
        width, spread = high_m[i] - low_m[i], high_s[i]
        step = (high_s[i] - low_s[i]) / n_children
        mean_gain = n * width * width * (1.0 - 1.0 / (n_children * n_children))
        kept = sum((spread - j * step) * (spread - j * step) for j in range(n_children))
        std_gain = n * (spread * spread - kept / n_children)
        for stat, gain, low, by in (
            ("MEAN", mean_gain, low_m[i], width / n_children), ("STD", std_gain, low_s[i], step)
        ):
            score = gain / factor if vertical else gain
            if score > top[0]:
                points = [float(low + by * j) for j in range(1, n_children)]
                top = (float(score), i, Split(off, n, stat, points, vertical))
    return top


def grow_subtree(
    x: np.ndarray, root: int, parent: int | None, depth: int, segments: list[Segment],
    options: IndexOptions,
) -> tuple[np.ndarray, list[tuple]]:
    """The leaf of every row of ``x`` and the rows of the node table below and with ``root``, whose
    members are the rows of ``x``. No path is too long: nodes wait in a queue."""
    leaf = np.full(len(x), root, np.int64)
    nodes: list[tuple] = []
    next_id = root << NODE_BITS
    waiting = deque([(root, parent, depth, segments, np.arange(len(x)))])
    while waiting:
        node, above, level, segs, rows = waiting.popleft()
        if not len(rows):
            nodes.append(node_row(node, above, level, 0, no_members(segs), None, None))
            continue
        parts = regions(segs, options.n_subsegments)
        means, stds = summaries(x[rows], [(off, n) for _, off, n, _ in parts])
        low_m, high_m, low_s, high_s = means.min(0), means.max(0), stds.min(0), stds.max(0)
        seg = sorted(
            (off, n, float(low_m[i]), float(high_m[i]), float(low_s[i]), float(high_s[i]))
            for i, (_, off, n, vertical) in enumerate(parts)
            if not vertical
        )
        score, at, split = 0.0, 0, None
        if len(rows) > options.leaf_size:
            score, at, split = _best_split(
                options.n_children, options.vertical_factor, parts, low_m, high_m, low_s, high_s
            )
        if split is None or score <= LEAST_SCORE:
            leaf[rows] = node
            nodes.append(node_row(node, above, level, len(rows), seg, None, None))
            continue
        value = (stds if split.stat == "STD" else means)[:, at]
        child = (value[:, None] >= np.array(split.breakpoints)).sum(axis=1)
        nodes.append(node_row(node, above, level, len(rows), seg, split, next_id))
        below = child_segments(segs, split, options.n_subsegments)
        for i in range(options.n_children):
            waiting.append((next_id + i, node, level + 1, below, rows[child == i]))
        next_id += options.n_children
    return leaf, nodes


def pack_envelopes(stats: DataFrame) -> DataFrame:
    entry = F.struct("off", "len", "min_mean", "max_mean", "min_std", "max_std")
    return stats.groupBy("leaf_id").agg(
        F.max("n").alias("n"), F.sort_array(F.collect_list(entry)).alias("seg")
    )
