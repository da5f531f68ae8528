"""Index build, save, load and append. An index is a set of Parquet tables under one manifest (see
``versions``): ``member``, ``tree`` (one row a node) or ``leaf``, ``meta``, and any tables that are
saved with it, such as filters and their margins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftleaf.functions.series import segmentation
from driftleaf.operators.bounds import ship_leaves
from driftleaf.operators.leaves import cluster_by_leaf, key_envelopes
from driftleaf.operators.scan import to_matrix
from driftleaf.operators.tree import (
    NODE_BITS,
    NODE_SCHEMA,
    ROOT,
    Nodes,
    Tree,
    grow,
    grow_subtree,
    pack_envelopes,
)
from driftleaf.plans import versions
from driftleaf.session import materialise, new_work_path, share, ship_package
from driftleaf.settings import BLOCK_ROWS, IndexOptions, broadcast_budget

# A task grows a subtree of at most this many bytes of doubles; the top has about so many ends.
SUBTREE_BYTES = 64 << 20
LEAST_SUBTREE_ROWS = 20_000
TOP_ENDS = 1 << 18
NODE_BYTES = 256
STAT_SCHEMA = (
    "node_id long, off int, len int, n long, min_mean double, max_mean double, "
    "min_std double, max_std double"
)


@dataclass
class Index:
    """``members``: (series_id, leaf_id, part, values, [sketch]); ``leaf``: (leaf_id, depth, n,
    parts, seg); ``nodes``: the split tree, None for an index over a given key. ``route_column``
    names the array that was summarised; a sketch gives bounds on sketch distances only, so it
    serves the approximate modes alone. ``tables``: what is saved with the index. Without ``ship``
    the tree is taken for too large to be broadcast."""

    members: DataFrame
    leaf: DataFrame
    nodes: DataFrame | None
    options: IndexOptions
    path: str | None = None
    route_column: str = "values"
    clustered: bool = True
    tables: dict[str, DataFrame] = field(default_factory=dict)
    ship: bool = True

    def clustered_members(self) -> DataFrame:
        """Members with the rows of a leaf next to each other, for scans that reduce by leaf."""
        return self.members if self.clustered else cluster_by_leaf(self.members)

    @cached_property
    def shipped_leaves(self) -> Broadcast | None:
        """Envelopes broadcast once for all searches on this index; None if they are too large."""
        return ship_leaves(self.leaf)

    @cached_property
    def shipped_nodes(self) -> Broadcast | None:
        """The whole tree broadcast once; None if it is too large."""
        if self.nodes is None or not self.ship:
            return None
        cap = broadcast_budget(self.nodes.sparkSession) // NODE_BYTES
        table = self.nodes.limit(cap + 1).toArrow()
        if table.num_rows > cap or table.nbytes > cap * NODE_BYTES:
            return None
        return share(self.nodes.sparkSession, Nodes(table, self.options.n_children))

    @cached_property
    def shipped_top(self) -> Broadcast:
        """The top of the tree, whose size is bounded when it grows."""
        top = self.nodes.where(F.col("node_id") < 1 << NODE_BITS).toArrow()
        return share(self.nodes.sparkSession, Nodes(top, self.options.n_children))

    @property
    def exact_bounds(self) -> bool:
        return self.route_column == "values"

    def route(self, rows: DataFrame, column: str | None = None) -> DataFrame:
        """Add ``leaf_id``. A tree that fits the budget is shipped and routing is a narrow map.
        Otherwise the top is shipped, and rows meet the subtree they fall into."""
        self._routable()
        column = column or self.route_column
        rows = rows.drop("leaf_id")
        schema = _with_field(rows.schema, "leaf_id", T.LongType())

        def leaves(nodes: Nodes, batch: pa.Table | pa.RecordBatch) -> pa.Table | pa.RecordBatch:
            at = nodes.route(to_matrix(_one(batch.column(column)))) if batch.num_rows else []
            return batch.append_column("leaf_id", pa.array(nodes.node_ids[at], pa.int64()))

        if self.shipped_nodes is not None:
            return rows.mapInArrow(_mapped(self.shipped_nodes, leaves), schema)
        top = materialise(rows.mapInArrow(_mapped(self.shipped_top, leaves), schema), "routed")
        done = top.join(self._subtrees().select("subtree").distinct(), top["leaf_id"] == F.col("subtree"), "left_anti")
        below = self._in_subtrees(top, lambda nodes, table: leaves(nodes, table.drop_columns(["leaf_id"])), schema)
        return done.unionByName(below)

    def _routable(self) -> None:
        if self.nodes is None:
            raise ValueError("an index over a given leaf key cannot route queries")

    def _subtrees(self) -> DataFrame:
        """Nodes by ``subtree``, the id of the subtree's topmost node, which is among them."""
        inner, root = F.col("node_id") >= 1 << NODE_BITS, F.col("first_child") >= 1 << NODE_BITS
        number = F.when(inner, F.shiftright("node_id", NODE_BITS)).when(root, F.col("node_id"))
        return self.nodes.withColumn("subtree", number).where(F.col("subtree").isNotNull())

    def _in_subtrees(
        self, routed: DataFrame, work: Callable[[Nodes, pa.Table], pa.Table], schema: T.StructType | str
    ) -> DataFrame:
        """Apply ``work`` to the rows whose ``leaf_id`` is a subtree, together with its nodes; a subtree
        that many rows fall into meets them in several groups."""
        ship_package(routed.sparkSession)
        fan = self.options.n_children
        trees = self._subtrees()
        groups = routed.groupBy(F.col("leaf_id").alias("subtree")).agg(
            F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("groups")
        )
        groups = materialise(groups.join(trees.select("subtree").distinct(), "subtree"), "groups")
        many = groups.select(F.col("subtree").alias("of"), F.col("groups").alias("salts"))
        rows = routed.join(many, F.col("leaf_id") == F.col("of")).select(
            *routed.columns, F.col("of").alias("subtree"), F.pmod(F.xxhash64("leaf_id", *_hashable(routed)), "salts").cast("int").alias("_salt")
        )
        copies = trees.join(groups, "subtree").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        copies = copies.drop("groups")
        extra = ["subtree", "_salt"]

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return work(Nodes(right.drop_columns(extra), fan), left.drop_columns(extra))

        keys = ["subtree", "_salt"]
        return rows.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(run, schema)

    def path_stats(self, rows: DataFrame) -> DataFrame:
        """(node_id, off, len, n, min_mean, ...) of the given rows for every node on their paths."""
        self._routable()
        column = self.route_column
        rows = rows.select(F.col(column).alias("values"))

        def stats(nodes: Nodes, batch: pa.Table, ends: bool = True) -> pa.Table:
            found = list(nodes.path_stats(to_matrix(_one(batch.column("values"))), ends)) if batch.num_rows else []
            return pa.Table.from_batches(found) if found else pa.table({})

        def run(shared: Broadcast, ends: bool) -> Callable:
            def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield from stats(shared.value, batch, ends).to_batches()

            return work

        if self.shipped_nodes is not None:
            out = rows.mapInArrow(run(self.shipped_nodes, True), STAT_SCHEMA)
        else:
            above = rows.mapInArrow(run(self.shipped_top, False), STAT_SCHEMA)
            top = _mapped(self.shipped_top, lambda nodes, batch: batch.append_column(
                "leaf_id", pa.array(nodes.node_ids[nodes.route(to_matrix(batch.column("values")))])
            ) if batch.num_rows else batch.append_column("leaf_id", pa.array([], pa.int64())))
            routed = materialise(rows.mapInArrow(top, _with_field(rows.schema, "leaf_id", T.LongType())), "routed")
            out = above.unionByName(self._in_subtrees(routed, stats, STAT_SCHEMA))
        return out.groupBy("node_id", "off", "len").agg(
            F.sum("n").alias("n"),
            F.min("min_mean").alias("min_mean"),
            F.max("max_mean").alias("max_mean"),
            F.min("min_std").alias("min_std"),
            F.max("max_std").alias("max_std"),
        )

    def resident(self, queries: DataFrame) -> DataFrame:
        """(query_id, leaf_id) of the leaf that each query falls into."""
        return self.route(queries).select("query_id", "leaf_id")


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]


def _one(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if not isinstance(column, pa.ChunkedArray):
        return column
    whole = column.combine_chunks()
    return pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole


def _with_field(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != name] + [T.StructField(name, kind)])


def _mapped(shared: Broadcast, work: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield work(shared.value, batch)

    return run


def _series_length(data: DataFrame, column: str) -> int:
    head = data.select(F.size(column)).first()
    if head is None:
        raise ValueError("no series to index")
    return head[0]


def subtree_limit(total: int, length: int, tasks: int, options: IndexOptions) -> int:
    """Members of a subtree that one task grows: bounded by bytes, enough of them for all tasks, and
    few enough for the top to stay small."""
    if options.subtree_rows is not None:
        return max(options.leaf_size, options.subtree_rows)
    by_task = max(LEAST_SUBTREE_ROWS, -(-total // (4 * tasks)))
    by_bytes = max(1, SUBTREE_BYTES // (8 * length))
    return max(options.leaf_size, min(by_bytes, by_task), -(-total // TOP_ENDS))


def build_index(
    series: DataFrame,
    options: IndexOptions = IndexOptions(),
    path: str | None = None,
    route_column: str = "values",
) -> Index:
    """Build over (series_id, values, [sketch]).

    The top of the tree grows on all series, one job a level that reduces in the tasks, until every
    node fits a task. One shuffle brings the series of a node together; the task grows the subtree and
    writes its members in leaf order with the rows of the tree. A node that stays large (copies cannot be
    split) is a leaf of several parts, which are spread."""
    spark = series.sparkSession
    length, total = _series_length(series, route_column), series.count()
    tree = Tree.root(length, options)
    limit = subtree_limit(total, length, spark.sparkContext.defaultParallelism, options)
    if total > limit:
        grow(materialise(series.select(F.col(route_column).alias("values")), "series"), tree, limit, options)

    path = path or new_work_path(spark, "index")
    part = f"data/grown-{new_work_path(spark, '').rsplit('-', 1)[-1]}"
    grown = _grown(series, tree, limit, options, route_column)
    writer = grown.write.option("maxRecordsPerFile", options.rows_per_file).partitionBy("kind")
    writer.mode("overwrite").parquet(f"{path}/{part}")
    held = [node for node in tree.segments if not _grows(tree, node, limit, options)]
    nodes = spark.createDataFrame([tree.row(node) for node in held], NODE_SCHEMA)
    if len(held) < len(tree.segments):
        below = spark.read.schema(T.StructType([grown.schema["node"]])).parquet(f"{path}/{part}/kind=node")
        nodes = nodes.unionByName(below.select("node.*"))
    nodes = versions.write_part(nodes, path, "tree")
    tables = {"member": [f"{part}/kind=member"], "tree": [nodes], "meta": [_write_meta(spark, options, route_column, path)]}
    versions.commit(spark, path, tables)
    return load_index(spark, path)


def _grows(tree: Tree, node: int, limit: int, options: IndexOptions) -> bool:
    """Whether a task grows the subtree of this end of the top."""
    if node in tree.splits:
        return False
    n = tree.facts[node][0] if node in tree.facts else (limit if node == ROOT else 0)
    return options.leaf_size < n <= limit


def _grown(series: DataFrame, tree: Tree, limit: int, options: IndexOptions, column: str) -> DataFrame:
    """Members (kind 'member') with ``leaf_id`` and ``part``, and the rows of the tree (kind 'node')."""
    spark = series.sparkSession
    series = series.drop("leaf_id", "part")
    ends = {
        node: (tree.segments[node], tree.depth[node], tree.parent[node], _grows(tree, node, limit, options),
               -(-max(1, tree.facts.get(node, (1, []))[0]) // BLOCK_ROWS))
        for node in tree.leaves()
    }
    shared = share(spark, (tree.compile(), ends))
    marked = series.withColumn("_draw", F.xxhash64("series_id"))
    schema = T.StructType(marked.schema.fields + [T.StructField("_top", T.LongType()), T.StructField("_part", T.IntegerType())])

    def to_top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router, known = shared.value
        parts = np.array([known[n][4] if n in known and not known[n][3] else 1 for n in router.node_ids.tolist()])
        for batch in batches:
            at = router.route(to_matrix(batch.column(column))) if batch.num_rows else np.zeros(0, np.int64)
            draw = batch.column("_draw").to_numpy(zero_copy_only=False)
            part = np.mod(draw, parts[at]).astype(np.int32)
            yield batch.append_column("_top", pa.array(router.node_ids[at])).append_column("_part", pa.array(part))

    own = [T.StructField(f.name, f.dataType) for f in series.schema.fields]
    node_type = T.StructType.fromDDL(NODE_SCHEMA)
    out = T.StructType(own + [
        T.StructField("leaf_id", T.LongType()), T.StructField("part", T.IntegerType()),
        T.StructField("node", node_type), T.StructField("kind", T.StringType()),
    ])
    names = [f.name for f in node_type.fields]

    def grow_group(table: pa.Table) -> pa.Table:
        root = table.column("_top")[0].as_py()
        segments, depth, parent, grows, _ = shared.value[1][root]
        n = table.num_rows
        leaf, part, rows = np.full(n, root), table.column("_part").to_numpy(), []
        if grows:
            leaf, rows = grow_subtree(to_matrix(_one(table.column(column))), root, parent, depth, segments, options)
            _, which, sizes = np.unique(leaf, return_inverse=True, return_counts=True)
            part = np.mod(table.column("_draw").to_numpy(), -(-sizes[which] // BLOCK_ROWS)).astype(np.int32)
        table = table.drop_columns(["_draw", "_top", "_part"])
        order = np.lexsort((table.column("series_id").to_numpy(), part, leaf))
        kind = pa.array(["member"] * n, pa.string())
        members = table.append_column("leaf_id", pa.array(leaf)).append_column("part", pa.array(part)).append_column("kind", kind)
        members = members.take(pa.array(order))
        if not rows:
            return _filled(members, arrow)
        struct = pa.array([dict(zip(names, row)) for row in rows], arrow.field("node").type)
        kind = pa.array(["node"] * len(rows), pa.string())
        return pa.concat_tables([_filled(members, arrow), _filled(pa.table({"node": struct, "kind": kind}), arrow)])

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)
    return marked.mapInArrow(to_top, schema).groupBy("_top", "_part").applyInArrow(grow_group, out)


def _filled(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """The columns of ``schema``; those that ``table`` lacks are null."""
    columns = [
        table.column(f.name).cast(f.type) if f.name in table.column_names else pa.nulls(table.num_rows, f.type)
        for f in schema
    ]
    return pa.table(columns, schema=schema)


def _parts(n: Column) -> Column:
    return F.ceil(n / F.lit(BLOCK_ROWS)).cast("int")


def _write_meta(spark: SparkSession, options: IndexOptions, route_column: str, path: str) -> str:
    meta = spark.createDataFrame(
        [(options.n_children, options.n_subsegments, options.leaf_size, options.vertical_factor,
          options.rows_per_file, route_column)],
        "n_children int, n_subsegments int, leaf_size int, vertical_factor double, "
        "rows_per_file int, route_column string",
    )
    return versions.write_part(meta.coalesce(1), path, "meta")


def leaf_table(nodes: DataFrame) -> DataFrame:
    """(leaf_id, depth, n, parts, seg) of the leaves that have members."""
    return nodes.where("is_leaf AND n > 0").select(
        F.col("node_id").alias("leaf_id"), "depth", "n", _parts(F.col("n")).alias("parts"), "seg"
    )


RESERVED = ("member", "tree", "leaf", "meta")


def load_index(
    spark: SparkSession, path: str, check: bool = False, version: int | None = None
) -> Index:
    """Read a saved index, its current version by default; ``check`` compares stored and actual leaf
    sizes."""
    parts = versions.parts_of(spark, path, version)
    if not parts:
        raise ValueError(f"no index in {path}")
    table = {name: versions.read(spark, path, files) for name, files in parts.items()}
    meta = table["meta"].first()
    options = replace(
        IndexOptions(),
        leaf_size=meta["leaf_size"],
        n_children=meta["n_children"],
        n_subsegments=meta["n_subsegments"],
        vertical_factor=meta["vertical_factor"],
        rows_per_file=meta["rows_per_file"],
    )
    nodes = table.get("tree")
    index = Index(
        table["member"].drop("node", "kind"),
        table["leaf"] if nodes is None else leaf_table(nodes),
        nodes,
        options,
        path,
        meta["route_column"],
        clustered=nodes is not None,
        tables={name: df for name, df in table.items() if name not in RESERVED},
    )
    if check:
        bad = leaf_size_mismatches(index).limit(1).count()
        if bad:
            raise ValueError("stored leaf sizes differ from the members")
    return index


def save_index(index: Index, path: str) -> Index:
    """Write an index and the tables it has, for one that was not built in a folder (such as one over a
    given key) or to copy it; all appear at once."""
    spark = index.members.sparkSession
    tables = {"member": [versions.write_part(index.members, path, "member")]}
    tables["meta"] = [_write_meta(spark, index.options, index.route_column, path)]
    name, rows = ("tree", index.nodes) if index.nodes is not None else ("leaf", index.leaf)
    tables[name] = [versions.write_part(rows, path, name)]
    for name, df in index.tables.items():
        tables[name] = [versions.write_part(df, path, name)]
    versions.commit(spark, path, tables)
    return load_index(spark, path)


def save_with_index(index: Index, tables: dict[str, DataFrame | None]) -> Index:
    """Save further tables (filters, margins, batches, residence) in a new version of the index, or
    drop those that are None; all change at once."""
    taken = [name for name in tables if name in RESERVED]
    if taken:
        raise ValueError(f"{taken} belong to the index itself")
    spark = index.members.sparkSession
    parts = {
        name: None if df is None else [versions.write_part(df, index.path, name)]
        for name, df in tables.items()
    }
    versions.commit(spark, index.path, parts)
    return load_index(spark, index.path)


def leaf_size_mismatches(index: Index) -> DataFrame:
    actual = index.members.groupBy("leaf_id").agg(F.count("*").alias("actual"))
    return (
        index.leaf.select("leaf_id", "n")
        .join(actual, "leaf_id", "full_outer")
        .where(~F.col("n").eqNullSafe(F.col("actual")))
    )


def append_to_index(index: Index, series: DataFrame, batch: str | None = None) -> Index:
    """Add series with the tree as it stands: route, write, and widen the envelopes of all nodes above
    them, in one new version. A named batch that is already in the index is not added again."""
    spark = series.sparkSession
    parts = versions.parts_of(spark, index.path)
    name = None if batch is None else f"member-batch-{batch}"
    if name is not None and f"data/{name}" in parts["member"]:
        return load_index(spark, index.path)
    routed = index.route(series).join(_leaf_parts(index), "leaf_id", "left")
    draw = F.pmod(F.xxhash64("series_id"), F.coalesce("parts", F.lit(1))).cast("int")
    placed = routed.withColumn("part", draw).drop("parts").repartition("leaf_id", "part")
    member = versions.write_part(placed.sortWithinPartitions("leaf_id", "part", "series_id"), index.path, "member", name)
    wider = versions.write_part(widen_nodes(index.nodes, index.path_stats(series)), index.path, "tree")
    versions.commit(spark, index.path, {"member": [*parts["member"], member], "tree": [wider]})
    return load_index(spark, index.path)


def _leaf_parts(index: Index) -> DataFrame:
    return index.leaf.select("leaf_id", "parts")


def widen_nodes(nodes: DataFrame, fresh: DataFrame) -> DataFrame:
    """The node table with further members' statistics (``STAT_SCHEMA``) merged in."""
    old = nodes.select("node_id", F.explode("seg").alias("s")).select("node_id", "s.*", F.lit(0).cast("long").alias("n"))
    stats = fresh.unionByName(old).groupBy(F.col("node_id").alias("leaf_id"), "off", "len").agg(
        F.sum("n").alias("n"),
        F.min("min_mean").alias("min_mean"),
        F.max("max_mean").alias("max_mean"),
        F.min("min_std").alias("min_std"),
        F.max("max_std").alias("max_std"),
    )
    packed = pack_envelopes(stats).select(F.col("leaf_id").alias("node_id"), F.col("n").alias("more"), F.col("seg").alias("wide"))
    merged = nodes.join(packed, "node_id", "left")
    merged = merged.withColumn("n", F.col("n") + F.coalesce("more", F.lit(0))).withColumn("seg", F.coalesce("wide", "seg"))
    return merged.select(*nodes.columns)


def index_by_key(members: DataFrame, length: int, n_segments: int = 4) -> Index:
    """Use an existing key as the leaf: (series_id, leaf_id, values). No tree; the leaf table is
    computed on demand."""
    leaf = (
        key_envelopes(members, segmentation(length, n_segments))
        .withColumn("depth", F.lit(0))
        .withColumn("parts", _parts(F.col("n")))
        .select("leaf_id", "depth", "n", "parts", "seg")
    )
    return Index(members, leaf, None, IndexOptions(n_subsegments=n_segments), clustered=False)


__all__ = [
    "Index", "append_to_index", "build_index", "index_by_key", "load_index", "save_index", "save_with_index",
]
