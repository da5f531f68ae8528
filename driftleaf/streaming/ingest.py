"""Streaming ingest: new series are routed with the tree as it stands and appended."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from driftleaf.plans.index import Index, leaf_table, widen_nodes
from driftleaf.session import materialise


def start_ingest(
    stream: DataFrame, index: Index, path: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Append each micro-batch under ``path``: its statistics in ``node/batch=<n>``, then its members in
    ``member/batch=<n>``. A reader between the two sees envelopes wider than the members need, which
    is sound. A repeated batch overwrites its own folders, so a restart neither loses nor doubles
    rows."""

    def append(batch: DataFrame, number: int) -> None:
        kept = materialise(batch, "arrived")
        index.path_stats(kept).write.mode("overwrite").parquet(f"{path}/node/batch={number}")
        index.route(kept).write.mode("overwrite").parquet(f"{path}/member/batch={number}")

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def with_ingested(index: Index, path: str) -> Index:
    """The index with everything that was ingested under ``path``."""
    spark = index.members.sparkSession
    fresh = spark.read.parquet(f"{path}/node").drop("batch")
    members = spark.read.parquet(f"{path}/member").drop("batch")
    columns = [c for c in index.members.columns if c in members.columns]
    nodes = materialise(widen_nodes(index.nodes, fresh), "nodes")
    return replace(
        index,
        members=index.members.select(*columns).unionByName(members.select(*columns)),
        leaf=leaf_table(nodes),
        nodes=nodes,
        path=None,
        clustered=False,
    )
