"""Streaming queries against a saved index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from driftleaf.plans.index import Index
from driftleaf.plans.search import knn_pruned


def start_search(
    queries: DataFrame, index: Index, k: int, path: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Answer arriving (query_id, values) rows; the answers of micro-batch n go to
    ``path/batch=<n>``, which a repeated batch overwrites."""

    def answer(batch: DataFrame, number: int) -> None:
        knn_pruned(index, batch, k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
