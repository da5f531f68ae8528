"""Fixed values and options shared by the whole package."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

# Tolerances and validity bounds of the data model.
EPSILON = 1e-5
EPSILON_GAP = 1e-4
MIN_VALID = -1e6
MAX_VALID = 1e8

# Rows of a member block and queries of a query block in the shuffled distance join.
BLOCK_ROWS = 8192
QUERY_BLOCK_ROWS = 2048


@dataclass(frozen=True)
class IndexOptions:
    """How series are cut into leaves; the first four defaults are fixed values."""

    leaf_size: int = 100
    n_children: int = 2
    n_subsegments: int = 2
    vertical_factor: float = 2.0
    rows_per_file: int = 500_000
    subtree_rows: int | None = None  # members of a subtree that one task grows; by size if unset


def broadcast_budget(spark: SparkSession) -> int:
    """Bytes a broadcast table may hold; larger inputs take the shuffled path."""
    return int(spark.conf.get("spark.driftleaf.broadcastBytes", str(64 << 20)))
