"""Session helpers: a local session for tests, and the shared work folder."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile
from typing import Any

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftleaf.settings import broadcast_budget


def local_session(cores: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("driftleaf")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def work_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; in local mode a temporary one if it is unset."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def new_work_path(spark: SparkSession, label: str) -> str:
    return f"{work_root(spark)}/driftleaf-{label}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a lineage cut that
    survives the loss of executors."""
    spark = df.sparkSession
    path = new_work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _bounded(df: DataFrame, row_bytes: int) -> pa.Table | None:
    """The rows, if they fit the broadcast budget; reads at most one row above the bound."""
    cap = max(1, broadcast_budget(df.sparkSession) // row_bytes)
    table = df.limit(cap + 1).toArrow()
    return table if table.num_rows <= cap else None


def series_bytes(df: DataFrame, column: str = "values") -> int:
    """Bytes of one row with a series, from its first row; all have the same length."""
    head = df.select(F.size(column)).first()
    return 64 + 8 * max(1, head[0] if head else 1)


def pinned_table(df: DataFrame, columns: list[str], row_bytes: int) -> pa.Table | None:
    """The given columns of a bounded table, None for a larger one; free for pinned tables."""
    held = getattr(df, "_held", None)
    if held is not None:
        return held.select(columns)
    return _bounded(df.select(*columns), row_bytes)


def pin(df: DataFrame, label: str, row_bytes: int = 64) -> DataFrame:
    """Evaluate ``df`` once. A result within the broadcast budget becomes a local relation; a
    larger one is written to the shared folder."""
    table = _bounded(df, row_bytes)
    if table is None:
        return materialise(df, label)
    out = df.sparkSession.createDataFrame(table, df.schema)
    out._held = table
    return out


def broadcast_if_small(df: DataFrame, label: str, row_bytes: int = 64) -> DataFrame:
    """Evaluate once; mark for broadcast only if it fits the budget."""
    out = pin(df, label, row_bytes)
    return F.broadcast(out) if getattr(out, "_held", None) is not None else out


def spread(df: DataFrame, *keys: str, rows: int | None = None, most: int | None = None) -> DataFrame:
    """Hash rows over the shuffle partitions before work that is heavy per row; adaptive execution
    would otherwise merge small inputs into few tasks. ``rows`` avoids tasks of few rows, and with
    ``most`` there are as many tasks as it takes for about so many rows in each."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if rows is not None:
        tasks = max(1, min(tasks, -(-rows // 2000)), -(-rows // most) if most else 1)
    return df.repartition(tasks, *keys)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers; once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    home = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="spark-")) / "driftleaf_pkg.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(home.rglob("*.py")):
            out.write(file, str(file.relative_to(home.parent)))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def share(spark: SparkSession, value: Any) -> Broadcast:
    """Broadcast a value of bounded size to Arrow tasks that also need this package."""
    ship_package(spark)
    return spark.sparkContext.broadcast(value)
