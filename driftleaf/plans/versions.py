"""Versions of a set of tables that belong together.

Every table is written under a name of its own and never changed. A manifest of one small file a version
says which files make up which table, so a version appears as a whole or not at all: a writer that
stops before the manifest leaves files that nothing refers to. One writer at a time is
expected; of two that commit the same version the later one gets an error and the tables of the
first stay. Names in the manifest are relative, so a folder can be copied.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, commit string, name string, place int, part string"


def _rows(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def history(spark: SparkSession, path: str) -> list[int]:
    """Versions from the first to the current one."""
    rows = _rows(spark, path)
    if rows is None:
        return []
    return [r[0] for r in rows.select("version").distinct().orderBy("version").collect()]


def parts_of(spark: SparkSession, path: str, version: int | None = None) -> dict[str, list[str]]:
    """The files of every table of a version, the current one by default; empty for a new folder."""
    rows = _rows(spark, path)
    if rows is None:
        return {}
    wanted = rows.agg(F.max("version")).first()[0] if version is None else version
    found = rows.where(F.col("version") == F.lit(wanted)).orderBy("commit", "name", "place").collect()
    if version is not None and not found:
        raise ValueError(f"{path} has no version {version}")
    out: dict[str, list[str]] = {}
    for row in found:
        if row["commit"] == found[0]["commit"]:
            out.setdefault(row["name"], []).append(row["part"])
    return out


def write_part(df: DataFrame, path: str, name: str, part: str | None = None) -> str:
    """Write a table's file under a new name, or under ``part`` again."""
    part = f"data/{part or f'{name}-{uuid.uuid4().hex[:12]}'}"
    df.write.mode("overwrite").parquet(f"{path}/{part}")
    return part


def commit(spark: SparkSession, path: str, tables: dict[str, list[str] | None]) -> int:
    """Make a version in which the named tables have the given files (None: no such table) and all
    others are as they were."""
    known = history(spark, path)
    version = known[-1] + 1 if known else 1
    merged = {**parts_of(spark, path), **tables}
    mine = uuid.uuid4().hex
    rows = [
        (version, mine, name, place, part)
        for name, parts in merged.items()
        for place, part in enumerate(parts or [])
    ]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    written = _rows(spark, path).where(F.col("version") == version)
    if written.agg(F.min("commit")).first()[0] != mine:
        raise ValueError(f"another writer committed version {version} of {path}; load it and try again")
    return version


def read(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    files = [f"{path}/{part}" for part in parts]
    schema = spark.read.parquet(files[0]).schema
    return spark.read.schema(schema).parquet(*files)
