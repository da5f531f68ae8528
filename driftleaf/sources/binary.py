"""Fixed-width float32 files: rows of ``length`` little-endian values, no header; the id of a
series is its position over the files in name order."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from driftleaf.operators.leaves import cluster_by_leaf
from driftleaf.session import ship_package

FORMAT = "float32_series"
_ROWS_PER_BATCH = 4096
_BYTES_PER_SPLIT = 64 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _files(path: str) -> list[fs.FileInfo]:
    system, root = _open(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [info]
    found = system.get_file_info(fs.FileSelector(root))
    return sorted(
        (f for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._"),
        key=lambda f: f.path,
    )


@dataclass
class _Range(InputPartition):
    file: str
    offset: int
    rows: int
    first_id: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, length: int, limit: int | None) -> None:
        self.path, self.length, self.limit = path, length, limit

    def partitions(self) -> list[_Range]:
        width = 4 * self.length
        step = max(1, _BYTES_PER_SPLIT // width)
        out, base = [], 0
        for info in _files(self.path):
            if info.size % width:
                raise ValueError(f"{info.path}: size is no multiple of the row width")
            rows = info.size // width
            if self.limit is not None:
                rows = min(rows, self.limit - base)
            for lo in range(0, rows, step):
                out.append(_Range(info.path, lo * width, min(step, rows - lo), base + lo))
            base += max(0, rows)
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        with system.open_input_file(partition.file) as source:
            source.seek(partition.offset)
            done = 0
            while done < partition.rows:
                n = min(_ROWS_PER_BATCH, partition.rows - done)
                data = np.frombuffer(source.read(4 * self.length * n), dtype="<f4")
                ids = np.arange(partition.first_id + done, partition.first_id + done + n)
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * self.length)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, type=pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(data, type=pa.float32())),
                    ],
                    names=["series_id", "values"],
                )
                done += n


@dataclass
class _Written(WriterCommitMessage):
    temporary: str
    rows: int


class _Writer(DataSourceArrowWriter):
    """Tasks write temporary files; the commit renames the successful attempts in partition
    order, so a retried task leaves no half-written file behind."""

    def __init__(self, path: str, length: int) -> None:
        self.path, self.length, self.job = path, length, uuid.uuid4().hex[:8]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        name = f"{root}/_{self.job}-{context.partitionId():06d}-{context.taskAttemptId()}.tmp"
        rows = 0
        with system.open_output_stream(name) as sink:
            for batch in iterator:
                column = batch.column("values")
                data = column.flatten().to_numpy(zero_copy_only=False)
                if len(data) != len(column) * self.length:
                    raise ValueError("a series has another length")
                sink.write(data.astype("<f4").tobytes())
                rows += len(column)
        return _Written(name, rows)

    def commit(self, messages: list[_Written | None]) -> None:
        system, _ = _open(self.path)
        for message in messages:
            if message is None:
                continue
            if message.rows:
                part = message.temporary.rsplit("-", 1)[0].replace("/_", "/part-")
                system.move(message.temporary, f"{part}.bin")
            else:
                system.delete_file(message.temporary)

    def abort(self, messages: list[_Written | None]) -> None:
        system, _ = _open(self.path)
        for message in messages:
            if message is not None:
                system.delete_file(message.temporary)


class Float32Series(DataSource):
    """Options: ``path``, ``length``, and ``limit`` for the first rows only."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "series_id long, values array<float>"

    def reader(self, schema) -> _Reader:
        limit = self.options.get("limit")
        return _Reader(
            self.options["path"], int(self.options["length"]), int(limit) if limit else None
        )

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], int(self.options["length"]))


def _register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(Float32Series)


def read_series(
    spark: SparkSession, path: str, length: int, limit: int | None = None
) -> DataFrame:
    """(series_id, values); with ``limit`` the first rows only, as for a query file."""
    _register(spark)
    reader = spark.read.format(FORMAT).option("length", length)
    if limit is not None:
        reader = reader.option("limit", limit)
    return reader.load(path)


def read_queries(spark: SparkSession, path: str, length: int, n: int | None = None) -> DataFrame:
    return read_series(spark, path, length, n).withColumnRenamed("series_id", "query_id")


def read_with_sketch(
    spark: SparkSession, path: str, length: int, sketch_path: str, sketch_length: int
) -> DataFrame:
    """(series_id, values, sketch) from two files aligned by position."""
    sketch = read_series(spark, sketch_path, sketch_length).withColumnRenamed("values", "sketch")
    return read_series(spark, path, length).join(sketch, "series_id")


def write_series(series: DataFrame, path: str, length: int, partitions: int = 8) -> None:
    """Write the values in order of ``series_id``; reading back numbers them from 0."""
    _register(series.sparkSession)
    (
        series.repartitionByRange(partitions, "series_id")
        .sortWithinPartitions("series_id")
        .select(F.col("series_id"), F.col("values").cast("array<float>").alias("values"))
        .write.format(FORMAT)
        .option("length", length)
        .mode("append")
        .save(path)
    )


def write_leaves(members: DataFrame, path: str, rows_per_file: int = 500_000) -> None:
    """One folder per leaf, as Parquet. Large leaves are spread over several files."""
    cluster_by_leaf(members, rows_per_file).write.mode("overwrite").partitionBy("leaf_id").parquet(
        path
    )
