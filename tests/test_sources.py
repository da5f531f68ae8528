import numpy as np
import pytest
from pyspark.sql import functions as F

from driftleaf.plans.index import build_index
from driftleaf.plans.search import knn_exact, knn_pruned
from driftleaf.session import new_work_path
from driftleaf.settings import IndexOptions
from driftleaf.sources import binary as B
from driftleaf.sources import tables as T
from driftleaf.streaming.ingest import start_ingest, with_ingested
from driftleaf.streaming.search import start_search
from tests.conftest import answers, brute_knn, frame


def test_binary_round_trip(spark, rng):
    x = rng.normal(size=(103, 12)).astype("f4")
    path = new_work_path(spark, "bin")
    B.write_series(frame(spark, x).repartition(5), path, 12, 3)
    back = B.read_series(spark, path, 12).orderBy("series_id").collect()
    assert [r["series_id"] for r in back] == list(range(103))
    assert np.array_equal(np.array([r["values"] for r in back], dtype="f4"), x)
    few = B.read_queries(spark, path, 12, 7)
    assert few.columns == ["query_id", "values"] and few.count() == 7


def test_binary_reads_a_plain_file_in_ranges(spark, rng, tmp_path, monkeypatch):
    x = rng.normal(size=(50, 8)).astype("<f4")
    file = tmp_path / "series.bin"
    file.write_bytes(x.tobytes())
    reader = B._Reader(str(file), 8, None)
    monkeypatch.setattr(B, "_BYTES_PER_SPLIT", 8 * 4 * 7)
    parts = reader.partitions()
    assert len(parts) == 8 and sum(p.rows for p in parts) == 50
    got = np.concatenate([np.stack(b.column(1).to_pylist()) for p in parts for b in reader.read(p)])
    assert np.array_equal(got.astype("f4"), x)
    with pytest.raises(ValueError):
        B._Reader(str(file), 7, None).partitions()


def test_sketch_alignment(spark, rng):
    x = rng.normal(size=(40, 8)).astype("f4")
    a, b = new_work_path(spark, "v"), new_work_path(spark, "s")
    B.write_series(frame(spark, x), a, 8, 2)
    B.write_series(frame(spark, x[:, :3]), b, 3, 5)
    rows = B.read_with_sketch(spark, a, 8, b, 3).collect()
    assert len(rows) == 40 and all(r["values"][:3] == r["sketch"] for r in rows)


def test_imported_errors_last_line_wins(spark, tmp_path):
    (tmp_path / "errors.txt").write_text(
        "Filter_ID,Recall,Coverage,Error\n1,0.9,0.9,1.0\n2,0.9,0.9,2.0\n1,0.95,0.9,3.0\n"
    )
    errors = T.read_imported_errors(spark, str(tmp_path))
    assert {r["filter_id"]: r["error"] for r in errors.collect()} == {1: 3.0, 2: 2.0}
    leaf = spark.createDataFrame([(1, True), (2, False), (3, True)], "leaf_id long, active boolean")
    got = {r["leaf_id"]: r["alpha"] for r in T.apply_imported_errors(leaf, errors).collect()}
    assert got == {1: 3.0, 2: None, 3: None}


def test_triple_files_take_the_id_from_the_name(spark, tmp_path):
    for i in (3, 14):
        (tmp_path / f"filter_{i}.csv").write_text("recall,coverage,error,is_test\n0.9,0.8,1.5,0\n")
    (tmp_path / "notes_1.txt").write_text("recall,coverage,error,is_test\n0.9,0.8,1.5,0\n")
    got = sorted(tuple(r) for r in T.read_triple_files(spark, str(tmp_path)).collect())
    assert got == [(0.9, 0.8, 1.5, 0, 3), (0.9, 0.8, 1.5, 0, 14)]


def test_triples_of_many_filters_in_few_files(spark):
    """Files follow tasks, not filters; each filter is whole and in order in one file, in both layouts."""
    rows = spark.range(900).selectExpr(
        "id div 3 AS filter_id", "0.9 + (2 - id % 3) / 100 AS recall", "0.5D AS coverage", "id / 7 AS error", "0 AS is_test"
    )
    want = sorted((i // 3, round(0.9 + (2 - i % 3) / 100, 6), 0.5, round(i / 7, 6), 0) for i in range(900))
    for by_filter in (False, True):
        path = new_work_path(spark, "triples")
        T.write_triples(rows.where("filter_id < 20") if by_filter else rows, path, by_filter)
        back = T.read_triples(spark, path).withColumn("file", F.col("_metadata.file_path")).collect()
        got = sorted((r["filter_id"], round(r["recall"], 6), r["coverage"], r["error"], r["is_test"]) for r in back)
        assert got == (want[:60] if by_filter else want)
        files = {r["file"] for r in back}
        assert len(files) == 20 if by_filter else len(files) <= 4
        places = {(r["filter_id"], r["file"]) for r in back}
        assert len(places) == (20 if by_filter else 300)
        for name in files:
            mine = [(r["filter_id"], r["recall"]) for r in back if r["file"] == name]
            assert mine == sorted(mine)


def test_ground_truth_mismatch(spark, rng):
    x, q = rng.normal(size=(30, 8)), rng.normal(size=(4, 8))
    queries = frame(spark, q, "query_id")
    path = new_work_path(spark, "truth")
    T.save_ground_truth(knn_exact(frame(spark, x), queries, 2), queries, path)
    truth = T.load_ground_truth(spark, path)
    assert T.ground_truth_mismatches(truth, queries).count() == 0
    other = queries.where("query_id != 3").withColumn(
        "values", F.when(F.col("query_id") == 1, F.transform("values", lambda v: v + 1)).otherwise(F.col("values"))
    )
    got = {r["query_id"]: r["problem"] for r in T.ground_truth_mismatches(truth, other).collect()}
    assert got == {1: "other values", 3: "unknown query"}


def test_load_table_checks_columns(spark):
    path = new_work_path(spark, "t")
    T.save_table(spark.range(3), path)
    with pytest.raises(ValueError):
        T.load_table(spark, path, T.ALPHA_SCHEMA)


def test_streaming_ingest_and_search(spark, rng):
    x, q = rng.normal(size=(200, 8)), rng.normal(size=(6, 8))
    index = build_index(frame(spark, x[:120]), IndexOptions(leaf_size=30))
    source = new_work_path(spark, "arrive")
    frame(spark, x[120:], start=120).repartition(3).write.parquet(source)
    stream = spark.readStream.schema("series_id long, values array<double>").option(
        "maxFilesPerTrigger", 1
    ).parquet(source)
    path, offsets = new_work_path(spark, "in"), new_work_path(spark, "offsets")
    start_ingest(stream, index, path, offsets).awaitTermination()
    start_ingest(stream, index, path, offsets).awaitTermination()
    grown = with_ingested(index, path)
    assert grown.members.count() == 200
    assert grown.leaf.agg(F.sum("n")).first()[0] == 200
    assert answers(knn_pruned(grown, frame(spark, q, "query_id"), 3)) == brute_knn(x, q, 3)

    asked, out = new_work_path(spark, "ask"), new_work_path(spark, "out")
    frame(spark, q, "query_id").write.parquet(asked)
    start_search(
        spark.readStream.schema("query_id long, values array<double>").parquet(asked),
        index, 2, out, new_work_path(spark, "offsets"),
    ).awaitTermination()
    assert answers(spark.read.parquet(out)) == brute_knn(x[:120], q, 2)
