"""Cases that once gave incomplete or wrong results."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from driftleaf.operators.lookup import actual_errors
from driftleaf.operators.navigation import combined_scores
from driftleaf.operators.sampling import leaf_queries
from driftleaf.operators.tree import depth_of
from driftleaf.plans.index import append_to_index, build_index
from driftleaf.session import work_root
from driftleaf.settings import IndexOptions
from driftleaf.sources.binary import _files
from tests.conftest import frame


def test_skewed_data_gives_a_deep_tree_of_small_leaves(spark, rng):
    x = np.cumsum(rng.normal(size=(600, 16)), 1) * np.exp2(-rng.integers(0, 10, (600, 1)).astype(float))
    index = build_index(frame(spark, x), IndexOptions(leaf_size=4))
    rows = index.leaf.select("leaf_id", "depth", "n").collect()
    assert max(r["n"] for r in rows) <= 4 and sum(r["n"] for r in rows) == 600
    assert max(r["depth"] for r in rows) > 9


@pytest.mark.parametrize("fan", [2, 3, 5])
def test_depth_in_whole_numbers(spark, fan):
    ids, level = [], 0
    while fan**level * 2 < 1 << 62:
        ids += [(fan**level, level), (2 * fan**level - 1, level)]
        level += 1
    df = spark.createDataFrame(ids, "id long, level int")
    assert df.where(depth_of(F.col("id"), fan) != F.col("level")).count() == 0


def test_append_with_three_children_keeps_depths(spark, rng):
    x = rng.normal(size=(200, 16))
    index = build_index(frame(spark, x[:120]), IndexOptions(leaf_size=10, n_children=3))
    index = append_to_index(index, frame(spark, x[120:], start=120))
    above = index.nodes.select(F.col("node_id").alias("parent_id"), F.col("depth").alias("above"))
    wrong = index.nodes.join(above, "parent_id", "left").where(F.coalesce("above", F.lit(-1)) + 1 != F.col("depth"))
    assert wrong.count() == 0 and index.members.count() == 200
    per_parent = index.nodes.where("parent_id IS NOT NULL").groupBy("parent_id").count()
    assert {r["count"] for r in per_parent.collect()} == {3}


def test_small_leaves_are_drawn_again(spark, rng):
    members = frame(spark, rng.normal(size=(12, 8)), leaf_id=[0] * 4 + [1] * 8)
    leaf = members.groupBy("leaf_id").agg(F.count("*").alias("n"))
    drawn = leaf_queries(members, leaf, 0, 6, repeats=True)
    assert {r["leaf_id"]: r["count"] for r in drawn.groupBy("leaf_id").count().collect()} == {0: 6, 1: 6}
    assert drawn.select("values").distinct().count() == 12


def test_leaves_without_a_score_count_as_zero(spark):
    bounds = spark.createDataFrame([(1, leaf, float(leaf)) for leaf in range(4)], "query_id long, leaf_id long, lb double")
    scores = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.1)], "query_id long, leaf_id long, score double")
    assert combined_scores(scores, bounds).count() == 4


def test_targets_far_away(spark):
    triples = spark.createDataFrame([(1, 0.5, 0.5, 2.0), (1, 0.6, 0.5, 4.0)], "filter_id long, recall double, coverage double, error double")
    rows = actual_errors(triples, [(50.0, 60.0)]).collect()
    assert [(r["actual_error"], r["match"]) for r in rows] == [(4.0, "nearest")]


def test_folder_reader_takes_any_name(tmp_path):
    for name in ("part-0.bin", "part-1", "x.f32", "_SUCCESS", ".crc"):
        (tmp_path / name).write_bytes(b"")
    assert sorted(f.base_name for f in _files(str(tmp_path))) == ["part-0.bin", "part-1", "x.f32"]


def test_work_folder_must_be_shared_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        work_root(Session())


def test_text_of_series_rounds_the_exact_value_as_its_sql(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    series = [
        [-0.0703125, 0.0703125, 0.0234375, 2.5e-6, 5e-7, -1e-9, 1.0], [1e23, -3.4e38, nan, -nan, inf, -inf, -0.0],
        [0.5, None, 2.0], [None, None], [], None,
    ]
    vectors = pa.array(series, pa.list_(pa.float32()), from_pandas=False)
    file = tmp_path / "embeddings.parquet"
    pq.write_table(pa.table({"vec_id": pa.array(range(len(series))), "embedding": vectors}), file)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{file}'")
        want = dict(con.execute(entry.oracle_sql()["series_as_text"]).fetchall())
    got = entry.queries()["series_as_text"](spark, str(tmp_path)).collect()
    assert {r["vec_id"]: r["text"] for r in got} == want
    assert want[0].startswith("-0.070312 0.070312 0.023438 ") and want[2] == "0.500000 2.000000"
