"""A sample of the registered queries against their SQL twins on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "knn_exact", "knn_join", "knn_lb_pruned", "knn_filtered", "kth_before_visit",
    "training_facts", "batch_recall_by_pos", "unique_triples", "search_replay",
    "calib_batches_balanced", "best_splits", "tree_route", "synthetic_queries", "raw_compaction",
    "monotone_bump", "surface_predict", "band_lookup", "coverage_sentinels", "enhanced_features",
    "prediction_statistics", "three_way_errors", "triples_csv", "binary_series", "ridge_filters",
    "alpha_for_recall_cubic",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(file).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    value = float(value)
    return None if math.isnan(value) else value + 0.0


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_twin(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = ordered([tuple(plain(r[c]) for c in columns) for r in df.collect()])
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = ordered([tuple(plain(r[i]) for i in at) for r in cursor.fetchall()])
    assert got and got == want
