"""The learned search on the tree index: targets are met and margins grow with them."""

import pytest
from pyspark.sql import functions as F

from catalog import feeds
from driftleaf.plans.learned import filtered_report, filtered_search, learn_filters
from driftleaf.plans.search import knn_exact, knn_pruned
from driftleaf.session import materialise

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark):
    queries = feeds.search_queries(spark, SF)
    index = feeds.tree_index(spark, SF)
    training = feeds.train_queries(spark, SF).select("query_id", "values")
    filters = learn_filters(index, training, 10, 20)
    truth = materialise(knn_exact(feeds.series(spark, SF), queries, 1), "truth")
    return queries, index, filters, truth


def test_targets_are_met_and_margins_grow(parts):
    queries, index, filters, truth = parts
    visited, margins = [], []
    for recall, coverage in ((0.5, 0.5), (0.95, 0.9)):
        active = filters.at(recall, coverage)
        out = filtered_report(index, queries, active, truth, recall, coverage).first()
        assert out["recall"] >= recall and out["coverage"] >= coverage
        assert abs(out["pruned_ratio"] - out["filter_ratio"] - out["bound_ratio"]) < 1e-9
        visited.append(out["visited_series"])
        margins.append({r["leaf_id"]: r["alpha"] for r in active.collect()})
    assert visited[0] <= visited[1]
    assert margins[0].keys() == margins[1].keys()
    assert all(margins[0][leaf] <= margins[1][leaf] + 1e-9 for leaf in margins[0])


def test_without_active_filters_the_search_is_exact(parts):
    queries, index, filters, truth = parts
    none = filters.at(0.5, 0.5).where(F.lit(False))
    rows = lambda df: sorted((r["query_id"], r["rank"], r["series_id"]) for r in df.collect())
    assert rows(filtered_search(index, queries, 3, none)) == rows(knn_pruned(index, queries, 3))
    assert rows(filtered_search(index, queries, 1, none)) == rows(truth)
