"""Searches by many queries whose bounds prune little."""

import numpy as np
import pytest

from driftleaf.operators import within as W
from driftleaf.plans import search as P
from driftleaf.plans.index import build_index
from driftleaf.settings import IndexOptions
from tests.conftest import answers, brute_knn, frame


@pytest.mark.parametrize("cells", [False, True])
def test_all_series_as_queries_send_no_pairs(spark, rng, monkeypatch, cells):
    x = rng.normal(size=(400, 16))
    x[200:210] = x[:10]  # copies: ties go to the smaller id
    monkeypatch.setattr(P, "MANY_QUERIES", 100)
    monkeypatch.setattr(W, "CELL_BYTES", 20_000)
    series = frame(spark, x).repartition(3)
    index = build_index(series, IndexOptions(leaf_size=10))
    queries = series.withColumnRenamed("series_id", "query_id")
    calls = []
    scan = P.scan
    monkeypatch.setattr(P, "scan", lambda *a, **b: calls.append(1) or scan(*a, **b))
    # 400 queries fit 80,000 bytes, their pairs with leaves do not; the leaves fit 40,000 in either case.
    spark.conf.set("spark.driftleaf.broadcastBytes", "40000" if cells else "80000")
    try:
        got = answers(P.knn_pruned(index, queries, 3))
    finally:
        spark.conf.unset("spark.driftleaf.broadcastBytes")
    assert got == brute_knn(x, x, 3)
    assert len(calls) == 1  # the resident leaves alone were met by pairs


def test_fewer_than_k_members(spark, rng):
    x, q = rng.normal(size=(3, 4)), rng.normal(size=(5, 4))
    best = W._Within(q, np.full(5, np.nan), 4)
    best._add(np.arange(5), x, np.zeros(3, np.int64), np.arange(3))
    rows = best.rows(np.arange(5)).to_pydict()
    assert sorted(zip(rows["query_id"], rows["series_id"])) == [(i, j) for i in range(5) for j in range(3)]
