"""Work that once lay in one group or multiplied rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftleaf.operators.facts import with_kth_before_visit
from driftleaf.operators.lookup import TARGETS, actual_errors, with_actual_errors
from driftleaf.sources import tables as T


def test_one_query_with_many_leaves_is_spread(spark, rng):
    """The leaves of one query lie in several blocks, and each starts with what came before."""
    n, k = 900, 3
    lb = rng.permutation(n).astype(float)
    facts = spark.createDataFrame([(1, i, i == 5, float(lb[i])) for i in range(n)], "query_id long, leaf_id long, is_resident boolean, lb double")
    dist = rng.random((n, k)) * 100
    tops = spark.createDataFrame([(1, i, float(d)) for i in range(n) if i % 7 for d in dist[i]], "query_id long, leaf_id long, dist double")
    got = {r["leaf_id"]: r["bsf"] for r in with_kth_before_visit(facts, tops, k).collect()}
    seen = []
    for i in sorted(range(n), key=lambda i: (i != 5, lb[i], i)):
        want = sorted(seen)[k - 1] if len(seen) >= k else None
        assert got[i] == want
        seen = sorted(seen + (dist[i].tolist() if i % 7 else []))[:k]
    plan = with_kth_before_visit(facts, tops, k)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas [query_id" in plan and "block" in plan


def test_errors_at_targets(spark, rng):
    rows = [(int(f), round(float(r), 4), round(float(c), 4), float(e)) for f, r, c, e in zip(
        rng.integers(0, 3, 400), 0.85 + rng.random(400) * 0.15, 0.8 + rng.random(400) * 0.2, rng.random(400))]
    rows += [(7, 0.9, 0.9, 1.0), (7, 0.9, 0.9, 3.0), (7, 0.9005, 0.9005, 8.0), (8, 0.5, 0.5, 2.0)]
    triples = spark.createDataFrame(rows, "filter_id long, recall double, coverage double, error double")
    got = {(r[0], r[1], r[2]): (round(r[3], 9), r[4]) for r in actual_errors(triples).collect()}
    assert len(got) == 5 * len(TARGETS)
    for f in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == f]
        for tr, tc in TARGETS:
            inside = [e for _, r, c, e in mine if abs(r - tr) <= 0.001 and abs(c - tc) <= 0.001]
            code = [(int(np.hypot(r - tr, c - tc) * 1e9 + 0.5), int(abs(r - tr) * 1e9 + 0.5)) for _, r, c, _ in mine]
            near = [e for (_, _, _, e), d in zip(mine, code) if d == min(code)]
            want = (round(float(np.mean(inside or near)), 9), "exact" if inside else "nearest")
            assert got[f, tr, tc] == want
    said = spark.createDataFrame([(7, 0.9, 0.9, 0.5), (99, 0.9, 0.9, 0.5)], "filter_id long, recall double, coverage double, error double")
    out = {r["filter_id"]: r for r in with_actual_errors(said, triples).collect()}
    assert out[7]["actual_error"] == 4.0 and out[99]["actual_error"] is None


def test_exchange_files_are_read_by_name(spark, tmp_path):
    path = str(tmp_path / "rows")
    df = spark.createDataFrame([(1, 2.5, "a"), (2, None, "b")], "id long, v double, s string")
    T.write_rows(df, path)
    T.write_rows(df, path, "append")
    assert sorted(map(tuple, T.read_rows(spark, path, "v double, id long").collect()), key=str) == [(2.5, 1), (2.5, 1), (None, 2), (None, 2)]
    with pytest.raises(ValueError):
        T.read_rows(spark, path, "w double")
