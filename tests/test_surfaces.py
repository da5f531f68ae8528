import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftleaf.models import surfaces as M
from driftleaf.operators import augment as A
from driftleaf.operators import surface as S
from driftleaf.operators.lookup import actual_errors
from driftleaf.operators.quadrant import quadrant_extreme


def make_triples(rng, n=120, filters=3):
    rows = {}
    for _ in range(n * filters):
        key = (int(rng.integers(filters)), round(0.9 + int(rng.integers(11)) / 100, 6), round(0.8 + int(rng.integers(21)) / 100, 6))
        rows[key] = float(rng.uniform(0, 5))
    return [(*k, v) for k, v in rows.items()]


@pytest.fixture()
def rows(rng):
    return make_triples(rng)


@pytest.fixture()
def triples(spark, rows):
    return spark.createDataFrame(rows, "filter_id long, recall double, coverage double, error double")


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("above", [True, False])
@pytest.mark.parametrize("strict", [True, False])
def test_quadrant_against_brute_force(spark, triples, rows, largest, above, strict):
    got = quadrant_extreme(
        triples, ["filter_id"], "recall", "coverage", "error", "m", largest, above, strict
    ).collect()
    assert len(got) == len(rows)
    for g in got:
        f, r, c, _, m = g
        sign = 1 if above else -1
        seen = [
            e for ff, rr, cc, e in rows
            if ff == f and sign * (rr - r) > 0 and (sign * (cc - c) > 0 or (not strict and cc == c))
        ]
        want = (max if largest else min)(seen) if seen else None
        assert m == want


def test_cleaning_against_loops(triples, rows):
    got = {tuple(r[:3]): r[3] for r in S.clean_triples(triples).collect()}
    for f in {r[0] for r in rows}:
        pts = [r[1:] for r in rows if r[0] == f]
        q1 = sorted(p[2] for p in pts)[len(pts) // 4]
        kept = [
            p for p in pts
            if not (p[2] < q1 and any(o[0] >= p[0] and o[1] >= p[1] and o[:2] != p[:2] and o[2] <= p[2] for o in pts))
        ]
        err = {p[:2]: p[2] for p in kept}
        for fixed, axis in ((0, 1), (1, 0)):
            new = dict(err)
            for v in {p[fixed] for p in err}:
                line = sorted((p for p in err if p[fixed] == v), key=lambda p: p[axis])
                for a, b in zip(line, line[1:]):
                    if err[b] <= err[a]:
                        new[b] = err[a] * 1.01
            err = new
        new = dict(err)
        for p in err:
            below = [e for o, e in err.items() if o[0] < p[0] and o[1] < p[1]]
            if below and err[p] <= max(below):
                new[p] = max(below) * 1.01
        mine = {k[1:]: v for k, v in got.items() if k[0] == f}
        assert mine.keys() == new.keys()
        assert all(abs(mine[k] - new[k]) < 1e-12 for k in new)


def test_grid_takes_the_largest_of_five_nearest(triples, rows):
    got = S.fit_grid(triples.repartition(7)).collect()
    for f in {r[0] for r in rows}:
        pts = np.array([r[1:] for r in rows if r[0] == f])
        size = min(20, int(np.sqrt(len(pts))) + 5)
        mine = [g for g in got if g["filter_id"] == f]
        assert len(mine) == size * size
        for g in mine:
            d = (pts[:, 0] - g["recall"]) ** 2 + (pts[:, 1] - g["coverage"]) ** 2
            near = np.lexsort((pts[:, 1], pts[:, 0], d))[:5]
            assert g["error"] == pts[near, 2].max()


def test_surface_rises_on_both_axes(triples):
    pdf = S.running_maximum(S.fit_grid(triples)).toPandas()
    for _, part in pdf.groupby("filter_id"):
        grid = part.pivot(index="recall", columns="coverage", values="error").to_numpy()
        assert (np.diff(grid, axis=0) >= 0).all() and (np.diff(grid, axis=1) >= 0).all()


def test_grid_hit_returns_the_node(spark):
    points = [(1, 0.9 + 0.01 * i, 0.9 + 0.01 * j, 1.0 + i + j) for i in range(3) for j in range(3)]
    df = spark.createDataFrame(points, "filter_id long, recall double, coverage double, error double")
    surface = S.running_maximum(S.fit_grid(df))
    node = surface.orderBy("recall", "coverage").first()
    out = S.predict_surface(surface, S.surface_bounds(df), [(0.5, 0.5)]).first()
    assert abs(out["error"] - node["error"]) < 1e-12


def test_quadratic_equals_least_squares(spark, triples, rows):
    targets = [(0.93, 0.85), (0.99, 0.97)]
    got = {(r[0], r[1], r[2]): r[3] for r in S.predict_quadratic(S.fit_quadratic(triples), targets).collect()}
    for f in {r[0] for r in rows}:
        pts = np.array([r[1:] for r in rows if r[0] == f])
        r, c = pts[:, 0] - 0.95, pts[:, 1] - 0.9
        x = np.c_[np.ones(len(r)), r, c, r * c, r * r, c * c]
        w = np.linalg.lstsq(x, pts[:, 2], rcond=None)[0]
        for t in targets:
            a, b = t[0] - 0.95, t[1] - 0.9
            assert abs(got[(f, *t)] - w @ [1, a, b, a * b, a * a, b * b]) < 1e-6


def test_quadratic_with_few_points(spark):
    df = spark.createDataFrame([(1, 0.9, 0.9, 1.0), (1, 0.95, 0.9, 3.0)], "filter_id long, recall double, coverage double, error double")
    assert abs(S.predict_quadratic(S.fit_quadratic(df), [(1.0, 1.0)]).first()["error"] - 2.0) < 1e-9


def test_dense_grid(triples):
    out = S.predict_quadratic(S.fit_quadratic(triples), S.DenseGrid((0.9, 1.0), (0.8, 1.0), 5))
    pdf = out.toPandas()
    assert len(pdf) == 75 and np.isclose(pdf["target_r"].max(), 1.0)


def test_steffen_is_monotone_and_interpolates(spark):
    x = [0.0, 0.2, 0.5, 0.6, 1.0]
    y = [0.0, 0.1, 0.1, 0.9, 1.0]
    df = spark.createDataFrame([(1, a, b) for a, b in zip(x, y)], "leaf_id long, r double, v double")
    values = []
    for at in np.linspace(-0.1, 1.1, 25):
        values.append(S.steffen_at(df, "leaf_id", "r", "v", float(at)).first()["value"])
    assert values[0] == 0.0 and values[-1] == 1.0
    assert (np.diff(values) >= -1e-12).all()
    for a, b in zip(x, y):
        assert abs(S.steffen_at(df, "leaf_id", "r", "v", a).first()["value"] - b) < 1e-12
    pos = S.position_for_target(
        spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "leaf_id long, pos int, recall double"),
        0.5, 0.5, 0.5, 0.5,
    ).first()
    assert pos["pos"] == 2


def test_thin_plate(triples):
    pdf = M.thin_plate_at(triples, [(0.95, 0.9), (1.0, 1.0)]).toPandas()
    assert len(pdf) == 6 and (pdf["error"] >= 0.2).all()


def test_boosted_surface_rises(spark, triples):
    model = M.BoostedSurface.fit(triples, rounds=3, depth=3)
    targets = [(r, c) for r in (0.9, 0.95, 1.0) for c in (0.8, 0.9, 1.0)]
    pdf = model.at_targets(triples.select("filter_id").distinct(), targets).toPandas()
    assert len(pdf) == 27
    for _, part in pdf.groupby("filter_id"):
        grid = part.pivot(index="recall", columns="coverage", values="error").to_numpy()
        assert (np.diff(grid, axis=0) >= 0).all() and (np.diff(grid, axis=1) >= 0).all()


def test_prediction_of_a_point_is_the_same_in_any_batch(spark, triples):
    model = M.BoostedSurface.fit(triples, enhanced=True, rounds=3, depth=3)
    batch = triples.select("filter_id", "recall", "coverage")
    point = batch.orderBy("filter_id", "recall", "coverage").limit(1)
    among = {tuple(r[:3]): r["pred"] for r in model.predict(batch).select("filter_id", "recall", "coverage", "pred").collect()}
    alone = model.predict(point).first()
    assert alone["pred"] == among[alone["filter_id"], alone["recall"], alone["coverage"]]


@pytest.mark.parametrize("enhanced", [False, True])
def test_tasks_of_a_fit_follow_the_rows(spark, monkeypatch, enhanced):
    """A task of the fit holds a bounded number of rows, whatever the shuffle partitions are."""
    seen = []

    class Learner:
        def __init__(self, **options):
            pass

        def fit(self, rows):
            seen.extend(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect())

    monkeypatch.setattr(M, "GBTRegressor", Learner)
    monkeypatch.setattr(M, "FIT_ROWS", 250)
    rows = spark.range(5000).selectExpr("id % 7 AS filter_id", "0.5 + id / 1e5 AS recall", "0.9D AS coverage", "1.0D * id AS error")
    M.BoostedSurface.fit(rows, enhanced)
    assert sum(seen) == 5000 and len(seen) == 20 and max(seen) < 400


def test_ranks_on_a_curve(spark):
    rows = spark.createDataFrame([(1, 0.2), (1, 0.4), (1, 0.4), (1, 0.8), (2, 0.5)], "filter_id long, recall double")
    asked = spark.createDataFrame([(1, 0.4), (1, 0.1), (1, 0.5), (1, 0.9), (2, 0.7), (3, 0.7)], rows.schema)
    curve = A.rank_curve(rows, ["filter_id"], "recall")
    got = {tuple(r[:2]): r[2] for r in A.rank_on_curve(asked, curve, ["filter_id"], "recall", "rank").select("filter_id", "recall", "rank").collect()}
    assert got == {(1, 0.4): 0.625, (1, 0.1): 0.125, (1, 0.5): 0.875, (1, 0.9): 1.0, (2, 0.7): 0.5, (3, 0.7): 0.5}


@pytest.mark.parametrize("size", [1, 2, 3, 4, 7, 100, 30_000])
@pytest.mark.parametrize("quarter", [1, 3])
def test_index_quartile_is_the_element_at_its_place(spark, size, quarter):
    values = np.random.default_rng(size).integers(0, max(2, size // 3), size).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"filter_id": 1, "error": values}))
    assert S.index_quartile(df, quarter).first()["q"] == np.sort(values)[size * quarter // 4]


def test_lookup(spark):
    df = spark.createDataFrame(
        [(1, 0.95, 0.95, 2.0), (1, 0.9505, 0.9501, 4.0), (1, 0.90, 0.90, 8.0), (1, 0.90, 0.80, 6.0)],
        "filter_id long, recall double, coverage double, error double",
    )
    got = {(r["recall"], r["coverage"]): (r["actual_error"], r["match"]) for r in
           actual_errors(df, [(0.95, 0.95), (0.9, 0.85), (0.99, 0.99)]).collect()}
    assert got[(0.95, 0.95)] == (3.0, "exact")
    assert got[(0.9, 0.85)] == (7.0, "nearest")
    assert got[(0.99, 0.99)][1] == "nearest" and got[(0.99, 0.99)][0] == 4.0


def test_percent_rank_and_features(spark):
    df = spark.createDataFrame(
        [(1, 0.9, 0.9, 1.0), (1, 0.9, 0.95, 1.0), (1, 1.0, 0.99, 1.0), (2, 0.5, 0.5, 1.0)],
        "filter_id long, recall double, coverage double, error double",
    )
    rows = {(r["filter_id"], r["coverage"]): r for r in A.surface_features(df).collect()}
    assert rows[(1, 0.9)]["recall_rank"] == 1.5 / 3 and rows[(1, 0.99)]["recall_rank"] == 1.0
    assert rows[(2, 0.5)]["recall_rank"] == 0.5 and rows[(2, 0.5)]["rank_correlation"] == 0.25
    assert set(A.FEATURES) <= set(rows[(1, 0.9)].asDict())


def test_sentinels(spark):
    df = spark.createDataFrame(
        [(1, 0.9, 0.95, 1.0), (1, 0.9, 0.5, 0.2), (1, 0.95, 1.0, 2.0)],
        "filter_id long, recall double, coverage double, error double",
    )
    got = {(r["recall"], r["coverage"]): (r["error"], r["is_new"]) for r in A.coverage_sentinels(df).collect()}
    assert got[(0.9, 1.0)] == (3.0, True) and got[(0.9, 0.96)] == (1.4, True)
    assert got[(0.95, 0.9995)] == (2.0, False) and got[(0.95, 1.0)] == (6.0, True)
    assert len(got) == 3 + 5 + 1
    extreme = A.extreme_sentinels(df, (0.999, 0.9999, 0.99))
    assert {r["coverage"]: r["error"] for r in extreme.where("is_new and recall = 0.9").collect()} == {
        0.999: 3.0, 0.9999: 5.0, 0.99: 2.0,
    }


def test_compaction(spark):
    df = spark.createDataFrame(
        [(1, 0, 0.9, 0.9, 1.0), (1, 1, 0.9000000001, 0.9, 2.0), (1, 1, 0.8, 0.9, 5.0), (1, 2, None, 0.9, 9.0)],
        "filter_id long, col_group int, recall double, coverage double, error double",
    )
    got = {(r["recall"], r["coverage"]): r["error"] for r in A.compact(df).collect()}
    assert got == {(0.9, 0.9): 5.0, (0.8, 0.9): 5.0}


def test_unpivot(spark):
    wide = spark.createDataFrame(
        [(0, 0.9, 0.8, 1.0, 0.7, 0.6, 2.0)],
        ["batch_id_sorted", "recall0", "cov1", "actual error2", "recall3", "cov4", "actual error5"],
    )
    got = [tuple(r) for r in A.unpivot_wide(wide).orderBy("col_group").collect()]
    assert got == [(0, 0.9, 0.8, 1.0), (1, 0.7, 0.6, 2.0)]


def test_natural_cubic(spark):
    x = np.linspace(0, 3, 7)
    df = spark.createDataFrame([(1, float(a), float(np.sin(a))) for a in x], "leaf_id long, r double, v double")
    for at in (0.0, 0.5, 1.3, 2.9, 3.0):
        got = S.natural_cubic_at(df, "leaf_id", "r", "v", at).first()["value"]
        assert abs(got - np.sin(at)) < 0.02
    assert abs(S.natural_cubic_at(df, "leaf_id", "r", "v", 1.5).first()["value"] - np.sin(1.5)) < 1e-12
    assert abs(S.natural_cubic_at(df, "leaf_id", "r", "v", 9.0).first()["value"] - np.sin(3.0)) < 1e-12


def test_grid_and_targets_make_no_row_a_pair(spark, monkeypatch):
    """Nodes meet points and targets inside a task; filters that are spread give the same grid."""
    rows = [(f, i / 8, j / 8, float((7 * i + 3 * j + f) % 11)) for f in range(3) for i in range(9) for j in range(9)]
    df = spark.createDataFrame(rows + [(9, 0.5, 0.5, 2.0)], "filter_id long, recall double, coverage double, error double")
    grid = S.fit_grid(df)
    out = S.predict_surface(S.running_maximum(grid), S.surface_bounds(df), [(0.5, 0.5), (0.9, 1.0)])
    assert "Generate" not in out._jdf.queryExecution().toString()
    assert {r["filter_id"]: r["error"] for r in out.where("target_r = 0.5").collect()}[9] == 2.0
    whole = {(r[0], r[1], r[2]): r[3] for r in grid.collect()}
    monkeypatch.setattr(S, "ROWS_PER_TASK", 20)
    assert whole == {(r[0], r[1], r[2]): r[3] for r in S.fit_grid(df).collect()}
