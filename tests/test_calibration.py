import numpy as np
import pytest
from pyspark.sql import functions as F

from driftleaf.models.fits import RIDGE, fit_per_leaf, mlp, predict_per_leaf
from driftleaf.operators import batches as B
from driftleaf.operators import conformal as C
from driftleaf.operators import recall as R
from driftleaf.operators.allocation import (
    CandidateModel,
    allocate,
    deactivate,
    filter_gains,
)
from driftleaf.operators.navigation import combined_scores
from driftleaf.plans.calibrate import alpha_for_target, calibrate, flagged
from driftleaf.plans.evaluate import replay


def fact_rows(rng, n_queries=60, n_leaves=5):
    rows = []
    for q in range(n_queries):
        for leaf in range(n_leaves):
            lnn = float(rng.uniform(1, 5))
            rows.append((q, leaf, lnn, lnn + float(rng.normal(0, 0.7))))
    return rows


@pytest.fixture()
def predicted(spark, rng):
    return spark.createDataFrame(fact_rows(rng), "query_id long, leaf_id long, lnn double, pred double")


def test_alphas(spark, predicted):
    pdf = predicted.toPandas()
    got = C.conformal_alphas(C.residuals(predicted)).toPandas()
    for leaf, part in pdf.groupby("leaf_id"):
        res = np.sort(np.abs(part["pred"] - part["lnn"]))
        want = np.r_[0, res, max(res.max(), res.mean() + 3 * res.std())]
        mine = got[got["leaf_id"] == leaf].sort_values("pos")
        assert list(mine["pos"]) == list(range(len(want)))
        assert np.allclose(mine["alpha"], want)


def test_invalid_predictions_leave_no_residual(spark):
    df = spark.createDataFrame(
        [(0, 0, 1.0, 0.0), (1, 0, 1.0, 1e8), (2, 0, 1.0, -1e6), (3, 0, 1.0, 2.0)],
        "query_id long, leaf_id long, lnn double, pred double",
    )
    assert [r["query_id"] for r in C.residuals(df).collect()] == [3]


def test_batch_alphas_of_an_empty_batch(spark):
    res = spark.createDataFrame([(0, 7, 0.5), (1, 7, 0.7)], "query_id long, leaf_id long, residual double")
    batches = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (1, 0, 9)], "batch_id int, slot int, query_id long")
    got = {(r["batch_id"], r["pos"]): r["alpha"] for r in C.batch_alphas(res, batches).collect()}
    assert got[(1, 0)] == 0.0 and got[(1, 1)] == 0.1
    assert abs(got[(0, 3)] - (0.6 + 3 * 0.1 + 1e-4)) < 1e-12


def test_recall_equals_sequential_simulation(spark, rng, predicted):
    """Visit the leaves of every query in a random order, as a search would."""
    alphas = C.conformal_alphas(C.residuals(predicted))
    queries = predicted.select("query_id").distinct()
    batches = B.balanced_batches(queries, 6, 15)
    got = {
        (r["batch_id"], r["pos"]): r["recall"]
        for r in R.recall_by_position(R.target_gaps(predicted), alphas, batches).collect()
    }
    pdf, apdf = predicted.toPandas(), alphas.toPandas()
    curve = {leaf: part.sort_values("pos")["alpha"].to_numpy() for leaf, part in apdf.groupby("leaf_id")}
    hits = {}
    for q, part in pdf.groupby("query_id"):
        target = part.loc[part["lnn"].idxmin(), "leaf_id"]
        order = part.sample(frac=1, random_state=int(q)).to_dict("records")
        hits[q] = np.zeros(len(curve[0]), dtype=bool)
        for pos in range(len(curve[0])):
            bsf = np.inf
            for row in order:
                bsf = min(bsf, row["lnn"])
                if row["leaf_id"] == target:
                    hits[q][pos] = row["pred"] - curve[target][pos] <= bsf
                    break
    # The simulation lowers bsf with the true distance before it tests the target.
    pb = batches.toPandas()
    for batch, part in pb.groupby("batch_id"):
        want = np.mean([hits[q] for q in part["query_id"]], axis=0)
        assert np.allclose([got[(batch, p)] for p in range(len(want))], want)


def test_coverage_and_pairs(spark, predicted):
    batches = B.balanced_batches(predicted.select("query_id").distinct(), 6, 15)
    rows = R.recall_by_position(
        R.target_gaps(predicted), C.conformal_alphas(C.residuals(predicted)), batches
    )
    covered = R.with_coverage(rows).toPandas()
    for _, part in covered.groupby("pos"):
        want = [(part["recall"] >= r).mean() for r in part["recall"]]
        assert np.allclose(part["coverage"], want)
    pairs = R.unique_pairs(R.with_coverage(rows)).toPandas()
    assert not pairs.duplicated(["recall", "coverage"]).any()


def test_rising_curve(spark, rng):
    r = np.sort(rng.uniform(0, 1, 30))
    r[5:9] = r[5]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(r)], "pos int, recall double")
    got = R.rising_recall_curve(df).orderBy("pos").toPandas()["recall"].to_numpy()
    want = r.copy()
    want[-1] = 1 - 1e-4
    for i in range(len(want) - 2, -1, -1):
        want[i] = min(want[i], want[i + 1] - 1e-4)
    assert np.allclose(got, want)


@pytest.mark.parametrize("n,n_batches,size", [(7, 3, 5), (50, 4, 5), (10, 10, 10)])
def test_balanced_batches(spark, n, n_batches, size):
    got = B.balanced_batches(spark.range(n).withColumnRenamed("id", "query_id"), n_batches, size).toPandas()
    assert len(got) == n_batches * size
    assert (got.groupby("batch_id").size() == size).all()
    uses = got.groupby("query_id").size().reindex(range(n), fill_value=0)
    assert uses.max() - uses.min() <= 1


@pytest.mark.parametrize("n,wanted", [(2, 5), (10, 5), (101, 7)])
def test_uniform_batches(spark, n, wanted):
    got = B.uniform_batches(spark.range(n).withColumnRenamed("id", "query_id"), wanted).toPandas()
    assert sorted(got["query_id"]) == list(range(n))
    sizes = got.groupby("batch_id").size()
    assert len(sizes) == max(1, min(wanted, n // 3))
    assert not got.duplicated(["batch_id", "slot"]).any()


def test_calibrate_to_target(spark, predicted):
    cal = calibrate(predicted, 10, 12)
    rows = flagged(cal.triples)
    assert set(rows.columns) == {"filter_id", "recall", "coverage", "error", "is_test"}
    low = {r["leaf_id"]: r["alpha"] for r in alpha_for_target(cal.triples, 0.5, 0.5).collect()}
    high = {r["leaf_id"]: r["alpha"] for r in alpha_for_target(cal.triples, 0.99, 0.99).collect()}
    assert len(low) == 5 and all(high[k] >= low[k] for k in low)


def test_replay_matches_a_loop(spark, rng):
    rows = []
    for q in range(30):
        for leaf in range(6):
            lb = float(rng.uniform(0, 4))
            lnn = lb + float(rng.uniform(0, 3))
            cal = None if leaf == 0 else max(0.0, lnn + float(rng.normal(0, 1)))
            rows.append((q, leaf, leaf == q % 6, lb, lnn, cal))
    df = spark.createDataFrame(
        rows, "query_id long, leaf_id long, is_resident boolean, lb double, lnn double, cal double"
    )
    got = {(r["query_id"], r["leaf_id"]): r["action"] for r in replay(df).collect()}
    for q in range(30):
        bsf = np.inf
        for row in sorted((r for r in rows if r[0] == q), key=lambda r: (not r[2], r[3], r[1])):
            _, leaf, home, lb, lnn, cal = row
            if home:
                action = "resident"
            elif lb >= bsf:
                action = "bound"
            elif cal is not None and cal > bsf:
                action = "filter"
            else:
                action = "visit"
            assert got[(q, leaf)] == action
            if action in ("resident", "visit"):
                bsf = min(bsf, lnn)


@pytest.mark.parametrize("model", [RIDGE, mlp(hidden=8, epochs=300)])
def test_per_leaf_models_learn(spark, rng, model):
    rows, features = [], []
    for q in range(120):
        f = rng.normal(size=4)
        features.append((q, [float(v) for v in f]))
        for leaf in (1, 2):
            y = 5 + f @ np.array([1.0, -2.0, 0.5, leaf])
            rows.append((q, leaf, "train" if q < 80 else "valid" if q < 100 else "calib", float(y)))
    facts = spark.createDataFrame(rows, "query_id long, leaf_id long, role string, lnn double")
    feats = spark.createDataFrame(features, "query_id long, features array<double>")
    weights = fit_per_leaf(facts.where("role != 'calib'"), feats, model)
    out = predict_per_leaf(facts.where("role = 'calib'"), feats, weights, model).toPandas()
    assert len(out) == 40
    assert np.sqrt(((out["pred"] - out["lnn"]) ** 2).mean()) < 0.8


def test_allocation(spark):
    leaf = spark.createDataFrame([(1, 100), (2, 50), (3, 9)], "leaf_id long, n long")
    prune = spark.createDataFrame([(1, 0.5), (2, 0.0), (3, 0.0)], "leaf_id long, lb_prune double")
    models = [CandidateModel("a", 0.5, 20.0, 1.0), CandidateModel("b", 0.9, 60.0, 2.0)]
    gains = {r["leaf_id"]: (r["model"], r["gain"]) for r in filter_gains(leaf, prune, models, 1.0).collect()}
    assert gains[1][0] == "a" and abs(gains[1][1] - 100 * 0.25 * 0.8) < 1e-9
    assert gains[3][1] == 0.0
    table = filter_gains(leaf, prune, models, 1.0)
    active = {r["leaf_id"]: r["active"] for r in allocate(table, leaf, 1.5).collect()}
    assert active == {1: True, 2: False, 3: False}
    by_size = {r["leaf_id"]: r["active"] for r in allocate(table.withColumn("gain", F.lit(0.0)), leaf, 9.0, 40).collect()}
    assert by_size == {1: True, 2: True, 3: False}
    off = deactivate(allocate(table, leaf, 9.0), leaf.where("leaf_id = 1"))
    assert not off.where("leaf_id = 1").first()["active"]


def test_combined_scores(spark):
    s = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.3), (0, 3, 0.5)], "query_id long, leaf_id long, score double")
    b = spark.createDataFrame([(0, 2, 1.0), (0, 3, 3.0)], "query_id long, leaf_id long, lb double")
    got = {r["leaf_id"]: r["score"] for r in combined_scores(s, b, 0.2).collect()}
    assert abs(got[2] - (0.2 * 0.5 + 0.8)) < 1e-12 and abs(got[3] - 0.2) < 1e-12


def test_report_with_few_queries(spark):
    df = spark.createDataFrame([(i, 1.0 if i else 0.5) for i in range(7)], "query_id long, recall double")
    rows = R.batch_report(df, 0.9).collect()
    assert len(rows) == 1 and rows[0]["n_queries"] == 7
    out = R.search_report(df, 0.9, 1.0).first()
    assert out["recall_passed"] and out["coverage_passed"] and out["n_batches"] == 1


@pytest.mark.parametrize("rows", [1, 7, 1000])
@pytest.mark.parametrize("q", [0.0, 0.5, 0.85, 1.0])
def test_exact_quantile(spark, rng, rows, q):
    from driftleaf.operators.quantile import exact_quantile

    values = np.r_[rng.normal(size=rows), np.zeros(rows // 3)]
    df = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate(values)], "g long, v double")
    got = {r["g"]: r["m"] for r in exact_quantile(df, ["g"], "v", q, "m").collect()}
    for g in got:
        assert abs(got[g] - np.quantile(values[g::2], q)) < 1e-12


def test_hash_place_numbers_every_row_once(spark):
    rows = B.hash_place(spark.range(1000), "s", "id").toPandas()
    assert sorted(rows["place"]) == list(range(1000))
    again = B.hash_place(spark.range(1000).repartition(7), "s", "id").toPandas()
    assert rows.sort_values("id")["place"].tolist() == again.sort_values("id")["place"].tolist()


def test_line_of_a_leaf_whose_bounds_do_not_vary(spark):
    """The twins' line is the query's: a leaf with equal bounds, or one row, gets its mean."""
    import duckdb

    from catalog.sql_parts import MODEL
    from driftleaf.models.fits import fit_linear

    rows = [(1, 0.0, 2.0), (1, 0.0, 4.0), (2, 0.1, 1.0), (2, 0.1, 5.0), (2, 0.1, 9.0), (3, 7.0, 2.5), (4, 1.0, 1.0), (4, 3.0, 5.0)]
    got = fit_linear(spark.createDataFrame(rows, "leaf_id long, lb double, lnn double")).collect()
    values = ", ".join(f"({leaf}, {lb}::DOUBLE, {lnn}::DOUBLE, 'train')" for leaf, lb, lnn in rows)
    facts = f"facts AS (SELECT * FROM (VALUES {values}) t(leaf_id, lb, lnn, role))"
    want = duckdb.sql(f"WITH {facts}, {MODEL} SELECT leaf_id, slope, intercept FROM model ORDER BY 1").fetchall()
    assert want == [(1, 0.0, 3.0), (2, 0.0, 5.0), (3, 0.0, 2.5), (4, 2.0, -1.0)]
    assert sorted((r["leaf_id"], r["slope"], r["intercept"]) for r in got) == want
