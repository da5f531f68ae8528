import numpy as np
from pyspark.sql import functions as F

from driftleaf.models.fits import query_features
from driftleaf.operators.facts import knn_residence, residence_share
from driftleaf.operators.navigation import TreeNavigator, _share_paths, fit_softmax, leaf_paths
from driftleaf.plans.index import build_index
from driftleaf.plans.search import knn_exact
from driftleaf.settings import IndexOptions
from tests.conftest import frame


def test_softmax_learns_shares(rng):
    x = rng.normal(size=(400, 3))
    truth = np.array([[2.0, 0, 0, 0.5], [0, -1.0, 0, 0], [0, 0, 0, 0]])
    logit = np.hstack([x, np.ones((400, 1))]) @ truth.T
    share = np.exp(logit) / np.exp(logit).sum(1, keepdims=True)
    w = fit_softmax(x, share, l2=1e-6, steps=3000)
    said = np.exp(np.hstack([x, np.ones((400, 1))]) @ w.T)
    assert np.abs(said / said.sum(1, keepdims=True) - share).max() < 0.02


def test_shares_along_the_tree(spark, rng):
    """Shares sum to 1, also below a floor they are never more, and the leaf of a near member comes early."""
    x = rng.normal(size=(400, 16)) + rng.integers(0, 6, (400, 1)) * 5.0
    index = build_index(frame(spark, x), IndexOptions(leaf_size=40, n_children=3))
    train = frame(spark, x[:150] + rng.normal(size=(150, 16)) * 0.3, "query_id")
    asked = frame(spark, x[150:190] + rng.normal(size=(40, 16)) * 0.3, "query_id")
    paths = leaf_paths(index.nodes)
    depth = {r["node_id"]: r["depth"] for r in index.nodes.where("is_leaf").collect()}
    assert {r["leaf_id"]: r["count"] for r in paths.groupBy("leaf_id").count().collect()} == {k: v for k, v in depth.items() if v}
    shares = residence_share(knn_residence(knn_exact(index.members, train, 3)), 3)
    navigator = TreeNavigator.fit(shares, query_features(train, 16), index.nodes, 3)
    scores = navigator.scores(query_features(asked, 16))
    assert scores.count() == 40 * len(depth)
    totals = [r["t"] for r in scores.groupBy("query_id").agg(F.sum("score").alias("t")).collect()]
    assert np.allclose(totals, 1.0)
    best = scores.groupBy("query_id").agg(F.max_by("leaf_id", "score").alias("leaf_id"))
    assert best.join(index.resident(asked), ["query_id", "leaf_id"]).count() >= 20
    cut = navigator.scores(query_features(asked, 16), least=0.01)
    assert cut.count() < scores.count() and cut.where("score < 0.01").count() == 0


def test_tree_of_one_leaf(spark, rng):
    index = build_index(frame(spark, rng.normal(size=(5, 16))), IndexOptions(leaf_size=40))
    q = frame(spark, rng.normal(size=(3, 16)), "query_id")
    shares = q.select("query_id", F.lit(1).cast("long").alias("leaf_id"), F.lit(1.0).alias("share"))
    navigator = TreeNavigator.fit(shares, query_features(q, 16), index.nodes, 2)
    assert {tuple(r) for r in navigator.scores(query_features(q, 16)).collect()} == {(i, 1, 1.0) for i in range(3)}


def test_shipped_tree_gives_the_rows_of_the_joins(spark, rng):
    """Fits are dealt over the tasks, and a shipped tree gives the paths and scores of the joins."""
    x = rng.normal(size=(300, 16)) + rng.integers(0, 6, (300, 1)) * 5.0
    index = build_index(frame(spark, x), IndexOptions(leaf_size=20, n_children=3))
    train, asked = frame(spark, x[:100], "query_id"), frame(spark, x[100:120] + 0.1, "query_id")
    shares = residence_share(knn_residence(knn_exact(index.members, train, 3)), 3)
    features = query_features(train, 16)
    navigator = TreeNavigator.fit(shares, features, index.nodes, 3)
    files = navigator.weights.select(F.input_file_name()).distinct().count()
    assert files == 4, "nodes were fitted in one task"
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("shipped", "")
    got = {(r[0], r[1]): r[2] for r in navigator.scores(query_features(asked, 16), 1e-6).collect()}
    assert len(jobs.getJobIdsForGroup("shipped")) <= 8, "jobs grow with the depth of the tree"
    spark.sparkContext.setJobGroup("joined", "")
    paths = sorted((r[0], r[1], r[2], round(r[3], 9)) for r in _share_paths(shares, index.nodes, 3).collect())
    spark.conf.set("spark.driftleaf.broadcastBytes", "64")
    try:
        want = {(r[0], r[1]): r[2] for r in navigator.scores(query_features(asked, 16), 1e-6).collect()}
        joined = sorted((r[0], r[1], r[2], round(r[3], 9)) for r in _share_paths(shares, index.nodes, 3).collect())
    finally:
        spark.conf.unset("spark.driftleaf.broadcastBytes")
    assert paths == joined and got.keys() == want.keys()
    assert all(abs(got[key] - want[key]) < 1e-9 for key in got)
