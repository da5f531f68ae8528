import numpy as np
import pytest
from pyspark.sql import functions as F

from driftleaf.operators.bounds import leaf_bounds
from driftleaf.operators.facts import leaf_top_k, with_kth_before_visit
from driftleaf.operators.sampling import draw_members, global_queries, local_queries, random_rows
from driftleaf.operators.scan import nearest, scan, top_k
from driftleaf.plans.index import (
    append_to_index,
    build_index,
    index_by_key,
    leaf_size_mismatches,
    load_index,
    save_index,
)
from driftleaf.plans import versions
from driftleaf.plans.search import knn_exact, knn_filtered, knn_pruned, within_budget
from driftleaf.plans.train import collect_facts
from driftleaf.settings import IndexOptions
from driftleaf.session import new_work_path
from tests.conftest import answers, brute_knn, frame


def hot_copies(rng, n=300, length=16):
    """A third of the rows are copies of one series."""
    x = rng.normal(size=(n, length))
    x[: n // 3] = x[0]
    return x


def test_nearest_breaks_ties_by_id():
    x = np.zeros((50, 4))
    ids = np.arange(50)[::-1].copy()
    row, col, dist = nearest(np.zeros((2, 4)), x, ids, 3)
    assert list(ids[col]) == [0, 1, 2, 0, 1, 2] and not dist.any() and list(row) == [0, 0, 0, 1, 1, 1]


@pytest.mark.parametrize("k", [1, 5, 400])
def test_full_scan_against_brute_force(spark, rng, k):
    x = hot_copies(rng)
    q = np.vstack([x[:3] + 0.0, rng.normal(size=(5, 16))])
    got = answers(knn_exact(frame(spark, x).repartition(5), frame(spark, q, "query_id"), k))
    assert got == brute_knn(x, q, k)


def test_shuffled_scan_gives_the_same(spark, rng, small_broadcast):
    x = hot_copies(rng)
    q = np.vstack([x[:3], rng.normal(size=(5, 16))])
    got = answers(knn_exact(frame(spark, x).repartition(5), frame(spark, q, "query_id"), 4))
    assert got == brute_knn(x, q, 4)


def test_shuffled_scan_cuts_hot_leaves(spark, rng, small_broadcast, monkeypatch):
    from driftleaf.operators import scan as module

    monkeypatch.setattr(module, "BLOCK_ROWS", 32)
    monkeypatch.setattr(module, "QUERY_BLOCK_ROWS", 3)
    x = hot_copies(rng)
    q = np.vstack([x[:3], rng.normal(size=(7, 16))])
    leaf = [0 if i < 200 else 1 for i in range(len(x))]
    members = frame(spark, x, leaf_id=leaf)
    queries = frame(spark, q, "query_id")
    pairs = spark.createDataFrame([(i, j) for i in range(10) for j in (0, 1)], "query_id long, leaf_id long")
    assert answers(top_k(scan(members, queries, 3, pairs=pairs), 3)) == brute_knn(x, q, 3)
    per_leaf = leaf_top_k(members, queries, 2)
    assert per_leaf.count() == 10 * 2 * 2


@pytest.mark.parametrize("options", [
    IndexOptions(leaf_size=40),
    IndexOptions(leaf_size=7),
    IndexOptions(leaf_size=40, n_children=3),
    IndexOptions(leaf_size=40, n_children=3),
    IndexOptions(leaf_size=5, rows_per_file=50),
])
def test_pruned_search_equals_full_scan(spark, rng, options):
    x = hot_copies(rng)
    x[100:200] += rng.normal(size=(100, 1)) * 4
    q = np.vstack([x[:2], rng.normal(size=(6, 16)), x[150:152] + 0.01])
    index = build_index(frame(spark, x), options)
    assert leaf_size_mismatches(index).count() == 0
    sizes = {r["leaf_id"]: r["n"] for r in index.leaf.collect()}
    assert sum(sizes.values()) == len(x)
    copies = index.members.where(F.col("series_id") == 0).first()["leaf_id"]
    assert all(n <= options.leaf_size for leaf, n in sizes.items() if leaf != copies)
    got = answers(knn_pruned(index, frame(spark, q, "query_id"), 4))
    assert got == brute_knn(x, q, 4)


def test_pruned_search_shuffled(spark, rng, small_broadcast):
    x = hot_copies(rng)
    q = np.vstack([x[:2], rng.normal(size=(6, 16))])
    index = build_index(frame(spark, x), IndexOptions(leaf_size=40))
    assert answers(knn_pruned(index, frame(spark, q, "query_id"), 4)) == brute_knn(x, q, 4)


def test_bounds_never_exceed_distances(spark, rng):
    x = rng.normal(size=(200, 20))
    q = np.vstack([x[:10] + 1e-6, rng.normal(size=(10, 20))])
    queries = frame(spark, q, "query_id")
    index = build_index(frame(spark, x), IndexOptions(leaf_size=10))
    facts = collect_facts(index, queries)
    assert facts.count() == 20 * index.leaf.count()
    assert facts.where(F.col("lb") > F.col("lnn") + 1e-7).count() == 0
    assert facts.where("is_resident").count() == 20
    assert facts.where(F.col("bsf").isNull()).count() == 20


def test_joined_bounds_equal_shipped_bounds(spark, rng):
    x, q = rng.normal(size=(120, 20)), rng.normal(size=(9, 20))
    index = build_index(frame(spark, x), IndexOptions(leaf_size=10))
    queries = frame(spark, q, "query_id").withColumn("kth", F.lit(4.0))
    a = {(r[0], r[1]): round(r[2], 9) for r in leaf_bounds(queries, index.leaf, "kth").collect()}
    spark.conf.set("spark.driftleaf.broadcastBytes", "64")
    b = {(r[0], r[1]): round(r[2], 9) for r in leaf_bounds(queries, index.leaf, "kth").collect()}
    spark.conf.unset("spark.driftleaf.broadcastBytes")
    assert a == b and a


def test_append_and_load(spark, rng):
    x = rng.normal(size=(240, 16))
    q = rng.normal(size=(5, 16))
    index = build_index(frame(spark, x[:150]), IndexOptions(leaf_size=30))
    index = append_to_index(index, frame(spark, x[150:] * 2, start=150))
    x[150:] *= 2
    assert load_index(spark, index.path, check=True).members.count() == 240
    assert answers(knn_pruned(index, frame(spark, q, "query_id"), 3)) == brute_knn(x, q, 3)
    broken = save_index(index, new_work_path(spark, "broken"))
    more = versions.write_part(broken.nodes.withColumn("n", F.col("n") + 1), broken.path, "tree")
    versions.commit(spark, broken.path, {"tree": [more]})
    with pytest.raises(ValueError):
        load_index(spark, broken.path, check=True)
    assert load_index(spark, broken.path, check=True, version=1).members.count() == 240


def test_sketch_index_answers_approximately(spark, rng):
    x = rng.normal(size=(200, 16))
    rows = frame(spark, x).withColumn("sketch", F.slice("values", 1, 8))
    index = build_index(rows, IndexOptions(leaf_size=40), route_column="sketch")
    assert not index.exact_bounds
    q = frame(spark, x[:4], "query_id").withColumn("sketch", F.slice("values", 1, 8))
    got = answers(knn_pruned(index, q, 1))
    assert {i: a[0][0] for i, a in got.items()} == {0: 0, 1: 1, 2: 2, 3: 3}


def test_filtered_search_recall_grows_with_the_margin(spark, rng):
    x, q = rng.normal(size=(300, 16)), rng.normal(size=(20, 16))
    members, queries = frame(spark, x, leaf_id=[i % 6 for i in range(300)]), frame(spark, q, "query_id")
    index = index_by_key(members, 16)
    home = queries.select("query_id", (F.col("query_id") % 6).alias("leaf_id"))
    truth, last = brute_knn(x, q, 1), -1.0
    for alpha in (0.0, 1.0, 2.0, 50.0):
        pred = queries.select("query_id").join(index.leaf.select("leaf_id")).select(
            "query_id", "leaf_id", F.lit(5.0).alias("pred"), F.lit(alpha).alias("alpha")
        )
        got = answers(knn_filtered(index, queries, 1, pred, home))
        recall = np.mean([got[i][0] == truth[i][0] for i in truth])
        assert recall >= last
        last = recall
    assert last == 1.0


def test_kth_before_visit(spark, rng):
    x, q = rng.normal(size=(60, 8)), rng.normal(size=(4, 8))
    leaf = [i % 5 for i in range(60)]
    members, queries = frame(spark, x, leaf_id=leaf), frame(spark, q, "query_id")
    index = index_by_key(members, 8)
    facts = collect_facts(index, queries, queries.select("query_id", F.lit(2).cast("long").alias("leaf_id")))
    got = with_kth_before_visit(facts.drop("bsf"), leaf_top_k(members, queries, 3), 3).collect()
    leaf = np.array(leaf)
    for qi in range(4):
        rows = sorted((r for r in got if r["query_id"] == qi), key=lambda r: (not r["is_resident"], r["lb"], r["leaf_id"]))
        seen = []
        for r in rows:
            want = sorted(seen)[2] if len(seen) >= 3 else None
            assert (r["bsf"] is None) == (want is None)
            assert want is None or abs(r["bsf"] - want) < 1e-9
            seen += list(np.sqrt(((x[leaf == r["leaf_id"]] - q[qi]) ** 2).sum(1)))


def test_budget(spark):
    rows = spark.createDataFrame(
        [(0, 1, 10, 0.1), (0, 2, 20, 0.2), (0, 3, 30, 0.3), (1, 1, 10, 0.5)],
        "query_id long, leaf_id long, n long, lb double",
    )
    order = [F.asc("lb")]
    assert within_budget(rows, order, 2, None).count() == 3
    assert within_budget(rows, order, None, 30).count() == 3
    assert within_budget(rows, order, None, 31).count() == 4


def test_draws_and_synthetic_queries(spark, rng):
    x = rng.normal(size=(2000, 8))
    members = frame(spark, x, leaf_id=[i % 4 for i in range(2000)])
    few = draw_members(members, 50, "s").select("series_id", "draw").collect()
    everything = sorted(draw_members(members, 2000, "s").select("draw", "series_id").collect())
    assert sorted(r["series_id"] for r in few) == sorted(r["series_id"] for r in everything[:50])
    twice = draw_members(members.limit(30), 75, "s").groupBy("series_id").count().collect()
    assert len(twice) == 30 and {r["count"] for r in twice} == {2, 3}
    q = global_queries(members, 40, seed="t").toPandas()
    assert sorted(q["query_id"]) == list(range(40))
    z = np.stack(q["values"])
    assert np.allclose(z.mean(1), 0, atol=1e-9) and np.allclose(z.std(1), 1)
    assert random_rows(members, "series_id", 7, "s").count() == 7


def test_local_queries_stay_near(spark, rng):
    x = rng.normal(size=(80, 16))
    members = frame(spark, x, leaf_id=[i % 2 for i in range(80)])
    index = index_by_key(members, 16)
    stats = spark.createDataFrame([(0, 3.0, 1.0), (1, 0.5, 1.0)], "leaf_id long, mean_lnn double, std_lnn double")
    got = local_queries(members, index.leaf, stats, 5, 0.05, 0.3).toPandas()
    assert set(got["leaf_id"]) <= {0} and len(got) <= 5 and (got["lnn"] <= 2.0).all()
