"""The node table: growth in two steps, routing, descent by bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftleaf.operators.descent import descend, descend_by_join, expanded_levels, nodes_met
from driftleaf.operators.tree import NODE_BITS, Nodes
from driftleaf.plans.index import append_to_index, build_index, leaf_size_mismatches
from driftleaf.plans.search import candidates, knn_in_rounds, knn_pruned, seed_limits
from driftleaf.settings import IndexOptions
from tests.conftest import answers, brute_knn, frame


def drifting(rng, n=400, length=16):
    """Levels far apart, so that bounds prune whole subtrees."""
    return rng.normal(size=(n, length)) + rng.integers(0, 8, (n, 1)) * 6.0


def shape(index):
    """Sizes of the leaves, and the members of each, without regard to ids."""
    rows = index.members.groupBy("leaf_id").agg(F.sort_array(F.collect_list("series_id")).alias("ids")).collect()
    return sorted(tuple(r["ids"]) for r in rows)


@pytest.mark.parametrize("fan, subtree_rows", [(2, 60), (3, 10_000)])
def test_growth_in_tasks_equals_growth_by_levels(spark, rng, fan, subtree_rows):
    x = drifting(rng)
    x[50:150] = x[50]
    options = IndexOptions(leaf_size=20, n_children=fan)
    whole = build_index(frame(spark, x), IndexOptions(leaf_size=20, n_children=fan, subtree_rows=1))
    assert whole.nodes.where(F.col("node_id") >= 1 << NODE_BITS).count() == 0
    mixed = build_index(frame(spark, x).repartition(3), IndexOptions(leaf_size=20, n_children=fan, subtree_rows=subtree_rows))
    assert shape(mixed) == shape(whole) and mixed.options.leaf_size == options.leaf_size
    assert leaf_size_mismatches(mixed).count() == 0
    ids = [r[0] for r in mixed.nodes.select("node_id").collect()]
    assert len(ids) == len(set(ids))


def test_tree_deeper_than_any_id_of_a_heap(spark):
    """Each split parts one or two series from the rest."""
    x = np.outer(2.0 ** np.arange(150), np.ones(8))
    index = build_index(frame(spark, x), IndexOptions(leaf_size=1, subtree_rows=140))
    assert index.leaf.agg(F.max("depth"), F.max("n"), F.sum("n")).first()[:] == (100, 1, 150)
    q = x[[0, 70, 149]] * 1.01
    assert answers(knn_pruned(index, frame(spark, q, "query_id"), 2)) == brute_knn(x, q, 2)


def limited(spark, index, q, k=3):
    queries = frame(spark, q, "query_id")
    return seed_limits(index, queries, k, index.resident(queries))[1].select("query_id", "values", "kth")


def bounds_of(df):
    return {(r["query_id"], r["leaf_id"]): round(r["lb"], 9) for r in df.collect()}


@pytest.mark.parametrize("subtree_rows", [60])
def test_descent_by_join_equals_shipped_descent(spark, rng, subtree_rows):
    x, q = drifting(rng), drifting(rng, 12)
    index = build_index(frame(spark, x), IndexOptions(leaf_size=10, subtree_rows=subtree_rows))
    asked = limited(spark, index, q)
    assert bounds_of(descend(asked, index.shipped_nodes)) == bounds_of(descend_by_join(asked, index.nodes))


def test_nothing_below_a_far_node_is_met(spark, rng):
    x, q = drifting(rng), drifting(rng, 12)
    index = build_index(frame(spark, x), IndexOptions(leaf_size=10))
    asked = limited(spark, index, q)
    kth = {r["query_id"]: r["kth"] for r in asked.collect()}
    parent = {r["node_id"]: r["parent_id"] for r in index.nodes.collect()}
    fan = index.options.n_children
    kept = set()
    for level in expanded_levels(asked, index.nodes):
        for r in level.collect():
            assert r["lb"] <= kth[r["query_id"]] * (1 + 1e-6) + 1e-6
            assert parent[r["node_id"]] is None or (r["query_id"], parent[r["node_id"]]) in kept
            kept.add((r["query_id"], r["node_id"]))
    inner = {r[0] for r in index.nodes.where("NOT is_leaf").select("node_id").collect()}
    met = {r["query_id"]: r["met"] for r in nodes_met(asked, index.shipped_nodes).collect()}
    assert met == {i: 1 + fan * sum(1 for q_, node in kept if q_ == i and node in inner) for i in range(12)}
    assert sum(met.values()) < 0.5 * 12 * index.nodes.count()


def test_search_beyond_the_broadcast_budget(spark, rng, small_broadcast):
    x, q = drifting(rng), drifting(rng, 6)
    index = build_index(frame(spark, x), IndexOptions(leaf_size=20, subtree_rows=90))
    assert index.shipped_nodes is None
    assert answers(knn_pruned(index, frame(spark, q, "query_id"), 4)) == brute_knn(x, q, 4)


def test_routing_and_append_in_subtrees(spark, rng):
    x, more = drifting(rng), drifting(rng, 100) * 1.5
    index = build_index(frame(spark, x), IndexOptions(leaf_size=20, subtree_rows=90))
    routed = index.route(frame(spark, more, start=400))
    expected = {r["series_id"]: r["leaf_id"] for r in routed.collect()}
    stats = {tuple(r)[:4]: [round(v, 9) for v in tuple(r)[4:]] for r in index.path_stats(frame(spark, more)).collect()}
    spark.conf.set("spark.driftleaf.broadcastBytes", "64")
    try:
        again = build_index(frame(spark, x), IndexOptions(leaf_size=20, subtree_rows=90))
        assert {r["series_id"]: r["leaf_id"] for r in again.route(frame(spark, more, start=400)).collect()} == expected
        rows = again.path_stats(frame(spark, more)).collect()
        assert {tuple(r)[:4]: [round(v, 9) for v in tuple(r)[4:]] for r in rows} == stats
    finally:
        spark.conf.unset("spark.driftleaf.broadcastBytes")
    index = append_to_index(index, frame(spark, more, start=400), batch="b1")
    index = append_to_index(index, frame(spark, more, start=400), batch="b1")
    assert leaf_size_mismatches(index).count() == 0 and index.members.count() == 500
    q = drifting(rng, 6)
    assert answers(knn_pruned(index, frame(spark, q, "query_id"), 4)) == brute_knn(np.vstack([x, more]), q, 4)
    home = index.resident(frame(spark, q, "query_id"))
    assert candidates(index, limited(spark, index, q), home).join(home, ["query_id", "leaf_id"]).count() == 0


def test_inner_envelopes_hold_all_members(spark, rng):
    x = drifting(rng, 200)
    index = build_index(frame(spark, x), IndexOptions(leaf_size=15, subtree_rows=60))
    table = index.nodes.toArrow()
    nodes = Nodes(table, 2)
    rows = {r["node_id"]: r for r in table.to_pylist()}
    at = nodes.node_ids[nodes.route(x)]
    for i, node in enumerate(at.tolist()):
        while node is not None:
            for s in rows[node]["seg"]:
                part = x[i, s["off"] : s["off"] + s["len"]]
                assert s["min_mean"] - 1e-12 <= part.mean() <= s["max_mean"] + 1e-12
                assert s["min_std"] - 1e-12 <= part.std() <= s["max_std"] + 1e-12
            node = rows[node]["parent_id"]


def test_rounds_read_fewer_series(spark, rng):
    """On drifting levels the first leaves are near, and the distance they give drops most others."""
    x = drifting(rng, 600)
    q = x[:10] + rng.normal(size=(10, 16)) * 2.0
    index = build_index(frame(spark, x), IndexOptions(leaf_size=10))
    queries = frame(spark, q, "query_id")
    home = index.resident(queries)
    got, read = knn_in_rounds(index, queries, 3, resident=home)
    assert answers(got) == brute_knn(x, q, 3)
    sizes = index.leaf.select("leaf_id", "n")
    in_rounds = read.join(sizes, "leaf_id").agg(F.sum("n")).first()[0]
    at_once = candidates(index, limited(spark, index, q), home).select("query_id", "leaf_id").unionByName(home)
    assert read.groupBy("query_id", "leaf_id").count().where("count > 1").count() == 0
    assert in_rounds < 0.8 * at_once.join(sizes, "leaf_id").agg(F.sum("n")).first()[0]


def test_rounds_with_filters(spark, rng):
    """A filter that allows a leaf only in the light of the distance found so far."""
    x = drifting(rng, 300)
    q = x[:6] + rng.normal(size=(6, 16))
    index = build_index(frame(spark, x), IndexOptions(leaf_size=10))
    queries = frame(spark, q, "query_id")
    every = queries.select("query_id").join(index.leaf.select("leaf_id"))
    open_all = every.withColumn("pred", F.lit(1.0)).withColumn("alpha", F.lit(5.0))
    assert answers(knn_in_rounds(index, queries, 2, open_all)[0]) == brute_knn(x, q, 2)
    closed = every.withColumn("pred", F.lit(1e9)).withColumn("alpha", F.lit(0.0))
    _, read = knn_in_rounds(index, queries, 2, closed)
    assert read.where("round > 0").join(queries, "query_id").count() == 0 or read.agg(F.max("round")).first()[0] <= 1
