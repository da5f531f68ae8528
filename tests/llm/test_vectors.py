import numpy as np
import pytest

from driftleaf.llm.exact_search import op3_exact_search, top_k
from driftleaf.llm.nearest import chi_square_cdf, chi_square_point, nearest, op7_nearest
from driftleaf.llm.sharded import grow_tree

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def brute(ids, x, queries, k, score):
    out = set()
    for q in queries:
        s = score(x, x[q])
        order = sorted((j for j in range(len(x)) if ids[j] != ids[q]), key=lambda j: (-s[j], ids[j]))[:k]
        out |= {(ids[q], r + 1, ids[j], round(float(s[j]), 9)) for r, j in enumerate(order)}
    return out


def answers(df):
    return {(r["query_id"], r["rank"], r["vec_id"], round(float(r["score"]), 9)) for r in df.collect()}


def cosine(x, q):
    return (x * q).sum(1) / np.sqrt((x * x).sum(1) * (q @ q))


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 6)).astype(np.float32)
    x[100:400] = x[100]
    x[400:405] = 0
    rows = [(i, [float(v) for v in r], "s", 1) for i, r in enumerate(x)]
    odd = [
        (2000, None, "s", 1), (2050, [1.0, None, 1.0], "s", 1), (2100, [float("nan")] * 6, "s", 1),
        (2150, [float("inf")] + [0.0] * 5, "s", 1), (2200, [], "s", 1), (None, [1.0] * 6, "s", 1), (2250, [1.0, 2.0], "s", 1),
    ]
    return x, spark.createDataFrame(rows + odd, SCHEMA)


def test_exact_search(vectors):
    x, df = vectors
    whole = np.floor(256 * x.astype(float))
    want = brute(list(range(900)), whole, range(0, 900, 50), 5, lambda a, b: a @ b)
    assert answers(op3_exact_search(df)) == want


def test_exact_search_over_many_shards(spark, vectors):
    x, _ = vectors
    whole = np.floor(256 * x.astype(float))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(whole)], "vec_id long, vec array<double>")
    got = answers(top_k(df, df.where("vec_id % 50 = 0"), 5, shard_rows=100, group_rows=5))
    assert got == brute(list(range(900)), whole, range(0, 900, 50), 5, lambda a, b: a @ b)


def test_nearest_recall_and_scores(spark, vectors):
    x, df = vectors
    x = x.astype(float)
    live = np.flatnonzero((x != 0).any(1))
    want = brute(live.tolist(), x[live], [i for i, j in enumerate(live) if j % 50 == 0], 5, cosine)
    got = answers(op7_nearest(df))
    assert len(got) == len(want)
    pairs = lambda rows: {(q, v) for q, _, v, _ in rows}
    assert len(pairs(got) & pairs(want)) >= 0.9 * len(want)
    for q, _, v, s in got:
        assert abs(s - cosine(x[[v]], x[q])[0]) < 1e-8
    few = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x) if i in live], "vec_id long, vec array<double>")
    many = answers(nearest(few, few.where("vec_id % 50 = 0"), 5, shard_rows=100, group_rows=5))
    assert len(pairs(many) & pairs(want)) >= 0.9 * len(want)


def test_nearest_recall_on_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], float)
    want = brute([r["vec_id"] for r in rows], x, [i for i, r in enumerate(rows) if r["vec_id"] % 50 == 0], 5, cosine)
    assert len(answers(op7_nearest(df)) & want) >= 0.9 * len(want)


def test_few_and_no_rows(spark):
    two = spark.createDataFrame([(0, [1.0, 0.0], "", 0), (1, [0.5, 0.5], "", 0)], SCHEMA)
    none = spark.createDataFrame([], SCHEMA)
    for operator in (op3_exact_search, op7_nearest):
        assert [(r["query_id"], r["rank"], r["vec_id"]) for r in operator(two).collect()] == [(0, 1, 1)]
        assert operator(none).count() == 0


def test_boxes_are_tight_and_cover(rng):
    points = rng.integers(0, 4, (500, 3)).astype(float)
    tree = grow_tree(points, np.arange(500), 16)
    assert sorted(tree.order) == list(range(500))
    for i, (a, b) in enumerate(zip(tree.start, tree.stop)):
        rows = points[tree.order[a:b]]
        assert (rows.min(0) == tree.low[i]).all() and (rows.max(0) == tree.high[i]).all()


def test_chi_square():
    assert abs(chi_square_cdf(7.344121497701792, 8) - 0.5) < 1e-9
    assert abs(chi_square_point(0.95, 8) - 15.507313055865453) < 1e-6
