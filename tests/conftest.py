import pathlib
import sys

import numpy as np
import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from driftleaf.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def rng():
    return np.random.default_rng(11)


@pytest.fixture()
def small_broadcast(spark):
    """Force the shuffled strategies."""
    spark.conf.set("spark.driftleaf.broadcastBytes", "64")
    yield
    spark.conf.unset("spark.driftleaf.broadcastBytes")


def frame(spark, matrix, id_column="series_id", start=0, **columns):
    rows = [
        (start + i, [float(v) for v in row], *[c[i] for c in columns.values()])
        for i, row in enumerate(matrix)
    ]
    schema = f"{id_column} long, values array<double>"
    for name in columns:
        schema += f", {name} long"
    return spark.createDataFrame(rows, schema)


def brute_knn(series, queries, k):
    """{query: [(series, distance)]}, ties by id."""
    out = {}
    for qi, q in enumerate(queries):
        d = np.sqrt(((series - q) ** 2).sum(1))
        order = np.lexsort((np.arange(len(d)), d))[:k]
        out[qi] = [(int(i), round(float(d[i]), 9)) for i in order]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["series_id"], round(r["dist"], 9)))
    return out
