"""Exchange files hold every position and target, not those of one twin."""

import pytest

import __spark_entry__ as entry
from catalog import feeds
from driftleaf.sources import tables as T
from tests.test_catalog import FOLDER, duck, ordered, plain, pytestmark  # noqa: F401


@pytest.fixture()
def written(monkeypatch):
    """Paths that a writer of ``tables`` was given."""
    paths = []

    def watch(name):
        write = getattr(T, name)
        monkeypatch.setattr(T, name, lambda df, path, *more: (paths.append(path), write(df, path, *more))[1])
        return paths

    return watch


def same_as_twin(spark, duck, name):  # noqa: F811
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = ordered([tuple(plain(r[c]) for c in columns) for r in df.collect()])
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = ordered([tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()])
    assert got and got == want
    return df


def test_wide_file_holds_all_positions(spark, duck, written):  # noqa: F811
    paths = written("write_wide")
    same_as_twin(spark, duck, "wide_export")
    margins = feeds.alphas(spark, FOLDER)
    first = margins.agg({"leaf_id": "min"}).first()[0]
    want = sorted(r["pos"] for r in margins.where(margins.leaf_id == first).collect())
    header = spark.read.csv(paths[0], header=True).columns
    assert [c for c in header if c.startswith("recall ")] == [f"recall {p}" for p in want]
    assert len(want) > 4
    every = same_as_twin(spark, duck, "wide_export_all")
    assert sorted(r["pos"] for r in every.select("pos").distinct().collect()) == want


def test_error_files_hold_all_targets(spark, duck, written):  # noqa: F811
    paths = written("write_errors")
    same_as_twin(spark, duck, "error_files")
    pool = feeds.pool(spark, FOLDER)
    want = {(r["recall"], r["coverage"]) for r in pool.select("recall", "coverage").distinct().collect()}
    rows = spark.read.csv(paths[0], header=True, inferSchema=True)
    assert {(r["recall"], r["coverage"]) for r in rows.select("recall", "coverage").distinct().collect()} == want
    assert rows.count() == pool.count() and len(want) == 99
    assert same_as_twin(spark, duck, "error_files_all").count() == 99
