"""Versions of an index and the filters saved with it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftleaf.models.fits import fit_linear
from driftleaf.operators.conformal import conformal_alphas, residuals
from driftleaf.models.fits import predict_linear
from driftleaf.plans import filters, versions
from driftleaf.plans.index import build_index, load_index, save_index, save_with_index
from driftleaf.plans.search import knn_filtered
from driftleaf.plans.train import collect_facts, with_roles
from driftleaf.session import new_work_path
from driftleaf.settings import IndexOptions
from tests.conftest import answers, frame


@pytest.fixture(scope="module")
def learned(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16)) + rng.integers(0, 4, (300, 1)) * 3.0
    q = x[:60] + rng.normal(size=(60, 16)) * 0.3
    index = build_index(frame(spark, x), IndexOptions(leaf_size=60))
    queries = frame(spark, q, "query_id")
    facts = with_roles(collect_facts(index, queries), 60)
    lines = fit_linear(facts.where("role = 'train'"))
    held = predict_linear(facts.where("role = 'calib'"), lines)
    return index, queries, facts, lines, conformal_alphas(residuals(held))


def saved_copy(spark, learned):
    index, _, _, lines, alphas = learned
    return filters.save_filters(save_index(index, new_work_path(spark, "saved")), lines, alphas)


def test_filtered_search_is_the_same_before_and_after_saving(spark, learned):
    index, queries, _, lines, alphas = learned
    copy = load_index(spark, saved_copy(spark, learned).path, check=True)
    index.tables.update(filter=lines.withColumn("active", F.lit(True)), alpha=alphas)
    want = answers(knn_filtered(index, queries, 3, filters.saved_predictions(index, queries, 0.5)))
    got = answers(knn_filtered(copy, queries, 3, filters.saved_predictions(copy, queries, 0.5)))
    assert got == want


def test_flags_and_retraining_change_only_what_they_name(spark, learned):
    index = saved_copy(spark, learned)
    facts = learned[2]
    some = index.leaf.orderBy("leaf_id").limit(2).select("leaf_id")
    chosen = {r[0] for r in some.collect()}
    lines = {r["leaf_id"]: (r["slope"], r["active"]) for r in index.tables["filter"].collect()}
    off = filters.deactivate_filters(index, some)
    assert {r["leaf_id"] for r in off.tables["filter"].where("NOT active").collect()} == chosen
    left = filters.saved_predictions(off, learned[1], 0.5).select("leaf_id").distinct()
    assert not chosen & {r[0] for r in left.collect()}
    again = filters.retrain_filters(off, facts.where("role <> 'calib'").join(some, "leaf_id"))
    fresh = {r["leaf_id"]: (r["slope"], r["active"]) for r in again.tables["filter"].collect()}
    assert fresh.keys() == lines.keys() and all(active for _, active in fresh.values())
    assert {leaf for leaf in lines if lines[leaf][0] != fresh[leaf][0]} == chosen
    only = filters.activate_filters(again, some)
    assert {r["leaf_id"] for r in only.tables["filter"].where("active").collect()} == chosen
    assert versions.history(spark, index.path) == [1, 2, 3, 4, 5]
    assert load_index(spark, index.path, version=2).tables["filter"].where("NOT active").count() == 0


def test_local_examples_accumulate(spark, learned):
    index = saved_copy(spark, learned)
    one = index.leaf.select("leaf_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("example_no")).withColumn(
        "lb", F.col("example_no") * 0.1).withColumn("lnn", F.col("lb") + 1.0)
    index = filters.append_examples(index, one.where("example_no < 5"))
    index = filters.append_examples(index, one.where("example_no >= 5"))
    rows = filters.with_local_examples(index, learned[2])
    counts = {(r["is_local"], r["role"]): r["count"] for r in rows.groupBy("is_local", "role").count().collect()}
    n = index.leaf.count()
    assert counts[True, "train"] == 8 * n and counts[True, "valid"] == 2 * n
    assert counts[False, "train"] == 20 * n and (False, "calib") not in counts


def test_a_writer_that_stops_leaves_the_old_version(spark, learned, monkeypatch):
    index = saved_copy(spark, learned)
    before = answers(knn_filtered(index, learned[1], 3, filters.saved_predictions(index, learned[1], 0.5)))

    def stop(*_):
        raise RuntimeError("stopped between the tables and the manifest")

    with monkeypatch.context() as patch:
        patch.setattr(versions, "commit", stop)
        with pytest.raises(RuntimeError):
            save_with_index(index, {"filter": index.tables["filter"].limit(0), "alpha": None})
    back = load_index(spark, index.path, check=True)
    assert answers(knn_filtered(back, learned[1], 3, filters.saved_predictions(back, learned[1], 0.5))) == before


def test_two_writers_of_one_version(spark, monkeypatch):
    path = new_work_path(spark, "versions")
    part = versions.write_part(spark.range(3).toDF("x"), path, "t")
    assert versions.commit(spark, path, {"t": [part]}) == 1
    real = versions.history
    monkeypatch.setattr(versions, "history", lambda *a: real(*a)[:1])
    outcome = []
    for n in (4, 5, 6):
        part = versions.write_part(spark.range(n).toDF("x"), path, "t")
        try:
            outcome.append(versions.commit(spark, path, {"t": [part]}))
        except ValueError:
            outcome.append(None)
    assert outcome[0] == 2
    held = versions.read(spark, path, versions.parts_of(spark, path)["t"]).count()
    assert held in {n for n, version in zip((4, 5, 6), outcome) if version == 2}


def test_reserved_and_unknown(spark, learned):
    index = saved_copy(spark, learned)
    with pytest.raises(ValueError):
        save_with_index(index, {"tree": index.leaf})
    with pytest.raises(ValueError):
        load_index(spark, new_work_path(spark, "nothing"))
    with pytest.raises(ValueError):
        load_index(spark, index.path, version=99)
