import pytest
from pyspark.sql import functions as F

from driftleaf.operators.allocation import allocate_by_gain
from driftleaf.operators.running import with_running
from driftleaf.operators.sampling import every_nth_by_size


@pytest.mark.parametrize("rows", [0, 1, 500])
def test_running_sums_over_ranges(spark, rows):
    df = spark.range(rows).select("id", (F.col("id") % 7).alias("g"), (F.col("id") * 0.5).alias("v")).repartition(5)
    out = with_running(df, [F.desc("g"), F.asc("id")], {"total": F.col("v")}, number="place").collect()
    want, total = [], 0.0
    for place, i in enumerate(sorted(range(rows), key=lambda i: (-(i % 7), i))):
        total += i * 0.5
        want.append((place, i, total))
    assert sorted((r["place"], r["id"], r["total"]) for r in out) == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_task_sees_all_rows(spark):
    leaf = spark.range(200).select(F.col("id").alias("leaf_id"), (F.col("id") % 9 + 1).alias("n"), F.lit(1.0).alias("memory"),
                                   (F.col("id") % 11).cast("double").alias("gain"))
    chosen = allocate_by_gain(leaf, 50.0)
    assert chosen.count() == 50 and "SinglePartition" not in plan_of(chosen)
    sample = every_nth_by_size(leaf, 10)
    assert sample.count() == 10 and "SinglePartition" not in plan_of(sample)
