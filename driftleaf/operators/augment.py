"""Compaction and augmentation of (recall, coverage, error) triples, and their features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftleaf.session import materialise

# Fixed values of the augmentation.
PULLED_COVERAGE = 0.9995
TOP_FACTOR = 3.0
STEP_PERCENT = 1
EXTREMES = ((0.999, 3.0), (0.9999, 5.0))
OTHER_EXTREME_FACTOR = 2.0


def unpivot_wide(wide: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Turn repeated groups of columns that start with ``recall``, ``cov`` and ``actual error``
    into rows (keys..., col_group, recall, coverage, error)."""
    keys = keys or []

    def starting(prefix: str) -> list[str]:
        return [c for c in wide.columns if c.startswith(prefix) and c not in keys]

    groups = list(zip(starting("recall"), starting("cov"), starting("actual error")))
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("col_group"),
                F.col(f"`{r}`").cast("double").alias("recall"),
                F.col(f"`{c}`").cast("double").alias("coverage"),
                F.col(f"`{e}`").cast("double").alias("error"),
            )
            for i, (r, c, e) in enumerate(groups)
        ]
    )
    return wide.select(*keys, F.explode(entries).alias("g")).select(*keys, "g.*")


def compact(raw: DataFrame, precision: int = 6) -> DataFrame:
    """(filter_id, recall, coverage, error): one row per rounded pair; its error is the largest
    error anywhere in the column groups in which the pair occurs."""
    cells = raw.groupBy(
        "filter_id",
        "col_group",
        F.round("recall", precision).alias("recall"),
        F.round("coverage", precision).alias("coverage"),
    ).agg(F.max("error").alias("error"))
    anywhere = F.max("error").over(Window.partitionBy("filter_id", "col_group"))
    complete = (
        F.col("recall").isNotNull() & F.col("coverage").isNotNull() & F.col("error").isNotNull()
    )
    return (
        cells.withColumn("largest", anywhere)
        .where(complete)
        .groupBy("filter_id", "recall", "coverage")
        .agg(F.max("largest").alias("error"))
    )


def sentinel_error(error: Column, method: str, factor: float) -> Column:
    if method == "exponential":
        return error * math.exp(factor - 1)
    if method == "quadratic":
        return error * factor**2
    return error * factor


def coverage_sentinels(triples: DataFrame) -> DataFrame:
    """For each filter and recall: full coverage is pulled to 0.9995, the point (1, 3 e) is added
    above the largest coverage, and whole percents in between are filled linearly. Added rows
    carry ``is_new`` and are training rows."""
    pulled = triples.withColumn(
        "coverage",
        F.when(F.col("coverage") >= 1.0, F.lit(PULLED_COVERAGE)).otherwise(F.col("coverage")),
    )
    top = pulled.groupBy("filter_id", "recall").agg(
        F.max("coverage").alias("c0"), F.max_by("error", F.struct("coverage", "error")).alias("e0")
    )
    first = F.ceil((F.col("c0") + 0.01) / 0.01).cast("int")
    percents = F.when(
        first <= 99, F.sequence(first, F.lit(99))
    ).otherwise(F.expr("cast(array() as array<int>)"))
    ratio = (F.col("coverage") - F.col("c0")) / (1.0 - F.col("c0"))
    e1 = F.col("e0") * TOP_FACTOR
    added = (
        top.withColumn("p", F.explode(F.concat(percents, F.array(F.lit(100)))))
        .withColumn("coverage", F.col("p") / 100.0)
        .withColumn(
            "error",
            F.when(F.col("p") == 100, e1).otherwise(F.col("e0") + (e1 - F.col("e0")) * ratio),
        )
        .select("filter_id", "recall", "coverage", "error")
    )
    return _joined(pulled, added)


def extreme_sentinels(
    triples: DataFrame, coverages: tuple[float, ...] = tuple(c for c, _ in EXTREMES)
) -> DataFrame:
    """Add points at very high coverages with a multiple of the largest error of the recall."""
    factors = dict(EXTREMES)
    points = F.array(
        *[
            F.struct(
                F.lit(c).alias("coverage"), F.lit(factors.get(c, OTHER_EXTREME_FACTOR)).alias("f")
            )
            for c in coverages
        ]
    )
    added = (
        triples.groupBy("filter_id", "recall")
        .agg(F.max("error").alias("e"))
        .withColumn("x", F.explode(points))
        .select(
            "filter_id", "recall", F.col("x.coverage").alias("coverage"),
            (F.col("e") * F.col("x.f")).alias("error"),
        )
    )
    return _joined(triples, added)


def _joined(old: DataFrame, added: DataFrame) -> DataFrame:
    if "is_test" not in old.columns:
        old = old.withColumn("is_test", F.lit(0))
    if "is_new" not in old.columns:
        old = old.withColumn("is_new", F.lit(False))
    return old.unionByName(
        added.withColumn("is_test", F.lit(0)).withColumn("is_new", F.lit(True)),
        allowMissingColumns=True,
    ).withColumn("error", F.round("error", 6))


def added_rows(augmented: DataFrame, original: DataFrame) -> DataFrame:
    """Rows of the augmented table that the original does not have."""
    columns = ["filter_id", "recall", "coverage", "error"]
    return augmented.select(*columns).exceptAll(original.select(*columns))


def rank_curve(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """(by, column, _same): how often each value occurs; what ranks are read from."""
    return df.groupBy(*by, column).agg(F.count("*").alias("_same"))


def rank_on_curve(df: DataFrame, curve: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """Add the rank of ``column`` among the rows behind ``curve`` divided by their number: ties at
    their average, a value between two of the curve halfway, 1 above all, 0.5 where the curve holds at most one
    row. Ranks depend on the curve alone and come from distinct values, so no group is sorted row
    by row."""
    asked = df.select(*by, column).distinct().withColumn("_same", F.lit(0).cast("long"))
    values = curve.unionByName(asked).groupBy(*by, column).agg(F.sum("_same").alias("_same"))
    upto = (
        Window.partitionBy(*by)
        .orderBy(column)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranks = (
        values.withColumn("_upto", F.sum("_same").over(upto))
        .withColumn("_all", F.sum("_same").over(Window.partitionBy(*by)))
        .select(
            *by,
            column,
            F.when(F.col("_all") <= 1, 0.5)
            .otherwise(F.least(F.lit(1.0), (F.col("_upto") - (F.col("_same") - 1) / 2.0) / F.col("_all")))
            .alias(name),
        )
    )
    return df.join(ranks, [*by, column])


def percent_rank_average(df: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """Add the rank of ``column`` in its group divided by the group size, with ties at their average."""
    return rank_on_curve(df, rank_curve(df, by, column), by, column, name)


RANKED = ("recall", "coverage")


def rank_curves(triples: DataFrame) -> dict[str, DataFrame]:
    """The written curve of each filter in both axes."""
    return {c: materialise(rank_curve(triples, ["filter_id"], c), f"{c}_curve") for c in RANKED}


TINY = 1e-10


def surface_features(triples: DataFrame, curves: dict[str, DataFrame] | None = None) -> DataFrame:
    """Add the engineered features of (recall, coverage). Ranks are those on ``curves``, which a model
    keeps from its training rows, or among the given rows."""
    return engineered(with_ranks(triples, curves))


def with_ranks(triples: DataFrame, curves: dict[str, DataFrame] | None = None) -> DataFrame:
    """Add the ranks on both axes."""
    df = triples = materialise(triples, "triples")
    for c in RANKED:
        curve = curves[c] if curves else rank_curve(triples, ["filter_id"], c)
        df = rank_on_curve(df, curve, ["filter_id"], c, f"{c}_rank")
    return df


def engineered(df: DataFrame) -> DataFrame:
    """Add the features that follow from a row with its ranks."""
    r, c = F.col("recall"), F.col("coverage")

    def beta_score(b2: float) -> Column:
        return (1 + b2) * r * c / (b2 * r + c + TINY)

    return df.withColumns(
        {
            "recall_coverage_product": r * c,
            "recall_coverage_ratio": r / (c + TINY),
            "coverage_recall_ratio": c / (r + TINY),
            "recall_squared": r * r,
            "coverage_squared": c * c,
            "recall_cubed": r * r * r,
            "coverage_cubed": c * c * c,
            "log_recall": F.log(r + TINY),
            "log_coverage": F.log(c + TINY),
            "log_product": F.log(r + TINY) + F.log(c + TINY),
            "distance_to_perfect": F.sqrt((1 - r) * (1 - r) + (1 - c) * (1 - c)),
            "distance_to_origin": F.sqrt(r * r + c * c),
            "manhattan_distance_to_perfect": (1 - r) + (1 - c),
            "harmony_score": 1 - F.abs(r - c),
            "balance_score": F.least(r, c) / F.greatest(r, c),
            "rank_correlation": F.col("recall_rank") * F.col("coverage_rank"),
            "rank_difference": F.abs(F.col("recall_rank") - F.col("coverage_rank")),
            "exp_recall": F.exp(-r),
            "exp_coverage": F.exp(-c),
            "high_recall": (r > 0.95).cast("int"),
            "high_coverage": (c > 0.95).cast("int"),
            "both_high": ((r > 0.95) & (c > 0.95)).cast("int"),
            "very_high_recall": (r > 0.98).cast("int"),
            "very_high_coverage": (c > 0.98).cast("int"),
            "medium_recall": ((r > 0.9) & (r <= 0.95)).cast("int"),
            "medium_coverage": ((c > 0.9) & (c <= 0.95)).cast("int"),
            "recall_coverage_diff": r - c,
            "abs_recall_coverage_diff": F.abs(r - c),
            "harmonic_mean": 2 * r * c / (r + c + TINY),
            "geometric_mean": F.sqrt(r * c),
            "f1_score": 2 * r * c / (r + c + TINY),
            "f2_score": beta_score(4.0),
            "f0_5_score": beta_score(0.25),
            "recall_high_region": F.greatest(F.lit(0.0), r - 0.9),
            "coverage_high_region": F.greatest(F.lit(0.0), c - 0.9),
            "recall_extreme_high": F.greatest(F.lit(0.0), r - 0.95),
            "coverage_extreme_high": F.greatest(F.lit(0.0), c - 0.95),
        }
    )


# The names of the model features.
FEATURES = [
    "recall", "coverage", "recall_coverage_product", "recall_coverage_ratio",
    "coverage_recall_ratio", "recall_squared", "coverage_squared", "recall_cubed",
    "coverage_cubed", "log_recall", "log_coverage", "log_product", "distance_to_perfect",
    "distance_to_origin", "manhattan_distance_to_perfect", "harmony_score", "balance_score",
    "recall_rank", "coverage_rank", "rank_correlation", "rank_difference", "exp_recall",
    "exp_coverage", "high_recall", "high_coverage", "both_high", "very_high_recall",
    "very_high_coverage", "medium_recall", "medium_coverage", "recall_coverage_diff",
    "abs_recall_coverage_diff", "harmonic_mean", "geometric_mean", "f1_score", "f2_score",
    "f0_5_score", "recall_high_region", "coverage_high_region", "recall_extreme_high",
    "coverage_extreme_high",
]
