"""Error reports and regression metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftleaf.operators.quantile import exact_quantile
from driftleaf.session import materialise


def _err(pred: str, actual: str) -> Column:
    return F.col(pred) - F.col(actual)


def metric_columns(pred: str = "pred", actual: str = "actual", quantile: float = 0.85) -> list:
    """MSE, RMSE, MAE, safe ratio, pinball loss and empirical coverage."""
    e = _err(pred, actual)
    loss = F.greatest(-quantile * e, (1.0 - quantile) * e)
    return [
        F.count("*").alias("n"),
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg((e >= 0).cast("double")).alias("safe_ratio"),
        F.avg(loss).alias("quantile_loss"),
        F.avg((F.col(actual) <= F.col(pred)).cast("double")).alias("covered"),
    ]


def regression_metrics(df: DataFrame, by: list[str], quantile: float = 0.85) -> DataFrame:
    return df.groupBy(*by).agg(*metric_columns(quantile=quantile))


def fit_statistics(df: DataFrame, by: list[str]) -> DataFrame:
    """R2, ranges, means, safe ratio and the number of distinct predictions."""
    e = _err("pred", "actual")
    total = F.var_pop("actual") * F.count("*")
    return df.groupBy(*by).agg(
        (1.0 - F.sum(e * e) / F.when(total > 0, total)).alias("r2"),
        F.min("pred").alias("min_pred"),
        F.max("pred").alias("max_pred"),
        F.avg("pred").alias("mean_pred"),
        F.min("actual").alias("min_actual"),
        F.max("actual").alias("max_actual"),
        F.avg("actual").alias("mean_actual"),
        F.avg((e >= 0).cast("double")).alias("safe_ratio"),
        F.countDistinct("pred").alias("distinct_pred"),
    )


def enough_samples(df: DataFrame, min_train: int = 5, min_test: int = 2) -> DataFrame:
    """(filter_id) of filters with enough training and test rows."""
    return (
        df.groupBy("filter_id")
        .agg(
            F.count_if(F.col("is_test") == 0).alias("n_train"),
            F.count_if(F.col("is_test") == 1).alias("n_test"),
        )
        .where((F.col("n_train") >= min_train) & (F.col("n_test") >= min_test))
    )


def average_metrics(per_filter: DataFrame) -> DataFrame:
    """Means of per-filter metrics over the filters that have them, and how many have not."""
    return per_filter.agg(
        F.count("mse").alias("succeeded"),
        F.count_if(F.col("mse").isNull()).alias("failed"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("mse", "rmse", "mae", "safe_ratio")],
    )


def prediction_statistics(df: DataFrame) -> DataFrame:
    """Per (recall, coverage), over filters: counts and distribution of predicted and actual
    errors and how they differ. Rows without an actual error count only on the predicted side."""
    e = _err("pred", "actual")

    def spread(column: str) -> list[Column]:
        return [
            F.avg(column).alias(f"mean_{column}"),
            F.stddev_pop(column).alias(f"std_{column}"),
            F.var_pop(column).alias(f"var_{column}"),
            F.min(column).alias(f"min_{column}"),
            F.max(column).alias(f"max_{column}"),
        ]

    key = ["recall", "coverage"]
    df = materialise(df.select(*key, "pred", "actual"), "errors")
    stats = df.groupBy(*key).agg(
        F.count("pred").alias("n"),
        F.count("actual").alias("n_actual"),
        *spread("pred"),
        *spread("actual"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg((e >= 0).cast("double")).alias("safe_ratio"),
    )
    for column in ("pred", "actual"):
        middle = exact_quantile(df, key, column, 0.5, f"median_{column}")
        stats = stats.join(middle, key, "left")
    return stats


def pivot_statistic(stats: DataFrame, column: str, coverages: list[float]) -> DataFrame:
    """One row per recall and one column per coverage."""
    wide = stats.groupBy("recall").pivot("coverage", coverages).agg(F.first(column))
    return wide.toDF("recall", *[f"c_{str(c).replace('.', '_')}" for c in coverages])


#: The statistics that are reported as a table of recalls by coverages.
PIVOTED = ("mean_pred", "mean_actual", "mae", "rmse", "safe_ratio", "n")


def pivot_all(stats: DataFrame, coverages: list[float]) -> DataFrame:
    """The pivot tables of all ``PIVOTED`` statistics, one below the other: (statistic, recall, c_...)."""
    tables = [
        pivot_statistic(stats.withColumn(name, F.col(name).cast("double")), name, coverages).select(
            F.lit(name).alias("statistic"), "*"
        )
        for name in PIVOTED
    ]
    return reduce(DataFrame.unionByName, tables)


def error_summary(df: DataFrame, key: str, error: str, prefix: str) -> DataFrame:
    """Count, mean, max, sample deviation and min of the positive errors per key."""
    return (
        df.where(F.col(error) > 0)
        .groupBy(key)
        .agg(
            F.count("*").alias(f"{prefix}_count"),
            F.avg(error).alias(f"{prefix}_mean"),
            F.max(error).alias(f"{prefix}_max"),
            F.stddev_samp(error).alias(f"{prefix}_std"),
            F.min(error).alias(f"{prefix}_min"),
        )
    )


def join_summaries(parts: list[DataFrame], key: str, prefixes: list[str]) -> DataFrame:
    """Full outer join of error summaries; missing means and maxima become 0."""
    joined = reduce(lambda a, b: a.join(b, key, "full_outer"), parts)
    return joined.fillna(0.0, [f"{p}_{s}" for p in prefixes for s in ("mean", "max")])


def error_pairs(
    observed: DataFrame, calibrated: DataFrame, key: str = "node_id", min_count: int = 5
) -> DataFrame:
    """Mean positive error of nodes with enough observations, next to the calibrated error."""
    stats = (
        observed.where(F.col("true_error") > 0)
        .groupBy(key)
        .agg(
            F.avg("true_error").alias("avg_real_error"),
            F.count("*").alias("n"),
            F.stddev_samp("true_error").alias("std"),
        )
        .where(F.col("n") >= min_count)
    )
    return stats.join(
        calibrated.where(F.col("calibration_error") > 0).select(key, "calibration_error"), key
    ).withColumn("error_difference", F.col("avg_real_error") - F.col("calibration_error"))


def in_log(stats: DataFrame, log: DataFrame, key: str, log_key: str) -> DataFrame:
    """Rows whose key occurs in a pruning log."""
    return stats.join(log.select(F.col(log_key).alias(key)).distinct(), key, "left_semi")


def mean_of_errors(joined: DataFrame, prefixes: list[str]) -> DataFrame:
    """Mean of each error over the keys that have it; 0 counts as missing."""
    means = [F.col(f"{p}_mean") for p in prefixes]
    rows = joined.where(reduce(lambda a, b: a | b, [m > 0 for m in means]))
    return rows.agg(
        F.count("*").alias("n_keys"),
        *[F.avg(F.nullif(F.col(f"{p}_mean"), F.lit(0.0))).alias(f"{p}_mean") for p in prefixes],
    )


def with_mean_error(joined: DataFrame, prefixes: list[str]) -> DataFrame:
    total = reduce(lambda a, b: a + b, [F.col(f"{p}_mean") for p in prefixes])
    return joined.withColumn("avg_all_errors", total / len(prefixes))


def distribution_by_recall(triples: DataFrame) -> DataFrame:
    return triples.groupBy("recall").agg(
        F.min("coverage").alias("min_coverage"),
        F.max("coverage").alias("max_coverage"),
        F.count("coverage").alias("n"),
        F.min("error").alias("min_error"),
        F.max("error").alias("max_error"),
        F.avg("error").alias("mean_error"),
        F.stddev_samp("error").alias("std_error"),
    )


def min_coverage(triples: DataFrame, floor: float) -> DataFrame:
    return triples.where(F.col("coverage") >= floor)
