"""Error reports and regression metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import feeds
from catalog.registry import register
from catalog.sql_parts import POOL, RAW, TRIPLES, draw
from driftleaf.operators import metrics as M
from driftleaf.operators.batches import test_flag
from driftleaf.operators.sampling import random_rows
from driftleaf.session import materialise, new_work_path
from driftleaf.sources import tables as T

COVERAGES = [0.92, 0.93, 0.94, 0.95, 0.96, 0.97, 0.98, 0.99, 1.0]


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles if c not in ("recall", "coverage")})


def _spread(c: str) -> str:
    return f"""round(avg({c}), 4) AS mean_{c}, round(stddev_pop({c}), 4) AS std_{c},
           round(var_pop({c}), 4) AS var_{c}, round(min({c}), 4) AS min_{c},
           round(max({c}), 4) AS max_{c}, round(median({c}), 4) AS median_{c}"""


@register(
    "prediction_statistics",
    f"""WITH {POOL}
    SELECT recall, coverage, count(pred) AS n, count(actual) AS n_actual,
           {_spread('pred')}, {_spread('actual')},
           round(avg(abs(pred - actual)), 4) AS mae,
           round(sqrt(avg((pred - actual) * (pred - actual))), 4) AS rmse,
           round(avg(CASE WHEN pred - actual >= 0 THEN 1.0 ELSE 0.0 END), 4) AS safe_ratio
    FROM pool GROUP BY 1, 2""",
)
def prediction_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(M.prediction_statistics(feeds.pool(spark, sf)))


@register(
    "prediction_pivot",
    f"""WITH {POOL}
    SELECT recall, {", ".join(
        f"round(avg(pred) FILTER (WHERE coverage = {c}::DOUBLE), 4) AS c_{str(c).replace('.', '_')}"
        for c in COVERAGES)} FROM pool GROUP BY recall""",
)
def prediction_pivot(spark: SparkSession, sf: str) -> DataFrame:
    stats = M.prediction_statistics(feeds.pool(spark, sf))
    return _rounded(M.pivot_statistic(stats, "mean_pred", COVERAGES))


_PIVOT_SQL = {
    "mean_pred": "avg(pred)", "mean_actual": "avg(actual)", "mae": "avg(abs(pred - actual))",
    "rmse": "sqrt(avg((pred - actual) * (pred - actual)))",
    "safe_ratio": "avg(CASE WHEN pred - actual >= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)", "n": "count(*)::DOUBLE",
}
_CELLS = " UNION ALL ".join(
    f"SELECT '{name}' AS statistic, recall, coverage, {sql} AS value FROM pool GROUP BY recall, coverage"
    for name, sql in _PIVOT_SQL.items()
)


@register(
    "statistics_files",
    f"""WITH {POOL}, cells AS ({_CELLS})
    SELECT statistic, recall, {", ".join(
        f"round(max(value) FILTER (WHERE coverage = {c}::DOUBLE), 4) AS c_{str(c).replace('.', '_')}"
        for c in COVERAGES)}, (SELECT count(*) FROM (SELECT DISTINCT recall, coverage FROM pool) t) AS n_targets
    FROM cells GROUP BY statistic, recall""",
)
def statistics_files(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics of all targets and their six pivot tables, written as files and read back."""
    path = new_work_path(spark, "statistics")
    stats = materialise(M.prediction_statistics(feeds.pool(spark, sf)), "statistics")
    T.write_statistics(stats, M.pivot_all(stats, COVERAGES), path)
    whole = T.read_rows(spark, f"{path}/all", "recall double, coverage double, n long").agg(F.count("*").alias("n_targets"))
    names = [f"c_{str(c).replace('.', '_')}" for c in COVERAGES]
    tables = T.read_rows(spark, f"{path}/pivot", "statistic string, recall double, " + ", ".join(f"{n} double" for n in names))
    return _rounded(tables.join(F.broadcast(whole)))


METRICS = """count(*) AS n, avg(pow(pred - actual, 2)) AS mse,
      sqrt(avg(pow(pred - actual, 2))) AS rmse, avg(abs(pred - actual)) AS mae,
      avg(CASE WHEN pred - actual >= 0 THEN 1.0 ELSE 0.0 END) AS safe_ratio,
      avg(greatest(-0.85::DOUBLE * (pred - actual), (1.0::DOUBLE - 0.85::DOUBLE) * (pred - actual)))
        AS quantile_loss,
      avg(CASE WHEN actual <= pred THEN 1.0 ELSE 0.0 END) AS covered"""


@register(
    "regression_metrics",
    f"""WITH {POOL}, m AS (SELECT filter_id, {METRICS} FROM pool GROUP BY 1)
    SELECT filter_id, n, round(mse, 4) AS mse, round(rmse, 4) AS rmse, round(mae, 4) AS mae,
           round(safe_ratio, 4) AS safe_ratio, round(quantile_loss, 4) AS quantile_loss,
           round(covered, 4) AS covered FROM m""",
)
def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(M.regression_metrics(feeds.pool(spark, sf), ["filter_id"]))


@register(
    "average_metrics",
    f"""WITH {POOL}, m AS (SELECT filter_id, {METRICS} FROM pool GROUP BY 1)
    SELECT count(mse) AS succeeded, count(*) - count(mse) AS failed,
           round(avg(mse), 4) AS mean_mse, round(avg(rmse), 4) AS mean_rmse,
           round(avg(mae), 4) AS mean_mae, round(avg(safe_ratio), 4) AS mean_safe_ratio FROM m""",
)
def average_metrics(spark: SparkSession, sf: str) -> DataFrame:
    per_filter = M.regression_metrics(feeds.pool(spark, sf), ["filter_id"])
    return _rounded(M.average_metrics(per_filter))


@register(
    "quantile_loss",
    f"""WITH {POOL}
    SELECT recall, round(avg(greatest(0.9::DOUBLE * (actual - pred),
           (0.9::DOUBLE - 1) * (actual - pred))), 4) AS loss FROM pool GROUP BY recall""",
)
def quantile_loss(spark: SparkSession, sf: str) -> DataFrame:
    out = M.regression_metrics(feeds.pool(spark, sf), ["recall"], 0.9)
    return _rounded(out.select("recall", F.col("quantile_loss").alias("loss")))


@register(
    "fit_statistics",
    f"""WITH {POOL}
    SELECT recall, round(1 - sum(pow(pred - actual, 2)) / (var_pop(actual) * count(*)), 4) AS r2,
           round(min(pred), 4) AS min_pred, round(max(pred), 4) AS max_pred,
           round(avg(pred), 4) AS mean_pred, round(min(actual), 4) AS min_actual,
           round(max(actual), 4) AS max_actual, round(avg(actual), 4) AS mean_actual,
           round(avg(CASE WHEN pred >= actual THEN 1.0 ELSE 0.0 END), 4) AS safe_ratio,
           count(DISTINCT round(pred, 6)) AS distinct_pred FROM pool GROUP BY recall""",
)
def fit_statistics(spark: SparkSession, sf: str) -> DataFrame:
    rows = feeds.pool(spark, sf)
    out = M.fit_statistics(rows, ["recall"]).drop("distinct_pred")
    distinct = rows.groupBy("recall").agg(
        F.countDistinct(F.round("pred", 6)).alias("distinct_pred")
    )
    return _rounded(out.join(distinct, "recall"))


@register(
    "sample_gate",
    f"""WITH {TRIPLES}, sizes AS (SELECT filter_id, count(*) AS n FROM triples GROUP BY 1),
    parts AS (SELECT filter_id, n - CAST(floor(n * 0.2::DOUBLE) AS BIGINT) AS n_train,
                     CAST(floor(n * 0.2::DOUBLE) AS BIGINT) AS n_test FROM sizes)
    SELECT * FROM parts WHERE n_train >= 5 AND n_test >= 2""",
)
def sample_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = test_flag(feeds.triples(spark, sf), ["recall", "coverage"], ["filter_id"], 0.2, "gate")
    return M.enough_samples(rows)


@register(
    "minimum_coverage",
    f"""WITH {TRIPLES} SELECT filter_id, count(*) AS n, round(max(error), 4) AS max_error
    FROM triples WHERE coverage >= 0.95::DOUBLE GROUP BY 1""",
)
def minimum_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.min_coverage(feeds.triples(spark, sf), 0.95)
    return _rounded(
        rows.groupBy("filter_id").agg(F.count("*").alias("n"), F.max("error").alias("max_error"))
    )


@register(
    "distribution_by_recall",
    f"""WITH {TRIPLES}
    SELECT recall, min(coverage) AS min_coverage, max(coverage) AS max_coverage,
           count(coverage) AS n, round(min(error), 4) AS min_error, round(max(error), 4) AS max_error,
           round(avg(error), 4) AS mean_error, round(stddev_samp(error), 4) AS std_error
    FROM triples GROUP BY recall""",
)
def distribution_by_recall(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(M.distribution_by_recall(feeds.triples(spark, sf)))


PREFIXES = ["calib", "test", "precal"]
_ERRORS = {
    # Three error tables on one key, from three tables of the data set.
    "calib": ("lineitem", "l_suppkey", "l_quantity / 10.0 - 1.0"),
    "test": ("supplier", "s_suppkey", "s_acctbal / 700.0"),
    "precal": ("part", "p_partkey", "p_retailprice / 700.0 - 1.0"),
}


def _summary_sql(prefix: str) -> str:
    source, key, error = _ERRORS[prefix]
    error = error.replace(".0", ".0::DOUBLE")
    return f"""
    {prefix} AS (
      SELECT {key} AS filter_id, count(*) AS {prefix}_count, avg({error}) AS {prefix}_mean,
             max({error}) AS {prefix}_max, stddev_samp({error}) AS {prefix}_std,
             min({error}) AS {prefix}_min FROM {source} WHERE {error} > 0 GROUP BY 1)"""


_THREE = f"""{", ".join(_summary_sql(p) for p in PREFIXES)},
    joined AS (
      SELECT filter_id, calib_count, coalesce(calib_mean, 0) AS calib_mean,
             coalesce(calib_max, 0) AS calib_max, calib_std, calib_min,
             test_count, coalesce(test_mean, 0) AS test_mean, coalesce(test_max, 0) AS test_max,
             test_std, test_min, precal_count, coalesce(precal_mean, 0) AS precal_mean,
             coalesce(precal_max, 0) AS precal_max, precal_std, precal_min
      FROM calib FULL OUTER JOIN test USING (filter_id) FULL OUTER JOIN precal USING (filter_id))"""


def _errors(spark: SparkSession, sf: str, prefix: str) -> DataFrame:
    source, key, error = _ERRORS[prefix]
    rows = feeds.table(spark, sf, source)
    return rows.select(F.col(key).alias("filter_id"), F.expr(_as_double(error)).alias("error"))


def _as_double(text: str) -> str:
    return text.replace(".0", ".0D")


def _three(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        M.error_summary(_errors(spark, sf, p), "filter_id", "error", p) for p in PREFIXES
    ]
    return M.join_summaries(parts, "filter_id", PREFIXES)


@register(
    "three_way_errors",
    f"""WITH {_THREE} SELECT filter_id, {", ".join(
        f"{p}_count, " + ", ".join(f"round({p}_{s}, 4) AS {p}_{s}" for s in ("mean", "max", "std", "min"))
        for p in PREFIXES)} FROM joined""",
)
def three_way_errors(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_three(spark, sf))


@register(
    "mean_of_errors",
    f"""WITH {_THREE} SELECT count(*) AS n_keys, {", ".join(
        f"round(avg(nullif({p}_mean, 0)), 4) AS {p}_mean" for p in PREFIXES)} FROM joined
    WHERE calib_mean > 0 OR test_mean > 0 OR precal_mean > 0""",
)
def mean_of_errors(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(M.mean_of_errors(_three(spark, sf), PREFIXES))


@register(
    "errors_in_log",
    f"""WITH {_THREE} SELECT filter_id,
           round((calib_mean + test_mean + precal_mean) / 3, 4) AS avg_all_errors FROM joined
    WHERE filter_id IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def errors_in_log(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that occur in a log: here the suppliers of returned items."""
    log = feeds.table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R")
    rows = M.in_log(_three(spark, sf), log, "filter_id", "l_suppkey")
    return _rounded(M.with_mean_error(rows, PREFIXES).select("filter_id", "avg_all_errors"))


@register(
    "error_pairs",
    """WITH stats AS (
      SELECT l_suppkey AS node_id, avg(l_quantity - 20.5::DOUBLE) AS avg_real_error, count(*) AS n,
             stddev_samp(l_quantity - 20.5::DOUBLE) AS std FROM lineitem
      WHERE l_quantity - 20.5::DOUBLE > 0 GROUP BY 1 HAVING count(*) >= 5)
    SELECT node_id, round(avg_real_error, 4) AS avg_real_error, n, round(std, 4) AS std,
           round(s_acctbal / 300.0::DOUBLE, 4) AS calibration_error,
           round(avg_real_error - s_acctbal / 300.0::DOUBLE, 4) AS error_difference
    FROM stats JOIN supplier ON s_suppkey = node_id WHERE s_acctbal > 0""",
)
def error_pairs(spark: SparkSession, sf: str) -> DataFrame:
    seen = feeds.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("node_id"), (F.col("l_quantity") - 20.5).alias("true_error")
    )
    calibrated = feeds.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("node_id"),
        (F.col("s_acctbal") / 300.0).alias("calibration_error"),
    )
    return _rounded(M.error_pairs(seen, calibrated))


@register(
    "random_filters",
    f"""SELECT s_suppkey AS filter_id FROM supplier
    ORDER BY {draw('42', 's_suppkey')}, s_suppkey LIMIT 50""",
)
def random_filters(spark: SparkSession, sf: str) -> DataFrame:
    ids = feeds.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("filter_id"))
    return random_rows(ids, "filter_id", 50, "42")


@register(
    "first_filters",
    f"""WITH {RAW} SELECT filter_id, count(*) AS n, round(avg(error), 4) AS mean_error FROM raw
    GROUP BY 1 ORDER BY count(*) DESC, filter_id LIMIT 10""",
)
def first_filters(spark: SparkSession, sf: str) -> DataFrame:
    """The ten filters with most rows, for a short report."""
    rows = feeds.raw_triples(spark, sf).groupBy("filter_id").agg(
        F.count("*").alias("n"), F.avg("error").alias("mean_error")
    )
    return _rounded(rows.orderBy(F.desc("n"), "filter_id").limit(10))
