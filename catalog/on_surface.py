"""Error surfaces: cleaning, grid, repair, evaluation, augmentation and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import feeds
from catalog.registry import register
from catalog.on_calibration import calibrated_triples
from catalog.on_search import FILTERED, MARGIN, search_predictions
from catalog.sql_parts import COMPACT, RAW, RECALL_CHAIN, TRIPLES, eliminated
from driftleaf.models import surfaces as M
from driftleaf.operators import augment as A
from driftleaf.operators import surface as S
from driftleaf.operators.batches import test_flag
from driftleaf.plans.calibrate import alpha_for_target as at_target
from driftleaf.operators.lookup import (
    TARGET_COVERAGES,
    TARGET_RECALLS,
    TARGETS,
    actual_errors,
    with_actual_errors,
    with_targets,
)
from driftleaf.operators import recall as R
from driftleaf.plans import search as P
from driftleaf.session import new_work_path
from driftleaf.sources import tables as T

POINT = "filter_id, round(recall, 6) AS recall, round(coverage, 6) AS coverage, round(error, 6) AS error"


def _point(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(
        "filter_id",
        F.round("recall", 6).alias("recall"),
        F.round("coverage", 6).alias("coverage"),
        F.round("error", 6).alias("error"),
        *extra,
    )


@register(
    "raw_compaction",
    f"WITH {COMPACT} SELECT {POINT} FROM compact",
)
def raw_compaction(spark: SparkSession, sf: str) -> DataFrame:
    return _point(feeds.compact_triples(spark, sf))


QUARTILE = """
    ranked AS (
      SELECT filter_id, error, row_number() OVER (PARTITION BY filter_id ORDER BY error) - 1 AS p,
             count(*) OVER (PARTITION BY filter_id) AS n FROM triples),
    quartile AS (SELECT filter_id, error AS q FROM ranked WHERE p = n // 4)"""


@register(
    "index_quartiles",
    f"""WITH {TRIPLES}, {QUARTILE},
    upper_q AS (SELECT filter_id, error AS q3 FROM ranked WHERE p = n * 3 // 4)
    SELECT filter_id, round(q, 4) AS q1, round(q3, 4) AS q3 FROM quartile JOIN upper_q USING (filter_id)""",
)
def index_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = feeds.triples(spark, sf)
    low = S.index_quartile(rows, 1).select("filter_id", F.round("q", 4).alias("q1"))
    high = S.index_quartile(rows, 3).select("filter_id", F.round("q", 4).alias("q3"))
    return low.join(high, "filter_id")


DOMINATED = f"""{TRIPLES}, {QUARTILE},
    flagged AS (
      SELECT t.*, t.error < q.q AND EXISTS (
        SELECT 1 FROM triples o WHERE o.filter_id = t.filter_id AND o.recall >= t.recall
        AND o.coverage >= t.coverage AND (o.recall > t.recall OR o.coverage > t.coverage)
        AND o.error <= t.error) AS dominated
      FROM triples t JOIN quartile q USING (filter_id))"""


@register("dominated_points", f"WITH {DOMINATED} SELECT {POINT}, dominated FROM flagged")
def dominated_points(spark: SparkSession, sf: str) -> DataFrame:
    return _point(S.with_dominated_flag(feeds.triples(spark, sf)), "dominated")


CLEAN = f"""{DOMINATED},
    kept AS (SELECT filter_id, recall, coverage, error FROM flagged WHERE NOT dominated),
    pass1 AS (
      SELECT filter_id, recall, coverage,
             CASE WHEN error <= lag(error) OVER w THEN lag(error) OVER w * 1.01::DOUBLE ELSE error END
             AS error FROM kept WINDOW w AS (PARTITION BY filter_id, recall ORDER BY coverage)),
    pass2 AS (
      SELECT filter_id, recall, coverage,
             CASE WHEN error <= lag(error) OVER w THEN lag(error) OVER w * 1.01::DOUBLE ELSE error END
             AS error FROM pass1 WINDOW w AS (PARTITION BY filter_id, coverage ORDER BY recall)),
    below AS (
      SELECT a.filter_id, a.recall, a.coverage, max(b.error) AS m FROM pass2 a JOIN pass2 b
      ON b.filter_id = a.filter_id AND b.recall < a.recall AND b.coverage < a.coverage
      GROUP BY 1, 2, 3),
    clean AS (
      SELECT a.filter_id, a.recall, a.coverage,
             CASE WHEN a.error <= m THEN m * 1.01::DOUBLE ELSE a.error END AS error
      FROM pass2 a LEFT JOIN below b USING (filter_id, recall, coverage))"""


@register("monotone_bump", f"WITH {CLEAN} SELECT {POINT} FROM clean")
def monotone_bump(spark: SparkSession, sf: str) -> DataFrame:
    return _point(S.clean_triples(feeds.triples(spark, sf)))


GRID = f"""{CLEAN},
    bounds AS (
      SELECT filter_id, min(recall) AS lo_r, max(recall) AS hi_r, min(coverage) AS lo_c,
             max(coverage) AS hi_c,
             least(20, CAST(floor(sqrt(count(*))) AS BIGINT) + 5) AS g FROM clean GROUP BY 1),
    axis AS (SELECT filter_id, g, lo_r, hi_r, lo_c, hi_c, unnest(range(g)) AS i FROM bounds),
    nodes AS (
      SELECT a.filter_id, a.i AS gi, b.i AS gj,
             a.lo_r + (a.hi_r - a.lo_r) * a.i / (a.g - 1) AS u,
             a.lo_c + (a.hi_c - a.lo_c) * b.i / (a.g - 1) AS v
      FROM axis a JOIN axis b USING (filter_id)),
    near AS (
      SELECT n.filter_id, gi, gj, u, v, c.error,
             row_number() OVER (PARTITION BY n.filter_id, gi, gj ORDER BY
               (u - c.recall) * (u - c.recall) + (v - c.coverage) * (v - c.coverage),
               c.recall, c.coverage) AS r
      FROM nodes n JOIN clean c USING (filter_id)),
    grid AS (
      SELECT filter_id, u AS recall, v AS coverage, max(error) AS error FROM near WHERE r <= 5
      GROUP BY filter_id, u, v)"""


@register("surface_grid", f"WITH {GRID} SELECT {POINT} FROM grid")
def surface_grid(spark: SparkSession, sf: str) -> DataFrame:
    return _point(S.fit_grid(S.clean_triples(feeds.triples(spark, sf))))


RISING = f"""{GRID},
    rise1 AS (
      SELECT filter_id, recall, coverage, max(error) OVER (
        PARTITION BY filter_id, recall ORDER BY coverage) AS error FROM grid),
    rising AS (
      SELECT filter_id, recall, coverage, max(error) OVER (
        PARTITION BY filter_id, coverage ORDER BY recall) AS error FROM rise1)"""


@register("surface_running_max", f"WITH {RISING} SELECT {POINT} FROM rising")
def surface_running_max(spark: SparkSession, sf: str) -> DataFrame:
    return _point(S.running_maximum(S.fit_grid(S.clean_triples(feeds.triples(spark, sf)))))


_PREDICT_TARGETS = [(0.9, 0.9), (0.95, 0.95), (0.99, 0.95), (0.985, 0.999), (1.0, 1.0)]


def surface_sql(targets: list[tuple[float, float]], source: str = TRIPLES) -> str:
    """The whole surface over ``source``, a fragment that defines ``triples``."""
    return f"""WITH {RISING.replace(TRIPLES, source)},
    targets(target_r, target_c) AS (
      VALUES {", ".join(f"({r}::DOUBLE, {c}::DOUBLE)" for r, c in targets)}),
    asked AS (
      SELECT b.filter_id, target_r, target_c, greatest(lo_r, least(hi_r, target_r)) AS r,
             greatest(lo_c, least(hi_c, target_c)) AS c FROM bounds b CROSS JOIN targets),
    met AS (
      SELECT a.*, s.error, (s.recall - r) * (s.recall - r) + (s.coverage - c) * (s.coverage - c) AS d
      FROM asked a JOIN rising s USING (filter_id)),
    mixed AS (
      SELECT filter_id, target_r, target_c, r, c, max(CASE WHEN d < 1e-10 THEN error END) AS hit,
             sum(CASE WHEN d >= 1e-10 THEN error / (d * d) END)
             / sum(CASE WHEN d >= 1e-10 THEN 1.0::DOUBLE / (d * d) END) AS p,
             CASE WHEN r >= 0.97::DOUBLE THEN (r - 0.97::DOUBLE) * 10 ELSE 0 END
             + CASE WHEN c >= 0.97::DOUBLE THEN (c - 0.97::DOUBLE) * 5 ELSE 0 END AS lift
      FROM met GROUP BY filter_id, target_r, target_c, r, c)
    SELECT filter_id, target_r, target_c,
           round(greatest(0.1::DOUBLE, CASE WHEN hit IS NOT NULL THEN hit + lift
                          ELSE 0.2::DOUBLE + 1.4::DOUBLE * p + lift END), 4) AS error FROM mixed"""


@register("surface_predict", surface_sql(_PREDICT_TARGETS))
def surface_predict(spark: SparkSession, sf: str) -> DataFrame:
    out = S.surface_at(feeds.triples(spark, sf), _PREDICT_TARGETS)
    return out.withColumn("error", F.round("error", 4))


_CALIBRATED = f"""{RECALL_CHAIN},
    triples AS (
      SELECT leaf_id AS filter_id, recall, coverage, alpha AS error FROM pairs JOIN alphas USING (pos))"""


@register(
    "alpha_for_target",
    f"SELECT filter_id AS leaf_id, error AS alpha FROM ({surface_sql([(0.95, 0.9)], _CALIBRATED)}) t",
)
def alpha_for_target(spark: SparkSession, sf: str) -> DataFrame:
    """Margins for recall 0.95 at coverage 0.9 from the surface of every filter."""
    return at_target(calibrated_triples(spark, sf), 0.95, 0.9).withColumn(
        "alpha", F.round("alpha", 4)
    )


_TERMS = "[1.0, u, v, u * v, u * u, v * v]::DOUBLE[]"

#: Normal equations about the mean point, in units of a twentieth, and their solution.
QUADRATIC = f"""{TRIPLES},
    middle AS (SELECT filter_id, avg(recall) AS mr, avg(coverage) AS mc FROM triples GROUP BY 1),
    terms AS (
      SELECT filter_id, error, {_TERMS} AS t FROM (
        SELECT filter_id, error, (recall - mr) * 20 AS u, (coverage - mc) * 20 AS v FROM triples JOIN middle USING (filter_id)) x),
    e0 AS MATERIALIZED (
      SELECT filter_id, i, j, sum(t[i] * CASE WHEN j = 7 THEN error ELSE t[j] END) AS a
      FROM terms, (SELECT unnest(range(1, 7)) AS i) r, (SELECT unnest(range(1, 8)) AS j) c GROUP BY ALL),
    {eliminated(["filter_id"], 6)},
    solved AS (SELECT filter_id, list(a ORDER BY i) AS w FROM e6 WHERE j = 7 GROUP BY filter_id)"""


def _quadratic_at(targets: str) -> str:
    return f"""WITH {QUADRATIC}, targets(target_r, target_c) AS ({targets}),
    asked AS (
      SELECT filter_id, w, target_r, target_c, (target_r - mr) * 20 AS u, (target_c - mc) * 20 AS v
      FROM solved JOIN middle USING (filter_id) CROSS JOIN targets),
    said AS (SELECT filter_id, target_r, target_c, list_dot_product(w, {_TERMS}) AS error FROM asked)"""


_FIVE = "VALUES " + ", ".join(f"({r}::DOUBLE, {c}::DOUBLE)" for r, c in _PREDICT_TARGETS)
_DENSE = "SELECT 0.9::DOUBLE + 0.1::DOUBLE * i / 49, 0.92::DOUBLE + 0.08::DOUBLE * j / 49 FROM range(50) a(i), range(50) b(j)"


@register(
    "surface_quadratic",
    f"{_quadratic_at(_FIVE)} SELECT filter_id, target_r, target_c, round(error, 4) AS error FROM said",
)
def surface_quadratic(spark: SparkSession, sf: str) -> DataFrame:
    models = S.fit_quadratic(feeds.triples(spark, sf))
    return S.predict_quadratic(models, _PREDICT_TARGETS).withColumn("error", F.round("error", 4))


@register("surface_thin_plate")
def surface_thin_plate(spark: SparkSession, sf: str) -> DataFrame:
    out = M.thin_plate_at(feeds.triples(spark, sf), _PREDICT_TARGETS)
    return out.withColumn("error", F.round("error", 4))


@register(
    "surface_quantile",
    f"""WITH {RAW},
    cells AS (
      SELECT filter_id, round(recall, 6) AS recall, round(coverage, 6) AS coverage,
             quantile_cont(error, 0.85) AS error FROM raw GROUP BY 1, 2, 3),
    rise1 AS (
      SELECT filter_id, recall, coverage, max(error) OVER (
        PARTITION BY filter_id, recall ORDER BY coverage) AS error FROM cells),
    rising AS (
      SELECT filter_id, recall, coverage, max(error) OVER (
        PARTITION BY filter_id, coverage ORDER BY recall) AS error FROM rise1)
    SELECT filter_id, recall, coverage, round(error, 9) AS error FROM rising""",
)
def surface_quantile(spark: SparkSession, sf: str) -> DataFrame:
    out = M.quantile_surface(feeds.raw_triples(spark, sf), 0.85)
    return out.withColumn("error", F.round("error", 9))


def _boosted(spark: SparkSession, sf: str):
    rows = test_flag(
        feeds.triples(spark, sf), ["recall", "coverage"], ["filter_id"], 0.2, "boosted"
    )
    return M.BoostedSurface.fit(rows.where(F.col("is_test") == 0)), rows


@register("surface_boosted")
def surface_boosted(spark: SparkSession, sf: str) -> DataFrame:
    """Boosted trees over all filters, evaluated on the target grid and repaired."""
    model, rows = _boosted(spark, sf)
    return _point(model.at_targets(rows.select("filter_id").distinct(), TARGETS))


@register("surface_boosted_metrics")
def surface_boosted_metrics(spark: SparkSession, sf: str) -> DataFrame:
    model, rows = _boosted(spark, sf)
    out = M.evaluate(model, rows)
    return out.withColumns({c: F.round(c, 4) for c in ("mse", "rmse", "mae", "safe_ratio")})


@register("surface_feature_importance")
def surface_feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    model = M.BoostedSurface.fit(feeds.triples(spark, sf), enhanced=True)
    return model.importances(spark).withColumn("importance", F.round("importance", 4))


@register(
    "surface_dense_grid",
    f"""{_quadratic_at(_DENSE)}
    SELECT filter_id, count(*) AS n, round(min(error), 3) AS low, round(max(error), 3) AS high FROM said GROUP BY filter_id""",
)
def surface_dense_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Quadratic surfaces on a 50 by 50 grid: range per filter."""
    models = S.fit_quadratic(feeds.triples(spark, sf))
    out = S.predict_quadratic(models, S.DenseGrid((0.9, 1.0), (0.92, 1.0)))
    return out.groupBy("filter_id").agg(
        F.count("*").alias("n"),
        F.round(F.min("error"), 3).alias("low"),
        F.round(F.max("error"), 3).alias("high"),
    )


@register(
    "target_grid",
    f"""WITH ids AS (SELECT DISTINCT l_suppkey AS filter_id FROM lineitem)
    SELECT filter_id, recall, coverage FROM ids CROSS JOIN
      (SELECT unnest([{", ".join(f"{r}::DOUBLE" for r in TARGET_RECALLS)}]) AS recall) r CROSS JOIN
      (SELECT unnest([{", ".join(f"{c}::DOUBLE" for c in TARGET_COVERAGES)}]) AS coverage) c""",
)
def target_grid(spark: SparkSession, sf: str) -> DataFrame:
    return with_targets(feeds.raw_triples(spark, sf).select("filter_id").distinct())


BAND = f"""{TRIPLES},
    targets AS (
      SELECT recall, coverage FROM
      (SELECT unnest([{", ".join(f"{r}::DOUBLE" for r in TARGET_RECALLS)}]) AS recall) r CROSS JOIN
      (SELECT unnest([{", ".join(f"{c}::DOUBLE" for c in TARGET_COVERAGES)}]) AS coverage) c),
    met AS (
      SELECT s.filter_id, t.recall, t.coverage, s.error, abs(s.recall - t.recall) AS dr,
             abs(s.coverage - t.coverage) AS dc FROM triples s CROSS JOIN targets t),
    inside AS (
      SELECT filter_id, recall, coverage, avg(error) AS error FROM met
      WHERE dr <= 0.001::DOUBLE AND dc <= 0.001::DOUBLE GROUP BY 1, 2, 3),
    placed AS (
      SELECT filter_id, recall, coverage, error, rank() OVER (
        PARTITION BY filter_id, recall, coverage
        ORDER BY round(sqrt(dr * dr + dc * dc) * 1e9), round(dr * 1e9)) AS r FROM met),
    nearest AS (
      SELECT filter_id, recall, coverage, avg(error) AS error FROM placed WHERE r = 1
      GROUP BY 1, 2, 3),
    found AS (
      SELECT n.filter_id, n.recall, n.coverage, coalesce(i.error, n.error) AS actual_error,
             CASE WHEN i.error IS NULL THEN 'nearest' ELSE 'exact' END AS match
      FROM nearest n LEFT JOIN inside i USING (filter_id, recall, coverage))"""


@register(
    "band_lookup",
    f"""WITH {BAND} SELECT filter_id, recall, coverage, round(actual_error, 4) AS actual_error, match
    FROM found""",
)
def band_lookup(spark: SparkSession, sf: str) -> DataFrame:
    out = actual_errors(feeds.triples(spark, sf))
    return out.withColumn("actual_error", F.round("actual_error", 4))


@register(
    "predicted_and_actual",
    f"""WITH predicted AS ({surface_sql(TARGETS)}),
    actual AS (WITH {BAND} SELECT * FROM found)
    SELECT filter_id, recall, coverage, p.error AS predicted_error, round(actual_error, 4) AS actual_error, match
    FROM predicted p JOIN actual a USING (filter_id)
    WHERE a.recall = p.target_r AND a.coverage = p.target_c""",
)
def predicted_and_actual(spark: SparkSession, sf: str) -> DataFrame:
    """The surface of every filter at all targets, next to the errors that its triples have there."""
    rows = feeds.triples(spark, sf)
    said = S.surface_at(rows, TARGETS).withColumnsRenamed({"target_r": "recall", "target_c": "coverage"})
    out = with_actual_errors(said, rows)
    return out.withColumns({c: F.round(c, 4) for c in ("predicted_error", "actual_error")})


@register(
    "predicted_alphas_file",
    f"""SELECT filter_id AS leaf_id, target_r AS recall, target_c AS coverage, error AS alpha
    FROM ({surface_sql([(0.9, 0.9), (0.95, 0.9), (0.99, 0.95)], _CALIBRATED)}) t""",
)
def predicted_alphas_file(spark: SparkSession, sf: str) -> DataFrame:
    """Margins that the surfaces of all filters give for three targets, written and read back."""
    wanted = [(0.9, 0.9), (0.95, 0.9), (0.99, 0.95)]
    at = S.surface_at(calibrated_triples(spark, sf), wanted)
    path = new_work_path(spark, "alphas")
    T.write_rows(at.select(F.col("filter_id").alias("leaf_id"), F.col("target_r").alias("recall"),
                           F.col("target_c").alias("coverage"), F.col("error").alias("alpha")), path)
    back = T.read_rows(spark, path, "leaf_id long, recall double, coverage double, alpha double")
    return back.withColumn("alpha", F.round("alpha", 4))


SENTINELS = f"""{TRIPLES},
    pulled AS (
      SELECT filter_id, recall, CASE WHEN coverage >= 1.0 THEN 0.9995::DOUBLE ELSE coverage END
             AS coverage, error FROM triples),
    tops AS (
      SELECT filter_id, recall, coverage AS c0, error AS e0 FROM (
        SELECT *, row_number() OVER (PARTITION BY filter_id, recall
                                     ORDER BY coverage DESC, error DESC) AS r FROM pulled) t
      WHERE r = 1),
    percents AS (
      SELECT *, unnest(list_append(
               CASE WHEN ceil((c0 + 0.01::DOUBLE) / 0.01::DOUBLE) <= 99
                    THEN range(CAST(ceil((c0 + 0.01::DOUBLE) / 0.01::DOUBLE) AS BIGINT), 100)
                    ELSE [] END, 100)) AS p FROM tops),
    added AS (
      SELECT filter_id, recall, p / 100.0::DOUBLE AS coverage,
             CASE WHEN p = 100 THEN 3 * e0
                  ELSE e0 + (3 * e0 - e0) * (p / 100.0::DOUBLE - c0) / (1.0::DOUBLE - c0) END
             AS error FROM percents)"""


@register(
    "coverage_sentinels",
    f"""WITH {SENTINELS}
    SELECT {POINT}, false AS is_new FROM pulled UNION ALL SELECT {POINT}, true FROM added""",
)
def coverage_sentinels(spark: SparkSession, sf: str) -> DataFrame:
    return _point(A.coverage_sentinels(feeds.triples(spark, sf)), "is_new")


@register(
    "extreme_sentinels",
    f"""WITH {TRIPLES}, tops AS (
      SELECT filter_id, recall, max(error) AS e FROM triples GROUP BY 1, 2)
    SELECT {POINT} FROM (
      SELECT filter_id, recall, coverage, error FROM triples
      UNION ALL SELECT filter_id, recall, 0.999::DOUBLE, e * 3 FROM tops
      UNION ALL SELECT filter_id, recall, 0.9999::DOUBLE, e * 5 FROM tops) t""",
)
def extreme_sentinels(spark: SparkSession, sf: str) -> DataFrame:
    return _point(A.extreme_sentinels(feeds.triples(spark, sf)))


@register(
    "added_rows",
    f"""WITH {SENTINELS}
    SELECT {POINT} FROM (
      SELECT filter_id, recall, coverage, round(error, 6) AS error FROM pulled
      UNION ALL SELECT filter_id, recall, coverage, round(error, 6) FROM added
      EXCEPT ALL SELECT filter_id, recall, coverage, round(error, 6) FROM triples) t""",
)
def added_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = feeds.triples(spark, sf)
    return _point(
        A.added_rows(A.coverage_sentinels(rows), rows.withColumn("error", F.round("error", 6)))
    )


@register(
    "sentinel_growth",
    """SELECT l_linenumber::BIGINT AS l_linenumber, round(sum(l_quantity * 2), 4) AS linear,
              round(sum(l_quantity * exp(1.0)), 2) AS exponential,
              round(sum(l_quantity * 4), 4) AS quadratic FROM lineitem GROUP BY 1""",
)
def sentinel_growth(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity")
    return (
        feeds.table(spark, sf, "lineitem")
        .groupBy("l_linenumber")
        .agg(
            F.round(F.sum(A.sentinel_error(q, "linear", 2.0)), 4).alias("linear"),
            F.round(F.sum(A.sentinel_error(q, "exponential", 2.0)), 2).alias("exponential"),
            F.round(F.sum(A.sentinel_error(q, "quadratic", 2.0)), 4).alias("quadratic"),
        )
    )


_INTS = {
    "high_recall", "high_coverage", "both_high", "very_high_recall", "very_high_coverage",
    "medium_recall", "medium_coverage",
}

_FEATURE_SQL = {
    "recall_coverage_product": "r * c",
    "recall_coverage_ratio": "r / (c + 1e-10)",
    "coverage_recall_ratio": "c / (r + 1e-10)",
    "recall_squared": "r * r",
    "coverage_squared": "c * c",
    "recall_cubed": "r * r * r",
    "coverage_cubed": "c * c * c",
    "log_recall": "ln(r + 1e-10)",
    "log_coverage": "ln(c + 1e-10)",
    "log_product": "ln(r + 1e-10) + ln(c + 1e-10)",
    "distance_to_perfect": "sqrt((1 - r) * (1 - r) + (1 - c) * (1 - c))",
    "distance_to_origin": "sqrt(r * r + c * c)",
    "manhattan_distance_to_perfect": "(1 - r) + (1 - c)",
    "harmony_score": "1 - abs(r - c)",
    "balance_score": "least(r, c) / greatest(r, c)",
    "recall_rank": "rr",
    "coverage_rank": "cr",
    "rank_correlation": "rr * cr",
    "rank_difference": "abs(rr - cr)",
    "exp_recall": "exp(-r)",
    "exp_coverage": "exp(-c)",
    "high_recall": "CAST(r > 0.95::DOUBLE AS BIGINT)",
    "high_coverage": "CAST(c > 0.95::DOUBLE AS BIGINT)",
    "both_high": "CAST(r > 0.95::DOUBLE AND c > 0.95::DOUBLE AS BIGINT)",
    "very_high_recall": "CAST(r > 0.98::DOUBLE AS BIGINT)",
    "very_high_coverage": "CAST(c > 0.98::DOUBLE AS BIGINT)",
    "medium_recall": "CAST(r > 0.9::DOUBLE AND r <= 0.95::DOUBLE AS BIGINT)",
    "medium_coverage": "CAST(c > 0.9::DOUBLE AND c <= 0.95::DOUBLE AS BIGINT)",
    "recall_coverage_diff": "r - c",
    "abs_recall_coverage_diff": "abs(r - c)",
    "harmonic_mean": "2 * r * c / (r + c + 1e-10)",
    "geometric_mean": "sqrt(r * c)",
    "f1_score": "2 * r * c / (r + c + 1e-10)",
    "f2_score": "5 * r * c / (4 * r + c + 1e-10)",
    "f0_5_score": "1.25::DOUBLE * r * c / (0.25::DOUBLE * r + c + 1e-10)",
    "recall_high_region": "greatest(0.0, r - 0.9::DOUBLE)",
    "coverage_high_region": "greatest(0.0, c - 0.9::DOUBLE)",
    "recall_extreme_high": "greatest(0.0, r - 0.95::DOUBLE)",
    "coverage_extreme_high": "greatest(0.0, c - 0.95::DOUBLE)",
}


@register(
    "enhanced_features",
    f"""WITH {TRIPLES},
    placed AS (
      SELECT filter_id, recall AS r, coverage AS c,
             (rank() OVER (PARTITION BY filter_id ORDER BY recall)
              + (count(*) OVER (PARTITION BY filter_id, recall) - 1) / 2.0::DOUBLE)
             / count(*) OVER (PARTITION BY filter_id) AS rr,
             (rank() OVER (PARTITION BY filter_id ORDER BY coverage)
              + (count(*) OVER (PARTITION BY filter_id, coverage) - 1) / 2.0::DOUBLE)
             / count(*) OVER (PARTITION BY filter_id) AS cr FROM triples)
    SELECT filter_id, r AS recall, c AS coverage, {", ".join(
        f"{e} AS {n}" if n in _INTS else f"round({e}, 7) + 0.0 AS {n}"
        for n, e in _FEATURE_SQL.items())} FROM placed""",
)
def enhanced_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.surface_features(feeds.triples(spark, sf))
    return rows.select(
        "filter_id",
        "recall",
        "coverage",
        *[
            F.col(n) if n in _INTS else (F.round(n, 7) + 0.0).alias(n)
            for n in A.FEATURES
            if n not in ("recall", "coverage")
        ],
    )


@register(
    "test_flags",
    f"""WITH {TRIPLES},
    sizes AS (SELECT filter_id, count(*) AS n FROM triples GROUP BY 1)
    SELECT filter_id, CAST(floor(n * 0.2::DOUBLE) AS BIGINT) AS n_test,
           n - CAST(floor(n * 0.2::DOUBLE) AS BIGINT) AS n_train FROM sizes""",
)
def test_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = test_flag(feeds.triples(spark, sf), ["recall", "coverage"], ["filter_id"], 0.2, "flags")
    return rows.groupBy("filter_id").agg(
        F.count_if(F.col("is_test") == 1).alias("n_test"),
        F.count_if(F.col("is_test") == 0).alias("n_train"),
    )


_AT_TARGET = f"""
    margin AS (
      SELECT filter_id AS leaf_id, error AS alpha FROM ({surface_sql([(0.95, 0.9)], _CALIBRATED)}) t)"""


@register(
    "filtered_report_by_key",
    f"""WITH {FILTERED.replace(MARGIN, _AT_TARGET)},
    per_query AS (
      SELECT e.query_id, count(f.series_id) / {feeds.K}::DOUBLE AS recall FROM exact e
      LEFT JOIN filtered f ON f.query_id = e.query_id AND f.series_id = e.series_id GROUP BY e.query_id),
    batched AS (
      SELECT least(query_id // 10, greatest(1, (SELECT count(*) FROM search) // 10) - 1) AS batch_id,
             avg(recall) AS recall FROM per_query GROUP BY 1)
    SELECT (SELECT count(*) FROM search) AS n_queries, (SELECT round(avg(recall), 4) FROM per_query) AS recall,
           (SELECT round(avg(CASE WHEN round(recall, 5) >= 0.95 THEN 1.0 ELSE 0.0 END), 4) FROM batched) AS coverage,
           (SELECT count(*) FROM cand) AS candidates, (SELECT count(*) FROM kept) AS kept,
           (SELECT round(1.0 - (SELECT count(*) FROM kept) / (SELECT count(*) FROM cand)::DOUBLE, 4)) AS filter_share,
           (SELECT round(1.0 - ((SELECT count(*) FROM cand) + (SELECT count(*) FROM search))
                   / ((SELECT count(*) FROM search) * (SELECT count(DISTINCT leaf_id) FROM series))::DOUBLE, 4)) AS bound_share""",
)
def filtered_report_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """The learned search with margins for recall 0.95 at coverage 0.9, end to end: what it finds, and the
    shares of leaves that bounds and then filters prune."""
    q, index = feeds.search_queries(spark, sf), feeds.keyed_index(spark, sf)
    home = feeds.home(q)
    margins = at_target(calibrated_triples(spark, sf), 0.95, 0.9).withColumn("alpha", F.round("alpha", 4))
    said = search_predictions(spark, sf).drop("alpha").join(margins, "leaf_id")
    answers = P.knn_filtered(index, q, feeds.K, said, home)
    truth = P.knn_exact(feeds.series(spark, sf), q, feeds.K)
    found = R.recall_by_set(answers, truth, feeds.K)
    report = R.search_report(found, 0.95, 0.9).select("n_queries", F.round("recall", 4).alias("recall"), F.round("coverage", 4).alias("coverage"))
    _, limited = P.seed_limits(index, q, feeds.K, home)
    left = P.candidates(index, limited, home)
    counts = left.agg(F.count("*").alias("candidates")).join(P.learned_keep(left, limited, said).agg(F.count("*").alias("kept")))
    leaves = index.leaf.agg(F.count("*").alias("leaves"))
    return report.join(counts).join(leaves).select(
        "n_queries", "recall", "coverage", "candidates", "kept",
        F.round(1.0 - F.col("kept") / F.col("candidates"), 4).alias("filter_share"),
        F.round(1.0 - (F.col("candidates") + F.col("n_queries")) / (F.col("n_queries") * F.col("leaves")), 4).alias("bound_share"),
    )
