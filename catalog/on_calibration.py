"""Training facts, filters, margins, calibration batches, recall and coverage."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import feeds
from catalog.feeds import TRAIN_QUERIES
from catalog.registry import register
from catalog.sql_parts import (
    ALL_FACTS,
    CALIBRATION,
    CHAIN,
    MODEL,
    RECALL_CHAIN,
    balanced,
    draw,
    eliminated,
)
from driftleaf.models.fits import (
    RIDGE,
    fit_linear,
    fit_per_leaf,
    mlp,
    predict_per_leaf,
    query_features,
)
from driftleaf.operators import conformal as C
from driftleaf.operators import facts as T
from driftleaf.operators import recall as R
from driftleaf.operators.allocation import (
    CandidateModel,
    allocate,
    allocate_by_gain,
    allocate_by_size,
    active_count,
    filter_gains,
    model_prune_rate,
)
from driftleaf.operators.batches import balanced_batches, role_by_ratio, uniform_batches
from driftleaf.plans import evaluate as E
from driftleaf.plans.search import prediction_interval
from driftleaf.session import new_work_path
from driftleaf.sources import tables as T_
from driftleaf.plans.train import trial


def _rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@register(
    "training_facts",
    f"""WITH {ALL_FACTS}
    SELECT query_id, leaf_id, is_resident, round(lb, 4) AS lb, round(lnn, 4) AS lnn,
           round(bsf, 4) AS bsf, role FROM facts""",
)
def training_facts(spark: SparkSession, sf: str) -> DataFrame:
    rows = feeds.facts(spark, sf).select(
        "query_id", "leaf_id", "is_resident", "lb", "lnn", "bsf", "role"
    )
    return _rounded(rows, "lb", "lnn", "bsf")


@register(
    "lb_prune_frequency",
    f"""WITH {ALL_FACTS}
    SELECT leaf_id, round(avg(CASE WHEN lb > bsf THEN 1.0 ELSE 0.0 END), 4) AS lb_prune
    FROM facts GROUP BY leaf_id""",
)
def lb_prune_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(T.bound_prune_frequency(feeds.facts(spark, sf)), "lb_prune")


@register(
    "leaf_distance_stats",
    f"""WITH {ALL_FACTS}
    SELECT leaf_id, round(avg(lnn), 4) AS mean_lnn, round(stddev_pop(lnn), 4) AS std_lnn
    FROM facts GROUP BY leaf_id""",
)
def leaf_distance_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(T.nn_distance_stats(feeds.facts(spark, sf)), "mean_lnn", "std_lnn")


@register(
    "bsf_lookup",
    f"""WITH {ALL_FACTS}
    SELECT t.query_id, t.leaf_id, round(f.bsf, 4) AS bsf FROM (
      SELECT query_id, leaf_id FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lnn, leaf_id) AS r FROM facts) x
      WHERE r = 1) t LEFT JOIN facts f USING (query_id, leaf_id)""",
)
def bsf_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The distance to beat when the search reaches the leaf of the true neighbour."""
    rows = feeds.facts(spark, sf)
    found = T.lookup_bsf(R.nearest_leaf(rows).select("query_id", "leaf_id"), rows)
    return _rounded(found, "bsf")


@register(
    "position_roles",
    f"""WITH {ALL_FACTS}
    SELECT role, CASE WHEN query_id < {int(TRAIN_QUERIES * 0.9)} THEN 'train' ELSE 'valid' END AS plain,
           count(DISTINCT query_id) AS n FROM facts GROUP BY 1, 2""",
)
def position_roles(spark: SparkSession, sf: str) -> DataFrame:
    plain = role_by_ratio(F.col("query_id"), TRAIN_QUERIES, 0.9)
    return (
        feeds.facts(spark, sf)
        .groupBy("role", plain.alias("plain"))
        .agg(F.countDistinct("query_id").alias("n"))
    )


@register(
    "linear_filters",
    f"""WITH {ALL_FACTS}, {MODEL}
    SELECT leaf_id, round(slope, 4) AS slope, round(intercept, 4) AS intercept FROM model""",
)
def linear_filters(spark: SparkSession, sf: str) -> DataFrame:
    train = feeds.facts(spark, sf).where(F.col("role") == "train")
    return _rounded(fit_linear(train), "slope", "intercept")


@register(
    "filter_predictions",
    f"""WITH {ALL_FACTS}, {MODEL}
    SELECT query_id, leaf_id, round(pred, 4) AS pred FROM predicted""",
)
def filter_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(feeds.predicted(spark, sf).select("query_id", "leaf_id", "pred"), "pred")


def _per_leaf(spark: SparkSession, sf: str, model) -> DataFrame:
    rows = feeds.facts(spark, sf)
    features = query_features(feeds.train_queries(spark, sf), feeds.LENGTH)
    weights = fit_per_leaf(rows.where(F.col("role") != "calib"), features, model)
    out = predict_per_leaf(rows.where(F.col("role") == "calib"), features, weights, model)
    return out.groupBy("leaf_id").agg(
        F.count("*").alias("n"),
        F.round(F.sqrt(F.avg((F.col("pred") - F.col("lnn")) ** 2)), 3).alias("rmse"),
    )


_PARTS, _WIDE = 8, feeds.LENGTH // 8

#: Normal equations of standardised features for every leaf and penalty, and the penalty that validates best.
RIDGE_FIT = f"""
    parts AS (
      SELECT query_id, p, "values"[p * {_WIDE} + 1 : p * {_WIDE} + {_WIDE}] AS part
      FROM train, range({_PARTS}) AS parts(p)),
    summaries AS (SELECT *, list_sum(part) / {_WIDE} AS mean FROM parts),
    features AS (
      SELECT query_id, list(mean ORDER BY p) || list(
        sqrt(list_sum(list_transform(part, lambda x: (x - mean) * (x - mean))) / {_WIDE}) ORDER BY p) AS f
      FROM summaries GROUP BY query_id),
    examples AS MATERIALIZED (
      SELECT query_id, leaf_id, role, lnn, f FROM facts JOIN features USING (query_id)),
    spans AS (
      SELECT leaf_id, list(mu ORDER BY i) AS mu, list(CASE WHEN sd > 0 THEN sd ELSE 1.0 END ORDER BY i) AS sd FROM (
        SELECT leaf_id, i, avg(f[i]) AS mu, stddev_pop(f[i]) AS sd FROM examples, range(1, {2 * _PARTS + 1}) AS t(i)
        WHERE role = 'train' GROUP BY leaf_id, i) s GROUP BY leaf_id),
    centres AS (SELECT leaf_id, avg(lnn) AS centre FROM examples WHERE role = 'train' GROUP BY leaf_id),
    scaled AS MATERIALIZED (
      SELECT query_id, leaf_id, role, lnn, centre, list_transform(f, lambda x, i: (x - mu[i]) / sd[i]) AS z
      FROM examples JOIN spans USING (leaf_id) JOIN centres USING (leaf_id)),
    sums AS (
      SELECT leaf_id, i, j, sum(z[i] * CASE WHEN j = {2 * _PARTS + 1} THEN lnn - centre ELSE z[j] END) AS a
      FROM scaled, range(1, {2 * _PARTS + 1}) AS r(i), range(1, {2 * _PARTS + 2}) AS c(j)
      WHERE role = 'train' GROUP BY leaf_id, i, j),
    e0 AS MATERIALIZED (
      SELECT leaf_id, penalty, i, j, a + CASE WHEN i = j THEN penalty ELSE 0.0 END AS a
      FROM sums, (VALUES (0.1::DOUBLE), (1.0), (10.0), (100.0)) AS l(penalty)),
    {eliminated(["leaf_id", "penalty"], 2 * _PARTS)},
    weights AS (
      SELECT leaf_id, penalty, list(a ORDER BY i) AS w FROM e{2 * _PARTS} WHERE j = {2 * _PARTS + 1}
      GROUP BY leaf_id, penalty),
    said AS (
      SELECT role, leaf_id, penalty, pow(centre + list_dot_product(w, z) - lnn, 2) AS err
      FROM scaled JOIN weights USING (leaf_id) WHERE role <> 'train'),
    picked AS (
      SELECT leaf_id, penalty FROM (
        SELECT leaf_id, penalty, row_number() OVER (PARTITION BY leaf_id ORDER BY avg(err), penalty) AS r
        FROM said WHERE role = 'valid' GROUP BY leaf_id, penalty) v WHERE r = 1)"""


@register(
    "ridge_filters",
    f"""WITH {ALL_FACTS}, {RIDGE_FIT}
    SELECT leaf_id, count(*) AS n, round(sqrt(avg(err)), 3) AS rmse FROM said JOIN picked USING (leaf_id, penalty)
    WHERE role = 'calib' GROUP BY leaf_id""",
)
def ridge_filters(spark: SparkSession, sf: str) -> DataFrame:
    return _per_leaf(spark, sf, RIDGE)


@register("network_filters")
def network_filters(spark: SparkSession, sf: str) -> DataFrame:
    return _per_leaf(spark, sf, mlp())


@register(
    "valid_predictions",
    f"""WITH {ALL_FACTS}, {MODEL}
    SELECT leaf_id, count(*) AS n FROM predicted
    WHERE pred > -1e6 AND pred < 1e8 AND pred <> 0 GROUP BY leaf_id""",
)
def valid_predictions(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.valid_predictions(feeds.predicted(spark, sf))
    return rows.groupBy("leaf_id").agg(F.count("*").alias("n"))


@register(
    "residual_stats",
    f"""WITH {ALL_FACTS}, {MODEL}, {CALIBRATION}
    SELECT leaf_id, n, round(max_residual, 4) AS max_residual,
           round(mean_residual, 4) AS mean_residual, round(std_residual, 4) AS std_residual
    FROM residual_stats""",
)
def residual_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.residuals(feeds.calibration_rows(spark, sf))
    return _rounded(
        C.residual_stats(rows, ["leaf_id"]), "max_residual", "mean_residual", "std_residual"
    )


@register(
    "conformal_alphas",
    f"""WITH {ALL_FACTS}, {MODEL}, {CALIBRATION}
    SELECT leaf_id, pos, round(alpha, 4) AS alpha FROM alphas""",
)
def conformal_alphas(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(C.conformal_alphas(C.residuals(feeds.calibration_rows(spark, sf))), "alpha")


@register(
    "alpha_at_confidence",
    f"""WITH {ALL_FACTS}, {MODEL}, {CALIBRATION}
    SELECT leaf_id, round(alpha, 4) AS alpha FROM (
      SELECT *, count(*) OVER (PARTITION BY leaf_id) AS n FROM alphas) t
    WHERE pos = least(CAST(floor(n * 0.9::DOUBLE) AS BIGINT), n - 1)""",
)
def alpha_at_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(C.alpha_at_confidence(feeds.alphas(spark, sf), feeds.CONFIDENCE), "alpha")


@register(
    "mean_alpha",
    f"""WITH {ALL_FACTS}, {MODEL}, {CALIBRATION}
    SELECT count(*) AS n_filters, round(avg(alpha), 4) AS mean_alpha FROM alphas WHERE pos = 50""",
)
def mean_alpha(spark: SparkSession, sf: str) -> DataFrame:
    picked = C.alpha_at_position(feeds.alphas(spark, sf), 50)
    return _rounded(C.mean_alpha(picked), "mean_alpha")


@register(
    "prediction_intervals",
    f"""WITH {ALL_FACTS}, {MODEL}, {CALIBRATION}
    SELECT query_id, leaf_id, round(pred - alpha, 4) AS lo, round(pred + alpha, 4) AS hi,
           round(greatest(0.0, pred - alpha), 4) AS cal
    FROM calib JOIN (SELECT leaf_id, alpha FROM alphas WHERE pos = 50) a USING (leaf_id)""",
)
def prediction_intervals(spark: SparkSession, sf: str) -> DataFrame:
    margin = C.alpha_at_position(feeds.alphas(spark, sf), 50)
    rows = E.with_calibrated(feeds.calibration_rows(spark, sf).join(margin, "leaf_id"))
    out = rows.withColumn("i", prediction_interval(F.col("pred"), F.col("alpha")))
    return _rounded(out.select("query_id", "leaf_id", "i.lo", "i.hi", "cal"), "lo", "hi", "cal")


@register(
    "calib_batches_balanced",
    f"""WITH orders_q AS (SELECT c_custkey AS query_id FROM customer),
    {balanced('b', 'orders_q', 'customers',
              f"(SELECT CAST(ceil(2.5 * count(*) / {feeds.BATCH_SIZE}) AS BIGINT) * {feeds.BATCH_SIZE} FROM orders_q)")}
    SELECT query_id, count(*) AS uses, min(batch_id) AS first_batch FROM b GROUP BY query_id""",
)
def calib_batches_balanced(spark: SparkSession, sf: str) -> DataFrame:
    """As many batches as it takes for every customer to be used twice or three times."""
    ids = feeds.table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"))
    n_batches = math.ceil(2.5 * ids.count() / feeds.BATCH_SIZE)
    rows = balanced_batches(ids, n_batches, feeds.BATCH_SIZE, "customers")
    return rows.groupBy("query_id").agg(
        F.count("*").alias("uses"), F.min("batch_id").alias("first_batch")
    )


@register(
    "calibration_batches",
    f"WITH {CHAIN} SELECT batch_id, slot, query_id FROM batches",
)
def calibration_batches(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.batches(spark, sf)


@register(
    "calib_batches_uniform",
    f"""WITH q AS (SELECT c_custkey AS query_id FROM customer),
    size AS (SELECT greatest(1, least(40, count(*) // 3)) AS nb, count(*) AS n FROM q),
    placed AS (
      SELECT query_id, row_number() OVER (ORDER BY {draw('uniform', 'query_id')}, query_id) - 1 AS p
      FROM q),
    cut AS (SELECT query_id, p, n // nb AS size, least(p // (n // nb), nb - 1) AS batch_id
            FROM placed, size)
    SELECT batch_id, p - batch_id * size AS slot, query_id FROM cut""",
)
def calib_batches_uniform(spark: SparkSession, sf: str) -> DataFrame:
    ids = feeds.table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"))
    return uniform_batches(ids, 40)


BATCH_ALPHAS = """
    joined AS (SELECT r.leaf_id, r.query_id, r.residual, b.batch_id, b.slot
               FROM residual_rows r JOIN batches b USING (query_id)),
    joined_stats AS (
      SELECT leaf_id, batch_id, count(*) AS n, max(residual) AS mx, avg(residual) AS mean,
             stddev_pop(residual) AS sd FROM joined GROUP BY 1, 2),
    batch_alphas AS (
      SELECT leaf_id, batch_id,
             row_number() OVER (PARTITION BY leaf_id, batch_id ORDER BY residual, query_id) AS pos,
             residual AS alpha FROM joined
      UNION ALL SELECT leaf_id, batch_id, 0, 0.0 FROM joined_stats
      UNION ALL SELECT leaf_id, batch_id, n + 1, greatest(mx, mean + 3.0 * sd) + 1e-4
                FROM joined_stats)"""


def stored_batch_alphas(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.residuals(feeds.calibration_rows(spark, sf))
    return C.batch_alphas(rows, feeds.batches(spark, sf))


@register(
    "batch_alphas",
    f"""WITH {CHAIN}, {BATCH_ALPHAS}
    SELECT leaf_id, batch_id, pos, round(alpha, 4) AS alpha FROM batch_alphas""",
)
def batch_alphas(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stored_batch_alphas(spark, sf), "alpha")


@register(
    "max_alpha_by_position",
    f"""WITH {CHAIN}, {BATCH_ALPHAS}
    SELECT leaf_id, pos, round(max(alpha), 4) AS alpha FROM batch_alphas GROUP BY 1, 2""",
)
def max_alpha_by_position(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(C.max_alpha_by_position(stored_batch_alphas(spark, sf)), "alpha")


def recalls(spark: SparkSession, sf: str) -> DataFrame:
    rows = feeds.calibration_rows(spark, sf)
    return R.recall_by_position(
        R.target_gaps(rows), feeds.alphas(spark, sf), feeds.batches(spark, sf)
    )


@register(
    "batch_recall_by_pos",
    f"WITH {RECALL_CHAIN} SELECT batch_id, pos, round(recall, 4) AS recall FROM recalls",
)
def batch_recall_by_pos(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(recalls(spark, sf), "recall")


@register(
    "residence_recall_by_pos",
    f"""WITH {CHAIN},
    near AS (
      SELECT query_id, leaf_id, count(*) AS n FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, series_id) AS r
        FROM train_dist) t WHERE r <= 5 GROUP BY 1, 2),
    gaps AS (
      SELECT c.query_id, c.leaf_id, pred - bsf AS gap, n FROM calib c
      JOIN near USING (query_id, leaf_id)),
    positions AS (SELECT DISTINCT pos FROM alphas)
    SELECT b.batch_id, p.pos,
           round(sum(CASE WHEN g.gap IS NULL OR a.alpha >= g.gap THEN n ELSE 0 END)
                 / (30 * 5)::DOUBLE, 4) AS recall
    FROM batches b JOIN gaps g USING (query_id) CROSS JOIN positions p
    JOIN alphas a ON a.leaf_id = g.leaf_id AND a.pos = p.pos GROUP BY 1, 2""",
)
def residence_recall_by_pos(spark: SparkSession, sf: str) -> DataFrame:
    """Recall for five neighbours, weighted by where they live."""
    from driftleaf.plans.search import knn_exact

    found = feeds.stored(
        spark, sf, "train_residence",
        lambda: T.knn_residence(
            knn_exact(feeds.series(spark, sf), feeds.train_queries(spark, sf), 5)
        ),
    )
    gaps = R.residence_gaps(found, feeds.calibration_rows(spark, sf))
    out = R.recall_by_position(gaps, feeds.alphas(spark, sf), feeds.batches(spark, sf), 5)
    return _rounded(out, "recall")


@register(
    "batch_margin_recall",
    f"""WITH {RECALL_CHAIN}, {BATCH_ALPHAS},
    top_pos AS (SELECT max(pos) AS last FROM batch_alphas),
    spots AS (SELECT unnest(range(0, (SELECT last FROM top_pos) + 1)) AS pos),
    filled AS (
      SELECT b.batch_id, s.pos, b.query_id, t.gap,
             (SELECT max(a.alpha) FROM batch_alphas a
              WHERE a.leaf_id = t.leaf_id AND a.batch_id = b.batch_id AND a.pos <= s.pos) AS alpha
      FROM batches b JOIN target t USING (query_id) CROSS JOIN spots s)
    SELECT batch_id, pos, round(avg(CASE WHEN alpha >= gap THEN 1.0 ELSE 0.0 END), 4) AS recall
    FROM filled GROUP BY 1, 2""",
)
def batch_margin_recall(spark: SparkSession, sf: str) -> DataFrame:
    """The same simulation with the margins of each batch."""
    gaps = R.target_gaps(feeds.calibration_rows(spark, sf))
    out = R.recall_by_position(gaps, stored_batch_alphas(spark, sf), feeds.batches(spark, sf))
    return _rounded(out, "recall")


@register(
    "coverage_pairs",
    f"""WITH {RECALL_CHAIN}
    SELECT batch_id, pos, round(recall, 4) AS recall, round(coverage, 4) AS coverage FROM covered""",
)
def coverage_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.with_coverage(recalls(spark, sf)), "recall", "coverage")


def calibrated_triples(spark: SparkSession, sf: str) -> DataFrame:
    pairs = R.unique_pairs(R.with_coverage(recalls(spark, sf)))
    return R.triples(pairs, feeds.alphas(spark, sf))


@register(
    "unique_triples",
    f"""WITH {RECALL_CHAIN}
    SELECT leaf_id AS filter_id, recall, coverage, round(alpha, 4) AS error
    FROM pairs JOIN alphas USING (pos)""",
)
def unique_triples(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(calibrated_triples(spark, sf), "error")


@register(
    "ranked_batches",
    f"""WITH {RECALL_CHAIN}
    SELECT a.leaf_id AS filter_id,
           row_number() OVER (PARTITION BY a.leaf_id, c.pos ORDER BY c.recall, c.batch_id) AS rank,
           c.pos, round(c.recall, 4) AS recall, round(c.coverage, 4) AS coverage,
           round(a.alpha, 4) AS error FROM covered c JOIN alphas a ON a.pos = c.pos""",
)
def ranked_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.wide_rows(R.with_coverage(recalls(spark, sf)), feeds.alphas(spark, sf))
    return _rounded(rows, "recall", "coverage", "error")


CURVE = """
    curve AS (SELECT pos, avg(recall) AS recall FROM recalls GROUP BY pos),
    pinned AS (
      SELECT pos, CASE WHEN pos = (SELECT max(pos) FROM curve) THEN 1.0 - 1e-4 ELSE recall END AS r
      FROM curve),
    rising AS (
      SELECT pos, min(r - pos * 1e-4) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND
             UNBOUNDED FOLLOWING) + pos * 1e-4 AS recall FROM pinned)"""


def _curve(spark: SparkSession, sf: str) -> DataFrame:
    mean = recalls(spark, sf).groupBy("pos").agg(F.avg("recall").alias("recall"))
    return R.rising_recall_curve(mean)


@register(
    "recall_curve_fix",
    f"WITH {RECALL_CHAIN}, {CURVE} SELECT pos, round(recall, 4) AS recall FROM rising",
)
def recall_curve_fix(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_curve(spark, sf), "recall")


@register(
    "first_position_for_recall",
    f"""WITH {RECALL_CHAIN}, {CURVE}, picked AS (SELECT min(pos) AS pos FROM rising WHERE recall >= 0.9)
    SELECT leaf_id, pos, round(alpha, 4) AS alpha FROM alphas JOIN picked USING (pos)""",
)
def first_position_for_recall(spark: SparkSession, sf: str) -> DataFrame:
    curve = _curve(spark, sf).withColumn("curve", F.lit(0))
    picked = R.first_position_reaching(curve, 0.9, ["curve"]).select("pos")
    return _rounded(feeds.alphas(spark, sf).join(picked, "pos"), "alpha")


STEFFEN = """
    steps AS (
      SELECT k, x, y, lead(x) OVER w AS x1, lead(x) OVER w - x AS h,
             (lead(y) OVER w - y) / (lead(x) OVER w - x) AS s
      FROM curve_points WINDOW w AS (PARTITION BY k ORDER BY x)),
    beside AS (
      SELECT *, lag(h) OVER w AS h0, lag(s) OVER w AS s0 FROM steps
      WINDOW w AS (PARTITION BY k ORDER BY x)),
    sloped AS (
      SELECT *, CASE WHEN s0 IS NULL THEN s WHEN s IS NULL THEN s0 ELSE
               (sign(s0) + sign(s)) * least(abs(s0), abs(s), 0.5 * abs((s0 * h + s * h0) / (h0 + h)))
               END AS d0 FROM beside),
    ready AS (
      SELECT *, lead(d0) OVER (PARTITION BY k ORDER BY x) AS d1 FROM sloped),
    inside AS (
      SELECT k, (((d0 + d1 - 2 * s) / (h * h) * (goal - x) + (3 * s - 2 * d0 - d1) / h) * (goal - x) + d0)
                * (goal - x) + y AS value
      FROM ready, wish WHERE x <= goal AND goal < x1),
    spline AS (
      SELECT e.k, coalesce(i.value, CASE WHEN goal < lo THEN first_y ELSE last_y END) AS value
      FROM (SELECT k, min(x) AS lo, arg_min(y, x) AS first_y, arg_max(y, x) AS last_y
            FROM curve_points GROUP BY k) e CROSS JOIN wish LEFT JOIN inside i ON i.k = e.k)"""


@register(
    "alpha_for_recall_spline",
    f"""WITH {RECALL_CHAIN}, {CURVE}, wish AS (SELECT 0.9::DOUBLE AS goal),
    curve_points AS (
      SELECT leaf_id AS k, recall AS x, alpha AS y FROM alphas JOIN rising USING (pos)), {STEFFEN}
    SELECT k AS leaf_id, round(value, 4) AS value FROM spline""",
)
def alpha_for_recall_spline(spark: SparkSession, sf: str) -> DataFrame:
    """Margins at recall 0.9 from a monotone cubic over the recall curve."""
    from driftleaf.operators.surface import steffen_at

    rows = feeds.alphas(spark, sf).join(_curve(spark, sf), "pos")
    return _rounded(steffen_at(rows, "leaf_id", "recall", "alpha", 0.9), "value")


#: Second derivatives at the knots by a sweep up and one down, zero at both ends.
NATURAL = """
    knots AS MATERIALIZED (
      SELECT *, lag(h) OVER w AS h0, lag(s) OVER w AS s0, lead(y) OVER w AS y1 FROM (
        SELECT k, x, y, lead(x) OVER w AS x1, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY k) AS n,
               lead(x) OVER w - x AS h, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS s
        FROM curve_points WINDOW w AS (PARTITION BY k ORDER BY x)) t
      WINDOW w AS (PARTITION BY k ORDER BY x)),
    up AS (
      SELECT k, i, 0.0::DOUBLE AS factor, 0.0::DOUBLE AS rest FROM knots WHERE i = 0
      UNION ALL
      SELECT q.k, q.i, q.h / (2 * (q.h0 + q.h) - q.h0 * u.factor),
             (6 * (q.s - q.s0) - q.h0 * u.rest) / (2 * (q.h0 + q.h) - q.h0 * u.factor)
      FROM up u JOIN knots q ON q.k = u.k AND q.i = u.i + 1 WHERE q.i < q.n - 1),
    down AS (
      SELECT k, i, 0.0::DOUBLE AS bend FROM knots WHERE i = n - 1
      UNION ALL
      SELECT u.k, u.i, CASE WHEN u.i = 0 THEN 0.0 ELSE u.rest - u.factor * d.bend END
      FROM down d JOIN up u ON u.k = d.k AND u.i = d.i - 1),
    inside AS (
      SELECT q.k, (a.bend * pow(x1 - goal, 3) + b.bend * pow(goal - x, 3)) / (6 * h)
             + (y / h - a.bend * h / 6) * (x1 - goal) + (y1 / h - b.bend * h / 6) * (goal - x) AS value
      FROM knots q JOIN wish ON x <= goal AND goal < x1
      JOIN down a ON a.k = q.k AND a.i = q.i JOIN down b ON b.k = q.k AND b.i = q.i + 1),
    spline AS (
      SELECT e.k, coalesce(i.value, CASE WHEN goal < lo THEN first_y ELSE last_y END) AS value
      FROM (SELECT k, min(x) AS lo, arg_min(y, x) AS first_y, arg_max(y, x) AS last_y
            FROM curve_points GROUP BY k) e CROSS JOIN wish LEFT JOIN inside i ON i.k = e.k)"""


@register(
    "alpha_for_recall_cubic",
    f"""WITH RECURSIVE {RECALL_CHAIN}, {CURVE}, wish AS (SELECT 0.9::DOUBLE AS goal),
    curve_points AS MATERIALIZED (
      SELECT leaf_id AS k, recall AS x, alpha AS y FROM alphas JOIN rising USING (pos)), {NATURAL}
    SELECT k AS leaf_id, round(value, 4) AS value FROM spline""",
)
def alpha_for_recall_cubic(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a natural cubic spline."""
    from driftleaf.operators.surface import natural_cubic_at

    rows = feeds.alphas(spark, sf).join(_curve(spark, sf), "pos")
    return _rounded(natural_cubic_at(rows, "leaf_id", "recall", "alpha", 0.9), "value")


@register(
    "position_for_target",
    f"""WITH {RECALL_CHAIN}, {CURVE}, wish AS (SELECT 0.7::DOUBLE * 0.95 + 0.3::DOUBLE * 0.9 AS goal),
    curve_points AS (
      SELECT leaf_id AS k, recall AS x, CAST(pos AS DOUBLE) AS y FROM alphas JOIN rising USING (pos)),
    {STEFFEN}
    SELECT k AS leaf_id, CAST(greatest(0, least(round(value),
             (SELECT max(pos) FROM alphas a WHERE a.leaf_id = k))) AS BIGINT) AS pos FROM spline""",
)
def position_for_target(spark: SparkSession, sf: str) -> DataFrame:
    """Margin positions for recall 0.95 and coverage 0.9, mixed seven to three."""
    from driftleaf.operators.surface import position_for_target as at_target

    leaves = feeds.alphas(spark, sf).select("leaf_id", "pos").join(_curve(spark, sf), "pos")
    return at_target(leaves, 0.95, 0.9, 0.7, 0.3)


REPLAY_FACTS = """
    margin AS (SELECT leaf_id, alpha FROM alphas WHERE pos = 50),
    walk AS (
      SELECT c.query_id, c.leaf_id, c.lb, c.lnn, pred, alpha, greatest(0.0, pred - alpha) AS cal,
             row_number() OVER (PARTITION BY query_id ORDER BY is_resident DESC, lb, leaf_id) - 1
             AS step FROM calib c JOIN margin USING (leaf_id)),
    run AS (
      SELECT query_id, step, leaf_id, 'resident' AS action, CAST(NULL AS DOUBLE) AS bsf,
             lnn AS after FROM walk WHERE step = 0
      UNION ALL
      SELECT w.query_id, w.step, w.leaf_id,
             CASE WHEN w.lb >= r.after THEN 'bound' WHEN w.cal > r.after THEN 'filter'
                  ELSE 'visit' END,
             r.after,
             CASE WHEN w.lb >= r.after OR w.cal > r.after THEN r.after
                  ELSE least(r.after, w.lnn) END
      FROM run r JOIN walk w ON w.query_id = r.query_id AND w.step = r.step + 1)"""

REPLAY = f"WITH RECURSIVE {CHAIN}, {REPLAY_FACTS}"


def _replay_facts(spark: SparkSession, sf: str) -> DataFrame:
    margin = C.alpha_at_position(feeds.alphas(spark, sf), 50)
    return E.with_calibrated(feeds.calibration_rows(spark, sf).join(margin, "leaf_id"))


@register(
    "search_replay",
    f"{REPLAY} SELECT query_id, leaf_id, step, action, round(bsf, 4) AS bsf FROM run",
)
def search_replay(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(E.replay(_replay_facts(spark, sf)), "bsf")


@register(
    "pruning_report",
    f"""{REPLAY}, sizes AS (SELECT leaf_id, count(*) AS n FROM series GROUP BY 1),
    sized AS (SELECT * FROM run JOIN sizes USING (leaf_id))
    SELECT count(*) FILTER (WHERE action IN ('resident', 'visit')) AS visited_leaves,
           count(*) FILTER (WHERE action = 'filter') AS filter_leaves,
           count(*) FILTER (WHERE action = 'bound') AS bound_leaves,
           CAST(coalesce(sum(n) FILTER (WHERE action IN ('resident', 'visit')), 0) AS BIGINT)
             AS visited_series,
           round(coalesce(sum(n) FILTER (WHERE action IN ('filter', 'bound')), 0)
                 / sum(n)::DOUBLE, 4) AS pruned_ratio,
           round(coalesce(sum(n) FILTER (WHERE action = 'filter'), 0) / sum(n)::DOUBLE, 4)
             AS filter_ratio,
           round(coalesce(sum(n) FILTER (WHERE action = 'bound'), 0) / sum(n)::DOUBLE, 4)
             AS bound_ratio FROM sized""",
)
def pruning_report(spark: SparkSession, sf: str) -> DataFrame:
    out = E.pruning_report(E.replay(_replay_facts(spark, sf)), feeds.keyed_index(spark, sf).leaf)
    return _rounded(out, "pruned_ratio", "filter_ratio", "bound_ratio")


_LOG = """
    log AS (
      SELECT r.query_id, r.leaf_id AS node_id, w.pred AS pred_raw_distance, w.alpha AS error_calib,
             w.cal AS predicted_nn_distance, r.bsf AS minbsf, w.pred - w.lnn AS true_error,
             w.lnn AS true_distance
      FROM run r JOIN walk w ON w.query_id = r.query_id AND w.leaf_id = r.leaf_id
      WHERE r.action = 'filter')"""
_LOG_COLUMNS = [
    "pred_raw_distance", "error_calib", "predicted_nn_distance", "minbsf", "true_error",
    "true_distance",
]
_LOG_SELECT = ", ".join(f"round({c}, 4) AS {c}" for c in _LOG_COLUMNS)


def _log(spark: SparkSession, sf: str) -> DataFrame:
    rows = _replay_facts(spark, sf)
    return E.prune_log(E.replay(rows), rows)


@register("prune_log", f"{REPLAY}, {_LOG} SELECT query_id, node_id, {_LOG_SELECT} FROM log")
def prune_log(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_log(spark, sf), *_LOG_COLUMNS)


@register(
    "prune_log_file",
    f"""{REPLAY}, {_LOG} SELECT query_id, node_id, {_LOG_SELECT}, true_distance < minbsf AS wrong FROM log""",
)
def prune_log_file(spark: SparkSession, sf: str) -> DataFrame:
    """The log is appended to a file in two runs, even queries and odd ones, and read back."""
    path = new_work_path(spark, "prune-log")
    lines = _log(spark, sf)
    for odd in (0, 1):
        T_.write_log(lines.where(F.pmod("query_id", F.lit(2)) == odd), path)
    schema = "query_id long, node_id long, " + ", ".join(f"{c} double" for c in _LOG_COLUMNS)
    back = T_.read_rows(spark, path, schema)
    return _rounded(back.withColumn("wrong", F.col("true_distance") < F.col("minbsf")), *_LOG_COLUMNS)


@register(
    "wrong_prunes",
    f"{REPLAY}, {_LOG} SELECT query_id, node_id, {_LOG_SELECT} FROM log WHERE true_distance < minbsf",
)
def wrong_prunes(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(E.wrong_prunes(_log(spark, sf)), *_LOG_COLUMNS)


@register(
    "prediction_errors",
    f"""WITH {CHAIN},
    first AS (
      SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, series_id) AS r
        FROM train_dist) t WHERE r = 1)
    SELECT c.query_id, c.leaf_id AS filter_id, round(f.dist, 4) AS true_nn_distance,
           round(c.pred, 4) AS predicted_distance, round(c.pred - f.dist, 4) AS prediction_error,
           f.series_id, round(c.bsf, 4) AS bsf_distance
    FROM calib c JOIN first f ON f.query_id = c.query_id AND f.leaf_id = c.leaf_id""",
)
def prediction_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Written to an exchange file and read back."""
    from driftleaf.plans.search import knn_exact

    answers = knn_exact(feeds.series(spark, sf), feeds.train_queries(spark, sf), 1)
    path = new_work_path(spark, "query-errors")
    T_.write_rows(E.prediction_errors(answers, feeds.calibration_rows(spark, sf)), path)
    out = T_.read_rows(
        spark, path,
        "query_id long, filter_id long, true_nn_distance double, predicted_distance double, "
        "prediction_error double, series_id long, bsf_distance double",
    )
    return _rounded(
        out, "true_nn_distance", "predicted_distance", "prediction_error", "bsf_distance"
    )


@register(
    "calibration_dump",
    f"""WITH {CHAIN}, {BATCH_ALPHAS},
    near AS (
      SELECT DISTINCT query_id, leaf_id FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, series_id) AS r
        FROM train_dist) t WHERE r <= 5),
    last AS (
      SELECT leaf_id, batch_id, max(alpha) AS alpha FROM batch_alphas GROUP BY 1, 2)
    SELECT b.batch_id, b.query_id, c.leaf_id AS node_id, round(lnn, 4) AS true_distance,
           round(pred, 4) AS pred_distance, round(bsf, 4) AS bsf_distance,
           round(pred - lnn, 4) AS true_error, round(l.alpha, 4) AS abs_error
    FROM batches b JOIN near n USING (query_id)
    JOIN calib c ON c.query_id = b.query_id AND c.leaf_id = n.leaf_id
    JOIN last l ON l.leaf_id = c.leaf_id AND l.batch_id = b.batch_id""",
)
def calibration_dump(spark: SparkSession, sf: str) -> DataFrame:
    from driftleaf.plans.search import knn_exact

    found = feeds.stored(
        spark, sf, "train_residence",
        lambda: T.knn_residence(
            knn_exact(feeds.series(spark, sf), feeds.train_queries(spark, sf), 5)
        ),
    )
    last = stored_batch_alphas(spark, sf).groupBy("leaf_id", "batch_id").agg(F.max("alpha").alias("alpha"))
    path = new_work_path(spark, "calibration")
    dump = E.calibration_dump(found, feeds.calibration_rows(spark, sf), feeds.batches(spark, sf), last)
    T_.write_rows(dump, path)
    out = T_.read_rows(
        spark, path,
        "batch_id int, query_id long, node_id long, true_distance double, pred_distance double, "
        "bsf_distance double, true_error double, abs_error double",
    )
    return _rounded(
        out, "true_distance", "pred_distance", "bsf_distance", "true_error", "abs_error"
    )


@register(
    "filter_prune_ratio",
    f"""WITH {CHAIN}
    SELECT leaf_id, round(avg(CASE WHEN pred - alpha > bsf THEN 1.0 ELSE 0.0 END), 4) AS prune_ratio
    FROM predicted JOIN (SELECT leaf_id, alpha FROM alphas WHERE pos = 50) a USING (leaf_id)
    WHERE role <> 'train' GROUP BY leaf_id""",
)
def filter_prune_ratio(spark: SparkSession, sf: str) -> DataFrame:
    margin = C.alpha_at_position(feeds.alphas(spark, sf), 50)
    held = feeds.predicted(spark, sf).where(F.col("role") != "train").join(margin, "leaf_id")
    return _rounded(T.filter_prune_ratio(held), "prune_ratio")


@register(
    "model_trial",
    f"""WITH {CHAIN},
    sizes AS (SELECT leaf_id, count(*) AS n FROM series GROUP BY 1),
    picked AS (
      SELECT leaf_id FROM (
        SELECT leaf_id, row_number() OVER (ORDER BY n DESC, leaf_id) - 1 AS p,
               greatest(1, (SELECT count(*) FROM sizes) // 4) AS step FROM sizes) t
      WHERE p % step = 0 AND p < 4 * step),
    ratios AS (
      SELECT leaf_id, avg(CASE WHEN pred - alpha > bsf THEN 1.0 ELSE 0.0 END) AS prune_ratio
      FROM predicted JOIN picked USING (leaf_id)
      JOIN (SELECT leaf_id, alpha FROM alphas WHERE pos = 50) a USING (leaf_id)
      WHERE role <> 'train' GROUP BY leaf_id)
    SELECT 'linear' AS model, round(avg(prune_ratio), 4) AS model_prune FROM ratios""",
)
def model_trial(spark: SparkSession, sf: str) -> DataFrame:
    margin = C.alpha_at_position(feeds.alphas(spark, sf), 50)
    ratios = trial(feeds.facts(spark, sf), feeds.keyed_index(spark, sf).leaf, 4, margin)
    return _rounded(model_prune_rate(ratios), "model_prune")


MODELS = [CandidateModel("small", 0.3, 2.0, 1.0), CandidateModel("large", 0.5, 15.0, 3.0)]

GAINS = """
    prune AS (SELECT leaf_id, avg(CASE WHEN lb > bsf THEN 1.0 ELSE 0.0 END) AS lb_prune
              FROM facts GROUP BY leaf_id),
    sizes AS (SELECT leaf_id, count(*) AS n FROM series GROUP BY 1),
    options AS (
      SELECT leaf_id, n, model, memory,
             greatest(0.0, n * (1.0 - lb_prune) * model_prune * (1.0 - cost / n)) AS gain
      FROM sizes JOIN prune USING (leaf_id) CROSS JOIN (
        VALUES ('small', 0.3::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE),
               ('large', 0.5::DOUBLE, 15.0::DOUBLE, 3.0::DOUBLE)) m(model, model_prune, cost, memory)),
    gains AS (
      SELECT * FROM (SELECT *, row_number() OVER (
        PARTITION BY leaf_id ORDER BY gain DESC, model DESC) AS r FROM options) t WHERE r = 1)"""


def _gains(spark: SparkSession, sf: str) -> DataFrame:
    prune = T.bound_prune_frequency(feeds.facts(spark, sf))
    return filter_gains(feeds.keyed_index(spark, sf).leaf, prune, MODELS, 1.0)


@register(
    "filter_gains",
    f"""WITH {ALL_FACTS}, {GAINS}
    SELECT leaf_id, n, model, round(gain, 4) AS gain, memory FROM gains""",
)
def gains(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_gains(spark, sf), "gain")


@register(
    "budgeted_allocation",
    f"""WITH {ALL_FACTS}, {GAINS}
    SELECT leaf_id, n, model, round(gain, 4) AS gain, memory, used FROM (
      SELECT *, sum(memory) OVER (ORDER BY gain DESC, leaf_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used
      FROM gains WHERE gain > 0) t WHERE used <= 9""",
)
def budgeted_allocation(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(allocate_by_gain(_gains(spark, sf), 9.0), "gain")


@register(
    "active_filters",
    f"""WITH {ALL_FACTS}, {GAINS}, chosen AS (
      SELECT leaf_id FROM (
        SELECT *, sum(memory) OVER (ORDER BY gain DESC, leaf_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used
        FROM gains WHERE gain > 0) t WHERE used <= 9)
    SELECT (SELECT count(*) FROM chosen) AS n_active, (SELECT count(*) FROM sizes) AS n_leaves""",
)
def active_filters(spark: SparkSession, sf: str) -> DataFrame:
    leaf = feeds.keyed_index(spark, sf).leaf
    return active_count(allocate(_gains(spark, sf), leaf, 9.0))


@register(
    "size_allocation",
    """WITH sizes AS (SELECT l_suppkey AS leaf_id, count(*) AS n FROM lineitem GROUP BY 1)
       SELECT leaf_id, n FROM sizes WHERE n > 600""",
)
def size_allocation(spark: SparkSession, sf: str) -> DataFrame:
    from driftleaf.operators.leaves import leaf_sizes

    rows = feeds.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("leaf_id"))
    return allocate_by_size(leaf_sizes(rows), 600)
