"""Named SQL fragments that the SQL twins are composed of."""

from __future__ import annotations

from catalog.feeds import (
    BATCH_SIZE,
    BATCHES,
    LENGTH,
    NOISE,
    SEARCH_QUERIES,
    SEGMENTS,
    TRAIN_QUERIES,
)
from driftleaf.functions.draws import DRAW_SPAN, HEX_DIGITS


def draw(seed: str, *keys: str) -> str:
    text = ", ".join(["'" + seed + "'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return (
        f"(CAST('0x' || substr(md5(concat_ws(':', {text})), 1, {HEX_DIGITS}) AS BIGINT)"
        f" / CAST({DRAW_SPAN} AS DOUBLE))"
    )


def normal(seed: str, *keys: str) -> str:
    return (
        f"(sqrt(-2.0 * ln(1.0 - {draw(seed + '/r', *keys)}))"
        f" * cos(6.283185307179586 * {draw(seed + '/a', *keys)}))"
    )


def znorm(source: str, column: str, keep: str) -> str:
    """Rows of ``source`` with ``column`` z-normalised as ``values``; constant rows are dropped."""
    return f"""
    SELECT {keep}, list_transform(v, lambda x: (x - m) / s) AS "values" FROM (
      SELECT *, sqrt(list_sum(list_transform(v, lambda x: (x - m) * (x - m))) / len(v)) AS s FROM (
        SELECT *, list_sum(v) / len(v) AS m FROM (
          SELECT *, CAST({column} AS DOUBLE[]) AS v FROM {source}) a) b) c
    WHERE s > 1e-5"""


def synthetic(name: str, n: int, seed: str) -> str:
    low, high = NOISE
    noisy = (
        f"list_transform(\"values\", lambda x, i: x + level * "
        f"{normal(seed + '/noise', 'series_id', 'c', 'i - 1')})"
    )
    return f"""
    {name}_drawn AS (
      SELECT series_id, leaf_id, "values", c, c + {draw(seed, 'series_id', 'c')} AS d,
             {low} + {draw(seed + '/level', 'series_id', 'c')} * {high - low!r} AS level
      FROM series, (SELECT unnest(range(CAST(greatest(1, ceil({n} / (SELECT count(*) FROM series)))
                    AS BIGINT))) AS c) copies
      ORDER BY d, series_id LIMIT {n}),
    {name}_noisy AS (SELECT series_id, leaf_id, d, {noisy} AS noisy FROM {name}_drawn),
    {name} AS (
      SELECT row_number() OVER (ORDER BY d, series_id) - 1 AS query_id, series_id AS source_id,
             leaf_id AS source_leaf, "values"
      FROM ({znorm(name + '_noisy', 'noisy', 'series_id, leaf_id, d')}) z)"""


SERIES = f"""
    base AS (SELECT vec_id AS series_id, CAST(label AS BIGINT) AS leaf_id, embedding
             FROM embeddings),
    series AS ({znorm('base', 'embedding', 'series_id, leaf_id')})"""

SEARCH = synthetic("search", SEARCH_QUERIES, "search")
TRAIN = synthetic("train", TRAIN_QUERIES, "train")

_STEP = LENGTH // SEGMENTS

SEGMENT_ROWS = f"""
    cuts AS (SELECT unnest(range({SEGMENTS})) AS ord),
    seg_mean AS (
      SELECT series_id, leaf_id, ord, ord * {_STEP} AS off, {_STEP} AS len,
             "values"[ord * {_STEP} + 1 : ord * {_STEP} + {_STEP}] AS part,
             list_sum("values"[ord * {_STEP} + 1 : ord * {_STEP} + {_STEP}]) / {_STEP} AS mean
      FROM series, cuts),
    seg_rows AS (
      SELECT *, sqrt(list_sum(list_transform(part, lambda x: (x - mean) * (x - mean))) / {_STEP})
             AS std FROM seg_mean)"""

ENVELOPE = """
    envelope AS (
      SELECT leaf_id, ord, off, len, count(*) AS n, min(mean) AS min_mean, max(mean) AS max_mean,
             min(std) AS min_std, max(std) AS max_std
      FROM seg_rows GROUP BY leaf_id, ord, off, len)"""


def bounds(queries: str) -> str:
    """(query_id, leaf_id, lb) of every query of ``queries`` and every leaf."""
    return f"""
    {queries}_mean AS (
      SELECT query_id, ord, "values"[ord * {_STEP} + 1 : ord * {_STEP} + {_STEP}] AS part,
             list_sum("values"[ord * {_STEP} + 1 : ord * {_STEP} + {_STEP}]) / {_STEP} AS mean
      FROM {queries}, cuts),
    {queries}_seg AS (
      SELECT query_id, ord, mean,
             sqrt(list_sum(list_transform(part, lambda x: (x - mean) * (x - mean))) / {_STEP})
             AS std FROM {queries}_mean),
    {queries}_lb AS (
      SELECT query_id, leaf_id, sqrt(sum(len * (
               pow(greatest(min_mean - mean, mean - max_mean, 0.0), 2)
               + pow(greatest(min_std - std, std - max_std, 0.0), 2)))) AS lb
      FROM {queries}_seg JOIN envelope USING (ord) GROUP BY query_id, leaf_id)"""


def distances(queries: str) -> str:
    return f"""
    {queries}_dist AS (
      SELECT query_id, s.series_id, s.leaf_id, list_distance(q."values", s."values") AS dist
      FROM {queries} q, series s)"""


def top(name: str, source: str, k: int) -> str:
    return f"""
    {name} AS (
      SELECT query_id, rank, series_id, leaf_id, dist FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, series_id) AS rank
        FROM {source}) t WHERE rank <= {k})"""


FACTS = f"""
    train_lnn AS (
      SELECT query_id, leaf_id, min(dist) AS lnn FROM train_dist GROUP BY query_id, leaf_id),
    fact_rows AS (
      SELECT query_id, leaf_id, lb, lnn, leaf_id = source_leaf AS is_resident
      FROM train_lb JOIN train_lnn USING (query_id, leaf_id) JOIN train USING (query_id)),
    facts AS (
      SELECT *, min(lnn) OVER (
                  PARTITION BY query_id ORDER BY is_resident DESC, lb, leaf_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bsf,
             CASE WHEN query_id < {TRAIN_QUERIES * 2 // 6} THEN 'train'
                  WHEN query_id < {TRAIN_QUERIES * 2 // 6 + TRAIN_QUERIES // 6} THEN 'valid'
                  ELSE 'calib' END AS role
      FROM fact_rows)"""

ALL_FACTS = ",".join(
    [SERIES, TRAIN, SEGMENT_ROWS, ENVELOPE, bounds("train"), distances("train"), FACTS]
)

# A line on bounds that do not vary has no slope; DuckDB gives NaN for it, not NULL.
SLOPE = "CASE WHEN min(lb) < max(lb) THEN regr_slope(lnn, lb) ELSE 0.0 END"
INTERCEPT = "CASE WHEN min(lb) < max(lb) THEN regr_intercept(lnn, lb) ELSE avg(lnn) END"

MODEL = f"""
    model AS (
      SELECT leaf_id, {SLOPE} AS slope, {INTERCEPT} AS intercept
      FROM facts WHERE role = 'train' GROUP BY leaf_id),
    predicted AS (
      SELECT f.*, intercept + slope * lb AS pred FROM facts f JOIN model USING (leaf_id))"""

CALIBRATION = """
    calib AS (SELECT * FROM predicted WHERE role = 'calib'),
    residual_rows AS (
      SELECT *, abs(pred - lnn) AS residual FROM calib
      WHERE pred > -1e6 AND pred < 1e8 AND pred <> 0),
    residual_stats AS (
      SELECT leaf_id, count(*) AS n, max(residual) AS max_residual, avg(residual) AS mean_residual,
             stddev_pop(residual) AS std_residual FROM residual_rows GROUP BY leaf_id),
    alphas AS (
      SELECT leaf_id,
             row_number() OVER (PARTITION BY leaf_id ORDER BY residual, query_id) AS pos,
             residual AS alpha FROM residual_rows
      UNION ALL SELECT leaf_id, 0, 0.0 FROM residual_stats
      UNION ALL SELECT leaf_id, n + 1,
                       greatest(max_residual, mean_residual + 3.0 * std_residual)
                FROM residual_stats)"""


def balanced(name: str, queries: str, seed: str, total: int | str = BATCHES * BATCH_SIZE) -> str:
    return f"""
    {name}_place AS (
      SELECT query_id,
             row_number() OVER (ORDER BY {draw(seed + '/quota', 'query_id')}, query_id) AS place,
             (SELECT count(*) FROM {queries}) AS n FROM {queries}),
    {name}_quota AS (
      SELECT query_id, {total} // n + CASE WHEN place <= {total} % n THEN 1 ELSE 0 END AS quota
      FROM {name}_place),
    {name}_pool AS (
      SELECT query_id, unnest(range(1, quota + 1)) AS use FROM {name}_quota WHERE quota > 0),
    {name} AS (
      SELECT (p - 1) // {BATCH_SIZE} AS batch_id, (p - 1) % {BATCH_SIZE} AS slot, query_id FROM (
        SELECT query_id,
               row_number() OVER (ORDER BY {draw(seed + '/pool', 'query_id', 'use')},
                                  query_id, use) AS p
        FROM {name}_pool) t)"""


CALIB_BATCHES = (
    "calib_ids AS (SELECT DISTINCT query_id FROM calib),"
    + balanced("batches", "calib_ids", "calibration")
)

RECALLS = """
    target AS (
      SELECT query_id, leaf_id, pred - lnn AS gap FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lnn, leaf_id) AS r FROM calib) t
      WHERE r = 1),
    positions AS (SELECT DISTINCT pos FROM alphas),
    recalls AS (
      SELECT b.batch_id, p.pos, avg(CASE WHEN a.alpha >= t.gap THEN 1.0 ELSE 0.0 END) AS recall
      FROM batches b JOIN target t USING (query_id) CROSS JOIN positions p
      JOIN alphas a ON a.leaf_id = t.leaf_id AND a.pos = p.pos GROUP BY b.batch_id, p.pos),
    covered AS (
      SELECT r.batch_id, r.pos, r.recall,
             (SELECT count(*) FROM recalls o WHERE o.pos = r.pos AND o.recall >= r.recall)
             / CAST((SELECT count(*) FROM recalls o WHERE o.pos = r.pos) AS DOUBLE) AS coverage
      FROM recalls r),
    pairs AS (
      SELECT round(recall, 6) AS recall, round(coverage, 6) AS coverage, max(pos) AS pos
      FROM covered GROUP BY 1, 2)"""

CHAIN = ",".join([ALL_FACTS, MODEL, CALIBRATION, CALIB_BATCHES])
RECALL_CHAIN = ",".join([CHAIN, RECALLS])

RAW = """
    raw AS (
      SELECT l_suppkey AS filter_id, l_linenumber AS col_group, 0.9::DOUBLE + l_discount AS recall,
             0.92::DOUBLE + l_tax AS coverage,
             l_quantity / 10.0::DOUBLE + l_extendedprice / 123457.0::DOUBLE AS error
      FROM lineitem)"""

TRIPLES = (
    RAW
    + """,
    triples AS (
      SELECT filter_id, round(recall, 6) AS recall, round(coverage, 6) AS coverage,
             max(error) AS error FROM raw GROUP BY 1, 2, 3)"""
)

COMPACT = (
    RAW
    + """,
    largest AS (SELECT filter_id, col_group, max(error) AS error FROM raw GROUP BY 1, 2),
    compact AS (
      SELECT r.filter_id, round(r.recall, 6) AS recall, round(r.coverage, 6) AS coverage,
             max(g.error) AS error
      FROM raw r JOIN largest g ON g.filter_id = r.filter_id AND g.col_group = r.col_group
      GROUP BY 1, 2, 3)"""
)

POOL = (
    RAW
    + """,
    pool AS (
      SELECT filter_id, round(recall, 6) AS recall, round(coverage, 6) AS coverage,
             avg(error) AS pred, (min(error) + max(error)) / 2.0::DOUBLE AS actual FROM raw GROUP BY 1, 2, 3)"""
)


def eliminated(keys: list[str], size: int) -> str:
    """Gauss-Jordan steps over e0 (keys, i, j, a): ``size`` equations and, as column ``size + 1``, their right
    sides. The last step is e{size}; its last column is the solution."""
    key = ", ".join(f"c.{k}" for k in keys)

    def same(table: str) -> str:
        return " AND ".join(f"{table}.{k} = c.{k}" for k in keys)

    return ",".join(
        f"""
    e{k} AS MATERIALIZED (
      SELECT {key}, c.i, c.j, CASE WHEN c.i = {k} THEN c.a / p.a ELSE c.a - r.a * q.a / p.a END AS a
      FROM e{k - 1} c JOIN e{k - 1} p ON {same('p')} AND p.i = {k} AND p.j = {k}
      JOIN e{k - 1} q ON {same('q')} AND q.i = {k} AND q.j = c.j
      JOIN e{k - 1} r ON {same('r')} AND r.i = c.i AND r.j = {k})"""
        for k in range(1, size + 1)
    )
