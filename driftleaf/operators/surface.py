"""The (recall, coverage) -> error surface of a filter: cleaning, grid, repair, evaluation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftleaf.operators.quadrant import quadrant_extreme
from driftleaf.operators.quantile import exact_element
from driftleaf.session import materialise, ship_package, spread

# Fixed values of the surface.
BUMP = 1.01
NEIGHBOURS = 5
MAX_GRID = 20
GRID_MARGIN = 5
HIT_DISTANCE2 = 1e-10
BASE, FACTOR, FLOOR = 0.2, 1.4, 0.1
BOOST_FROM, RECALL_BOOST, COVERAGE_BOOST = 0.97, 10.0, 5.0

# A filter with more triples than this is spread over several tasks.
ROWS_PER_TASK = 20_000

KEY = ["filter_id"]


def index_quartile(triples: DataFrame, quarter: int = 1) -> DataFrame:
    """(filter_id, q): the element at position floor(n * quarter / 4) of the sorted errors."""
    return exact_element(triples, KEY, "error", quarter / 4, "q")


def with_dominated_flag(triples: DataFrame) -> DataFrame:
    """Add ``dominated``: the error lies below the first quartile although another point with at
    least the recall and coverage, one of them larger, has no larger error. Expects one row per
    (filter_id, recall, coverage)."""
    points = materialise(triples.select(*KEY, "recall", "coverage", "error"), "points")
    right = quadrant_extreme(
        points, KEY, "recall", "coverage", "error", "m1", largest=False, above=True, strict_y=False
    )
    above = (
        Window.partitionBy(*KEY, "recall")
        .orderBy(F.desc("coverage"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    smallest = F.coalesce(F.least("m1", "m2"), F.lit(float("inf")))
    return (
        right.withColumn("m2", F.min("error").over(above))
        .join(index_quartile(points), KEY)
        .withColumn(
            "dominated", (F.col("error") < F.col("q")) & (smallest <= F.col("error"))
        )
        .select(*KEY, "recall", "coverage", "error", "dominated")
    )


def drop_dominated(triples: DataFrame) -> DataFrame:
    return with_dominated_flag(triples).where(~F.col("dominated")).drop("dominated")


def _bump_along(triples: DataFrame, fixed: str, axis: str) -> DataFrame:
    before = F.lag("error").over(Window.partitionBy(*KEY, fixed).orderBy(axis))
    return triples.withColumn("_before", before).select(
        *KEY,
        "recall",
        "coverage",
        F.when(F.col("error") <= F.col("_before"), F.col("_before") * BUMP)
        .otherwise(F.col("error"))
        .alias("error"),
    )


def bump_monotone(triples: DataFrame) -> DataFrame:
    """Lift errors that do not grow: along coverage, then along recall, each by one percent over
    the neighbour before it, then over the largest point that is smaller on both axes."""
    step = _bump_along(triples, "recall", "coverage")
    step = materialise(_bump_along(step, "coverage", "recall"), "bumped")
    both = quadrant_extreme(
        step, KEY, "recall", "coverage", "error", "m", largest=True, above=False, strict_y=True
    )
    return both.select(
        *KEY,
        "recall",
        "coverage",
        F.when(F.col("error") <= F.col("m"), F.col("m") * BUMP)
        .otherwise(F.col("error"))
        .alias("error"),
    )


def clean_triples(triples: DataFrame) -> DataFrame:
    """Dominated points dropped and the rest lifted; written once, since bounds and grid both
    read it."""
    return materialise(bump_monotone(drop_dominated(triples)), "clean")


def surface_bounds(triples: DataFrame) -> DataFrame:
    return (
        triples.groupBy(*KEY)
        .agg(
            F.min("recall").alias("lo_r"),
            F.max("recall").alias("hi_r"),
            F.min("coverage").alias("lo_c"),
            F.max("coverage").alias("hi_c"),
            F.count("*").alias("n"),
        )
        .withColumn(
            "grid",
            F.least(F.lit(MAX_GRID), F.floor(F.sqrt("n")).cast("int") + GRID_MARGIN),
        )
    )


_GRID_SCHEMA = (
    "filter_id long, gi int, gj int, u double, v double, "
    "d double, recall double, coverage double, error double"
)
_GRID_ARROW = pa.schema(
    [("filter_id", pa.int64()), ("gi", pa.int32()), ("gj", pa.int32())]
    + [(c, pa.float64()) for c in ("u", "v", "d", "recall", "coverage", "error")]
)


def _axis(low: float, high: float, size: int) -> np.ndarray:
    return low + (high - low) * np.arange(size) / (size - 1)


class _GridNearest:
    """The nearest points of one filter to each of its grid nodes, seen so far."""

    def __init__(self, low_r: float, high_r: float, low_c: float, high_c: float, size: int) -> None:
        self.size = size
        u, v = _axis(low_r, high_r, size), _axis(low_c, high_c, size)
        self.u, self.v = np.repeat(u, size), np.tile(v, size)
        self.kept = [np.empty((size * size, 0)) for _ in range(4)]

    def add(self, r: np.ndarray, c: np.ndarray, e: np.ndarray) -> None:
        for lo in range(0, len(r), 2000):
            part = slice(lo, lo + 2000)
            du, dv = self.u[:, None] - r[part], self.v[:, None] - c[part]
            shape = du.shape
            fresh = (
                du * du + dv * dv,
                np.broadcast_to(r[part], shape),
                np.broadcast_to(c[part], shape),
                np.broadcast_to(e[part], shape),
            )
            merged = [np.concatenate(p, axis=1) for p in zip(self.kept, fresh)]
            order = np.lexsort((merged[2], merged[1], merged[0]), axis=-1)[:, :NEIGHBOURS]
            self.kept = [np.take_along_axis(m, order, axis=1) for m in merged]

    def batch(self, filter_id: int) -> pa.RecordBatch:
        width = self.kept[0].shape[1]
        node = np.repeat(np.arange(self.size * self.size), width)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(node), filter_id, dtype=np.int64)),
                pa.array((node // self.size).astype(np.int32)),
                pa.array((node % self.size).astype(np.int32)),
                pa.array(self.u[node]),
                pa.array(self.v[node]),
                *[pa.array(k.ravel()) for k in self.kept],
            ],
            schema=_GRID_ARROW,
        )


def nearest_to_grid(triples: DataFrame) -> DataFrame:
    """(filter_id, gi, gj, u, v, d, recall, coverage, error, rank): the five triples nearest to
    every node of the filter's grid. Each task keeps five per node, so a filter that holds most
    of the triples is spread over all tasks."""
    ship_package(triples.sparkSession)
    salt = F.pmod(
        F.xxhash64("recall", "coverage"), F.ceil(F.col("n") / F.lit(ROWS_PER_TASK)).cast("int")
    )
    rows = spread(
        triples.join(surface_bounds(triples), KEY).withColumn("salt", salt),
        *KEY,
        "salt",
        rows=triples.count(),
    ).select(*KEY, "recall", "coverage", "error", "lo_r", "hi_r", "lo_c", "hi_c", "grid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, _GridNearest] = {}
        for batch in batches:
            for key, pdf in batch.to_pandas().groupby("filter_id", sort=False):
                if key not in seen:
                    top = pdf.iloc[0]
                    seen[key] = _GridNearest(
                        top["lo_r"], top["hi_r"], top["lo_c"], top["hi_c"], int(top["grid"])
                    )
                seen[key].add(
                    pdf["recall"].to_numpy(), pdf["coverage"].to_numpy(), pdf["error"].to_numpy()
                )
            if len(seen) > 1000:
                for key, grid in seen.items():
                    yield grid.batch(key)
                seen = {}
        for key, grid in seen.items():
            yield grid.batch(key)

    order = Window.partitionBy(*KEY, "gi", "gj").orderBy("d", "recall", "coverage")
    return (
        rows.mapInArrow(run, _GRID_SCHEMA)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= NEIGHBOURS)
    )


def _grid_errors(
    r: np.ndarray, c: np.ndarray, e: np.ndarray, u: np.ndarray, v: np.ndarray
) -> np.ndarray:
    """The largest error of the five points nearest to each node; points come by recall and coverage, which
    is how ties go."""
    k, out = min(NEIGHBOURS, len(r)), np.empty(len(u))
    step = max(1, (1 << 20) // len(r))
    for lo in range(0, len(u), step):
        part = slice(lo, lo + step)
        du, dv = u[part, None] - r, v[part, None] - c
        d = du * du + dv * dv
        kth = np.partition(d, k - 1, axis=1)[:, k - 1]
        near = d <= kth[:, None]
        for row in np.flatnonzero(near.sum(1) > k):
            first = np.argsort(d[row], kind="stable")[:k]
            near[row] = False
            near[row, first] = True
        out[part] = np.where(near, e, -np.inf).max(1)
    return out


_SURFACE = "filter_id long, recall double, coverage double, error double"


def _packed(rows: DataFrame) -> DataFrame:
    """(filter_id, points): the rows of a filter by recall and coverage in one array."""
    return rows.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("recall", "coverage", "error"))).alias("points"))


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, filter_id, recall, coverage, error) of every packed filter."""
    points = batch.column("points")
    ends, flat = points.offsets.to_numpy(), points.values
    columns = [flat.field(i).to_numpy(zero_copy_only=False) for i in range(3)]
    for i, key in enumerate(batch.column("filter_id").to_pylist()):
        yield i, key, *[column[ends[i] : ends[i + 1]] for column in columns]


def fit_grid(triples: DataFrame) -> DataFrame:
    """(filter_id, recall, coverage, error): at each grid node the largest error of its five
    nearest triples. A filter whose triples fit a task is met whole by one; others are spread."""
    ship_package(triples.sparkSession)
    bounds = materialise(surface_bounds(triples), "bounds")
    small = bounds.where(F.col("n") <= ROWS_PER_TASK)
    large = bounds.where(F.col("n") > ROWS_PER_TASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ends = [some.column(c).to_numpy(zero_copy_only=False) for c in ("lo_r", "hi_r", "lo_c", "hi_c", "grid")]
                parts = []
                for i, key, r, c, e in _unpacked(some):
                    low_r, high_r, low_c, high_c, size = (column[i] for column in ends)
                    # Nodes of an axis without extent are one node.
                    us, vs = np.unique(_axis(low_r, high_r, int(size))), np.unique(_axis(low_c, high_c, int(size)))
                    u, v = np.repeat(us, len(vs)), np.tile(vs, len(us))
                    parts.append((np.full(len(u), key, np.int64), u, v, _grid_errors(r, c, e, u, v)))
                if parts:
                    columns = [pa.array(np.concatenate(p)) for p in zip(*parts)]
                    yield pa.RecordBatch.from_arrays(columns, names=["filter_id", "recall", "coverage", "error"])

    mine = triples.join(small.select(*KEY), KEY, "left_semi")
    grid = _packed(mine).join(small, KEY).mapInArrow(run, _SURFACE)
    if not large.isEmpty():
        spread_out = nearest_to_grid(triples.join(large.select(*KEY), KEY, "left_semi"))
        grid = grid.unionByName(
            spread_out.groupBy(*KEY, F.col("u").alias("recall"), F.col("v").alias("coverage")).agg(
                F.max("error").alias("error")
            )
        )
    # At most ``MAX_GRID`` squared rows a filter; windows and groups of a filter need no other shuffle.
    return grid.repartition(*KEY)


def running_maximum(surface: DataFrame, value: str = "error") -> DataFrame:
    """Make a gridded surface rise along coverage and then along recall."""
    keys = [k for k in KEY if k in surface.columns]

    def up(fixed: str, axis: str):
        return (
            Window.partitionBy(*keys, fixed)
            .orderBy(axis)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )

    step = surface.withColumn(value, F.max(value).over(up("recall", "coverage")))
    return step.withColumn(value, F.max(value).over(up("coverage", "recall")))


@dataclass(frozen=True)
class DenseGrid:
    """Evenly spaced evaluation points, ``size`` on each axis."""

    recalls: tuple[float, float]
    coverages: tuple[float, float]
    size: int = 50


Targets = Sequence[tuple[float, float]] | DenseGrid


def with_targets(df: DataFrame, targets: Targets) -> DataFrame:
    """Every row with every target point, as ``target_r`` and ``target_c``."""
    if isinstance(targets, DenseGrid):
        steps = F.sequence(F.lit(0), F.lit(targets.size - 1))

        def on(axis: tuple[float, float], step: str) -> Column:
            return F.lit(axis[0]) + F.col(step) * ((axis[1] - axis[0]) / (targets.size - 1))

        return (
            df.withColumn("_i", F.explode(steps))
            .withColumn("_j", F.explode(steps))
            .withColumn("target_r", on(targets.recalls, "_i"))
            .withColumn("target_c", on(targets.coverages, "_j"))
            .drop("_i", "_j")
        )
    points = F.array(
        *[F.struct(F.lit(r).alias("target_r"), F.lit(c).alias("target_c")) for r, c in targets]
    )
    return df.withColumn("_t", F.explode(points)).select(*df.columns, "_t.*")


def boost(recall: Column, coverage: Column) -> Column:
    return F.when(recall >= BOOST_FROM, (recall - BOOST_FROM) * RECALL_BOOST).otherwise(
        0.0
    ) + F.when(coverage >= BOOST_FROM, (coverage - BOOST_FROM) * COVERAGE_BOOST).otherwise(0.0)


def _target_arrays(targets: Targets) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(targets, DenseGrid):
        r, c = (a[0] + np.arange(targets.size) * ((a[1] - a[0]) / (targets.size - 1)) for a in (targets.recalls, targets.coverages))
        return np.repeat(r, targets.size), np.tile(c, targets.size)
    points = np.array(targets, float).reshape(-1, 2)
    return points[:, 0], points[:, 1]


def predict_surface(
    surface: DataFrame, bounds: DataFrame, targets: Targets
) -> DataFrame:
    """(filter_id, target_r, target_c, error) from a repaired grid, by inverse fourth power of
    the distance; targets are pulled into the data bounds first. The nodes of a filter meet its targets as
    matrices: a row for every pair of them would be several thousand a filter."""
    ship_package(surface.sparkSession)
    target_r, target_c = _target_arrays(targets)

    def lift(at: np.ndarray, by: float) -> np.ndarray:
        return np.where(at >= BOOST_FROM, (at - BOOST_FROM) * by, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ends = [some.column(c).to_numpy(zero_copy_only=False) for c in ("lo_r", "hi_r", "lo_c", "hi_c")]
                keys, errors = [], []
                for i, key, r, c, e in _unpacked(some):
                    low_r, high_r, low_c, high_c = (column[i] for column in ends)
                    bound_r = np.maximum(low_r, np.minimum(high_r, target_r))
                    bound_c = np.maximum(low_c, np.minimum(high_c, target_c))
                    d = (r - bound_r[:, None]) ** 2 + (c - bound_c[:, None]) ** 2
                    near = d < HIT_DISTANCE2
                    weight = np.where(near, 0.0, 1.0 / np.where(near, 1.0, d * d))
                    with np.errstate(invalid="ignore"):
                        mean = (weight @ e) / weight.sum(1)
                    hit = np.where(near, e, -np.inf).max(1)
                    up = lift(bound_r, RECALL_BOOST) + lift(bound_c, COVERAGE_BOOST)
                    said = np.where(near.any(1), hit + up, BASE + FACTOR * mean + up)
                    keys.append(np.full(len(said), key, np.int64))
                    errors.append(np.maximum(FLOOR, said))
                if keys:
                    columns = [np.concatenate(keys), np.tile(target_r, len(keys)), np.tile(target_c, len(keys)), np.concatenate(errors)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["filter_id", "target_r", "target_c", "error"])

    asked = _packed(surface).join(bounds.select(*KEY, "lo_r", "hi_r", "lo_c", "hi_c"), KEY)
    return asked.mapInArrow(run, "filter_id long, target_r double, target_c double, error double")


def surface_at(triples: DataFrame, targets: Targets) -> DataFrame:
    """Clean, grid, repair, evaluate."""
    clean = clean_triples(triples)
    return predict_surface(running_maximum(fit_grid(clean)), surface_bounds(clean), targets)


def polynomial_terms(recall: Column, coverage: Column) -> list[Column]:
    return [
        F.lit(1.0), recall, coverage, recall * coverage, recall * recall, coverage * coverage,
    ]


def fit_quadratic(triples: DataFrame) -> DataFrame:
    """(filter_id, n, mid_r, mid_c, coefficients): least squares on up to six polynomial terms, at
    most n - 1 of them, about the mean point. The moments are summed by the engine; only the
    solve of six equations per filter is Python."""
    ship_package(triples.sparkSession)
    middle = triples.groupBy(*KEY).agg(
        F.avg("recall").alias("mid_r"), F.avg("coverage").alias("mid_c")
    )
    terms = polynomial_terms(F.col("recall") - F.col("mid_r"), F.col("coverage") - F.col("mid_c"))
    products = [F.sum(a * b) for i, a in enumerate(terms) for b in terms[: i + 1]]
    moments = (
        triples.join(middle, KEY)
        .groupBy(*KEY, "mid_r", "mid_c")
        .agg(
            F.count("*").alias("n"),
            F.array(*products).alias("gram"),
            F.array(*[F.sum(a * F.col("error")) for a in terms]).alias("rhs"),
        )
    )

    @F.pandas_udf("array<double>")
    def solve(n: pd.Series, gram: pd.Series, rhs: pd.Series) -> pd.Series:
        out = []
        low = np.tril_indices(6)
        for count, g, b in zip(n, gram, rhs):
            full = np.zeros((6, 6))
            full[low] = np.asarray(g)
            full = full + np.tril(full, -1).T
            k = min(6, count - 1) if count > 2 else 1
            diagonal = np.diag(full)[:k]
            scale = np.sqrt(np.where(diagonal > 0, diagonal, 1.0))
            unit = full[:k, :k] / np.outer(scale, scale)
            out.append(list(np.linalg.lstsq(unit, np.asarray(b)[:k] / scale, rcond=1e-13)[0] / scale))
        return pd.Series(out)

    return moments.select(
        *KEY, "n", "mid_r", "mid_c", solve("n", "gram", "rhs").alias("coefficients")
    )


def predict_quadratic(models: DataFrame, targets: Targets) -> DataFrame:
    terms = polynomial_terms(F.col("target_r") - F.col("mid_r"), F.col("target_c") - F.col("mid_c"))
    weights = [F.coalesce(F.get("coefficients", F.lit(i)), F.lit(0.0)) for i in range(6)]
    value = sum((w * t for w, t in zip(weights[1:], terms[1:])), weights[0])
    return with_targets(models, targets).select(
        *KEY, "target_r", "target_c", value.alias("error")
    )


def polynomial_value(coefficients: Column, x: Column) -> Column:
    """c0 + c1 x + c2 x^2 + ... ."""
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda acc, c: acc * x + c)


def steffen_at(curve: DataFrame, key: str, x: str, y: str, at: float) -> DataFrame:
    """(key, value): a monotone cubic through the points of each curve, evaluated at ``at``;
    outside the points the nearest end value. Points must differ in x."""
    order = Window.partitionBy(key).orderBy(x)
    h, s = F.col("h"), F.col("s")
    steps = (
        curve.select(key, F.col(x).alias("x"), F.col(y).alias("y"))
        .withColumn("x1", F.lead("x").over(Window.partitionBy(key).orderBy("x")))
        .withColumn("y1", F.lead("y").over(Window.partitionBy(key).orderBy("x")))
        .withColumn("h", F.col("x1") - F.col("x"))
        .withColumn("s", (F.col("y1") - F.col("y")) / F.col("h"))
    )
    order = Window.partitionBy(key).orderBy("x")
    h0, s0 = F.lag("h").over(order), F.lag("s").over(order)
    p = (s0 * h + s * h0) / (h0 + h)
    slope = F.when(s0.isNull(), s).when(s.isNull(), s0).otherwise(
        (F.signum(s0) + F.signum(s)) * F.least(F.abs(s0), F.abs(s), 0.5 * F.abs(p))
    )
    sloped = steps.withColumn("d0", slope)
    sloped = sloped.withColumn("d1", F.lead("d0").over(order))
    t = F.lit(at) - F.col("x")
    a = (F.col("d0") + F.col("d1") - 2.0 * s) / (h * h)
    b = (3.0 * s - 2.0 * F.col("d0") - F.col("d1")) / h
    value = ((a * t + b) * t + F.col("d0")) * t + F.col("y")
    inside = (F.col("x") <= at) & (F.lit(at) < F.col("x1"))
    ends = F.when(F.lit(at) < F.min("x"), F.min_by("y", "x")).when(
        F.lit(at) >= F.max("x"), F.max_by("y", "x")
    )
    return sloped.groupBy(key).agg(
        F.coalesce(F.max(F.when(inside, value)), ends).alias("value")
    )


def natural_cubic_at(curve: DataFrame, key: str, x: str, y: str, at: float) -> DataFrame:
    """(key, value): the natural cubic spline through the points of each curve, evaluated at
    ``at``; outside the points the nearest end value. A curve has one point per margin position."""
    ship_package(curve.sparkSession)

    def value(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        xs, ys = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        where = float(np.clip(at, xs[0], xs[-1]))
        out = ys[0]
        if len(xs) > 1:
            h = np.diff(xs)
            rise = np.diff(ys) / h
            bend = _natural_bends(h, rise)
            i = int(np.clip(np.searchsorted(xs, where, side="right") - 1, 0, len(h) - 1))
            a, b = xs[i + 1] - where, where - xs[i]
            out = (
                (bend[i] * a**3 + bend[i + 1] * b**3) / (6 * h[i])
                + (ys[i] / h[i] - bend[i] * h[i] / 6) * a
                + (ys[i + 1] / h[i] - bend[i + 1] * h[i] / 6) * b
            )
        return pd.DataFrame({key: [pdf[key].iloc[0]], "value": [out]})

    points = curve.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return points.groupBy(key).applyInPandas(value, f"{key} long, value double")


def _natural_bends(h: np.ndarray, rise: np.ndarray) -> np.ndarray:
    """Second derivatives at the knots, zero at both ends: one tridiagonal sweep."""
    n = len(h) + 1
    bend, factor, right = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(1, n - 1):
        pivot = 2 * (h[i - 1] + h[i]) - h[i - 1] * factor[i - 1]
        factor[i] = h[i] / pivot
        right[i] = (6 * (rise[i] - rise[i - 1]) - h[i - 1] * right[i - 1]) / pivot
    for i in range(n - 2, 0, -1):
        bend[i] = right[i] - factor[i] * bend[i + 1]
    return bend


def position_for_target(
    curve: DataFrame, recall: float, coverage: float, w_recall: float, w_coverage: float
) -> DataFrame:
    """The position that a weighted mix of recall and coverage asks for, rounded and kept inside
    the curve. ``curve``: (leaf_id, pos, recall)."""
    mix = w_recall * recall + w_coverage * coverage
    last = curve.groupBy("leaf_id").agg(F.max("pos").alias("last"))
    raw = steffen_at(curve.withColumn("p", F.col("pos").cast("double")), "leaf_id", "recall", "p", mix)
    return raw.join(last, "leaf_id").select(
        "leaf_id",
        F.least(F.greatest(F.round("value").cast("int"), F.lit(0)), F.col("last")).alias("pos"),
    )
