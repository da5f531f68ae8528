"""Column expressions on series held as arrays."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftleaf.settings import EPSILON

# Fixed value: single-precision machine epsilon.
FLOAT_EPSILON = 1.1920929e-07


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def as_doubles(values: Column) -> Column:
    return values.cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _mean(values: Column) -> Column:
    return total(values) / F.size(values)


def _std_about(values: Column, centre: Column) -> Column:
    squares = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - centre) * (x - centre))
    return F.sqrt(squares / F.size(values))


def _mean_std(values: Column) -> Column:
    return let(
        _mean(values),
        lambda m: F.struct(m.alias("mean"), _std_about(values, m).alias("std")),
    )


def mean(values: Column) -> Column:
    return let(values, _mean)


def std(values: Column) -> Column:
    """Population standard deviation, in two passes."""
    return let(values, lambda v: let(_mean(v), lambda m: _std_about(v, m)))


def mean_std(values: Column) -> Column:
    return let(values, _mean_std)


def segment(values: Column, offset: Column | int, length: Column | int) -> Column:
    return F.slice(values, offset + 1, length)


def znormalize(values: Column) -> Column:
    """Zero mean and unit deviation; NULL for a series with no spread."""

    def scaled(v: Column, ms: Column) -> Column:
        return F.when(ms["std"] > EPSILON, F.transform(v, lambda x: (x - ms["mean"]) / ms["std"]))

    return let(as_doubles(values), lambda v: let(_mean_std(v), lambda ms: scaled(v, ms)))


def l2_squared(left: Column, right: Column) -> Column:
    return total(F.zip_with(left, right, lambda a, b: (a - b) * (a - b)))


def l2(left: Column, right: Column) -> Column:
    return F.sqrt(l2_squared(left, right))


def segmentation(length: int, parts: int) -> list[tuple[int, int]]:
    """(offset, length) of equal parts; the last one takes the remainder."""
    step = length // parts
    cuts = [i * step for i in range(parts)] + [length]
    return [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(parts)]


def segments_literal(segments: Sequence[tuple[int, int]]) -> Column:
    return F.array(
        *[F.struct(F.lit(off).alias("off"), F.lit(n).alias("len")) for off, n in segments]
    )


def segment_summary(values: Column, segments: Column) -> Column:
    """``array<struct<off,len,mean,std>>``: one entry per segment."""

    def entry(seg: Column) -> Column:
        part = segment(values, seg["off"], seg["len"])
        return let(
            mean_std(part),
            lambda ms: F.struct(
                seg["off"].alias("off"),
                seg["len"].alias("len"),
                ms["mean"].alias("mean"),
                ms["std"].alias("std"),
            ),
        )

    return F.transform(segments, entry)


def _outside(low: Column, high: Column, x: Column) -> Column:
    return F.greatest(low - x, x - high, F.lit(0.0))


def lower_bound_squared(values: Column, envelope: Column) -> Column:
    """Squared distance that no member inside ``envelope`` can undercut. ``envelope`` is
    ``array<struct<off,len,min_mean,max_mean,min_std,max_std>>``."""

    def term(seg: Column) -> Column:
        part = segment(values, seg["off"], seg["len"])

        def gap(ms: Column) -> Column:
            dm = _outside(seg["min_mean"], seg["max_mean"], ms["mean"])
            ds = _outside(seg["min_std"], seg["max_std"], ms["std"])
            return seg["len"] * (dm * dm + ds * ds)

        return let(mean_std(part), gap)

    return total(F.transform(envelope, term))


def nearly_equal(a: Column, b: Column, eps: float = FLOAT_EPSILON) -> Column:
    return F.abs(a - b) <= eps * F.greatest(F.abs(a), F.abs(b))


def is_zero(a: Column, eps: float = FLOAT_EPSILON) -> Column:
    return F.abs(a) <= eps


def to_root(dist2: Column) -> Column:
    return F.sqrt(dist2)


def to_square(dist: Column) -> Column:
    return dist * dist
