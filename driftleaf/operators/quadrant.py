"""Extremes over dominated quadrants without pairing points.

"The largest value among points with smaller x and smaller y" is a two-sided prefix query. Ranks
of x are cut into dyadic blocks: a point reports to the block of every level that contains it, and
a question reads the few disjoint blocks that make up its prefix. Inside a block a running
extreme along y answers it. The row count grows by the logarithm of the distinct x values, and a
join of all pairs never arises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quadrant_extreme(
    points: DataFrame,
    by: list[str],
    x: str,
    y: str,
    value: str,
    name: str,
    largest: bool,
    above: bool,
    strict_y: bool,
) -> DataFrame:
    """Add ``name``: the extreme of ``value`` over the points of the group with strictly smaller
    x (larger if ``above``) and smaller-or-equal y (larger-or-equal if ``above``; strict if
    ``strict_y``). One row per (by, x, y) is expected."""
    x_order = F.desc(x) if above else F.asc(x)
    y_order = F.desc(y) if above else F.asc(y)
    # ranks come from the distinct values, so no group is sorted row by row
    ranks = points.select(*by, x).distinct().withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*by).orderBy(x_order)) - 1
    ).withColumn("_levels", F.length(F.bin(F.max("_rank").over(Window.partitionBy(*by)))))
    ranked = points.join(ranks, [*by, x])
    levels = F.sequence(F.lit(0), F.col("_levels") - 1)

    def shifted(level: Column) -> Column:
        return F.call_function("shiftright", F.col("_rank"), level)

    # Rows at the same y: an inclusive question sees them, a strict one does not.
    tell_turn = 1 if strict_y else 0

    def entry(level: Column, block: Column, asks: bool) -> Column:
        return F.struct(
            level.alias("level"),
            block.alias("block"),
            F.lit(1 - tell_turn if asks else tell_turn).alias("turn"),
            F.lit(asks).alias("asks"),
        )

    entries = F.concat(
        F.array(entry(F.lit(-1), F.col("_rank"), True)),
        F.transform(levels, lambda v: entry(v, shifted(v), False)),
        F.transform(
            F.filter(levels, lambda v: shifted(v).bitwiseAND(F.lit(1)) == 1),
            lambda v: entry(v, shifted(v) - 1, True),
        ),
    )
    columns = points.columns
    rows = ranked.select(*columns, F.explode(entries).alias("b"))
    running = (
        Window.partitionBy(*by, "b.level", "b.block")
        .orderBy(y_order, "b.turn")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    told = F.when(~F.col("b.asks"), F.col(value))
    extreme = (F.max if largest else F.min)
    return (
        rows.withColumn("_seen", extreme(told).over(running))
        .where("b.asks")
        .groupBy(*columns)
        .agg(extreme("_seen").alias(name))
    )
