"""Synthetic queries and systematic samples, from hash draws."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftleaf.functions.draws import normal_draw, unit_draw
from driftleaf.functions.series import as_doubles, let, znormalize
from driftleaf.operators.running import with_running
from driftleaf.operators.scan import scan
from driftleaf.session import broadcast_if_small, pin, series_bytes


def draw_members(members: DataFrame, n: int, seed: str) -> DataFrame:
    """``n`` draws of members, each equally likely, so leaves are drawn in proportion to their
    size. Every member is drawn before any is drawn again. Adds ``copy`` and ``draw``.

    A hash threshold keeps slightly more than ``n`` rows, so that the final ordering handles a
    bounded number of rows instead of the whole table."""
    total = members.count()
    copies = max(1, math.ceil(n / max(1, total)))
    rows = members
    if copies > 1:
        rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    else:
        rows = rows.withColumn("copy", F.lit(0))
    keyed = rows.withColumn(
        "draw", F.col("copy") + unit_draw(seed, F.col("series_id"), F.col("copy"))
    )
    share = (n + 12 * math.sqrt(n) + 60) / max(1, total)
    if share < 1.0:
        near = keyed.where(F.col("draw") < share)
        if near.select("draw").limit(n).count() >= n:
            keyed = near
    return keyed.orderBy("draw", "series_id").limit(n)


def add_noise(values: Column, low: float, high: float, seed: str, *keys: Column) -> Column:
    """Gaussian noise whose deviation is uniform in [low, high], then z-normalised."""
    level = F.lit(low) + unit_draw(f"{seed}/level", *keys) * F.lit(high - low)
    noisy = let(
        level,
        lambda sigma: F.transform(
            as_doubles(values), lambda x, i: x + sigma * normal_draw(f"{seed}/noise", *keys, i)
        ),
    )
    return znormalize(noisy)


def global_queries(
    members: DataFrame, n: int, low: float = 0.1, high: float = 0.4, seed: str = "global"
) -> DataFrame:
    """(query_id, source_id, [leaf_id as source_leaf], values): ``n`` noisy copies of drawn
    members; constant members cannot be normalised and are never drawn."""
    leaf = [F.col("leaf_id").alias("source_leaf")] if "leaf_id" in members.columns else []
    usable = members.where(znormalize(F.col("values")).isNotNull())
    drawn = draw_members(usable, n, seed)
    noisy = drawn.select(
        F.col("series_id").alias("source_id"),
        *leaf,
        "draw",
        "copy",
        add_noise(F.col("values"), low, high, seed, F.col("series_id"), F.col("copy")).alias(
            "values"
        ),
    ).where(F.col("values").isNotNull())
    order = [F.asc("draw"), F.asc("source_id"), F.asc("copy")]
    return with_running(noisy, order, number="query_id").drop("draw", "copy")


def leaf_queries(
    members: DataFrame,
    leaf: DataFrame,
    min_leaf_size: int,
    per_leaf: int = 1,
    low: float = 0.4,
    high: float = 0.4,
    seed: str = "leaf",
    repeats: bool = False,
) -> DataFrame:
    """(leaf_id, attempt, source_id, values): noisy copies of ``per_leaf`` members of every leaf
    above the size: those with the smallest hash draws. With ``repeats``, members of a leaf with
    fewer than ``per_leaf`` are drawn again, each time with other noise."""
    # The share kept of a leaf leaves room for chance, so that enough rows remain in every leaf and
    # only about as many rows as are asked for reach the shuffle, with their values.
    room = per_leaf + 12.0 * math.sqrt(per_leaf) + 60.0
    shares = leaf.where(F.col("n") > min_leaf_size).select(
        "leaf_id", (F.lit(room) / F.col("n")).alias("share")
    )
    order = Window.partitionBy("leaf_id").orderBy("draw", "series_id")
    # A share above ``room / per_leaf`` belongs to a leaf of fewer than ``per_leaf`` members.
    copies = F.ceil(F.col("share") * (per_leaf / room)).cast("int") if repeats else F.lit(1)
    again = unit_draw(seed, F.col("series_id"), F.col("copy"))
    first = add_noise(F.col("values"), low, high, seed, F.col("series_id"))
    more = add_noise(F.col("values"), low, high, seed, F.col("series_id"), F.col("copy"))
    return (
        members.join(broadcast_if_small(shares, "shares"), "leaf_id")
        .withColumn("draw", unit_draw(seed, F.col("series_id")))
        .where(F.col("draw") < F.col("share"))
        .withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
        .withColumn("draw", F.when(F.col("copy") == 0, F.col("draw")).otherwise(again))
        .withColumn("attempt", F.row_number().over(order))
        .where(F.col("attempt") <= per_leaf)
        .select(
            "leaf_id",
            "attempt",
            F.col("series_id").alias("source_id"),
            F.when(F.col("copy") == 0, first).otherwise(more).alias("values"),
        )
        .where(F.col("values").isNotNull())
    )


def local_queries(
    members: DataFrame,
    leaf: DataFrame,
    nn_stats: DataFrame,
    per_leaf: int,
    low: float = 0.1,
    high: float = 0.4,
    seed: str = "local",
    max_attempts: int = 3,
) -> DataFrame:
    """Noisy members of each leaf that stay close to it: kept when the distance to the nearest
    member of that leaf is at most mean - std of the leaf's earlier nearest distances.
    ``nn_stats``: (leaf_id, mean_lnn, std_lnn). Up to ``max_attempts`` draws per query asked for.
    Returns (leaf_id, query_no, values, lnn)."""
    limits = nn_stats.select(
        "leaf_id", (F.col("mean_lnn") - F.col("std_lnn")).alias("limit")
    ).where(F.col("limit") > 0)
    tries = leaf_queries(
        members, leaf.join(limits, "leaf_id", "left_semi"), 0, per_leaf * max_attempts, low, high,
        seed, repeats=True,
    ).withColumn("query_id", F.xxhash64("leaf_id", "attempt"))
    tries = pin(tries, "tries", series_bytes(members))
    near = (
        scan(members, tries, 1, pairs=tries.select("query_id", "leaf_id"))
        .groupBy("query_id", "leaf_id")
        .agg(F.sqrt(F.min("dist2")).alias("lnn"))
    )
    order = Window.partitionBy("leaf_id").orderBy("attempt")
    return (
        tries.join(near, ["query_id", "leaf_id"])
        .join(limits, "leaf_id")
        .where(F.col("lnn") <= F.col("limit"))
        .withColumn("query_no", F.row_number().over(order))
        .where(F.col("query_no") <= per_leaf)
        .select("leaf_id", "query_no", "values", "lnn")
    )


def every_nth_by_size(leaf: DataFrame, wanted: int) -> DataFrame:
    """A systematic sample of leaves over their size order: every ``step``-th."""
    n = leaf.count()
    step = max(1, n // max(1, wanted))
    placed = with_running(leaf, [F.desc("n"), F.asc("leaf_id")], number="pos")
    return placed.where(F.col("pos") % step == 0).where(F.col("pos") < wanted * step)


def random_rows(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows in hash order of ``key``."""
    return (
        df.withColumn("_draw", unit_draw(seed, F.col(key)))
        .orderBy("_draw", key)
        .limit(n)
        .drop("_draw")
    )
