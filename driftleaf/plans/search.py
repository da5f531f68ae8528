"""The search modes: full scan, resident leaf, bound pruning, learned pruning, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftleaf.operators.bounds import SLACK, leaf_bounds
from driftleaf.operators.descent import descend, descend_by_join
from driftleaf.operators.scan import scan, top_k
from driftleaf.operators.within import member_cells, scan_within
from driftleaf.plans.index import Index
from driftleaf.session import materialise, pin, series_bytes
from driftleaf.settings import broadcast_budget

# Fewer queries never make more pairs than a search can hold; how many of more are asked for their leaves.
MANY_QUERIES, SAMPLED_QUERIES = 2000, 500

ANSWER = ["query_id", "rank", "series_id", "leaf_id", "dist"]


def knn_exact(series: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact nearest neighbours by reading every series once."""
    return top_k(scan(series, queries, k), k).select(*ANSWER)


def knn_resident(index: Index, queries: DataFrame, k: int, resident: DataFrame | None = None):
    """Approximate: only the leaf a query falls into."""
    resident = index.resident(queries) if resident is None else resident
    return top_k(scan(index.members, queries, k, pairs=resident), k).select(*ANSWER)


def _pinned(
    index: Index, queries: DataFrame, resident: DataFrame | None
) -> tuple[DataFrame, DataFrame]:
    """Queries and their resident leaves, evaluated once."""
    columns = ["query_id", "values"]
    if index.route_column != "values":
        columns.append(index.route_column)
    if not hasattr(queries, "_held"):
        queries = pin(
            queries.select(*columns), "queries", series_bytes(queries) * (len(columns) - 1)
        )
    resident = index.resident(queries) if resident is None else resident
    return queries, pin(resident.select("query_id", "leaf_id"), "resident")


def seed_limits(
    index: Index, queries: DataFrame, k: int, resident: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Answers from the resident leaf, and the queries with ``kth``: the distance to beat, NULL
    while fewer than k members were seen."""
    best = top_k(scan(index.members, queries, k, pairs=resident), k)
    first = pin(best.select("query_id", "leaf_id", "series_id", "dist2"), "seed")
    return first, queries.join(_kth(first, k), "query_id", "left")


def _kth(best: DataFrame, k: int) -> DataFrame:
    return (
        best.groupBy("query_id")
        .agg(F.count("*").alias("n"), F.sqrt(F.max("dist2")).alias("kth"))
        .where(F.col("n") == k)
        .drop("n")
    )


def candidates(
    index: Index, limited: DataFrame, resident: DataFrame
) -> DataFrame:
    """(query_id, leaf_id, lb) of the other leaves whose bound does not exceed ``kth``; with a tree no
    leaf below a node whose bound does."""
    asked = limited.select("query_id", F.col(index.route_column).alias("values"), "kth")
    if index.nodes is None:
        bounds = leaf_bounds(asked, index.leaf, "kth", index.shipped_leaves)
    elif index.shipped_nodes is not None:
        bounds = descend(asked, index.shipped_nodes)
    else:
        bounds = descend_by_join(asked, index.nodes)
    return bounds.join(resident.select("query_id", "leaf_id"), ["query_id", "leaf_id"], "left_anti")


def _without_pairs(index: Index, limited: DataFrame, resident: DataFrame, k: int) -> DataFrame | None:
    """The scan that takes bounds in the tasks, where a table of (query, leaf) pairs would be larger than what
    that scan sends; None where it would not. A sample of the queries tells how many leaves one wants."""
    spark = limited.sparkSession
    n_queries = limited.count()
    budget = broadcast_budget(spark)
    if n_queries < MANY_QUERIES:
        return None
    wanted = limited.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-n_queries // SAMPLED_QUERIES))) == 0)
    n_wanted = wanted.count()
    if not n_wanted or index.shipped_leaves is None:
        return None
    each = candidates(index, wanted, resident).count() / n_wanted
    n_members = index.members.count()
    small = n_queries * series_bytes(limited) <= budget
    if each * n_queries * 16 <= budget if small else each <= 2 * member_cells(limited, n_members):
        return None
    return scan_within(index.members, limited, k, index.shipped_leaves, n_queries, n_members)


def knn_pruned(
    index: Index,
    queries: DataFrame,
    k: int,
    resident: DataFrame | None = None,
    keep: DataFrame | None = None,
) -> DataFrame:
    """Nearest neighbours with bound pruning: the resident leaf gives a first k-th distance, and
    only leaves whose bound does not exceed it are read. Exact when the index has exact bounds.
    ``keep`` (query_id, leaf_id) drops further candidates; see ``knn_filtered``."""
    queries, resident = _pinned(index, queries, resident)
    first, limited = seed_limits(index, queries, k, resident)
    if keep is None and index.exact_bounds:
        rest = _without_pairs(index, limited, resident, k)
        if rest is not None:
            return top_k(rest, k).select(*ANSWER)
    left = candidates(index, limited, resident)
    if keep is not None:
        left = left.join(keep.select("query_id", "leaf_id"), ["query_id", "leaf_id"], "left_semi")
    rest = scan(index.members, queries, k, pairs=left)
    return top_k(first.unionByName(rest), k).select(*ANSWER)


def calibrated(pred: Column, alpha: Column) -> Column:
    """Prediction minus its margin, at least 0; the raw prediction when there is no margin."""
    return F.when(alpha.isNull(), pred).otherwise(F.greatest(F.lit(0.0), pred - alpha))


def prediction_interval(pred: Column, alpha: Column) -> Column:
    return F.struct((pred - alpha).alias("lo"), (pred + alpha).alias("hi"))


def knn_filtered(
    index: Index,
    queries: DataFrame,
    k: int,
    predictions: DataFrame,
    resident: DataFrame | None = None,
) -> DataFrame:
    """Bound pruning plus learned pruning. ``predictions``: (query_id, leaf_id, pred, alpha) for
    leaves with an active filter; a leaf without one is never pruned by it."""
    queries, resident = _pinned(index, queries, resident)
    first, limited = seed_limits(index, queries, k, resident)
    left = candidates(index, limited, resident)
    kept = learned_keep(left, limited, predictions)
    rest = scan(index.members, queries, k, pairs=kept)
    return top_k(first.unionByName(rest), k).select(*ANSWER)


def knn_in_rounds(
    index: Index,
    queries: DataFrame,
    k: int,
    predictions: DataFrame | None = None,
    resident: DataFrame | None = None,
    first: int = 1,
    growth: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """The answers of ``knn_pruned``, or with ``predictions`` those of a filtered search, and what was read
    for them: (query_id, leaf_id, round).

    Every round reads, for each query, the leaves with the lowest bounds among those left, ``first`` of
    them and then ``growth`` times as many in each further round. The k-th distance found so far
    then drops leaves before they are read. So the rounds are few, and their number depends on the
    leaves of a query, not on the data. A filter is asked again in every round with the distance
    that it has to beat."""
    queries, resident = _pinned(index, queries, resident)
    best, limited = seed_limits(index, queries, k, resident)
    left = materialise(candidates(index, limited, resident), "left")
    read = resident.select("query_id", "leaf_id", F.lit(0).alias("round"))
    width, number = first, 1
    while True:
        open_leaves = left if predictions is None else learned_keep(left, limited, predictions)
        turn = F.row_number().over(Window.partitionBy("query_id").orderBy("lb", "leaf_id"))
        ranked = materialise(open_leaves.withColumn("_turn", turn), "round")
        taken = ranked.where(F.col("_turn") <= width).select("query_id", "leaf_id")
        if taken.isEmpty():
            return top_k(best, k).select(*ANSWER), read
        read = read.unionByName(taken.withColumn("round", F.lit(number)))
        fresh = scan(index.members, queries, k, pairs=taken)
        best = materialise(
            top_k(best.unionByName(fresh), k).select("query_id", "leaf_id", "series_id", "dist2"), "best"
        )
        limited = queries.join(_kth(best, k), "query_id", "left")
        near = F.col("kth").isNull() | (F.col("lb") <= F.col("kth") * (1 + SLACK) + SLACK)
        rest = ranked.where(F.col("_turn") > width).select("query_id", "leaf_id", "lb")
        rest = rest.join(limited.select("query_id", "kth"), "query_id").where(near).drop("kth")
        left, width, number = rest, width * growth, number + 1


def learned_keep(left: DataFrame, limited: DataFrame, predictions: DataFrame) -> DataFrame:
    """Candidates that the filters do not prune: a leaf goes when its calibrated prediction
    exceeds the k-th distance."""
    return (
        left.join(
            predictions.select("query_id", "leaf_id", "pred", "alpha"),
            ["query_id", "leaf_id"],
            "left",
        )
        .join(limited.select("query_id", "kth"), "query_id")
        .withColumn("cal", calibrated(F.col("pred"), F.col("alpha")))
        .where(F.coalesce(F.col("cal") <= F.col("kth"), F.lit(True)))
        .select("query_id", "leaf_id", "lb")
    )


def within_budget(
    ordered: DataFrame, order: list[Column], max_leaves: int | None, max_series: int | None
) -> DataFrame:
    """Leaves of each query in visiting order until a budget is used up. ``ordered`` has
    (query_id, leaf_id, n). A leaf is visited while both counts before it are below budget."""
    before = (
        Window.partitionBy("query_id")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    out = ordered.withColumn("leaves_before", F.count("*").over(before)).withColumn(
        "series_before", F.coalesce(F.sum("n").over(before), F.lit(0))
    )
    if max_leaves is not None:
        out = out.where(F.col("leaves_before") < max_leaves)
    if max_series is not None:
        out = out.where(F.col("series_before") < max_series)
    return out


def knn_budgeted(
    index: Index,
    queries: DataFrame,
    k: int,
    max_leaves: int | None = None,
    max_series: int | None = None,
    resident: DataFrame | None = None,
    scores: DataFrame | None = None,
) -> DataFrame:
    """Approximate search with a visiting budget. The resident leaf comes first, then leaves by
    ``scores`` (query_id, leaf_id, score), best first, or by bound when none are given."""
    queries, resident = _pinned(index, queries, resident)
    first, limited = seed_limits(index, queries, k, resident)
    left = candidates(index, limited, resident).join(index.leaf.select("leaf_id", "n"), "leaf_id")
    if scores is None:
        order = [F.asc("lb"), F.asc("leaf_id")]
    else:
        left = left.join(scores, ["query_id", "leaf_id"], "left").fillna(0.0, ["score"])
        order = [F.desc("score"), F.asc("leaf_id")]
    allowed = within_budget(left, order, max_leaves, max_series)
    rest = scan(index.members, queries, k, pairs=allowed)
    return top_k(first.unionByName(rest), k).select(*ANSWER)
