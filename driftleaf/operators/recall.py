"""Recall, coverage and the step from calibration hits to (recall, coverage, error) triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftleaf.settings import EPSILON_GAP


def nearest_leaf(facts: DataFrame) -> DataFrame:
    """The leaf that holds the nearest neighbour of each query."""
    return facts.groupBy("query_id").agg(
        F.min_by("leaf_id", F.struct("lnn", "leaf_id")).alias("leaf_id"),
        F.min("lnn").alias("lnn"),
    )


def target_gaps(predicted: DataFrame) -> DataFrame:
    """(query_id, leaf_id, gap, weight) of the leaf with the true neighbour. When the search
    reaches that leaf its best distance is that of the leaf, so the leaf survives as soon as the
    margin reaches pred - lnn, whatever the visiting order."""
    target = nearest_leaf(predicted).select("query_id", "leaf_id")
    return predicted.join(target, ["query_id", "leaf_id"]).select(
        "query_id", "leaf_id", (F.col("pred") - F.col("lnn")).alias("gap"), F.lit(1).alias("weight")
    )


def residence_gaps(residence: DataFrame, predicted: DataFrame) -> DataFrame:
    """The same for k > 1: every leaf that holds neighbours counts by how many it holds, and
    survives as soon as the margin reaches pred - bsf."""
    return residence.join(
        predicted.select("query_id", "leaf_id", "pred", "bsf"), ["query_id", "leaf_id"], "left"
    ).select(
        "query_id",
        "leaf_id",
        (F.col("pred") - F.col("bsf")).alias("gap"),
        F.col("n").alias("weight"),
    )


def recall_by_position(
    gaps: DataFrame, alphas: DataFrame, batches: DataFrame, k: int = 1
) -> DataFrame:
    """(batch_id, pos, recall). A hit starts at the first position whose margin reaches the gap,
    so a histogram of first positions and a running sum replace the product of positions and
    queries. A leaf without margins never prunes. ``alphas`` may carry ``batch_id``."""
    keys = ["leaf_id"] + (["batch_id"] if "batch_id" in alphas.columns else [])
    curves = alphas.groupBy(*keys).agg(F.sort_array(F.collect_list("alpha")).alias("curve"))
    width = (alphas.agg(F.max("pos")).first()[0] or 0) + 1
    first = F.when(
        F.col("curve").isNull() | F.col("gap").isNull(), F.lit(0)
    ).otherwise(F.size(F.filter("curve", lambda a: a < F.col("gap"))))
    hits = (
        batches.select("batch_id", "query_id")
        .join(gaps, "query_id")
        .join(curves, keys, "left")
        .groupBy("batch_id", first.alias("pos"))
        .agg(F.sum("weight").alias("found"))
    )
    running = Window.partitionBy("batch_id").orderBy("pos")
    spine = (
        batches.groupBy("batch_id")
        .agg(F.count("*").alias("size"))
        .withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    )
    found = F.sum(F.coalesce("found", F.lit(0))).over(running)
    return spine.join(hits, ["batch_id", "pos"], "left").select(
        "batch_id", "pos", (found / (F.col("size") * k)).alias("recall")
    )


def with_coverage(by_position: DataFrame) -> DataFrame:
    """Add ``coverage``: the share of batches whose recall at this position is at least this
    one's, itself included."""
    order = Window.partitionBy("pos").orderBy(F.desc("recall"))
    return by_position.withColumn("coverage", F.cume_dist().over(order))


def unique_pairs(covered: DataFrame) -> DataFrame:
    """(recall, coverage, pos): one row per pair at six decimals, with its largest position."""
    return covered.groupBy(
        F.round("recall", 6).alias("recall"), F.round("coverage", 6).alias("coverage")
    ).agg(F.max("pos").alias("pos"))


def triples(pairs: DataFrame, alphas: DataFrame) -> DataFrame:
    """(filter_id, recall, coverage, error): the margin of every filter at the position of every
    pair."""
    return pairs.join(alphas.select("leaf_id", "pos", "alpha"), "pos").select(
        F.col("leaf_id").alias("filter_id"), "recall", "coverage", F.col("alpha").alias("error")
    )


def wide_rows(covered: DataFrame, alphas: DataFrame, filter_id: int | None = None) -> DataFrame:
    """Long form of the wide export: batches ranked by recall at each position, with the margin."""
    order = Window.partitionBy("pos").orderBy("recall", "batch_id")
    ranked = covered.withColumn("rank", F.row_number().over(order))
    chosen = alphas if filter_id is None else alphas.where(F.col("leaf_id") == filter_id)
    return ranked.join(chosen.select("leaf_id", "pos", "alpha"), "pos").select(
        F.col("leaf_id").alias("filter_id"),
        "rank",
        "pos",
        "recall",
        "coverage",
        F.col("alpha").alias("error"),
    )


def rising_recall_curve(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Make a recall curve over ``pos`` strictly increasing: the last point becomes 1 - gap and
    every earlier one lies at least a gap below its successor."""
    by = by or []
    last = F.max("pos").over(Window.partitionBy(*by))
    pinned = F.when(F.col("pos") == last, 1.0 - EPSILON_GAP).otherwise(F.col("recall"))
    ahead = (
        Window.partitionBy(*by)
        .orderBy("pos")
        .rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    shifted = F.col("pinned") - F.col("pos") * EPSILON_GAP
    return (
        curve.withColumn("pinned", pinned)
        .withColumn("recall", F.min(shifted).over(ahead) + F.col("pos") * EPSILON_GAP)
        .drop("pinned")
    )


def first_position_reaching(curve: DataFrame, target: float, by: list[str]) -> DataFrame:
    return curve.where(F.col("recall") >= target).groupBy(*by).agg(F.min("pos").alias("pos"))


def recall_by_set(answers: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): share of true neighbours among the answers."""
    hits = answers.join(
        truth.select("query_id", "series_id"), ["query_id", "series_id"], "left_semi"
    )
    return _recall(hits, truth, k)


def recall_by_rank(answers: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): share of ranks at which answer and truth name the same series."""
    hits = answers.join(
        truth.select("query_id", "rank", "series_id"), ["query_id", "rank", "series_id"],
        "left_semi",
    )
    return _recall(hits, truth, k)


def recall_by_intersection(answers: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """The set form on arrays of at most k ids per query."""
    mine = answers.groupBy("query_id").agg(F.collect_set("series_id").alias("found"))
    right = truth.groupBy("query_id").agg(F.collect_set("series_id").alias("wanted"))
    hit = F.coalesce(F.size(F.array_intersect("found", "wanted")), F.lit(0))
    return right.join(mine, "query_id", "left").select(
        "query_id", (F.greatest(hit, F.lit(0)) / k).alias("recall")
    )


def _recall(hits: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    counted = hits.groupBy("query_id").agg(F.count("*").alias("hits"))
    return (
        truth.select("query_id")
        .distinct()
        .join(counted, "query_id", "left")
        .select("query_id", (F.coalesce("hits", F.lit(0)) / k).alias("recall"))
    )


def batch_report(per_query: DataFrame, target_recall: float) -> DataFrame:
    """(batch_id, n_queries, recall, above_target): runs of 10 queries, or of 100 when there are
    more than 100; the last batch takes the remainder."""
    n = per_query.count()
    size = 10 if n <= 100 else 100
    n_batches = max(1, n // size)
    batch = F.least(F.floor(F.col("query_id") / size), F.lit(n_batches - 1)).cast("int")
    return (
        per_query.groupBy(batch.alias("batch_id"))
        .agg(F.count("*").alias("n_queries"), F.avg("recall").alias("recall"))
        .withColumn(
            "above_target", F.round("recall", 5) >= F.round(F.lit(target_recall), 5)
        )
    )


def search_report(
    per_query: DataFrame, target_recall: float, target_coverage: float
) -> DataFrame:
    """One row: mean recall, achieved coverage, and whether both targets were met."""
    batches = batch_report(per_query, target_recall)
    totals = batches.agg(
        F.sum("n_queries").alias("n_queries"),
        F.count("*").alias("n_batches"),
        (F.sum(F.col("recall") * F.col("n_queries")) / F.sum("n_queries")).alias("recall"),
        F.avg(F.col("above_target").cast("double")).alias("coverage"),
    )
    return totals.withColumn("recall_passed", F.col("recall") >= target_recall).withColumn(
        "coverage_passed", F.col("coverage") >= target_coverage
    )
