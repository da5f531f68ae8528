"""The training facts: what every query sees in every leaf."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftleaf.operators.scan import scan, top_k
from driftleaf.session import materialise, ship_package
from driftleaf.settings import MAX_VALID, MIN_VALID


def visit_order(facts: DataFrame) -> list:
    """Resident leaf first, then by lower bound."""
    return [F.desc("is_resident"), F.asc("lb"), F.asc("leaf_id")]


def with_bsf_before_visit(facts: DataFrame) -> DataFrame:
    """Add ``bsf``: the best distance over the leaves visited before this one; NULL at the first
    leaf. Facts: (query_id, leaf_id, is_resident, lb, lnn)."""
    before = (
        Window.partitionBy("query_id")
        .orderBy(*visit_order(facts))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return facts.withColumn("bsf", F.min("lnn").over(before))


def with_kth_before_visit(facts: DataFrame, leaf_top: DataFrame, k: int) -> DataFrame:
    """The same for k > 1: the k-th best distance over all series of the leaves visited before.
    ``leaf_top``: (query_id, leaf_id, dist), the k nearest members of every leaf.

    A prefix scan over blocks of leaves: rows are dealt by range of query and visiting order, each block
    gives its k best of a query, and those of the blocks before are what a block starts
    with. So a query's leaves are spread over tasks, and a walk keeps k distances."""
    spark = facts.sparkSession
    ship_package(spark)
    tops = leaf_top.groupBy("query_id", "leaf_id").agg(F.sort_array(F.collect_list("dist")).alias("ds"))
    steps = facts.select("query_id", "leaf_id", "is_resident", "lb").join(
        tops, ["query_id", "leaf_id"], "left"
    )
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = steps.repartitionByRange(blocks, "query_id", *visit_order(facts))
    placed = materialise(dealt.withColumn("block", F.spark_partition_id()), "visits")

    def best(lists: Column) -> Column:
        return F.slice(F.sort_array(F.flatten(lists)), 1, k)

    by_block = placed.where(F.col("ds").isNotNull()).groupBy("query_id", "block").agg(
        best(F.collect_list("ds")).alias("best")
    )
    # A row a query and block: at most as many as there are blocks.
    every = placed.select("query_id", "block").distinct().join(by_block, ["query_id", "block"], "left")
    earlier = (
        Window.partitionBy("query_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = every.select("query_id", "block", best(F.collect_list("best").over(earlier)).alias("carried"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["is_resident", "lb", "leaf_id"], ascending=[False, True, True])
        best, kth = np.array(pdf["carried"].iloc[0], float), np.full(len(pdf), np.nan)
        for i, ds in enumerate(pdf["ds"]):
            if len(best) >= k:
                kth[i] = best[k - 1]
            if ds is not None and len(ds) and (len(best) < k or ds[0] < best[k - 1]):
                best = np.sort(np.concatenate([best, ds]))[:k]
        return pd.DataFrame(
            {"query_id": pdf["query_id"], "leaf_id": pdf["leaf_id"], "bsf": kth}
        )

    bsf = placed.join(carried, ["query_id", "block"]).groupBy("query_id", "block").applyInPandas(
        walk, "query_id long, leaf_id long, bsf double"
    ).withColumn("bsf", F.nanvl("bsf", F.lit(None).cast("double")))
    return facts.join(bsf, ["query_id", "leaf_id"])


def lookup_bsf(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """bsf of (query_id, leaf_id) pairs; NULL where none was stored."""
    return pairs.join(
        facts.select("query_id", "leaf_id", "bsf"), ["query_id", "leaf_id"], "left"
    )


def knn_residence(answers: DataFrame) -> DataFrame:
    """How many of the nearest neighbours of a query live in each leaf."""
    return answers.groupBy("query_id", "leaf_id").agg(F.count("*").alias("n"))


def residence_share(residence: DataFrame, k: int) -> DataFrame:
    return residence.withColumn("share", F.col("n") / F.lit(float(k)))


def nn_distance_stats(facts: DataFrame) -> DataFrame:
    return facts.groupBy("leaf_id").agg(
        F.avg("lnn").alias("mean_lnn"), F.stddev_pop("lnn").alias("std_lnn")
    )


def bound_prune_frequency(facts: DataFrame) -> DataFrame:
    """Share of queries for which the lower bound alone prunes the leaf."""
    pruned = F.coalesce((F.col("lb") > F.col("bsf")).cast("double"), F.lit(0.0))
    return facts.groupBy("leaf_id").agg(F.avg(pruned).alias("lb_prune"))


def filter_prune_ratio(predicted: DataFrame) -> DataFrame:
    """Share of held-out queries for which prediction minus margin exceeds bsf. Needs
    (leaf_id, pred, alpha, bsf)."""
    pruned = F.coalesce(
        (F.col("pred") - F.col("alpha") > F.col("bsf")).cast("double"), F.lit(0.0)
    )
    return predicted.groupBy("leaf_id").agg(F.avg(pruned).alias("prune_ratio"))


def valid_predictions(df: DataFrame, column: str = "pred") -> DataFrame:
    """Predictions strictly inside the valid range and not zero."""
    c = F.col(column)
    return df.where((c > MIN_VALID) & (c < MAX_VALID) & (c != 0))


def leaf_top_k(members: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, leaf_id, series_id, rank, dist): the k nearest members of every leaf."""
    return top_k(scan(members, queries, k, per_leaf=True), k, ["query_id", "leaf_id"]).drop("dist2")
