"""Training facts, filters and trials."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftleaf.operators.batches import role_by_position
from driftleaf.operators.bounds import leaf_bounds
from driftleaf.operators.facts import filter_prune_ratio, with_bsf_before_visit
from driftleaf.operators.sampling import every_nth_by_size
from driftleaf.operators.scan import leaf_nn_distance
from driftleaf.models.fits import fit_linear, predict_linear
from driftleaf.plans.index import Index


def collect_facts(index: Index, queries: DataFrame, resident: DataFrame | None = None) -> DataFrame:
    """(query_id, leaf_id, is_resident, lb, lnn, bsf): every query visits every leaf. The series
    are read once; tasks reduce them to one minimum per query and leaf."""
    resident = index.resident(queries) if resident is None else resident
    bounds = leaf_bounds(
        queries.select("query_id", F.col(index.route_column).alias("values")),
        index.leaf,
        shipped=index.shipped_leaves,
    )
    home = resident.select("query_id", F.col("leaf_id").alias("home"))
    facts = (
        bounds.join(leaf_nn_distance(index.clustered_members(), queries), ["query_id", "leaf_id"])
        .join(home, "query_id", "left")
        .withColumn("is_resident", F.coalesce(F.col("leaf_id") == F.col("home"), F.lit(False)))
        .drop("home")
    )
    return with_bsf_before_visit(facts)


def with_roles(facts: DataFrame, n_queries: int) -> DataFrame:
    return facts.withColumn("role", role_by_position(F.col("query_id"), n_queries))


def join_examples(global_rows: DataFrame, local_rows: DataFrame) -> DataFrame:
    """Global and local training rows of the same leaf."""
    return global_rows.unionByName(local_rows, allowMissingColumns=True)


def trial(
    facts: DataFrame, leaf: DataFrame, wanted: int, alpha: DataFrame, model: str = "linear"
) -> DataFrame:
    """(model, leaf_id, prune_ratio): fit a systematic sample of leaves and measure how often
    their filter would prune on held-out queries."""
    sampled = every_nth_by_size(leaf, wanted).select("leaf_id")
    mine = facts.join(sampled, "leaf_id", "left_semi")
    fitted = fit_linear(mine.where(F.col("role") == "train"))
    held = predict_linear(mine.where(F.col("role") != "train"), fitted).join(alpha, "leaf_id")
    return filter_prune_ratio(held).withColumn("model", F.lit(model))
