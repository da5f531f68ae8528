"""Which leaves get an active filter."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftleaf.operators.running import with_running


@dataclass(frozen=True)
class CandidateModel:
    name: str
    prune: float
    cost_per_query: float
    memory: float


def filter_gains(
    leaf: DataFrame, prune: DataFrame, models: Sequence[CandidateModel], cost_per_series: float
) -> DataFrame:
    """(leaf_id, n, model, gain, memory): the most useful model of every leaf. ``prune``:
    (leaf_id, lb_prune). gain = n (1 - lb_prune) prune (cost_per_series - cost_per_query / n),
    at least 0."""

    def option(m: CandidateModel):
        gain = (
            F.col("n")
            * ((1.0 - F.col("lb_prune")) * F.lit(m.prune))
            * (F.lit(cost_per_series) - F.lit(m.cost_per_query) / F.col("n"))
        )
        return F.struct(
            F.greatest(gain, F.lit(0.0)).alias("gain"),
            F.lit(m.name).alias("model"),
            F.lit(m.memory).alias("memory"),
        )

    best = F.array_max(F.array(*[option(m) for m in models]))
    return (
        leaf.select("leaf_id", "n")
        .join(prune, "leaf_id")
        .withColumn("b", best)
        .select("leaf_id", "n", "b.model", "b.gain", "b.memory")
    )


def allocate_by_gain(gains: DataFrame, budget: float) -> DataFrame:
    """Leaves in order of gain while their memory fits the budget; only positive gains."""
    gaining = gains.where(F.col("gain") > 0)
    used = with_running(gaining, [F.desc("gain"), F.asc("leaf_id")], {"used": F.col("memory")})
    return used.where(F.col("used") <= budget)


def allocate_by_size(leaf: DataFrame, threshold: int) -> DataFrame:
    return leaf.where(F.col("n") > threshold).select("leaf_id", "n")


def allocate(gains: DataFrame, leaf: DataFrame, budget: float, threshold: int = 8) -> DataFrame:
    """(leaf_id, active): by gain, or by size when no filter gains anything."""
    if gains.where(F.col("gain") > 0).limit(1).count():
        chosen = allocate_by_gain(gains, budget)
    else:
        chosen = allocate_by_size(leaf, threshold)
    return set_active(leaf, chosen)


def set_active(leaf: DataFrame, chosen: DataFrame) -> DataFrame:
    marked = chosen.select("leaf_id", F.lit(True).alias("_on"))
    return leaf.drop("active").join(marked, "leaf_id", "left").select(
        *[c for c in leaf.columns if c != "active"], F.coalesce("_on", F.lit(False)).alias("active")
    )


def deactivate(leaf: DataFrame, gone: DataFrame) -> DataFrame:
    off = gone.select("leaf_id", F.lit(True).alias("_off"))
    return (
        leaf.join(off, "leaf_id", "left")
        .withColumn("active", F.col("active") & F.col("_off").isNull())
        .drop("_off")
    )


def active_count(leaf: DataFrame) -> DataFrame:
    return leaf.agg(F.count_if("active").alias("n_active"), F.count("*").alias("n_leaves"))


def model_prune_rate(trial: DataFrame) -> DataFrame:
    """Mean pruning ratio of each model over the leaves it was tried on."""
    return trial.groupBy("model").agg(F.avg("prune_ratio").alias("model_prune"))
