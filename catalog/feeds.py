"""Inputs of the registered queries, derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftleaf.functions.series import znormalize
from driftleaf.models.fits import fit_linear, predict_linear
from driftleaf.operators.augment import compact
from driftleaf.operators.batches import balanced_batches
from driftleaf.operators.conformal import conformal_alphas, residuals
from driftleaf.operators.sampling import global_queries
from driftleaf.plans.index import Index, build_index, index_by_key, load_index
from driftleaf.plans.train import collect_facts, with_roles
from driftleaf.session import new_work_path
from driftleaf.settings import IndexOptions

LENGTH = 64
SEGMENTS = 4
K = 5
TRAIN_QUERIES = 600
SEARCH_QUERIES = 100
NOISE = (0.1, 2.0)
BATCHES, BATCH_SIZE = 20, 30
CONFIDENCE = 0.9
OPTIONS = IndexOptions(leaf_size=50)

_stored: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stored(
    spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """Build a table once per application and data folder; later queries read it back."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _stored:
        path = new_work_path(spark, name)
        build().write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def series(spark: SparkSession, sf: str) -> DataFrame:
    """Every embedding as a z-normalised series; its label is a ready-made leaf key."""
    return (
        table(spark, sf, "embeddings")
        .select(
            F.col("vec_id").alias("series_id"),
            F.col("label").cast("long").alias("leaf_id"),
            znormalize(F.col("embedding")).alias("values"),
        )
        .where(F.col("values").isNotNull())
    )


def train_queries(spark: SparkSession, sf: str) -> DataFrame:
    return stored(
        spark, sf, "train_queries",
        lambda: global_queries(series(spark, sf), TRAIN_QUERIES, *NOISE, seed="train"),
    )


def search_queries(spark: SparkSession, sf: str) -> DataFrame:
    return stored(
        spark, sf, "search_queries",
        lambda: global_queries(series(spark, sf), SEARCH_QUERIES, *NOISE, seed="search"),
    )


def home(queries: DataFrame) -> DataFrame:
    """The leaf a synthetic query was drawn from."""
    return queries.select("query_id", F.col("source_leaf").alias("leaf_id"))


def keyed_index(spark: SparkSession, sf: str) -> Index:
    return index_by_key(series(spark, sf), LENGTH, SEGMENTS)


def tree_index(spark: SparkSession, sf: str) -> Index:
    key = (spark.sparkContext.applicationId, sf, "tree")
    if key not in _stored:
        rows = series(spark, sf).drop("leaf_id")
        _stored[key] = build_index(rows, OPTIONS).path
    return load_index(spark, _stored[key])


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, leaf_id, is_resident, lb, lnn, bsf, role) of the training queries."""

    def build() -> DataFrame:
        q = train_queries(spark, sf)
        return with_roles(collect_facts(keyed_index(spark, sf), q, home(q)), TRAIN_QUERIES)

    return stored(spark, sf, "facts", build)


def predicted(spark: SparkSession, sf: str) -> DataFrame:
    """Facts with the prediction of a per-leaf line."""
    rows = facts(spark, sf)
    return predict_linear(rows, fit_linear(rows.where(F.col("role") == "train")))


def calibration_rows(spark: SparkSession, sf: str) -> DataFrame:
    return stored(
        spark, sf, "calibration_rows",
        lambda: predicted(spark, sf).where(F.col("role") == "calib"),
    )


def alphas(spark: SparkSession, sf: str) -> DataFrame:
    return stored(
        spark, sf, "alphas", lambda: conformal_alphas(residuals(calibration_rows(spark, sf)))
    )


def batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = calibration_rows(spark, sf).select("query_id").distinct()
    return stored(
        spark, sf, "batches", lambda: balanced_batches(rows, BATCHES, BATCH_SIZE, "calibration")
    )


def raw_triples(spark: SparkSession, sf: str) -> DataFrame:
    """Raw (filter_id, col_group, recall, coverage, error) rows: one per line item. The odd divisor
    keeps errors off short decimals, on which engines round halves differently."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("filter_id"),
        F.col("l_linenumber").alias("col_group"),
        (0.9 + F.col("l_discount")).alias("recall"),
        (0.92 + F.col("l_tax")).alias("coverage"),
        (F.col("l_quantity") / 10.0 + F.col("l_extendedprice") / 123457.0).alias("error"),
    )


def compact_triples(spark: SparkSession, sf: str) -> DataFrame:
    return compact(raw_triples(spark, sf))


def triples(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (filter_id, recall, coverage) with its largest error."""
    return (
        raw_triples(spark, sf)
        .groupBy(
            "filter_id",
            F.round("recall", 6).alias("recall"),
            F.round("coverage", 6).alias("coverage"),
        )
        .agg(F.max("error").alias("error"))
    )


def pool(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted and actual error per filter and pair: mean and middle of the line items."""
    return (
        raw_triples(spark, sf)
        .groupBy(
            "filter_id",
            F.round("recall", 6).alias("recall"),
            F.round("coverage", 6).alias("coverage"),
        )
        .agg(
            F.avg("error").alias("pred"),
            ((F.min("error") + F.max("error")) / 2.0).alias("actual"),
        )
    )
