"""Filters that are saved with an index: their lines, margins, calibration batches, residence counts and
flags, and the local examples they are trained on. Each change is a new version of the index, in which
all of its tables change at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftleaf.functions.series import lower_bound_squared
from driftleaf.models.fits import fit_linear, predict_linear
from driftleaf.operators.allocation import deactivate, set_active
from driftleaf.operators.batches import local_role
from driftleaf.operators.bounds import leaf_bounds
from driftleaf.operators.conformal import alpha_at_confidence
from driftleaf.plans import versions
from driftleaf.plans.index import Index, load_index, save_with_index
from driftleaf.plans.train import join_examples
from driftleaf.session import materialise
from driftleaf.sources.tables import (
    ALPHA_SCHEMA,
    BATCH_ALPHA_SCHEMA,
    CALIB_BATCH_SCHEMA,
    RESIDENCE_SCHEMA,
)

FILTER_SCHEMA = "leaf_id long, slope double, intercept double, active boolean"
EXAMPLE_SCHEMA = "leaf_id long, example_no long, lb double, lnn double"


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema``, in its types."""
    wanted = df.sparkSession.createDataFrame([], schema).schema
    missing = [f.name for f in wanted if f.name not in df.columns]
    if missing:
        raise ValueError(f"a table lacks {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])


def save_filters(
    index: Index,
    lines: DataFrame,
    alphas: DataFrame,
    batches: DataFrame | None = None,
    batch_alphas: DataFrame | None = None,
    residence: DataFrame | None = None,
) -> Index:
    """Save (leaf_id, slope, intercept) of all filters, active, with what calibrated them. Tables that
    are not given are dropped, since they belong to other filters."""
    given = {
        "alpha": (alphas, ALPHA_SCHEMA),
        "calib_batch": (batches, CALIB_BATCH_SCHEMA),
        "batch_alpha": (batch_alphas, BATCH_ALPHA_SCHEMA),
        "residence": (residence, RESIDENCE_SCHEMA),
    }
    tables = {name: None if df is None else _shaped(df, schema) for name, (df, schema) in given.items()}
    filters = _shaped(lines.withColumn("active", F.lit(True)), FILTER_SCHEMA)
    return save_with_index(index, {"filter": filters, **tables})


def activate_filters(index: Index, leaves: DataFrame) -> Index:
    """Exactly the filters of these leaves are active from now on; the others stay trained."""
    return save_with_index(index, {"filter": set_active(index.tables["filter"], leaves)})


def deactivate_filters(index: Index, leaves: DataFrame) -> Index:
    return save_with_index(index, {"filter": deactivate(index.tables["filter"], leaves)})


def retrain_filters(index: Index, rows: DataFrame, alphas: DataFrame | None = None) -> Index:
    """Fit the filters of the leaves in ``rows`` (leaf_id, lb, lnn) again and activate them; all others
    stay as they are. With ``alphas``, the margins of those leaves are replaced in the same version."""
    fresh = _shaped(fit_linear(rows).withColumn("active", F.lit(True)), FILTER_SCHEMA)
    fresh = materialise(fresh, "refitted")
    old = index.tables["filter"].join(fresh.select("leaf_id"), "leaf_id", "left_anti")
    tables = {"filter": old.unionByName(fresh)}
    if alphas is not None:
        kept = index.tables["alpha"].join(fresh.select("leaf_id"), "leaf_id", "left_anti")
        again = _shaped(alphas.join(fresh.select("leaf_id"), "leaf_id", "left_semi"), ALPHA_SCHEMA)
        tables["alpha"] = kept.unionByName(again)
    return save_with_index(index, tables)


def saved_predictions(index: Index, queries: DataFrame, confidence: float) -> DataFrame:
    """(query_id, leaf_id, lb, pred, alpha) of the active filters that the index holds."""
    lines = index.tables["filter"].where("active").select("leaf_id", "slope", "intercept")
    asked = queries.select("query_id", F.col(index.route_column).alias("values"))
    bounds = leaf_bounds(asked, index.leaf, shipped=index.shipped_leaves)
    margins = alpha_at_confidence(index.tables["alpha"], confidence)
    return predict_linear(bounds, lines).join(margins, "leaf_id", "left")


def local_examples(index: Index, queries: DataFrame) -> DataFrame:
    """Examples of local queries (leaf_id, query_no, values, lnn) on the leaf they were made for."""
    near = queries.join(index.leaf.select("leaf_id", "seg"), "leaf_id")
    lb = F.sqrt(lower_bound_squared(F.col("values"), F.col("seg")))
    return near.select("leaf_id", F.col("query_no").cast("long").alias("example_no"), lb.alias("lb"), "lnn")


def append_examples(index: Index, examples: DataFrame) -> Index:
    """Add local examples to those that the index holds."""
    spark = index.members.sparkSession
    before = versions.parts_of(spark, index.path).get("example", [])
    part = versions.write_part(_shaped(examples, EXAMPLE_SCHEMA), index.path, "example")
    versions.commit(spark, index.path, {"example": [*before, part]})
    return load_index(spark, index.path)


def with_local_examples(index: Index, facts: DataFrame) -> DataFrame:
    """Training rows (leaf_id, lb, lnn, role, is_local): the global facts that train and validate, and the
    local examples of the index with roles of their own, by their order in the leaf."""
    order = Window.partitionBy("leaf_id").orderBy("example_no", "lb", "lnn")
    local = index.tables["example"].withColumn("_n", F.count("*").over(Window.partitionBy("leaf_id")))
    role = local_role(F.row_number().over(order) - 1, F.col("_n"))
    local = local.select("leaf_id", "lb", "lnn", role.alias("role"), F.lit(True).alias("is_local"))
    known = facts.where(F.col("role") != "calib").select("leaf_id", "lb", "lnn", "role", F.lit(False).alias("is_local"))
    return join_examples(known, local)
