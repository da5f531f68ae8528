"""Sources, sinks, saved state and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import feeds
from catalog.feeds import K, LENGTH
from catalog.on_search import EXACT, FILTERED, MARGIN
from catalog.registry import register
from catalog.on_calibration import BATCH_ALPHAS, recalls, stored_batch_alphas
from catalog.on_series import LOCAL, local_rows
from catalog.sql_parts import (
    ALL_FACTS,
    CALIBRATION,
    CHAIN,
    COMPACT,
    INTERCEPT,
    MODEL,
    POOL,
    RECALL_CHAIN,
    SERIES,
    SLOPE,
    TRAIN,
    bounds,
)
from driftleaf.functions.series import as_doubles, total
from driftleaf.operators.augment import unpivot_wide
from driftleaf.operators.conformal import residuals
from driftleaf.operators.recall import wide_rows, with_coverage
from driftleaf.plans.index import append_to_index, build_index, leaf_size_mismatches, load_index
from driftleaf.plans import filters as saved
from driftleaf.plans.index import Index, save_index
from driftleaf.plans.search import knn_exact, knn_filtered, knn_pruned
from driftleaf.models.fits import fit_linear
from driftleaf.operators.facts import knn_residence
from driftleaf.session import materialise, new_work_path
from driftleaf.settings import IndexOptions
from driftleaf.sources import binary as B
from driftleaf.sources import tables as T
from driftleaf.streaming.ingest import start_ingest, with_ingested
from driftleaf.streaming.search import start_search


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("series_id"), F.col("embedding").alias("values")
    )


@register(
    "binary_series",
    """SELECT row_number() OVER (ORDER BY vec_id) - 1 AS series_id,
              round(list_sum(CAST(embedding AS DOUBLE[])), 4) + 0.0 AS total,
              round(CAST(embedding[64] AS DOUBLE), 6) AS last_value FROM embeddings""",
)
def binary_series(spark: SparkSession, sf: str) -> DataFrame:
    """Write all vectors as flat float32 rows and scan them back; ids are positions."""
    path = new_work_path(spark, "binary")
    B.write_series(_embeddings(spark, sf), path, LENGTH)
    v = as_doubles(F.col("values"))
    return B.read_series(spark, path, LENGTH).select(
        "series_id",
        (F.round(total(v), 4) + 0.0).alias("total"),
        F.round(v[LENGTH - 1], 6).alias("last_value"),
    )


@register(
    "binary_with_sketch",
    """SELECT row_number() OVER (ORDER BY vec_id) - 1 AS series_id,
              round(CAST(embedding[1] AS DOUBLE), 6) AS first_value,
              round(CAST(embedding[33] AS DOUBLE), 6) AS first_sketch FROM embeddings""",
)
def binary_with_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """Values and sketches (here the second half of a vector) from two aligned files."""
    rows = _embeddings(spark, sf)
    path, sketch_path = new_work_path(spark, "binary"), new_work_path(spark, "sketch")
    B.write_series(rows, path, LENGTH)
    half = LENGTH // 2
    B.write_series(
        rows.withColumn("values", F.slice("values", half + 1, half)), sketch_path, half, 3
    )
    both = B.read_with_sketch(spark, path, LENGTH, sketch_path, half)
    return both.select(
        "series_id",
        F.round(F.col("values")[0].cast("double"), 6).alias("first_value"),
        F.round(F.col("sketch")[0].cast("double"), 6).alias("first_sketch"),
    )


@register(
    "leaf_files",
    f"WITH {SERIES} SELECT leaf_id, count(*) AS n FROM series GROUP BY leaf_id",
)
def leaf_files(spark: SparkSession, sf: str) -> DataFrame:
    path = new_work_path(spark, "leaves")
    B.write_leaves(feeds.series(spark, sf), path)
    return (
        spark.read.parquet(path)
        .groupBy(F.col("leaf_id").cast("long").alias("leaf_id"))
        .agg(F.count("*").alias("n"))
    )


@register(
    "index_save_load",
    f"WITH {SERIES} SELECT count(*) AS n_series, CAST(0 AS BIGINT) AS mismatches FROM series",
)
def index_save_load(spark: SparkSession, sf: str) -> DataFrame:
    path = feeds.tree_index(spark, sf).path
    index = load_index(spark, path, check=True)
    return index.members.agg(
        F.count("*").alias("n_series"),
        F.lit(leaf_size_mismatches(index).count()).cast("long").alias("mismatches"),
    )


@register(
    "index_append",
    f"WITH {EXACT} SELECT query_id, rank, series_id, round(dist, 4) AS dist FROM exact",
)
def index_append(spark: SparkSession, sf: str) -> DataFrame:
    """Index some labels, append the others, and search: the answers are those of a full scan."""
    rows = feeds.series(spark, sf)
    first = rows.where(F.col("leaf_id") < 5).drop("leaf_id")
    later = rows.where(F.col("leaf_id") >= 5).drop("leaf_id")
    index = append_to_index(build_index(first, IndexOptions(leaf_size=100)), later)
    answers = knn_pruned(index, feeds.search_queries(spark, sf), K)
    return answers.select("query_id", "rank", "series_id", F.round("dist", 4).alias("dist"))


@register(
    "streamed_ingest",
    f"WITH {EXACT} SELECT query_id, rank, series_id, round(dist, 4) AS dist FROM exact",
)
def streamed_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the labels are indexed, the others arrive as a stream; then search."""
    rows = feeds.series(spark, sf)
    index = build_index(
        rows.where(F.col("leaf_id") < 5).drop("leaf_id"), IndexOptions(leaf_size=100)
    )
    arriving = new_work_path(spark, "arriving")
    rows.where(F.col("leaf_id") >= 5).select("series_id", "values").write.parquet(arriving)
    schema = spark.read.parquet(arriving).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    path = new_work_path(spark, "ingest")
    start_ingest(stream, index, path, new_work_path(spark, "offsets")).awaitTermination()
    answers = knn_pruned(with_ingested(index, path), feeds.search_queries(spark, sf), K)
    return answers.select("query_id", "rank", "series_id", F.round("dist", 4).alias("dist"))


@register(
    "streamed_search",
    f"WITH {EXACT} SELECT query_id, rank, series_id, round(dist, 4) AS dist FROM exact",
)
def streamed_search(spark: SparkSession, sf: str) -> DataFrame:
    arriving, path = new_work_path(spark, "arriving"), new_work_path(spark, "answers")
    queries = feeds.search_queries(spark, sf).select("query_id", "values")
    queries.write.parquet(arriving)
    stream = spark.readStream.schema(queries.schema).parquet(arriving)
    index = feeds.tree_index(spark, sf)
    start_search(stream, index, K, path, new_work_path(spark, "offsets")).awaitTermination()
    answers = spark.read.parquet(path)
    return answers.select("query_id", "rank", "series_id", F.round("dist", 4).alias("dist"))


@register(
    "ground_truth_check",
    f"""WITH {EXACT} SELECT query_id, count(*) AS n, CAST(NULL AS VARCHAR) AS problem
    FROM exact GROUP BY query_id""",
)
def ground_truth_check(spark: SparkSession, sf: str) -> DataFrame:
    """Save answers with the heads of their queries, load them and compare."""
    queries = feeds.search_queries(spark, sf)
    path = new_work_path(spark, "truth")
    T.save_ground_truth(knn_exact(feeds.series(spark, sf), queries, K), queries, path)
    truth = T.load_ground_truth(spark, path)
    problems = T.ground_truth_mismatches(truth, queries)
    return (
        truth.groupBy("query_id")
        .agg(F.count("*").alias("n"))
        .join(problems, "query_id", "left")
    )


@register(
    "triples_csv",
    f"""WITH {COMPACT} SELECT filter_id, recall, coverage, round(error, 6) AS error, CAST(0 AS BIGINT)
    AS is_test FROM compact""",
)
def triples_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = new_work_path(spark, "triples")
    rows = feeds.compact_triples(spark, sf).withColumn("is_test", F.lit(0))
    T.write_triples(rows, path)
    return T.read_triples(spark, path)


@register(
    "imported_errors",
    """WITH e AS (SELECT s_suppkey AS leaf_id, s_acctbal / 700.0::DOUBLE AS error FROM supplier),
    leaf AS (SELECT l_suppkey AS leaf_id, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT leaf_id, n, n > 600 AS active,
           CASE WHEN n > 600 THEN round(error, 4) END AS alpha FROM leaf LEFT JOIN e USING (leaf_id)""",
)
def imported_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Write per-filter errors as text, import them, and set the margins of active leaves."""
    path = new_work_path(spark, "errors")
    feeds.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("Filter_ID"), F.lit(0.9).alias("Recall"),
        F.lit(0.9).alias("Coverage"), (F.col("s_acctbal") / 700.0).alias("Error"),
    ).write.csv(path, header=True)
    leaf = (
        feeds.table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("leaf_id"))
        .agg(F.count("*").alias("n"))
        .withColumn("active", F.col("n") > 600)
    )
    out = T.apply_imported_errors(leaf, T.read_imported_errors(spark, path))
    return out.withColumn("alpha", F.round("alpha", 4))


@register(
    "alphas_save_load",
    f"""WITH {ALL_FACTS}, {MODEL}, {CALIBRATION}
    SELECT leaf_id, count(*) AS n, round(max(alpha), 4) AS top FROM alphas GROUP BY 1""",
)
def alphas_save_load(spark: SparkSession, sf: str) -> DataFrame:
    path = new_work_path(spark, "alphas")
    T.save_table(feeds.alphas(spark, sf), path)
    rows = T.load_table(spark, path, T.ALPHA_SCHEMA)
    return rows.groupBy("leaf_id").agg(
        F.count("*").alias("n"), F.round(F.max("alpha"), 4).alias("top")
    )


@register(
    "calib_ids_save_load",
    f"WITH {CHAIN} SELECT batch_id, count(*) AS n, max(slot) AS last_slot FROM batches GROUP BY 1",
)
def calib_ids_save_load(spark: SparkSession, sf: str) -> DataFrame:
    path = new_work_path(spark, "calib")
    T.save_table(feeds.batches(spark, sf), path)
    rows = T.load_table(spark, path, T.CALIB_BATCH_SCHEMA)
    return rows.groupBy("batch_id").agg(
        F.count("*").alias("n"), F.max("slot").alias("last_slot")
    )


@register(
    "residual_files",
    f"""WITH {ALL_FACTS}, {MODEL}, {CALIBRATION}
    SELECT leaf_id, row_number() OVER (PARTITION BY leaf_id ORDER BY residual DESC, query_id) AS rank,
           query_id, round(residual, 4) AS residual FROM residual_rows""",
)
def residual_files(spark: SparkSession, sf: str) -> DataFrame:
    path = new_work_path(spark, "residuals")
    T.write_residuals(residuals(feeds.calibration_rows(spark, sf)), path)
    schema = "leaf_id long, rank long, query_id long, pred double, lnn double, residual double"
    return spark.read.schema(schema).csv(path, header=True).select(
        "leaf_id", "rank", "query_id", F.round("residual", 4).alias("residual")
    )


def _wide_file(spark: SparkSession, sf: str) -> DataFrame:
    """The wide file of one filter with all its positions: written, read back and unpivoted."""
    margins = feeds.alphas(spark, sf)
    first = margins.agg(F.min("leaf_id")).first()[0]
    rows = materialise(wide_rows(with_coverage(recalls(spark, sf)), margins, first), "wide_rows")
    # One position a residual of the filter: bounded by the calibration size.
    positions = sorted(r[0] for r in rows.select("pos").distinct().collect())
    path = new_work_path(spark, "wide")
    T.write_wide(rows, path, positions)
    back = unpivot_wide(spark.read.csv(path, header=True), ["batch_id_sorted"])
    pos = F.element_at(F.array(*map(F.lit, positions)), F.col("col_group") + 1)
    return back.select(
        F.col("batch_id_sorted").cast("long").alias("rank"),
        pos.alias("pos"),
        *[F.round(c, 4).alias(c) for c in ("recall", "coverage", "error")],
    )


@register(
    "wide_export",
    f"""WITH {RECALL_CHAIN}, spots AS (SELECT unnest([0, 20, 40, 60]) AS pos),
    long AS (
      SELECT row_number() OVER (PARTITION BY c.pos ORDER BY c.recall, c.batch_id) AS rank, c.pos,
             c.recall, c.coverage FROM covered c JOIN spots USING (pos)),
    margins AS (SELECT pos, alpha FROM alphas WHERE leaf_id = (SELECT min(leaf_id) FROM alphas))
    SELECT l.pos // 20 AS col_group, round(l.recall, 4) AS recall, round(l.coverage, 4) AS coverage,
           round(alpha, 4) AS error, count(*) AS n FROM long l JOIN margins USING (pos)
    GROUP BY ALL""",
)
def wide_export(spark: SparkSession, sf: str) -> DataFrame:
    """Counts at the four positions of the twin, from the file that holds all of them."""
    back = _wide_file(spark, sf).where(F.col("pos").isin(0, 20, 40, 60))
    return (
        back.withColumn("col_group", (F.col("pos") / 20).cast("int"))
        .groupBy("col_group", "recall", "coverage", "error")
        .agg(F.count("*").alias("n"))
    )


@register(
    "wide_export_all",
    f"""WITH {RECALL_CHAIN},
    margins AS (SELECT pos, alpha FROM alphas WHERE leaf_id = (SELECT min(leaf_id) FROM alphas))
    SELECT row_number() OVER (PARTITION BY c.pos ORDER BY c.recall, c.batch_id) AS rank, c.pos,
           round(c.recall, 4) AS recall, round(c.coverage, 4) AS coverage, round(m.alpha, 4) AS error
    FROM covered c JOIN margins m ON m.pos = c.pos""",
)
def wide_export_all(spark: SparkSession, sf: str) -> DataFrame:
    return _wide_file(spark, sf)


def _error_files(spark: SparkSession, sf: str) -> DataFrame:
    """Prediction files, one folder per target, for all targets that the data has; read back and counted."""
    path = new_work_path(spark, "predictions")
    T.write_errors(
        feeds.pool(spark, sf).select(
            F.col("filter_id").alias("Filter_ID"), F.col("pred").alias("Predicted_Error"),
            F.col("actual").alias("Actual_Error"), "recall", "coverage",
        ),
        path,
    )
    schema = "Filter_ID long, Predicted_Error double, Actual_Error double, recall double, coverage double"
    back = spark.read.schema(schema).csv(path, header=True)
    return back.groupBy("recall", "coverage").agg(
        F.count("*").alias("n"), F.round(F.avg("Predicted_Error"), 4).alias("mean_pred")
    )


@register(
    "error_files",
    f"""WITH {POOL}, picked AS (
      SELECT filter_id, recall, coverage, pred, actual FROM pool
      WHERE recall IN (0.9::DOUBLE, 0.95::DOUBLE, 1.0::DOUBLE)
      AND coverage IN (0.95::DOUBLE, 1.0::DOUBLE))
    SELECT recall, coverage, count(*) AS n, round(avg(pred), 4) AS mean_pred FROM picked
    GROUP BY 1, 2""",
)
def error_files(spark: SparkSession, sf: str) -> DataFrame:
    """The twin's targets, from the files of all targets."""
    kept = F.col("recall").isin(0.9, 0.95, 1.0) & F.col("coverage").isin(0.95, 1.0)
    return _error_files(spark, sf).where(kept)


@register(
    "error_files_all",
    f"""WITH {POOL}
    SELECT recall, coverage, count(*) AS n, round(avg(pred), 4) AS mean_pred FROM pool GROUP BY 1, 2""",
)
def error_files_all(spark: SparkSession, sf: str) -> DataFrame:
    return _error_files(spark, sf)


@register(
    "training_queries_saved",
    f"""WITH {SERIES}, {TRAIN} SELECT query_id, CAST(2 AS BIGINT) AS copies FROM train""",
)
def training_queries_saved(spark: SparkSession, sf: str) -> DataFrame:
    """Generated queries are appended to their file, with a copy for tests."""
    path, test_path = new_work_path(spark, "train"), new_work_path(spark, "test")
    T.save_training_queries(feeds.train_queries(spark, sf), path, test_path)
    both = spark.read.parquet(path).unionByName(spark.read.parquet(test_path))
    return both.groupBy("query_id").agg(F.count("*").alias("copies"))


def _with_filters(spark: SparkSession, sf: str) -> Index:
    """An index saved in a new folder, then its filters with margins, batches and residence."""
    index = save_index(feeds.keyed_index(spark, sf), new_work_path(spark, "filters"))
    lines = fit_linear(feeds.facts(spark, sf).where(F.col("role") == "train"))
    near = knn_residence(knn_exact(index.members, feeds.search_queries(spark, sf), K))
    return saved.save_filters(
        index, lines, feeds.alphas(spark, sf), feeds.batches(spark, sf), stored_batch_alphas(spark, sf), near
    )


def _filtered_answers(spark: SparkSession, sf: str, index: Index) -> DataFrame:
    q = feeds.search_queries(spark, sf)
    rows = knn_filtered(index, q, K, saved.saved_predictions(index, q, 0.5), feeds.home(q))
    return rows.select("query_id", "rank", "series_id", "leaf_id", F.round("dist", 4).alias("dist"))


@register(
    "index_with_filters_save_load",
    f"WITH {FILTERED} SELECT query_id, rank, series_id, leaf_id, round(dist, 4) AS dist FROM filtered",
)
def index_with_filters_save_load(spark: SparkSession, sf: str) -> DataFrame:
    """The filtered search from a saved index alone gives the answers it gave before saving."""
    return _filtered_answers(spark, sf, load_index(spark, _with_filters(spark, sf).path, check=True))


@register(
    "filters_deactivated",
    f"""WITH {FILTERED.replace("c.kth IS NULL OR", "c.leaf_id % 2 = 0 OR c.kth IS NULL OR")}
    SELECT query_id, rank, series_id, leaf_id, round(dist, 4) AS dist FROM filtered""",
)
def filters_deactivated(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves whose filters were switched off are never pruned by them."""
    index = _with_filters(spark, sf)
    even = index.leaf.where(F.col("leaf_id") % 2 == 0)
    return _filtered_answers(spark, sf, saved.deactivate_filters(index, even))


@register(
    "filters_retrained",
    f"""WITH {ALL_FACTS}
    SELECT leaf_id, round({SLOPE}, 4) AS slope, round({INTERCEPT}, 4) AS intercept, true AS active
    FROM facts WHERE role = 'train' OR (role = 'valid' AND leaf_id < 5) GROUP BY leaf_id""",
)
def filters_retrained(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the filters are switched off and fitted again on more rows, the others stay."""
    rows = feeds.facts(spark, sf).where("role <> 'calib' AND leaf_id < 5")
    index = _with_filters(spark, sf)
    index = saved.retrain_filters(saved.deactivate_filters(index, rows.select("leaf_id").distinct()), rows)
    return index.tables["filter"].select(
        "leaf_id", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), "active"
    )


@register(
    "residence_save_load",
    f"""WITH {EXACT}, {ALL_FACTS.replace(SERIES + ",", "", 1)}, {MODEL}, {CALIBRATION},
    {CHAIN.split(CALIBRATION + ",", 1)[1]}, {BATCH_ALPHAS},
    near AS (SELECT query_id, leaf_id, count(*) AS n FROM exact GROUP BY 1, 2)
    SELECT leaf_id, count(*) AS n_queries, sum(n)::BIGINT AS n_series,
           (SELECT count(*) FROM batch_alphas b WHERE b.leaf_id = near.leaf_id) AS n_alphas,
           (SELECT round(max(alpha), 4) FROM batch_alphas b WHERE b.leaf_id = near.leaf_id) AS top
    FROM near GROUP BY leaf_id""",
)
def residence_save_load(spark: SparkSession, sf: str) -> DataFrame:
    """Residence counts and margins of the calibration batches, as the saved index holds them."""
    tables = load_index(spark, _with_filters(spark, sf).path).tables
    near = tables["residence"].groupBy("leaf_id").agg(
        F.count("*").alias("n_queries"), F.sum("n").alias("n_series")
    )
    margins = tables["batch_alpha"].groupBy("leaf_id").agg(
        F.count("*").alias("n_alphas"), F.round(F.max("alpha"), 4).alias("top")
    )
    return near.join(margins, "leaf_id")


@register(
    "filters_with_local_examples",
    f"""WITH {ALL_FACTS}, {LOCAL},
    local_ids AS (SELECT *, leaf_id * 1000 + query_no AS query_id FROM local_queries),
    {bounds("local_ids")},
    examples AS (
      SELECT q.leaf_id, b.lb, q.lnn, row_number() OVER w - 1 < floor(count(*) OVER (PARTITION BY q.leaf_id) * 4 / 5) AS trains
      FROM local_ids q JOIN local_ids_lb b ON b.query_id = q.query_id AND b.leaf_id = q.leaf_id
      WINDOW w AS (PARTITION BY q.leaf_id ORDER BY query_no)),
    both_ AS (
      SELECT leaf_id, lb, lnn, 0 AS local FROM facts WHERE role = 'train'
      UNION ALL SELECT leaf_id, lb, lnn, 1 FROM examples WHERE trains)
    SELECT leaf_id, count(*) AS n, sum(local)::BIGINT AS n_local, round({SLOPE}, 4) AS slope,
           round({INTERCEPT}, 4) AS intercept FROM both_ GROUP BY leaf_id""",
)
def filters_with_local_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Filters trained on global facts and on local examples that were saved with the index in two
    parts, each set with a split of its own."""
    index = _with_filters(spark, sf)
    made = materialise(saved.local_examples(index, local_rows(spark, sf)), "examples")
    for odd in (0, 1):
        index = saved.append_examples(index, made.where(F.col("example_no") % 2 == odd))
    rows = saved.with_local_examples(index, feeds.facts(spark, sf)).where(F.col("role") == "train")
    counts = rows.groupBy("leaf_id").agg(F.count("*").alias("n"), F.sum(F.col("is_local").cast("long")).alias("n_local"))
    return fit_linear(rows).join(counts, "leaf_id").select(
        "leaf_id", "n", "n_local", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept")
    )
