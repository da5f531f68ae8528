"""Queries on series, segments, leaves and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import feeds
from catalog.feeds import LENGTH, SEGMENTS
from catalog.registry import register
from catalog.sql_parts import (
    ALL_FACTS,
    ENVELOPE,
    SEARCH,
    SEGMENT_ROWS,
    SERIES,
    TRAIN,
    bounds,
    distances,
    draw,
    normal,
    znorm,
)
from driftleaf.functions import series as S
from driftleaf.functions.text import array_to_text, parse_model_setting
from driftleaf.operators.bounds import leaf_bounds
from driftleaf.operators.leaves import leaf_sizes, region_stats, segment_rows
from driftleaf.operators.sampling import every_nth_by_size, leaf_queries
from driftleaf.operators.scan import scan
from driftleaf.operators.tree import best_splits, child_of, split_scores
from driftleaf.plans.index import leaf_size_mismatches

CUTS = S.segmentation(LENGTH, SEGMENTS)


@register(
    "znormalised_series",
    f"""WITH {SERIES}
    SELECT series_id, round("values"[1], 4) AS first_value, round("values"[64], 4) AS last_value,
           round(list_sum("values"), 4) + 0.0 AS total,
           round(list_sum(list_transform("values", lambda x: x * x)) / 64, 4) AS variance
    FROM series""",
)
def znormalised_series(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("values")
    return feeds.series(spark, sf).select(
        "series_id",
        F.round(v[0], 4).alias("first_value"),
        F.round(v[LENGTH - 1], 4).alias("last_value"),
        (F.abs(F.round(S.total(v), 4))).alias("total"),
        F.round(S.total(F.transform(v, lambda x: x * x)) / LENGTH, 4).alias("variance"),
    )


@register(
    "series_mean_std",
    """SELECT vec_id AS series_id, round(m, 6) AS mean,
              round(sqrt(list_sum(list_transform(v, lambda x: (x - m) * (x - m))) / len(v)), 6) AS std
       FROM (SELECT vec_id, v, list_sum(v) / len(v) AS m
             FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) a) b""",
)
def series_mean_std(spark: SparkSession, sf: str) -> DataFrame:
    ms = S.mean_std(S.as_doubles(F.col("embedding")))
    return (
        feeds.table(spark, sf, "embeddings")
        .select(F.col("vec_id").alias("series_id"), ms.alias("ms"))
        .select(
            "series_id",
            F.round("ms.mean", 6).alias("mean"),
            F.round("ms.std", 6).alias("std"),
        )
    )


@register(
    "segment_stats",
    f"""WITH {SERIES}, {SEGMENT_ROWS}
    SELECT series_id, CAST(ord AS BIGINT) AS ord, CAST(off AS BIGINT) AS off, CAST(len AS BIGINT) AS len,
           round(mean, 4) AS mean, round(std, 4) AS std FROM seg_rows""",
)
def segment_stats(spark: SparkSession, sf: str) -> DataFrame:
    return segment_rows(feeds.series(spark, sf), CUTS).select(
        "series_id", "ord", "off", "len",
        F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
    )


@register(
    "leaf_sizes",
    f"WITH {SERIES} SELECT leaf_id, count(*) AS n FROM series GROUP BY leaf_id",
)
def sizes(spark: SparkSession, sf: str) -> DataFrame:
    return leaf_sizes(feeds.series(spark, sf))


@register(
    "leaf_envelope",
    f"""WITH {SERIES}, {SEGMENT_ROWS}, {ENVELOPE}
    SELECT leaf_id, CAST(off AS BIGINT) AS off, CAST(len AS BIGINT) AS len, n,
           round(min_mean, 4) AS min_mean, round(max_mean, 4) AS max_mean,
           round(min_std, 4) AS min_std, round(max_std, 4) AS max_std FROM envelope""",
)
def leaf_envelope(spark: SparkSession, sf: str) -> DataFrame:
    leaf = feeds.keyed_index(spark, sf).leaf
    return leaf.select("leaf_id", "n", F.explode("seg").alias("s")).select(
        "leaf_id", "s.off", "s.len", "n",
        *[F.round(f"s.{c}", 4).alias(c) for c in ("min_mean", "max_mean", "min_std", "max_std")],
    )


@register(
    "leaf_lower_bound",
    f"""WITH {SERIES}, {SEARCH}, {SEGMENT_ROWS}, {ENVELOPE}, {bounds('search')}
    SELECT query_id, leaf_id, round(lb, 4) AS lb FROM search_lb""",
)
def leaf_lower_bound(spark: SparkSession, sf: str) -> DataFrame:
    q, index = feeds.search_queries(spark, sf), feeds.keyed_index(spark, sf)
    return leaf_bounds(q, index.leaf).select("query_id", "leaf_id", F.round("lb", 4).alias("lb"))


@register(
    "bound_soundness",
    f"""WITH {SERIES} SELECT leaf_id, CAST(0 AS BIGINT) AS violations FROM series GROUP BY leaf_id""",
)
def bound_soundness(spark: SparkSession, sf: str) -> DataFrame:
    """Queries whose lower bound exceeds their true distance to the leaf: there must be none."""
    rows = feeds.facts(spark, sf)
    return rows.groupBy("leaf_id").agg(
        F.count_if(F.col("lb") > F.col("lnn") + 1e-7).alias("violations")
    )


@register(
    "leaf_nn_distance",
    f"""WITH {SERIES}, {SEARCH}, {distances('search')}
    SELECT query_id, leaf_id, round(min(dist), 4) AS lnn FROM search_dist GROUP BY 1, 2""",
)
def leaf_nn_distance(spark: SparkSession, sf: str) -> DataFrame:
    q = feeds.search_queries(spark, sf)
    return (
        scan(feeds.series(spark, sf), q, 1, per_leaf=True)
        .groupBy("query_id", "leaf_id")
        .agg(F.round(F.sqrt(F.min("dist2")), 4).alias("lnn"))
    )


_SPLIT = f"""
    halves AS (SELECT unnest(range({2 * SEGMENTS})) AS h),
    sub_mean AS (
      SELECT series_id, leaf_id, h // 2 AS ord, h % 2 AS half, h * {LENGTH // SEGMENTS // 2} AS off,
             {LENGTH // SEGMENTS // 2} AS len,
             "values"[h * {LENGTH // SEGMENTS // 2} + 1 : (h + 1) * {LENGTH // SEGMENTS // 2}] AS part
      FROM series, halves),
    sub_rows AS (
      SELECT *, sqrt(list_sum(list_transform(part, lambda x: (x - mean) * (x - mean))) / len) AS std
      FROM (SELECT *, list_sum(part) / len AS mean FROM sub_mean) t),
    regions AS (
      SELECT leaf_id AS node_id, ord * 3 AS ord, off, len, false AS vertical, count(*) AS n,
             min(mean) AS min_mean, max(mean) AS max_mean, min(std) AS min_std, max(std) AS max_std
      FROM seg_rows GROUP BY leaf_id, ord, off, len
      UNION ALL
      SELECT leaf_id, ord * 3 + 1 + half, off, len, true, count(*),
             min(mean), max(mean), min(std), max(std)
      FROM sub_rows GROUP BY leaf_id, ord, half, off, len),
    scored AS (
      SELECT node_id, n, off, len, vertical, 'MEAN' AS stat, ord * 2 AS seq, min_mean AS low,
             (max_mean - min_mean) / 2 AS step,
             len * pow(max_mean - min_mean, 2) * 0.75 AS gain FROM regions
      UNION ALL
      SELECT node_id, n, off, len, vertical, 'STD', ord * 2 + 1, min_std, (max_std - min_std) / 2,
             len * (pow(max_std, 2)
                    - (pow(max_std, 2) + pow(max_std - (max_std - min_std) / 2, 2)) / 2)
      FROM regions),
    best AS (
      SELECT *, CASE WHEN vertical THEN gain / 2 ELSE gain END AS score FROM scored)"""


def _regions(spark: SparkSession, sf: str) -> DataFrame:
    """Segments, each followed by its halves, of the leaves given by the label."""
    regions = []
    for off, n in CUTS:
        regions += [(off, n)] + [(off + o, m) for o, m in S.segmentation(n, 2)]
    return (
        region_stats(feeds.series(spark, sf), regions)
        .withColumn("vertical", F.col("ord") % 3 > 0)
        .withColumnRenamed("leaf_id", "node_id")
    )


@register(
    "split_scores",
    f"""WITH {SERIES}, {SEGMENT_ROWS}, {_SPLIT}
    SELECT node_id, CAST(off AS BIGINT) AS off, CAST(len AS BIGINT) AS len, vertical, stat,
           round(score, 4) AS score FROM best""",
)
def scores(spark: SparkSession, sf: str) -> DataFrame:
    return split_scores(_regions(spark, sf)).select(
        "node_id", "off", "len", "vertical", "stat", F.round("score", 4).alias("score")
    )


@register(
    "best_splits",
    f"""WITH {SERIES}, {SEGMENT_ROWS}, {_SPLIT}
    SELECT node_id, n, CAST(off AS BIGINT) AS off, CAST(len AS BIGINT) AS len, vertical, stat,
           round(low + step, 4) AS breakpoint FROM (
      SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, seq) AS r FROM best) t
    WHERE r = 1""",
)
def splits(spark: SparkSession, sf: str) -> DataFrame:
    found = best_splits(split_scores(_regions(spark, sf)))
    return found.select(
        "node_id", "n", "off", "len", "vertical", "stat",
        F.round(F.element_at("breakpoints", 1), 4).alias("breakpoint"),
    )


@register(
    "value_routing",
    """SELECT l_returnflag,
              CAST((l_quantity >= 10)::INT + (l_quantity >= 20)::INT + (l_quantity >= 40)::INT AS BIGINT)
              AS child, count(*) AS n FROM lineitem GROUP BY 1, 2""",
)
def value_routing(spark: SparkSession, sf: str) -> DataFrame:
    points = F.array(F.lit(10.0), F.lit(20.0), F.lit(40.0))
    rows = feeds.table(spark, sf, "lineitem")
    child = child_of(F.col("l_quantity"), points)
    return rows.groupBy("l_returnflag", child.alias("child")).agg(F.count("*").alias("n"))


@register(
    "tree_partition",
    f"""WITH {SERIES} SELECT count(*) AS n_series, CAST(0 AS BIGINT) AS oversize,
    CAST(0 AS BIGINT) AS mismatches FROM series""",
)
def tree_partition(spark: SparkSession, sf: str) -> DataFrame:
    """Every series lies in one leaf, no leaf is too large, stored sizes are right."""
    index = feeds.tree_index(spark, sf)
    bad = leaf_size_mismatches(index).count()
    return index.leaf.agg(
        F.sum("n").alias("n_series"),
        F.count_if(F.col("n") > index.options.leaf_size).alias("oversize"),
        F.lit(bad).cast("long").alias("mismatches"),
    )


@register("tree_leaves")
def tree_leaves(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.tree_index(spark, sf).leaf.select("leaf_id", "depth", "n", F.size("seg").alias("segs"))


@register(
    "tree_route",
    f"""WITH {SERIES} SELECT series_id, true AS same_leaf FROM series""",
)
def tree_route(spark: SparkSession, sf: str) -> DataFrame:
    """Routing a member again finds the leaf that stores it."""
    index = feeds.tree_index(spark, sf)
    stored = index.members.select("series_id", F.col("leaf_id").alias("stored"))
    again = index.route(feeds.series(spark, sf)).select("series_id", "leaf_id")
    return again.join(stored, "series_id").select(
        "series_id", (F.col("leaf_id") == F.col("stored")).alias("same_leaf")
    )


@register(
    "synthetic_queries",
    f"""WITH {SERIES}, {TRAIN}
    SELECT query_id, source_id, source_leaf, round("values"[1], 4) AS first_value,
           round("values"[64], 4) AS last_value FROM train""",
)
def synthetic_queries(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("values")
    return feeds.train_queries(spark, sf).select(
        "query_id", "source_id", "source_leaf", F.round(v[0], 4).alias("first_value"),
        F.round(v[LENGTH - 1], 4).alias("last_value"),
    )


@register(
    "leaf_synthetic_queries",
    f"""WITH {SERIES}, sizes AS (SELECT leaf_id, count(*) AS n FROM series GROUP BY 1),
    placed AS (
      SELECT leaf_id, series_id AS source_id, row_number() OVER (
        PARTITION BY leaf_id ORDER BY {draw('leaf', 'series_id')}, series_id) AS r
      FROM series JOIN sizes USING (leaf_id) WHERE n > 8)
    SELECT leaf_id, source_id FROM placed WHERE r = 1""",
)
def leaf_synthetic(spark: SparkSession, sf: str) -> DataFrame:
    """One noisy member of every leaf above the size threshold."""
    index = feeds.keyed_index(spark, sf)
    return leaf_queries(index.members, index.leaf, 8).select("leaf_id", "source_id")


_LOCAL_NOISE = (
    "list_transform(\"values\", lambda x, i: x + level * "
    + normal("local/noise", "series_id", "i - 1")
    + ")"
)


def local_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(leaf_id, query_no, values, lnn) of ten local queries a leaf."""
    from driftleaf.operators.facts import nn_distance_stats
    from driftleaf.operators.sampling import local_queries

    index = feeds.keyed_index(spark, sf)
    stats = nn_distance_stats(feeds.facts(spark, sf))
    return local_queries(index.members, index.leaf, stats, 10)


#: Local queries of every leaf as (leaf_id, query_no, lnn, "values").
LOCAL = f"""
    limits AS (
      SELECT leaf_id, avg(lnn) - stddev_pop(lnn) AS most FROM facts GROUP BY 1
      HAVING avg(lnn) - stddev_pop(lnn) > 0),
    tries AS (
      SELECT * FROM (
        SELECT series_id, leaf_id, "values",
               {0.1} + {draw('local/level', 'series_id')} * {0.4 - 0.1!r} AS level,
               row_number() OVER (PARTITION BY leaf_id
                                  ORDER BY {draw('local', 'series_id')}, series_id) AS attempt
        FROM series JOIN limits USING (leaf_id)) t WHERE attempt <= 30),
    noised AS (SELECT leaf_id, attempt, {_LOCAL_NOISE} AS noisy FROM tries),
    scaled AS ({znorm('noised', 'noisy', 'leaf_id, attempt')}),
    near AS (
      SELECT q.leaf_id, q.attempt, min(list_distance(q."values", s."values")) AS lnn
      FROM scaled q JOIN series s ON s.leaf_id = q.leaf_id GROUP BY 1, 2),
    kept AS (
      SELECT n.leaf_id, n.attempt, n.lnn,
             row_number() OVER (PARTITION BY n.leaf_id ORDER BY attempt) AS query_no
      FROM near n JOIN limits l ON l.leaf_id = n.leaf_id WHERE lnn <= most),
    local_queries AS (
      SELECT k.leaf_id, k.query_no, k.lnn, s."values" FROM kept k
      JOIN scaled s ON s.leaf_id = k.leaf_id AND s.attempt = k.attempt WHERE query_no <= 10)"""


@register(
    "local_synthetic_queries",
    f"""WITH {ALL_FACTS}, {LOCAL}
    SELECT leaf_id, query_no, round(lnn, 4) AS lnn FROM local_queries""",
)
def local_synthetic(spark: SparkSession, sf: str) -> DataFrame:
    return local_rows(spark, sf).select(
        "leaf_id", "query_no", F.round("lnn", 4).alias("lnn")
    )


@register(
    "leaf_size_sample",
    f"""WITH {SERIES}, sizes AS (SELECT leaf_id, count(*) AS n FROM series GROUP BY 1),
    placed AS (SELECT leaf_id, n, row_number() OVER (ORDER BY n DESC, leaf_id) - 1 AS pos,
                      greatest(1, (SELECT count(*) FROM sizes) // 4) AS step FROM sizes)
    SELECT leaf_id, n FROM placed WHERE pos % step = 0 AND pos < 4 * step""",
)
def leaf_size_sample(spark: SparkSession, sf: str) -> DataFrame:
    return every_nth_by_size(leaf_sizes(feeds.series(spark, sf)), 4).select("leaf_id", "n")


@register(
    "model_settings",
    """SELECT p_partkey, 'mlp' AS model_type,
              CAST(CASE WHEN p_size % 2 = 0 THEN p_size % 5 + 1 ELSE 2 END AS BIGINT) AS n_layers,
              CAST(CASE WHEN p_size % 2 = 0 THEN p_size * 8 ELSE 256 END AS BIGINT) AS layer_size,
              p_size % 2 = 0 AND p_size > 25 AS has_skip FROM part""",
)
def model_settings(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    text = F.concat_ws(
        "_",
        F.concat(F.lit("v"), (size % 2).cast("string")),
        F.lit("mlp"),
        (size % 5 + 1).cast("string"),
        (size * 8).cast("string"),
        F.when(size > 25, "t").otherwise("f"),
    )
    return (
        feeds.table(spark, sf, "part")
        .select("p_partkey", parse_model_setting(text).alias("m"))
        .select("p_partkey", "m.model_type", "m.n_layers", "m.layer_size", "m.has_skip")
    )


@register(
    "series_as_text",
    """SELECT vec_id, array_to_string(list_transform(embedding, lambda x: printf('%.6f', CAST(x AS DOUBLE))), ' ')
              AS text FROM embeddings""",
)
def series_as_text(spark: SparkSession, sf: str) -> DataFrame:
    text = array_to_text(S.as_doubles(F.col("embedding")))
    return feeds.table(spark, sf, "embeddings").select("vec_id", text.alias("text"))


@register(
    "near_equality",
    """SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber,
              count(*) FILTER (WHERE abs(l_discount - l_tax)
                                     <= 1.1920929e-07 * greatest(abs(l_discount), abs(l_tax))) AS equal,
              count(*) FILTER (WHERE abs(l_discount) <= 1.1920929e-07) AS zero
       FROM lineitem GROUP BY l_linenumber""",
)
def near_equality(spark: SparkSession, sf: str) -> DataFrame:
    return (
        feeds.table(spark, sf, "lineitem")
        .groupBy("l_linenumber")
        .agg(
            F.count_if(S.nearly_equal(F.col("l_discount"), F.col("l_tax"))).alias("equal"),
            F.count_if(S.is_zero(F.col("l_discount"))).alias("zero"),
        )
    )
