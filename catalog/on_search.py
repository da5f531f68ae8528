"""Search modes and recall."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import feeds
from catalog.feeds import K
from catalog.registry import register
from catalog.sql_parts import (
    ALL_FACTS,
    CALIBRATION,
    ENVELOPE,
    MODEL,
    SEARCH,
    SEGMENT_ROWS,
    SERIES,
    bounds,
    distances,
    top,
)
from driftleaf.models.fits import fit_linear, query_features
from driftleaf.operators import recall as R
from driftleaf.operators.bounds import leaf_bounds
from driftleaf.operators.conformal import alpha_at_confidence
from driftleaf.operators.facts import knn_residence, leaf_top_k, residence_share, with_kth_before_visit
from driftleaf.operators.navigation import Navigator, TreeNavigator, combined_scores
from driftleaf.plans import search as P
from driftleaf.plans.learned import filtered_report, learn_filters
from driftleaf.session import materialise, pin, series_bytes

BASE = f"{SERIES}, {SEARCH}, {distances('search')}"
EXACT = f"{BASE}, {top('exact', 'search_dist', K)}"
ANSWER = "query_id, rank, series_id, leaf_id, round(dist, 4) AS dist"

RESIDENT = f"""{EXACT},
    home_dist AS (
      SELECT d.* FROM search_dist d JOIN search q
      ON q.query_id = d.query_id AND q.source_leaf = d.leaf_id),
    {top('approx', 'home_dist', K)}"""

LIMITED = f"""{RESIDENT}, {SEGMENT_ROWS}, {ENVELOPE}, {bounds('search')},
    kth AS (SELECT query_id, dist AS kth FROM approx WHERE rank = {K}),
    cand AS (
      SELECT l.query_id, l.leaf_id, l.lb, kth FROM search_lb l JOIN search q USING (query_id)
      LEFT JOIN kth k USING (query_id)
      WHERE l.leaf_id <> q.source_leaf AND (kth IS NULL OR lb <= kth * (1 + 1e-7) + 1e-7))"""


def _answer(df: DataFrame, leaf: bool = True) -> DataFrame:
    columns = ["query_id", "rank", "series_id"] + (["leaf_id"] if leaf else [])
    return df.select(*columns, F.round("dist", 4).alias("dist"))


def _exact(spark: SparkSession, sf: str) -> DataFrame:
    return P.knn_exact(feeds.series(spark, sf), feeds.search_queries(spark, sf), K)


def _resident(spark: SparkSession, sf: str) -> DataFrame:
    q = feeds.search_queries(spark, sf)
    return P.knn_resident(feeds.keyed_index(spark, sf), q, K, feeds.home(q))


@register("knn_exact", f"WITH {EXACT} SELECT {ANSWER} FROM exact")
def knn_exact(spark: SparkSession, sf: str) -> DataFrame:
    return _answer(_exact(spark, sf))


@register(
    "knn_join",
    f"""WITH {SERIES},
    pairs AS (SELECT a.series_id AS query_id, b.series_id, b.leaf_id,
                     list_distance(a."values", b."values") AS dist FROM series a, series b),
    {top('joined', 'pairs', K)} SELECT query_id, rank, series_id, round(dist, 4) AS dist FROM joined""",
)
def knn_join(spark: SparkSession, sf: str) -> DataFrame:
    """Every series asks for its neighbours among all series, through the tree index."""
    q = feeds.series(spark, sf).select(F.col("series_id").alias("query_id"), "values")
    return _answer(P.knn_pruned(feeds.tree_index(spark, sf), q, K), leaf=False)


@register(
    "knn_lb_pruned",
    f"WITH {EXACT} SELECT query_id, rank, series_id, round(dist, 4) AS dist FROM exact",
)
def knn_lb_pruned(spark: SparkSession, sf: str) -> DataFrame:
    q = feeds.search_queries(spark, sf)
    return _answer(P.knn_pruned(feeds.tree_index(spark, sf), q, K), leaf=False)


@register(
    "knn_descent_by_join",
    f"WITH {EXACT} SELECT query_id, rank, series_id, round(dist, 4) AS dist FROM exact",
)
def knn_descent_by_join(spark: SparkSession, sf: str) -> DataFrame:
    """The same search for a tree that is too large to ship: the frontier meets the node table level by level."""
    index = replace(feeds.tree_index(spark, sf), ship=False)
    return _answer(P.knn_pruned(index, feeds.search_queries(spark, sf), K), leaf=False)


@register("knn_lb_pruned_by_key", f"WITH {EXACT} SELECT {ANSWER} FROM exact")
def knn_lb_pruned_by_key(spark: SparkSession, sf: str) -> DataFrame:
    q = feeds.search_queries(spark, sf)
    return _answer(P.knn_pruned(feeds.keyed_index(spark, sf), q, K, feeds.home(q)))


@register("knn_resident", f"WITH {RESIDENT} SELECT {ANSWER} FROM approx")
def knn_resident(spark: SparkSession, sf: str) -> DataFrame:
    return _answer(_resident(spark, sf))


@register("knn_resident_tree")
def knn_resident_tree(spark: SparkSession, sf: str) -> DataFrame:
    return _answer(P.knn_resident(feeds.tree_index(spark, sf), feeds.search_queries(spark, sf), K))


@register(
    "bound_candidates",
    f"WITH {LIMITED} SELECT query_id, leaf_id, round(lb, 4) AS lb FROM cand",
)
def bound_candidates(spark: SparkSession, sf: str) -> DataFrame:
    q, index = feeds.search_queries(spark, sf), feeds.keyed_index(spark, sf)
    _, limited = P.seed_limits(index, q, K, feeds.home(q))
    return P.candidates(index, limited, feeds.home(q)).select(
        "query_id", "leaf_id", F.round("lb", 4).alias("lb")
    )


def search_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions and margins of the per-leaf lines for the search queries."""
    q, index = feeds.search_queries(spark, sf), feeds.keyed_index(spark, sf)
    train = feeds.facts(spark, sf).where(F.col("role") == "train")
    margins = alpha_at_confidence(feeds.alphas(spark, sf), 0.5)
    return (
        leaf_bounds(q, index.leaf)
        .join(fit_linear(train), "leaf_id")
        .join(margins, "leaf_id")
        .select(
            "query_id", "leaf_id",
            (F.col("intercept") + F.col("slope") * F.col("lb")).alias("pred"), "alpha",
        )
    )


MARGIN = """
    margin_pos AS (SELECT leaf_id, least(CAST(floor(count(*) * 0.5) AS BIGINT), count(*) - 1) AS pos
                   FROM alphas GROUP BY leaf_id),
    margin AS (SELECT a.leaf_id, a.alpha FROM alphas a JOIN margin_pos m
               ON m.leaf_id = a.leaf_id AND m.pos = a.pos)"""

FILTERED = f"""{ALL_FACTS}, {MODEL}, {CALIBRATION}, {MARGIN},
    {LIMITED.replace(SERIES + ', ', '', 1).replace(SEGMENT_ROWS + ', ' + ENVELOPE + ', ', '', 1)},
    kept AS (
      SELECT c.query_id, c.leaf_id FROM cand c JOIN model m USING (leaf_id)
      JOIN margin a USING (leaf_id)
      WHERE c.kth IS NULL OR greatest(0.0, intercept + slope * lb - alpha) <= c.kth),
    open_dist AS (
      SELECT * FROM home_dist UNION ALL
      SELECT d.* FROM search_dist d JOIN kept k
      ON k.query_id = d.query_id AND k.leaf_id = d.leaf_id),
    {top('filtered', 'open_dist', K)}"""


def _filtered(spark: SparkSession, sf: str) -> DataFrame:
    q, index = feeds.search_queries(spark, sf), feeds.keyed_index(spark, sf)
    return P.knn_filtered(index, q, K, search_predictions(spark, sf), feeds.home(q))


@register("knn_filtered", f"WITH {FILTERED} SELECT {ANSWER} FROM filtered")
def knn_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _answer(_filtered(spark, sf))


def _rounds(widths: list[int]) -> str:
    """Rounds over the candidates by bound, each with the k-th distance of those before; the widths have
    to cover all leaves."""
    out, reached, left = [], "home_dist", "cand"
    for i, width in enumerate(widths, 1):
        out.append(f"""
    turn{i} AS (SELECT query_id, leaf_id, lb, row_number() OVER (PARTITION BY query_id ORDER BY lb, leaf_id) AS r FROM {left}),
    read{i} AS (SELECT query_id, leaf_id FROM turn{i} WHERE r <= {width}),
    seen{i} AS (SELECT * FROM {reached} UNION ALL SELECT d.* FROM search_dist d JOIN read{i} USING (query_id, leaf_id)),
    {top(f'best{i}', f'seen{i}', K)},
    kth{i} AS (SELECT query_id, dist AS kth FROM best{i} WHERE rank = {K}),
    left{i} AS (SELECT t.query_id, t.leaf_id, t.lb FROM turn{i} t LEFT JOIN kth{i} k USING (query_id)
      WHERE r > {width} AND (kth IS NULL OR lb <= kth * (1 + 1e-7) + 1e-7))""")
        reached, left = f"seen{i}", f"left{i}"
    return ",".join(out)


_WIDTHS = [1, 4, 16]


@register(
    "knn_in_rounds",
    f"""WITH {LIMITED}, {_rounds(_WIDTHS)},
    sizes AS (SELECT leaf_id, count(*) AS n FROM series GROUP BY leaf_id),
    reads AS (
      SELECT query_id, source_leaf AS leaf_id, 0 AS round FROM search
      {" ".join(f"UNION ALL SELECT query_id, leaf_id, {i} FROM read{i}" for i in range(1, len(_WIDTHS) + 1))}),
    work AS (SELECT query_id, sum(n)::BIGINT AS series_read, max(round)::BIGINT AS rounds FROM reads JOIN sizes USING (leaf_id) GROUP BY 1)
    SELECT query_id, rank, series_id, leaf_id, round(dist, 4) AS dist, series_read, rounds
    FROM best{len(_WIDTHS)} JOIN work USING (query_id)""",
)
def knn_in_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Lowest bounds first, with the k-th distance tightened between rounds; and how much was read."""
    q, index = feeds.search_queries(spark, sf), feeds.keyed_index(spark, sf)
    answers, read = P.knn_in_rounds(index, q, K, resident=feeds.home(q))
    work = read.join(index.leaf.select("leaf_id", "n"), "leaf_id").groupBy("query_id").agg(
        F.sum("n").alias("series_read"), F.max("round").alias("rounds")
    )
    return _answer(answers).join(work, "query_id")


@register("knn_in_rounds_tree", f"WITH {EXACT} SELECT query_id, rank, series_id, round(dist, 4) AS dist FROM exact")
def knn_in_rounds_tree(spark: SparkSession, sf: str) -> DataFrame:
    answers, _ = P.knn_in_rounds(feeds.tree_index(spark, sf), feeds.search_queries(spark, sf), K)
    return _answer(answers, leaf=False)


def _budget(where: str) -> str:
    return f"""{LIMITED},
    sizes AS (SELECT leaf_id, count(*) AS n FROM series GROUP BY leaf_id),
    walk AS (
      SELECT query_id, leaf_id,
             count(*) OVER w AS leaves_before, coalesce(sum(n) OVER w, 0) AS series_before
      FROM cand JOIN sizes USING (leaf_id)
      WINDOW w AS (PARTITION BY query_id ORDER BY lb, leaf_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    open_dist AS (
      SELECT * FROM home_dist UNION ALL
      SELECT d.* FROM search_dist d JOIN walk k
      ON k.query_id = d.query_id AND k.leaf_id = d.leaf_id WHERE {where}),
    {top('budgeted', 'open_dist', K)}"""


@register("knn_leaf_budget", f"WITH {_budget('leaves_before < 3')} SELECT {ANSWER} FROM budgeted")
def knn_leaf_budget(spark: SparkSession, sf: str) -> DataFrame:
    q, index = feeds.search_queries(spark, sf), feeds.keyed_index(spark, sf)
    return _answer(P.knn_budgeted(index, q, K, max_leaves=3, resident=feeds.home(q)))


@register(
    "knn_series_budget", f"WITH {_budget('series_before < 120')} SELECT {ANSWER} FROM budgeted"
)
def knn_series_budget(spark: SparkSession, sf: str) -> DataFrame:
    q, index = feeds.search_queries(spark, sf), feeds.keyed_index(spark, sf)
    return _answer(P.knn_budgeted(index, q, K, max_series=120, resident=feeds.home(q)))


def _navigator_scores(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        index, train = feeds.keyed_index(spark, sf), feeds.train_queries(spark, sf)
        shares = residence_share(knn_residence(P.knn_exact(index.members, train, K)), K)
        features = query_features(train, feeds.LENGTH)
        navigator = Navigator.fit(shares, features, index.leaf)
        return navigator.scores(query_features(feeds.search_queries(spark, sf), feeds.LENGTH))

    return feeds.stored(spark, sf, "navigator_scores", build)


@register("knn_navigated")
def knn_navigated(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves in the order of the learned score, three leaves per query."""
    q, index = feeds.search_queries(spark, sf), feeds.keyed_index(spark, sf)
    scores = _navigator_scores(spark, sf)
    return _answer(
        P.knn_budgeted(index, q, K, max_leaves=3, resident=feeds.home(q), scores=scores)
    )


@register("knn_navigated_combined")
def knn_navigated_combined(spark: SparkSession, sf: str) -> DataFrame:
    q, index = feeds.search_queries(spark, sf), feeds.keyed_index(spark, sf)
    home = feeds.home(q)
    others = leaf_bounds(q, index.leaf).join(home, ["query_id", "leaf_id"], "left_anti")
    scores = combined_scores(_navigator_scores(spark, sf), others)
    return _answer(P.knn_budgeted(index, q, K, max_leaves=3, resident=home, scores=scores))


def _tree_scores(spark: SparkSession, sf: str) -> DataFrame:
    def build() -> DataFrame:
        index, train = feeds.tree_index(spark, sf), feeds.train_queries(spark, sf)
        shares = residence_share(knn_residence(P.knn_exact(index.members, train, K)), K)
        features = query_features(train, feeds.LENGTH)
        navigator = TreeNavigator.fit(shares, features, index.nodes, index.options.n_children)
        return navigator.scores(query_features(feeds.search_queries(spark, sf), feeds.LENGTH))

    return feeds.stored(spark, sf, "tree_scores", build)


@register("navigator_shares", f"WITH {SERIES}, {SEARCH} SELECT query_id, 1.0::DOUBLE AS total, true AS has_home FROM search")
def navigator_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The shares that the classifiers along the tree give to all leaves of a query sum to 1; the leaf that
    the query falls into is among them."""
    home = feeds.tree_index(spark, sf).resident(feeds.search_queries(spark, sf)).withColumn("home", F.lit(True))
    scores = _tree_scores(spark, sf).join(home, ["query_id", "leaf_id"], "left")
    return scores.groupBy("query_id").agg(
        F.round(F.sum("score"), 6).alias("total"), F.coalesce(F.max("home"), F.lit(False)).alias("has_home")
    )


_BUDGETS = [1, 4, 16, 1_000_000]


@register(
    "navigated_recall",
    f"""WITH {SERIES}, {SEARCH} SELECT b::BIGINT AS max_leaves, (SELECT count(*) FROM search) AS n_queries, true AS not_worse,
    b = {_BUDGETS[-1]} OR NULL AS exact FROM (SELECT unnest({_BUDGETS}) AS b) t""",
)
def navigated_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Searches in the order of the learned shares: recall does not fall as the budget grows, and without
    a limit the answers are exact."""
    index, scores = feeds.tree_index(spark, sf), _tree_scores(spark, sf)
    asked = feeds.search_queries(spark, sf).select("query_id", "values")
    q = pin(asked, "queries", series_bytes(asked))
    resident = pin(index.resident(q), "resident")
    truth = materialise(P.knn_exact(feeds.series(spark, sf), q, K), "truth")
    rows, last = [], 0.0
    for budget in _BUDGETS:
        found = R.recall_by_set(P.knn_budgeted(index, q, K, max_leaves=budget, resident=resident, scores=scores), truth, K)
        recall, n = found.agg(F.avg("recall"), F.count("*")).first()
        rows.append((budget, n, recall >= last, recall == 1.0 or None if budget == _BUDGETS[-1] else None))
        last = recall
    return spark.createDataFrame(rows, "max_leaves long, n_queries long, not_worse boolean, exact boolean")


@register(
    "combined_leaf_scores",
    f"""WITH {SERIES}, {SEARCH}, {SEGMENT_ROWS}, {ENVELOPE}, {bounds('search')}, {distances('search')},
    near AS (SELECT query_id, leaf_id, -min(dist) AS score FROM search_dist GROUP BY 1, 2),
    s AS (SELECT query_id, leaf_id,
                 (score - min(score) OVER (PARTITION BY query_id))
                 / (max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id))
                 AS s FROM near),
    o AS (SELECT l.* FROM search_lb l JOIN search q USING (query_id) WHERE leaf_id <> source_leaf),
    b AS (SELECT query_id, leaf_id, max(lb) OVER (PARTITION BY query_id) AS hi,
                 min(lb) OVER (PARTITION BY query_id) AS lo, lb FROM o)
    SELECT query_id, leaf_id,
           round(0.2 * s + 0.8 * (1.0 - CASE WHEN hi > lo THEN (lb - lo) / (hi - lo) ELSE 0.0 END), 4)
           AS score FROM s JOIN b USING (query_id, leaf_id)""",
)
def combined_leaf_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Min-max scaled mix, with the negative in-leaf distance in place of a learned score."""
    q, index = feeds.search_queries(spark, sf), feeds.keyed_index(spark, sf)
    near = leaf_top_k(index.clustered_members(), q, 1).select(
        "query_id", "leaf_id", (-F.col("dist")).alias("score")
    )
    others = leaf_bounds(q, index.leaf).join(
        feeds.home(q), ["query_id", "leaf_id"], "left_anti"
    )
    return combined_scores(near, others).select(
        "query_id", "leaf_id", F.round("score", 4).alias("score")
    )


_RECALL = f"""
    {RESIDENT},
    per_query AS (
      SELECT e.query_id, count(a.series_id) / {K}::DOUBLE AS recall FROM exact e
      LEFT JOIN approx a ON a.query_id = e.query_id AND a.series_id = e.series_id
      GROUP BY e.query_id)"""


def _set_recall(spark: SparkSession, sf: str) -> DataFrame:
    return R.recall_by_set(_resident(spark, sf), _exact(spark, sf), K)


@register("recall_by_set", f"WITH {_RECALL} SELECT query_id, round(recall, 4) AS recall FROM per_query")
def recall_by_set(spark: SparkSession, sf: str) -> DataFrame:
    return _set_recall(spark, sf).select("query_id", F.round("recall", 4).alias("recall"))


@register(
    "recall_by_intersection",
    f"WITH {_RECALL} SELECT query_id, round(recall, 4) AS recall FROM per_query",
)
def recall_by_intersection(spark: SparkSession, sf: str) -> DataFrame:
    out = R.recall_by_intersection(_resident(spark, sf), _exact(spark, sf), K)
    return out.select("query_id", F.round("recall", 4).alias("recall"))


@register(
    "recall_by_rank",
    f"""WITH {RESIDENT}
    SELECT e.query_id, round(count(a.series_id) / {K}::DOUBLE, 4) AS recall FROM exact e
    LEFT JOIN approx a ON a.query_id = e.query_id AND a.series_id = e.series_id AND a.rank = e.rank
    GROUP BY e.query_id""",
)
def recall_by_rank(spark: SparkSession, sf: str) -> DataFrame:
    out = R.recall_by_rank(_resident(spark, sf), _exact(spark, sf), K)
    return out.select("query_id", F.round("recall", 4).alias("recall"))


_REPORT = f"""{_RECALL},
    batched AS (
      SELECT least(query_id // 10, greatest(1, (SELECT count(*) FROM search) // 10) - 1) AS batch_id,
             recall FROM per_query),
    report AS (
      SELECT batch_id, count(*) AS n_queries, avg(recall) AS recall,
             round(avg(recall), 5) >= round(0.251::DOUBLE, 5) AS above_target FROM batched GROUP BY batch_id)"""


@register(
    "batch_recall_report",
    f"""WITH {_REPORT}
    SELECT batch_id, n_queries, round(recall, 4) AS recall, above_target
    FROM report""",
)
def batch_recall_report(spark: SparkSession, sf: str) -> DataFrame:
    return R.batch_report(_set_recall(spark, sf), 0.251).withColumn("recall", F.round("recall", 4))


@register(
    "search_report",
    f"""WITH {_REPORT}
    SELECT (SELECT count(*) FROM per_query) AS n_queries, count(*) AS n_batches,
           round((SELECT avg(recall) FROM per_query), 4) AS recall,
           round(avg(above_target::INT), 4) AS coverage,
           (SELECT avg(recall) FROM per_query) >= 0.251 AS recall_passed,
           avg(above_target::INT) >= 0.9 AS coverage_passed FROM report""",
)
def search_report(spark: SparkSession, sf: str) -> DataFrame:
    out = R.search_report(_set_recall(spark, sf), 0.251, 0.9)
    return out.withColumn("recall", F.round("recall", 4)).withColumn(
        "coverage", F.round("coverage", 4)
    )


TARGET_RECALL, TARGET_COVERAGE = 0.9, 0.8


def _active_filters(spark: SparkSession, sf: str, recall: float, coverage: float) -> DataFrame:
    """Lines and margins of the tree's leaves, learned from the training queries."""
    q = feeds.train_queries(spark, sf).select("query_id", "values")
    filters = learn_filters(feeds.tree_index(spark, sf), q, feeds.BATCHES, feeds.BATCH_SIZE)
    return filters.at(recall, coverage)


@register(
    "filtered_search_report",
    f"""WITH {SERIES}, {SEARCH}
    SELECT count(*) AS n_queries, greatest(1, count(*) // 10) AS n_batches,
           count(*) * (SELECT count(*) FROM series) AS n_series, true AS recall_passed,
           true AS coverage_passed, true AS prunes FROM search""",
)
def filtered_search_report(spark: SparkSession, sf: str) -> DataFrame:
    """Tree leaves, facts, margins for the target, search, recall: the target is met, every series
    is accounted for once a query, and filters prune what bounds do not."""
    q, index = feeds.search_queries(spark, sf), feeds.tree_index(spark, sf)
    active = _active_filters(spark, sf, TARGET_RECALL, TARGET_COVERAGE)
    truth = P.knn_exact(feeds.series(spark, sf), q, 1)
    out = filtered_report(index, q, active, truth, TARGET_RECALL, TARGET_COVERAGE)
    pruned = F.col("visited_series") / (1 - F.col("pruned_ratio"))
    return out.select(
        "n_queries", "n_batches", F.round(pruned).cast("long").alias("n_series"),
        "recall_passed", "coverage_passed", (F.col("filter_ratio") > 0).alias("prunes"),
    )


@register(
    "knn_residence",
    f"WITH {EXACT} SELECT query_id, leaf_id, count(*) AS n FROM exact GROUP BY 1, 2",
)
def residence(spark: SparkSession, sf: str) -> DataFrame:
    return knn_residence(_exact(spark, sf))


@register(
    "residence_share",
    f"""WITH {EXACT} SELECT query_id, leaf_id, round(count(*) / {K}::DOUBLE, 4) AS share
    FROM exact GROUP BY 1, 2""",
)
def residence_shares(spark: SparkSession, sf: str) -> DataFrame:
    return residence_share(knn_residence(_exact(spark, sf)), K).select(
        "query_id", "leaf_id", F.round("share", 4).alias("share")
    )


@register(
    "kth_before_visit",
    f"""WITH {SERIES}, {SEARCH}, {SEGMENT_ROWS}, {ENVELOPE}, {bounds('search')}, {distances('search')},
    walk AS (
      SELECT l.query_id, leaf_id,
             row_number() OVER (PARTITION BY l.query_id
                                ORDER BY leaf_id = source_leaf DESC, lb, leaf_id) AS step
      FROM search_lb l JOIN search q ON q.query_id = l.query_id),
    seen AS (
      SELECT w.query_id, w.leaf_id, d.dist,
             row_number() OVER (PARTITION BY w.query_id, w.leaf_id ORDER BY d.dist) AS r
      FROM walk w JOIN walk b ON b.query_id = w.query_id AND b.step < w.step
      JOIN search_dist d ON d.query_id = b.query_id AND d.leaf_id = b.leaf_id)
    SELECT w.query_id, w.leaf_id, round(s.dist, 4) AS bsf FROM walk w
    LEFT JOIN seen s ON s.query_id = w.query_id AND s.leaf_id = w.leaf_id AND s.r = 3""",
)
def kth_before_visit(spark: SparkSession, sf: str) -> DataFrame:
    """The third best distance over the leaves visited before each leaf."""
    q, index = feeds.search_queries(spark, sf), feeds.keyed_index(spark, sf)
    home = feeds.home(q).withColumnRenamed("leaf_id", "home")
    facts = leaf_bounds(q, index.leaf).join(home, "query_id").withColumn(
        "is_resident", F.col("leaf_id") == F.col("home")
    )
    out = with_kth_before_visit(facts, leaf_top_k(index.clustered_members(), q, 3), 3)
    return out.select("query_id", "leaf_id", F.round("bsf", 4).alias("bsf"))
