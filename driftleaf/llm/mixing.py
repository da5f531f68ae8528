"""Mixing sources to target weights with hash thresholds.

Each source gets a target of words; a document is taken once if its hash lies below the first
threshold of its source and twice if below the second one, which is nested in the first. Thresholds
come from histograms: words are summed by source and leading hash bits, the running sum finds the
bucket in which the budget ends, and only that bucket is cut again by the next bits until it holds
one hash. Nothing is sorted.

Targets: sources by code point, null last, get the weights in turn, and share ``share`` of all words
by weight; a target stops at ``repeats`` times the source's words and the excess goes to the others
by weight until none is above. That is one level for all open sources, found from running sums.

Defined cases: null or blank text has no words and is never taken; a null source is a source of its
own; rows with the same ``doc_id`` and text share a hash and are taken alike, so a threshold cannot part
them; a null ``doc_id`` counts as an id like others; an empty table gives no row; ``mix`` ignores other
columns and ``mixed_documents`` keeps them, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftleaf.session import materialise

WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
BITS, HASH_BITS = 10, 60


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")
    gaps = F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit("")))
    outer = F.startswith(trimmed, F.lit(" ")).cast("int") + F.endswith(trimmed, F.lit(" ")).cast("int")
    return F.when(trimmed.isin("", " "), 0).otherwise(gaps + 1 - outer).cast("long")


def doc_hash() -> Column:
    """The first ``HASH_BITS`` bits of the MD5 of the id and the text's own MD5."""
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), text)
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_key() -> Column:
    return F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source"))


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, repeats=REPEATS) -> DataFrame:
    """(key, source_size, target) from (key, source, size); one small row a source."""
    per_source = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights)).cast("int") + 1)
    order = [F.col("source_size") / F.col("weight"), F.asc_nulls_last("source")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onwards = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = (
        per_source.withColumn("weight", weight)
        .withColumn("full", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * repeats)
        .withColumn("open", F.sum("weight").over(onwards))
        .withColumn("level", (F.sum("source_size").over(Window.partitionBy()) * share - F.col("full")) / F.col("open"))
        .withColumn("cap", (F.col("source_size") * repeats).cast("double"))
    )
    # the level of the first source that stays below its cap holds for it and all after it
    below = F.when(F.col("weight") * F.col("level") <= F.col("cap"), F.col("level"))
    reached = F.first(below, ignorenulls=True).over(
        Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return rows.select(
        "key", "source", "source_size",
        F.coalesce(F.least("cap", F.col("weight") * reached), F.col("cap")).alias("target"),
    )


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """(key, once, twice, source_size, target): hashes below ``once`` are taken, below ``twice`` again."""
    spark = sizes.sparkSession
    filled = F.col("target") >= F.col("source_size")
    left = materialise(
        goals.withColumn("rest", F.when(filled, F.col("target") - F.col("source_size")).otherwise(F.col("target")))
        .withColumn("prefix", F.lit(0).cast("long")),
        "mix_goals",
    )
    done = None
    for used in range(0, HASH_BITS, BITS):
        down = HASH_BITS - used - BITS
        inside = sizes.join(left.select("key", "prefix", "rest"), "key").where(
            (F.col("size") > 0) & (F.shiftright("hash", HASH_BITS - used) == F.col("prefix"))
        )
        histogram = inside.groupBy("key", F.shiftright("hash", down).alias("bucket")).agg(
            F.sum("size").alias("words"), F.first("rest").alias("rest"),
            F.min("hash").alias("lowest"), F.max("hash").alias("highest"),
        )
        upto = Window.partitionBy("key").orderBy("bucket")
        summed = histogram.withColumn("until", F.sum("words").over(upto))
        boundary = (
            summed.where(F.col("until") > F.col("rest"))
            .groupBy("key")
            .agg(F.min_by(F.struct("bucket", "words", "until", "lowest", "highest"), "bucket").alias("at"))
        )
        step = materialise(
            left.join(boundary, "key", "left").withColumn(
                "rest", F.coalesce(F.col("rest") - F.col("at.until") + F.col("at.words"), F.col("rest"))
            ),
            "mix_step",
        )
        whole = F.col("at").isNull() | (F.col("at.lowest") == F.col("at.highest")) | F.lit(down == 0)
        nearer = F.col("at.words") - F.col("rest") < F.col("rest")
        cut = (
            F.when(F.col("at").isNull() & (F.col("rest") > 0), F.lit(1 << HASH_BITS).cast("long"))
            .when(F.col("at").isNull(), F.lit(0).cast("long"))
            .otherwise(F.col("at.lowest") + F.when(nearer, 1).otherwise(0))
        )
        ended = step.where(whole).select("key", "source_size", "target", cut.alias("cut"))
        done = ended if done is None else done.unionByName(ended)
        left = step.where(~whole).select(
            "key", "source", "source_size", "target", "rest", F.col("at.bucket").alias("prefix")
        )
        if left.isEmpty():
            break
    everything = F.lit(1 << HASH_BITS).cast("long")
    return done.select(
        "key", "source_size", "target",
        F.when(filled, everything).otherwise(F.col("cut")).alias("once"),
        F.when(filled, F.col("cut")).otherwise(F.lit(0).cast("long")).alias("twice"),
    )


def plan_mix(documents: DataFrame, weights=WEIGHTS, share=SHARE, repeats=REPEATS) -> tuple[DataFrame, DataFrame]:
    """The written sizes (doc_id, key, source, size, hash) and thresholds of the mix; the texts are read
    once. ``repeats`` is 2: two nested thresholds."""
    if repeats != 2:
        raise ValueError("two nested thresholds serve exactly two repeats")
    size = word_count(F.col("text")).alias("size")
    sizes = materialise(
        documents.select("doc_id", source_key().alias("key"), "source", size, doc_hash().alias("hash")), "mix_sizes"
    )
    return sizes, materialise(thresholds(sizes, targets(sizes, weights, share, repeats)), "mix_cuts")


def times_taken(hashed: Column) -> Column:
    return (hashed < F.col("once")).cast("int") + (hashed < F.col("twice")).cast("int")


def mix(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row a document."""
    sizes, cuts = plan_mix(documents, **options)
    return sizes.join(cuts, "key").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * times_taken(F.col("hash"))).alias("taken")
    )


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The rows of ``documents``, each as often as the mix takes it; those without words are not taken."""
    _, cuts = plan_mix(documents, **options)
    cuts = cuts.select(F.col("key").alias("_key"), "once", "twice")
    row = F.struct(*[F.col(c) for c in documents.columns]).alias("_row")
    plain = documents.where(F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select(
        row, source_key().alias("_key"), doc_hash().alias("_hash")
    )
    copies = plain.join(cuts, "_key").select(
        "_row", F.explode(F.array_repeat(F.lit(1), times_taken(F.col("_hash"))))
    )
    return copies.select("_row.*")


def op4_mixing(documents: DataFrame) -> DataFrame:
    return mix(documents)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'none') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS hash
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS turn FROM s
), l AS (
  SELECT *, 2 * source_size AS cap,
    ((SELECT sum(source_size) FROM s) * CAST(1.5 AS DOUBLE)
      - 2 * coalesce(sum(source_size) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM o
), t AS (
  SELECT a.source, a.source_size, coalesce(least(a.cap, a.weight * (
    SELECT arg_min(b.level, b.turn) FROM l b WHERE b.turn <= a.turn AND b.weight * b.level <= b.cap)), a.cap) AS target
  FROM l a
), g AS (
  SELECT source, source_size, target, target >= source_size AS filled,
    CASE WHEN target >= source_size THEN target - source_size ELSE target END AS rest
  FROM t
), h AS (
  SELECT source, hash, sum(size) AS words FROM d WHERE size > 0 GROUP BY source, hash
), r AS (
  SELECT source, hash, words, sum(words) OVER (PARTITION BY source ORDER BY hash) AS until FROM h
), c AS (
  SELECT g.source, arg_min(CASE WHEN until - rest < rest - until + words THEN hash + 1 ELSE hash END, hash) AS cut
  FROM g JOIN r ON g.source IS NOT DISTINCT FROM r.source WHERE until > rest GROUP BY g.source
), k AS (
  SELECT g.*, coalesce(c.cut, CASE WHEN rest > 0 THEN CAST(1152921504606846976 AS BIGINT) ELSE 0 END) AS cut
  FROM g LEFT JOIN c ON g.source IS NOT DISTINCT FROM c.source
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  size * (CASE WHEN filled THEN 1 ELSE 0 END + CASE WHEN hash < cut THEN 1 ELSE 0 END) AS taken
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source
"""
