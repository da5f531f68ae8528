"""A corpus pipeline over ``documents``: language, near duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the
shared work folder and reads it back as the next stage's documents. All stages but the last
return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftleaf.llm import language, mixing, near_dedup, packing
from driftleaf.session import broadcast_if_small, materialise

LEAST_SCORE = 0.5


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letters, or a probability below ``LEAST_SCORE``."""
    model = language.fit(docs.where(~language.held_out()))
    said = language.predict(docs, model)
    sure = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return said.where(sure).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, with the smallest id (a null id only if no other has one). Where that
    id is null or repeated, the smallest class and text decide. Documents with an empty set are in no group;
    equal rows of them stay once."""
    found = near_dedup.near_duplicates(docs)
    ids = found.groupBy(F.col("doc_id").alias("_id")).agg(
        F.max("kept").alias("_kept"), (F.count("*") > 1).alias("_repeated")
    )
    # Fewer documents go or are repeated than stay; their ids are shipped if they fit the budget.
    others = materialise(ids.where(~F.col("_kept") | F.col("_repeated")), "other_ids")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
    once = docs.join(broadcast_if_small(others.select("_id"), "other_ids"), same, "left_anti")
    repeated = others.where("_kept").select("_id")
    if repeated.isEmpty():
        return once
    # All kept rows of a component have the same id; one of its classes stays, and one row of that class.
    kept = found.where("kept").join(repeated, same, "left_semi")
    linked = kept.where("n_shingles > 0").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").alias("_id"), F.col("class").alias("_class"))).alias("_stays")
    )
    empty = kept.where("n_shingles = 0").select(F.col("doc_id").alias("_id"), F.col("class").alias("_class"))
    stays = linked.select("_stays.*", F.lit(False).alias("_empty")).unionByName(
        empty.distinct().withColumn("_empty", F.lit(True))
    )
    rows = docs.join(repeated, same, "left_semi").select(
        F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_own"), "text",
        near_dedup.class_of(F.col("text")).alias("_of"),
    )
    chosen = rows.join(stays, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_of") == F.col("_class")))
    one = chosen.groupBy("_own", "_of", F.when(F.col("_empty"), F.col("text")).alias("_text")).agg(
        F.min_by("_row", F.coalesce("text", F.lit(""))).alias("_row")
    )
    return once.unionByName(one.select("_row.*"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their ids and their place in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("language", by_language),
    ("near_duplicates", without_near_duplicates),
    ("mix", mixed),
    ("pack", packed),
]

#: Language models, MinHash components and tokenizers can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
