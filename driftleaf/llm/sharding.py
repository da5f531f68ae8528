"""Jump consistent hashing with DataFrame functions only.

A key walks through growing shard numbers, driven by a linear congruential generator; the last
number below the shard count is its shard. No ring table is kept, and with one more shard a row
stays or moves into the new one. The generator's 64-bit product is built from 32-bit halves, as
Spark's arithmetic raises an error on overflow.

Rows are numbered within their shard by (task that read them, position): first a number within
(shard, task), then an offset from the sizes of the tasks before, so no shard is gathered in one task.

Defined cases: a null key counts as 0; null text has no bytes (its size is ``overhead``) and the
checksum of the empty text; rows with the same key share a shard; an empty table gives no row;
other columns are kept by ``assign_shards``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftleaf.session import materialise

# Fixed value: the multiplier of the published generator (its increment is 1).
MULTIPLIER = 2862933555777941757
LOW = 0xFFFFFFFF


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """Halves of ``(hi, lo) * MULTIPLIER + 1`` modulo 2**64."""
    m1, m0 = MULTIPLIER >> 32, MULTIPLIER & LOW
    a, b = m0 & 0xFFFF, m0 >> 16
    times = lambda x, m: x * F.lit(m)
    low16 = lambda x: F.shiftleft(x.bitwiseAND(F.lit(0xFFFF)), 16)
    bottom = times(lo, a) + low16(times(lo, b)) + F.lit(1)
    top = (
        F.shiftright(times(lo, b), 16) + times(lo, m1) + times(hi, a) + low16(times(hi, b))
        + F.shiftright(bottom, 32)
    )
    return top.bitwiseAND(F.lit(LOW)), bottom.bitwiseAND(F.lit(LOW))


def jump_shards(key: Column, *counts: int) -> Column:
    """A struct with one int field ``s<count>`` for each shard count, all from one walk."""
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    most = max(counts)
    fields = ", ".join(f"s{n}: int" for n in counts)
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(F.lit(LOW)).alias("lo"),
        F.lit(0).cast("long").alias("at"),
        *[F.lit(0).alias(f"s{n}") for n in counts],
    ).cast(f"struct<hi: long, lo: long, at: long, {fields}>")

    def walk(state: Column, _: Column) -> Column:
        hi, lo = _step(state["hi"], state["lo"])
        draw = F.shiftright(hi, 1) + 1
        here = state["at"]
        jumped = F.floor((here + 1) * (F.lit(float(1 << 31)) / draw.cast("double")))
        moved = F.struct(
            hi.alias("hi"),
            lo.alias("lo"),
            jumped.cast("long").alias("at"),
            *[F.when(here < n, here.cast("int")).otherwise(state[f"s{n}"]).alias(f"s{n}") for n in counts],
        )
        return F.when(here >= most, state).otherwise(moved)

    steps = F.sequence(F.lit(1), F.lit(most))
    return F.aggregate(steps, start, walk, lambda s: F.struct(*[s[f"s{n}"] for n in counts]))


def assign_shards(df: DataFrame, key: str, shards: int) -> DataFrame:
    """Adds ``shard`` and ``grown_shard``, the one with one shard more."""
    walked = jump_shards(F.col(key), shards, shards + 1)
    return df.withColumn("_walk", walked).select(
        *[F.col(c) for c in df.columns if c not in ("shard", "grown_shard")],
        F.col(f"_walk.s{shards}").alias("shard"),
        F.col(f"_walk.s{shards + 1}").alias("grown_shard"),
    )


def number_slots(rows: DataFrame) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard. ``rows`` is written first: which task a row was
    read by then never changes."""
    fixed = materialise(rows.withColumn("_task", F.spark_partition_id()), "shards")
    before = Window.partitionBy("shard").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    sizes = fixed.groupBy("shard", "_task").count()
    offsets = sizes.select(
        "shard", "_task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset")
    )
    within = Window.partitionBy("shard", "_task").orderBy("doc_id", "text_crc32")
    numbered = fixed.withColumn("_place", F.row_number().over(within).cast("long") - 1)
    return (
        numbered.join(offsets, ["shard", "_task"])
        .withColumn("slot", F.col("_offset") + F.col("_place"))
        .drop("_task", "_offset", "_place")
    )


def op9_sharding(documents: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = documents.select(
        "doc_id",
        (F.octet_length(text).cast("long") + overhead).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    out = number_slots(assign_shards(narrow, "doc_id", shards))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
