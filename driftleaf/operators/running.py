"""Running sums and numbers over a whole table, without a task that sees all of it.

Rows are dealt by range of their order, so a partition holds consecutive rows and is sorted on its own. The
sums of the partitions, one row each, give every partition its start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftleaf.session import materialise


def with_running(df: DataFrame, order: list[Column], sums: dict[str, Column] | None = None, number: str | None = None) -> DataFrame:
    """Add the running sum of each column in ``sums`` up to and with the row, in ``order``, and with ``number``
    the position of the row, from 0. ``order`` has to tell rows apart."""
    wanted = dict(sums or {})
    if number is not None:
        wanted[number] = F.lit(1).cast("long")
    dealt = df.repartitionByRange(*order).withColumns({f"_of_{name}": column for name, column in wanted.items()})
    # Partition numbers only mean something for one evaluation, so it is written.
    placed = materialise(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    totals = placed.groupBy("_range").agg(*[F.sum(f"_of_{name}").alias(name) for name in wanted])
    starts, so_far = [], dict.fromkeys(wanted)
    for row in sorted(totals.collect(), key=lambda r: r["_range"]):  # a row a partition
        starts.append((row["_range"], *[so_far[name] for name in wanted]))
        for name in wanted:
            if row[name] is not None:
                so_far[name] = row[name] if so_far[name] is None else so_far[name] + row[name]
    types = {f.name: f.dataType for f in totals.schema.fields}
    schema = ", ".join(["_range int"] + [f"_start_{name} {types[name].simpleString()}" for name in wanted])
    first = df.sparkSession.createDataFrame(starts, schema)
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.join(F.broadcast(first), "_range")
    before = {number: 1} if number is not None else {}
    out = out.withColumns(
        {name: F.coalesce(f"_start_{name}", F.lit(0)) + F.sum(f"_of_{name}").over(inside) - before.get(name, 0) for name in wanted}
    )
    return out.select(*[c for c in df.columns if c not in wanted], *wanted)
