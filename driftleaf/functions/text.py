"""The few string expressions: model settings, arrays as text, ids in file names."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_model_setting(setting: Column) -> Column:
    """``v0_mlp_3_256_f`` as a struct; settings of another version or model take the defaults."""
    parts = F.filter(F.split(setting, "_"), lambda t: t != "")
    known = (
        (F.size(parts) >= 5)
        & (F.substring(F.get(parts, F.lit(0)), 2, 1) == "0")
        & (F.get(parts, F.lit(1)) == "mlp")
    )
    layers = F.expr("cast(null as int)")
    return F.struct(
        F.lit("mlp").alias("model_type"),
        F.coalesce(
            F.when(known, F.get(parts, F.lit(2)).try_cast("int")).otherwise(layers), F.lit(2)
        ).alias("n_layers"),
        F.coalesce(
            F.when(known, F.get(parts, F.lit(3)).try_cast("int")).otherwise(layers), F.lit(256)
        ).alias("layer_size"),
        F.coalesce(
            F.when(known, F.get(parts, F.lit(4)) == "t"), F.lit(False)
        ).alias("has_skip"),
    )


def array_to_text(values: Column) -> Column:
    """Elements with six decimals, joined by a blank. As C's ``%.6f`` does, the exact value is rounded, a
    tie to the even digit, and a NaN keeps its sign; Java rounds its shortest decimal, halves up. Null
    elements are left out; an array of nulls alone is null, an empty one an empty text."""

    def fixed(x: float) -> str:
        return ("-" if x != x and math.copysign(1.0, x) < 0 else "") + "%.6f" % x

    @F.arrow_udf("string")
    def text(arrays: pa.Array) -> pa.Array:
        out = []
        for array in arrays:
            given = array.values if array.is_valid else pa.nulls(1)
            kept = given.drop_null().to_pylist()
            out.append(" ".join(map(fixed, kept)) if kept or not len(given) else None)
        return pa.array(out, pa.string())

    return text(values)


def filter_id_from_path(path: Column) -> Column:
    """The last number in a file name such as ``filter_17_data.csv``."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_extract(name, r"(\d+)\D*$", 1).try_cast("long")
