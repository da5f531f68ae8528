"""Random draws that are pure functions of their keys.

A draw hashes its keys with MD5, so it depends neither on partitioning nor on task retries, and
any SQL engine with ``md5`` can reproduce it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: thirteen hexadecimal digits fill the mantissa of a double.
HEX_DIGITS = 13
DRAW_SPAN = 16**HEX_DIGITS


def unit_draw(seed: str, *keys: Column) -> Column:
    """Uniform in [0, 1)."""
    text = F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("long") / F.lit(
        float(DRAW_SPAN)
    )


def normal_draw(seed: str, *keys: Column) -> Column:
    """Standard normal, from two uniform draws."""
    radius = F.sqrt(-2.0 * F.log(1.0 - unit_draw(f"{seed}/r", *keys)))
    return radius * F.cos(6.283185307179586 * unit_draw(f"{seed}/a", *keys))
