"""Rounding rules that Spark's ``round``/``bround`` do not reproduce.

Both work on plain IEEE doubles, so a result does not depend on the engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLITTER = 134217729.0  # 2**27 + 1


def scaled_round(x: Column, digits: int) -> Column:
    """Half-even on the scaled value, as array libraries round: ``rint(x * 10**d) / 10**d``."""
    scale = float(10**digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def exact_round(x: Column, digits: int) -> Column:
    """Half-even on the exact binary value, as Python's ``round`` on a float.

    ``x * 10**d`` itself is rounded, so a value just off a tie can look like one.  The
    error of that product is recovered exactly (Dekker's split) and decides such cases.
    """
    scale = F.lit(float(10**digits))
    x = x.cast("double")
    product = x * scale
    shifted = x * F.lit(_SPLITTER)
    high = shifted - (shifted - x)
    error = (high * scale - product) + (x - high) * scale
    floor = F.floor(product).cast("double")
    fraction = product - floor
    even = F.pmod(floor, F.lit(2.0)) == 0.0
    go_down = (
        (fraction < 0.5)
        | ((fraction == 0.5) & (error < 0.0))
        | ((fraction == 0.5) & (error == 0.0) & even)
    )
    return F.when(go_down, floor).otherwise(floor + F.lit(1.0)) / scale
