"""Scalar functions on number columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column | str, digits: int) -> Column:
    """``x`` as a double, rounded in binary arithmetic: the scaled double goes to the nearest whole number, halves away from zero, and the
    sign of zero stays. The built-in function rounds the shortest decimal notation instead, and has no negative zero."""
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    scale = 10.0**digits
    y = x * scale
    near = F.rint(y)  # halves to even
    return F.when(F.abs(y) == float("inf"), x).when(F.abs(y - near) == 0.5, (y + 0.5 * F.signum(y)) / scale).otherwise(near / scale)
