"""Rounding, thresholds and fixed-decimal text, shared by every operator.

All are ``Column -> Column`` compositions of built-ins, so they stay inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_even(col, digits: int) -> Column:
    """Round a (possibly float32) value the way Python's ``round`` does on its double.

    The cast to double keeps Spark from returning a float (4.3000002); ``bround``
    is half-to-even on true ties (4.25f -> 4.2).
    """
    return F.bround(_c(col).cast("double"), digits)


def threshold_for(df: DataFrame, column: str, value: float) -> Column:
    """A literal threshold in the column's own type.

    A float32 column holding 4.6 is below the double 4.6; casting the threshold to
    FLOAT lets a stored 4.6 pass ``>= 4.6``, as the viewer's rounded doubles do.
    """
    dtype = df.schema[column].dataType
    lit = F.lit(float(value))
    return lit.cast("float") if isinstance(dtype, T.FloatType) else lit.cast(dtype)


def clamp(col, lo: float, hi: float) -> Column:
    """``max(lo, min(hi, x))`` with nulls kept null (``greatest``/``least`` would skip them)."""
    c = _c(col)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def to_fixed(col, digits: int) -> Column:
    """Number to text with ``digits`` decimals by the exact decimal value (``toFixed``).

    Halves, which only binary fractions can be, go away from zero. The product
    with 10^digits is taken in two exact parts (the value's high and low bits),
    so its rounding error never decides.
    """
    c = _c(col).cast("double")
    x = F.abs(c)
    scale = 10 ** digits
    t = x * F.lit(134217729.0)                 # 2^27 + 1 splits 53 bits in two halves
    high = t - (t - x)
    p_high, p_low = high * F.lit(float(scale)), (x - high) * F.lit(float(scale))
    product = p_high + p_low
    error = p_low - (product - p_high)         # exact: product + error is the true product
    whole_part = F.floor(product)
    up = ((product - whole_part.cast("double") - F.lit(0.5)) + error) >= 0
    scaled = whole_part.cast("long") + F.when(up, 1).otherwise(0)
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    whole = F.floor(scaled / F.lit(scale)).cast("long").cast("string")
    if digits == 0:
        text = F.concat(sign, whole)
    else:
        frac = F.lpad((scaled % F.lit(scale)).cast("string"), digits, "0")
        text = F.concat(sign, whole, F.lit("."), frac)
    return F.when(c.isNull(), F.lit(None)).otherwise(text)


def js_round(col) -> Column:
    """``Math.round``: half up toward +infinity."""
    return F.floor(_c(col).cast("double") + F.lit(0.5)).cast("long")
