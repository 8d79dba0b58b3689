"""Numeric expressions: the coercing number parser and moment corrections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text forms the coercing number parser accepts. Plain
# decimals with an optional sign, fraction and exponent, plus inf / infinity
# in any case. "nan" parses but is a missing value; anything else ("1d",
# "0x1A", "1_000", "True", "1,5") is not a number.
NUMBER_PATTERN = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)$"
INFINITY_PATTERN = r"^[+-]?([iI][nN][fF]([iI][nN][iI][tT][yY])?)$"


def parse_number(text: Column) -> Column:
    """Cell text -> DOUBLE, NULL when it is not a number.

    A decimal that overflows (``1e400``) is missing, an infinity only counts
    when spelled out; NaN never appears (it would sort above every number and
    poison max/avg).
    """
    plain = text.rlike(NUMBER_PATTERN)
    spelled_inf = text.rlike(INFINITY_PATTERN)
    v = text.try_cast("double")
    return (F.when(plain & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)
            .when(spelled_inf, v))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den as DOUBLE, NULL when den is 0 or NULL (never raises in ANSI mode)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def round_half_even(c: Column, digits: int) -> Column:
    """Round the way NumPy does: scale, round half to even on the double, unscale."""
    scale = float(10 ** digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def sample_skewness(v: Column) -> Column:
    """Bias-corrected skewness (G1) of an aggregate input.

    NULL for fewer than 3 values, 0 when all values are equal.
    """
    n = F.count(v).cast("double")
    g1 = F.skewness(v)
    return (F.when(n < 3, F.lit(None).cast("double"))
            .when(F.var_pop(v) == 0, F.lit(0.0))
            .otherwise(F.sqrt(n * (n - 1)) / (n - 2) * g1))


def sample_kurtosis(v: Column) -> Column:
    """Bias-corrected excess kurtosis (G2) of an aggregate input.

    NULL for fewer than 4 values, 0 when all values are equal.
    """
    n = F.count(v).cast("double")
    g2 = F.kurtosis(v)
    return (F.when(n < 4, F.lit(None).cast("double"))
            .when(F.var_pop(v) == 0, F.lit(0.0))
            .otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)))
