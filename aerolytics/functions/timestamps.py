"""The five timestamp formats of a recording, as expressions that never raise.

A cell matches the shape of at most one format (they differ in separators
and in the fraction), so parsing is: classify the shape once (``rlike``,
first match), cut the cell into digit tokens with ``translate`` + a one-char
``split`` (no regex), check the field ranges and build the value with
integer arithmetic. Formats without a year land in 1900; day-of-year 366 of
1900 rolls into 1901, seconds 60 and 61 roll into the next minute. Fractions
keep microseconds (digits 7-9 are cut).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The formats, in the order they are tried.
TS_FORMATS = [
    "%j:%H:%M:%S.%f",
    "%Y-%m-%d %H:%M:%S.%f",
    "%Y-%m-%d %H:%M:%S",
    "%H:%M:%S.%f",
    "%H:%M:%S",
]

# The text shape each format accepts (fields of 1-2 digits,
# day of year 1-3, year 4; fraction 1-9 digits, or any length after a date).
SHAPES = [
    r"^[0-9]{1,3}:[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}\.[0-9]{1,9}$",
    r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} +[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}\.[0-9]*$",
    r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} +[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$",
    r"^[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}\.[0-9]{1,9}$",
    r"^[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$",
]

# The range a nanosecond timestamp can hold.
TS_RANGE = ("1677-09-21 00:12:43.145225", "2262-04-11 23:47:16.854775")


def timestamp_shape(c: Column) -> Column:
    """Index of the format whose shape the cell has, or NULL."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(SHAPES))):
        out = F.when(c.rlike(SHAPES[i]), F.lit(i)).otherwise(out)
    return out


def timestamp_tokens(c: Column) -> Column:
    """Digit runs of a cell: separators '-', ' ', '.', ':' -> one array."""
    return F.array_remove(F.split(F.translate(c, "- .", ":::"), ":", -1), "")


def timestamp_from_tokens(tokens: Column, shape: Column) -> Column:
    """TIMESTAMP_NTZ from the tokens of a cell of the given shape, NULL when a
    field is out of range or the date does not exist.

    One expression for all shapes, a day and a clock that begins at some token:
    with a branch for each the generated method passes the 8,000 bytes up to
    which the JVM compiles it.
    """
    def t(i):
        return F.get(tokens, i).cast("long")

    at = F.when(shape == 0, F.lit(1)).when(shape.isin(1, 2), F.lit(3)).otherwise(F.lit(0))
    h, m, s = t(at), t(at + 1), t(at + 2)
    us = F.coalesce(F.rpad(F.substring(F.get(tokens, at + 3), 1, 6), 6, "0").cast("long"), F.lit(0))
    clock = F.when((h <= 23) & (m <= 59) & (s <= 61), (h * 3600 + m * 60 + s) * 1_000_000 + us)
    # Day of year or time of day count from 1900; day 0 or 367 gives no time.
    base_1900 = F.expr("TIMESTAMP_NTZ'1900-01-01 00:00:00'")
    date = F.try_make_timestamp_ntz(t(F.lit(0)).cast("int"), t(F.lit(1)).cast("int"), t(F.lit(2)).cast("int"), F.lit(0), F.lit(0), F.lit(0))
    day = F.when(shape.isin(1, 2), date).otherwise(base_1900)
    days = F.when(shape == 0, t(F.lit(0)) - 1).otherwise(F.lit(0))
    value = F.timestamp_add("MICROSECOND", F.when(days.between(0, 365), days * 86_400_000_000 + clock), day)
    return F.when(value.between(F.expr(f"TIMESTAMP_NTZ'{TS_RANGE[0]}'"), F.expr(f"TIMESTAMP_NTZ'{TS_RANGE[1]}'")), value)


def with_timestamp(df: DataFrame, cell: str, shape_col: str = "ts_shape", ts_col: str = "ts_any") -> DataFrame:
    """Add the cell's format shape and its parsed value, in two steps so the
    shape test and the tokenisation run once per row."""
    d = df.withColumn(shape_col, timestamp_shape(F.col(cell)))
    d = d.withColumn("_ts_tok", F.when(F.col(shape_col).isNotNull(), timestamp_tokens(F.col(cell))))
    return d.withColumn(ts_col, timestamp_from_tokens(F.col("_ts_tok"), F.col(shape_col))).drop("_ts_tok")


def with_timestamp_of(df: DataFrame, cell: str, fmt: str, ts_col: str) -> DataFrame:
    """Add the value of a cell that has the format of index column ``fmt``, NULL otherwise.

    Only that format's shape is tested: a cell has the shape of at most one.
    """
    test = F.lit(False)
    for i in reversed(range(len(SHAPES))):
        test = F.when(F.col(fmt) == i, F.col(cell).rlike(SHAPES[i])).otherwise(test)
    d = df.withColumn("_ts_tok", F.when(test, timestamp_tokens(F.col(cell))))
    return d.withColumn(ts_col, timestamp_from_tokens(F.col("_ts_tok"), F.col(fmt))).drop("_ts_tok")


def parse_timestamp(c: Column, fmt: int) -> Column:
    """Parse a stripped cell with format number ``fmt`` (0-based index in TS_FORMATS)."""
    if not 0 <= fmt < len(TS_FORMATS):
        raise ValueError(f"unknown timestamp format {fmt}")
    shape = F.when(c.rlike(SHAPES[fmt]), F.lit(fmt))
    return F.when(shape.isNotNull(), timestamp_from_tokens(timestamp_tokens(c), shape))
