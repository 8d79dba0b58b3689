"""String expressions for header and cell handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes: every code point below U+3001
# for which str.isspace() holds (the highest is U+3000).
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())

# Units that are not appended to a parameter name.
SILENT_UNITS = ["EU", "", "N/A", "-"]
# Fixed value: the word removed from the front of a parameter name.
DESCRIPTION_WORD = "Description"
TIMESTAMP_COLUMN = "Timestamp"
ELAPSED_COLUMN = "Elapsed Time (s)"


def py_strip(c: Column) -> Column:
    """Strip leading and trailing whitespace the way Python's str.strip() does."""
    return F.btrim(c, F.lit(PY_WHITESPACE))


def split_cells(line: Column) -> Column:
    """Split a line on every comma (no quoting) and strip each cell."""
    return F.transform(F.split(line, ",", -1), py_strip)


def column_name(name: Column, unit: Column, position: Column) -> Column:
    """Column name of one header position.

    Position 0 is always the timestamp. Otherwise the stripped name, with every
    occurrence of the description word removed when it starts the name, and
    `` (unit)`` appended unless the unit is a silent one.
    """
    p = py_strip(name)
    u = py_strip(unit)
    p = F.when(p.startswith(DESCRIPTION_WORD),
               py_strip(F.replace(p, F.lit(DESCRIPTION_WORD), F.lit("")))).otherwise(p)
    named = F.when(u.isin(SILENT_UNITS), p).otherwise(F.concat(p, F.lit(" ("), u, F.lit(")")))
    return F.when(position == 0, F.lit(TIMESTAMP_COLUMN)).otherwise(named)
