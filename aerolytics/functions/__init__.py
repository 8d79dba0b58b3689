"""Column expressions (JVM-side, codegen-friendly) shared by the operators."""

from aerolytics.functions.numbers import (parse_number, round_half_even, sample_skewness,
                                          sample_kurtosis, safe_ratio)
from aerolytics.functions.text import py_strip, column_name, split_cells
from aerolytics.functions.timestamps import TS_FORMATS, parse_timestamp, with_timestamp

__all__ = ["parse_number", "round_half_even", "sample_skewness", "sample_kurtosis",
           "safe_ratio", "py_strip", "column_name", "split_cells", "TS_FORMATS",
           "parse_timestamp", "with_timestamp"]
