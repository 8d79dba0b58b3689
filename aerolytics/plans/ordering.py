"""File-order helpers that never put a whole flight into one task.

A window partitioned by flight alone would sort one recording in one task; a
recording may hold a third of all data. Both helpers here cut the order into
bounded blocks, work inside a block with a window partitioned by
``(keys, block)``, and stitch blocks together through a small per-block table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolytics.session import join_small, materialize

ROW_BLOCK_BITS = 16  # 65,536 rows per block for dense row numbers


def dense_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                     block: Column, out: str = "row_no", counted: Column | None = None) -> DataFrame:
    """Add ``out`` = 0-based position of each row within ``keys`` by ``order``.

    ``block`` must be monotone in ``order`` within a key (e.g. line_no >> 16);
    it bounds how many rows one window task sorts. Block offsets come from a
    per-(key, block) count table, prefix-summed over blocks.

    ``counted`` (boolean): only those rows are numbered (others get the number
    the next counted row would get) - the caller filters afterwards. The
    filter then sits above the window, so the optimizer cannot push it down
    into (and duplicate) the expressions that compute ``counted``.
    """
    keys = list(keys)
    one = F.lit(1) if counted is None else F.when(counted, F.lit(1)).otherwise(F.lit(0))
    d = df.withColumn("_dr_blk", block).withColumn("_dr_one", one)
    counts = d.groupBy(*keys, "_dr_blk").agg(F.sum("_dr_one").alias("_dr_n"))
    before = Window.partitionBy(*keys).orderBy("_dr_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_dr_blk",
                            F.coalesce(F.sum("_dr_n").over(before), F.lit(0)).alias("_dr_off"))
    inner = (Window.partitionBy(*keys, "_dr_blk").orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("_dr_r", F.sum("_dr_one").over(inner) - F.col("_dr_one"))
    return (d.join(offsets, [*keys, "_dr_blk"])
            .withColumn(out, (F.col("_dr_off") + F.col("_dr_r")).cast("long"))
            .drop("_dr_blk", "_dr_off", "_dr_r", "_dr_one"))


def range_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "row_no",
                     block_rows: int = 1 << ROW_BLOCK_BITS, stored: Mapping[str, Column] | None = None) -> DataFrame:
    """Stored ``df`` in order, with ``out`` = 0-based position of each row within ``keys`` by ``order``.

    Blocks of equal depth: the rows are cut where a sample of their keys and
    order says, into as many ranges as they have ``block_rows``, so neither a
    burst in the order nor a long key fills a task. A range's rows are numbered
    as they lie; a table of one row per range and key gives each its offset.
    ``order`` should have no ties, which a range cannot part. With ``stored`` only the
    keys and those columns are stored, computed once the rows lie in their range: the
    runs that count, sample and deal the rows do not compute them.
    """
    keys, order = list(keys), list(order)
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // block_rows))
    # Stored, because a second run may sample and cut elsewhere.
    rows = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    if stored is not None:
        rows = rows.select(*keys, *[c.alias(name) for name, c in stored.items()])
    rows = materialize(rows.withColumn("_rn_id", F.monotonically_increasing_id()))
    rows = rows.withColumn("_rn_part", F.shiftright("_rn_id", 33))
    per = rows.groupBy(*keys, "_rn_part").agg(F.min("_rn_id").alias("_rn_first"), F.count(F.lit(1)).alias("_rn_n"))
    before = Window.partitionBy(*keys).orderBy("_rn_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_rn_part", (F.coalesce(F.sum("_rn_n").over(before), F.lit(0)) - F.col("_rn_first")).alias("_rn_shift"))
    return (join_small(rows, per, [*keys, "_rn_part"]).withColumn(out, F.col("_rn_id") + F.col("_rn_shift"))
            .drop("_rn_id", "_rn_part", "_rn_shift"))


def keep_not_null(df: DataFrame, col: str) -> DataFrame:
    """Keep the rows where ``col`` is not NULL, evaluating ``col`` once.

    A plain ``filter`` on a computed column is pushed below the projections
    that compute it, and the optimizer then inlines the whole expression chain
    into the pushed predicate (and into join conditions), once per reference.
    Here the value passes through a one-element ``explode_outer``; a predicate
    on a generator's output is never pushed below the generator.
    """
    fenced = "_kept_" + col
    return (df.withColumn(fenced, F.explode_outer(F.array(F.col(col))))
            .filter(F.col(fenced).isNotNull())
            .drop(col).withColumnRenamed(fenced, col))


def previous_values(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
                    row_col: str = "row_no", bits: int = ROW_BLOCK_BITS,
                    prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<col>`` = value of ``col`` on row ``row_no - 1`` of the same key.

    ``row_no`` must be dense from 0. Inside a block ``lag`` does the work; the
    first row of a block takes the last row of the previous block from a small
    per-block table.
    """
    keys = list(keys)
    blk = F.shiftright(F.col(row_col), bits)
    d = df.withColumn("_dr_blk", blk)
    w = Window.partitionBy(*keys, "_dr_blk").orderBy(row_col)
    for c in cols:
        d = d.withColumn("_lag_" + c, F.lag(c).over(w))
    tails = (df.withColumn("_dr_blk", blk).groupBy(*keys, "_dr_blk")
             .agg(*[F.max_by(c, row_col).alias("_tail_" + c) for c in cols])
             .withColumn("_dr_blk", F.col("_dr_blk") + 1))
    d = d.join(tails, [*keys, "_dr_blk"], "left")
    first_in_block = (F.col(row_col) == F.shiftleft(F.col("_dr_blk"), bits))
    for c in cols:
        d = d.withColumn(prefix + c, F.when(first_in_block, F.col("_tail_" + c))
                         .otherwise(F.col("_lag_" + c)))
    return d.drop("_dr_blk", *["_lag_" + c for c in cols], *["_tail_" + c for c in cols])
