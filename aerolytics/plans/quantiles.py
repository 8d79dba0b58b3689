"""Exact quantiles per group without holding a group in one task.

Spark's ``percentile`` keeps one count per distinct value of a group; a large
recording with continuous values would put billions of entries in one task.
Here a mergeable rank sketch brackets every wanted rank first:

1. per group one aggregate: n, min, max and ``rank_brackets``, the values a
   Greenwald-Khanna sketch (``percentile_approx``) puts a little under and a
   little over each quantile. The sketch errs by at most n / ``ACCURACY`` ranks;
2. the ranks linear interpolation needs (floor of q * (n - 1) and the next);
3. a second scan counts values by their place among the brackets and keeps the
   value itself only inside one (under a hundredth of the rows, equal values
   counted before the shuffle); running counts give the value at each rank.
   A rank that its bracket misses is found, and goes the way of step 5;
4. a group of at most ``SKETCH_ROWS`` values is ranked by a window;
5. a group of more than ``SKETCH_GROWTH`` x ``FINAL_ROWS`` values, whose
   brackets hold more than a task should: histogram refinement. The values of
   each open search interval are counted in ``BUCKETS`` buckets (an aggregate
   keyed by group, target and bucket, partial before the shuffle), and every
   target narrows to the bucket that holds its rank, tightened to the bucket's
   own min and max, until that holds one distinct value or at most
   ``FINAL_ROWS`` rows, which a window finishes;
6. interpolate like NumPy / pandas ("linear").

Every table besides the values is (groups x targets) or (groups x targets x
buckets); all stay distributed and are checkpointed between rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolytics.session import join_small, materialize_counted

BUCKETS = 4096
FINAL_ROWS = 1 << 20
#: Rank error of the sketch (as a share of n: 1 / ACCURACY), and half the width of a bracket.
ACCURACY = 10_000
SPREAD = 0.001
#: Groups up to this size need no sketch; beyond so many times FINAL_ROWS brackets hold too much.
SKETCH_ROWS = 1 << 12
SKETCH_GROWTH = 128


def rank_brackets(value: Column, probs: Sequence[float]) -> Column:
    """Aggregate: for each quantile a value under and a value over its rank, one array."""
    ends = [min(1.0, max(0.0, q + d)) for q in probs for d in (-SPREAD, SPREAD)]
    return F.percentile_approx(value, ends, ACCURACY)


def _in_brackets(v: DataFrame, groups: DataFrame, n_groups: int, ranks: DataFrame, keys: list[str],
                 n_probs: int) -> DataFrame:
    """(keys..., r, x) of the ranks whose value lies in a bracket of its group."""
    ends = groups.select(*keys, *[F.col("_br")[2 * i + k].alias(f"_{side}{i}") for i in range(n_probs)
                                  for k, side in enumerate(("l", "h"))])
    j = join_small(v, ends, keys, n_rows=n_groups)
    inside = F.lit(False)
    slot = F.lit(0)
    for i in range(n_probs):
        inside = inside | ((F.col("_v") >= F.col(f"_l{i}")) & (F.col("_v") <= F.col(f"_h{i}")))
        slot = slot + (F.col("_v") > F.col(f"_h{i}")).cast("int")
    # Of the rows with a slot, those between brackets (without a value) lie under those inside the next one.
    counts = (j.select(*keys, slot.alias("_slot"), F.when(inside, F.col("_v")).alias("x"))
              .groupBy(*keys, "_slot", "x").agg(F.count(F.lit(1)).alias("cnt")))
    w = (Window.partitionBy(*keys).orderBy("_slot", F.col("x").asc_nulls_first())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    upto = counts.withColumn("upto", F.sum("cnt").over(w)).filter(F.col("x").isNotNull())
    want = ranks.groupBy(*keys).agg(F.collect_set("r").alias("_want"))  # at most 2 * len(probs) ranks
    hit = join_small(upto, want, keys, n_rows=n_groups * n_probs)
    mine = F.filter("_want", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("cnt")))
    return hit.select(*keys, F.explode(mine).alias("r"), "x")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    stats: tuple[DataFrame, int] | None = None, final_rows: int | None = None) -> DataFrame:
    """(keys..., q_index, quantile) for every group with at least one value.

    Linear interpolation between the order statistics at floor(q * (n - 1))
    and the next one, exactly as NumPy / pandas compute it. ``stats`` may give
    a stored (keys..., _n, _lo, _hi, _br) table of the groups with its row count,
    when the caller has already aggregated them (saves one scan); ``_br`` is
    ``rank_brackets`` for the same ``probs``.
    """
    keys, final = list(keys), FINAL_ROWS if final_rows is None else final_rows
    direct, most = min(final, SKETCH_ROWS), final * SKETCH_GROWTH
    v = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    if stats is None:
        stats = materialize_counted(v.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
            rank_brackets(F.col("_v"), probs).alias("_br")))
    stats, n_stats = stats
    stats = stats.filter(F.col("_n") > 0)
    size = F.col("_n")
    n_direct, n_sketch, n_large = stats.agg(F.count_if(size <= direct), F.count_if((size > direct) & (size <= most)),
                                            F.count_if((size > direct) & (size > most))).first()
    qs = F.array(*[F.struct(F.lit(i).alias("qi"), F.lit(float(q)).alias("q")) for i, q in enumerate(probs)])
    pos = stats.select(*keys, "_n", "_lo", "_hi", F.explode(qs).alias("p")).select(
        *keys, "_n", "_lo", "_hi", F.col("p.qi").alias("qi"),
        (F.col("p.q") * (F.col("_n") - 1).cast("double")).alias("pos"))
    # as NumPy's "linear" method: the next order statistic is always floor + 1
    # (clipped to the last), so an infinite neighbour gives NaN as in pandas
    pos = (pos.withColumn("r_lo", F.floor("pos").cast("long"))
           .withColumn("r_hi", F.least(F.col("r_lo") + 1, F.col("_n") - 1)))
    ranks = (pos.select(*keys, "_n", "_lo", "_hi",
                        F.explode(F.array_distinct(F.array("r_lo", "r_hi"))).alias("r")).distinct())
    found = []
    if n_direct:  # one window per group
        wanted = (ranks.filter(size <= direct).groupBy(*keys).agg(F.collect_set("r").alias("_want")))
        vs = join_small(v, wanted, keys, n_rows=n_direct * len(probs))
        wr = Window.partitionBy(*keys).orderBy("_v")
        found.append(vs.withColumn("r", (F.row_number().over(wr) - 1).cast("long"))
                     .filter(F.array_contains(F.col("_want"), F.col("r"))).select(*keys, "r", F.col("_v").alias("x")))
    open_ranks = ranks.filter((size > direct) & (size > most))
    if n_sketch:
        mid = (size > direct) & (size <= most)
        bracketed, n_found = materialize_counted(
            _in_brackets(v, stats.filter(mid), n_sketch, ranks.filter(mid), keys, len(probs)))
        found.append(bracketed)
        missed = ranks.filter(mid).join(bracketed.select(*keys, "r"), [*keys, "r"], "left_anti")
        if n_found < ranks.filter(mid).count():  # reads stored tables
            n_large += 1
            open_ranks = open_ranks.unionByName(missed)
    # large groups: refinement; open targets hold rank r in [a, b], c = values below a
    targets = open_ranks.select(
        *keys, "r", F.col("_lo").alias("a"), F.col("_hi").alias("b"), F.lit(0).cast("long").alias("c"))
    # The ends of an interval fall into different buckets, so every round narrows
    # every open interval and the loop ends; no target is given up.
    while n_large:
        targets, n_open = materialize_counted(targets)
        solved = targets.filter(F.col("a") == F.col("b")).select(*keys, "r", F.col("a").alias("x"))
        found.append(solved)
        open_t = targets.filter(F.col("a") < F.col("b"))
        n_open = open_t.count()  # reads the stored table
        if n_open == 0:
            break
        j = join_small(v, open_t, keys, n_rows=n_open).filter((F.col("_v") >= F.col("a")) & (F.col("_v") <= F.col("b")))
        width = F.col("b") - F.col("a")
        finite = ~F.isnan(width) & (F.abs(width) != F.lit(float("inf")))
        # Over several powers of two the buckets are equal on a signed log scale.
        scale = _signed_log("b") - _signed_log("a")
        wide = (F.abs("a") != F.lit(float("inf"))) & (F.abs("b") != F.lit(float("inf"))) & ~F.isnan("b") & (scale > 2)
        part = F.when(wide, (_signed_log("_v") - _signed_log("a")) / scale).when(finite, (F.col("_v") - F.col("a")) / width)
        bucket = (F.when(F.col("_v") == F.col("a"), F.lit(0)).when(F.col("_v") == F.col("b"), F.lit(BUCKETS - 1))
                  .when(part.isNotNull(), F.greatest(F.lit(0), F.least(F.floor(part * BUCKETS), F.lit(BUCKETS - 1))))
                  .otherwise(F.lit(BUCKETS // 2)).cast("int"))
        hist = j.groupBy(*keys, "r", "a", "b", "c", bucket.alias("_bucket")).agg(
            F.count(F.lit(1)).alias("cnt"), F.min("_v").alias("kmin"), F.max("_v").alias("kmax"))
        w = (Window.partitionBy(*keys, "r").orderBy("_bucket")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        hist = hist.withColumn("upto", F.col("c") + F.sum("cnt").over(w))
        hit = hist.filter((F.col("upto") - F.col("cnt") <= F.col("r")) & (F.col("r") < F.col("upto")))
        nxt = hit.select(*keys, "r", F.col("kmin").alias("a"), F.col("kmax").alias("b"),
                         (F.col("upto") - F.col("cnt")).alias("c"), "cnt")
        nxt, n_next = materialize_counted(nxt)
        small = nxt.filter((F.col("cnt") <= final) & (F.col("a") < F.col("b")))
        # finish bounded buckets exactly: sort at most final values per target
        fin = join_small(v, small.drop("cnt"), keys, n_rows=n_next).filter(
            (F.col("_v") >= F.col("a")) & (F.col("_v") <= F.col("b")))
        wt = Window.partitionBy(*keys, "r").orderBy("_v")
        fin = (fin.withColumn("_i", F.row_number().over(wt) - 1 + F.col("c"))
               .filter(F.col("_i") == F.col("r")).select(*keys, "r", F.col("_v").alias("x")))
        found.append(fin)
        targets = nxt.filter((F.col("cnt") > final) | (F.col("a") == F.col("b"))).drop("cnt")
    # at most 2 * len(probs) ranks per group: one small map, read once
    done = found[0] if found else ranks.select(*keys, "r", F.col("_lo").alias("x")).limit(0)
    for more in found[1:]:
        done = done.unionByName(more)
    found = done.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("r", "x"))).alias("_at"))
    out = (pos.join(found, keys)
           .withColumn("x_lo", F.element_at("_at", F.col("r_lo")))
           .withColumn("x_hi", F.element_at("_at", F.col("r_hi"))))
    t = F.col("pos") - F.col("r_lo").cast("double")
    lerp = F.when(t >= 0.5, F.col("x_hi") - (F.col("x_hi") - F.col("x_lo")) * (1 - t)).otherwise(
        F.col("x_lo") + (F.col("x_hi") - F.col("x_lo")) * t)
    return out.select(*keys, F.col("qi").alias("q_index"), lerp.alias("quantile"))


def _signed_log(c: str):
    """Non-decreasing map of the finite doubles to -2099..2099: log2 of the size, mirrored for negatives."""
    v = F.col(c)
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.log2(F.abs(v)) + 1075.0))


def quantile_columns(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                     names: Sequence[str], stats: tuple[DataFrame, int] | None = None,
                     final_rows: int | None = None) -> DataFrame:
    """``exact_quantiles`` pivoted to one column per probability (``names``)."""
    q = exact_quantiles(df, keys, value, probs, stats, final_rows)
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("q_index") == i, F.col("quantile"))).alias(nm)
                                  for i, nm in enumerate(names)])
