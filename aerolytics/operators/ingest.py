"""Ingest: recording text lines -> typed long samples.

Input ``lines(flight_id, line_no, line)``, one recording per flight_id, in
file order by line_no. Two passes over the input, each a plain scan:

1. every split of the input gives a small mergeable state (``ingest_state``):
   its lines' range per flight; per flight and cell position the count, least
   and largest timestamp of each of the five formats (position 0) and the count
   of numeric cells on rows whose timestamp parses (other positions); and the
   few lines that may be the header (the text is trimmed as a whole, so the
   header is the first non-blank line). Every per-flight decision - format,
   column names, numeric or text, refusal - is read from the merged state;
2. the typed samples: the chosen format only, rows without a timestamp
   dropped, ``row_no`` dense in file order over the kept rows. The splits'
   counts of kept rows number them where they lie. Lines that do not lie in
   file order, or come out of a shuffle and so may lie elsewhere in the second
   pass, are first sorted and stored, once; if splits or flights are too many to
   broadcast, a shuffle numbers the rows.

Flights that the reference would refuse as a whole (too few lines, no data
rows, no timestamp, a column name twice) yield no samples and an issue row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolytics.functions.numbers import parse_number, safe_ratio
from aerolytics.functions.text import (ELAPSED_COLUMN, column_name, py_strip,
                                       split_cells)
from aerolytics.functions.timestamps import TS_FORMATS, with_timestamp_of
from aerolytics.operators.ingest_state import line_state, split_state
from aerolytics.plans.ordering import ROW_BLOCK_BITS, dense_row_number, keep_not_null, previous_values
from aerolytics.plans.quantiles import quantile_columns
from aerolytics.session import materialize, materialize_counted

# Share thresholds (strictly greater than) for a timestamp format
# and for a numeric column; minimum number of lines of a recording.
TS_VALID_SHARE = 0.8
NUMERIC_VALID_SHARE = 0.8
MIN_LINES = 3
BOM = "\ufeff"
NF = len(TS_FORMATS)
# A decision table is broadcast up to this size, at so many bytes per row or nested entry.
BROADCAST_MAX_BYTES = 128 << 20
ROW_BYTES = 100
# State rows that one task merges.
ONE_TASK_ROWS = 1 << 16


@dataclass
class Recording:
    """Result of ingest: lazy DataFrames over the two passes.

    ``flights`` (needs the median row gap) and ``issues`` are built on first
    access, so a caller that only reads samples pays for neither.
    """

    samples: DataFrame      # flight_id, row_no, ts, elapsed_s, parameter, text, value
    parameters: DataFrame   # flight_id, position, parameter, name, unit, is_numeric, n_rows, n_valid
    cells: DataFrame        # flight_id, line_no, position, cell  (parsed rows, before typing)
    head: DataFrame         # per-flight decisions (small)
    _parts: dict = field(repr=False, default_factory=dict)

    @cached_property
    def flights(self) -> DataFrame:
        """flight_id, n_rows, n_parameters, duration_s, median_interval_s, sampling_rate_hz, ts_format"""
        p = self._parts
        return _flights(p["accepted"], p["kept"])

    @cached_property
    def issues(self) -> DataFrame:
        """flight_id, line_no, column, code, count"""
        p = self._parts
        return _issues(self.head, p["params"], p["rows"], self.samples, p["kept"])


def _small(df: DataFrame, nested: str) -> tuple[DataFrame, bool]:
    """Materialise a decision table, mark it for broadcast if its size allows, and tell whether it does.

    The entries of the array column ``nested`` count too: a table of few rows
    may hold long column lists.
    """
    df = materialize(df)
    n, entries = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col(nested).isNotNull(), F.size(nested))), F.lit(0))).first()
    small = (n + entries) * ROW_BYTES <= BROADCAST_MAX_BYTES
    return (F.broadcast(df) if small else df), small


def _prepared(lines: DataFrame) -> DataFrame:
    line = F.when(F.col("line_no") == 0, F.regexp_replace("line", "^" + BOM, "")).otherwise(F.col("line"))
    return (lines.filter(F.col("flight_id").isNotNull())
            .select("flight_id", F.col("line_no").cast("long").alias("line_no"), F.coalesce(line, F.lit("")).alias("line"))
            .withColumn("blank", py_strip(F.col("line")) == ""))


def _in_order(runs: DataFrame) -> tuple[bool, int]:
    """Whether every partition holds each recording as one ascending run, runs do not overlap; and their number."""
    before = Window.partitionBy("flight_id").orderBy("line_no", "part")
    r = runs.withColumn("apart", F.coalesce(F.lag("last_no").over(before) < F.col("line_no"), F.lit(True))).agg(
        F.bool_and(F.col("ordered") & F.col("apart")).alias("ok"), F.count(F.lit(1)).alias("n")).first()
    return bool(r["ok"]), r["n"]


def _reads_in_place(df: DataFrame) -> bool:
    """Whether the rows reach a task without a shuffle, so that two passes meet the same partitions.

    Shuffles that only build a broadcast table do not move the rows.
    """
    def moved(plan) -> bool:
        name = plan.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return moved(plan.executedPlan())
        if name.startswith("BroadcastExchange"):
            return False
        if name.startswith(("Exchange", "Coalesce", "AQEShuffleRead", "ShuffleQueryStage")):
            return True
        children = plan.children()
        return any(moved(children.apply(i)) for i in range(children.size()))

    return not moved(df._jdf.queryExecution().executedPlan())


def _numbered_in_place(kept: DataFrame, runs: DataFrame, counts: DataFrame, accepted: DataFrame) -> DataFrame:
    """``row_no`` of kept lines from the counts of their splits: no line leaves its task.

    A line's place among the kept lines of its partition, less those of the
    recordings before it there, plus those of the recording's earlier splits.
    A line outside the range its split had in the first pass stops the query.
    """
    r = (runs.join(accepted, "flight_id").join(counts, ["part", "flight_id"], "left")
         .withColumn("n", F.coalesce(_pick("cnt"), F.lit(0))))
    before = lambda key, order: (Window.partitionBy(key).orderBy(order)
                                 .rowsBetween(Window.unboundedPreceding, -1))
    r = r.select("part", "flight_id", F.col("line_no").alias("first_no"), "last_no",
                 F.coalesce(F.sum("n").over(before("flight_id", "line_no")), F.lit(0)).alias("offset"),
                 F.coalesce(F.sum("n").over(before("part", "seq")), F.lit(0)).alias("start"))
    k = kept.withColumn("_id", F.monotonically_increasing_id()).withColumn("part", F.shiftright("_id", 33).cast("int"))
    k = k.join(F.broadcast(r), ["part", "flight_id"], "left")
    moved = F.raise_error(F.lit("lines lie in other partitions than in the first pass: store them before ingest"))
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) - F.col("start")
    ok = (F.col("line_no") >= F.col("first_no")) & (F.col("line_no") <= F.col("last_no")) & (place >= 0)
    return k.withColumn("row_no", F.when(F.coalesce(ok, F.lit(False)), F.col("offset") + place)
                        .otherwise(moved.cast("long"))).drop("_id", "part", "first_no", "last_no", "offset", "start")


def _pick(prefix: str):
    """The column of the chosen timestamp format."""
    return F.expr(f"CASE {' '.join(f'WHEN fmt = {i} THEN {prefix}{i}' for i in range(NF - 1))} ELSE {prefix}{NF - 1} END")


def _elapsed_entry():
    """The elapsed time as a layout entry; position 0, the timestamp's, is in no layout."""
    return F.struct(F.lit(0).alias("position"), F.lit(ELAPSED_COLUMN).alias("parameter"), F.lit(True).alias("is_numeric"))


def ingest(lines: DataFrame) -> Recording:
    """Parse recording lines into typed samples; see the module notes."""
    L, kind = _prepared(lines), F.col("kind")

    # pass 1: what each split knows, then per flight
    def read_splits():
        state, n = materialize_counted(split_state(L))
        # Few rows of state are merged in one task, without a shuffle.
        few = n <= ONE_TASK_ROWS
        state = state.coalesce(1) if few else state
        return few, state, state.filter(kind == "run").select("part", "flight_id", "line_no", "last_no", "seq", "ordered")

    ordered = _reads_in_place(L)
    if ordered:
        few, state, runs = read_splits()
        ordered, n_runs = _in_order(runs)
    if not ordered:
        # Lines from a shuffle, or not in file order: sorted into ranges of lines and stored, once.
        L = materialize(L.repartitionByRange("flight_id", "line_no").sortWithinPartitions("flight_id", "line_no"))
        few, state, runs = read_splits()
        n_runs = runs.count()
    bounds = (state.groupBy("flight_id").agg(
        F.min(F.when((kind == "line") & ~F.col("blank"), F.col("line_no"))).alias("h0"),
        F.max(F.when(kind == "end", F.col("line_no"))).alias("hl"))
        .withColumn("too_few", F.col("h0").isNull() | (F.col("hl") - F.col("h0") + 1 < MIN_LINES)))
    loose = (state.filter(kind == "line").select("part", "flight_id", "line_no", "blank", "line")
             .join(bounds.filter(~F.col("too_few")).select("flight_id", "h0"), "flight_id"))
    header = loose.filter(F.col("line_no") <= F.col("h0") + 1).filter(F.col("line_no") >= F.col("h0"))
    is_h1 = F.col("line_no") == F.col("h0")
    header = (header.select("flight_id", is_h1.alias("first"), F.posexplode(F.split("line", ",", -1)).alias("pos", "cell"))
              .groupBy("flight_id", F.col("pos").cast("long").alias("pos"))
              .agg(F.max(F.when(F.col("first"), F.col("cell"))).alias("h1"),
                   F.max(F.when(~F.col("first"), F.col("cell"))).alias("h2")))
    # Lines that a split kept back and that are no header after all are counted like the others.
    late = line_state(loose.filter((F.col("line_no") > F.col("h0") + 1) & ~F.col("blank")))
    cell_rows = state.filter(kind == "cell").unionByName(late)
    cell_rows = cell_rows.coalesce(1) if few else cell_rows
    # Long column lists as SQL text: one call to the JVM each.
    sums = [F.expr("sum(n_data) AS n_data"), *[F.expr(f"{f}({c}{i}) AS {c}{i}") for i in range(NF) for f, c in (
        ("sum", "cnt"), ("min", "min"), ("max", "max"), ("sum", "num"))]]
    counts = cell_rows.groupBy("flight_id", "pos").agg(*sums)
    counted = [f"coalesce({c}, 0L) AS {c}" for c in ["n_data", *[f"{p}{i}" for p in ("cnt", "num") for i in range(NF)]]]
    times = [f"timestampadd(MICROSECOND, {p}{i}, TIMESTAMP_NTZ'1970-01-01 00:00:00') AS {p}{i}"
             for p in ("min", "max") for i in range(NF)]
    cols = (counts.join(header, ["flight_id", "pos"], "full")
            .join(bounds.filter(~F.col("too_few")).select("flight_id"), "flight_id", "left_semi")
            .selectExpr("flight_id", "pos", "h1", "h2", *counted, *times))
    cols = materialize(cols)
    cols = cols.coalesce(1) if few else cols

    # per-flight decisions
    share = " ".join(f"WHEN double(cnt{i}) > double(n_rows) * double({TS_VALID_SHARE}) THEN {i}" for i in range(NF - 1))
    fmt = F.expr(f"CASE {share} ELSE {NF - 1} END")

    at0 = cols.filter(F.col("pos") == 0).selectExpr(
        "flight_id", "n_data AS n_rows", *[f"{p}{i}" for p in ("cnt", "min", "max") for i in range(NF)])
    widths = cols.groupBy("flight_id").agg(
        F.least(F.count("h1"), F.count("h2")).cast("int").alias("n_cols"))
    fl = (bounds.join(widths, "flight_id", "left").join(at0, "flight_id", "left")
          .withColumn("n_rows", F.coalesce(F.col("n_rows"), F.lit(0)))
          .withColumn("fmt", fmt)
          .withColumn("n_kept", _pick("cnt"))
          .withColumn("t0", _pick("min"))
          .withColumn("t1", _pick("max"))
          .select("flight_id", "h0", "hl", "too_few", "n_cols", "n_rows", "fmt", "n_kept", "t0", "t1"))
    params = (cols.join(fl.select("flight_id", "n_cols", "fmt", "n_kept"), "flight_id")
              .filter(F.col("pos") < F.col("n_cols"))
              .withColumn("num_ok", _pick("num"))
              .select("flight_id", F.col("pos").cast("int").alias("position"),
                      column_name(F.col("h1"), F.coalesce(F.col("h2"), F.lit("")), F.col("pos")).alias("parameter"),
                      py_strip(F.col("h1")).alias("name"), py_strip(F.col("h2")).alias("unit"),
                      (safe_ratio(F.col("num_ok"), F.col("n_kept")) > F.lit(NUMERIC_VALID_SHARE)).alias("is_numeric"),
                      F.col("n_kept").alias("n_rows"), F.col("num_ok")))
    dups = (params.groupBy("flight_id", "parameter").agg(F.count(F.lit(1)).alias("times"))
            .filter(F.col("times") > 1))
    dup_flights = dups.groupBy("flight_id").agg(F.lit(True).alias("dup_names"))
    refusal = (F.when(F.col("too_few"), F.lit("TOO_FEW_LINES"))
               .when(F.col("n_rows") == 0, F.lit("NO_ROWS"))
               .when(F.coalesce(F.col("n_kept"), F.lit(0)) == 0, F.lit("NO_TIMESTAMPS"))
               .when(F.col("dup_names"), F.lit("DUPLICATE_COLUMN")))
    layout = (params.filter(F.col("position") > 0)
              .groupBy("flight_id")
              .agg(F.array_sort(F.collect_list(F.struct("position", "parameter", "is_numeric"))).alias("layout")))
    head, small = _small(fl.join(dup_flights, "flight_id", "left").withColumn("refused", refusal)
                         .join(layout, "flight_id", "left"), "layout")
    accepted = head.filter(F.col("refused").isNull())
    in_place = small and n_runs * ROW_BYTES <= BROADCAST_MAX_BYTES

    # pass 2: typed samples
    r = L.join(head.select("flight_id", "h0", "hl", "n_cols", "fmt", "t0", "refused"), "flight_id")
    body = (F.col("line_no") >= F.col("h0") + 2) & (F.col("line_no") <= F.col("hl")) & ~F.col("blank")
    rows = r.filter(body & F.col("n_cols").isNotNull())
    cells = split_cells(F.col("line"))
    n = F.size(F.split(F.col("line"), ",", -1))
    fixed = (F.when(n > F.col("n_cols"), F.slice(cells, 1, F.col("n_cols")))
             .when(n < F.col("n_cols"), F.concat(cells, F.array_repeat(F.lit(""), F.col("n_cols") - n)))
             .otherwise(cells))
    cell_table = rows.select("flight_id", "line_no", F.posexplode(fixed).alias("position", "cell"))

    first_cell = py_strip(F.substring_index(F.col("line"), ",", 1))
    kept = rows.filter(F.col("refused").isNull()).select("flight_id", "line_no", "line", "fmt", first_cell.alias("_c0"))
    kept = with_timestamp_of(kept, "_c0", "fmt", "ts")
    kept = keep_not_null(kept.drop("_c0", "fmt"), "ts")
    if in_place:
        per_split = (cell_rows.filter(F.col("pos") == 0).groupBy("part", "flight_id")
                     .agg(*[F.expr(f"sum(cnt{i}) AS cnt{i}") for i in range(NF)]))
        kept = _numbered_in_place(kept, runs, per_split, accepted.select("flight_id", "fmt"))
    else:
        # Too many splits or flights for a broadcast: the line itself passes the numbering
        # shuffle; cells and column lists come after it.
        kept = dense_row_number(kept, ["flight_id"], ["line_no"], F.shiftright(F.col("line_no"), ROW_BLOCK_BITS))
    kept = kept.join(head.select("flight_id", "t0", "n_cols", "layout"), "flight_id")
    kept = kept.withColumn("elapsed_s", F.timestamp_diff("MICROSECOND", F.col("t0"), F.col("ts")) / 1e6)
    # The layout holds every position from 1 on, so a line is split once and zipped with it; cells that
    # the line lacks are null there and become '', those beyond the layout are cut.
    body_cells = F.slice(F.split(F.col("line"), ",", -1), F.lit(2), F.greatest(F.size("layout"), F.lit(0)))
    exploded = (kept.select("flight_id", "row_no", "ts", "elapsed_s", F.col("line"), "layout")
                .withColumn("z", F.explode(F.concat(F.arrays_zip(F.col("layout").alias("p"), body_cells.alias("cell")),
                                                    F.array(F.struct(_elapsed_entry().alias("p"), F.lit(None).cast("string").alias("cell")))))))
    exploded = (exploded.filter((F.col("z.p.position") == 0) | (F.col("z.p.parameter") != ELAPSED_COLUMN))
                .select("flight_id", "row_no", "ts", "elapsed_s", F.struct(
                    F.col("z.p.parameter").alias("parameter"), F.col("z.p.is_numeric").alias("is_numeric"),
                    py_strip(F.coalesce(F.col("z.cell"), F.lit(""))).alias("cell")).alias("p")))
    samples = exploded.select(
        "flight_id", "row_no", "ts", "elapsed_s", F.col("p.parameter").alias("parameter"),
        F.when(~F.col("p.is_numeric"), F.col("p.cell")).alias("text"),
        F.when(F.col("p.parameter") == ELAPSED_COLUMN, F.col("elapsed_s"))
        .when(F.col("p.is_numeric"), parse_number(F.col("p.cell"))).alias("value"))

    parameters = (params.join(accepted.select("flight_id"), "flight_id", "left_semi")
                  .filter(F.col("position") > 0)
                  .select("flight_id", "position", "parameter", "name", "unit", "is_numeric", "n_rows",
                          F.when(F.col("is_numeric"), F.col("num_ok")).otherwise(F.col("n_rows")).alias("n_valid")))
    return Recording(samples=samples, parameters=parameters, cells=cell_table, head=head,
                     _parts={"accepted": accepted, "kept": kept, "params": params, "rows": rows.withColumn("n_raw", n)})


def _flights(accepted: DataFrame, kept: DataFrame) -> DataFrame:
    """Per-flight summary; the median interval comes from row-to-row gaps in file order."""
    gaps = previous_values(kept.select("flight_id", "row_no", "elapsed_s"), ["flight_id"], ["elapsed_s"])
    med = quantile_columns(gaps.select("flight_id", (F.col("elapsed_s") - F.col("prev_elapsed_s")).alias("gap")),
                           ["flight_id"], "gap", [0.5], ["median_interval_s"])
    fmt_name = F.element_at(F.array(*[F.lit(f) for f in TS_FORMATS]), F.col("fmt") + 1)
    return (accepted.join(med, "flight_id", "left")
            .select("flight_id", F.col("n_kept").cast("long").alias("n_rows"),
                    (F.col("n_cols") - 1).cast("int").alias("n_parameters"),
                    (F.timestamp_diff("MICROSECOND", F.col("t0"), F.col("t1")) / 1e6).alias("duration_s"),
                    "median_interval_s",
                    F.when((F.col("n_kept") > 1) & (F.col("median_interval_s") > 0),
                           1.0 / F.col("median_interval_s")).alias("sampling_rate_hz"),
                    fmt_name.alias("ts_format")))


def _issue(df: DataFrame, code: str, line_no=None, column=None, count=None) -> DataFrame:
    lit_none = F.lit(None)
    return df.select("flight_id",
                     (line_no if line_no is not None else lit_none).cast("long").alias("line_no"),
                     (column if column is not None else lit_none).cast("string").alias("column"),
                     F.lit(code).alias("code"),
                     (count if count is not None else F.lit(1)).cast("long").alias("count"))


def _issues(head: DataFrame, params: DataFrame, rows: DataFrame, samples: DataFrame, kept: DataFrame) -> DataFrame:
    """Data faults as rows; counts are results, wording is not kept."""
    refused = head.filter(F.col("refused").isNotNull()).select(
        "flight_id", F.lit(None).cast("long").alias("line_no"), F.lit(None).cast("string").alias("column"),
        F.col("refused").alias("code"), F.lit(1).cast("long").alias("count"))
    line_num = F.col("line_no") - F.col("h0") + 1
    width_code = F.when(F.col("n_raw") > F.col("n_cols"), "EXTRA_COLUMNS").otherwise("MISSING_COLUMNS")
    widths = rows.filter(F.col("n_raw") != F.col("n_cols")).select(
        "flight_id", line_num.cast("long").alias("line_no"), F.lit(None).cast("string").alias("column"),
        width_code.alias("code"), F.lit(1).cast("long").alias("count"))
    h = head.filter(F.col("refused").isNull() | (F.col("refused") == "DUPLICATE_COLUMN"))
    bad_ts = _issue(h.filter(F.col("n_kept") < F.col("n_rows")), "INVALID_TIMESTAMP",
                    count=F.col("n_rows") - F.col("n_kept"))
    ok = head.filter(F.col("refused").isNull()).select("flight_id")
    p = params.join(ok, "flight_id", "left_semi").filter(F.col("position") > 0)
    non_numeric = _issue(p.filter(F.col("is_numeric") & (F.col("num_ok") < F.col("n_rows"))), "NON_NUMERIC",
                         column=F.col("parameter"), count=F.col("n_rows") - F.col("num_ok"))
    as_text = _issue(p.filter(~F.col("is_numeric")), "KEPT_AS_TEXT", column=F.col("parameter"),
                     count=F.col("n_rows") - F.col("num_ok"))
    from aerolytics.operators.quality import quality_issues
    return (refused.unionByName(widths).unionByName(bad_ts)
            .unionByName(non_numeric).unionByName(as_text).unionByName(quality_issues(samples, kept)))
