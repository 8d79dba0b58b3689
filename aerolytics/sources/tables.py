"""Adapters: tabular data presented as recordings.

Each returns long ``samples`` (or text ``lines``) so every operator runs on
them unchanged. Row order inside a flight comes from ``dense_row_number`` with
a block column that is monotone in the order, never a flight-wide window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolytics.plans.ordering import dense_row_number, range_row_number
from aerolytics.schema import unpivot
from aerolytics.session import join_small

BOM = "\ufeff"

# The fault rules injected into the event-derived recordings, by
# event_id divisor. Applied identically in the DuckDB oracle.
NULL_VALUE_EVERY = 37
BLANK_LINE_EVERY = 97
BAD_TIMESTAMP_EVERY = 89
SHORT_ROW_EVERY = 83
LONG_ROW_EVERY = 79
BAD_NUMBER_EVERY = 73
# Header of the event-derived recordings and the timestamp
# layout used by each flight (event_type).
EVENT_HEADER_NAMES = "Description,VALUE,Description K,NOTE"
EVENT_HEADER_UNITS = "EU,deg,N/A,-"
EVENT_TS_LAYOUT = {
    "click": "DDD:HH:mm:ss.SSSSSS",
    "error": "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "purchase": "yyyy-MM-dd HH:mm:ss",
    "signup": "HH:mm:ss.SSSSSS",
}
MIXED_FLIGHT_LAYOUTS = ("DDD:HH:mm:ss.SSSSSS", "HH:mm:ss")  # 3 of 5 events, then 2 of 5


def _numbered_by_time(df: DataFrame, out: str = "row_no") -> DataFrame:
    """Rows numbered by (ts, event_id), with ``elapsed_s`` since the flight's first timestamp."""
    return _elapsed(range_row_number(df, ["flight_id"], ["ts", "event_id"], out))


def _elapsed(df: DataFrame) -> DataFrame:
    start = df.groupBy("flight_id").agg(F.min("ts").alias("_t0"))
    return (join_small(df, start, ["flight_id"])
            .withColumn("elapsed_s", F.timestamp_diff("MICROSECOND", F.col("_t0"), F.col("ts")) / 1e6)
            .drop("_t0"))


def _event_flight(per_type: int | None):
    """flight_id of an event: its type, or type and user bucket for ``per_type`` recordings per type."""
    if not per_type:
        return F.col("event_type")
    return F.concat_ws("-", F.col("event_type"), (F.col("user_id") % per_type).cast("string"))


def events_samples(spark: SparkSession, sf_dir: str, with_nulls: bool = False,
                   per_type: int | None = None, numbered: bool = True) -> DataFrame:
    """``events`` as recordings: flight = event_type, rows by (ts, event_id).

    Parameters ``value`` and ``k`` (from props). ``with_nulls`` blanks
    ``value`` on every NULL_VALUE_EVERY-th event_id. Without ``numbered`` the rows
    keep a null ``row_no``: operators that ask for no order need no shuffle.
    """
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.col("value")
    if with_nulls:
        value = F.when(F.col("event_id") % NULL_VALUE_EVERY != 0, value)
    base = ev.select(_event_flight(per_type).alias("flight_id"), "event_id", "ts", value.alias("value"),
                     F.get_json_object("props", "$.k").cast("double").alias("k"))
    base = _numbered_by_time(base) if numbered else _elapsed(base).withColumn("row_no", F.lit(None).cast("long"))
    return unpivot(base, {"value": "value", "k": "k"}, "flight_id", "row_no", "ts", "elapsed_s")


def lineitem_samples(spark: SparkSession, sf_dir: str, extra: bool = False, numbered: bool = True) -> DataFrame:
    """``lineitem`` as recordings: flight = l_returnflag, rows by (l_orderkey,
    l_linenumber, l_partkey, l_suppkey).

    Four parameters: quantity, extended price, discount, tax. ``extra`` adds a
    constant parameter ``one`` and ``tax_gaps`` = l_tax, missing on line 3 of
    each order. Without ``numbered`` the rows keep a null ``row_no``.
    """
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    base = li.select(F.col("l_returnflag").alias("flight_id"), "l_orderkey", "l_linenumber", "l_partkey",
                     "l_suppkey",
                     F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
                     "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    # The first date comes from the raw rows, before they are numbered.
    base = _elapsed(base)
    if numbered:
        base = dense_row_number(base, ["flight_id"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
                                F.shiftright(F.col("l_orderkey"), 12))
    else:
        base = base.withColumn("row_no", F.lit(None).cast("long"))
    params = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice",
              "l_discount": "l_discount", "l_tax": "l_tax"}
    if extra:
        params["one"] = F.lit(1.0)
        params["tax_gaps"] = F.when(F.col("l_linenumber") != 3, F.col("l_tax"))
    return unpivot(base, params, "flight_id", "row_no", "ts", "elapsed_s")


def hourly_counts_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events counted per hour and event_type, on the full hour grid from the
    flight's first to its last event hour (hours without events count 0).
    Row = hour index from the first hour."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = F.date_trunc("hour", F.col("ts"))
    counts = ev.groupBy(F.col("event_type").alias("flight_id"), hour.alias("hour")).agg(
        F.count(F.lit(1)).cast("double").alias("n"))
    span = counts.groupBy("flight_id").agg(F.min("hour").alias("h0"), F.max("hour").alias("h1"))
    grid = (span.select("flight_id", "h0", F.explode(F.sequence(
        F.lit(0), F.timestamp_diff("HOUR", F.col("h0"), F.col("h1")).cast("int"))).alias("row_no"))
        .withColumn("hour", F.timestamp_add("HOUR", F.col("row_no"), F.col("h0"))))
    full = (grid.join(counts, ["flight_id", "hour"], "left")
            .select("flight_id", F.col("row_no").cast("long").alias("row_no"), F.col("hour").alias("ts"),
                    (F.col("row_no") * 3600.0).alias("elapsed_s"),
                    F.coalesce(F.col("n"), F.lit(0.0)).alias("events")))
    return unpivot(full, {"events": "events"}, "flight_id", "row_no", "ts", "elapsed_s")


def events_lines(spark: SparkSession, sf_dir: str, per_type: int | None = None) -> DataFrame:
    """``events`` written out as recording text: ``lines(flight_id, line_no, line)``.

    One recording per event_type: a byte-order mark and two header lines, then
    one line per event in (ts, event_id) order, ``timestamp,value,k,note``. The
    timestamp layout depends on the flight (one mixes two layouts). Faults by
    event_id: blank line, unreadable timestamp, short row, long row, bad number.
    ``per_type`` splits each type into that many recordings by user_id bucket.
    """
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    eid = F.col("event_id")
    fid = F.col("event_type")
    # Every expression stands once: repeated ones grow the generated method past what the JVM compiles.
    layout = None
    for name, pattern in EVENT_TS_LAYOUT.items():
        cell = F.date_format(F.col("ts"), pattern)
        layout = F.when(fid == name, cell) if layout is None else layout.when(fid == name, cell)
    mixed = F.when(eid % 5 < 3, F.date_format(F.col("ts"), MIXED_FLIGHT_LAYOUTS[0])).otherwise(
        F.date_format(F.col("ts"), MIXED_FLIGHT_LAYOUTS[1]))
    ts_cell = F.concat(F.when(eid % BAD_TIMESTAMP_EVERY == 0, F.lit("x")).otherwise(F.lit("")), layout.otherwise(mixed))
    value_cell = F.when(eid % BAD_NUMBER_EVERY == 0, F.lit("n/a")).otherwise(
        F.format_string("%.2f", F.col("value")))
    k_cell = F.get_json_object("props", "$.k")
    note_cell = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    # concat_ws leaves null cells out: a short row ends after the value.
    short = F.when(eid % SHORT_ROW_EVERY == 0, F.lit(True)).otherwise(F.lit(False))
    body = F.concat(F.concat_ws(",", ts_cell, value_cell, F.when(~short, k_cell), F.when(~short, note_cell)),
                    F.when(eid % LONG_ROW_EVERY == 0, F.lit(",extra")).otherwise(F.lit("")))
    line = F.when(eid % BLANK_LINE_EVERY == 0, F.lit("  ")).otherwise(body)
    # The text is written once, where the sorted rows are stored.
    data = range_row_number(ev.withColumn("flight_id", _event_flight(per_type)), ["flight_id"], ["ts", "event_id"],
                            "_seq", stored={"line": line})
    data = data.select("flight_id", (F.col("_seq") + 2).alias("line_no"), "line")
    flights = ev.select(_event_flight(per_type).alias("flight_id")).distinct()
    head = flights.select("flight_id", F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("line_no"), F.lit(BOM + EVENT_HEADER_NAMES).alias("line")),
        F.struct(F.lit(1).cast("long").alias("line_no"), F.lit(EVENT_HEADER_UNITS).alias("line")),
    )).alias("h")).select("flight_id", "h.line_no", "h.line")
    return head.unionByName(data)


# Flight-test vocabulary used to label part rows as parameter
# names, picked by p_partkey modulo its length (a label, not a filter).
PARAMETER_VOCABULARY = [
    "aileron", "elevator", "rudder", "flap", "spoiler", "trim tab", "angle of attack", "alpha",
    "beta", "sideslip", "pitch rate", "roll rate", "yaw rate", "longitudinal force", "lateral force",
    "normal load", "strain gauge", "stress", "hinge moment", "torque", "stick position", "pedal cmd",
    "pitch trim", "betha", "controller", "tablet", "airspeed", "altitude", "longitudinal lateral load",
]


def part_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parameter catalogue from ``part``: flight = p_brand, one parameter per
    part, named ``<VOCABULARY WORD> <P_NAME> #<p_partkey>``, column position =
    p_partkey (so column order is part order)."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    vocab = F.array(*[F.lit(w) for w in PARAMETER_VOCABULARY])
    word = F.get(vocab, (F.col("p_partkey") % len(PARAMETER_VOCABULARY)).cast("int"))
    name = F.concat_ws(" ", F.upper(word), F.upper(F.col("p_name")),
                       F.concat(F.lit("#"), F.col("p_partkey").cast("string")))
    return part.select(F.col("p_brand").alias("flight_id"), name.alias("parameter"),
                       F.col("p_partkey").cast("int").alias("position"))
