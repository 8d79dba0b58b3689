"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each statement reads the driver tables directly and restates the operator's
rule in plain SQL (window row numbers, self-joins, direct DFT sums), so it
checks the Spark plan rather than repeating it. Aliases and rounding follow
``catalog``: round(x * 10^d) / 10^d + 0.0.
"""

from __future__ import annotations

from aerolytics.functions.text import ELAPSED_COLUMN
from aerolytics.functions.timestamps import TS_FORMATS
from aerolytics.plans import catalog
from aerolytics.sources import tables as T

EL = f"'{ELAPSED_COLUMN}'"


def R(e: str, d: int = 6) -> str:
    return f"(round(({e}) * 1e{d}) / 1e{d} + 0.0)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ev_base(with_nulls: bool = False) -> str:
    value = f"CASE WHEN event_id % {T.NULL_VALUE_EVERY} <> 0 THEN value END" if with_nulls else "value"
    return f"""ev_base AS (
  SELECT event_type AS flight_id, event_id, ts, {value} AS value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS row_no,
         (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY event_type))) / 1e6 AS elapsed_s
  FROM events)"""


def _long(base: str, name: str, params: dict[str, str]) -> str:
    parts = [f"SELECT flight_id, row_no, ts, elapsed_s, {_q(p)} AS parameter, CAST(NULL AS VARCHAR) AS text, "
             f"CAST({e} AS DOUBLE) AS value FROM {base}" for p, e in params.items()]
    parts.append(f"SELECT flight_id, row_no, ts, elapsed_s, {EL} AS parameter, CAST(NULL AS VARCHAR) AS text, "
                 f"elapsed_s AS value FROM {base}")
    return f"{name} AS (\n  " + "\n  UNION ALL ".join(parts) + ")"


def EV(with_nulls: bool = False, name: str = "ev") -> str:
    return "WITH " + ev_base(with_nulls) + ",\n" + _long("ev_base", name, {"value": "value", "k": "k"})


LI_BASE = """li_base AS (
  SELECT l_returnflag AS flight_id, l_orderkey, l_linenumber, CAST(l_shipdate AS TIMESTAMP) AS ts,
         l_quantity, l_extendedprice, l_discount, l_tax,
         row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1
           AS row_no,
         (epoch_us(l_shipdate) - epoch_us(min(l_shipdate) OVER (PARTITION BY l_returnflag))) / 1e6 AS elapsed_s
  FROM lineitem)"""
LI_PARAMS = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "l_discount": "l_discount",
             "l_tax": "l_tax"}
LI_EXTRA = dict(LI_PARAMS, one="1.0", tax_gaps="CASE WHEN l_linenumber <> 3 THEN l_tax END")


def LI(extra: bool = False, name: str = "li") -> str:
    return "WITH " + LI_BASE + ",\n" + _long("li_base", name, LI_EXTRA if extra else LI_PARAMS)


# --- ingest of the event-derived recordings --------------------------------

_LAYOUT_FMT = {"DDD:HH:mm:ss.SSSSSS": 0, "yyyy-MM-dd HH:mm:ss.SSSSSS": 1, "yyyy-MM-dd HH:mm:ss": 2,
               "HH:mm:ss.SSSSSS": 3, "HH:mm:ss": 4}
_STRF = {0: "%j:%H:%M:%S.%f", 1: "%Y-%m-%d %H:%M:%S.%f", 2: "%Y-%m-%d %H:%M:%S", 3: "%H:%M:%S.%f", 4: "%H:%M:%S"}


def _cell_fmt() -> str:
    whens = " ".join(f"WHEN {_q(f)} THEN {_LAYOUT_FMT[l]}" for f, l in T.EVENT_TS_LAYOUT.items())
    mixed = (f"CASE WHEN event_id % 5 < 3 THEN {_LAYOUT_FMT[T.MIXED_FLIGHT_LAYOUTS[0]]} "
             f"ELSE {_LAYOUT_FMT[T.MIXED_FLIGHT_LAYOUTS[1]]} END")
    return f"CASE event_type {whens} ELSE {mixed} END"


def _ts_cell() -> str:
    return "CASE cell_fmt " + " ".join(f"WHEN {i} THEN strftime(ts, '{f}')" for i, f in _STRF.items()) + " END"


def _parsed() -> str:
    day = "(ts - date_trunc('day', ts))"
    sec_day = "(date_trunc('second', ts) - date_trunc('day', ts))"
    return (f"CASE fmt WHEN 0 THEN TIMESTAMP '1900-01-01' + to_days(CAST(dayofyear(ts) - 1 AS INTEGER)) + {day} "
            f"WHEN 1 THEN ts WHEN 2 THEN date_trunc('second', ts) "
            f"WHEN 3 THEN TIMESTAMP '1900-01-01' + {day} "
            f"ELSE TIMESTAMP '1900-01-01' + {sec_day} END")


INGEST = f"""WITH e AS (
  SELECT event_type AS flight_id, event_id, ts, value, props, user_id,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) + 1 AS line_no,
         event_id % {T.BLANK_LINE_EVERY} = 0 AS blank, event_id % {T.BAD_TIMESTAMP_EVERY} = 0 AS bad_ts,
         event_id % {T.SHORT_ROW_EVERY} = 0 AS short_row, event_id % {T.LONG_ROW_EVERY} = 0 AS long_row,
         event_id % {T.BAD_NUMBER_EVERY} = 0 AS bad_num, {_cell_fmt()} AS cell_fmt
  FROM events),
rows AS (SELECT * FROM e WHERE NOT blank),
nrows AS (SELECT flight_id, count(*) AS n_rows FROM rows GROUP BY 1),
fmtcnt AS (SELECT flight_id, cell_fmt, count(*) AS c FROM rows WHERE NOT bad_ts GROUP BY 1, 2),
choice AS (
  SELECT n.flight_id, n.n_rows,
         coalesce(min(CASE WHEN CAST(f.c AS DOUBLE) > CAST(n.n_rows AS DOUBLE) * CAST(0.8 AS DOUBLE)
                           THEN f.cell_fmt END), 4) AS fmt
  FROM nrows n LEFT JOIN fmtcnt f USING (flight_id) GROUP BY n.flight_id, n.n_rows),
kept0 AS (
  SELECT r.*, c.fmt FROM rows r JOIN choice c USING (flight_id) WHERE NOT r.bad_ts AND r.cell_fmt = c.fmt),
kept1 AS (SELECT *, {_parsed()} AS tsp FROM kept0),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY line_no) - 1 AS row_no,
         (epoch_us(tsp) - epoch_us(min(tsp) OVER (PARTITION BY flight_id))) / 1e6 AS elapsed_s,
         CASE WHEN bad_num THEN NULL ELSE CAST(printf('%.2f', value) AS DOUBLE) END AS v_value,
         CASE WHEN short_row THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS v_k,
         CASE WHEN short_row THEN '' ELSE 'u' || CAST(user_id AS VARCHAR) END AS t_note
  FROM kept1),
nk AS (SELECT flight_id, count(*) AS n_kept, count(v_value) AS ok_value, count(v_k) AS ok_k,
              count(TRY_CAST(t_note AS DOUBLE)) AS ok_note
       FROM kept GROUP BY 1),
params AS (
  SELECT flight_id, 1 AS position, 'VALUE (deg)' AS parameter, 'VALUE' AS name, 'deg' AS unit,
         CAST(ok_value AS DOUBLE) / CAST(n_kept AS DOUBLE) > 0.8 AS is_numeric, n_kept AS n_rows, ok_value AS ok
  FROM nk
  UNION ALL SELECT flight_id, 2, 'K', 'Description K', 'N/A', CAST(ok_k AS DOUBLE) / CAST(n_kept AS DOUBLE) > 0.8,
         n_kept, ok_k FROM nk
  UNION ALL SELECT flight_id, 3, 'NOTE', 'NOTE', '-', CAST(ok_note AS DOUBLE) / CAST(n_kept AS DOUBLE) > 0.8,
         n_kept, ok_note FROM nk),
samples AS (
  SELECT k.flight_id, k.row_no, k.tsp AS ts, k.elapsed_s, p.parameter,
         CASE WHEN p.is_numeric THEN NULL ELSE (CASE p.position WHEN 1 THEN printf('%.2f', k.value)
              WHEN 2 THEN (CASE WHEN k.short_row AND k.long_row THEN 'extra' WHEN k.short_row THEN ''
                                ELSE json_extract_string(k.props, '$.k') END)
              ELSE k.t_note END) END AS text,
         CASE WHEN NOT p.is_numeric THEN NULL WHEN p.position = 1 THEN k.v_value WHEN p.position = 2 THEN k.v_k
              ELSE TRY_CAST(k.t_note AS DOUBLE) END AS value
  FROM kept k JOIN params p USING (flight_id)
  UNION ALL
  SELECT flight_id, row_no, tsp, elapsed_s, {EL}, NULL, elapsed_s FROM kept)"""


INGEST_CELLS = INGEST + """,
cells AS (
  SELECT flight_id, line_no, 0 AS position,
         CASE WHEN bad_ts THEN 'x' ELSE '' END || (""" + _ts_cell().replace("strftime(ts", "strftime(ts") + """) AS cell
  FROM rows
  UNION ALL SELECT flight_id, line_no, 1, CASE WHEN bad_num THEN 'n/a' ELSE printf('%.2f', value) END FROM rows
  UNION ALL SELECT flight_id, line_no, 2, CASE WHEN short_row AND long_row THEN 'extra' WHEN short_row THEN ''
                                                 ELSE json_extract_string(props, '$.k') END
            FROM rows
  UNION ALL SELECT flight_id, line_no, 3, CASE WHEN short_row THEN '' ELSE 'u' || CAST(user_id AS VARCHAR) END
            FROM rows)
SELECT flight_id, line_no, position, cell FROM cells"""

INGEST_SCHEMA = INGEST + """
SELECT flight_id, CAST(position AS INTEGER) AS position, parameter, name, unit, is_numeric, n_rows,
       CASE WHEN is_numeric THEN ok ELSE n_rows END AS n_valid
FROM params"""

INGEST_SAMPLES = INGEST + f"""
SELECT flight_id, row_no, ts, {R('elapsed_s')} AS elapsed_s, parameter, text, {R('value')} AS value FROM samples"""

_FMT_NAMES = "[" + ", ".join(_q(f) for f in TS_FORMATS) + "]"
INGEST_FLIGHTS = INGEST + f""",
gaps AS (SELECT flight_id, elapsed_s - lag(elapsed_s) OVER (PARTITION BY flight_id ORDER BY row_no) AS gap
         FROM kept),
med AS (SELECT flight_id, quantile_cont(gap, 0.5) AS m FROM gaps WHERE gap IS NOT NULL GROUP BY 1),
agg AS (SELECT flight_id, any_value(fmt) AS fmt, count(*) AS n_rows,
               (epoch_us(max(tsp)) - epoch_us(min(tsp))) / 1e6 AS duration_s FROM kept GROUP BY 1)
SELECT a.flight_id, a.n_rows, 3 AS n_parameters, {R('a.duration_s')} AS duration_s,
       {R('m.m')} AS median_interval_s,
       {R('CASE WHEN a.n_rows > 1 AND m.m > 0 THEN 1.0 / m.m END', 12)} AS sampling_rate_hz,
       {_FMT_NAMES}[a.fmt + 1] AS ts_format
FROM agg a LEFT JOIN med m USING (flight_id)"""

INGEST_ISSUES = INGEST + f""",
iss AS (
  SELECT flight_id, line_no + 1 AS line_no, NULL AS col, 'EXTRA_COLUMNS' AS code, 1 AS cnt FROM rows
    WHERE long_row AND NOT short_row
  UNION ALL SELECT flight_id, line_no + 1, NULL, 'MISSING_COLUMNS', 1 FROM rows WHERE short_row
  UNION ALL SELECT n.flight_id, NULL, NULL, 'INVALID_TIMESTAMP', c.n_rows - n.n_kept
    FROM nk n JOIN choice c USING (flight_id) WHERE n.n_kept < c.n_rows
  UNION ALL SELECT flight_id, NULL, parameter, 'NON_NUMERIC', n_rows - ok FROM params WHERE is_numeric AND ok < n_rows
  UNION ALL SELECT flight_id, NULL, parameter, 'KEPT_AS_TEXT', n_rows - ok FROM params WHERE NOT is_numeric
  UNION ALL SELECT flight_id, NULL, NULL, 'DUPLICATE_TIMESTAMPS', count(*) - count(DISTINCT tsp) FROM kept
    GROUP BY 1 HAVING count(*) - count(DISTINCT tsp) > 0
  UNION ALL SELECT flight_id, NULL, parameter, CASE WHEN nd = 1 THEN 'CONSTANT' ELSE 'LOW_VARIETY' END, nd
    FROM (SELECT flight_id, parameter, count(DISTINCT value) AS nd, count(*) AS n, count(value) AS nv
          FROM samples WHERE text IS NULL AND parameter <> {EL} GROUP BY 1, 2)
    WHERE nv > 0 AND (nd = 1 OR CAST(nd AS DOUBLE) < CAST(n AS DOUBLE) * 0.01)
  UNION ALL SELECT flight_id, NULL, parameter, 'EMPTY_COLUMN', 0
    FROM samples WHERE text IS NULL GROUP BY flight_id, parameter HAVING count(value) = 0)
SELECT flight_id, CAST(line_no AS BIGINT) AS line_no, CAST(col AS VARCHAR) AS "column", code,
       CAST(cnt AS BIGINT) AS count FROM iss"""


# --- operators on event / lineitem samples ---------------------------------

ELAPSED_GAPS = EV() + f"""
SELECT flight_id, row_no, {R('elapsed_s - lag(elapsed_s) OVER (PARTITION BY flight_id ORDER BY row_no)')} AS gap_s
FROM ev_base QUALIFY row_no > 0"""

SAMPLING = EV() + f""",
g AS (SELECT flight_id, elapsed_s - lag(elapsed_s) OVER (PARTITION BY flight_id ORDER BY row_no) AS gap FROM ev_base),
m AS (SELECT flight_id, quantile_cont(gap, 0.5) AS m FROM g WHERE gap IS NOT NULL GROUP BY 1)
SELECT flight_id, {R('m')} AS median_interval_s, {R('CASE WHEN m > 0 THEN 1.0 / m END', 12)} AS sampling_rate_hz FROM m"""

DUPLICATE_TS = EV() + """
SELECT flight_id, count(*) AS n_rows, count(DISTINCT date_trunc('hour', ts)) AS n_distinct,
       count(*) - count(DISTINCT date_trunc('hour', ts)) AS duplicates
FROM ev_base GROUP BY 1"""

VARIETY = LI(True) + f""",
v AS (SELECT flight_id, parameter, count(DISTINCT value) AS n_distinct, count(*) AS n_rows,
             arg_min_null(value, row_no) AS first_value, count(value) AS n_valid
      FROM li WHERE text IS NULL AND parameter <> {EL} GROUP BY 1, 2)
SELECT flight_id, parameter, n_distinct, n_rows, {R('first_value')} AS first_value,
       CASE WHEN n_distinct = 1 THEN 'constant'
            WHEN CAST(n_distinct AS DOUBLE) < CAST(n_rows AS DOUBLE) * 0.01 THEN 'low_variety' END AS status
FROM v WHERE n_valid > 0"""

EMPTY = LI(True) + f""",
allp AS (SELECT * FROM li UNION ALL
         SELECT flight_id, row_no, ts, elapsed_s, 'blank', NULL, CAST(NULL AS DOUBLE) FROM li WHERE parameter = {EL}),
empty AS (SELECT flight_id, parameter FROM allp WHERE text IS NULL GROUP BY 1, 2 HAVING count(value) = 0),
kept AS (SELECT flight_id, count(DISTINCT parameter) AS n_kept FROM allp
         WHERE (flight_id, parameter) NOT IN (SELECT (flight_id, parameter) FROM empty) GROUP BY 1)
SELECT e.flight_id, e.parameter, k.n_kept FROM empty e JOIN kept k USING (flight_id)"""

OVERVIEW = EV() + f"""
SELECT flight_id, count(*) FILTER (WHERE parameter = {EL}) AS n_points,
       count(DISTINCT parameter) FILTER (WHERE parameter <> {EL}) AS n_parameters,
       count(DISTINCT parameter) FILTER (WHERE parameter <> {EL}) + 2 AS n_columns,
       {R(f'coalesce(max(value) FILTER (WHERE parameter = {EL}) / 60.0, 0.0)')} AS duration_min
FROM ev GROUP BY 1"""

DESCRIBE = LI() + f"""
SELECT flight_id, parameter, count(value) AS count, {R('avg(value)', 4)} AS mean, {R('stddev_samp(value)', 4)} AS std,
       {R('min(value)', 4)} AS min, {R('quantile_cont(value, 0.25)', 4)} AS q25,
       {R('quantile_cont(value, 0.5)', 4)} AS q50, {R('quantile_cont(value, 0.75)', 4)} AS q75,
       {R('max(value)', 4)} AS max
FROM li WHERE text IS NULL GROUP BY 1, 2"""

STATISTICS = EV(True) + f"""
SELECT flight_id, parameter, count(value) AS count, {R('avg(value)')} AS mean, {R('stddev_samp(value)')} AS std,
       {R('min(value)')} AS min, {R('max(value)')} AS max, {R('quantile_cont(value, 0.5)')} AS median,
       {R('quantile_cont(value, 0.25)')} AS q25, {R('quantile_cont(value, 0.75)')} AS q75,
       {R('max(value) - min(value)')} AS range,
       {R('CASE WHEN count(value) < 3 THEN NULL WHEN var_pop(value) = 0 THEN 0.0 ELSE skewness(value) END')} AS skewness,
       {R('CASE WHEN count(value) < 4 THEN NULL WHEN var_pop(value) = 0 THEN 0.0 ELSE kurtosis(value) END')} AS kurtosis
FROM ev WHERE text IS NULL AND parameter IN ('value', 'k', 'absent') AND value IS NOT NULL GROUP BY 1, 2"""

RANGES = LI() + f"""
SELECT flight_id, parameter, {R('min(value)', 4)} AS min, {R('max(value)', 4)} AS max, {R('avg(value)', 4)} AS mean,
       {R('stddev_samp(value)', 4)} AS std
FROM li WHERE text IS NULL AND parameter <> {EL} GROUP BY 1, 2"""

REPORT_STATISTICS = LI() + f"""
SELECT flight_id, parameter, {R('min(value)', 4)} AS min, {R('max(value)', 4)} AS max, {R('avg(value)', 4)} AS mean,
       {R('stddev_samp(value)', 4)} AS std, {R('max(value) - min(value)', 4)} AS range
FROM li WHERE text IS NULL AND parameter <> {EL} GROUP BY 1, 2"""

_MISS = """m AS (SELECT flight_id, parameter, count(*) FILTER (WHERE value IS NULL AND text IS NULL) AS missing,
                    count(*) AS n_rows FROM ev GROUP BY 1, 2)"""
MISSING_VALUES = EV(True) + ",\n" + _MISS + """
SELECT flight_id, parameter, missing,
       round_even(CAST(missing AS DOUBLE) / CAST(n_rows AS DOUBLE) * CAST(100.0 AS DOUBLE) * CAST(100.0 AS DOUBLE), 0)
         / CAST(100.0 AS DOUBLE) + 0.0 AS percent
FROM m WHERE missing > 0"""

MISSING_SUMMARY = EV(True) + ",\n" + _MISS + """
SELECT flight_id, bool_or(missing > 0) AS any_missing, count(*) FILTER (WHERE missing > 0) AS n_columns_with_missing
FROM m GROUP BY 1"""


def _corr(params_filter: str, label: bool, value: str = "value") -> str:
    lab = ", round_even(r * 100.0, 0) / 100.0 + 0.0 AS r_label" if label else ""
    return LI(True) + f""",
s AS (SELECT flight_id, row_no, parameter, {value} AS value FROM li
      WHERE text IS NULL AND parameter <> {EL} {params_filter}),
names AS (SELECT DISTINCT flight_id, parameter FROM s),
np AS (SELECT flight_id, count(*) AS np FROM names GROUP BY 1),
grid AS (SELECT a.flight_id, a.parameter AS x, b.parameter AS y FROM names a JOIN names b USING (flight_id)),
p AS (SELECT a.flight_id, a.parameter AS x, b.parameter AS y, a.value AS vx, b.value AS vy
      FROM s a JOIN s b USING (flight_id, row_no) WHERE a.value IS NOT NULL AND b.value IS NOT NULL),
c AS (SELECT flight_id, x, y, count(*) AS n,
             covar_samp(vx, vy) / nullif(stddev_samp(vx) * stddev_samp(vy), 0) AS r FROM p GROUP BY 1, 2, 3)
SELECT g.flight_id, g.x, g.y, coalesce(c.n, 0) AS n, {R('r')} AS r{lab}
FROM grid g JOIN np USING (flight_id) LEFT JOIN c ON c.flight_id = g.flight_id AND c.x = g.x AND c.y = g.y
WHERE np.np >= 2"""


CORRELATION = _corr("", False)
CORRELATION_MISSING = _corr("", False, "CASE WHEN parameter = 'l_tax' AND row_no % 2 = 1 THEN NULL "
                                       "WHEN parameter = 'tax_gaps' AND row_no % 2 = 0 THEN NULL "
                                       "WHEN parameter = 'l_discount' THEN NULL ELSE value END")
CORRELATION_LABELS = _corr("AND parameter IN ('l_quantity', 'tax_gaps', 'absent')", True)

_LIM = ("lim(parameter, limit_min, limit_max) AS (VALUES "
        + ", ".join(f"({_q(p)}, CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))" for p, lo, hi in catalog.QUERY_LIMITS)
        + ")")
LIMIT_CHECK = EV() + ",\n" + _LIM + f""",
mm AS (SELECT e.flight_id, e.parameter, l.limit_min, l.limit_max, min(e.value) AS min_value, max(e.value) AS max_value
       FROM ev e JOIN lim l USING (parameter) WHERE e.text IS NULL GROUP BY 1, 2, 3, 4),
found AS (
  SELECT flight_id, parameter, 'below' AS status, min_value, max_value, limit_min, limit_max FROM mm
    WHERE min_value < limit_min
  UNION ALL SELECT flight_id, parameter, 'above', min_value, max_value, limit_min, limit_max FROM mm
    WHERE max_value > limit_max
  UNION ALL SELECT flight_id, parameter, 'ok', min_value, max_value, limit_min, limit_max FROM mm
    WHERE limit_min <= min_value AND max_value <= limit_max)
SELECT flight_id, parameter, status, {R('min_value')} AS min_value, {R('max_value')} AS max_value, limit_min, limit_max
FROM found
UNION ALL
SELECT DISTINCT flight_id, NULL, 'none', NULL, NULL, NULL, NULL FROM ev
WHERE flight_id NOT IN (SELECT flight_id FROM found)"""


def _zscore(params: list[str], t: float) -> str:
    plist = ", ".join(_q(p) for p in params)
    return EV(True) + f""",
s AS (SELECT * FROM ev WHERE text IS NULL AND parameter IN ({plist})),
st AS (SELECT flight_id, parameter, avg(value) AS m, stddev_samp(value) AS sd FROM s GROUP BY 1, 2)
SELECT s.flight_id, s.row_no, s.parameter, s.value,
       coalesce(abs((s.value - st.m) / nullif(st.sd, 0)) > CAST({t} AS DOUBLE), false) AS is_outlier
FROM s JOIN st USING (flight_id, parameter)"""


OUTLIERS_Z = _zscore(["value", "k"], 3.0)
OUTLIERS_ISOLATION = _zscore(["value"], 2.5)
OUTLIERS_IQR = EV(True) + """,
s AS (SELECT * FROM ev WHERE text IS NULL AND parameter = 'value'),
st AS (SELECT flight_id, parameter, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM s GROUP BY 1, 2)
SELECT s.flight_id, s.row_no, s.parameter, s.value,
       coalesce(s.value < st.q1 - CAST(1.5 AS DOUBLE) * (st.q3 - st.q1)
                OR s.value > st.q3 + CAST(1.5 AS DOUBLE) * (st.q3 - st.q1), false) AS is_outlier
FROM s JOIN st USING (flight_id, parameter)"""

QUANTILES_LARGE = LI() + f"""
SELECT flight_id, parameter, {R('quantile_cont(value, 0.25)', 4)} AS q25,
       {R('quantile_cont(value, 0.5)', 4)} AS q50, {R('quantile_cont(value, 0.75)', 4)} AS q75
FROM li WHERE value IS NOT NULL GROUP BY 1, 2"""

# One infinite value leaves mean and deviation undefined: nothing is an outlier by z-score.
OUTLIERS_Z_INF = EV() + f""",
s AS (SELECT * FROM ev WHERE parameter IN ('value', 'k')),
st AS (SELECT flight_id, avg(value) AS m, stddev_samp(value) AS sd FROM s WHERE parameter = 'k' GROUP BY 1)
SELECT s.flight_id, s.row_no, s.parameter,
       coalesce(s.parameter = 'k' AND abs((s.value - st.m) / nullif(st.sd, 0)) > 3.0, false) AS is_outlier
FROM s JOIN st USING (flight_id)"""
OUTLIERS_IQR_INF = EV() + f""",
s AS (SELECT flight_id, row_no, parameter,
             CASE WHEN row_no % {catalog.INFINITE_VALUE_EVERY} = 0 THEN CAST('inf' AS DOUBLE) ELSE value END AS value
      FROM ev WHERE parameter = 'value'),
st AS (SELECT flight_id, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM s GROUP BY 1)
SELECT s.flight_id, s.row_no, s.parameter,
       coalesce(s.value < st.q1 - CAST(1.5 AS DOUBLE) * (st.q3 - st.q1)
                OR s.value > st.q3 + CAST(1.5 AS DOUBLE) * (st.q3 - st.q1), false) AS is_outlier
FROM s JOIN st USING (flight_id)"""

EVERY_KTH = EV() + f""",
k AS (SELECT flight_id, greatest(1, count(*) // 50) AS k FROM ev_base GROUP BY 1)
SELECT e.flight_id, e.row_no, e.ts, {R('e.elapsed_s')} AS elapsed_s, e.parameter, e.text, {R('e.value')} AS value
FROM ev e JOIN k USING (flight_id) WHERE e.row_no % k.k = 0"""

MEAN_STEP = EV() + f""",
a AS (SELECT flight_id, count(*) AS n_rows, arg_min(elapsed_s, row_no) AS f, arg_max(elapsed_s, row_no) AS l
      FROM ev_base GROUP BY 1)
SELECT flight_id, n_rows, {R('f')} AS first_elapsed_s, {R('l')} AS last_elapsed_s,
       {R('(l - f) / nullif(CAST(n_rows - 1 AS DOUBLE), 0)')} AS dt_s FROM a"""

FIRST_VALUE = EV() + f"""
SELECT flight_id, parameter, {R('arg_min_null(value, row_no)')} AS first_value, arg_min_null(text, row_no) AS first_text
FROM ev GROUP BY 1, 2"""

FFT = """WITH hc AS (SELECT event_type AS flight_id, date_trunc('hour', ts) AS hour, count(*) AS n
            FROM events GROUP BY 1, 2),
span AS (SELECT flight_id, min(hour) AS h0, max(hour) AS h1 FROM hc GROUP BY 1),
grid AS (SELECT flight_id, h0, unnest(generate_series(0, date_diff('hour', h0, h1))) AS row_no FROM span),
ser AS (SELECT g.flight_id, g.row_no, CAST(coalesce(hc.n, 0) AS DOUBLE) AS x
        FROM grid g LEFT JOIN hc ON hc.flight_id = g.flight_id AND hc.hour = g.h0 + to_hours(g.row_no)),
nn AS (SELECT flight_id, count(*) AS n FROM ser GROUP BY 1),
bins AS (SELECT flight_id, n, unnest(generate_series(0, n // 2 - 1)) AS k FROM nn),
dft AS (SELECT b.flight_id, b.k, b.n,
               sum(s.x * cos(2 * pi() * ((s.row_no * b.k) % b.n) / b.n)) AS re,
               sum(s.x * sin(2 * pi() * ((s.row_no * b.k) % b.n) / b.n)) AS im
        FROM bins b JOIN ser s USING (flight_id) GROUP BY 1, 2, 3)
SELECT flight_id, 'events' AS parameter, CAST(k AS BIGINT) AS bin,
       """ + R("k * (1.0 / (n * CAST(3600.0 AS DOUBLE)))", 12) + """ AS frequency_hz,
       """ + R("2.0 / n * sqrt(re * re + im * im)") + """ AS amplitude
FROM dft"""

def _psd(column: str) -> str:
    return f"""
s AS (SELECT flight_id, row_no, elapsed_s, {column} AS value FROM ev_base),
info AS (SELECT flight_id, count(*) AS n, least(256, count(*)) AS L, arg_min(elapsed_s, row_no) AS e0,
                arg_max(elapsed_s, row_no) AS e1 FROM s GROUP BY 1),
info2 AS (SELECT *, L - L // 2 AS step, (n - L) // (L - L // 2) + 1 AS nseg,
                 1.0 / ((e1 - e0) / CAST(n - 1 AS DOUBLE)) AS fs FROM info),
m0 AS (SELECT s.flight_id, s.row_no // i.step AS seg, s.row_no, s.value, i.L, i.step, i.nseg
       FROM s JOIN info2 i USING (flight_id)
       UNION ALL
       SELECT s.flight_id, s.row_no // i.step - 1, s.row_no, s.value, i.L, i.step, i.nseg
       FROM s JOIN info2 i USING (flight_id)),
m AS (SELECT *, row_no - seg * step AS j FROM m0 WHERE seg >= 0 AND seg < nseg AND row_no - seg * step < L),
w AS (SELECT *, (value - avg(value) OVER (PARTITION BY flight_id, seg)) * (0.5 - 0.5 * cos(2 * pi() * j / L)) AS xw
      FROM m),
bins AS (SELECT flight_id, L, fs, unnest(generate_series(0, L // 2)) AS k FROM info2),
dft AS (SELECT w.flight_id, w.seg, b.k, b.L, b.fs,
               sum(w.xw * cos(2 * pi() * ((w.j * b.k) % b.L) / b.L)) AS re,
               sum(w.xw * sin(2 * pi() * ((w.j * b.k) % b.L) / b.L)) AS im
        FROM w JOIN bins b USING (flight_id) GROUP BY 1, 2, 3, 4, 5),
ws AS (SELECT flight_id, sum(power(0.5 - 0.5 * cos(2 * pi() * j / L), 2)) AS s2
       FROM (SELECT DISTINCT flight_id, j, L FROM m) GROUP BY 1),
p AS (SELECT d.flight_id, d.k, d.L, d.fs,
             (re * re + im * im) / (d.fs * ws.s2)
               * CASE WHEN d.k = 0 THEN 1 WHEN d.L % 2 = 0 AND d.k = d.L // 2 THEN 1 ELSE 2 END AS p
      FROM dft d JOIN ws USING (flight_id))"""


PSD = EV() + "," + _psd("value") + f"""
SELECT flight_id, 'value' AS parameter, CAST(k AS BIGINT) AS bin,
       {R('k * (1.0 / (L * (1.0 / fs)))', 12)} AS frequency_hz, {R('10.0 * log10(avg(p))')} AS psd_db
FROM p GROUP BY flight_id, k, L, fs"""

SPECTRUM_DISPATCH = EV() + f""",
fn AS (SELECT flight_id, count(*) AS n, arg_min(elapsed_s, row_no) AS e0, arg_max(elapsed_s, row_no) AS e1
       FROM ev_base GROUP BY 1),
fb AS (SELECT flight_id, n, (e1 - e0) / CAST(n - 1 AS DOUBLE) AS dt, unnest(generate_series(0, n // 2 - 1)) AS k FROM fn),
fd AS (SELECT b.flight_id, b.k, b.n, b.dt,
              sum(e.value * cos(2 * pi() * ((e.row_no * b.k) % b.n) / b.n)) AS re,
              sum(e.value * sin(2 * pi() * ((e.row_no * b.k) % b.n) / b.n)) AS im
       FROM fb b JOIN ev_base e USING (flight_id) GROUP BY 1, 2, 3, 4),""" + _psd("k") + f"""
SELECT flight_id, 'value' AS parameter, 'fft' AS kind, CAST(k AS BIGINT) AS bin,
       {R('k * (1.0 / (n * dt))', 12)} AS frequency_hz, {R('2.0 / n * sqrt(re * re + im * im)', 3)} AS amplitude
FROM fd
UNION ALL
SELECT flight_id, 'k', 'psd', CAST(k AS BIGINT), {R('k * (1.0 / (L * (1.0 / fs)))', 12)}, {R('avg(p)', 3)}
FROM p GROUP BY flight_id, k, L, fs"""


# --- parameter names from part ---------------------------------------------

_VOCAB = "[" + ", ".join(_q(w) for w in T.PARAMETER_VOCABULARY) + "]"
PART_PARAMS = f"""pp AS (
  SELECT p_brand AS flight_id,
         upper({_VOCAB}[p_partkey % {len(T.PARAMETER_VOCABULARY)} + 1]) || ' ' || upper(p_name) || ' #'
           || CAST(p_partkey AS VARCHAR) AS parameter,
         CAST(p_partkey AS INTEGER) AS position
  FROM part),
ps AS (SELECT * FROM pp
       UNION ALL SELECT flight_id, 'Timestamp', 0 FROM pp GROUP BY 1
       UNION ALL SELECT flight_id, {EL}, CAST(max(position) + 1 AS INTEGER) FROM pp GROUP BY 1)"""


# The rules stand here a second time, as SQL, so that a wrong rule table does not pass.
def _any(words: str, col: str = "parameter") -> str:
    """Does the lower-cased name hold one of these |-separated words?"""
    return f"regexp_matches(lower({col}), '{words}')"


CATEGORIES = "WITH " + PART_PARAMS + f"""
SELECT flight_id,
       CASE WHEN {_any('aileron|elevator|rudder|flap|spoiler|tab')} THEN 'Control Surfaces'
            WHEN {_any('angle|alpha|beta|aoa|sideslip|pitch|roll|yaw')} THEN 'Flight Angles'
            WHEN {_any('force|load|strain|stress|moment|torque')} THEN 'Forces & Loads'
            WHEN {_any('position|cmd|command|stick|pedal')} THEN 'Positions & Commands'
            WHEN {_any('trim')} THEN 'Trim Settings'
            ELSE 'Other Parameters' END AS category, parameter, position
FROM pp"""

QUICK = "WITH " + PART_PARAMS + f""",
sel AS (
  SELECT flight_id, 'control' AS selector, parameter, position FROM ps WHERE {_any('aileron|elevator|rudder|flap')}
  UNION ALL SELECT flight_id, 'angle', parameter, position FROM ps WHERE {_any('angle|alpha|beta')}
  UNION ALL SELECT flight_id, 'force', parameter, position FROM ps WHERE {_any('force|strain|load')})
SELECT flight_id, selector, parameter, position,
       row_number() OVER (PARTITION BY flight_id, selector ORDER BY position) AS rank
FROM sel QUALIFY rank <= 4"""


def _chart(template: str, no: int, title: str, where: str, limit: int, label: str, color: str) -> str:
    return (f"SELECT flight_id, parameter, position, '{template}' AS template, {no} AS chart_no, '{title}' AS title, "
            f"{limit} AS lim, '{label}' AS y_axis_label, '{color}' AS color_scheme FROM ps WHERE {where}")


_FORCE = _any("force|strain|load")
_MATCHES = "\n  UNION ALL ".join([
    _chart("control_surfaces", 0, "Aileron Control", _any("aileron"), 3, "Deflection (deg)", "blues"),
    _chart("control_surfaces", 1, "Elevator Control", _any("elevator"), 3, "Deflection (deg)", "reds"),
    _chart("control_surfaces", 2, "Rudder Control", _any("rudder"), 3, "Deflection (deg)", "greens"),
    _chart("control_surfaces", 3, "Flap Position", _any("flap"), 3, "Position (deg)", "purples"),
    _chart("flight_angles", 0, "Angle of Attack", _any("alpha|angle of attack|aoa"), 2, "Angle (deg)", "viridis"),
    _chart("flight_angles", 1, "Sideslip Angle", _any("beta|sideslip|betha"), 2, "Angle (deg)", "plasma"),
    _chart("forces", 0, "Longitudinal Forces", f"{_FORCE} AND {_any('longitudinal')}", 3, "Force (kg)", "blues"),
    _chart("forces", 1, "Lateral Forces", f"{_FORCE} AND {_any('lateral')}", 3, "Force (kg)", "reds"),
    _chart("forces", 2, "Other Forces", f"{_FORCE} AND NOT {_any('lateral|longitudinal')}", 3, "Force (kg)", "greens"),
    _chart("comprehensive", 0, "Control Surfaces Overview", _any("aileron|elevator|rudder"), 4, "Deflection (deg)",
           "viridis"),
    _chart("comprehensive", 1, "Flight Angles", _any("alpha|beta|angle"), 3, "Angle (deg)", "plasma"),
    _chart("comprehensive", 2, "Force Measurements", _any("force|strain"), 3, "Force (kg)", "inferno"),
    _chart("comprehensive", 3, "Trim Settings", _any("trim"), 3, "Trim (deg)", "cividis"),
])


def _templates(keep: str = "") -> str:
    return "WITH " + PART_PARAMS + ",\nmatches AS (" + _MATCHES + """),
top AS (SELECT * FROM matches
        QUALIFY row_number() OVER (PARTITION BY flight_id, template, chart_no ORDER BY position) <= lim),
charts AS (SELECT flight_id, template, chart_no, title, y_axis_label, color_scheme,
                  string_agg(parameter, ', ' ORDER BY position) AS parameters
           FROM top GROUP BY 1, 2, 3, 4, 5, 6),
numbered AS (SELECT *, row_number() OVER (PARTITION BY flight_id, template ORDER BY chart_no) - 1 AS chart_idx
             FROM charts)
SELECT flight_id, template, 'template_chart_' || CAST(chart_idx AS VARCHAR) AS chart_id, title, 'line' AS type,
       parameters, """ + EL + f""" AS x_axis, y_axis_label, color_scheme
FROM numbered {keep}"""


TEMPLATES_SQL = _templates()
LAYOUT_SQL = _templates("WHERE chart_idx < 2")  # a 1x2 grid

_REQ = ("req(request_pos, parameter) AS (VALUES "
        + ", ".join(f"({i}, {_q(p)})" for i, p in enumerate(catalog.VALID_REQUEST)) + ")")
VALID_PARAMETERS = INGEST + ",\n" + _REQ + """
SELECT p.flight_id, CAST(r.request_pos AS INTEGER) AS request_pos, p.parameter, p.is_numeric
FROM params p JOIN req r USING (parameter)"""

SERIES_LINE = EV() + f""",
req(series_no, parameter) AS (VALUES (0, 'value'), (1, 'k'), (2, 'absent'))
SELECT e.flight_id, 'c0' AS chart_id, CAST(r.series_no AS INTEGER) AS series_no, e.parameter, e.row_no,
       {R('e.elapsed_s')} AS x, {R('e.value')} AS y
FROM ev e JOIN req r USING (parameter)"""

SERIES_AREA = LI() + f""",
req(series_no, parameter) AS (VALUES (0, 'l_quantity'), (1, 'l_discount')),
pts AS (SELECT l.flight_id, CAST(r.series_no AS INTEGER) AS series_no, l.parameter, l.row_no, l.elapsed_s AS x,
               l.value AS y FROM li l JOIN req r USING (parameter))
SELECT flight_id, 'c1' AS chart_id, series_no, parameter, row_no, {R('x')} AS x, {R('y')} AS y,
       {R('CASE WHEN series_no = 0 THEN 0.0 ELSE lag(y) OVER (PARTITION BY flight_id, row_no ORDER BY series_no) END')}
         AS baseline
FROM pts"""

SERIES_TWO_AXES = EV() + f""",
req(series_no, parameter, axis) AS (VALUES (0, 'value', 'y1'), (1, 'k', 'y2'), (2, 'absent', 'y2'))
SELECT e.flight_id, 'multi_axis' AS chart_id, CAST(r.series_no AS INTEGER) AS series_no, e.parameter, e.row_no,
       {R('e.elapsed_s')} AS x, {R('e.value')} AS y, r.axis
FROM ev e JOIN req r USING (parameter)"""

SERIES_SCATTER_XY = EV() + f"""
SELECT flight_id, 'c3' AS chart_id, CAST(0 AS INTEGER) AS series_no, 'value' AS parameter, row_no,
       {R('k')} AS x, {R('value')} AS y
FROM ev_base"""

SERIES_TS_BAR = EV() + f""",
k AS (SELECT flight_id, greatest(1, count(*) // 50) AS k FROM ev_base GROUP BY 1)
SELECT e.flight_id, 'c2' AS chart_id, CAST(0 AS INTEGER) AS series_no, e.parameter, e.row_no, e.ts AS x_ts,
       {R('e.value')} AS y
FROM ev e JOIN k USING (flight_id) WHERE e.parameter = 'k' AND e.row_no % k.k = 0"""

EXPORT_METADATA = EV(True) + f""",
g AS (SELECT flight_id, elapsed_s - lag(elapsed_s) OVER (PARTITION BY flight_id ORDER BY row_no) AS gap FROM ev_base),
med AS (SELECT flight_id, quantile_cont(gap, 0.5) AS m FROM g WHERE gap IS NOT NULL GROUP BY 1),
b AS (SELECT flight_id, count(*) FILTER (WHERE parameter = {EL}) AS data_points,
             count(DISTINCT parameter) FILTER (WHERE parameter <> {EL}) AS np,
             max(value) FILTER (WHERE parameter = {EL}) AS duration_s FROM ev GROUP BY 1)
SELECT b.flight_id, {_q(catalog.EXPORT_DATE)} AS export_date, data_points, np AS n_parameters, np + 2 AS n_columns,
       {R('duration_s')} AS duration_s, format('{{:.2f}}', duration_s) AS duration_text,
       {R('1.0 / nullif(med.m, 0)', 12)} AS sampling_rate_hz, 0 AS charts_count
FROM b LEFT JOIN med USING (flight_id)"""

VALIDATE_EXPORT = EV(True) + ",\n" + _MISS + f""",
b AS (SELECT flight_id, count(*) FILTER (WHERE parameter = {EL}) AS points,
             count(DISTINCT parameter) FILTER (WHERE parameter <> {EL}) AS np,
             count(DISTINCT parameter) FILTER (WHERE text IS NULL) AS numeric_columns FROM ev GROUP BY 1),
mc AS (SELECT flight_id, count(*) FILTER (WHERE missing > 0) AS nm FROM m GROUP BY 1)
SELECT flight_id, 'warning' AS severity, 'MISSING_VALUES' AS code, nm AS n FROM mc WHERE nm > 0
UNION ALL SELECT flight_id, 'info', 'DATA_POINTS', points FROM b
UNION ALL SELECT flight_id, 'info', 'PARAMETERS', np + 2 FROM b
UNION ALL SELECT flight_id, 'info', 'NUMERIC_PARAMETERS', numeric_columns FROM b"""

EXPORT_ROUNDTRIP = "WITH " + ev_base(True) + f"""
SELECT flight_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS "Timestamp", {R('k')} AS k, {R('value')} AS value,
       {R('elapsed_s')} AS elapsed_s
FROM ev_base"""

def _mixed(stamp: str) -> str:
    return EV(True) + f""",
cells AS (
  SELECT flight_id, ts, parameter, text, value FROM ev
  UNION ALL
  SELECT flight_id, ts, 'mixed, kind', CASE WHEN flight_id IN ('click', 'error')
           THEN 't"' || coalesce(CAST(CAST(trunc(k) AS INTEGER) AS VARCHAR), '') END,
         CASE WHEN flight_id NOT IN ('click', 'error') THEN k END FROM ev_base
  UNION ALL SELECT flight_id, ts, 'only_click', NULL, k * 2 FROM ev_base WHERE flight_id = 'click')
SELECT flight_id, strftime(ts, '{stamp}') AS stamp, parameter, text, {R('value')} AS value FROM cells"""


EXPORT_CSV = _mixed("%Y-%m-%d %H:%M:%S.%f")
EXPORT_JSON = _mixed("%Y-%m-%dT%H:%M:%S.%f")

EXPORT_PLAIN_CSV = EV(True) + """
SELECT flight_id, count(*) AS n_rows, 'Timestamp,k,value,Elapsed Time (s)' AS header, false AS metadata FROM ev_base GROUP BY 1"""

EXPORT_JSON_METADATA = EV(True) + f""",
b AS (SELECT flight_id, count(*) AS data_points, max(elapsed_s) AS duration_s, flight_id = 'click' AS more FROM ev_base GROUP BY 1)
SELECT flight_id, {_q(catalog.EXPORT_DATE)} AS export_date, data_points, CASE WHEN more THEN 4 ELSE 3 END AS n_parameters,
       CASE WHEN more THEN 6 ELSE 5 END AS n_columns, {R('duration_s')} AS duration_s,
       format('{{:.2f}}', duration_s) AS duration_text, 2 AS charts_count,
       'Timestamp|k|mixed, kind|' || CASE WHEN more THEN 'only_click|' ELSE '' END || 'value|Elapsed Time (s)' AS columns,
       'c1:line:Values:value+k|c2:bar:Key:k' AS charts
FROM b"""

INGEST_FILES = INGEST_SAMPLES + """
UNION ALL SELECT 'too short', NULL, NULL, NULL, 'TOO_FEW_LINES', NULL, NULL"""

AUTO_REPORT = EV(True) + ",\n" + _LIM + f""",
ov AS (SELECT flight_id, count(*) FILTER (WHERE parameter = {EL}) AS n_points,
              count(DISTINCT parameter) FILTER (WHERE parameter <> {EL}) AS n_parameters,
              coalesce(max(value) FILTER (WHERE parameter = {EL}) / 60.0, 0.0) AS duration_min FROM ev GROUP BY 1),
de AS (SELECT flight_id, parameter, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
              quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75,
              max(value) AS max FROM ev WHERE text IS NULL GROUP BY 1, 2),
ts AS (SELECT flight_id, count(*) AS n, epoch_us(min(ts)) / 1e6 AS first, epoch_us(max(ts)) / 1e6 AS last
       FROM ev_base GROUP BY 1),
mp AS (SELECT flight_id, parameter, count(*) FILTER (WHERE value IS NULL AND text IS NULL) AS missing FROM ev GROUP BY 1, 2),
ms AS (SELECT flight_id, CAST(bool_or(missing > 0) AS INTEGER) AS any_missing,
              count(*) FILTER (WHERE missing > 0) AS nm FROM mp GROUP BY 1),
li AS (SELECT d.flight_id, d.parameter, d.min, d.max, l.limit_min, l.limit_max FROM de d JOIN lim l USING (parameter)),
st AS (SELECT *, 'below' AS status FROM li WHERE min < limit_min
       UNION ALL SELECT *, 'above' FROM li WHERE max > limit_max
       UNION ALL SELECT *, 'ok' FROM li WHERE limit_min <= min AND max <= limit_max),
u AS (
  SELECT flight_id, 'overview' AS section, '' AS key, 'n_points' AS field, CAST(n_points AS DOUBLE) AS value FROM ov
  UNION ALL SELECT flight_id, 'overview', '', 'n_parameters', CAST(n_parameters AS DOUBLE) FROM ov
  UNION ALL SELECT flight_id, 'overview', '', 'duration_min', duration_min FROM ov
  UNION ALL SELECT flight_id, 'describe', parameter, 'count', CAST(n AS DOUBLE) FROM de
  UNION ALL SELECT flight_id, 'describe', parameter, 'mean', mean FROM de
  UNION ALL SELECT flight_id, 'describe', parameter, 'std', std FROM de
  UNION ALL SELECT flight_id, 'describe', parameter, 'min', min FROM de
  UNION ALL SELECT flight_id, 'describe', parameter, 'q25', q25 FROM de
  UNION ALL SELECT flight_id, 'describe', parameter, 'q50', q50 FROM de
  UNION ALL SELECT flight_id, 'describe', parameter, 'q75', q75 FROM de
  UNION ALL SELECT flight_id, 'describe', parameter, 'max', max FROM de
  UNION ALL SELECT flight_id, 'describe', 'Timestamp', 'count', CAST(n AS DOUBLE) FROM ts
  UNION ALL SELECT flight_id, 'describe', 'Timestamp', 'first', first FROM ts
  UNION ALL SELECT flight_id, 'describe', 'Timestamp', 'last', last FROM ts
  UNION ALL SELECT flight_id, 'missing', '', 'any_missing', CAST(any_missing AS DOUBLE) FROM ms
  UNION ALL SELECT flight_id, 'missing', '', 'n_columns_with_missing', CAST(nm AS DOUBLE) FROM ms
  UNION ALL SELECT flight_id, 'limits', parameter || '|' || status, 'min_value', min FROM st
  UNION ALL SELECT flight_id, 'limits', parameter || '|' || status, 'max_value', max FROM st
  UNION ALL SELECT flight_id, 'charts', 'line|Values', 'n_parameters', 2.0 FROM ov
  UNION ALL SELECT flight_id, 'charts', 'bar|Key', 'n_parameters', 1.0 FROM ov)
SELECT flight_id, section, key, field, {R('value', 4)} AS value FROM u"""

REPORT = LI(True) + f""",
ov AS (SELECT flight_id, count(*) FILTER (WHERE parameter = {EL}) AS n_points,
              count(DISTINCT parameter) FILTER (WHERE parameter <> {EL}) AS n_parameters,
              coalesce(max(value) FILTER (WHERE parameter = {EL}) / 60.0, 0.0) AS duration_min FROM li GROUP BY 1),
st AS (SELECT flight_id, parameter, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
              max(value) AS max, max(value) - min(value) AS range
       FROM li WHERE text IS NULL AND parameter <> {EL} GROUP BY 1, 2),
mp AS (SELECT flight_id, parameter, count(*) FILTER (WHERE value IS NULL AND text IS NULL) AS missing FROM li GROUP BY 1, 2),
ms AS (SELECT flight_id, CAST(bool_or(missing > 0) AS INTEGER) AS any_missing,
              count(*) FILTER (WHERE missing > 0) AS n_columns_with_missing FROM mp GROUP BY 1),
cs AS (SELECT flight_id, parameter, arg_min_null(value, row_no) AS first_value
       FROM li WHERE text IS NULL AND parameter <> {EL} GROUP BY 1, 2
       HAVING count(DISTINCT value) = 1 AND count(value) > 0),
u AS (
  SELECT flight_id, 'overview' AS section, '' AS key, 'n_points' AS field, CAST(n_points AS DOUBLE) AS value FROM ov
  UNION ALL SELECT flight_id, 'overview', '', 'n_parameters', CAST(n_parameters AS DOUBLE) FROM ov
  UNION ALL SELECT flight_id, 'overview', '', 'duration_min', duration_min FROM ov
  UNION ALL SELECT flight_id, 'statistics', parameter, 'mean', mean FROM st
  UNION ALL SELECT flight_id, 'statistics', parameter, 'std', std FROM st
  UNION ALL SELECT flight_id, 'statistics', parameter, 'min', min FROM st
  UNION ALL SELECT flight_id, 'statistics', parameter, 'max', max FROM st
  UNION ALL SELECT flight_id, 'statistics', parameter, 'range', range FROM st
  UNION ALL SELECT flight_id, 'missing', '', 'any_missing', CAST(any_missing AS DOUBLE) FROM ms
  UNION ALL SELECT flight_id, 'missing', '', 'n_columns_with_missing', CAST(n_columns_with_missing AS DOUBLE) FROM ms
  UNION ALL SELECT flight_id, 'constants', parameter, 'first_value', first_value FROM cs
  UNION ALL SELECT flight_id, 'charts', 'line|Values', 'n_parameters', 2.0 FROM ov
  UNION ALL SELECT flight_id, 'charts', 'bar|Key', 'n_parameters', 1.0 FROM ov)
SELECT flight_id, section, key, field, {R('value', 4)} AS value FROM u"""


ORACLE: dict[str, str] = {
    "ingest_cells": INGEST_CELLS,
    "ingest_schema": INGEST_SCHEMA,
    "ingest_samples": INGEST_SAMPLES,
    "ingest_flights": INGEST_FLIGHTS,
    "ingest_issues": INGEST_ISSUES,
    "elapsed": ELAPSED_GAPS,
    "sampling_rate": SAMPLING,
    "duplicate_timestamps": DUPLICATE_TS,
    "constant_low_variety": VARIETY,
    "empty_columns": EMPTY,
    "overview": OVERVIEW,
    "describe": DESCRIBE,
    "statistics": STATISTICS,
    "ranges": RANGES,
    "report_statistics": REPORT_STATISTICS,
    "missing_values": MISSING_VALUES,
    "missing_summary": MISSING_SUMMARY,
    "correlation_matrix": CORRELATION,
    "correlation_labels": CORRELATION_LABELS,
    "limit_check": LIMIT_CHECK,
    "outliers_zscore": OUTLIERS_Z,
    "outliers_iqr": OUTLIERS_IQR,
    "outliers_isolation": OUTLIERS_ISOLATION,
    "every_kth_row": EVERY_KTH,
    "mean_time_step": MEAN_STEP,
    "first_value": FIRST_VALUE,
    "fft": FFT,
    "psd_welch": PSD,
    "categories": CATEGORIES,
    "quick_selectors": QUICK,
    "templates": TEMPLATES_SQL,
    "layout_limit": LAYOUT_SQL,
    "valid_parameters": VALID_PARAMETERS,
    "series_line": SERIES_LINE,
    "series_area": SERIES_AREA,
    "series_two_axes": SERIES_TWO_AXES,
    "series_timestamp_bar": SERIES_TS_BAR,
    "export_metadata": EXPORT_METADATA,
    "validate_export": VALIDATE_EXPORT,
    "export_roundtrip": EXPORT_ROUNDTRIP,
    "correlation_missing": CORRELATION_MISSING,
    "quantiles_large": QUANTILES_LARGE,
    "outliers_zscore_inf": OUTLIERS_Z_INF,
    "outliers_iqr_inf": OUTLIERS_IQR_INF,
    "fft_large": FFT,
    "spectrum_dispatch": SPECTRUM_DISPATCH,
    "series_scatter_xy": SERIES_SCATTER_XY,
    "export_csv": EXPORT_CSV,
    "export_plain_csv": EXPORT_PLAIN_CSV,
    "export_json_mixed": EXPORT_JSON,
    "export_json_metadata": EXPORT_JSON_METADATA,
    "export_bundle": EXPORT_CSV,
    "auto_report": AUTO_REPORT,
    "ingest_files": INGEST_FILES,
    "report_tables": REPORT,
}
