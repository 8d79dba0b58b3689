"""Ingest edge cases (FIXTURES.md §3), all flights in one ingest call."""

import pytest
from pyspark.sql import functions as F

from aerolytics.functions.text import ELAPSED_COLUMN
from aerolytics.operators.ingest import ingest
from aerolytics.sources.recordings import lines_from_text, read_recordings

H = "Description,A,B\nEU,deg,-\n"
TEXTS = {
    "bom_crlf": "﻿Description,A,B\r\nEU,deg,-\r\n001:00:00:00.0,1,x\r\n001:00:00:01.0,2,y\r\n",
    "two_lines": "Description,A\nEU,-",
    "blank_tail": "Description,A\nEU,-\n\n   \n",
    "lead_blank": "\n\n  \nDescription,A\nEU,-\n1:00:00:00.5,3\n\n\n",
    "header_short": "Description,A,B,C\nEU,deg\n001:00:00:00.1,1,2,3\n001:00:00:00.2,4,5,6\n",
    "header_units": "Description,Description X,B,C,D,E\nEU,EU,,N/A,-,deg\n001:00:00:00.1,1,2,3,4,5\n",
    "header_dup": "Description,A,A\nEU,-,-\n001:00:00:00.1,1,2\n",
    "header_case": "Description,A,a\nEU,-,-\n001:00:00:00.1,1,2\n001:00:00:00.2,3,4\n",
    "names_odd": "Description,P.1,R/S,T–U,[V]\nEU,-,-,-,-\n001:00:00:00.1,1,2,3,4\n",
    "rows_ragged": H + "1:00:00:00.1, 5 ,6\n1:00:00:00.2,7\n\n1:00:00:00.3,8,9,10\n1:00:00:00.4,9,1\n1:00:00:00.5,1,1\n",
    "rows_quoted": "Description,A,B\nEU,-,-\n1:00:00:00.1,\"1,5\",2\n",
    "ts_doy": H + "010:00:00:00.25,1,2\n010:00:00:01.25,2,2\n",
    "ts_datetime_f": H + "2024-03-01 10:00:00.5,1,2\n2024-03-01 10:00:01.5,2,2\n",
    "ts_datetime": H + "2024-03-01 10:00:00,1,2\n2024-03-01 10:00:02,2,2\n",
    "ts_time_f": H + "10:00:00.5,1,2\n10:00:01.5,2,2\n",
    "ts_time": H + "10:00:00,1,2\n10:00:03,2,2\n",
    "ts_80": H + "".join(f"1:00:00:{i:02d}.0,1,2\n" for i in range(8)) + "bad,1,2\nbad,1,2\n",
    "ts_90": H + "".join(f"1:00:00:{i:02d}.0,1,2\n" for i in range(9)) + "bad,1,2\n",
    "ts_60": H + "".join(f"1:00:00:{i:02d}.0,1,2\n" for i in range(6)) + "10:00:00,1,2\n10:00:05,3,2\n"
             + "10:00:07,1,2\n10:00:09,1,2\n",
    "ts_midnight": H + "23:59:59.5,1,2\n00:00:00.5,2,2\n00:00:01.5,3,2\n",
    "num_80": "Description,A\nEU,-\n" + "".join(f"1:00:00:0{i}.0,{v}\n" for i, v in enumerate(["1", "2", "3", "4", "x"])),
    "num_odd": "Description,A\nEU,-\n" + "".join(f"1:00:00:{i:02d}.0,{v}\n" for i, v in enumerate(
        ["1", "2", "3", "4", "5", "6", "7", "8", "9", "nan", "inf", "1e400"])),
    "time_dup": H + "1:00:00:01.0,1,2\n1:00:00:01.0,2,2\n1:00:00:00.0,3,2\n",
}


@pytest.fixture(scope="module")
def rec(spark):
    return ingest(lines_from_text(spark, TEXTS))


@pytest.fixture(scope="module")
def head(rec):
    return {r.flight_id: r for r in rec.head.collect()}


@pytest.fixture(scope="module")
def params(rec):
    out = {}
    for r in rec.parameters.orderBy("flight_id", "position").collect():
        out.setdefault(r.flight_id, []).append((r.parameter, r.is_numeric))
    return out


@pytest.fixture(scope="module")
def samples(rec):
    out = {}
    for r in rec.samples.orderBy("flight_id", "row_no", "parameter").collect():
        out.setdefault(r.flight_id, []).append(r)
    return out


@pytest.fixture(scope="module")
def issues(rec):
    out = {}
    for r in rec.issues.collect():
        out.setdefault(r.flight_id, []).append((r.code, r.line_no, r.column, r["count"]))
    return out


def test_refusals(head):
    assert head["two_lines"].refused == "TOO_FEW_LINES"
    assert head["blank_tail"].refused == "TOO_FEW_LINES"
    assert head["header_dup"].refused == "DUPLICATE_COLUMN"
    assert head["ts_80"].refused == "NO_TIMESTAMPS"
    assert head["header_case"].refused is None


def test_bom_crlf(params, samples):
    assert params["bom_crlf"] == [("A (deg)", True), ("B", False)]
    vals = [(r.row_no, r.parameter, r.value, r.text) for r in samples["bom_crlf"]]
    assert (0, "A (deg)", 1.0, None) in vals and (1, "B", None, "y") in vals
    assert (1, ELAPSED_COLUMN, 1.0, None) in vals


def test_header_rules(params):
    assert params["header_short"] == [("A (deg)", True)]
    assert [p for p, _ in params["header_units"]] == ["X", "B", "C", "D", "E (deg)"]
    assert [p for p, _ in params["header_case"]] == ["A", "a"]
    assert [p for p, _ in params["names_odd"]] == ["P.1", "R/S", "T–U", "[V]"]


def test_lead_blank(samples, issues):
    s = samples["lead_blank"]
    assert [(r.parameter, r.value) for r in s if r.parameter == "A"] == [("A", 3.0)]
    assert [c for c, *_ in issues["lead_blank"]] == ["CONSTANT"]  # one value only


def test_ragged_rows(samples, issues, params):
    codes = sorted((c, ln) for c, ln, _, _ in issues["rows_ragged"] if c.endswith("COLUMNS"))
    assert codes == [("EXTRA_COLUMNS", 6), ("MISSING_COLUMNS", 4)]
    a = [r.value for r in samples["rows_ragged"] if r.parameter == "A (deg)"]
    assert a == [5.0, 7.0, 8.0, 9.0, 1.0]
    b = [r.text for r in samples["rows_ragged"] if r.parameter == "B"]
    assert b == ["6", "", "9", "1", "1"]
    assert ("B", False) in params["rows_ragged"]  # 4 of 5 numeric is not over 80 %


def test_quoted_commas_split(params, issues):
    assert params["rows_quoted"] == [("A", False), ("B", False)]
    assert ("EXTRA_COLUMNS", 3, None, 1) in issues["rows_quoted"]


def test_format_choice(rec):
    fl = {r.flight_id: r for r in rec.flights.collect()}
    assert fl["ts_doy"].ts_format == "%j:%H:%M:%S.%f"
    assert fl["ts_datetime_f"].ts_format == "%Y-%m-%d %H:%M:%S.%f"
    assert fl["ts_datetime"].ts_format == "%Y-%m-%d %H:%M:%S"
    assert fl["ts_time_f"].ts_format == "%H:%M:%S.%f"
    assert fl["ts_time"].ts_format == "%H:%M:%S"
    assert fl["ts_90"].ts_format == "%j:%H:%M:%S.%f" and fl["ts_90"].n_rows == 9
    assert fl["ts_60"].ts_format == "%H:%M:%S" and fl["ts_60"].n_rows == 4
    assert fl["ts_time"].duration_s == 3.0
    assert fl["ts_doy"].sampling_rate_hz == 1.0
    assert fl["ts_60"].median_interval_s == 2.0


def test_dropped_rows_renumbered(samples, issues):
    rows = sorted({r.row_no for r in samples["ts_60"]})
    assert rows == [0, 1, 2, 3]
    assert ("INVALID_TIMESTAMP", None, None, 6) in issues["ts_60"]
    assert ("INVALID_TIMESTAMP", None, None, 1) in issues["ts_90"]


def test_midnight_elapsed_against_minimum(samples):
    el = [r.value for r in samples["ts_midnight"] if r.parameter == ELAPSED_COLUMN]
    assert el == [86399.0, 0.0, 1.0]


def test_numeric_threshold(params, issues):
    assert params["num_80"] == [("A", False)]
    assert params["num_odd"] == [("A", True)]
    assert ("NON_NUMERIC", None, "A", 2) in issues["num_odd"]


def test_duplicate_timestamps(issues, samples):
    assert ("DUPLICATE_TIMESTAMPS", None, None, 1) in issues["time_dup"]
    el = [r.value for r in samples["time_dup"] if r.parameter == ELAPSED_COLUMN]
    assert el == [1.0, 1.0, 0.0]


def test_constant_and_low_variety(issues):
    assert ("CONSTANT", None, "B", 1) in issues["ts_doy"]


def test_read_recordings_files_in_many_splits(spark, tmp_path):
    text = "﻿Description,A\r\nEU,deg\r\n" + "".join(f"001:00:00:{i:02d}.5,{i}\r\n" for i in range(40))
    (tmp_path / "f1.csv").write_bytes(text.encode("utf-8"))
    (tmp_path / "f2.txt").write_bytes("Description,B\nEU,-\n1:00:00:00.0,1\n1:00:00:01.0,2\n".encode())
    lines = read_recordings(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 2  # small split size in the test session
    got = {(r.flight_id, r.line_no): r.line for r in lines.collect()}
    assert got[("f1", 0)].startswith("﻿Description") or got[("f1", 0)].startswith("Description")
    assert got[("f1", 41)].startswith("001:00:00:39.5")
    # no empty line after the final newline
    assert sorted(k[1] for k in got if k[0] == "f1") == list(range(len(text.split("\n")) - 1))
    rec = ingest(lines)
    a = [r.value for r in rec.samples.filter(F.col("parameter") == "A (deg)").orderBy("flight_id", "row_no").collect()]
    assert a == [float(i) for i in range(40)]
