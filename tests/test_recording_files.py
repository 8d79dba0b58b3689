"""Recording files on disk: identity of files, refusals, exports that lose nothing."""

import json

import pytest
from pyspark.sql import functions as F

from aerolytics.operators import export, outliers, spectrum
from aerolytics.operators.ingest import ingest
from aerolytics.plans.quantiles import quantile_columns
from aerolytics.sources.recordings import lines_from_text, read_recordings, write_recordings
from tests.helpers import series_samples

TEXT = "Description,A\nEU,deg\n001:00:00:00.0,{}\n001:00:00:01.0,2\n"


def test_files_of_one_name_stay_apart_and_names_are_decoded(spark, tmp_path):
    for folder, value in (("a", 1), ("b", 5)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "233.csv").write_text(TEXT.format(value))
    (tmp_path / "a" / "my flight+1.csv").write_text(TEXT.format(7))
    lines = read_recordings(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    rec = ingest(lines)
    first = {r.flight_id: r.value for r in rec.samples.filter("row_no = 0 and parameter = 'A (deg)'").collect()}
    assert sorted(k.rsplit("/", 2)[-2:] if "/" in k else k for k in first if k != "my flight+1") == [
        ["a", "233.csv"], ["b", "233.csv"]]
    assert first["my flight+1"] == 7.0 and sorted(first.values()) == [1.0, 5.0, 7.0]


def test_a_long_recording_is_written_in_parts_and_read_as_one(spark, tmp_path):
    rows = [(f, i, f"{f} line {i}" if i % 9 else "") for f, n in (("long one", 100), ("b", 3)) for i in range(n)]
    lines = spark.createDataFrame(rows, "flight_id string, line_no long, line string").repartition(3)
    write_recordings(lines, str(tmp_path / "r"), part_bits=3)
    sizes = {str(p.parent.relative_to(tmp_path / "r")): p.read_text().count("\n") for p in (tmp_path / "r").rglob("*.txt")}
    assert len(sizes) == 14 and max(sizes.values()) == 8 and sum(sizes.values()) == 103
    back = read_recordings(spark, str(tmp_path / "r"), flight_id_from="parts").collect()
    assert sorted((r.flight_id.split("flight_id=")[1], r.line_no, r.line) for r in back) == sorted(rows)


def test_exports_keep_own_columns_order_and_mixed_kinds(spark, tmp_path):
    rec = ingest(lines_from_text(spark, {
        "fA": "Description,Z,M\nEU,-,-\n1:00:00:00.0,1,2.5\n1:00:00:01.0,3,4.5\n",
        "fB": 'Description,M,only b\nEU,-,-\n1:00:00:00.0,x"y,1\n1:00:00:01.0,z,2\n'}))
    export.export_json(rec.samples, str(tmp_path / "j"), "2024-01-01", [{"id": "c", "parameters": ("Z",)}], rec.parameters)
    rows = {}
    for r in spark.read.text(str(tmp_path / "j" / "data")).collect():
        rows.setdefault(r.flight_id, []).append(json.loads(r.value))
    a, b = (sorted(rows[f], key=lambda x: x["Timestamp"]) for f in ("fA", "fB"))
    assert list(a[0]) == ["Timestamp", "Z", "M", "Elapsed Time (s)"] and [x["M"] for x in a] == [2.5, 4.5]
    assert list(b[0]) == ["Timestamp", "M", "Description only b", "Elapsed Time (s)"] or list(b[0])[1] == "M"
    assert [x["M"] for x in b] == ['x"y', "z"]
    meta = {r.flight_id: r for r in spark.read.json(str(tmp_path / "j" / "metadata")).collect()}
    assert meta["fA"].columns == ["Timestamp", "Z", "M", "Elapsed Time (s)"]
    assert json.loads(meta["fA"].charts) == [{"id": "c", "parameters": ["Z"]}] and meta["fA"].charts_count == 1
    export.export_csv(rec.samples, str(tmp_path / "c"), parameters=rec.parameters)
    text = [r.value for r in spark.read.text(str(tmp_path / "c" / "data" / "flight_id=fB")).collect()]
    assert text[0].startswith("Timestamp,M,") and '"x""y"' in text[1]


def test_validation_of_nothing_is_an_error(spark):
    s = series_samples(spark, {"f": {"a": [1.0]}})
    rows = export.validate_export(s.limit(0)).collect()
    assert [(r.flight_id, r.severity, r.code) for r in rows] == [(None, "error", "NO_DATA")]


def test_infinite_values_flag_nothing_by_themselves(spark):
    inf = float("inf")
    s = series_samples(spark, {"f": {"a": [1.0, 2.0, 3.0] * 6 + [inf, 4.0], "b": [inf] * 20}})
    assert outliers.outliers(s, ["a", "b"], "zscore").where("is_outlier").count() == 0
    flagged = outliers.outliers(s, ["a", "b"], "iqr", 1.5).where("is_outlier").collect()
    assert [(r.parameter, r.row_no) for r in flagged] == [("a", 18)]


@pytest.mark.parametrize("final_rows", [4, 50])
def test_quantiles_of_extreme_exponents_are_all_closed(spark, final_rows):
    values = [2.0 ** e for e in range(-1000, 991, 10)] + [-(2.0 ** e) for e in range(-900, 900, 45)] + [0.0] * 30
    df = spark.createDataFrame([("g", v) for v in values], "flight string, v double")
    got = quantile_columns(df, ["flight"], "v", [0.0, 0.1, 0.5, 0.9, 1.0], ["a", "b", "c", "d", "e"], final_rows=final_rows)
    import numpy as np
    want = np.quantile(np.array(values), [0.0, 0.1, 0.5, 0.9, 1.0])
    assert [got.first()[c] for c in "abcde"] == pytest.approx(want.tolist(), rel=1e-12)


def test_both_fft_paths_agree_on_zero_step_and_missing_values(spark):
    s = series_samples(spark, {"f": {"a": [1.0, 5.0, 2.0, 7.0, 1.0, 0.0], "b": [1.0, None, 2.0, 3.0, 4.0, 5.0]}}, dt=0.0)
    one, many = (sorted((r.parameter, r.bin, repr(r.frequency_hz), None if r.amplitude is None else round(r.amplitude, 9))
                        for r in spectrum.fft_spectrum(s, single_task_max=m).collect()) for m in (100, 2))
    assert one == many


def test_chirp_angles_are_exact_beyond_32_bits():
    import numpy as np
    n = (1 << 41) - 3
    j = np.array([0, 1, 12345, n - 1, n // 2, 2 * n - 1], np.int64)
    assert spectrum._square_mod(j, 2 * n).tolist() == [int(x) * int(x) % (2 * n) for x in j.tolist()]
    col = spectrum._square_mod(F.col("j"), F.lit(2 * n))
    assert col is not None
