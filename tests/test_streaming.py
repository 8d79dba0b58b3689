"""Recordings dropped into a folder are ingested by the stream."""

from aerolytics.streaming import start_ingest_stream


def test_stream_ingests_new_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "f1.csv").write_text("Description,A\nEU,deg\n001:00:00:00.0,1\n001:00:00:01.0,2\n")
    q = start_ingest_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "chk"), available_now=True)
    q.awaitTermination(120)
    (src / "f2.csv").write_text("Description,B\nEU,-\n10:00:00,5\n10:00:02,6\n10:00:04,7\n")
    q = start_ingest_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "chk"), available_now=True)
    q.awaitTermination(120)
    s = spark.read.parquet(str(tmp_path / "out" / "samples"))
    got = sorted((r.flight_id, r.parameter, r.value) for r in s.filter("parameter <> 'Elapsed Time (s)'").collect())
    assert got == [("f1", "A (deg)", 1.0), ("f1", "A (deg)", 2.0), ("f2", "B", 5.0), ("f2", "B", 6.0),
                   ("f2", "B", 7.0)]
    fl = {r.flight_id: r.n_rows for r in spark.read.parquet(str(tmp_path / "out" / "flights")).collect()}
    assert fl == {"f1": 2, "f2": 3}
