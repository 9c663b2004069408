import datetime as dt
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F
from test_spacing_and_archive import FILES

from sparkgap import cli
from sparkgap.settings import Settings, read_profile, write_profile
from sparkgap.sinks import reports
from sparkgap.sources import assignment_files as imp
from sparkgap.streaming import measurement_stream as ms


def test_json_import(spark, tmp_path):
    good = {"final_class": "GND", "final_voltage_v": 0, "confidence": "High", "severity": "Info", "review_state": "Approved"}
    content = {"schema_version": 1, "file_kind": "snapshot", "assignments": {"GND": good, "X": {**good, "final_class": "NOPE"}, "Y": {**good, "final_voltage_v": "abc"}, "Z": {**good, "final_voltage_v": None}}}
    (tmp_path / "a.json").write_text(json.dumps(content))
    (tmp_path / "b.json").write_text(json.dumps({**content, "schema_version": 2}))
    (tmp_path / "c.json").write_text("[]")
    out = {(r.source_file.rsplit("/", 1)[1], r.net_name): (r.problem, r.final_voltage_v) for r in imp.read_json(spark, str(tmp_path)).collect()}
    assert out == {
        ("a.json", "GND"): (None, 0.0), ("a.json", "X"): ("final_class", 0.0), ("a.json", "Y"): ("final_voltage_v", None), ("a.json", "Z"): (None, None),
        ("b.json", None): ("newer schema_version", None), ("c.json", None): ("no assignments", None),
    }


def test_csv_import(spark, tmp_path):
    head = "net_name,final_class,assigned_voltage_v,confidence,severity,review_state\n"
    path = tmp_path / "a.csv"
    path.write_text(head + "GND,GND,0,High,Info,Approved\nX,GND,inf,High,Info,Approved\nY,GND,,High,Info,?\n")
    out = {r.net_name: r.problem for r in imp.read_csv(spark, str(path)).collect()}
    assert out == {"GND": None, "X": "final_voltage_v", "Y": "review_state"}
    path.write_text(head + "GND,GND,0,High,Info,Approved\nGND,GND,0,High,Info,Approved\n")
    with pytest.raises(imp.ImportRejected):
        imp.read_csv(spark, str(path))
    path.write_text("net_name\nA\n")
    with pytest.raises(imp.ImportRejected):
        imp.read_csv(spark, str(path))


def test_reports(spark, tmp_path):
    rows = [("L", "A", "B", 0.3, None), ("K", "A", "C", 0.1, 5.0), ("K", "A", 'q"|', 0.1, 12.0)]
    df = spark.createDataFrame(rows, "layer string, net_a string, net_b string, clearance_mm double, v double")
    paths = reports.write_reports({"measurements": df, "effective_gaps": df.limit(0)}, str(tmp_path))
    names = {os.path.basename(p) for p in paths}
    assert names == {"net_to_net_measurements_full.csv", "net_to_net_critical_under_0p2mm.csv", "report.md", "report.xlsx", "report.zip"}
    assert (tmp_path / "net_to_net_measurements_full.csv").read_text().splitlines() == ["layer,net_a,net_b,clearance_mm,v", "K,A,C,0.1,5.0", 'K,A,"q""|",0.1,12.0', "L,A,B,0.3,"]
    assert "| K | A | C | 0.1 | 5 |" in (tmp_path / "report.md").read_text()
    with zipfile.ZipFile(tmp_path / "report.xlsx") as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
        assert "<v>0.1</v>" in sheet and "q&quot;|" in sheet or 'q"|' in sheet
    with zipfile.ZipFile(tmp_path / "report.zip") as z:
        assert "report.xlsx" in z.namelist()
    assert reports.revision_file("Rev B/2") == "net_voltage_assignments_Rev_B_2.json" and reports.short_number(12.0) == "12" and reports.short_number(None) == ""
    now = dt.datetime(2030, 1, 2, 3, 4, 5)
    assert [os.path.basename(reports.run_folder(str(tmp_path), now)) for _ in range(2)] == ["run_20300102_030405", "run_20300102_030405_001"]


def test_profile_round_trip(tmp_path):
    path = str(tmp_path / "p.json")
    write_profile(Settings(cti=600, layers=("F.CU",), galvanic_zone_matrix={"Zone 1": {"Zone 2": 5}}), path)
    assert read_profile(path) == Settings(cti=600, layers=("F.CU",), galvanic_zone_matrix={"Zone 1": {"Zone 2": 5}})
    (tmp_path / "bad.json").write_text("[]")
    with pytest.raises(ValueError):
        read_profile(str(tmp_path / "bad.json"))


def test_stream_counts_windows_and_drops_repeats(spark, tmp_path):
    t = lambda h: dt.datetime(2030, 1, 1, h)
    rows = [(1, "j", 0.1, t(1), t(1)), (1, "j", 0.1, t(1), t(2)), (2, "j", 0.5, t(1), t(1)), (3, "j", None, t(1), t(1)), (4, "k", float("nan"), t(1), t(1)), (5, "j", 0.3, t(9), t(9))]
    df = spark.createDataFrame(rows, "measurement_id bigint, job_id string, clearance_mm double, measured_at timestamp, loaded_at timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, frame, mode in (("once", ms.deduplicated(stream), "append"), ("counts", ms.critical_counts(stream), "complete")):
        query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
    assert spark.table("once").count() == 5
    got = {(r.window_start.hour, r.n_pairs, r.n_critical, r.least_mm) for r in spark.table("counts").filter(F.col("job_id") == "j").collect()}
    assert {g[1:] for g in got} == {(3, 2, 0.1), (1, 0, 0.3)}


def test_late_corrections_replace_what_was_kept(spark, tmp_path):
    t = lambda d: dt.datetime(2030, 1, d)
    schema = "measurement_id bigint, job_id string, clearance_mm double, measured_at timestamp, loaded_at timestamp"
    deliveries = [[(1, "j", 0.1, t(1), t(1)), (1, "j", 0.15, t(1), t(2)), (2, "j", 0.5, t(20), t(20)), (None, "j", 0.3, t(1), t(1))], [(1, "j", 0.9, t(1), t(25)), (3, "j", None, t(1), t(26)), (None, "j", 0.3, t(1), t(1))], [(1, "j", 0.2, t(1), t(3))]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for rows in deliveries:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = ms.kept_deliveries(stream, str(tmp_path / "kept")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = sorted((r.measurement_id or 0, r.clearance_mm) for r in ms.last_deliveries(spark, str(tmp_path / "kept")).collect())
    assert got == [(0, 0.3), (0, 0.3), (1, 0.9), (2, 0.5), (3, None)]


def test_command_line(spark, tmp_path, capsys):
    board = tmp_path / "boards"
    board.mkdir()
    with zipfile.ZipFile(board / "one.zip", "w") as z:
        for name, text in FILES.items():
            z.writestr(name, text)
    assert cli.main([str(board), "--output", str(tmp_path / "out"), "--within-mm", "3"], spark) == 0
    folder = capsys.readouterr().out.strip()
    lines = open(os.path.join(folder, "net_to_net_measurements_full.csv")).read().splitlines()
    assert len(lines) == 2 and ",GND,SIG," in lines[1]
    assert cli.main([str(tmp_path / "nowhere"), "--output", str(tmp_path)], spark) in (1,)
