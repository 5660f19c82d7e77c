"""Readers, writers and the anomaly log on small files."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rotaflow import fixed_values as V
from rotaflow.operators import anomaly_log, convert, debounce, fleet, quality
from rotaflow.plans.timeline import Timeline
from rotaflow.sources import headers, readers, writers

HEADER = ",".join(V.TELEMETRY_COLUMNS)


def test_telemetry_file(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        HEADER + "\n5/1/2024 0:00,Well 1,505,148,25,76,85.2,1760\n"
        "2024-05-01 01:00:00,Well 1,,152,26,77,84.8,1765\n5/1/2024 2:00,Well 2,1,2,3,4,5,6\n"
    )
    rows = readers.read_telemetry(spark, str(path), ["Well 1"]).orderBy("ts").collect()
    assert [r["ts"] for r in rows] == [datetime(2024, 5, 1, 0), datetime(2024, 5, 1, 1)]
    assert rows[0]["flow"] == 505.0 and rows[1]["flow"] is None


def test_missing_columns_raise(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("timestamp,Well ID,Flow\n5/1/2024 0:00,Well 1,505\n")
    with pytest.raises(ValueError, match="Flow .gpm."):
        readers.read_telemetry(spark, str(path))


def test_unknown_well_names_known_ones(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(HEADER + "\n5/1/2024 0:00,Well 1,505,148,25,76,85.2,1760\n")
    source = readers.read_telemetry(spark, str(path))
    with pytest.raises(ValueError, match="Well 1"):
        readers.require_rows(source.where("well_id = 'x'"), source, "x")


def test_damaged_headers(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text(
        'Site,Date,Snapshot,"4 Line Current Flow (gal/min)""","4 Line FT Head (ft)""",'
        '"4 Line Pressure (psi)""",Power Monitor A Current Average (A)\n'
        "Test Pit,8/21 9:55:38 am (CDT),FALSE,252.33,173.98,75.31,23.5\n"
    )
    row = readers.read_curve_test(spark, str(path)).first()
    assert (row["site"], row["flow_gpm"], row["current_a"]) == ("Test Pit", 252.33, 23.5)


def test_tolerance_file_equals_default(spark, tmp_path):
    cell = lambda m, hi, lo, b: {
        "mandatory": m, "max_deviation": 999 if hi is None else hi,
        "min_deviation": -999 if lo is None else lo, "bidirectional": b, "note": "",
    }
    nested = {
        "categories": {
            c: {"name": c, "application": c,
                "tolerances": {p: cell(*values) for p, values in cells.items()}}
            for c, cells in V.TOLERANCES.items()
        }
    }
    path = tmp_path / "tolerances.json"
    path.write_text(json.dumps(nested, indent=1))
    read = readers.load_tolerances(spark, str(path))
    default = fleet.default_tolerances(spark)
    assert read.count() == 24
    assert read.select(default.columns).exceptAll(default).isEmpty()
    with pytest.raises(ValueError):
        readers.load_tolerances(spark, str(path), "9Z")


def test_site_config(spark, tmp_path):
    path = tmp_path / "site.json"
    path.write_text(json.dumps({
        "site_info": {"site_id": 35482, "pump_id": 1, "sensor_ids": {"flow": 101, "head": 102}},
        "anomaly_reporting": {"enabled": True, "report_on_status": ["Warning"]},
    }, indent=1))
    sites = readers.load_site_config(spark, str(path))
    row = sites.first()
    assert (row["debounce_minutes"], row["min_readings"], row["retention_days"]) == (60, 168, 30)
    found = {(r["param"], r["sensor_id"]) for r in readers.sensor_dimension(sites).collect()}
    assert found == {("flow", 101), ("head", 102)}


def test_log_takes_objects_and_text(spark, tmp_path):
    path = tmp_path / "log.json"
    context = {"status": "Failure", "tolerance_category": "1U"}
    rows = [
        {"id": 1, "pumpId": 7, "timestamp": "2024-01-01T00:00:00Z", "additionalContext": context},
        {"id": 2, "pumpId": 7, "timestamp": "2024-01-02T00:00:00Z",
         "additionalContext": json.dumps(context)},
    ]
    path.write_text("\n".join(json.dumps(r) for r in rows))
    log = readers.read_anomaly_log(spark, str(path))
    assert [r["status"] for r in log.orderBy("id").collect()] == ["Failure"] * 2
    pages = tmp_path / "page.json"
    pages.write_text(json.dumps({"items": rows, "total": 2, "skip": 0, "take": 25}))
    assert readers.read_anomaly_pages(spark, str(pages)).count() == 2
    out = str(tmp_path / "csv")
    writers.write_anomaly_csv(log, out)
    back = spark.read.option("header", True).option("escape", '"').csv(out).first()
    assert json.loads(back["additionalContext"])["status"] == "Failure"


def test_outbox_batch_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "outbox")
    batch = spark.createDataFrame([("Well 1", 1)], "well_id string, n int")
    for _ in range(2):
        writers.append_outbox(batch, path, 3)
    writers.append_outbox(batch, path, 4)
    assert spark.read.parquet(path).count() == 2
    for _ in range(2):  # calls without a number add
        writers.append_outbox(batch, path)
    writers.append_outbox(batch, path, 3, "another run")
    assert spark.read.parquet(path).count() == 5


def test_date_bounds():
    now = datetime(2024, 3, 10, 12)
    assert anomaly_log.date_bounds("2024-01-01", None) == ("2024-01-01T00:00:00", None)
    assert anomaly_log.date_bounds("2024-01-01", "2024-01-02", 7, now) == (
        "2024-03-03T12:00:00", "2024-03-10T12:00:00",
    )


def test_strict_validation_raises(spark):
    bad = spark.range(3).select(
        F.lit("Well 1").alias("well_id"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"),
        *[F.lit(-1.0).alias(c) for c in quality.SENSORS],
    )
    with pytest.raises(ValueError):
        quality.validate(bad, strict=True)
    rules = {(r["rule"], r["column"]): r["readings"] for r in quality.validate(bad).collect()}
    assert rules[("negative", "flow")] == 3
    assert rules[("duplicate_timestamp", "ts")] == 2
    assert ("negative", "suction") not in rules


def test_filters_reach_the_scan(spark, folder, capsys):
    log = spark.read.parquet(f"{folder}/events.parquet").withColumnRenamed("user_id", "pumpId")
    anomaly_log.log_filter(log, pump_id=3, start="2024-01-05").select("event_id").explain()
    plan = capsys.readouterr().out
    assert "EqualTo(user_id,3)" in plan and "GreaterThanOrEqual(ts," in plan
    assert "props" not in plan

# -- files whose columns differ in order ----------------------------------------------


def _telemetry_files(folder, layouts):
    values = {"timestamp": "5/1/2024 {h}:00", "Well ID": "Well {w}", "Flow (gpm)": "{w}05.5", "Discharge Pressure (psi)": "1{h}.25"}
    for w, names in enumerate(layouts):
        cells = [values.get(n, "7").format(w=w, h="{h}") for n in names]
        lines = [",".join(names)] + [",".join(cells).format(h=h) for h in range(3)]
        (folder / f"log {w} [a].csv").write_text("\n".join(lines) + "\n")


def test_columns_are_read_by_name_in_every_file(spark, tmp_path):
    names = list(V.TELEMETRY_COLUMNS)
    swapped = [names[0], names[1], names[3], names[2], *names[4:]]
    _telemetry_files(tmp_path, [names, swapped, ["note", *reversed(names)], names])
    (tmp_path / "empty.csv").write_text("")
    rows = readers.read_telemetry(spark, str(tmp_path)).collect()
    assert len(rows) == 12
    for r in rows:
        w = int(r["well_id"].split()[1])
        assert (r["flow"], r["head"]) == (float(f"{w}05.5"), float(f"1{r['ts'].hour}.25"))
        assert (r["suction"], r["speed"]) == (7.0, 7.0)


def test_a_file_without_a_column_is_named(spark, tmp_path):
    names = list(V.TELEMETRY_COLUMNS)
    _telemetry_files(tmp_path, [names, [n for n in names if "Flow" not in n], names])
    with pytest.raises(ValueError, match=r"1 of 3 files: .*log%201.*Flow"):
        readers.read_telemetry(spark, str(tmp_path))


def test_the_header_index_is_one_job_that_stops_after_a_line(spark, tmp_path):
    names = list(V.TELEMETRY_COLUMNS)
    _telemetry_files(tmp_path, [names] * 60)
    context = spark.sparkContext
    context.setJobGroup("headers", "header index")
    found = headers.layouts(spark, str(tmp_path), names)
    context.setJobGroup("", "")
    assert found == [headers.Layout(tuple(names), ())]
    assert len(context.statusTracker().getJobIdsForGroup("headers")) <= 2  # the listing of many files, and the index
    assert readers.read_telemetry(spark, str(tmp_path)).count() == 180


def test_other_columns_stay(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Site,x`y,4 Line Current Flow (gal/min),4 Line FT Head (ft),4 Line Pressure (psi),Power Monitor A Current Average (A)\nA,1,2,3,4,5\n")
    (tmp_path / "b.csv").write_text("4 Line FT Head (ft),4 Line Current Flow (gal/min),Site,4 Line Pressure (psi),Power Monitor A Current Average (A)\n3,2,B,4,5\n")
    rows = {r["site"]: r for r in readers.read_curve_test(spark, str(tmp_path)).collect()}
    assert {(r["flow_gpm"], r["head_ft"], r["pressure_psi"], r["current_a"]) for r in rows.values()} == {(2.0, 3.0, 4.0, 5.0)}
    assert (rows["A"]["x`y"], rows["B"]["x`y"]) == ("1", None)


def test_baselines_are_one_per_machine(spark, tmp_path):
    header = ",".join(V.BASELINE_COLUMNS)
    (tmp_path / "b.csv").write_text(f"{header}\nWell 1,T,100,API,500,150,75,85\nWell 1,T,90,API,510,150,75,85\nWell 2,T,100,API,500,150,75,85\n")
    assert readers.read_baseline(spark, str(tmp_path)).count() == 2
    raw = readers.raw_baseline(spark, str(tmp_path))
    assert raw.count() == 3 and fleet.fleet_limits(raw, fleet.default_tolerances(spark)).count() == 2
    assert [tuple(r) for r in quality.baseline_violations(raw).collect()] == [("Well 1", "several baselines for one machine")]


def test_nan_in_a_vendor_log_is_missing(spark, tmp_path):
    (tmp_path / "v.csv").write_text(
        "SitePumpID,PumpLogDate,OutputCurrent,Pressure,VibrationLevel,Frequency,Running,PumpDepth,PumpID,FailTs\n"
        "1,2024-01-01 00:00:00,10,100,NaN,50,true,300,1,2024-02-15 00:00:00\n1,2024-01-01 01:00:00,12,100,0.5,50,true,300,1,2024-02-15 00:00:00\n"
    )
    log = readers.read_vendor_log(spark, str(tmp_path))
    stats = convert.vendor_statistics(log).first()
    assert stats["max_vibration"] == 0.5


def test_decisions_keep_repeated_readings(spark):
    rows = [("Well 1", datetime(2024, 5, 1, 0), 7, 1, "Warning", "a")] * 3 + [("Well 1", datetime(2024, 5, 1, 1), 8, 0, "Normal", "b")] * 2
    scored = spark.createDataFrame(rows, "well_id string, ts timestamp_ntz, reading_id int, mask int, status string, more string")
    made = debounce.with_decisions(scored, Timeline.of(scored), 60).collect()
    assert sorted((r["more"], r["blocked_by"]) for r in made if r["blocked_by"]) == [("a", "flow")] * 2
    assert len(made) == 5
