"""Faults found by review: data that the given tables don't hold."""

import random
import re
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotaflow.operators import features, fleet, model, status
from rotaflow.operators.status import DEVIATIONS
from rotaflow.plans import carry
from rotaflow.plans.medians import medians
from rotaflow.plans.timeline import Timeline
from rotaflow.streaming.folds import Rolling
from rotaflow.streaming.ordered import Delays, _Ordered
from suite.queries import QUERIES, Given, _arriving
from test_edge import CountedStore

START = datetime(2024, 1, 1)


@pytest.mark.parametrize("max_rows", [10, 2_000_000])
def test_medians_ignore_what_is_no_number(spark, max_rows):
    values = [float(v) for v in range(1, 102)] + [float("nan"), float("inf"), None]
    rows = [("a", v) for v in values] + [(None, 1.0)] * 20 + [("b", 2.0)]
    found = medians(spark.createDataFrame(rows, "k string, v double"), "k", {"m": F.col("v")}, max_rows)
    assert {tuple(r) for r in found.collect()} == {("a", 51.0), ("b", 2.0)}


def _history(spark, n=1400):
    """Two machines at irregular times, one with repeated instants and gaps, and readings of no machine."""
    rng = random.Random(3)
    rows, at = [], START
    for i in range(n):
        at += timedelta(minutes=rng.choice([0, 7, 30, 60, 600]))
        values = [None if rng.random() < 0.02 else rng.uniform(-20, 30) for _ in DEVIATIONS]
        rows.append(("Well 1" if i % 4 else "Well 2", at, i, *values))
    rows += [(None, START, 10_000 + i, 1.0, 1.0, 1.0, 1.0) for i in range(300)]
    schema = "well_id string, ts timestamp_ntz, reading_id long, " + ", ".join(f"{d} double" for d in DEVIATIONS)
    return spark.createDataFrame(rows, schema)


def _in_sql(rows, statement):
    readings = rows.where("well_id IS NOT NULL").toPandas()  # noqa: F841
    return duckdb.sql(statement).fetchall()


def _close(made, want):
    assert len(made) == len(want)
    for a, b in zip(made, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert (x is None or x != x) == (y is None or y != y) and (x is None or x == y or x == pytest.approx(y, abs=1e-7))


@pytest.mark.parametrize("max_rows", [10**6, 150])
def test_frames_of_any_length(spark, max_rows):
    rows = _history(spark)
    timeline = Timeline.of(rows, max_rows=max_rows, halo=20)
    assert timeline.sliced == (max_rows == 150)
    windows = (24, 100, 480, 5000)
    made = features.engineer_features(rows, timeline, windows).orderBy("well_id", "ts", "reading_id")
    names = [f"flow_rolling_{s}_{n}h" for n in windows for s in ("mean", "std", "max", "min")] + ["head_slope_480h"]
    parts = []
    for n in windows:
        frame = f"(PARTITION BY well_id ORDER BY ts, reading_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        parts += [f"avg(flow_deviation_pct) OVER {frame}", f"CASE WHEN count(flow_deviation_pct) OVER {frame} > 1 THEN stddev_samp(flow_deviation_pct) OVER {frame} ELSE 0 END",
                  f"max(flow_deviation_pct) OVER {frame}", f"min(flow_deviation_pct) OVER {frame}"]
    slope = "coalesce((head_deviation_pct - lag(head_deviation_pct, 480) OVER (PARTITION BY well_id ORDER BY ts, reading_id)) / 480, 0)"
    want = _in_sql(rows, f"SELECT well_id, reading_id, {', '.join(parts)}, {slope} FROM readings ORDER BY well_id, ts, reading_id")
    _close([tuple(r) for r in made.select("well_id", "reading_id", *names).collect()], want)


@pytest.mark.parametrize("max_rows", [10**6, 150])
def test_frames_by_time(spark, max_rows):
    rows = _history(spark)
    timeline = Timeline.of(rows, max_rows=max_rows, halo=2)
    made = features.rolling_time(rows, timeline, 24.0, ["flow_deviation_pct"]).orderBy("well_id", "ts", "reading_id")
    frame = "(PARTITION BY well_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)"
    c = "flow_deviation_pct"
    want = _in_sql(rows, f"SELECT well_id, reading_id, count(*) OVER {frame}, avg({c}) OVER {frame}, coalesce(stddev_samp({c}) OVER {frame}, 0), max({c}) OVER {frame}, min({c}) OVER {frame} FROM readings ORDER BY well_id, ts, reading_id")
    _close([tuple(r) for r in made.select("well_id", "reading_id", "readings", *[f"{c}_{s}" for s in ("mean", "std", "max", "min")]).collect()], want)


def test_long_history_rules_are_the_same_with_slices(spark, folder):
    given = Given(spark, folder)
    plain, cut = Given(spark, folder), Given(spark, folder, max_rows=100)
    cut.__dict__["timeline"] = Timeline.of(cut.telemetry, max_rows=100, halo=5)
    for make in (
        lambda g: status.analyse(g.telemetry, g.fleet, g.timeline, history_window=200).select("well_id", "ts", "reading_number", "sustained", "status"),
        lambda g: status.deviation_trend(given.deviations, g.timeline, 300),
    ):
        assert make(plain).exceptAll(make(cut)).isEmpty()



def test_rows_without_a_machine_are_not_hot(spark):
    rows = spark.range(300).select(F.lit(None).cast("string").alias("well_id"), F.col("id").alias("ts"), F.col("id").alias("reading_id"))
    assert not Timeline.of(rows, max_rows=50, numeric_clock=True).sliced


def test_one_baseline_per_machine(spark):
    rows = spark.createDataFrame([("a", 2.0, 1.0), ("a", 1.0, 9.0), (None, 1.0, 1.0)], "well_id string, flow double, head double")
    assert [tuple(r) for r in fleet.one_baseline(rows).collect()] == [("a", 1.0, 9.0)]


def test_site_files_are_written_by_many_tasks(spark, folder, tmp_path, monkeypatch):
    """One small file of machines, a file a machine: no single task may write them all."""
    monkeypatch.setattr(Given, "path", lambda self, name: f"{tmp_path}/{name}")
    rows = QUERIES["load_site_config"](Given(spark, folder)).count()
    files = [f for f in Path(f"{tmp_path}/sites").glob("part-*.json") if f.stat().st_size]  # Spark's first task writes one without rows
    assert len(files) * 4 == rows
    assert len({re.match(r"part-(\d+)", f.name)[1] for f in files}) > 1


def test_newest_readings_are_predicted_from_the_table_of_the_fit(spark, folder, monkeypatch):
    """Features are made once, for the fit and for the newest readings."""
    made, real = [], features.engineer_features
    monkeypatch.setattr(features, "engineer_features", lambda *given: made.append(1) or real(*given))
    given = Given(spark, folder)
    plan = status.latest_reading(given.split)._jdf.queryExecution().optimizedPlan().toString()
    assert made == [1] and "Window" not in plan


def _training_inputs(spark):
    """Missing values, machines shorter than a frame, a machine with two failure times and one without."""
    rng = random.Random(5)
    rows = []
    for machine, n in (("a", 700), ("b", 400), ("c", 9), ("d", 30)):
        for i in range(n):
            rows.append((machine, START + timedelta(hours=i // 2), i, *[None if rng.random() < 0.1 else rng.uniform(-20, 30) for _ in DEVIATIONS]))
    deviations = spark.createDataFrame(rows, "well_id string, ts timestamp_ntz, reading_id long, " + ", ".join(f"{d} double" for d in DEVIATIONS))
    ends = [("a", START + timedelta(days=9)), ("b", START + timedelta(days=5)), ("b", START + timedelta(days=7)), ("c", None), (None, START)]
    return deviations, spark.createDataFrame(ends, "well_id string, failure_ts timestamp_ntz")


@pytest.mark.parametrize("max_rows", [10**6, 150])
def test_training_rows_made_in_batches(spark, max_rows):
    """The same rows as from windows, with one exchange of narrow readings, in batches that machines do not fit into."""
    deviations, failures = _training_inputs(spark)
    timeline = Timeline.of(deviations, max_rows=max_rows, halo=20)
    assert timeline.sliced == (max_rows == 150)
    if timeline.sliced:  # numbers of slices count each reading once
        failures = failures.dropDuplicates(["well_id"])
    labelled = features.rul_labels(features.engineer_features(deviations, timeline), failures)
    want = features.chronological_split(labelled, timeline)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        made = [tuple(r) for r in features.training_table(deviations, timeline, failures).select(*want.columns).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    wanted = [tuple(r) for r in want.collect()]
    at = {c: k for k, c in enumerate(want.columns)}
    # of two rows of one reading either may be the last before the test part
    place = lambda r: (r[at["well_id"]], r[at["ts"]], r[at["reading_id"]], r[at["rul_days"]])
    plain = lambda rows: [r[:-1] for r in sorted(rows, key=place)]
    _close(plain(made), plain(wanted))
    tests = lambda rows: sorted((r[at["well_id"]], r[at["ts"]], r[at["reading_id"]]) for r in rows if r[at["is_test"]])
    assert tests(made) == tests(wanted)


def test_lines_are_trained_without_a_wide_table(spark, folder, monkeypatch):
    """A line over all features needs their moments only: nothing is stored, and two passes give what the stored table gives."""
    given = Given(spark, folder)
    batches = features.training_batches(given.deviations, given.timeline, given.failures)
    want = model.train_rul(given.split, model_type="linear", is_stored=True)
    monkeypatch.setattr(model, "stored", None)
    made = model.train_line(spark, batches)
    rows = lambda t: [tuple(r) for r in t.metrics.orderBy("part").collect()]
    _close(rows(made), rows(want))
    train = given.split.where("NOT is_test").withColumn("rul_days", F.col("rul_days").cast("double"))
    plain = Pipeline(stages=[VectorAssembler(inputCols=made.features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True), model._regressor("linear", "rul_days", 0, 0)]).fit(train)
    assert made.model.stages[-1].coefficients.toArray() == pytest.approx(plain.stages[-1].coefficients.toArray(), abs=1e-6)
    assert made.model.stages[-1].intercept == pytest.approx(plain.stages[-1].intercept, abs=1e-7)


def test_rows_with_missing_features_are_not_trained_on_silently(spark):
    split = spark.createDataFrame([(1.0, 2.0, False), (None, 3.0, False), (2.0, 5.0, True)], "x double, rul_days double, is_test boolean")
    with pytest.raises(Exception, match="no finite number"):
        model.train_rul(split, model_type="linear", features=["x"])


def test_state_is_called_by_groups_of_machines_not_by_machine(spark):
    """300 machines with a few readings each in one group: calls to the state, frames and timers don't follow the machines, rows are each machine's own."""
    machines, n, delays = 300, 40, Delays(order=120, late=30)
    kept = T.StructType.fromDDL("tick long, reading_id struct<a: long>, flow double, head double, power double, efficiency double")
    rng = random.Random(4)
    rows = [(f"Well {m}", k * 600_000_000, {"a": k}, None if (m + k) % 7 == 0 else float(m + k), 1.0, 2.0, 3.0) for k in range(n) for m in range(machines)]
    store, made = CountedStore(), []
    processor = _Ordered(Rolling(24, 30), kept, delays)
    processor.init(store)
    for low in (0, n // 2):
        part = rows[low * machines : (low + n // 2) * machines]
        rng.shuffle(part)
        made += processor.handleInputRows((7,), iter([pd.DataFrame(part, columns=["well_id", *kept.names])]), None)
        mark = 10**9
        for at in list(store.timers) if low else ():
            made += processor.handleExpiredTimer((7,), type("Now", (), {"getCurrentWatermarkInMs": staticmethod(lambda: mark)}), None)
            store.timers.discard(at)
    assert store.calls < machines and len(made) < machines / 10 and not store.entries
    out = pd.concat(made)
    assert len(out) == len(rows)
    for m in (0, 150, 299):
        own = out[out["well_id"] == f"Well {m}"]
        assert own["reading_id"].map(lambda r: r["a"]).tolist() == list(range(n))
        assert own["readings"].tolist() == [min(k + 1, 24) for k in range(n)] and own["ready"].tolist() == [k >= 29 for k in range(n)]
        assert own["recent_flow_max"].iloc[-1] == max(m + k for k in range(n - 24, n) if (m + k) % 7)


def test_arrivals_are_written_once_by_all_cores_in_order_of_time(spark, folder, monkeypatch, tmp_path):
    monkeypatch.setattr(Given, "path", lambda self, name: f"{tmp_path}/{name}")
    given = Given(spark, folder)
    _arriving(given)
    parts = sorted(Path(f"{tmp_path}/arrivals").glob("part=*"))
    times = [{f.stat().st_mtime for f in part.glob("*.parquet")} for part in parts]
    assert len(parts) == 6 and all(len(t) == 1 for t in times) and [min(t) for t in times] == sorted(min(t) for t in times)
    assert all(len(list(part.glob("*.parquet"))) > 2 for part in parts[:-1])
    assert spark.read.parquet(*map(str, parts[:-1])).count() == given.telemetry.count()


def test_newest_rows_and_saved_models_need_no_wide_table(spark, folder, monkeypatch):
    """The newest row of each machine comes from the batches, cut anywhere; nothing is stored for a line that is saved and loaded."""
    given = Given(spark, folder)
    want = status.latest_reading(given.split)
    columns = ["well_id", "ts", "reading_id", *model.feature_names()]
    monkeypatch.setattr(model, "stored", None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        made = features.training_batches(given.deviations, given.timeline, given.failures).newest().select(*columns).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    _close(sorted(map(tuple, made)), sorted(map(tuple, want.select(*columns).collect())))
    rows = QUERIES["save_load_model"](Given(spark, folder)).collect()
    assert len(rows) == len(made) and {r["model_type"] for r in rows} == {"linear"}


def test_readings_dealt_by_machine_are_not_dealt_again_for_batches(spark, monkeypatch):
    """Behind a join by shuffle, features in batches need no further exchange of the readings."""
    deviations, failures = _training_inputs(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = features.training_batches(deviations, Timeline.of(deviations), failures).rows
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2  # the readings, and the failures


@pytest.mark.parametrize("max_rows", [10**6, 150])
def test_statuses_and_features_of_a_batch_come_together(spark, tmp_path, max_rows):
    """The rows of the join by key, repeated readings included, without the join."""
    rng = random.Random(8)
    rows = []
    for machine, n in (("a", 200), ("b", 90), ("c", 5)):
        for i in range(n):
            rows += [(machine, START + timedelta(hours=i // 2), i, *[500 + rng.uniform(-90, 90), 150 + rng.uniform(-20, 20), 25.0, 75.0, 85.0, 1750.0])] * (2 if i % 17 == 0 else 1)
    schema = "well_id string, ts timestamp_ntz, reading_id long, flow double, head double, suction double, power double, efficiency double, speed double"
    readings = spark.createDataFrame(rows, schema)
    machines = spark.createDataFrame([(m, "T", 100.0, "API", 500.0, 150.0, 75.0, 85.0) for m in "abc"], "well_id string, pump_type string, horsepower double, application string, baseline_flow double, baseline_head double, baseline_power double, baseline_efficiency double")
    limits = fleet.fleet_limits(machines, fleet.default_tolerances(spark))
    cut = START + timedelta(hours=40)
    seen = 0
    for number, part in enumerate((readings.where(F.col("ts") < F.lit(cut)), readings.where(F.col("ts") >= F.lit(cut)))):
        made = carry.advance(part, limits, f"{tmp_path}/carry", number, max_rows)
        key = ["well_id", "ts", "reading_id"]
        names = [*key, *carry.TOLD, "flow_rolling_mean_168h", "head_slope_168h", "power_cumulative_deviation", "hours_since_start"]
        got, want = ([tuple(r) for r in df.select(*names).collect()] for df in (made.together, made.classified.select(*key, *carry.TOLD).join(made.features, key)))
        seen += len(got)
        place = lambda r: r[:3]
        assert sorted(map(place, got)) == sorted(map(place, want))
        once = lambda rows: sorted(r for r in rows if r[2] % 17)  # noqa: E731  of two equal readings either may be the first
        _close(once(got), once(want))
    repeated = sum(1 for machine, n in (("a", 200), ("b", 90), ("c", 5)) for i in range(n) if i % 17 == 0)
    assert seen == 295 + 3 * repeated
    plan = made.together._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
