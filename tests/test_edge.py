"""The edge run: batch and chained stream give equal rows, whatever order readings arrive in; models per machine."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotaflow.operators import anomalies, debounce, edge, machine_models
from rotaflow.operators.fleet import default_tolerances, fleet_limits
from rotaflow.plans.timeline import Timeline
from rotaflow.streaming import live
from rotaflow.streaming.edge import stream_decisions, stream_edge_features, stream_edge_run
from rotaflow.streaming.ordered import PIECE, Delays, _Ordered, arriving, in_order, state_store
from rotaflow.streaming.folds import Debounce, Rolling

START = datetime(2024, 1, 1)
TELEMETRY = "well_id string, ts timestamp_ntz, reading_id struct<a: long, b: int>, flow double, head double, power double, efficiency double"
END = ("end", START + timedelta(days=3650), (0, 0), 500.0, 150.0, 75.0, 85.0)


def readings(machines=3, n=120):
    rng = random.Random(6)
    rows = []
    for m in range(machines):
        at = START
        for i in range(n if m else 3 * n):
            at += timedelta(minutes=rng.choice([0, 0, 5, 20, 45]))
            rows.append((f"Well {m}", at, (i, m), 500.0 + rng.choice([0, 0, 90, 120]), 150 + rng.choice([0, 15, 1.0]) * rng.random(), None if rng.random() < 0.05 else 75 + rng.random() * 12, 85.0 - rng.random()))
    return rows


def arrival(spark, rows, folder, parts=6, jitter_minutes=100):
    """Files in the order of arrival, which differs from event time by ``jitter_minutes`` at most; the last one ends the stream."""
    rng = random.Random(9)
    rows = sorted(rows, key=lambda r: r[1] + timedelta(minutes=rng.random() * jitter_minutes))
    step = -(-len(rows) // parts)
    for k in range(0, len(rows), step):
        part = rows[k : k + step]
        rng.shuffle(part)
        spark.createDataFrame(part, TELEMETRY).coalesce(1).write.mode("append").parquet(f"{folder}/{k // step:02d}")
    spark.createDataFrame([END], TELEMETRY).coalesce(1).write.parquet(f"{folder}/99")
    return spark.readStream.schema(TELEMETRY).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


@pytest.fixture(scope="module")
def given(spark):
    rows = readings()
    telemetry = spark.createDataFrame(rows, TELEMETRY)
    machines = spark.createDataFrame(
        [(f"Well {m}", "T", 100.0, app, 500.0, 150.0, 75.0, 85.0) for m, app in enumerate(["API", "Cooling Tower", "Municipal Water and Wastewater"])],
        "well_id string, pump_type string, horsepower double, application string, baseline_flow double, baseline_head double, baseline_power double, baseline_efficiency double",
    )
    sites = spark.createDataFrame([(f"Well {m}", 1, m, {"flow": m * 10 + 1, "head": m * 10 + 2}) for m in range(3)], "well_id string, site_id long, pump_id long, sensor_ids map<string,long>")
    models = spark.createDataFrame([("Well 0", 99, 30.0, [-0.05]), ("Well 1", 99, -20.0, [0.05])], "well_id string, readings long, intercept double, coefficients array<double>")
    return rows, telemetry, fleet_limits(machines, default_tolerances(spark)), sites, models.withColumn("model_version", F.lit("7"))


DELAYS = Delays(order=120, late=30)


def batches(stream, path):
    return stream.sparkSession.read.parquet(path)


def test_stream_equals_batch_over_shuffled_micro_batches(spark, given, tmp_path):
    rows, telemetry, fleet, sites, models = given
    batch = edge.edge_run(telemetry, fleet, sites, models, ["recent_flow_mean"], Timeline.of(telemetry), minutes=60, minimum=40)
    stream = arrival(spark, rows, f"{tmp_path}/in")
    live_run = stream_edge_run(stream, fleet, sites, models, ["recent_flow_mean"], DELAYS, minutes=60, minimum=40)
    with state_store(spark):
        query = live_run.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) >= 6
    made = spark.read.schema(live_run.schema).parquet(f"{tmp_path}/out")
    digest = lambda df: sorted(str(r) for r in df.select("well_id", "ts", "description", "sensorId", "logValue", "reason", F.to_json("metadata"), F.to_json("additionalContext")).collect())
    assert digest(made) == digest(batch) and batch.count() > 30
    versions = {r[0] for r in batch.select("metadata.modelVersion").where("metadata.prediction_rul_days IS NOT NULL").collect()}
    assert versions == {"7"}


def test_the_run_makes_what_its_records_hold(given):
    """Readings are scored once, and statistics that no model asks for are not made."""
    _, telemetry, fleet, sites, models = given
    run = edge.edge_run(telemetry, fleet, sites, models, ["recent_flow_mean"], Timeline.of(telemetry), minutes=60, minimum=40)
    plan = run._jdf.queryExecution().optimizedPlan().toString()
    assert "stddev_samp" not in plan and "Union" not in plan and plan.count("avg(") == 1


def test_late_readings_go_aside(spark, given, tmp_path):
    """A reading older than what its machine has been folded up to is returned marked; the others are as without it."""
    _, telemetry, fleet, _, _ = given
    base = [("Well 0", START + timedelta(minutes=10 * k), (k, 0), 600.0, 150.0, 75.0, 85.0) for k in range(60)]
    late = ("Well 0", START + timedelta(minutes=10 * 50 + 5), (999, 0), 600.0, 150.0, 75.0, 85.0)
    for k, part in enumerate((base[:30], base[30:], *([("Well 1", START + timedelta(minutes=m), (0, 0), 600.0, 150.0, 75.0, 85.0)] for m in (740, 745)), [late], [late], [END])):
        spark.createDataFrame(part, TELEMETRY).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(TELEMETRY).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    made = stream_edge_features(stream, Delays(order=120, late=600))
    with state_store(spark):
        out = live.run_to_table(made, f"{tmp_path}/out", f"{tmp_path}/state")
    rows = out.where("well_id = 'Well 0'").collect()
    assert sorted(r["reading_id"]["a"] for r in rows if r["late"]) == [999, 999]
    assert sorted((r["tick"], r["readings"]) for r in rows if not r["late"]) == [((START + timedelta(minutes=10 * k) - datetime(1970, 1, 1)) // timedelta(microseconds=1), min(k + 1, 24)) for k in range(60)]


def test_folds_carry_on_between_steps(spark, given):
    rows, telemetry, fleet, _, _ = given
    scored = anomalies.edge_score(telemetry, fleet).where("well_id = 'Well 0'").orderBy("ts", "reading_id").collect()
    level = {"Normal": 0, "Warning": 1, "Critical": 2, "Failure": 3}
    records = [{"mask": r["mask"], "level": level[r["status"]], "tick": int((r["ts"] - datetime(1970, 1, 1)) / timedelta(microseconds=1))} for r in scored]
    for options in ((60, False, False), (60, True, True)):
        fold, state, parts = Debounce(*options), Debounce(*options).start(), []
        for k in range(0, len(records), 7):
            state, made = fold.step(state, records[k : k + 7])
            parts += made
        want = {r["reading_id"]: (r["blocked_by"], r["elapsed_minutes"]) for r in debounce.debounce(anomalies.edge_score(telemetry, fleet).where("well_id = 'Well 0'"), Timeline.of(telemetry), *options).collect()}
        assert {r["reading_id"]: m for r, m in zip(scored, parts, strict=True) if r["mask"]} == want


def test_rolling_fold_equals_windows(spark, given):
    rows, telemetry, *_ = given
    for max_rows in (10**6, 50):
        made = edge.edge_features(telemetry, Timeline.of(telemetry, max_rows=max_rows), minimum=40).where("well_id = 'Well 0'").orderBy("ts", "reading_id").collect()
        own = sorted((r for r in rows if r[0] == "Well 0"), key=lambda r: r[1:3])
        fold, state, parts = Rolling(24, 40), Rolling().start(), []
        for k in range(0, len(own), 11):
            state, more = fold.step(state, [dict(zip(("flow", "head", "power", "efficiency"), r[3:], strict=True)) for r in own[k : k + 11]])
            parts += more
        names = ["readings", "ready", *edge.edge_feature_names()]
        for got, want in zip(parts, made, strict=True):
            for name, value in zip(names, got, strict=True):
                assert (value is None) == (want[name] is None) and (value is None or value == pytest.approx(want[name], abs=1e-9))


class CountedStore:
    """A key's state as the processor sees it; counts the calls."""

    def __init__(self):
        self.calls, self.timers, self.entries, self.kept = 0, set(), {}, {}

    def getValueState(self, name, schema):
        return self._state(exists=lambda: name in self.kept, get=lambda: self.kept[name], update=lambda value: self.kept.__setitem__(name, value))

    def getMapState(self, name, key, value):
        return self._state(getValue=self.entries.__getitem__, updateValue=self.entries.__setitem__, removeKey=self.entries.pop)

    def _state(self, **calls):
        return type("State", (), {name: staticmethod(self._counted(call)) for name, call in calls.items()})

    def _counted(self, call):
        def run(*given):
            self.calls += 1
            return call(*given)

        return run

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


def test_state_calls_follow_batches_not_slots():
    """A slot for nearly every reading, as in sparse histories: calls to the state store stay few, rows are put in order all the same."""
    rng = random.Random(3)
    n, step, delays = 3000, 40, Delays(order=120, late=30)
    kept = T.StructType.fromDDL("tick long, reading_id struct<a: long>, flow double, head double, power double, efficiency double")
    arrivals = sorted(range(n), key=lambda k: k * step + rng.random() * 100)
    store, out, calls = CountedStore(), [], []
    processor = _Ordered(Rolling(24, 40), kept, delays)
    processor.init(store)
    cuts = [*range(0, n, 500), n]
    for number, (low, high) in enumerate(zip(cuts, cuts[1:])):
        rows = [(k * step * 60_000_000, {"a": k}, float(k), 1.0, 2.0, 3.0) for k in arrivals[low:high]]
        out += processor.handleInputRows(("Well 0",), iter([pd.DataFrame(rows, columns=kept.names)]), None)
        newest = max(arrivals[:high]) * step * 60_000 + (10**9 if high == n else 0)
        mark = newest - int(delays.order * 60_000) - delays.behind_ms
        for at in sorted(t for t in store.timers if t <= mark):
            out += processor.handleExpiredTimer(("Well 0",), type("Now", (), {"getCurrentWatermarkInMs": staticmethod(lambda: mark)}), None)
            store.timers.discard(at)
        calls.append(store.calls)
    made = pd.concat(out)
    assert made["reading_id"].map(lambda r: r["a"]).tolist() == list(range(n)) and not made["late"].any()
    assert made["readings"].tolist() == [min(k + 1, 24) for k in range(n)]
    assert not store.entries and not store.timers
    assert calls[-1] < len(calls) * 20 + 3 * n / PIECE


def test_machines_are_solved_by_many_tasks(spark):
    """A machine's moments are few bytes and its solution takes milliseconds: machines are not coalesced by bytes."""
    rows = spark.range(4000).select(F.concat(F.lit("Well "), F.col("id") % 400).alias("well_id"), F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("rul_days"), F.lit(False).alias("is_test"))
    made = machine_models.fit_machines(rows, ["x"]).withColumn("task", F.spark_partition_id())
    assert made.select("well_id").distinct().count() == 400 and len({r["task"] for r in made.collect()}) > 8


def test_models_per_machine(spark, tmp_path):
    rng = np.random.default_rng(4)
    names = [f"x{i}" for i in range(65)]
    rows, truth = [], {}
    for m in range(3):
        truth[f"Well {m}"] = rng.normal(size=65), rng.normal()
        x = rng.normal(loc=1e4, scale=rng.uniform(0.5, 20, 65), size=(300, 65))
        x[:, 7] = 3.0  # a constant feature
        for i, values in enumerate(x):
            rows.append((f"Well {m}", *values.tolist(), float(values @ truth[f"Well {m}"][0] + truth[f"Well {m}"][1]), i >= 250))
    rows += [("Well 0", *[float("nan")] * 65, 1.0, False), (None, *[1.0] * 65, 1.0, False), ("Well 9", *[1.0] * 65, 5.0, False)]
    schema = "well_id string, " + ", ".join(f"{n} double" for n in names) + ", rul_days double, is_test boolean"
    split = spark.createDataFrame(rows, schema).repartition(5)
    models = machine_models.fit_machines(split, names)
    found = {r["well_id"]: r for r in models.collect()}
    assert set(found) == {"Well 0", "Well 1", "Well 2", "Well 9"}
    assert (found["Well 9"]["intercept"], set(found["Well 9"]["coefficients"])) == (5.0, {0.0})
    for well, (coefficients, _) in truth.items():
        own = np.array(found[well]["coefficients"])
        free = np.arange(65) != 7
        assert found[well]["readings"] == 250 and np.allclose(own[free], coefficients[free], atol=1e-5) and own[7] == 0
    machine_models.save_models(models, f"{tmp_path}/m", "1.1", names)
    machine_models.save_models(models.where("well_id = 'Well 1'"), f"{tmp_path}/m", "1.2", names)
    loaded, kept = machine_models.load_models(spark, f"{tmp_path}/m", "1.1")
    assert kept == names and loaded.count() == 4 and {r["model_version"] for r in loaded.collect()} == {"1.1"}
    scored = split.where("is_test").join(loaded, "well_id").select("rul_days", machine_models.predicted(names).alias("p")).collect()
    assert all(r["p"] == pytest.approx(r["rul_days"], abs=1e-2) for r in scored) and len(scored) == 150
