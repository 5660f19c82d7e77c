"""Boundaries of the rules on tiny frames."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rotaflow import fixed_values as V
from rotaflow.functions import rules
from rotaflow.operators import anomalies, convert, features, fleet, model, status
from rotaflow.plans.monitor import FleetMonitor
from rotaflow.plans.timeline import Timeline
from rotaflow.schemas import feature_names

TELEMETRY = (
    "well_id string, ts timestamp_ntz, flow double, head double, suction double, "
    "power double, efficiency double, speed double, reading_id long"
)
BASELINE = (
    "well_id string, pump_type string, horsepower double, application string, "
    "baseline_flow double, baseline_head double, baseline_power double, "
    "baseline_efficiency double"
)
START = datetime(2024, 5, 1)


def readings(spark, rows, well="Well 1"):
    """Rows of (flow, head, power, efficiency), one per hour."""
    return spark.createDataFrame(
        [
            (well, START + timedelta(hours=i), f, h, 25.0, p, e, 1760.0, i)
            for i, (f, h, p, e) in enumerate(rows)
        ],
        TELEMETRY,
    )


def baselines(spark, application="Municipal Water and Wastewater", hp=100.0, efficiency=85.5):
    return spark.createDataFrame(
        [("Well 1", "Goulds 3409", hp, application, 500.0, 150.0, 75.0, efficiency)], BASELINE
    )


def statuses(spark, rows, category=None, **options):
    limits = fleet.fleet_limits(baselines(spark), fleet.default_tolerances(spark), category)
    telemetry = readings(spark, rows)
    made = status.analyse(telemetry, limits, Timeline.of(telemetry), **options)
    return [r["status"] for r in made.orderBy("ts").collect()]


TEMPLATE = [
    (505.0, 148.0, 76.0, 85.2), (510.0, 152.0, 77.0, 84.8), (498.0, 147.0, 75.5, 85.3),
    (502.0, 149.0, 75.8, 85.1), (507.0, 151.0, 76.2, 84.9),
]


def test_template_readings(spark):
    monitor = FleetMonitor(spark, baselines(spark)).load(readings(spark, TEMPLATE))
    rows = monitor.analyze().orderBy("ts").collect()
    assert [r["status"] for r in rows] == ["Warning"] * 5
    assert [round(r["flow_deviation_pct"], 2) for r in rows] == [1.0, 2.0, -0.4, 0.4, 1.4]
    assert [round(r["head_deviation_pct"], 2) for r in rows] == [-1.33, 1.33, -2.0, -0.67, 0.67]
    assert [round(r["efficiency_deviation_pct"], 2) for r in rows] == [
        -0.35, -0.82, -0.23, -0.47, -0.70,
    ]
    first = monitor.first_exceedances().first()
    assert first["efficiency_first_exceeded"] == START
    assert first["flow_first_exceeded"] is None
    report = monitor.report().first()["report"]
    assert "Status now: **Warning**" in report
    assert "| Warning | 5 | 100.0 % |" in report
    assert "- Flow: warn from +5.0% on" in report
    assert "- was off by -0.35% then" in report


@pytest.mark.parametrize(
    "application, hp, category",
    [
        ("Municipal Water and Wastewater", 10.0, "1U"), ("API", 500.0, "1B"),
        ("Energy Conservation", 1.0, "1E"), ("Cooling Tower", 1.0, "2B"),
        ("General Industry", 133.9, "3B"), ("General Industry", 134.0, "2B"),
        ("Dewatering, drainage, and irrigation", 133.0, "3B"), ("Unknown", 1.0, None),
    ],
)
def test_category(spark, application, hp, category):
    row = fleet.machine_registry(baselines(spark, application, hp)).first()
    assert row["category"] == category


def test_status_boundaries(spark):
    rows = [
        (550.0, 150.0, 75.0, 86.0),  # exactly at the limit
        (550.1, 150.0, 75.0, 86.0),  # one mandatory
        (575.0, 150.0, 75.0, 86.0),  # severity exactly 1.5
        (551.0, 159.5, 75.0, 86.0),  # two mandatory
        (551.0, 150.0, 83.0, 85.0),  # three in all
        (500.0, 150.0, 87.0, 72.6),  # two severe
        (500.0, 150.0, 75.0, 72.0),  # one severe, zero limit
    ]
    assert statuses(spark, rows) == [
        "Normal", "Warning", "Critical", "Failure", "Critical", "Failure", "Critical",
    ]


def test_lower_limit_uses_excess_not_ratio(spark):
    # -19.9 % against -8 %: excess 1.4875; -20.1 %: 1.5125
    rows = [(400.5, 150.0, 75.0, 86.0), (399.5, 150.0, 75.0, 86.0)]
    assert statuses(spark, rows, "2B") == ["Warning", "Critical"]


def test_sustained_rule_starts_at_row_26_with_17_of_24(spark):
    good, high = (500.0, 150.0, 75.0, 86.0), (555.0, 150.0, 75.0, 86.0)
    made = statuses(spark, [high] * 30)
    assert made[:25] == ["Warning"] * 25 and made[25:] == ["Critical"] * 5
    made = statuses(spark, [good] * 20 + [high] * 20)
    assert made[20:36] == ["Warning"] * 16 and made[36:] == ["Critical"] * 4


def test_nan_and_zero_baseline(spark):
    nan = float("nan")
    limits = fleet.fleet_limits(
        baselines(spark, efficiency=0.0), fleet.default_tolerances(spark)
    )
    telemetry = readings(spark, [(nan, 150.0, 75.0, 80.0)])
    row = status.analyse(telemetry, limits, Timeline.of(telemetry)).first()
    assert row["status"] == "Normal"
    assert row["flow_deviation_pct"] is None and row["efficiency_deviation_pct"] is None
    edge = anomalies.edge_score(telemetry, limits).first()
    assert edge["efficiency_dev"] == 0.0 and edge["status"] == "Normal"


def test_edge_status(spark):
    limits = fleet.fleet_limits(baselines(spark), fleet.default_tolerances(spark))
    rows = [
        (555.0, 150.0, 75.0, 86.0), (580.0, 150.0, 75.0, 86.0), (605.0, 150.0, 75.0, 86.0),
        (500.0, 150.0, 75.0, 60.0), (500.0, 150.0, 75.0, 86.0),
    ]
    scored = anomalies.edge_score(readings(spark, rows), limits).orderBy("ts")
    assert [r["status"] for r in scored.collect()] == [
        "Warning", "Critical", "Failure", "Warning", "Normal",
    ]
    sites = spark.createDataFrame(
        [("Well 1", 35482, 1, {"flow": 101, "head": 102})],
        "well_id string, site_id long, pump_id long, sensor_ids map<string,long>",
    )
    record = anomalies.anomaly_payload(scored.where("mask > 0"), sites).orderBy("ts").first()
    assert record["description"] == "Pump anomaly detected - flow: 11.0% (threshold: 10.0%)"
    assert (record["sensorId"], record["logValue"]) == (101, 555.0)
    assert record["timestamp"] == "2024-05-01T00:00:00Z"
    assert record["additionalContext"]["parameter"] == ["flow"]
    assert record["metadata"]["confidence"] is None


def test_text_helpers(spark):
    made = spark.range(1).select(
        rules.one_decimal(F.lit(-0.04)).alias("a"),
        rules.one_decimal(F.lit(12.25)).alias("b"),
        rules.iso_z(F.lit("2024-01-01 00:00:00.5").cast("timestamp_ntz")).alias("c"),
        rules.two_places(F.lit(0.125)).alias("d"),
        rules.slug_of(F.lit("Well 1")).alias("e"),
    ).first()
    assert tuple(made) == ("-0.0", "12.3", "2024-01-01T00:00:00.500000Z", 0.12, "well_1")


def test_curve_baseline_golden(spark):
    rows = [("Well 1", 252.33, 173.98, 75.31, 23.5)] * 3 + [("Well 1", 388.0, 5.4, 2.3, 24.0)]
    rows += [("Dry", 120.0, 10.0, 5.0, 20.0), ("Dry", 0.0, 10.0, 5.0, 90.0)]
    curve = spark.createDataFrame(
        rows,
        "site string, flow_gpm double, head_ft double, pressure_psi double, current_a double",
    )
    made = {r["well_id"]: r for r in convert.baseline_from_curve_test(curve).collect()}
    well = made["Well 1"]
    assert well["baseline_flow"] == 252.33 and well["baseline_head"] == 75.31
    assert well["baseline_power"] == pytest.approx(20.03513784004471, abs=1e-12)
    assert (well["baseline_efficiency"], well["horsepower"]) == (60.0, 24.0)
    assert made["Dry"]["baseline_flow"] == 120.0  # nothing stable: all rows with flow


def test_feature_names():
    names = feature_names()
    assert len(names) == 65 and len(set(names)) == 65
    assert names[4:8] == [f"flow_rolling_{s}_24h" for s in ("mean", "std", "max", "min")]
    assert names[-2:] == ["flow_head_product", "power_efficiency_product"]


def test_constant_signal_has_zero_deviation(spark):
    telemetry = readings(spark, [(503.3, 151.7, 76.1, 84.9)] * 400)
    limits = fleet.fleet_limits(baselines(spark), fleet.default_tolerances(spark))
    made = features.engineer_features(
        status.deviation_pct(telemetry, limits), Timeline.of(telemetry)
    )
    largest = made.agg(F.max("flow_rolling_std_168h"), F.max("head_rolling_std_24h")).first()
    assert max(largest) < 1e-9


def test_train_and_predict(spark):
    rows = [(500.0 + i % 7, 150.0 + 0.02 * i, 75.0 + i % 3, 86.0 - 0.01 * i) for i in range(300)]
    failures = spark.createDataFrame([("Well 1", START + timedelta(days=14))],
                                     "well_id string, failure_ts timestamp_ntz")
    monitor = FleetMonitor(spark, baselines(spark)).load(readings(spark, rows))
    with pytest.raises(ValueError):
        monitor.analyze(train_model=True)
    split = features.chronological_split(
        features.rul_labels(monitor.features(), failures), monitor.timeline
    )
    names = ["flow_deviation_pct", "head_deviation_pct", "hours_since_start"]
    trained = model.train_rul(split, features=names, trees=5)
    parts = {r["part"]: r for r in trained.metrics.collect()}
    assert (parts["train"]["readings"], parts["test"]["readings"]) == (240, 60)
    assert parts["train"]["r2"] > 0.95
    row = model.predict_rul(trained.model, status.latest_reading(split), names).first()
    assert row["rul_lower"] <= row["rul_days"] <= row["rul_upper"]
    assert 0 <= row["failure_probability"] <= 1
    assert set(row["contributing_factors"]) == set(names)
    assert trained.importance.count() == 3


def test_advice_covers_all_statuses():
    assert tuple(V.ADVICE) == V.STATUSES
