"""Data-quality checks: a table of violations, or an error with ``strict``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotaflow import fixed_values as V
from rotaflow.plans.timeline import Timeline

SENSORS = ("flow", "head", "suction", "power", "efficiency", "speed")
NON_NEGATIVE = ("flow", "head", "power", "speed")
_FILE_NAME = {v: k for k, v in V.TELEMETRY_COLUMNS.items()}


def required_columns(df: DataFrame, required: Sequence[str]) -> None:
    """Raises if columns are missing; looks at the schema only."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}; available: {df.columns}")


def check_not_empty(df: DataFrame, clock: str = "ts") -> None:
    """Raises on an empty table or a clock that is not a timestamp."""
    if not isinstance(df.schema[clock].dataType, (T.TimestampType, T.TimestampNTZType)):
        raise ValueError(f"{clock} must be a timestamp")
    if df.isEmpty():
        raise ValueError("the table is empty")


def _rules(df: DataFrame, checks: dict[tuple[str, str, str], object]) -> DataFrame:
    """One aggregation pass per machine, then one row per failed rule."""
    names = {key: f"_c{i}" for i, key in enumerate(checks)}
    counted = df.groupBy("well_id").agg(
        *[F.count_if(cond).alias(names[key]) for key, cond in checks.items()]
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"),
                F.lit(column).alias("column"),
                F.lit(level).alias("level"),
                F.col(names[(rule, column, level)]).alias("readings"),
            )
            for rule, column, level in checks
        ]
    )
    failed = F.filter(entries, lambda e: e["readings"] > 0)
    return counted.select("well_id", F.explode(failed).alias("e")).select("well_id", "e.*")


def negative_values(telemetry: DataFrame) -> DataFrame:
    return _rules(
        telemetry, {("negative", c, "error"): F.col(c) < 0 for c in NON_NEGATIVE}
    )


def efficiency_range(telemetry: DataFrame) -> DataFrame:
    outside = (F.col("efficiency") < 0) | (F.col("efficiency") > 100)
    return _rules(telemetry, {("efficiency_range", "efficiency", "error"): outside})


def missing_values(telemetry: DataFrame) -> DataFrame:
    checks = {("missing", "ts", "warning"): F.col("ts").isNull()}
    checks |= {
        ("missing", c, "warning"): F.col(c).isNull() | F.isnan(c) for c in SENSORS
    }
    return _rules(telemetry, checks)


def duplicate_timestamps(telemetry: DataFrame) -> DataFrame:
    """Repeats of a timestamp after its first use, counted per machine.

    Grouping by machine and timestamp first keeps the work spread over the
    cluster even if one machine sends most readings.
    """
    return (
        telemetry.groupBy("well_id", "ts")
        .agg(F.count("*").alias("n"))
        .groupBy("well_id")
        .agg(F.sum(F.col("n") - 1).alias("readings"))
        .where("readings > 0")
        .select(
            "well_id",
            F.lit("duplicate_timestamp").alias("rule"),
            F.lit("ts").alias("column"),
            F.lit("warning").alias("level"),
            "readings",
        )
    )


def not_monotonic(telemetry: DataFrame, arrival: Timeline) -> DataFrame:
    """Readings older than the one that arrived before them.

    ``arrival`` orders readings by their arrival sequence, not by time.
    """
    attached = arrival.attach(telemetry.select("well_id", "ts", *arrival.order))
    earlier = F.lag("ts").over(arrival.window())
    steps = arrival.core(attached.withColumn("_back", F.col("ts") < earlier))
    return _rules(steps, {("not_chronological", "ts", "warning"): F.col("_back")})


def validate(
    telemetry: DataFrame, strict: bool = False, arrival: Timeline | None = None
) -> DataFrame:
    """All reading checks as one violations table.

    With ``strict`` rules of level ``error`` raise; the count is one row, so
    nothing but the answer reaches the driver.
    """
    required_columns(telemetry, ["well_id", "ts", *SENSORS])
    checks = {("negative", c, "error"): F.col(c) < 0 for c in NON_NEGATIVE}
    checks[("efficiency_range", "efficiency", "error")] = (F.col("efficiency") < 0) | (
        F.col("efficiency") > 100
    )
    checks[("missing", "ts", "warning")] = F.col("ts").isNull()
    for c in SENSORS:
        checks[("missing", c, "warning")] = F.col(c).isNull() | F.isnan(c)
    found = _rules(telemetry, checks).unionByName(duplicate_timestamps(telemetry))
    if arrival is not None:
        found = found.unionByName(not_monotonic(telemetry, arrival))
    if strict:
        check_not_empty(telemetry)
        errors = found.where("level = 'error'").agg(F.sum("readings")).first()[0]
        if errors:
            raise ValueError(f"{errors} readings break a rule of level error")
    return found


def baseline_violations(baselines: DataFrame) -> DataFrame:
    """Baselines that break a rule, one row per baseline and rule; a machine with several baselines has one more row."""
    positive = ("horsepower", "baseline_flow", "baseline_head", "baseline_power")
    entries = [F.when(F.col(c) <= 0, F.lit(f"{c} must be positive")) for c in positive]
    entries.append(
        F.when(
            ~F.col("baseline_efficiency").between(0, 100),
            F.lit("baseline_efficiency must be between 0 and 100"),
        )
    )
    entries.append(
        F.when(
            F.col("category").isNull() if "category" in baselines.columns else F.lit(False),
            F.lit("unknown application"),
        )
    )
    entries.append(F.when(F.col("well_id").isNull(), F.lit("well_id is missing")))
    failed = F.filter(F.array(*entries), lambda e: e.isNotNull())
    found = baselines.select("well_id", F.explode(failed).alias("violation"))
    counted = baselines.where("well_id IS NOT NULL").groupBy("well_id").agg(F.count("*").alias("n"))
    several = counted.where("n > 1").select("well_id", F.lit("several baselines for one machine").alias("violation"))
    return found.unionByName(several)


def payload_violations(payloads: DataFrame) -> DataFrame:
    """Failed rules of anomaly payloads whose fields are still text."""
    iso = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?(Z|[+-]\d{2}:\d{2})?$"
    stamp = F.regexp_replace("timestamp", "Z$", "+00:00")
    entries = [
        F.when(F.col("sourceType").isNull(), "sourceType is missing"),
        F.when(F.col("description").isNull(), "description is missing"),
        F.when(~F.col("sourceType").isin(*V.SOURCE_TYPES), "sourceType is invalid"),
    ]
    entries += [
        F.when(F.col(c).isNotNull() & F.col(c).try_cast("bigint").isNull(), f"{c} is no integer")
        for c in ("siteId", "pumpId", "sensorId")
    ]
    entries.append(
        F.when(
            F.col("timestamp").isNotNull()
            & (~F.col("timestamp").rlike(iso) | F.try_to_timestamp(stamp).isNull()),
            "timestamp is not ISO-8601",
        )
    )
    entries.append(
        F.when(
            F.col("logValue").isNotNull() & F.col("logValue").try_cast("double").isNull(),
            "logValue is not numeric",
        )
    )
    return payloads.withColumn("failed", F.filter(F.array(*entries), lambda e: e.isNotNull()))
