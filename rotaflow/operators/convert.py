"""Vendor logs and curve tests turned into telemetry and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotaflow import fixed_values as V
from rotaflow.functions import rules
from rotaflow.plans.medians import medians
from rotaflow.plans.timeline import MAX_ROWS


def running_only(vendor: DataFrame) -> DataFrame:
    return vendor.where("Running")


def vendor_statistics(vendor: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Median current and largest vibration of each pump while running."""
    running = running_only(vendor)
    middle = medians(running, "SitePumpID", {"median_current": F.col("OutputCurrent")}, max_rows)
    largest = running.groupBy("SitePumpID").agg(F.max("VibrationLevel").alias("max_vibration"))
    return middle.join(largest, "SitePumpID")


def normalise_vendor_log(vendor: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Telemetry estimated from current, pressure, vibration and frequency."""
    joined = running_only(vendor).join(vendor_statistics(vendor, max_rows), "SitePumpID")
    columns = {
        "well_id": F.concat(F.lit("Pump "), F.col("SitePumpID")),
        "ts": F.col("PumpLogDate"),
        "flow": rules.flow_from_current(F.col("OutputCurrent"), F.col("median_current")),
        "head": F.col("Pressure"),
        "suction": F.lit(V.NOMINAL_SUCTION),
        "power": rules.amps_to_hp(F.col("OutputCurrent")),
        "efficiency": rules.efficiency_from_vibration(
            F.col("VibrationLevel"), F.col("max_vibration")
        ),
        "speed": rules.hz_to_rpm(F.col("Frequency")),
    }
    sensors = [c for c in columns if c != "well_id"]
    return joined.select(*[c.alias(name) for name, c in columns.items()]).withColumn(
        "reading_id", F.xxhash64(*sensors)
    )


def vendor_failures(vendor: DataFrame) -> DataFrame:
    """Failure time of each pump as its log states it."""
    return vendor.groupBy("SitePumpID").agg(F.min("FailTs").alias("failure_ts")).select(
        F.concat(F.lit("Pump "), F.col("SitePumpID")).alias("well_id"), "failure_ts"
    )


def source_summary(vendor: DataFrame) -> DataFrame:
    """Mean, min and max of the raw sensors per pump while running."""
    aggs = []
    for c in ("OutputCurrent", "Pressure", "VibrationLevel", "Frequency"):
        aggs += [
            F.avg(c).alias(f"{c}_mean"),
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
        ]
    return running_only(vendor).groupBy("SitePumpID").agg(F.count("*").alias("records"), *aggs)


def _stable() -> object:
    return (F.col("flow_gpm") > 200) & (F.col("head_ft") > 50) & (F.col("head_ft") < 200)


def stable_range(curve: DataFrame) -> DataFrame:
    """Readings in the stable range; of a site without any, all with flow."""
    sites = curve.groupBy("site").agg(F.coalesce(F.bool_or(_stable()), F.lit(False)).alias("_any"))
    chosen = F.when(F.col("_any"), _stable()).otherwise(F.col("flow_gpm") > 0)
    return curve.join(sites, "site").where(chosen).drop("_any")


def baseline_from_curve_test(
    curve: DataFrame,
    application: str = "Municipal Water and Wastewater",
    pump_type: str = "Unknown",
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Baseline of each site from medians over its stable range."""
    columns = {c: F.col(c) for c in ("flow_gpm", "head_ft", "pressure_psi", "current_a")}
    middle = medians(stable_range(curve), "site", columns, max_rows)
    power = rules.amps_to_hp(F.col("current_a"))
    return middle.select(
        F.col("site").alias("well_id"),
        F.lit(pump_type).alias("pump_type"),
        rules.horsepower_rating(power).cast("double").alias("horsepower"),
        F.lit(application).alias("application"),
        F.col("flow_gpm").alias("baseline_flow"),
        F.col("pressure_psi").alias("baseline_head"),
        power.alias("baseline_power"),
        rules.hydraulic_efficiency(F.col("flow_gpm"), F.col("head_ft"), power).alias(
            "baseline_efficiency"
        ),
    )


def curve_summary(curve: DataFrame) -> DataFrame:
    aggs = []
    for c in ("flow_gpm", "head_ft", "pressure_psi", "current_a"):
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return curve.groupBy("site").agg(F.count("*").alias("records"), *aggs)
