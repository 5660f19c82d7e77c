"""Presents star-schema and event tables as telemetry, machines, logs and failures.

All views are projections without a shuffle, so they cost what the scan costs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

APPLICATIONS = (
    "Municipal Water and Wastewater",
    "API",
    "Energy Conservation",
    "Cooling Tower",
    "General Industry",
    "Dewatering, drainage, and irrigation",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def telemetry(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry_view(table(spark, folder, "lineitem"))


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The same Parquet table as a file stream."""
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}*.parquet")


def telemetry_view(lineitem: DataFrame) -> DataFrame:
    """Line items as readings of one pump per supplier, with a slow drift.

    From 1999 on, head rises on every third pump and flow falls on another third.
    """
    drift = F.greatest(F.lit(0), F.date_diff(F.col("l_shipdate"), F.lit("1999-01-01").cast("date")))
    third = F.col("l_suppkey") % 3
    return lineitem.select(
        F.concat(F.lit("Well "), F.col("l_suppkey")).alias("well_id"),
        F.col("l_shipdate").alias("ts"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("reading_id"),
        (
            500 + 3.0 * (F.col("l_quantity") - 25) - F.when(third == 1, 0.05 * drift).otherwise(0.0)
        ).alias("flow"),
        (
            150
            + 0.0002 * (F.col("l_extendedprice") - F.col("l_quantity") * 1500)
            + 150 * (F.col("l_tax") - 0.04)
            + F.when(third == 0, 0.015 * drift).otherwise(0.0)
        ).alias("head"),
        F.lit(25.0).alias("suction"),
        (75 + 150 * (F.col("l_discount") - 0.05)).alias("power"),
        (85 - 100 * (F.col("l_tax") - 0.04)).alias("efficiency"),
        (1750.0 + F.col("l_linenumber")).alias("speed"),
    )


def machines(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as machines with nameplate baselines; all applications occur."""
    names = F.array(*[F.lit(a) for a in APPLICATIONS])
    return table(spark, folder, "supplier").select(
        F.concat(F.lit("Well "), F.col("s_suppkey")).alias("well_id"),
        F.concat(F.lit("Type "), F.col("s_nationkey")).alias("pump_type"),
        (F.abs("s_acctbal") % 268).alias("horsepower"),
        names[F.col("s_nationkey") % 6].alias("application"),
        F.lit(500.0).alias("baseline_flow"),
        F.lit(150.0).alias("baseline_head"),
        F.lit(75.0).alias("baseline_power"),
        F.lit(85.0).alias("baseline_efficiency"),
    )


def failures(spark: SparkSession, folder: str) -> DataFrame:
    """A failure time for each machine, some before its last reading."""
    days = (F.col("s_suppkey") % 200).cast("int")
    return table(spark, folder, "supplier").select(
        F.concat(F.lit("Well "), F.col("s_suppkey")).alias("well_id"),
        F.date_add(F.lit("2001-08-01").cast("date"), days).cast("timestamp_ntz").alias("failure_ts"),
    )


def sites(spark: SparkSession, folder: str) -> DataFrame:
    """Site, pump and sensor ids of each machine."""
    key = F.col("s_suppkey")
    sensors = F.create_map(
        *[
            x
            for i, p in enumerate(("flow", "head", "power", "efficiency"), start=1)
            for x in (F.lit(p), key * 10 + i)
        ]
    )
    return table(spark, folder, "supplier").select(
        F.concat(F.lit("Well "), key).alias("well_id"),
        F.col("s_nationkey").cast("long").alias("site_id"),
        key.alias("pump_id"),
        sensors.alias("sensor_ids"),
    )


def anomaly_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as reported anomalies."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts"),
        F.col("user_id").alias("pumpId"),
        (F.col("user_id") % 10).alias("siteId"),
        F.when(k % 5 != 4, 101 + k % 5).alias("sensorId"),
        F.lit(None).cast("long").alias("cameraId"),
        F.col("value").alias("logValue"),
        F.when(kind == "error", "Failure")
        .when(kind == "purchase", "Critical")
        .when(kind == "view", "Warning")
        .otherwise("Normal")
        .alias("status"),
    )


def vendor_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a vendor's pump log, all columns as in its files."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("SitePumpID"),
        F.col("ts").alias("PumpLogDate"),
        F.col("value").alias("OutputCurrent"),
        (100 + k / 2).alias("Pressure"),
        F.when(F.col("user_id") % 7 == 0, 0.0).otherwise(k / 10).alias("VibrationLevel"),
        (50 + k / 10).alias("Frequency"),
        (F.col("event_type") != "signup").alias("Running"),
        F.lit(300.0).alias("PumpDepth"),
        F.col("user_id").cast("string").alias("PumpID"),
        F.lit("2024-02-15 00:00:00").cast("timestamp_ntz").alias("FailTs"),
    )


def curve_test(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as curve tests, one site per supplier; some sites are never stable."""
    unstable = F.col("l_suppkey") % 5 == 0
    return table(spark, folder, "lineitem").select(
        F.concat(F.lit("Well "), F.col("l_suppkey")).alias("site"),
        F.when(unstable, F.col("l_quantity") * 3).otherwise(F.col("l_quantity") * 10).alias("flow_gpm"),
        (F.col("l_extendedprice") / 400).alias("head_ft"),
        (F.col("l_extendedprice") / 924).alias("pressure_psi"),
        (20 + 50 * F.col("l_discount")).alias("current_a"),
    )
