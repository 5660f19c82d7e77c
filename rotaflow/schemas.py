"""Schemas of files and nested records, and the feature column order."""

from __future__ import annotations

from pyspark.sql import types as T

from rotaflow.fixed_values import (
    BASELINE_COLUMNS,
    CURVE_TEST_COLUMNS,
    FEATURE_WINDOWS,
    PARAMETERS,
    TELEMETRY_COLUMNS,
)

_BASELINE_TEXT = {"Well ID", "pump_type", "application"}

BASELINE_FILE = T.StructType(
    [
        T.StructField(name, T.StringType() if name in _BASELINE_TEXT else T.DoubleType())
        for name in BASELINE_COLUMNS
    ]
)

# timestamps arrive as text in several layouts and are parsed after the scan
TELEMETRY_FILE = T.StructType(
    [
        T.StructField(
            name, T.StringType() if name in ("timestamp", "Well ID") else T.DoubleType()
        )
        for name in TELEMETRY_COLUMNS
    ]
)

VENDOR_FILE = T.StructType(
    [
        T.StructField("SitePumpID", T.StringType()),
        T.StructField("PumpLogDate", T.StringType()),
        T.StructField("OutputCurrent", T.DoubleType()),
        T.StructField("Pressure", T.DoubleType()),
        T.StructField("VibrationLevel", T.DoubleType()),
        T.StructField("Frequency", T.DoubleType()),
        T.StructField("Running", T.BooleanType()),
        T.StructField("PumpDepth", T.DoubleType()),
        T.StructField("PumpID", T.StringType()),
        T.StructField("FailTs", T.StringType()),
    ]
)

CURVE_TEST_FILE = T.StructType(
    [T.StructField("Site", T.StringType())]
    + [T.StructField(name, T.DoubleType()) for name in CURVE_TEST_COLUMNS]
)

_TEXT_TO_DOUBLE = T.MapType(T.StringType(), T.DoubleType())

ANOMALY_CONTEXT = T.StructType(
    [
        T.StructField("parameter", T.ArrayType(T.StringType())),
        T.StructField("status", T.StringType()),
        T.StructField("tolerance_category", T.StringType()),
        T.StructField("all_deviations", _TEXT_TO_DOUBLE),
        T.StructField("baseline_values", _TEXT_TO_DOUBLE),
        T.StructField("current_values", _TEXT_TO_DOUBLE),
    ]
)

ANOMALY_METADATA = T.StructType(
    [
        T.StructField("modelName", T.StringType()),
        T.StructField("modelVersion", T.StringType()),
        T.StructField("framework", T.StringType()),
        T.StructField("tolerance_category", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("prediction_rul_days", T.DoubleType()),
        T.StructField("prediction_probability", T.DoubleType()),
        T.StructField("model_type", T.StringType()),
    ]
)

# the two nested columns stay text on the scan: producers send either an
# object or its JSON text, and a string field accepts both
ANOMALY_LOG = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("sourceType", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("siteId", T.LongType()),
        T.StructField("pumpId", T.LongType()),
        T.StructField("sensorId", T.LongType()),
        T.StructField("cameraId", T.LongType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("logValue", T.DoubleType()),
        T.StructField("additionalContext", T.StringType()),
        T.StructField("metadata", T.StringType()),
    ]
)

_TOLERANCE_CELL = T.StructType(
    [
        T.StructField("mandatory", T.BooleanType()),
        T.StructField("max_deviation", T.DoubleType()),
        T.StructField("min_deviation", T.DoubleType()),
        T.StructField("bidirectional", T.BooleanType()),
        T.StructField("note", T.StringType()),
    ]
)

TOLERANCE_FILE = T.StructType(
    [
        T.StructField(
            "categories",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("application", T.StringType()),
                        T.StructField("tolerances", T.MapType(T.StringType(), _TOLERANCE_CELL)),
                    ]
                ),
            ),
        )
    ]
)

SITE_FILE = T.StructType(
    [
        T.StructField(
            "site_info",
            T.StructType(
                [
                    T.StructField("site_id", T.LongType()),
                    T.StructField("pump_id", T.LongType()),
                    T.StructField("sensor_ids", T.MapType(T.StringType(), T.LongType())),
                ]
            ),
        ),
        T.StructField(
            "anomaly_reporting",
            T.StructType(
                [
                    T.StructField("enabled", T.BooleanType()),
                    T.StructField("report_on_status", T.ArrayType(T.StringType())),
                    T.StructField("debounce_minutes", T.LongType()),
                    T.StructField("include_ml_predictions", T.BooleanType()),
                ]
            ),
        ),
        T.StructField(
            "inference_settings",
            T.StructType(
                [
                    T.StructField("min_data_points_for_ml", T.LongType()),
                    T.StructField("save_results_locally", T.BooleanType()),
                    T.StructField("results_retention_days", T.LongType()),
                ]
            ),
        ),
    ]
)


def feature_names(windows=FEATURE_WINDOWS) -> list[str]:
    """Feature columns in training order (65 of them for the two default windows)."""
    names = [f"{p}_deviation_pct" for p in PARAMETERS]
    names += [
        f"{p}_rolling_{stat}_{w}h"
        for p in PARAMETERS
        for w in windows
        for stat in ("mean", "std", "max", "min")
    ]
    names += [f"{p}_slope_{w}h" for p in PARAMETERS for w in windows]
    names += [f"{p}_acceleration_{w}h" for p in PARAMETERS for w in windows]
    names += [f"{p}_cumulative_deviation" for p in PARAMETERS]
    names += [f"{p}_abs_deviation" for p in PARAMETERS]
    names += ["hours_since_start", "day_of_week", "hour_of_day"]
    names += ["flow_head_product", "power_efficiency_product"]
    return names
