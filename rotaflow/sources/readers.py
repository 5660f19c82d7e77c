"""Readers with pinned schemas; column names at the edge, snake case inside."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaflow import fixed_values as V
from rotaflow import schemas
from rotaflow.functions import rules
from rotaflow.operators.fleet import machine_registry, one_baseline
from rotaflow.sources.headers import scan_by_name

# --- fixed values: layouts of timestamps in files ----------------------------
TIMESTAMP_LAYOUTS = (
    "M/d/yyyy H:mm",
    "M/d/yyyy H:mm:ss",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "M/d/yyyy",
)


def parse_timestamp(text: Column) -> Column:
    """First layout that fits; NULL if none does."""
    tries = [
        F.try_to_timestamp(text, F.lit(layout)).cast("timestamp_ntz")
        for layout in TIMESTAMP_LAYOUTS
    ]
    return F.coalesce(*tries)


def _scan(spark: SparkSession, path, fmt: str, schema, others: bool = False) -> DataFrame:
    """CSV by header name in any column order, also if it differs from file to file, or Parquet; missing names raise."""
    if fmt == "csv":
        return scan_by_name(spark, path, schema, others=others)
    df = spark.read.format(fmt).load(path)
    missing = [c for c in schema.fieldNames() if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}; available: {df.columns}")
    return df


def read_baseline(spark: SparkSession, path, fmt: str = "csv") -> DataFrame:
    """Baselines, one row per machine: of repeated ones the smallest; ``baseline_violations`` finds them in ``raw_baseline``."""
    return one_baseline(raw_baseline(spark, path, fmt))


def raw_baseline(spark: SparkSession, path, fmt: str = "csv") -> DataFrame:
    """Baselines as they stand in the files, repeated machines included."""
    raw = _scan(spark, path, fmt, schemas.BASELINE_FILE)
    return raw.select(*[F.col(f"`{old}`").alias(new) for old, new in V.BASELINE_COLUMNS.items()])


def to_telemetry(raw: DataFrame) -> DataFrame:
    """Named file columns to telemetry: parsed clock, NaN as missing, a tie-breaker."""
    columns = []
    for old, new in V.TELEMETRY_COLUMNS.items():
        column = F.col(f"`{old}`")
        if new == "ts":
            text = dict(raw.dtypes)[old] == "string"
            column = parse_timestamp(column) if text else column.cast("timestamp_ntz")
        elif new != "well_id":
            column = rules.clean(column.cast("double"))
        columns.append(column.alias(new))
    sensors = [n for n in V.TELEMETRY_COLUMNS.values() if n != "well_id"]
    return raw.select(*columns).withColumn("reading_id", F.xxhash64(*sensors))


def read_telemetry(
    spark: SparkSession, path, well_ids: Sequence[str] | None = None, fmt: str = "csv"
) -> DataFrame:
    """Telemetry of all machines, or of the given ones (pushed into the scan)."""
    raw = _scan(spark, path, fmt, schemas.TELEMETRY_FILE)
    if well_ids is not None:
        raw = raw.where(F.col("`Well ID`").isin(*well_ids))
    return to_telemetry(raw)


def require_rows(telemetry: DataFrame, source: DataFrame, well_id: str) -> DataFrame:
    """Raises if ``well_id`` has no rows, naming some ids that the source has."""
    if telemetry.isEmpty():
        known = [r[0] for r in source.select("well_id").distinct().orderBy("well_id").take(20)]
        raise ValueError(f"No data found for {well_id!r}; ids include {known}")
    return telemetry


def read_latest_feed(spark: SparkSession, path) -> DataFrame:
    """Readings of a feed folder: same parsing, no check of the contract."""
    raw = spark.read.option("header", True).schema(schemas.TELEMETRY_FILE).option(
        "enforceSchema", False
    ).csv(path)
    return to_telemetry(raw)


def stream_telemetry(
    spark: SparkSession, path, fmt: str = "csv", files_per_batch: int = 64
) -> DataFrame:
    """Telemetry as an unbounded table; new files are picked up as they arrive.

    Files of a stream are read as they come, so CSV columns must stand in the order of the contract; others raise.
    """
    reader = (
        spark.readStream.schema(schemas.TELEMETRY_FILE)
        .option("header", True)
        .option("enforceSchema", False)
        .option("maxFilesPerTrigger", files_per_batch)
    )
    return to_telemetry(reader.format(fmt).load(path))


def read_vendor_log(spark: SparkSession, path, fmt: str = "csv") -> DataFrame:
    """Vendor log with parsed clocks; NaN counts as missing."""
    raw = _scan(spark, path, fmt, schemas.VENDOR_FILE, others=True)
    return raw.withColumns(
        {
            "PumpLogDate": parse_timestamp(F.col("PumpLogDate")),
            "FailTs": parse_timestamp(F.col("FailTs")),
        }
        | {c: rules.clean(F.col(c)) for c, kind in raw.dtypes if kind == "double"}
    )


def clean_header(name: str) -> str:
    """Header text without the stray quotes some loggers write."""
    return name.strip().replace('""', "").rstrip('"')


def read_curve_test(spark: SparkSession, path) -> DataFrame:
    """Curve-test log; headers are cleaned, four columns renamed and typed."""
    raw = scan_by_name(spark, path, schemas.CURVE_TEST_FILE, clean_header, others=True, escape='"')
    return raw.withColumnsRenamed({"Site": "site"} | V.CURVE_TEST_COLUMNS)


def load_tolerances(spark: SparkSession, path, category: str | None = None) -> DataFrame:
    """Tolerance file as one row per category and parameter; 999 / -999 become NULL."""
    nested = spark.read.option("multiLine", True).schema(schemas.TOLERANCE_FILE).json(path)
    cells = (
        nested.select(F.explode("categories").alias("category", "c"))
        .select("category", F.explode("c.tolerances").alias("param", "t"))
        .select(
            "category",
            "param",
            "t.mandatory",
            F.nullif("t.max_deviation", F.lit(V.NO_UPPER_LIMIT)).alias("max_deviation"),
            F.nullif("t.min_deviation", F.lit(V.NO_LOWER_LIMIT)).alias("min_deviation"),
            "t.bidirectional",
        )
    )
    if category is None:
        return cells
    chosen = cells.where(F.col("category") == category)
    if chosen.isEmpty():
        raise ValueError(f"category {category} not found")
    return chosen


def load_site_config(spark: SparkSession, path) -> DataFrame:
    """Site configuration files, one row each: ids, sensor map and report settings."""
    nested = spark.read.option("multiLine", True).schema(schemas.SITE_FILE).json(path)
    return nested.select(
        "site_info.site_id",
        "site_info.pump_id",
        "site_info.sensor_ids",
        F.col("anomaly_reporting.enabled").alias("reporting_enabled"),
        "anomaly_reporting.report_on_status",
        F.coalesce("anomaly_reporting.debounce_minutes", F.lit(V.DEBOUNCE_MINUTES)).alias(
            "debounce_minutes"
        ),
        "anomaly_reporting.include_ml_predictions",
        F.coalesce(
            "inference_settings.min_data_points_for_ml", F.lit(V.MIN_READINGS_FOR_ML)
        ).alias("min_readings"),
        F.coalesce("inference_settings.results_retention_days", F.lit(V.RETENTION_DAYS)).alias(
            "retention_days"
        ),
    )


def sensor_dimension(sites: DataFrame) -> DataFrame:
    """``(site_id, pump_id, param, sensor_id)`` rows of a site configuration."""
    return sites.select("site_id", "pump_id", F.explode("sensor_ids").alias("param", "sensor_id"))


def pump_registry(baselines: DataFrame, category_override: str | None = None) -> DataFrame:
    """What edge scoring needs of a machine: category and baselines."""
    return machine_registry(baselines, category_override)


def parse_anomaly_log(raw: DataFrame) -> DataFrame:
    """Parsed clock, nested columns, and the two fields queries ask for."""
    stamp = F.regexp_replace("timestamp", "Z$", "")
    return raw.withColumns(
        {
            "ts": F.try_to_timestamp(stamp).cast("timestamp_ntz"),
            "additionalContext": F.from_json("additionalContext", schemas.ANOMALY_CONTEXT),
            "metadata": F.from_json("metadata", schemas.ANOMALY_METADATA),
        }
    ).withColumns(
        {
            "status": F.col("additionalContext.status"),
            "tolerance_category": F.col("additionalContext.tolerance_category"),
        }
    )


def read_anomaly_log(spark: SparkSession, path) -> DataFrame:
    """Anomaly records from JSON lines; nested columns may be objects or JSON text."""
    return parse_anomaly_log(spark.read.schema(schemas.ANOMALY_LOG).json(path))


def read_anomaly_pages(spark: SparkSession, path) -> DataFrame:
    """Anomaly records from page documents ``{items, total, skip, take}``."""
    page = schemas.T.StructType(
        [schemas.T.StructField("items", schemas.T.ArrayType(schemas.ANOMALY_LOG))]
    )
    pages = spark.read.option("multiLine", True).schema(page).json(path)
    return parse_anomaly_log(pages.select(F.explode("items").alias("i")).select("i.*"))
