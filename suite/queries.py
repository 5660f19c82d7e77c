"""One query per operator over the given tables; see ``oracle.py`` for their SQL."""

from __future__ import annotations

from datetime import datetime
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaflow import fixed_values as V
from rotaflow import schemas
from rotaflow.fixed_values import PARAMETERS
from rotaflow.functions import rules
from rotaflow.operators import (
    anomalies,
    anomaly_log,
    convert,
    debounce,
    edge,
    features,
    fleet,
    machine_models,
    model,
    quality,
    report,
    status,
)
from rotaflow.plans import carry
from rotaflow.plans.timeline import MAX_ROWS, Timeline
from rotaflow.session import free_shuffles, fresh_path
from rotaflow.sources import readers, warehouse, writers
from rotaflow.sources.log_store import DatedLog, RankedLog
from rotaflow.sources.outbox import Outbox
from rotaflow.streaming import live
from rotaflow.streaming.edge import stream_decisions, stream_edge_features
from rotaflow.streaming.edge import stream_edge_run as stream_edge_run_of
from rotaflow.streaming.ordered import Delays, arriving, state_store

PAUSE_MINUTES = 10_080  # readings of the given tables are days apart
SHIFT = 3.1e-9
EVENT_NOW = datetime(2024, 1, 31)


def r6(df: DataFrame, *names: str) -> DataFrame:
    """Rounds the named columns, or all doubles, to six places.

    The shift keeps values that lie half-way between two results (they occur in
    the given tables) from being rounded by the last bit of a sum.
    """
    chosen = names or [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: half_safe(n) for n in chosen})


def half_safe(column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.floor((column + SHIFT) * 1e6 + 0.5) / 1e6


def longs(df: DataFrame) -> DataFrame:
    """Counts as bigint, whatever function made them."""
    return df.withColumns({n: F.col(n).cast("long") for n, t in df.dtypes if t == "int"})


class Given:
    """Views over one data folder; ``max_rows`` lower than the data exercises slicing."""

    def __init__(self, spark: SparkSession, folder: str, max_rows: int = MAX_ROWS):
        self.spark, self.folder, self.max_rows = spark, folder, max_rows

    @cached_property
    def telemetry(self) -> DataFrame:
        return warehouse.telemetry(self.spark, self.folder)

    @cached_property
    def machines(self) -> DataFrame:
        return warehouse.machines(self.spark, self.folder)

    @cached_property
    def tolerances(self) -> DataFrame:
        return fleet.default_tolerances(self.spark)

    @cached_property
    def timeline(self) -> Timeline:
        return Timeline.of(self.telemetry, max_rows=self.max_rows)

    @cached_property
    def fleet(self) -> DataFrame:
        """Nameplate baselines."""
        return fleet.fleet_limits(self.machines, self.tolerances)

    @cached_property
    def early(self) -> DataFrame:
        return fleet.baseline_from_early(self.telemetry, self.timeline)

    @cached_property
    def early_fleet(self) -> DataFrame:
        """Baselines measured from each machine's first readings."""
        return fleet.fleet_limits(
            fleet.with_early_baseline(self.machines, self.early), self.tolerances
        )

    @cached_property
    def deviations(self) -> DataFrame:
        return status.deviation_pct(self.telemetry, self.fleet)

    @cached_property
    def flagged(self) -> DataFrame:
        return status.exceedance_flags(self.deviations)

    @cached_property
    def classified(self) -> DataFrame:
        return status.analyse(self.telemetry, self.fleet, self.timeline)

    @cached_property
    def early_classified(self) -> DataFrame:
        return status.analyse(self.telemetry, self.early_fleet, self.timeline)

    @cached_property
    def details(self) -> DataFrame:
        return status.first_exceedance_detail(self.flagged)

    @cached_property
    def failures(self) -> DataFrame:
        return warehouse.failures(self.spark, self.folder)

    @cached_property
    def sites(self) -> DataFrame:
        return warehouse.sites(self.spark, self.folder)

    @cached_property
    def scored(self) -> DataFrame:
        return anomalies.edge_score(self.telemetry, self.fleet)

    @cached_property
    def log(self) -> DataFrame:
        return warehouse.anomaly_log(self.spark, self.folder)

    @cached_property
    def vendor(self) -> DataFrame:
        return warehouse.vendor_log(self.spark, self.folder)

    @cached_property
    def curve(self) -> DataFrame:
        return warehouse.curve_test(self.spark, self.folder)

    @cached_property
    def labelled(self) -> DataFrame:
        made = features.engineer_features(self.deviations, self.timeline)
        return features.rul_labels(made, self.failures)

    @cached_property
    def split(self) -> DataFrame:
        """Training and test rows, stored once for the fit and for what it predicts."""
        return model.stored(features.chronological_split(self.labelled, self.timeline))

    def path(self, name: str) -> str:
        return fresh_path(self.spark, name)


QUERIES = {}


def query(make):
    QUERIES[make.__name__] = make
    return make


# -- sources ----------------------------------------------------------------------


def _file_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(new).alias(old) for old, new in names.items()])


@query
def read_baseline(g: Given) -> DataFrame:
    path = g.path("baseline")
    _file_columns(g.machines, V.BASELINE_COLUMNS).write.option("header", True).csv(path)
    return r6(readers.read_baseline(g.spark, path))


@query
def read_telemetry(g: Given) -> DataFrame:
    """Files of three layouts: the contract's, flow and head exchanged, and one column more."""
    path = g.path("telemetry")
    text = g.telemetry.withColumn("ts", F.date_format("ts", "M/d/yyyy H:mm"))
    rows = _file_columns(text, V.TELEMETRY_COLUMNS)
    exchanged = [*V.TELEMETRY_COLUMNS]
    exchanged[2], exchanged[3] = exchanged[3], exchanged[2]
    third = F.length("Well ID") % 3
    for k, layout in enumerate((rows, rows.select(*exchanged), rows.select(F.lit("x").alias("note"), *rows.columns))):
        layout.where(third == k).write.option("header", True).csv(f"{path}/{k}")
    return r6(readers.read_telemetry(g.spark, f"{path}/*").drop("reading_id"))


@query
def read_latest_feed(g: Given) -> DataFrame:
    path = g.path("feed")
    text = g.telemetry.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    _file_columns(text, V.TELEMETRY_COLUMNS).write.option("header", True).csv(path)
    feed = readers.read_latest_feed(g.spark, path)
    return feed.groupBy("well_id").agg(
        F.count("*").alias("readings"), F.max("ts").alias("newest_ts")
    )


@query
def read_vendor_log(g: Given) -> DataFrame:
    path = g.path("vendor")
    g.vendor.withColumns(
        {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("PumpLogDate", "FailTs")}
    ).write.option("header", True).csv(path)
    return r6(readers.read_vendor_log(g.spark, path))


@query
def read_curve_test(g: Given) -> DataFrame:
    path = g.path("curve")
    damaged = {new: f'{old}"' for old, new in V.CURVE_TEST_COLUMNS.items()}
    g.curve.withColumnsRenamed(damaged | {"site": "Site"}).write.option("header", True).option(
        "escape", '"'
    ).csv(path)
    return r6(readers.read_curve_test(g.spark, path))


@query
def load_tolerances(g: Given) -> DataFrame:
    """A tolerance file is written, read back and applied to the machines."""
    path = g.path("tolerances")
    cell = F.struct(
        "mandatory",
        F.coalesce("max_deviation", F.lit(V.NO_UPPER_LIMIT)).alias("max_deviation"),
        F.coalesce("min_deviation", F.lit(V.NO_LOWER_LIMIT)).alias("min_deviation"),
        "bidirectional",
    )
    entries = F.map_from_entries(F.collect_list(F.struct("param", cell)))
    categories = g.tolerances.groupBy("category").agg(entries.alias("tolerances"))
    category = F.struct("category", F.struct(F.col("category").alias("name"), "tolerances"))
    writers.write_json(categories.agg(F.map_from_entries(F.collect_list(category)).alias("categories")), path)
    tolerances = readers.load_tolerances(g.spark, path)
    limits = fleet.fleet_limits(g.machines, tolerances)
    return longs(fleet.machine_tolerances(limits, tolerances)).drop("bidirectional")


@query
def load_site_config(g: Given) -> DataFrame:
    """Site files, one per site, are written and read back."""
    path = g.path("sites")
    files = g.sites.select(
        F.struct("site_id", "pump_id", "sensor_ids").alias("site_info"),
        F.struct(F.lit(True).alias("enabled")).alias("anomaly_reporting"),
    )
    # the dimension is one small file, but every row becomes a file: all cores write, and each task moves its own files to their place
    spread = files.repartition(4 * g.spark.sparkContext.defaultParallelism, "pump_id")
    in_tasks = "mapreduce.fileoutputcommitter.algorithm.version"
    spread.write.option("maxRecordsPerFile", 1).option(in_tasks, "2").json(path)
    return readers.sensor_dimension(readers.load_site_config(g.spark, path))


@query
def pump_registry(g: Given) -> DataFrame:
    return r6(readers.pump_registry(g.machines))


@query
def read_anomaly_log(g: Given) -> DataFrame:
    path = g.path("log")
    raw = g.log.select(
        "id",
        F.lit("log").alias("sourceType"),
        "pumpId",
        "siteId",
        "sensorId",
        "logValue",
        rules.iso_z(F.col("ts")).alias("timestamp"),
        F.to_json(F.struct("status", F.lit("1U").alias("tolerance_category"))).alias(
            "additionalContext"
        ),
    )
    writers.write_json(raw, path)
    parsed = readers.read_anomaly_log(g.spark, path)
    return parsed.select(
        "id", "pumpId", "siteId", "sensorId", "logValue", "ts", "status", "tolerance_category"
    )


# -- sinks ------------------------------------------------------------------------


@query
def write_processed(g: Given) -> DataFrame:
    path = g.path("processed")
    writers.write_processed(status.processed(g.classified), path)
    return r6(g.spark.read.parquet(path).select("well_id", "ts", *status.DEVIATIONS, "status"))


@query
def write_anomaly_csv(g: Given) -> DataFrame:
    path = g.path("export")
    writers.write_anomaly_csv(g.log.withColumn("context", F.struct("status")), path)
    back = g.spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select(F.col("id").cast("long").alias("id"), "context")


@query
def write_inference_result(g: Given) -> DataFrame:
    path = g.path("results")
    newest = status.latest_reading(g.scored)
    result = anomalies.inference_result(newest, F.lit(False))
    writers.write_json(result, path)
    return g.spark.read.schema(result.schema).json(path).select(
        "well_id",
        "timestamp",
        "status",
        *[F.col("deviations")[p].alias(f"{p}_dev") for p in PARAMETERS],
        F.array_join(F.map_keys("violations"), ",").alias("violated"),
        "reported_to_api",
    )


@query
def anomaly_outbox(g: Given) -> DataFrame:
    path = g.path("outbox")
    payloads = anomalies.anomaly_payload(g.scored.where("mask > 0"), g.sites)
    writers.append_outbox(payloads, path)
    return g.spark.read.parquet(path).groupBy("siteId", "delivery_status").agg(
        F.count("*").alias("anomalies"), F.max("ts").alias("newest_ts")
    )


@query
def report_tables(g: Given) -> DataFrame:
    current = status.current_status(g.classified, g.fleet)
    tables = report.report_tables(g.fleet, g.tolerances, current, g.details, g.classified)
    return tables.select(
        "well_id",
        "category",
        "current_status",
        "monitor_every",
        F.array_join("actions", "; ").alias("actions"),
        F.array_join("watch", "; ").alias("watch"),
        "start_ts",
        "end_ts",
        F.col("days").cast("long").alias("days"),
        "alerts",
    )


@query
def generate_report(g: Given) -> DataFrame:
    current = status.current_status(g.classified, g.fleet)
    return report.render_reports(g.fleet, g.tolerances, current, g.details, g.classified)


# -- projections, filters, scalar rules ---------------------------------------------


@query
def well_filter(g: Given) -> DataFrame:
    return r6(g.telemetry.where(F.col("well_id") == "Well 3").drop("reading_id"))


@query
def running_filter(g: Given) -> DataFrame:
    return convert.running_only(g.vendor).select("SitePumpID", "PumpLogDate", "OutputCurrent")


@query
def stable_range_filter(g: Given) -> DataFrame:
    return r6(convert.stable_range(g.curve))


@query
def deviation_pct(g: Given) -> DataFrame:
    return r6(g.deviations.select("well_id", "ts", *status.DEVIATIONS))


@query
def deviation_pct_edge(g: Given) -> DataFrame:
    return g.scored.select("well_id", "ts", *[f"{p}_dev" for p in PARAMETERS])


@query
def tolerance_category(g: Given) -> DataFrame:
    return g.fleet.select("well_id", "application", half_safe("horsepower").alias("horsepower"),
                          "category")


@query
def exceedance_flags(g: Given) -> DataFrame:
    sides = ("max_exceeded", "min_exceeded", "exceeded")
    return g.flagged.select(
        "well_id", "ts", *[f"{p}_{s}" for p in PARAMETERS for s in sides]
    )


@query
def violation_map_edge(g: Given) -> DataFrame:
    entries = g.scored.select(
        "well_id", "ts", F.explode(anomalies.violations()).alias("param", "v")
    )
    return entries.select("well_id", "ts", "param", "v.*")


@query
def severity(g: Given) -> DataFrame:
    rated = status.severities(g.flagged)
    return r6(rated.select("well_id", "ts", *[f"{p}_severity" for p in PARAMETERS]))


@query
def classify_status(g: Given) -> DataFrame:
    return g.early_classified.select("well_id", "ts", "status", "sustained")


@query
def classify_status_edge(g: Given) -> DataFrame:
    return g.scored.select("well_id", "ts", "status", "mandatory_exceeded")


@query
def tolerance_band(g: Given) -> DataFrame:
    return r6(status.tolerance_band(g.telemetry, g.fleet))


@query
def band_excess(g: Given) -> DataFrame:
    series = status.parameter_series(g.telemetry, g.fleet).drop("reading_id")
    return r6(status.band_excess(series))


@query
def normalise_vendor_log(g: Given) -> DataFrame:
    return r6(convert.normalise_vendor_log(g.vendor, g.max_rows).drop("reading_id"))


@query
def amps_to_hp(g: Given) -> DataFrame:
    return r6(
        g.vendor.select(
            "SitePumpID", "PumpLogDate", rules.amps_to_hp(F.col("OutputCurrent")).alias("power")
        )
    )


@query
def hz_to_rpm(g: Given) -> DataFrame:
    return r6(
        g.vendor.select(
            "SitePumpID", "PumpLogDate", rules.hz_to_rpm(F.col("Frequency")).alias("speed")
        )
    )


@query
def flow_from_current(g: Given) -> DataFrame:
    stats = convert.vendor_statistics(g.vendor, g.max_rows)
    joined = convert.running_only(g.vendor).join(stats, "SitePumpID")
    flow = rules.flow_from_current(F.col("OutputCurrent"), F.col("median_current"))
    return r6(joined.select("SitePumpID", "PumpLogDate", "median_current", flow.alias("flow")))


@query
def eff_from_vibration(g: Given) -> DataFrame:
    stats = convert.vendor_statistics(g.vendor, g.max_rows)
    joined = convert.running_only(g.vendor).join(stats, "SitePumpID")
    made = rules.efficiency_from_vibration(F.col("VibrationLevel"), F.col("max_vibration"))
    return r6(joined.select("SitePumpID", "PumpLogDate", "max_vibration", made.alias("efficiency")))


@query
def hydraulic_efficiency(g: Given) -> DataFrame:
    power = rules.amps_to_hp(F.col("current_a"))
    made = rules.hydraulic_efficiency(F.col("flow_gpm"), F.col("head_ft"), power)
    return r6(
        g.curve.select(
            "site", "flow_gpm", "head_ft", power.alias("power"), made.alias("efficiency"),
            rules.horsepower_rating(power).alias("rating"),
        )
    )


@query
def abs_deviation(g: Given) -> DataFrame:
    made = {f"{p}_abs_deviation": F.abs(f"{p}_deviation_pct") for p in PARAMETERS}
    return r6(g.deviations.select("well_id", "ts", *[c.alias(n) for n, c in made.items()]))


@query
def interactions(g: Given) -> DataFrame:
    made = [c.alias(n) for n, c in features.interactions().items()]
    return r6(g.deviations.select("well_id", "ts", *made))


def _features(g: Given, *wanted: str) -> DataFrame:
    made = features.engineer_features(g.deviations, g.timeline)
    return r6(made.select("well_id", "ts", *[c for c in made.columns if any(w in c for w in wanted)]))


@query
def time_features(g: Given) -> DataFrame:
    return _features(g, "day_of_week", "hour_of_day")


@query
def rul_labels(g: Given) -> DataFrame:
    labelled = features.rul_labels(g.telemetry, g.failures)
    return r6(labelled.select("well_id", "ts", "rul_days"))


@query
def fail_soon_labels(g: Given) -> DataFrame:
    labelled = features.fail_soon_labels(g.telemetry, g.failures)
    return longs(labelled.select("well_id", "ts", "fails_soon"))


@query
def feature_select(g: Given) -> DataFrame:
    """Numeric columns left for a model, counted and summed per machine."""
    exclude = ("ts", "well_id", "status", "flow", "head", "suction", "power", "efficiency", "speed")
    columns = features.numeric_features(status.processed(g.classified), exclude)
    return r6(
        g.classified.groupBy("well_id").agg(
            F.lit(",".join(columns)).alias("features"),
            *[F.sum(F.coalesce(c, F.lit(0.0))).alias(f"{c}_sum") for c in columns],
        )
    )


@query
def failure_probability(g: Given) -> DataFrame:
    labelled = features.rul_labels(g.telemetry, g.failures)
    made = rules.failure_probability(F.col("rul_days")).alias("failure_probability")
    return r6(labelled.select("well_id", "ts", made))


@query
def rul_buckets_edge(g: Given) -> DataFrame:
    labelled = features.rul_labels(g.telemetry, g.failures)
    made = rules.edge_prediction(F.col("rul_days")).alias("p")
    return labelled.select("well_id", "ts", made).select("well_id", "ts", "p.*")


def _predicted(g: Given) -> DataFrame:
    """Scored readings with a prediction made from the known failure time."""
    labelled = features.rul_labels(g.scored, g.failures)
    return labelled.withColumn("prediction", rules.edge_prediction(F.col("rul_days")))


@query
def report_decision(g: Given) -> DataFrame:
    decided = anomalies.report_decision(
        debounce.with_decisions(_predicted(g), g.timeline, PAUSE_MINUTES)
    )
    return decided.select("well_id", "ts", "status", "report", "reason")


@query
def anomaly_payload(g: Given) -> DataFrame:
    payloads = anomalies.anomaly_payload(_predicted(g).where("mask > 0"), g.sites)
    return payloads.select(
        "well_id",
        "sourceType",
        "description",
        "siteId",
        "pumpId",
        "sensorId",
        "timestamp",
        half_safe("logValue").alias("logValue"),
        F.array_join("additionalContext.parameter", ",").alias("parameter"),
        F.col("additionalContext.status").alias("status"),
        F.col("additionalContext.tolerance_category").alias("tolerance_category"),
        half_safe(F.col("additionalContext.current_values")["flow"]).alias("current_flow"),
        F.col("metadata.modelName").alias("modelName"),
        F.col("metadata.prediction_rul_days").alias("prediction_rul_days"),
        F.col("metadata.prediction_probability").alias("prediction_probability"),
        F.col("metadata.confidence").alias("confidence"),
    )


@query
def simple_payload(g: Given) -> DataFrame:
    records = g.scored.where("mask > 0").join(g.sites, "well_id").select(
        F.col("site_id").alias("siteId"),
        F.col("pump_id").alias("pumpId"),
        F.concat(F.lit("Status "), F.col("status")).alias("description"),
        "status",
        F.col("category").alias("tolerance_category"),
        "ts",
        anomalies.param_map({p: F.col(f"{p}_dev") for p in PARAMETERS}).alias("deviations"),
        anomalies.param_map({p: F.col(f"baseline_{p}") for p in PARAMETERS}).alias(
            "baseline_values"
        ),
        anomalies.param_map({p: F.col(p) for p in PARAMETERS}).alias("current_values"),
    )
    made = anomalies.simple_payload(records)
    context = F.col("additionalContext")
    return made.select(
        "sourceType", "description", "siteId", "pumpId", "timestamp",
        context["status"].alias("status"),
        context["tolerance_category"].alias("tolerance_category"),
        context["all_deviations"]["flow"].alias("flow_dev"),
        half_safe(context["baseline_values"]["head"]).alias("baseline_head"),
    )


@query
def early_warning_thresholds(g: Given) -> DataFrame:
    return r6(fleet.early_warning_thresholds(g.fleet, g.tolerances))


@query
def recommendations(g: Given) -> DataFrame:
    made = status.recommendations(status.current_status(g.classified))
    return made.select(
        "well_id", "ts", "status", "monitoring_level", "monitor_every",
        F.array_join("watch", "; ").alias("watch"),
        F.array_join("actions", "; ").alias("actions"),
    )


@query
def tolerance_summary(g: Given) -> DataFrame:
    return fleet.tolerance_summary(g.fleet, g.tolerances)


@query
def anomaly_timeline(g: Given) -> DataFrame:
    return r6(status.anomaly_timeline(g.classified))


@query
def name_helpers(g: Given) -> DataFrame:
    """Units, labels, titles and slugs of every machine and sensor column."""
    names = F.array(*[F.lit(n) for n in V.TELEMETRY_COLUMNS])
    rows = g.machines.select("well_id", F.explode(names).alias("name"))
    return rows.select(
        "well_id",
        "name",
        rules.unit_of(F.col("name")).alias("unit"),
        rules.label_of(F.col("name")).alias("label"),
        rules.title_of(F.lower(rules.label_of(F.col("name")))).alias("title"),
        rules.slug_of(F.col("well_id")).alias("slug"),
    )


@query
def date_range_args(g: Given) -> DataFrame:
    start, end = anomaly_log.date_bounds("2024-01-10", "2024-01-20")
    found = anomaly_log.log_filter(g.log, start=start, end=end)
    return found.select("id", "pumpId", "ts", "status")


@query
def status_code(g: Given) -> DataFrame:
    return longs(status.status_strip(g.classified))


# -- data quality -------------------------------------------------------------------


def _dirty(g: Given) -> DataFrame:
    """Telemetry with faults that follow from its own values."""
    t = g.telemetry
    return t.withColumns(
        {
            "flow": F.when(F.col("flow") < 435, -F.col("flow")).otherwise(F.col("flow")),
            "head": F.when(F.col("head") > 163, F.lit(None)).otherwise(F.col("head")),
            "power": F.when(F.col("power") > 82, F.lit(float("nan"))).otherwise(F.col("power")),
            "efficiency": F.when(F.col("efficiency") > 88.5, F.col("efficiency") + 20).otherwise(
                F.col("efficiency")
            ),
        }
    )


@query
def dq_required_columns(g: Given) -> DataFrame:
    quality.required_columns(g.telemetry, ["well_id", "ts", *quality.SENSORS])
    return g.telemetry.groupBy("well_id").agg(F.count("*").alias("readings"))


@query
def dq_empty(g: Given) -> DataFrame:
    quality.check_not_empty(g.telemetry)
    return g.telemetry.agg(F.count("*").alias("readings"), (F.count("*") == 0).alias("empty"))


@query
def dq_duplicate_ts(g: Given) -> DataFrame:
    return quality.duplicate_timestamps(g.telemetry)


@query
def dq_monotonic(g: Given) -> DataFrame:
    """Order numbers stand for the arrival sequence of a machine's readings."""
    arrived = g.telemetry.withColumns(
        {
            "seq": F.col("reading_id.l_orderkey"),
            "line": F.col("reading_id.l_linenumber"),
            "part": F.col("reading_id.l_partkey"),
        }
    )
    arrival = Timeline.of(
        arrived, order=("seq", "line", "part", "ts"), max_rows=g.max_rows, halo=1,
        numeric_clock=True,
    )
    return quality.not_monotonic(arrived, arrival)


@query
def dq_negative(g: Given) -> DataFrame:
    return quality.negative_values(_dirty(g))


@query
def dq_efficiency_range(g: Given) -> DataFrame:
    return quality.efficiency_range(_dirty(g))


@query
def dq_missing(g: Given) -> DataFrame:
    return quality.missing_values(_dirty(g))


@query
def dq_validate(g: Given) -> DataFrame:
    return quality.validate(_dirty(g))


@query
def dq_baseline(g: Given) -> DataFrame:
    faulty = fleet.machine_registry(g.machines).withColumns(
        {
            "horsepower": F.when(F.col("horsepower") < 20, F.lit(0.0)).otherwise(
                F.col("horsepower")
            ),
            "baseline_efficiency": F.when(F.col("category") == "1E", F.lit(120.0)).otherwise(
                F.col("baseline_efficiency")
            ),
        }
    )
    repeated = faulty.where(F.length("well_id") == 6).withColumn("pump_type", F.lit("other"))
    return quality.baseline_violations(faulty.unionByName(repeated.where("horsepower >= 20 AND category <> '1E'")))


@query
def dq_payload(g: Given) -> DataFrame:
    """Events as text payloads, some with fields that break a rule."""
    text = g.log.select(
        "id",
        F.when(F.col("pumpId") % 11 == 0, F.lit(None))
        .when(F.col("pumpId") % 11 == 1, "sound").otherwise("log").alias("sourceType"),
        F.when(F.col("pumpId") % 13 != 0, F.col("status")).alias("description"),
        F.col("siteId").cast("string").alias("siteId"),
        F.when(F.col("pumpId") % 7 == 0, F.concat(F.lit("p"), F.col("pumpId")))
        .otherwise(F.col("pumpId").cast("string")).alias("pumpId"),
        F.col("sensorId").cast("string").alias("sensorId"),
        F.when(F.col("pumpId") % 5 == 0, "yesterday").otherwise(rules.iso_z(F.col("ts"))).alias(
            "timestamp"
        ),
        F.when(F.col("pumpId") % 3 == 0, "high")
        .otherwise(F.col("logValue").cast("string")).alias("logValue"),
    )
    checked = quality.payload_violations(text)
    return checked.select("id", F.explode("failed").alias("violation"))


# -- joins --------------------------------------------------------------------------


@query
def join_baseline(g: Given) -> DataFrame:
    joined = status.join_baseline(g.telemetry, g.early_fleet)
    return r6(joined.select("well_id", "ts", *[f"baseline_{p}" for p in PARAMETERS]))


@query
def unmatched_machines(g: Given) -> DataFrame:
    """Machines whose registry entry has too little power count as unregistered."""
    known = g.machines.where("horsepower >= 50")
    return fleet.unmatched_machines(g.telemetry, known)


@query
def join_tolerance(g: Given) -> DataFrame:
    limits = [f"{p}_{s}" for p in PARAMETERS for s in ("max", "min", "mandatory")]
    return g.fleet.select("well_id", "category", *limits)


@query
def join_first_exceedance_value(g: Given) -> DataFrame:
    return r6(g.details.select("well_id", "param", "deviation"))


@query
def join_sensor(g: Given) -> DataFrame:
    payloads = anomalies.anomaly_payload(g.scored.where("mask > 0"), g.sites)
    return payloads.groupBy("sensorId").agg(
        F.count("*").alias("anomalies"), half_safe(F.avg("logValue")).alias("mean_value")
    )


@query
def join_failure_date(g: Given) -> DataFrame:
    newest = g.telemetry.groupBy("well_id").agg(F.max("ts").alias("newest_ts"))
    return newest.join(g.failures, "well_id")


@query
def category_by_hp(g: Given) -> DataFrame:
    return g.fleet.where(F.col("application").isin(*V.HORSEPOWER_APPLICATIONS)).groupBy(
        "application", "category"
    ).agg(F.count("*").alias("machines"), half_safe(F.max("horsepower")).alias("largest_hp"))


# -- aggregations -------------------------------------------------------------------


@query
def first_exceedance(g: Given) -> DataFrame:
    return status.first_exceedance(g.flagged)


@query
def first_exceedance_detail(g: Given) -> DataFrame:
    return r6(g.details)


@query
def time_to_failure(g: Given) -> DataFrame:
    return status.time_to_failure(g.details, g.failures)


@query
def status_distribution(g: Given) -> DataFrame:
    return status.status_distribution(g.early_classified)


@query
def fleet_status(g: Given) -> DataFrame:
    """How is the fleet doing: statuses by tolerance category, baselines from early readings."""
    return status.fleet_status_distribution(g.early_classified)


@query
def analysis_period(g: Given) -> DataFrame:
    return longs(status.analysis_period(g.telemetry))


@query
def mean_deviation(g: Given) -> DataFrame:
    return r6(status.mean_deviation(g.deviations))


@query
def baseline_from_early(g: Given) -> DataFrame:
    return r6(g.early)


@query
def baseline_from_curve_test(g: Given) -> DataFrame:
    return r6(convert.baseline_from_curve_test(g.curve, max_rows=g.max_rows))


@query
def source_summary(g: Given) -> DataFrame:
    return r6(convert.source_summary(g.vendor))


@query
def curve_summary(g: Given) -> DataFrame:
    return r6(convert.curve_summary(g.curve))


@query
def label_stats(g: Given) -> DataFrame:
    labelled = features.fail_soon_labels(
        features.rul_labels(g.telemetry, g.failures), g.failures
    )
    return r6(longs(features.label_stats(labelled)))


@query
def regression_metrics(g: Given) -> DataFrame:
    """Errors of a plain guess (30 days left, always) on both parts of the split."""
    labelled = features.rul_labels(g.telemetry, g.failures).withColumn("prediction", F.lit(30.0))
    return r6(model.regression_metrics(features.chronological_split(labelled, g.timeline)))


@query
def anomaly_summary(g: Given) -> DataFrame:
    return anomaly_log.anomaly_summary(g.log)


@query
def compare_pumps(g: Given) -> DataFrame:
    return anomaly_log.compare_pumps(g.log)


@query
def anomaly_timeline_pivot(g: Given) -> DataFrame:
    made = anomaly_log.timeline_pivot(g.log)
    return made.withColumnsRenamed({s: s.lower() for s in V.STATUSES})


@query
def latest_24_stats(g: Given) -> DataFrame:
    return r6(features.latest_24_stats(g.telemetry, g.timeline))


# -- windows ------------------------------------------------------------------------


@query
def rolling_stats(g: Given) -> DataFrame:
    return _features(g, "_rolling_")


@query
def rolling_long(g: Given) -> DataFrame:
    """A frame of 480 readings, put together from blocks."""
    made = features.engineer_features(g.deviations, g.timeline, (35, 480))
    return r6(made.select("well_id", "ts", *[c for c in made.columns if c.endswith("_480h") and "_rolling_" in c]))


@query
def rolling_time(g: Given) -> DataFrame:
    """Statistics over the readings of the last 30 days, however many."""
    return r6(features.rolling_time(g.deviations, g.timeline, 720.0).drop("reading_id"))


@query
def slope(g: Given) -> DataFrame:
    return _features(g, "_slope_")


@query
def acceleration(g: Given) -> DataFrame:
    return _features(g, "_acceleration_")


@query
def cumulative_deviation(g: Given) -> DataFrame:
    return _features(g, "_cumulative_")


@query
def hours_since_start(g: Given) -> DataFrame:
    return _features(g, "hours_since_start")


@query
def engineer_features(g: Given) -> DataFrame:
    return r6(features.engineer_features(g.deviations, g.timeline).drop("reading_id"))


@query
def deviation_trend(g: Given) -> DataFrame:
    return r6(status.deviation_trend(g.deviations, g.timeline).drop("reading_id"))


@query
def sustained_violation(g: Given) -> DataFrame:
    made = g.classified.where(F.col("first_mandatory").isNotNull())
    return made.select("well_id", "ts", "reading_number", "first_mandatory", "sustained")


@query
def ffill(g: Given) -> DataFrame:
    gaps = g.telemetry.select(
        "well_id",
        "ts",
        "reading_id",
        F.when(F.col("flow") < 530, F.col("flow")).alias("flow"),
        F.when(F.col("power") > 78, F.col("power")).alias("power"),
    )
    return r6(features.fill_forward(gaps, ["flow", "power"], g.timeline).drop("reading_id"))


@query
def chronological_split(g: Given) -> DataFrame:
    made = features.chronological_split(g.telemetry, g.timeline)
    return made.groupBy("well_id", "is_test").agg(
        F.count("*").alias("readings"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@query
def current_status(g: Given) -> DataFrame:
    return status.current_status(g.classified, g.machines)


@query
def status_episodes(g: Given) -> DataFrame:
    return r6(status.status_episodes(g.classified, g.timeline))


# -- order and top-k ------------------------------------------------------------------


@query
def sort_by_time(g: Given) -> DataFrame:
    return g.telemetry.orderBy("ts", "well_id", "reading_id").select(
        "well_id", "ts", F.col("reading_id.l_orderkey").alias("order_key")
    )


@query
def latest_reading(g: Given) -> DataFrame:
    return r6(status.latest_reading(g.telemetry).drop("reading_id"))


@query
def first_n_per_pump(g: Given) -> DataFrame:
    return r6(g.timeline.first_rows(g.telemetry, V.EARLY_ROWS).select("well_id", "ts", *PARAMETERS))


@query
def exceedance_order(g: Given) -> DataFrame:
    return status.exceedance_order(g.details)


@query
def contributing_factors(g: Given) -> DataFrame:
    """Largest features of each reading, all of equal importance."""
    names = [n for n in schemas.feature_names() if "24h" not in n and "168h" not in n]
    names = [n for n in names if "cumulative" not in n and n != "hours_since_start"]
    made = features.engineer_features(g.deviations, g.timeline)
    factors = model.contributing_factors(names, [1.0] * len(names))
    return made.select("well_id", "ts", F.array_join(factors, ",").alias("factors"))


@query
def anomaly_page(g: Given) -> DataFrame:
    return anomaly_log.anomaly_page(g.log, page=3, page_size=25, site_id=4).drop("cameraId")


@query
def anomaly_page_keyset(g: Given) -> DataFrame:
    """The page behind a known last row, oldest first."""
    return anomaly_log.anomaly_page(
        g.log, take=40, direction="asc", after=("2024-01-15 00:00:00", 0)
    ).drop("cameraId")


@query
def anomaly_page_total(g: Given) -> DataFrame:
    return anomaly_log.page_total(g.log, skip=50, take=25, site_id=4)


@query
def anomaly_query(g: Given) -> DataFrame:
    return anomaly_log.anomaly_query(g.log, days_back=7, max_results=1000, now=EVENT_NOW).drop("cameraId")


@query
def result_retention(g: Given) -> DataFrame:
    return anomaly_log.retention(g.log, EVENT_NOW, days=14).groupBy("siteId").agg(
        F.count("*").alias("anomalies"), F.min("ts").alias("oldest_ts")
    )


@query
def union_readings(g: Given) -> DataFrame:
    """Readings of two feeds as one table."""
    early = g.telemetry.where("ts < timestamp_ntz'1999-01-01'")
    late = g.telemetry.where("ts >= timestamp_ntz'1999-01-01'")
    return early.unionByName(late).groupBy("well_id").agg(
        F.count("*").alias("readings"), F.round(F.sum("flow"), 4).alias("flow_sum")
    )


# -- debouncing and streams -----------------------------------------------------------


@query
def debounce_anomalies(g: Given) -> DataFrame:
    return debounce.debounce(g.scored, g.timeline, PAUSE_MINUTES).select(
        "well_id", "ts", F.col("mask").cast("long").alias("mask"), "blocked_by", "elapsed_minutes"
    )


@query
def debounce_documented(g: Given) -> DataFrame:
    made = debounce.debounce(
        g.scored, g.timeline, PAUSE_MINUTES, reset_on_normal=True, escalation_bypasses=True
    )
    return made.select(
        "well_id", "ts", F.col("mask").cast("long").alias("mask"), "blocked_by", "elapsed_minutes"
    )


@query
def ml_gate(g: Given) -> DataFrame:
    return features.ml_gate(g.telemetry, minimum=600)


def _live(g: Given) -> DataFrame:
    return warehouse.telemetry_view(warehouse.stream(g.spark, g.folder, "lineitem"))


@query
def stream_status(g: Given) -> DataFrame:
    scored = live.stream_status(_live(g), g.fleet).select(
        "well_id", "ts", "status", "mandatory_exceeded"
    )
    return live.run_to_table(scored, g.path("live"), g.path("live-state"))


JITTER_DAYS = 30  # readings arrive this much later than they were taken, at most
DELAYS = Delays(order=(JITTER_DAYS + 1) * 1440, late=1440)
ARRIVALS = 5  # micro-batches
READY_FROM = 40


def _cores(g: Given) -> int:
    """Files of a micro-batch, and parts of the state."""
    return max(4, g.spark.sparkContext.defaultParallelism)


def _arriving(g: Given) -> DataFrame:
    """The telemetry as a stream out of order: each file holds what arrived in a stretch of time, in no order.

    All files are written in one job; a stream takes files by the time they were written at, so they are given times in the order of arrival.
    A marker far in the future ends the stream, so that the watermark passes all readings.
    """
    path, files = g.path("arrivals"), _cores(g)
    late = F.pmod(F.xxhash64("reading_id"), F.lit(JITTER_DAYS)).cast("int")
    rows = g.telemetry.withColumn("_day", F.date_diff(F.col("ts"), F.lit("1990-01-01").cast("date")) + late)
    first, last = rows.agg(F.min("_day"), F.max("_day")).first()
    part = F.floor((F.col("_day") - first) * ARRIVALS / (last - first + 1))
    known = rows.withColumn("part", part).where("part IS NOT NULL").drop("_day")
    known.repartition(files, "reading_id").write.partitionBy("part").parquet(path)
    end = g.telemetry.limit(1).withColumns(
        {"well_id": F.lit("end of stream"), "ts": F.lit("2100-01-01 00:00:00").cast("timestamp_ntz")}
    )
    end.write.parquet(f"{path}/part={ARRIVALS}")
    writers.in_turn(g.spark, [f"{path}/part={k}" for k in range(ARRIVALS + 1)])
    reader = g.spark.readStream.schema(g.telemetry.schema).option("maxFilesPerTrigger", files)
    return reader.parquet(f"{path}/part=*")


@query
def stream_debounce(g: Given) -> DataFrame:
    """Alarms that arrive out of order over five micro-batches, decided in event-time order."""
    scored = live.stream_status(arriving(_arriving(g), DELAYS), g.fleet)
    made = live.run_to_table(
        stream_decisions(scored, DELAYS, PAUSE_MINUTES), g.path("decisions"), g.path("decisions-state"), partitions=_cores(g)
    )
    return made.where("NOT late").select(
        "well_id", "ts", F.col("mask").cast("long").alias("mask"), "blocked_by", "elapsed_minutes"
    )


@query
def stream_dedup(g: Given) -> DataFrame:
    once = live.watermarked(_live(g), dedup=True).select("well_id", "ts", *PARAMETERS)
    return live.run_to_table(once, g.path("once"), g.path("once-state"))


@query
def stream_rolling_24(g: Given) -> DataFrame:
    """Each machine's newest statistics after readings that arrived out of order."""
    made = live.run_to_table(
        stream_edge_features(_arriving(g), DELAYS, minimum=600), g.path("rolling"), g.path("rolling-state"), partitions=_cores(g)
    )
    made = made.where("NOT late AND well_id <> 'end of stream'")
    stats = [F.col(f"recent_{n}").alias(n) for n in (f"{p}_{s}" for p in PARAMETERS for s in edge.STATISTICS)]
    newest = F.max_by(F.struct("ts", "readings", "ready", *stats), F.struct("ts", "reading_id"))
    return r6(longs(made.groupBy("well_id").agg(newest.alias("r")).select("well_id", "r.*")))


@query
def stream_outbox(g: Given) -> DataFrame:
    scored = live.stream_status(_live(g), g.fleet).where("mask > 0")
    payloads = anomalies.anomaly_payload(scored, g.sites)
    path = g.path("outbox")
    live.start_outbox(payloads, path, g.path("outbox-state"), available_now=True).awaitTermination()
    sent = g.spark.read.parquet(path)
    return sent.groupBy("siteId", "delivery_status").agg(
        F.count("*").alias("anomalies"), F.max("ts").alias("newest_ts")
    )


# -- stored tables with maintenance -----------------------------------------------------


@query
def keyed_outbox(g: Given) -> DataFrame:
    """Two runs over the same anomalies, then deliveries: some arrive, some fail."""
    payloads = anomalies.anomaly_payload(g.scored.where("mask > 0"), g.sites)
    box = Outbox(g.spark, g.path("keyed-outbox"), payloads.schema, buckets=8)
    box.add(payloads.where("ts < timestamp_ntz'1999-01-01'"))
    box.add(payloads)
    outcome = F.when(F.col("pumpId") % 3 == 0, "sent").when(F.col("pumpId") % 3 == 1, "failed")
    box.mark(payloads.select("well_id", "ts", outcome.alias("delivery_status")).where("delivery_status IS NOT NULL"))
    return box.read().groupBy("siteId", "delivery_status").agg(F.count("*").alias("anomalies"))


@query
def retention_store(g: Given) -> DataFrame:
    """Retention of a stored log: whole days go, one day is written anew."""
    log = g.log.drop("cameraId")
    store = DatedLog(g.spark, g.path("dated-log"), log.schema)
    store.append(log)
    store.retain(EVENT_NOW, 14)
    return store.read().groupBy("siteId").agg(F.count("*").alias("anomalies"), F.min("ts").alias("oldest_ts"))


@query
def anomaly_page_deep(g: Given) -> DataFrame:
    """A page far from the newest, from the ranges that hold its ranks."""
    log = g.log.drop("cameraId")
    store = RankedLog(g.spark, g.path("ranked-log"), log.schema)
    store.build(log, 16)
    return store.page(skip=400, take=30)


# -- state carried from batch to batch ------------------------------------------------

BATCHES = ("1900-01-01", "1996-06-01", "1999-01-01", "2000-01-01", "2001-01-01", "2200-01-01")


def _advanced(g: Given) -> tuple[str, list[carry.Advanced]]:
    """The history fed in five batches."""
    path = g.path("carry")
    made = []
    for k, (low, high) in enumerate(zip(BATCHES, BATCHES[1:])):
        part = g.telemetry.where(f"ts >= timestamp_ntz'{low}' AND ts < timestamp_ntz'{high}'")
        made.append(carry.advance(part, g.fleet, path, k, g.max_rows))
    return path, made


@query
def incremental_status(g: Given) -> DataFrame:
    """Statuses and features of all readings, batch by batch."""
    _, made = _advanced(g)
    kept = ("flow_rolling_mean_168h", "head_slope_168h", "power_cumulative_deviation", "hours_since_start")
    parts = [a.together.select("well_id", "ts", "reading_id", *carry.TOLD, *kept) for a in made]
    return r6(reduce(DataFrame.unionByName, parts).drop("reading_id"))


@query
def incremental_current_status(g: Given) -> DataFrame:
    """Newest status and first exceedances, from the carry table after the last batch."""
    path, _ = _advanced(g)
    state = carry.read_state(g.spark, path)
    return carry.current_status(state, g.machines).join(carry.first_exceedance(state), "well_id", "left")


# -- the edge run -------------------------------------------------------------------

EDGE_FEATURES = ["recent_flow_mean"]


def _edge_split(g: Given) -> DataFrame:
    made = edge.edge_features(g.telemetry, g.timeline, minimum=READY_FROM)
    return features.chronological_split(features.rul_labels(made, g.failures), g.timeline)


def _edge_models(g: Given) -> DataFrame:
    """Models of every machine, saved as a version and loaded again."""
    path = g.path("edge-models")
    fitted = machine_models.fit_machines(_edge_split(g), EDGE_FEATURES)
    machine_models.save_models(fitted, path, "2.0", EDGE_FEATURES)
    return machine_models.load_models(g.spark, path, "2.0")[0]


@query
def machine_model(g: Given) -> DataFrame:
    """Remaining life by the mean flow of the newest readings: a line per machine."""
    fitted = machine_models.fit_machines(_edge_split(g), EDGE_FEATURES)
    line = fitted.select("well_id", "readings", "intercept", F.col("coefficients")[0].alias("slope"))
    return line.withColumns({c: F.round(c, 4) + 0.0 for c in ("intercept", "slope")})


def _edge_digest(records: DataFrame) -> DataFrame:
    return records.select(
        "well_id", "ts", "description", "sensorId", "reason",
        half_safe("logValue").alias("logValue"),
        F.col("additionalContext.status").alias("status"),
        F.col("metadata.modelVersion").alias("modelVersion"),
        F.col("metadata.model_type").alias("model_type"),
        F.col("metadata.prediction_rul_days").alias("prediction_rul_days"),
        F.col("metadata.prediction_probability").alias("prediction_probability"),
    )


@query
def edge_run(g: Given) -> DataFrame:
    """What the edge reports: debounced alarms with the remaining life that each machine's model gives."""
    return _edge_digest(
        edge.edge_run(
            g.telemetry, g.fleet, g.sites, _edge_models(g), EDGE_FEATURES, g.timeline,
            minutes=PAUSE_MINUTES, minimum=READY_FROM,
        )
    )


@query
def stream_edge_run(g: Given) -> DataFrame:
    """The same as one stream with two stateful operators, over readings that arrive out of order; sent through the outbox."""
    run = stream_edge_run_of(
        _arriving(g), g.fleet, g.sites, _edge_models(g), EDGE_FEATURES, DELAYS, minutes=PAUSE_MINUTES, minimum=READY_FROM
    )
    path = g.path("edge-outbox")
    with state_store(g.spark, _cores(g)):
        query = live.start_outbox(run, path, g.path("edge-state"), available_now=True)
    query.awaitTermination()
    return _edge_digest(g.spark.read.parquet(path))


# -- models -------------------------------------------------------------------------


@query
def scale_features(g: Given) -> DataFrame:
    columns = list(status.DEVIATIONS)
    frame = g.deviations.select("well_id", "ts", *columns)
    return r6(features.scale_features(frame, features.fit_scaler(frame, columns), columns))


@query
def train_rul(g: Given) -> DataFrame:
    batches = features.training_batches(g.deviations, g.timeline, g.failures)
    return r6(model.train_line(g.spark, batches).metrics)


@query
def train_rul_forest(g: Given) -> DataFrame:
    return r6(model.train_rul(g.split, is_stored=True).metrics)


@query
def feature_importance_topk(g: Given) -> DataFrame:
    trained = model.train_rul(g.split, model_type="gradient_boosting", trees=5, is_stored=True)
    return r6(model.feature_importance_topk(trained.importance))


@query
def predict_rul(g: Given) -> DataFrame:
    """Every machine's newest reading scored by a forest."""
    trained = model.train_rul(g.split, trees=20, is_stored=True)
    newest = status.latest_reading(g.split)
    return r6(model.predict_rul(trained.model, newest).drop("prediction", "contributing_factors"))


@query
def save_load_model(g: Given) -> DataFrame:
    """A saved and reloaded model scores the newest readings."""
    path = g.path("model")
    batches = features.training_batches(g.deviations, g.timeline, g.failures)
    model.save_model(model.train_line(g.spark, batches), path, "linear", "fleet")
    free_shuffles(g.spark)
    loaded, names = model.load_model(g.spark, path)
    scored = model.predict_rul(loaded, batches.newest(), names)
    told = g.spark.read.parquet(f"{path}/metadata").select("version", "model_type", "framework").first()
    kept = scored.select("well_id", "ts", "rul_days", "rul_lower", "rul_upper")
    return r6(kept.withColumns({name: F.lit(told[name]) for name in told.asDict()}))
