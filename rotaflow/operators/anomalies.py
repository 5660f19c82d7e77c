"""Edge scoring, report decision and nested anomaly records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotaflow import fixed_values as V
from rotaflow.fixed_values import PARAMETERS
from rotaflow.functions import rules
from rotaflow.operators.status import join_baseline


def param_map(columns: dict[str, Column]) -> Column:
    return F.create_map(*[x for p, c in columns.items() for x in (F.lit(p), c)])


def edge_score(telemetry: DataFrame, fleet: DataFrame) -> DataFrame:
    """Scores each reading on its own: no shuffle beyond the dimension join.

    Works on batch and streaming frames alike. Adds per parameter ``{p}_dev``
    (rounded), ``{p}_limit`` and ``{p}_side`` (NULL unless violated), and ``mask``
    (bit set of violated parameters), ``mandatory_exceeded`` and ``status``.
    """
    scored = join_baseline(telemetry, fleet).withColumns(
        {
            f"{p}_dev": rules.edge_deviation(rules.clean(F.col(p)), F.col(f"baseline_{p}"))
            for p in PARAMETERS
        }
    )
    parts = {p: [F.col(f"{p}_{c}") for c in ("dev", "max", "min")] for p in PARAMETERS}
    scored = scored.withColumns(
        {f"{p}_limit": rules.edge_limit(*parts[p]) for p in PARAMETERS}
        | {f"{p}_side": rules.edge_side(*parts[p]) for p in PARAMETERS}
    )
    hit = hits()
    mandatory = F.lit(False)
    mask = F.lit(0)
    for bit, p in enumerate(PARAMETERS):
        mandatory = mandatory | (hit[p] & F.col(f"{p}_mandatory"))
        mask = mask + F.when(hit[p], 1 << bit).otherwise(0)
    scored = scored.withColumns({"mask": mask, "mandatory_exceeded": mandatory})
    dev = {p: F.col(f"{p}_dev") for p in PARAMETERS}
    limit = {p: F.col(f"{p}_limit") for p in PARAMETERS}
    return scored.withColumn(
        "status", rules.edge_status(hit, dev, limit, F.col("mandatory_exceeded"))
    )


def hits() -> dict[str, Column]:
    return {p: F.col(f"{p}_limit").isNotNull() for p in PARAMETERS}


def violations() -> Column:
    """Map parameter -> deviation, threshold, side and need, of violated parameters only."""
    entries = {
        p: F.struct(
            F.lit(p).alias("key"),
            F.struct(
                F.col(f"{p}_dev").alias("deviation"),
                F.col(f"{p}_limit").alias("threshold"),
                F.col(f"{p}_side").alias("threshold_type"),
                F.col(f"{p}_mandatory").alias("mandatory"),
            ).alias("value"),
        )
        for p in PARAMETERS
    }
    return F.map_from_entries(rules.chosen(hits(), entries))


def worst_parameter() -> Column:
    """Violated parameter with the largest absolute deviation; the first wins ties."""
    size = {p: F.when(F.col(f"{p}_limit").isNotNull(), F.abs(f"{p}_dev")) for p in PARAMETERS}
    largest = F.greatest(*size.values())
    return F.coalesce(*[F.when(size[p] == largest, F.lit(p)) for p in PARAMETERS])


def report_decision(decided: DataFrame) -> DataFrame:
    """Adds ``report`` and ``reason``.

    Expects ``status``, ``mandatory_exceeded``, ``blocked_by``, ``elapsed_minutes``
    (both NULL when not debounced) and ``prediction`` (struct, may be NULL).
    """
    likely = (F.col("prediction.probability") > V.REPORT_PROBABILITY_ABOVE) & (
        F.col("prediction.rul_days") < V.REPORT_RUL_BELOW
    )
    debounced = F.col("blocked_by").isNotNull()
    reason = (
        F.when(F.col("status") == "Normal", V.REASONS["normal"])
        .when(debounced, F.format_string(V.REASONS["debounced"], "blocked_by", "elapsed_minutes"))
        .when(F.col("mandatory_exceeded"), V.REASONS["mandatory"])
        .when(
            F.col("status").isin("Critical", "Failure"),
            F.concat(F.lit(V.REASONS["status"]), F.col("status")),
        )
        .when(F.coalesce(likely, F.lit(False)), V.REASONS["prediction"])
        .when(F.col("status") == "Warning", V.REASONS["warning"])
        .otherwise(V.REASONS["none"])
    )
    report = (F.col("status") != "Normal") & ~debounced
    return decided.withColumns({"report": report, "reason": reason})


def no_prediction() -> Column:
    return F.lit(None).cast("struct<rul_days:double,probability:double,confidence:double>")


def anomaly_payload(
    scored: DataFrame, sites: DataFrame, model_version: str = V.MODEL_VERSION,
    model_type: str = "random_forest",
) -> DataFrame:
    """The nested record of each reported reading.

    ``sites`` holds ``well_id, site_id, pump_id, sensor_ids`` (map), one row per
    machine; it is left-joined without a forced broadcast. ``scored`` may carry a
    ``prediction`` struct, the ``model_version`` it came from, and the ``reason`` of the
    report, which stays.
    """
    hit = hits()
    texts = [
        F.when(
            hit[p],
            F.concat(
                F.lit(f"{p}: "),
                rules.one_decimal(F.col(f"{p}_dev")),
                F.lit("% (threshold: "),
                rules.one_decimal(F.col(f"{p}_limit")),
                F.lit("%)"),
            ),
        )
        for p in PARAMETERS
    ]
    prediction = F.col("prediction") if "prediction" in scored.columns else no_prediction()
    known = prediction.isNotNull()
    current = param_map({p: F.col(p).cast("double") for p in PARAMETERS})
    context = F.struct(
        rules.chosen(hit, {p: F.lit(p) for p in PARAMETERS}).alias("parameter"),
        F.col("status"),
        F.col("category").alias("tolerance_category"),
        param_map({p: F.col(f"{p}_dev") for p in PARAMETERS}).alias("all_deviations"),
        param_map({p: F.col(f"baseline_{p}") for p in PARAMETERS}).alias("baseline_values"),
        current.alias("current_values"),
    )
    version = F.lit(model_version)
    if "model_version" in scored.columns:
        version = F.coalesce(F.col("model_version"), version)
    metadata = F.struct(
        F.lit(V.MODEL_NAME).alias("modelName"),
        version.alias("modelVersion"),
        F.lit(V.FRAMEWORK).alias("framework"),
        F.col("category").alias("tolerance_category"),
        prediction["confidence"].alias("confidence"),
        prediction["rul_days"].alias("prediction_rul_days"),
        prediction["probability"].alias("prediction_probability"),
        F.when(known, F.lit(model_type)).alias("model_type"),
    )
    joined = scored.join(sites, "well_id", "left").withColumn("_worst", worst_parameter())
    sensor = F.col("sensor_ids")[F.col("_worst")]
    measured = F.coalesce(*[F.when(F.col("_worst") == p, F.col(p)) for p in PARAMETERS])
    return joined.select(
        "well_id",
        "ts",
        F.lit("log").alias("sourceType"),
        F.concat(F.lit(V.DESCRIPTION_PREFIX), F.concat_ws(", ", *texts)).alias("description"),
        F.col("site_id").alias("siteId"),
        F.col("pump_id").alias("pumpId"),
        sensor.alias("sensorId"),
        rules.iso_z(F.col("ts")).alias("timestamp"),
        F.when(sensor.isNotNull(), measured.cast("double")).alias("logValue"),
        context.alias("additionalContext"),
        metadata.alias("metadata"),
        *[c for c in ("reason",) if c in scored.columns],
    )


def simple_payload(records: DataFrame) -> DataFrame:
    """Reduced record built from given columns and maps.

    Expects ``siteId, pumpId, description, status, deviations, baseline_values,
    current_values, tolerance_category`` and optionally ``sensorId, logValue,
    ts, metadata``; absent optional columns stay absent.
    """
    context = F.struct(
        F.col("status"),
        F.col("tolerance_category"),
        F.col("deviations").alias("all_deviations"),
        F.col("baseline_values"),
        F.col("current_values"),
    )
    stamp = rules.iso_z(F.coalesce(F.col("ts"), F.localtimestamp())) if (
        "ts" in records.columns
    ) else rules.iso_z(F.localtimestamp())
    optional = [c for c in ("sensorId", "logValue", "metadata") if c in records.columns]
    return records.select(
        F.lit("log").alias("sourceType"),
        "description",
        "siteId",
        "pumpId",
        stamp.alias("timestamp"),
        context.alias("additionalContext"),
        *optional,
    )


def inference_result(scored: DataFrame, reported: Column) -> DataFrame:
    """One result record per reading, as the edge stores it."""
    prediction = F.col("prediction") if "prediction" in scored.columns else no_prediction()
    return scored.select(
        "well_id",
        F.regexp_replace(rules.iso_z(F.col("ts")), "Z$", "").alias("timestamp"),
        "status",
        param_map({p: F.col(f"{p}_dev") for p in PARAMETERS}).alias("deviations"),
        violations().alias("violations"),
        prediction.alias("prediction"),
        reported.alias("reported_to_api"),
    )
