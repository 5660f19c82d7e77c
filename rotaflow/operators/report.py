"""Report sections as columns, and their text, one row per machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotaflow import fixed_values as V
from rotaflow.fixed_values import PARAMETERS
from rotaflow.functions import rules
from rotaflow.operators.fleet import early_warning_thresholds
from rotaflow.operators.status import recommendations


def _position():
    return F.array_position(F.array(*[F.lit(p) for p in PARAMETERS]), F.col("param"))


def _lines(rows: DataFrame, text, name: str) -> DataFrame:
    """Lines of one section per machine in parameter order; at most four each."""
    ordered = F.array_sort(F.collect_list(F.struct(_position().alias("i"), text.alias("t"))))
    return rows.groupBy("well_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias(name)
    )


def exceedance_text(details: DataFrame) -> DataFrame:
    """A paragraph per parameter that has left its limits: since when, what is allowed, how far off it was."""
    sides = [F.when(F.col(c).isNotNull(), F.format_string("%+.0f%%", c)) for c in ("min_deviation", "max_deviation")]
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("**"), rules.title_of(F.col("param")), F.lit("**")),
        F.concat(F.lit("- outside its limits from "), F.date_format("first_exceeded", "yyyy-MM-dd HH:mm:ss")),
        F.concat(F.lit("- allowed: "), F.concat_ws(" to ", *sides), F.format_string(" of %.2f", "baseline")),
        F.format_string("- was off by %+.2f%% then\n", "deviation"),
    )
    return _lines(details, text, "exceedances")


def warning_text(fleet: DataFrame, tolerances: DataFrame) -> DataFrame:
    text = F.format_string("- %s: warn from %+.1f%% on", rules.title_of(F.col("param")), "alert_at")
    return _lines(early_warning_thresholds(fleet, tolerances), text, "alerts")


def history_text(classified: DataFrame) -> DataFrame:
    """Period and status table of each machine, from one aggregation."""
    counts = classified.groupBy("well_id").agg(
        F.count("*").alias("n"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        *[F.count_if(F.col("status") == s).alias(s) for s in V.STATUSES],
    )
    rows = [
        F.format_string(f"| {s} | %d | %.1f %% |", s, F.col(s) * 100.0 / F.col("n"))
        for s in V.STATUSES
    ]
    days = F.timestamp_diff("DAY", F.col("start_ts"), F.col("end_ts")).alias("days")
    return counts.select("well_id", F.concat_ws("\n", *rows).alias("distribution"), "start_ts", "end_ts", days)


def report_tables(
    fleet: DataFrame,
    tolerances: DataFrame,
    current: DataFrame,
    details: DataFrame,
    classified: DataFrame,
) -> DataFrame:
    """All parts of the report, one row per machine.

    Every part is aggregated to one row per machine before the joins.
    """
    advice = recommendations(current).select(
        "well_id", F.col("status").alias("current_status"), "monitoring_level",
        "monitor_every", "watch", "actions",
    )
    parts = [
        advice,
        exceedance_text(details),
        history_text(classified),
        warning_text(fleet, tolerances),
    ]
    out = fleet.select("well_id", "pump_type", "horsepower", "application", "category")
    for part in parts:
        out = out.join(part, "well_id", "left")
    return out


def render_reports(
    fleet: DataFrame,
    tolerances: DataFrame,
    current: DataFrame,
    details: DataFrame,
    classified: DataFrame,
    trained: bool = False,
) -> DataFrame:
    """``well_id, report``: the markdown text, concatenated by Spark expressions."""
    known = F.coalesce("current_status", F.lit(V.NO_ANALYSIS))
    bullet = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    period = F.format_string(
        "Readings from %s to %s (%d days):\n",
        F.date_format("start_ts", "yyyy-MM-dd"),
        F.date_format("end_ts", "yyyy-MM-dd"),
        "days",
    )
    sections = [
        F.format_string("# Condition of %s\n", "well_id"),
        F.format_string("%s pump of %.1f hp, used for: %s", "pump_type", "horsepower", "application"),
        F.concat(F.lit("Judged by category "), F.coalesce("category", F.lit("unknown"))),
        F.concat(F.lit("Status now: **"), known, F.lit("**\n")),
        F.lit("## Limits that were left\n"),
        F.coalesce("exceedances", F.lit("None: all parameters stayed within their limits.\n")),
        F.lit("## Status of all readings\n"),
        period,
        F.lit("| Status | Readings | Share |\n|---|---|---|"),
        F.col("distribution"),
    ]
    if trained:
        sections.append(F.lit("\n## Model\n\nA model of the remaining life was trained; its errors are in the metrics table."))
    sections += [
        F.lit("\n## Next steps\n"),
        F.format_string("- look at it %s (%s)", "monitor_every", "monitoring_level"),
        bullet(F.col("watch")),
        bullet(F.col("actions")),
        F.lit("\n## Early warnings of mandatory parameters\n"),
        F.col("alerts"),
    ]
    tables = report_tables(fleet, tolerances, current, details, classified)
    return tables.select("well_id", F.concat_ws("\n", *sections).alias("report"))
