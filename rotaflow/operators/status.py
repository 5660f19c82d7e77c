"""Deviations, limits, status per reading, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rotaflow import fixed_values as V
from rotaflow.fixed_values import PARAMETERS
from rotaflow.functions import rules
from rotaflow.plans.timeline import Timeline

DEVIATIONS = tuple(f"{p}_deviation_pct" for p in PARAMETERS)


def join_baseline(telemetry: DataFrame, fleet: DataFrame) -> DataFrame:
    """Readings with their machine's baseline and limits.

    The machine dimension grows with the fleet: no broadcast is forced, Spark
    broadcasts it only below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    return telemetry.join(fleet, "well_id")


def deviation_pct(
    telemetry: DataFrame, fleet: DataFrame, mapping: dict[str, str] | None = None
) -> DataFrame:
    """Readings with four percentage deviations from the baseline."""
    columns = mapping or {p: p for p in PARAMETERS}
    joined = join_baseline(telemetry, fleet)
    return joined.withColumns(
        {
            f"{p}_deviation_pct": rules.clean(
                rules.deviation(F.col(columns[p]), F.col(f"baseline_{p}"))
            )
            for p in PARAMETERS
        }
    )


def exceedance_flags(deviations: DataFrame) -> DataFrame:
    """Adds, per parameter, which side is exceeded and whether any is."""
    upper, lower = {}, {}
    for p in PARAMETERS:
        dev = F.col(f"{p}_deviation_pct")
        upper[f"{p}_max_exceeded"] = rules.above(dev, F.col(f"{p}_max"))
        lower[f"{p}_min_exceeded"] = rules.below(dev, F.col(f"{p}_min"))
    flagged = deviations.withColumns(upper | lower)
    return flagged.withColumns(
        {
            f"{p}_exceeded": F.col(f"{p}_max_exceeded") | F.col(f"{p}_min_exceeded")
            for p in PARAMETERS
        }
    )


def severities(flagged: DataFrame) -> DataFrame:
    return flagged.withColumns(
        {
            f"{p}_severity": rules.severity(
                F.col(f"{p}_deviation_pct"), F.col(f"{p}_max"), F.col(f"{p}_min")
            )
            for p in PARAMETERS
        }
    )


def violation_counts(rated: DataFrame) -> DataFrame:
    """Adds counts of mandatory, optional, severe and all violations."""
    hit = {p: F.col(f"{p}_exceeded") for p in PARAMETERS}
    mandatory = {p: hit[p] & F.col(f"{p}_mandatory") for p in PARAMETERS}
    return rated.withColumns(
        {
            "mandatory_violations": rules.count_true(list(mandatory.values())),
            "total_violations": rules.count_true(list(hit.values())),
            "severe_violations": rules.count_true(
                [hit[p] & (F.col(f"{p}_severity") >= V.SEVERE_FROM) for p in PARAMETERS]
            ),
            "first_mandatory": rules.first_violated(mandatory),
        }
    )


def sustained_violation(
    counted: DataFrame,
    timeline: Timeline,
    history_window: int = V.HISTORY_WINDOW,
    share: float = V.SUSTAINED_SHARE,
    both_sides: bool = False,
) -> DataFrame:
    """Adds ``sustained`` and ``reading_number``.

    The first violated mandatory parameter must have been above its upper limit
    in ``share`` of the last ``history_window`` readings; looked at from the
    26th reading on. ``both_sides`` also counts readings below the lower limit.
    """

    timeline = timeline.looking_back(history_window + 1)

    def over(p: str):
        flag = rules.above(
            F.col(f"{p}_deviation_pct"), F.coalesce(f"{p}_max", F.lit(V.NO_UPPER_LIMIT))
        )
        return (flag | F.col(f"{p}_min_exceeded") if both_sides else flag).cast("long")

    # counts over the last rows = difference of two running counts; exact for integers
    # and the same cost for any window
    w = timeline.window()
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    numbered = counted if "reading_number" in counted.columns else timeline.number(counted)
    flagged = numbered.withColumns({f"_over_{p}": over(p) for p in PARAMETERS})
    running = flagged.withColumns(
        {f"_over_{p}": F.sum(f"_over_{p}").over(upto) for p in PARAMETERS}
    )
    often = {
        p: F.col(f"_over_{p}")
        - F.coalesce(F.lag(f"_over_{p}", history_window).over(w), F.lit(0))
        for p in PARAMETERS
    }
    chosen = F.coalesce(*[F.when(F.col("first_mandatory") == p, often[p]) for p in PARAMETERS])
    first_row = max(V.FIRST_SUSTAINED_ROW, history_window)
    sustained = F.coalesce(
        (F.col("reading_number") >= first_row) & (chosen >= history_window * share),
        F.lit(False),
    )
    rated = timeline.core(running.withColumn("sustained", sustained))
    return rated.drop(*[f"_over_{p}" for p in PARAMETERS])


def classify_status(
    deviations: DataFrame,
    timeline: Timeline,
    history_window: int = V.HISTORY_WINDOW,
    share: float = V.SUSTAINED_SHARE,
    both_sides: bool = False,
) -> DataFrame:
    """Readings with ``status``; one exchange on the machine for the history rule.

    ``deviations`` may already be numbered by ``timeline``, see ``analyse``.
    """
    counted = violation_counts(severities(exceedance_flags(deviations)))
    rated = sustained_violation(counted, timeline, history_window, share, both_sides)
    return rated.withColumn(
        "status",
        rules.status_from_counts(
            F.col("mandatory_violations"),
            F.col("severe_violations"),
            F.col("total_violations"),
            F.col("sustained"),
        ),
    )


def analyse(telemetry: DataFrame, fleet: DataFrame, timeline: Timeline, **options) -> DataFrame:
    """Deviations and status of all readings, exchanging raw readings only.

    With hot machines the dimension is joined first: if it is too large to be
    broadcast, that join must not undo the slices. Readings without a machine have no
    baseline and go before anything is numbered.
    """
    timeline = timeline.looking_back(options.get("history_window", V.HISTORY_WINDOW) + 1)
    telemetry = telemetry.where(F.col("well_id").isNotNull())
    if timeline.sliced:
        return classify_status(deviation_pct(telemetry, fleet), timeline, **options)
    return classify_status(deviation_pct(timeline.number(telemetry), fleet), timeline, **options)


def processed(classified: DataFrame) -> DataFrame:
    """The analysed table a user keeps: readings, deviations and status."""
    return classified.select(
        "well_id",
        "ts",
        *PARAMETERS,
        "suction",
        "speed",
        *DEVIATIONS,
        "status",
    )


def anomaly_timeline(classified: DataFrame) -> DataFrame:
    return classified.select("well_id", "ts", "status", *DEVIATIONS)


# -- summaries ------------------------------------------------------------------


def status_distribution(classified: DataFrame) -> DataFrame:
    """Zero-filled count and percentage of each status per machine."""
    counts = classified.groupBy("well_id").agg(
        F.count("*").alias("_total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in V.STATUSES],
    )
    entries = F.array(
        *[F.struct(F.lit(s).alias("status"), F.col(s).alias("readings")) for s in V.STATUSES]
    )
    return (
        counts.select("well_id", "_total", F.explode(entries).alias("e"))
        .select("well_id", "e.status", "e.readings", "_total")
        .withColumn("pct", F.round(F.col("readings") * 100.0 / F.col("_total"), 1))
        .drop("_total")
    )


def fleet_status_distribution(classified: DataFrame) -> DataFrame:
    """Zero-filled status counts of the whole fleet by tolerance category."""
    per_machine = classified.groupBy("category").agg(
        F.count("*").alias("readings"),
        F.countDistinct("well_id").alias("machines"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in V.STATUSES],
    )
    return per_machine


def current_status(classified: DataFrame, machines: DataFrame | None = None) -> DataFrame:
    """Newest status per machine; partial aggregation, no window.

    With ``machines`` also those without readings are listed, as unknown.
    """
    newest = classified.groupBy("well_id").agg(
        F.max("ts").alias("ts"),
        F.max_by("status", F.struct("ts", "reading_id")).alias("status"),
    )
    if machines is None:
        return newest
    return (
        machines.select("well_id")
        .join(newest, "well_id", "left")
        .withColumn("status", F.coalesce("status", F.lit(V.NO_ANALYSIS)))
    )


def analysis_period(classified: DataFrame) -> DataFrame:
    return (
        classified.groupBy("well_id")
        .agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
        .withColumn("days", F.timestamp_diff("DAY", F.col("start_ts"), F.col("end_ts")))
    )


def mean_deviation(deviations: DataFrame) -> DataFrame:
    return deviations.groupBy("well_id").agg(
        *[F.avg(d).alias(d.replace("_deviation_pct", "_mean_deviation")) for d in DEVIATIONS]
    )


def latest_reading(telemetry: DataFrame) -> DataFrame:
    """Newest reading per machine by partial aggregation."""
    columns = [c for c in telemetry.columns if c != "well_id"]
    newest = F.max_by(F.struct(*columns), F.struct("ts", "reading_id"))
    return telemetry.groupBy("well_id").agg(newest.alias("r")).select("well_id", "r.*")


def first_exceedance(flagged: DataFrame) -> DataFrame:
    """Earliest exceedance per parameter, NULL where there is none."""
    return flagged.groupBy("well_id").agg(
        *[
            F.min(F.when(F.col(f"{p}_exceeded"), F.col("ts"))).alias(f"{p}_first_exceeded")
            for p in PARAMETERS
        ]
    )


def first_exceedance_detail(flagged: DataFrame) -> DataFrame:
    """Long form with baseline, limits and the deviation at that reading."""
    aggs = []
    for p in PARAMETERS:
        when = F.when(F.col(f"{p}_exceeded"), F.struct("ts", "reading_id"))
        detail = F.struct(
            F.lit(p).alias("param"),
            F.col("ts").alias("first_exceeded"),
            F.col(f"baseline_{p}").alias("baseline"),
            F.col(f"{p}_max").alias("max_deviation"),
            F.col(f"{p}_min").alias("min_deviation"),
            F.col(f"{p}_deviation_pct").alias("deviation"),
        )
        aggs.append(F.min_by(detail, when).alias(p))
    found = flagged.groupBy("well_id").agg(*aggs)
    rows = F.filter(F.array(*PARAMETERS), lambda d: d.isNotNull())
    return found.select("well_id", F.explode(rows).alias("d")).select("well_id", "d.*")


def exceedance_order(details: DataFrame) -> DataFrame:
    """Position of each exceeded parameter in time; at most four rows per machine."""
    position = F.array_position(F.array(*[F.lit(p) for p in PARAMETERS]), F.col("param"))
    order = W.partitionBy("well_id").orderBy("first_exceeded", position)
    return details.select(
        "well_id",
        "param",
        "first_exceeded",
        F.row_number().over(order).cast("long").alias("position"),
    )


def time_to_failure(details: DataFrame, failures: DataFrame) -> DataFrame:
    """Whole days from each first exceedance to the machine's failure (floored)."""
    gap = rules.days_between(F.col("failure_ts"), F.col("first_exceeded"))
    return details.join(failures, "well_id").select(
        "well_id", "param", "first_exceeded", "failure_ts", F.floor(gap).alias("days_to_failure")
    )


def status_episodes(classified: DataFrame, timeline: Timeline) -> DataFrame:
    """Runs of equal status: start, end, number of readings, duration in hours."""
    attached = timeline.attach(classified.select("well_id", "ts", "reading_id", "status"))
    changed = attached.withColumn(
        "_changed",
        F.coalesce(
            (F.lag("status").over(timeline.window()) != F.col("status")).cast("long"), F.lit(1)
        ),
    )
    numbered = timeline.with_carry(changed, sums=["_changed"]).withColumn(
        "episode", timeline.running_sum("_changed")
    )
    return (
        timeline.core(numbered)
        .groupBy("well_id", "episode")
        .agg(
            F.first("status").alias("status"),
            F.min("ts").alias("start_ts"),
            F.max("ts").alias("end_ts"),
            F.count("*").alias("readings"),
        )
        .withColumn("hours", F.round(rules.days_between(F.col("end_ts"), F.col("start_ts")) * 24, 6))
    )


def recommendations(statuses: DataFrame) -> DataFrame:
    """Monitoring interval and actions for each machine's current status."""

    def texts(values):
        return F.array(*[F.lit(v) for v in values])

    advice = []
    for status, (level, interval, watch, actions) in V.ADVICE.items():
        advice += [
            F.lit(status),
            F.struct(
                F.lit(level).alias("monitoring_level"),
                F.lit(interval).alias("monitor_every"),
                texts(watch).alias("watch"),
                texts(actions).alias("actions"),
            ),
        ]
    advised = statuses.withColumn("_advice", F.create_map(*advice)[F.col("status")])
    return advised.select(*statuses.columns, "_advice.*")


# -- chart tables -----------------------------------------------------------------


def parameter_series(telemetry: DataFrame, fleet: DataFrame) -> DataFrame:
    """Long table behind the charts: value, baseline, band, and the part outside it."""
    largest = telemetry.groupBy("well_id").agg(
        *[F.max(p).alias(f"_{p}_largest") for p in PARAMETERS]
    )
    joined = telemetry.join(tolerance_band_inputs(fleet).join(largest, "well_id"), "well_id")
    entries = F.array(
        *[
            F.struct(
                F.lit(p).alias("param"),
                F.col(p).alias("value"),
                F.col(f"baseline_{p}").alias("baseline"),
                rules.band_lower(F.col(f"baseline_{p}"), F.col(f"{p}_min")).alias("lower"),
                rules.band_upper(
                    F.col(f"baseline_{p}"), F.col(f"{p}_max"), F.col(f"_{p}_largest")
                ).alias("upper"),
            )
            for p in PARAMETERS
        ]
    )
    return joined.select("well_id", "ts", "reading_id", F.explode(entries).alias("e")).select(
        "well_id", "ts", "reading_id", "e.*"
    )


def tolerance_band_inputs(fleet: DataFrame) -> DataFrame:
    return fleet.select(
        "well_id",
        *[f"baseline_{p}" for p in PARAMETERS],
        *[f"{p}_{side}" for p in PARAMETERS for side in ("max", "min")],
    )


def tolerance_band(telemetry: DataFrame, fleet: DataFrame) -> DataFrame:
    """Absolute band per machine and parameter."""
    largest = telemetry.groupBy("well_id").agg(
        *[F.max(p).alias(f"_{p}_largest") for p in PARAMETERS]
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(p).alias("param"),
                F.col(f"baseline_{p}").alias("baseline"),
                rules.band_lower(F.col(f"baseline_{p}"), F.col(f"{p}_min")).alias("lower"),
                rules.band_upper(
                    F.col(f"baseline_{p}"), F.col(f"{p}_max"), F.col(f"_{p}_largest")
                ).alias("upper"),
            )
            for p in PARAMETERS
        ]
    )
    joined = tolerance_band_inputs(fleet).join(largest, "well_id")
    return joined.select("well_id", F.explode(entries).alias("e")).select("well_id", "e.*")


def band_excess(series: DataFrame) -> DataFrame:
    """Marks values outside the band; a lower bound counts only if it is positive."""
    over = rules.above(F.col("value"), F.col("upper"))
    under = (F.col("lower") > 0) & rules.below(F.col("value"), F.col("lower"))
    return series.withColumns(
        {
            "above_band": over,
            "below_band": under,
            "clipped_up": F.greatest("value", "upper"),
            "clipped_down": F.least("value", "lower"),
        }
    )


def deviation_trend(deviations: DataFrame, timeline: Timeline, window: int = 24) -> DataFrame:
    """Change per reading over ``window`` readings; NULL until there are enough."""
    timeline = timeline.looking_back(window)
    attached = timeline.attach(deviations.select("well_id", "ts", "reading_id", *DEVIATIONS))
    w = timeline.window()
    trends = attached.withColumns(
        {
            d.replace("_deviation_pct", "_trend"): (F.col(d) - F.lag(d, window).over(w)) / window
            for d in DEVIATIONS
        }
    )
    return timeline.core(trends).drop(*DEVIATIONS)


def status_strip(classified: DataFrame) -> DataFrame:
    return classified.select(
        "well_id", "ts", "status", rules.status_code(F.col("status")).alias("status_code")
    )
