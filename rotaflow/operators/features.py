"""Time-series features, labels, filling and splitting."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rotaflow import fixed_values as V
from rotaflow.fixed_values import PARAMETERS
from rotaflow.functions import rules
from rotaflow.operators import feature_batches
from rotaflow.operators.status import DEVIATIONS, latest_reading
from rotaflow.plans.timeline import Timeline, micros
from rotaflow.schemas import feature_names

_STAT_FIELDS = ("n", "mean", "m2", "max", "min")
LONGEST_DIRECT = 64  # rows of a frame that is read again for every reading
MOST_PARTS = 16  # short frames that one long frame is put together from
SMALLEST = 6  # rows of the frame at most that the shortest window is put together from


def engineer_features(
    deviations: DataFrame,
    timeline: Timeline,
    windows: Sequence[int] = V.FEATURE_WINDOWS,
    in_batches: bool = False,
    keep: Sequence[str] = (),
    series: Sequence[str] = (),
) -> DataFrame:
    """All features in training order next to ``well_id, ts, reading_id``.

    Every window function shares one specification, so readings are exchanged
    and sorted once. A long window that is a multiple of the short one is put
    together from the short one's moments at equal distances (7 look-ups
    instead of 168 re-reads per reading for the default windows), and the short one in the same way from a frame of
    a few rows. Other long windows are put together from blocks, see ``_block_moments``. Readings without a machine have no features.

    ``in_batches`` makes the same from Arrow batches of the sorted readings, at a fraction of the time, for results whose partitioning
    does not matter. Further columns ``keep`` stay then; ``_number`` and ``_rows``, the reading's number and the machine's readings, may be among them. A machine may have several ``series``.
    """
    if in_batches:
        return _features_in_batches(deviations, timeline, windows, keep, series)
    base = deviations.where(F.col("well_id").isNotNull()).select("well_id", "ts", "reading_id", *DEVIATIONS)
    timeline = timeline.looking_back(max(windows) + 1)
    attached = timeline.with_carry(timeline.attach(base), sums=DEVIATIONS)
    w = timeline.window()

    first = {"_start": timeline.machine_start()}
    first |= {f"_total_{p}": timeline.running_sum(f"{p}_deviation_pct") for p in PARAMETERS}
    first |= slopes(w, windows)
    short = min(windows)
    composed = [n for n in windows if n > short and n % short == 0 and n // short <= MOST_PARTS]
    blocked = [n for n in windows if n not in composed and n > LONGEST_DIRECT]
    direct = [n for n in windows if n not in composed and n not in blocked]
    small = max(k for k in range(1, SMALLEST + 1) if short % k == 0)
    split = short in direct and 1 < small < short <= small * MOST_PARTS
    for n in direct:
        first |= {"_small": _moments(w.rowsBetween(1 - small, 0))} if split and n == short else {f"_stats_{n}": _moments(w.rowsBetween(1 - n, 0))}
    if blocked:
        first["_number"] = timeline.row_number()
    staged = attached.withColumns(first)
    if split:
        steps = range(1, short // small)
        staged = staged.withColumns({f"_small_{k}": F.lag("_small", small * k).over(w) for k in steps})
        staged = _united(staged, short, ["_small", *[f"_small_{k}" for k in steps]])

    second = {
        f"{p}_acceleration_{n}h": F.coalesce(
            F.col(f"{p}_slope_{n}h") - F.lag(f"{p}_slope_{n}h").over(w), F.lit(0.0)
        )
        for p in PARAMETERS
        for n in windows
    }
    for n in composed:
        for step in range(1, n // short):
            second[f"_back_{n}_{step}"] = F.lag(f"_stats_{short}", step * short).over(w)
    staged = staged.withColumns(second)

    for n in composed:
        staged = _united(staged, n, [f"_stats_{short}", *[f"_back_{n}_{step}" for step in range(1, n // short)]])
    for n in blocked:
        staged = _united(_block_moments(staged, timeline, n), n, [f"_stats_{n}", f"_back_{n}"])

    third = {}
    for p in PARAMETERS:
        dev = F.col(f"{p}_deviation_pct")
        for n in windows:
            third |= _named_stats(p, n)
        third[f"{p}_cumulative_deviation"] = F.when(dev.isNotNull(), F.col(f"_total_{p}"))
        third[f"{p}_abs_deviation"] = F.abs(dev)
    third |= time_features("_start") | interactions()
    return timeline.core(staged.withColumns(third)).select(
        "well_id", "ts", "reading_id", *feature_names(windows)
    )


def _for_batches(deviations: DataFrame, timeline: Timeline, keep: Sequence[str], series: Sequence[str]) -> DataFrame:
    """Sorted readings with all features of a single reading; what frames give is made of them by ``feature_batches``."""
    base = deviations.where(F.col("well_id").isNotNull()).select("well_id", "ts", "reading_id", *DEVIATIONS, *series, *keep)
    attached = timeline.with_carry(timeline.attach(base), sums=DEVIATIONS)
    keys = [*timeline.keys(), *series]
    # the windows exchange and sort the rows, unless a join before has dealt them by machine already; no operator between them and the batches
    # may deal rows anew
    whole = W.partitionBy(*keys).orderBy(*timeline.order)
    places = {"_start": timeline.machine_start(whole), "_number": timeline.row_number(whole), "_rows": timeline.machine_rows(whole)}
    single = {f"{p}_abs_deviation": F.abs(f"{p}_deviation_pct") for p in PARAMETERS}
    return attached.withColumns(places).withColumns(single | time_features("_start") | interactions())


def _features_in_batches(
    deviations: DataFrame, timeline: Timeline, windows: Sequence[int], keep: Sequence[str], series: Sequence[str]
) -> DataFrame:
    timeline = timeline.looking_back(max(windows) + 1)
    numbers = [c for c in keep if c in ("_number", "_rows")]
    dealt = _for_batches(deviations, timeline, [c for c in keep if c not in numbers], series)
    schema = StructType([*dealt.schema.fields, *[StructField(n, DoubleType()) for n in feature_batches.names(windows)]])
    run = feature_batches.over_batches([*timeline.keys(), *series], windows, timeline.sliced)
    return dealt.mapInArrow(run, schema).select("well_id", "ts", "reading_id", *feature_names(windows), *series, *keep)


def _block_moments(rows: DataFrame, timeline: Timeline, n: int) -> DataFrame:
    """Adds ``_stats_n`` and ``_back_n``: the moments of two adjoining parts of each reading's last ``n`` readings.

    A machine's readings are cut into blocks of ``n`` by their number. A frame of ``n`` is the head of its reading's block and a tail of the block
    before; heads and tails of all readings are running aggregates, so the cost of a reading does not grow with ``n``.
    """
    block = F.floor((F.col("_number") - 1) / n)
    rows = rows.withColumn("_block", block)
    by_block = W.partitionBy(*timeline.keys(), "_block")
    heads = by_block.orderBy(*timeline.order).rowsBetween(W.unboundedPreceding, 0)
    tails = by_block.orderBy(*[F.col(c).desc() for c in timeline.order]).rowsBetween(W.unboundedPreceding, 0)
    # tails before heads, so that heads leave the rows in time order: blocks follow time, and the look-back needs no further sort
    rows = rows.withColumn("_tail", _moments(tails)).withColumn(f"_stats_{n}", _moments(heads))
    whole_block = F.col("_number") % n == 0
    in_time = W.partitionBy(*timeline.keys()).orderBy("_block", *timeline.order)
    back = F.when(~whole_block, F.lag("_tail", n - 1).over(in_time))
    return rows.withColumn(f"_back_{n}", back).drop("_tail", "_block")


def rolling_time(
    deviations: DataFrame, timeline: Timeline, hours: float = 24.0, columns: Sequence[str] = DEVIATIONS
) -> DataFrame:
    """Count, mean, sample deviation, max and min over the readings of the last ``hours``, the reading's own instant included.

    The frame is measured in time, so it holds any number of readings; slices of hot machines reach back as far in time.
    Names: ``{column}_{statistic}``, next to ``well_id, ts, reading_id, readings``.
    """
    span = int(hours * 3_600_000_000)
    timeline = timeline.looking_back(micros=span)
    kept = deviations.where(F.col("well_id").isNotNull() & F.col("ts").isNotNull())
    attached = timeline.attach(kept.select("well_id", "ts", "reading_id", *columns)).withColumn("_tick", micros("ts"))
    frame = W.partitionBy(*timeline.keys()).orderBy("_tick").rangeBetween(-span, 0)
    made = {"readings": F.count("*").over(frame)}
    for c in columns:
        made |= {
            f"{c}_mean": F.avg(c).over(frame),
            f"{c}_std": F.coalesce(F.stddev_samp(c).over(frame), F.lit(0.0)),
            f"{c}_max": F.max(c).over(frame),
            f"{c}_min": F.min(c).over(frame),
        }
    return timeline.core(attached.withColumns(made)).drop("_tick", *columns)


def _moments(frame) -> Column:
    """Count, mean, squared deviation, max and min of each parameter over a frame."""
    fields = []
    for p in PARAMETERS:
        x = F.col(f"{p}_deviation_pct")
        n = F.count(x).over(frame)
        fields += [
            n.alias(f"{p}_n"),
            F.avg(x).over(frame).alias(f"{p}_mean"),
            (F.var_pop(x).over(frame) * n).alias(f"{p}_m2"),
            F.max(x).over(frame).alias(f"{p}_max"),
            F.min(x).over(frame).alias(f"{p}_min"),
        ]
    return F.struct(*fields)


def _united(rows: DataFrame, n: int, parts: Sequence[str]) -> DataFrame:
    """Sets ``_stats_n`` to the moments of the union of adjoining frames, in place of their columns ``parts``.

    Counts and means are columns of their own first: the squares need them several times.
    """
    total = lambda cols: sum(cols[1:], cols[0])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    means, squares, fields = {}, {}, []
    for p in PARAMETERS:
        get = {f: [F.col(part)[f"{p}_{f}"] for part in parts] for f in _STAT_FIELDS}
        count, mean = f"_united_{p}_n", f"_united_{p}_mean"
        means[count] = total([zero(c) for c in get["n"]])
        means[mean] = F.try_divide(total([zero(c * m) for c, m in zip(get["n"], get["mean"])]), means[count])
        spread = [zero(c * (m - F.col(mean)) * (m - F.col(mean))) for c, m in zip(get["n"], get["mean"])]
        squares[f"_united_{p}_m2"] = total([zero(c) for c in get["m2"]]) + total(spread)
        fields += [F.col(f"_united_{p}_{f}").alias(f"{p}_{f}") for f in ("n", "mean", "m2")]
        fields += [F.greatest(*get["max"]).alias(f"{p}_max"), F.least(*get["min"]).alias(f"{p}_min")]
    made = rows.withColumns(means).withColumns(squares).withColumn(f"_stats_{n}", F.struct(*fields))
    # the shortest window's moments are a part of others
    return made.drop(*means, *squares, *[part for part in parts if not part.startswith("_stats_")])


def _named_stats(p: str, n: int) -> dict[str, Column]:
    """Mean, sample deviation, max and min of a window from its moments."""
    count, mean, m2, largest, smallest = (F.col(f"_stats_{n}")[f"{p}_{f}"] for f in _STAT_FIELDS)
    deviation = F.when(count > 1, F.sqrt(m2 / (count - 1))).otherwise(0.0)
    return {
        f"{p}_rolling_mean_{n}h": mean,
        f"{p}_rolling_std_{n}h": deviation,
        f"{p}_rolling_max_{n}h": largest,
        f"{p}_rolling_min_{n}h": smallest,
    }


def slopes(w, windows: Sequence[int]) -> dict[str, Column]:
    return {
        f"{p}_slope_{n}h": F.coalesce(
            (F.col(f"{p}_deviation_pct") - F.lag(f"{p}_deviation_pct", n).over(w)) / n, F.lit(0.0)
        )
        for p in PARAMETERS
        for n in windows
    }


def time_features(start: str) -> dict[str, Column]:
    return {
        "hours_since_start": rules.days_between(F.col("ts"), F.col(start)) * 24,
        "day_of_week": F.weekday("ts").cast("double"),
        "hour_of_day": F.hour("ts").cast("double"),
    }


def interactions() -> dict[str, Column]:
    d = {p: F.col(f"{p}_deviation_pct") for p in PARAMETERS}
    return {
        "flow_head_product": d["flow"] * d["head"],
        "power_efficiency_product": d["power"] * d["efficiency"],
    }


def numeric_features(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """Numeric columns that are not excluded, in order."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [
        name
        for name, kind in df.dtypes
        if name not in exclude and (kind in numeric or kind.startswith("decimal"))
    ]


def fill_forward(df: DataFrame, columns: Sequence[str], timeline: Timeline) -> DataFrame:
    """Missing values become the machine's last known value, or 0 before any; rows without a machine go."""
    df = df.where(F.col("well_id").isNotNull())
    attached = timeline.with_carry(timeline.attach(df), lasts=columns)
    filled = attached.withColumns(
        {f"_filled_{c}": F.coalesce(timeline.last_value(c), F.lit(0.0)) for c in columns}
    )
    kept = timeline.core(filled)
    renamed = {f"_filled_{c}": c for c in columns}
    return kept.drop(*columns).withColumnsRenamed(renamed).select(*df.columns)


def rul_labels(df: DataFrame, failures: DataFrame) -> DataFrame:
    """Adds ``rul_days``: fractional days until the machine's failure, never negative."""
    joined = df.join(failures.select("well_id", "failure_ts"), "well_id")
    left = rules.days_between(F.col("failure_ts"), F.col("ts"))
    return joined.withColumn("rul_days", F.greatest(F.lit(0.0), left)).drop("failure_ts")


def fail_soon_labels(df: DataFrame, failures: DataFrame, days: int = V.SOON_DAYS) -> DataFrame:
    """Adds ``fails_soon``: 1 if the failure is at most ``days`` away, or past."""
    joined = df.join(failures.select("well_id", "failure_ts"), "well_id")
    left = rules.days_between(F.col("failure_ts"), F.col("ts"))
    return joined.withColumn("fails_soon", (left <= days).cast("int")).drop("failure_ts")


def label_stats(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("well_id").agg(
        F.min("rul_days").alias("rul_min"),
        F.max("rul_days").alias("rul_max"),
        F.sum("fails_soon").alias("positives"),
        (F.avg("fails_soon") * 100).alias("positive_pct"),
    )


def chronological_split(df: DataFrame, timeline: Timeline, test_share: float = 0.2) -> DataFrame:
    """Adds ``is_test``: true for the last ``ceil(share * n)`` readings of a machine; rows without a machine go."""
    attached = timeline.attach(df.where(F.col("well_id").isNotNull()))
    rows = timeline.machine_rows()
    marked = attached.withColumn(
        "is_test", timeline.row_number() > rows - F.ceil(rows * test_share)
    )
    return timeline.core(marked)


def _with_failures(deviations: DataFrame, failures: DataFrame) -> DataFrame:
    """Readings once for each failure time of their machine, with ``rul_days``; ``_copy`` and ``_copies`` tell which of how many."""
    known = failures.where(F.col("well_id").isNotNull()).groupBy("well_id").agg(F.collect_list(F.struct("failure_ts")).alias("_failures"))
    each = known.select("well_id", F.size("_failures").alias("_copies"), F.posexplode("_failures").alias("_copy", "_failure"))
    left = rules.days_between(F.col("_failure.failure_ts"), F.col("ts"))
    return deviations.join(each, "well_id").withColumn("rul_days", F.greatest(F.lit(0.0), left)).drop("_failure")


def _is_test(test_share: float) -> Column:
    rows = F.col("_rows") * F.col("_copies")
    return (F.col("_number") - 1) * F.col("_copies") + F.col("_copy") + 1 > rows - F.ceil(rows * test_share)


def training_table(deviations: DataFrame, timeline: Timeline, failures: DataFrame, test_share: float = 0.2) -> DataFrame:
    """Features, ``rul_days`` and ``is_test``: the rows of ``chronological_split`` over ``rul_labels`` over ``engineer_features``.

    Failure times are attached to the readings before they get wide, so no wide row is exchanged. A machine with several failure
    times has a series of readings for each of them, and the last share is that of all these rows.
    """
    keep = ("rul_days", "_copies", "_number", "_rows")
    made = engineer_features(_with_failures(deviations, failures), timeline, V.FEATURE_WINDOWS, True, keep, ("_copy",))
    return made.withColumn("is_test", _is_test(test_share)).drop("_copy", "_copies", "_number", "_rows")


@dataclass(frozen=True)
class TrainingBatches:
    """The rows of ``training_table`` as Arrow batches: steps that leave little of each row see them without a wide table."""

    rows: DataFrame
    make: Callable
    keys: tuple[str, ...]

    def through(self, step: Callable, schema: str) -> DataFrame:
        make = self.make
        return self.rows.drop("ts", "reading_id").mapInArrow(lambda batches: step(make(batches)), schema)

    def newest(self) -> DataFrame:
        """The newest row of each machine: ``well_id, ts, reading_id`` and the features. Tasks hand on the last rows they see of a machine."""
        make, kept, last = self.make, ["well_id", "ts", "reading_id", *feature_names()], feature_batches.last_of_each(self.keys)
        there = {f.name: f for f in self.rows.schema.fields}
        schema = StructType([there.get(c, StructField(c, DoubleType())) for c in kept])
        return latest_reading(self.rows.mapInArrow(lambda batches: (b.select(kept) for b in last(make(batches))), schema))


def training_batches(deviations: DataFrame, timeline: Timeline, failures: DataFrame, test_share: float = 0.2) -> TrainingBatches:
    timeline = timeline.looking_back(max(V.FEATURE_WINDOWS) + 1)
    rows = _for_batches(_with_failures(deviations, failures), timeline, ("rul_days", "_copies"), ("_copy",))
    rows = rows.withColumn("is_test", _is_test(test_share)).drop("_start", "_number", "_rows", "_copies")
    keys = (*timeline.keys(), "_copy")
    return TrainingBatches(rows, feature_batches.over_batches(keys, V.FEATURE_WINDOWS, timeline.sliced), keys)


def fit_scaler(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each column per machine."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    return train.groupBy("well_id").agg(*aggs)


def scale_features(df: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Z-scores; a constant column becomes 0."""
    joined = df.join(scaler, "well_id")
    scaled = joined.withColumns(
        {
            c: F.when(F.col(f"{c}__std") > 0, (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__std"))
            .otherwise(0.0)
            for c in columns
        }
    )
    return scaled.select(*df.columns)


def latest_24_stats(telemetry: DataFrame, timeline: Timeline, rows: int = 24) -> DataFrame:
    """Mean, sample deviation, max and min of each machine's newest raw readings."""
    newest = timeline.last_rows(telemetry.where(F.col("well_id").isNotNull()), rows)
    aggs = []
    for p in PARAMETERS:
        aggs += [
            F.avg(p).alias(f"{p}_mean"),
            F.stddev_samp(p).alias(f"{p}_std"),
            F.max(p).alias(f"{p}_max"),
            F.min(p).alias(f"{p}_min"),
        ]
    return newest.groupBy("well_id").agg(F.count("*").alias("readings"), *aggs)


def ml_gate(telemetry: DataFrame, minimum: int = V.MIN_READINGS_FOR_ML) -> DataFrame:
    """Machines and whether they have enough readings for a prediction."""
    return telemetry.groupBy("well_id").agg(
        F.count("*").alias("readings"), (F.count("*") >= minimum).alias("ready")
    )
