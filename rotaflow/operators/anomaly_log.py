"""Queries over the log of reported anomalies."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotaflow import fixed_values as V

FILTERS = ("siteId", "pumpId", "sensorId", "cameraId")


def date_bounds(
    start: str | None = None,
    end: str | None = None,
    days_back: int | None = None,
    now: datetime | None = None,
) -> tuple[str | None, str | None]:
    """ISO bounds; ``days_back`` overrides both, plain dates mean midnight."""
    if days_back:
        until = now or datetime.now(timezone.utc).replace(tzinfo=None)
        return (until - timedelta(days=days_back)).isoformat(), until.isoformat()

    def whole(value: str | None) -> str | None:
        if value is None:
            return None
        if value.endswith("Z"):
            return value[:-1]
        return datetime.strptime(value, "%Y-%m-%d").isoformat()

    return whole(start), whole(end)


def log_filter(
    log: DataFrame,
    site_id: int | None = None,
    pump_id: int | None = None,
    sensor_id: int | None = None,
    camera_id: int | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Plain comparisons on columns, so Parquet scans can skip row groups; bounds inclusive."""
    wanted = dict(zip(FILTERS, (site_id, pump_id, sensor_id, camera_id)))
    for name, value in wanted.items():
        if value is not None:
            log = log.where(F.col(name) == value)
    if start is not None:
        log = log.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        log = log.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return log


def _order(direction: str) -> list[Column]:
    if direction == "asc":
        return [F.col("ts").asc(), F.col("id").asc()]
    return [F.col("ts").desc(), F.col("id").desc()]


def anomaly_page(
    log: DataFrame,
    page: int = 1,
    page_size: int = 25,
    skip: int | None = None,
    take: int | None = None,
    direction: str = "desc",
    after: tuple[str, int] | None = None,
    **filters,
) -> DataFrame:
    """One page, newest first by default; ``skip`` / ``take`` win over page numbers.

    ``after=(ts, id)`` continues behind the last row of the previous page. Its
    cost does not grow with the page number, unlike an offset.
    """
    size = take if take is not None else page_size
    found = log_filter(log, **filters)
    if after is not None:
        ts, last_id = F.lit(after[0]).cast("timestamp_ntz"), after[1]
        key, bound = F.struct("ts", "id"), F.struct(ts.alias("ts"), F.lit(last_id).alias("id"))
        # the bound on the time alone reaches the scan; ties are told apart behind it
        found = found.where(F.col("ts") >= ts if direction == "asc" else F.col("ts") <= ts)
        found = found.where(key > bound if direction == "asc" else key < bound)
        return found.orderBy(*_order(direction)).limit(size)
    offset = skip if skip is not None else (page - 1) * size
    return found.orderBy(*_order(direction)).offset(offset).limit(size)


def page_total(log: DataFrame, skip: int = 0, take: int = 25, **filters) -> DataFrame:
    """Total of the matching anomalies next to the page bounds."""
    return log_filter(log, **filters).agg(
        F.count("*").alias("total"),
        F.lit(skip).cast("long").alias("skip"),
        F.lit(take).cast("long").alias("take"),
    )


def anomaly_query(
    log: DataFrame,
    start: str | None = None,
    end: str | None = None,
    days_back: int | None = None,
    max_results: int | None = None,
    now: datetime | None = None,
    **filters,
) -> DataFrame:
    """Matching anomalies; with ``max_results`` the newest, that many at most."""
    start, end = date_bounds(start, end, days_back, now)
    found = log_filter(log, start=start, end=end, **filters)
    return found if max_results is None else found.orderBy(*_order("desc")).limit(max_results)


def anomaly_summary(log: DataFrame) -> DataFrame:
    """Counts by status, pump, site and sensor and the total, in one pass.

    One row per group: ``dimension`` names the grouping, ``value`` its value.
    """
    dims = ("status", "pumpId", "siteId", "sensorId")
    names = ("by_status", "by_pump", "by_site", "by_sensor")
    entries = F.array(
        F.struct(F.lit("total_anomalies").alias("dimension"), F.lit("all").alias("value")),
        *[
            F.struct(F.lit(n).alias("dimension"), F.col(d).cast("string").alias("value"))
            for n, d in zip(names, dims)
        ],
    )
    # count per combination first: the explode then sees groups, not rows
    combined = log.groupBy(*dims).agg(
        F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")
    )
    return (
        combined.select(F.explode(entries).alias("e"), "n", "lo", "hi")
        .where("e.value is not null")
        .groupBy("e.dimension", "e.value")
        .agg(
            F.sum("n").alias("anomalies"),
            F.min("lo").alias("first_ts"),
            F.max("hi").alias("last_ts"),
        )
    )


def compare_pumps(log: DataFrame) -> DataFrame:
    return log.groupBy("pumpId").agg(
        F.count("*").alias("anomalies"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in V.STATUSES],
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def timeline_pivot(log: DataFrame, statuses=V.STATUSES) -> DataFrame:
    """Anomalies per day and status, zero-filled, with a fixed list of columns."""
    return (
        log.groupBy(F.to_date("ts").alias("date"))
        .pivot("status", list(statuses))
        .agg(F.count(F.lit(1)))
        .na.fill(0)
    )


def retention(records: DataFrame, now: datetime, days: int = V.RETENTION_DAYS) -> DataFrame:
    """Records of the last ``days`` days."""
    oldest = F.lit((now - timedelta(days=days)).isoformat()).cast("timestamp_ntz")
    return records.where(F.col("ts") >= oldest)
