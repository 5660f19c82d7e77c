"""The stored anomaly log: parts by day for retention, and a rank index for deep pages."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaflow.sources.manifest import PartTable


class DatedLog:
    """Anomalies in a part per day."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.table = PartTable(spark, path, schema)

    def append(self, log: DataFrame) -> None:
        """Adds rows; days that have some already are written anew with both."""
        base, day = self.table.version(), F.to_date("ts")
        days = {str(r[0]) for r in log.select(day).distinct().collect()}
        there = self.table.read(sorted(days & set(self.table.parts(base))), base)
        self.table.replace(base, self.table.write_parts(there.unionByName(log.select(*there.columns)), day))

    def retain(self, now: datetime, days: int) -> None:
        """Drops what is older than ``days``: whole days leave the manifest, only the day of the boundary is written anew.

        The files of all other days stay as they are, and readers of the version before are not disturbed.
        """
        base, oldest = self.table.version(), now - timedelta(days=days)
        boundary = str(oldest.date())
        parts = self.table.parts(base)
        gone = [k for k in parts if k != "__HIVE_DEFAULT_PARTITION__" and k < boundary]
        made = []
        if boundary in parts:
            kept = self.table.read([boundary], base).where(F.col("ts") >= F.lit(oldest.isoformat()).cast("timestamp_ntz"))
            made = self.table.write_parts(kept, F.to_date("ts"))
            gone += [] if made else [boundary]
        if made or gone:
            self.table.replace(base, made, gone)

    def read(self) -> DataFrame:
        return self.table.read()


class RankedLog:
    """The log in ranges of its order, newest first, with the rows of each: a page reads the ranges that hold its ranks."""

    def __init__(self, spark: SparkSession, path: str, schema, order: tuple[str, ...] = ("ts", "id")):
        self.table, self.order = PartTable(spark, path, schema), order

    def build(self, log: DataFrame, ranges: int) -> None:
        """Sampled bounds cut the log into about equal ranges; their counts are the index."""
        descending = [F.col(c).desc_nulls_last() for c in self.order]
        cut = log.repartitionByRange(ranges, *descending).withColumn("_range", F.lpad(F.spark_partition_id().cast("string"), 9, "0"))
        base = self.table.version()
        self.table.commit(base, self.table.write_parts(cut, F.col("_range")))

    def total(self) -> int:
        return sum(p.rows for p in self.table.parts().values())

    def page(self, skip: int, take: int) -> DataFrame:
        """Rows ``skip`` to ``skip + take``, newest first, from the few ranges that hold them."""
        version = self.table.version()
        wanted, before, first = [], 0, None
        for part in sorted(self.table.parts(version).values(), key=lambda p: p.key):
            if before < skip + take and before + part.rows > skip:
                wanted.append(part.key)
                first = before if first is None else first
            before += part.rows
        rows = self.table.read(wanted, version)
        descending = [F.col(c).desc_nulls_last() for c in self.order]
        # at most a range before the page and the page itself are sorted
        return rows.orderBy(*descending).offset(skip - (first or 0)).limit(take)
