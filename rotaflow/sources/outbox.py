"""The outbox keyed by reading: each anomaly once, with how its delivery went.

Rows are dealt to buckets by their key. What of a batch is not there yet is added to its buckets as one more piece, rows that are there
stay in their files. How deliveries went is a narrow table of its own, beside the records, and joined when they are read. Both are committed by the exchange of
a manifest. A batch that runs again, under whatever run, finds its keys there and adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotaflow.sources.manifest import PART, Conflict, PartTable

KEY = ("well_id", "ts")
BUCKETS = 64
PIECES = 16  # a bucket with so many is written as one when rows are added to it
# A delivery that succeeded stays so; a failed one may be tried again.
UNSENT, SENT, FAILED = "unsent", "sent", "failed"


class Outbox:
    def __init__(self, spark: SparkSession, path: str, payload: T.StructType, buckets: int = BUCKETS):
        self.schema = T.StructType([*payload.fields, T.StructField("delivery_status", T.StringType())])
        self.table, self.buckets = PartTable(spark, path, self.schema), buckets
        told = T.StructType([*[self.schema[k] for k in KEY], self.schema["delivery_status"]])
        self.deliveries = PartTable(spark, f"{path.rstrip('/')}/deliveries", told)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("string")

    def _touched(self, rows: DataFrame) -> list[str]:
        """At most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())

    def _keyed(self, rows: DataFrame) -> tuple[DataFrame, list[str]]:
        """Rows with bucket and key as columns that are never null: equal keys meet by plain equality, so one exchange serves all steps."""
        zero = {"well_id": "", "ts": "1970-01-01 00:00:00"}
        made = {"_bucket": self._bucket()}
        for k in KEY:
            made |= {f"_no_{k}": F.col(k).isNull(), f"_{k}": F.coalesce(k, F.lit(zero[k]).cast(self.schema[k].dataType))}
        return rows.withColumns(made), list(made)

    @staticmethod
    def _pieces(table: PartTable, touched: list[str], base: int) -> dict[str, list[str]]:
        """The names of the parts of each touched bucket: ``bucket`` or ``bucket.version``."""
        found: dict[str, list[str]] = {b: [] for b in touched}
        for name in table.parts(base):
            if (bucket := name.partition(".")[0]) in found:
                found[bucket].append(name)
        return found

    @staticmethod
    def _retried(step, tries: int = 5) -> None:
        for left in range(tries - 1, -1, -1):
            try:
                return step()
            except Conflict:  # another batch was faster: merge again with what it wrote
                if not left:
                    raise

    def add(self, payloads: DataFrame) -> None:
        """Adds anomalies whose key is not there yet, unsent; of several with one key in a batch the smallest stays."""
        rest = [f.name for f in self.schema.fields if f.name not in (*KEY, "delivery_status")]
        comparable = [F.to_json(c) if isinstance(self.schema[c].dataType, (T.StructType, T.MapType, T.ArrayType)) else F.col(c) for c in rest]
        order = F.struct(*[F.coalesce(c.cast("string"), F.lit("")) for c in comparable])
        touched = self._touched(payloads)
        if not touched:
            return
        same = lambda old: F.col("well_id").eqNullSafe(old["_well_id"]) & F.col("ts").eqNullSafe(old["_ts"])

        def step() -> None:
            base = self.table.version()
            pieces = self._pieces(self.table, touched, base)
            there = sorted(name for names in pieces.values() for name in names)
            new = payloads
            if there:  # before the records are united, so that only those that are new are exchanged and sorted
                known = self.table.read(there, base).select(F.col("well_id").alias("_well_id"), F.col("ts").alias("_ts"))
                new = new.join(known, same(known), "left_anti")
            # sorted by bucket first: the writer needs no second sort of the records
            part = F.concat(self._bucket(), F.lit(f".{base + 1}")).alias(PART)
            new = new.groupBy(part, *KEY).agg(F.min_by(F.struct(*rest), order).alias("one"))
            new = new.select(*KEY, "one.*", F.lit(UNSENT).alias("delivery_status"), PART).select(*self.schema.fieldNames(), PART)
            gone = [name for names in pieces.values() if len(names) >= PIECES for name in names]
            if gone:
                new = new.unionByName(self.table.read(gone, base).withColumn(PART, part))
            made = self.table.write_parts(new, F.col(PART))
            if made:
                self.table.replace(base, made, gone)

        self._retried(step)

    def mark(self, outcomes: DataFrame) -> None:
        """Takes over ``well_id, ts, delivery_status`` of deliveries; what is sent stays sent. The records themselves are not written again."""
        touched = self._touched(outcomes)
        ranked = F.when(F.col("delivery_status") == SENT, 2).when(F.col("delivery_status") == FAILED, 1).otherwise(0)
        rows, keys = self._keyed(outcomes.select(*KEY, "delivery_status"))
        told = rows.groupBy(*keys).agg(*[F.first(k).alias(k) for k in KEY], F.max_by("delivery_status", ranked).alias("_told")).where("_told IS NOT NULL")

        def step() -> None:
            base, held = self.deliveries.version(), self.table.version()
            there = sorted(name for names in self._pieces(self.table, touched, held).values() for name in names)
            if not there:
                return
            known, _ = self._keyed(self.table.read(there, held).select(*KEY))
            before, _ = self._keyed(self.deliveries.read(touched, base))
            before = before.select(*keys, *[F.col(k).alias(f"_was_{k}") for k in KEY], F.col("delivery_status").alias("_was"))
            both = told.join(known.select(*keys), keys, "left_semi").join(before, keys, "full")
            final = (F.col("_was") == SENT) | F.col("_told").isNull()
            status = F.when(final, F.col("_was")).otherwise(F.col("_told")).alias("delivery_status")
            made = self.deliveries.write_parts(both.select(*[F.coalesce(k, f"_was_{k}").alias(k) for k in KEY], status), self._bucket())
            if made:
                self.deliveries.replace(base, made)

        if touched:
            self._retried(step)

    def read(self) -> DataFrame:
        """The records with how their delivery went; only the columns that are asked for take part in the join."""
        rows, keys = self._keyed(self.table.read())
        if not self.deliveries.version():
            return rows.select(*self.schema.fieldNames())
        told, _ = self._keyed(self.deliveries.read())
        joined = rows.join(told.select(*keys, F.col("delivery_status").alias("_told")), keys, "left")
        own = F.col("delivery_status")  # what an earlier layout kept with the records
        status = F.when(own == SENT, own).otherwise(F.coalesce("_told", own))
        return joined.withColumn("delivery_status", status).select(*self.schema.fieldNames())

    def pending(self) -> DataFrame:
        """What is still to be delivered: unsent and failed."""
        return self.read().where(F.col("delivery_status") != SENT)


def with_reported(results: DataFrame, outbox: DataFrame) -> DataFrame:
    """Inference results with ``reported_to_api`` from the outbox; readings that are not in it were not reported."""
    sent = outbox.where(F.col("delivery_status") == SENT).select("well_id", "ts").distinct().withColumn("_sent", F.lit(True))
    joined = results.drop("reported_to_api").join(sent, ["well_id", "ts"], "left")
    return joined.withColumn("reported_to_api", F.coalesce("_sent", F.lit(False))).drop("_sent")


def start_keyed_outbox(payloads: DataFrame, outbox: Outbox, checkpoint: str, available_now: bool = False):
    """A stream into the outbox; a micro-batch that is repeated adds nothing."""
    writer = payloads.writeStream.foreachBatch(lambda batch, _: outbox.add(batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
