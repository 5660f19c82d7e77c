"""Ordered per-machine work that stays balanced when one machine is huge.

Rolling features, row numbers and running sums need a machine's readings in
time order. ``Window.partitionBy("well_id")`` does that with one task per
machine, which is right for ordinary machines and wrong for one that holds a
large share of all rows. A ``Timeline`` keeps the plain window for ordinary
machines and cuts the history of each *hot* machine into time slices:

* a slice holds whole time buckets and at most about ``2 * max_rows`` readings;
* the readings just before a slice (the halo, ``halo`` rows or more) are added
  to it, so frames that look back a bounded number of rows see all they need;
* exact row offsets of the slices turn slice-local row numbers into global ones;
* running totals add the sum of all earlier slices (``carry``).

If no machine is hot nothing is added to the plan: one exchange on ``well_id``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rotaflow.session import cut_lineage

MAX_ROWS = 2_000_000
HALO_ROWS = 169
# slice tables up to this many rows are broadcast; larger ones are joined by shuffle
BROADCAST_ROWS = 500_000

_SECOND = 1_000_000
# bucket widths tried in turn until no bucket is larger than max_rows
WIDTHS = (86_400 * _SECOND, 3_600 * _SECOND, 60 * _SECOND, _SECOND, 1)
_BEFORE_ALL = -(2**62)

_SLICE, _CORE, _OFFSET, _ROWS, _START, _BUCKET = (
    "_slice",
    "_core",
    "_offset",
    "_machine_rows",
    "_machine_start",
    "_bucket",
)


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", start, ts.cast("timestamp_ntz"))


@dataclass(frozen=True)
class Timeline:
    """How the readings of each machine are put in order; see the module text."""

    key: str
    order: tuple[str, ...]
    clock: str
    numeric_clock: bool
    width: int = WIDTHS[0]
    slices: DataFrame | None = None
    small: bool = True
    halo: int = HALO_ROWS
    span: int = 0  # microseconds the halo reaches back at least
    buckets: DataFrame | None = None
    max_rows: int = MAX_ROWS

    # -- planning -------------------------------------------------------------

    @staticmethod
    def of(
        readings: DataFrame,
        key: str = "well_id",
        order: Sequence[str] = ("ts", "reading_id"),
        max_rows: int = MAX_ROWS,
        halo: int = HALO_ROWS,
        numeric_clock: bool = False,
    ) -> Timeline:
        """Count rows per machine (one column-pruned pass) and slice the hot ones.

        ``order[0]`` is the clock: a timestamp, or an integer with ``numeric_clock``.
        """
        clock = order[0]
        tick = _tick(clock, numeric_clock)
        plain = Timeline(key, tuple(order), clock, numeric_clock)
        known = readings.where(F.col(key).isNotNull())  # rows without a machine are in no timeline
        hot = known.groupBy(key).count().where(F.col("count") > max_rows).select(key)
        if hot.isEmpty():
            return plain

        # at most rows / max_rows keys, so the broadcast below is bounded
        hot = cut_lineage(hot)
        ticks = readings.select(key, F.col(clock), tick.alias("_tick")).join(
            F.broadcast(hot), key, "left_semi"
        )
        widths = (
            [max(1, max_rows // 10**k) for k in range(8)] if numeric_clock else WIDTHS
        )
        for width in widths:
            buckets = cut_lineage(
                ticks.groupBy(key, F.floor(F.col("_tick") / width).alias(_BUCKET)).agg(
                    F.count("*").alias("n"), F.min(clock).alias("first_clock")
                )
            )
            if buckets.where(F.col("n") > max_rows).isEmpty():
                break
        return replace(plain, width=width, buckets=buckets, max_rows=max_rows)._sliced(halo, 0)

    def _sliced(self, halo: int, span: int) -> Timeline:
        slices = cut_lineage(_slice_table(self.buckets, self.key, self.max_rows, halo, -(-span // self.width)))
        small = slices.count() <= BROADCAST_ROWS
        return replace(self, slices=slices, small=small, halo=halo, span=span)

    @property
    def sliced(self) -> bool:
        return self.slices is not None

    # -- use ------------------------------------------------------------------

    def looking_back(self, rows: int = 0, micros: int = 0) -> Timeline:
        """This timeline, or one whose slices reach back so many rows and microseconds more.

        Only the slice table is made anew, from the stored counts of buckets; readings are not counted again.
        """
        if not self.sliced or (rows <= self.halo and micros <= self.span):
            return self
        return self._sliced(max(rows, self.halo), max(micros, self.span))

    def attach(self, readings: DataFrame) -> DataFrame:
        """Add slice columns; halo readings appear once more in each slice they precede."""
        if not self.sliced:
            return readings
        slices = self.slices.drop("_before", "_after")
        slices = F.broadcast(slices) if self.small else slices
        bucket = F.floor(_tick(self.clock, self.numeric_clock) / self.width)
        return (
            readings.withColumn(_BUCKET, bucket)
            .join(slices, [self.key, _BUCKET], "left")
            .withColumn(_SLICE, F.coalesce(_SLICE, F.lit(0)))
            .withColumn(_CORE, F.coalesce(_CORE, F.lit(True)))
            .withColumn(_OFFSET, F.coalesce(_OFFSET, F.lit(0)))
        )

    def number(self, readings: DataFrame) -> DataFrame:
        """Attached readings with ``reading_number``.

        Numbering raw readings first puts the exchange right behind the scan: it
        then carries raw columns only, and later steps run on its partitions.
        """
        return self.attach(readings).withColumn("reading_number", self.row_number())

    def core(self, attached: DataFrame) -> DataFrame:
        """Drop the halo readings and the slice columns."""
        if not self.sliced:
            return attached
        kept = attached.where(_CORE)
        return kept.drop(_SLICE, _CORE, _OFFSET, _ROWS, _START, _BUCKET, *_carries(kept))

    def keys(self) -> list[str]:
        return [self.key, _SLICE] if self.sliced else [self.key]

    def window(self) -> WindowSpec:
        return W.partitionBy(*self.keys()).orderBy(*self.order)

    def whole(self, window: WindowSpec | None = None) -> WindowSpec:
        """All readings of the window's partition; ordered like the others to share their sort."""
        return (window or self.window()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)

    def row_number(self, window: WindowSpec | None = None) -> Column:
        """Row number within the whole history of the machine; of a part of its readings with a narrower ``window``."""
        local = F.row_number().over(window or self.window()).cast("long")
        return local + F.col(_OFFSET) if self.sliced else local

    def machine_rows(self, window: WindowSpec | None = None) -> Column:
        """Number of readings of the machine."""
        local = F.count("*").over(self.whole(window))
        return F.coalesce(F.col(_ROWS), local) if self.sliced else local

    def machine_start(self, window: WindowSpec | None = None) -> Column:
        """First clock value of the machine."""
        local = F.min(self.clock).over(self.whole(window))
        return F.coalesce(F.col(_START), local) if self.sliced else local

    def with_carry(self, attached: DataFrame, sums=(), lasts=()) -> DataFrame:
        """Add per-slice totals (``sums``) or last values (``lasts``) of earlier slices.

        The carry table has one row per slice of a hot machine, no more than the slice table.
        """
        if not self.sliced:
            return attached
        ordering = F.struct(*self.order)
        per_slice = (
            attached.where(F.col(_CORE) & F.col(_ROWS).isNotNull())
            .groupBy(self.key, _SLICE)
            .agg(
                F.count("*").alias("_n"),
                *[F.sum(c).alias(f"_carry_{c}") for c in sums],
                *[
                    F.max_by(c, F.when(F.col(c).isNotNull(), ordering)).alias(f"_carry_{c}")
                    for c in lasts
                ],
            )
        )
        before = W.partitionBy(self.key).orderBy(_SLICE).rowsBetween(W.unboundedPreceding, -1)
        carry = per_slice.select(
            self.key,
            _SLICE,
            *[F.sum(f"_carry_{c}").over(before).alias(f"_carry_{c}") for c in sums],
            *[F.last(f"_carry_{c}", True).over(before).alias(f"_carry_{c}") for c in lasts],
        )
        return attached.join(F.broadcast(carry) if self.small else carry, [self.key, _SLICE], "left")

    def running_sum(self, name: str) -> Column:
        """Sum of ``name`` from the machine's first reading on; needs ``with_carry``."""
        frame = self.window().rowsBetween(W.unboundedPreceding, 0)
        if not self.sliced:
            return F.sum(name).over(frame)
        local = F.sum(F.when(F.col(_CORE), F.col(name))).over(frame)
        carry = F.col(f"_carry_{name}")
        return F.when(
            local.isNotNull() | carry.isNotNull(),
            F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0)),
        )

    def last_value(self, name: str) -> Column:
        """Newest non-null ``name`` up to this reading; needs ``with_carry``."""
        frame = self.window().rowsBetween(W.unboundedPreceding, 0)
        local = F.last(name, True).over(frame)
        return F.coalesce(local, F.col(f"_carry_{name}")) if self.sliced else local

    def first_rows(self, readings: DataFrame, n: int) -> DataFrame:
        """The first ``n`` readings of each machine."""
        near = self._near(readings, F.col("_before") < n)
        return self._limited(near, [F.col(c).asc() for c in self.order], n)

    def last_rows(self, readings: DataFrame, n: int) -> DataFrame:
        """The last ``n`` readings of each machine."""
        near = self._near(readings, F.col("_after") < n)
        return self._limited(near, [F.col(c).desc() for c in self.order], n)

    def _near(self, readings: DataFrame, wanted: Column) -> DataFrame:
        # Of a hot machine only the buckets at the wanted end are read on.
        if not self.sliced:
            return readings
        buckets = self.slices.where(_CORE).select(
            self.key, _BUCKET, wanted.alias("_wanted")
        )
        bucket = F.floor(_tick(self.clock, self.numeric_clock) / self.width)
        return (
            readings.withColumn(_BUCKET, bucket)
            .join(F.broadcast(buckets) if self.small else buckets, [self.key, _BUCKET], "left")
            .where(F.coalesce("_wanted", F.lit(True)))
            .drop("_wanted", _BUCKET)
        )

    def _limited(self, readings: DataFrame, order: list[Column], n: int) -> DataFrame:
        # row_number <= n keeps n rows per machine and map task before the shuffle
        window = W.partitionBy(self.key).orderBy(*order)
        ranked = readings.withColumn("_rank", F.row_number().over(window))
        return ranked.where(F.col("_rank") <= n).drop("_rank")


def _tick(clock: str, numeric: bool) -> Column:
    raw = F.col(clock).cast("long") if numeric else micros(clock)
    return F.coalesce(raw, F.lit(_BEFORE_ALL))


def _carries(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("_carry_")]


def _slice_table(buckets: DataFrame, key: str, max_rows: int, halo: int, span: int = 0) -> DataFrame:
    """One row per bucket and slice it belongs to: its own, and those it is halo of.

    A bucket is halo of the slices that start within ``halo`` rows or ``span`` bucket widths behind it.
    """
    by_time = W.partitionBy(key).orderBy(_BUCKET)
    machine = W.partitionBy(key)
    placed = (
        buckets.withColumn(
            "_before",
            F.coalesce(
                F.sum("n").over(by_time.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .withColumn(_ROWS, F.sum("n").over(machine))
        .withColumn(_START, F.min("first_clock").over(machine))
        .withColumn("_after", F.col(_ROWS) - F.col("_before") - F.col("n"))
        .withColumn(_SLICE, F.floor(F.col("_before") / max_rows))
    )
    by_rows = W.partitionBy(key).orderBy("_before")
    previous = F.lag(_SLICE).over(by_rows)
    marked = placed.withColumn(
        "_opens", F.when(previous.isNull() | (previous != F.col(_SLICE)), F.col(_SLICE))
    )
    # slices that start within `halo` rows after a bucket's end; never more than `halo`
    ahead = F.collect_list("_opens").over(by_rows.rangeBetween(0, halo - 1))
    nearby = F.array().cast("array<bigint>")
    if span:
        nearby = F.collect_list("_opens").over(by_time.rangeBetween(1, span + 1))
    belongs = (
        marked.withColumns({"_ahead": ahead, "_nearby": nearby})
        .withColumn("_halo_of", F.array_union(F.coalesce(F.lead("_ahead").over(by_rows), F.array()), "_nearby"))
        .withColumn(
            "_member",
            F.explode(
                F.concat(
                    F.array(F.col(_SLICE)),
                    F.filter(F.col("_halo_of"), lambda s: s != F.col(_SLICE)),
                )
            ),
        )
    )
    start = F.min("_before").over(W.partitionBy(key, "_member"))
    return belongs.select(
        key,
        _BUCKET,
        F.col("_member").alias(_SLICE),
        (F.col("_member") == F.col(_SLICE)).alias(_CORE),
        start.alias(_OFFSET),
        F.col(_ROWS),
        F.col(_START),
        F.col("_before"),
        F.col("_after"),
    )
