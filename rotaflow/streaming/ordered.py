"""Event-time order in streamed state: rows of a key reach a fold sorted, however they arrived.

Machines are dealt to a fixed number of groups, and a group is a key of the state: a call to the state store, a frame and a timer cost about as much for a
row as for thousands, so what a batch costs follows its rows and not the number of machines.

Arriving rows go into a buffer in the state store, cut into pieces of neighbouring time that are stored whole. A group has one event-time timer, for its earliest
buffered time slot. When the watermark has passed that slot's end, all slots it has passed are taken at once: their pieces are read in the order of their first slots,
and rows are sorted machine by machine and handed to the fold as soon as no unread piece can hold an earlier one. The fold's own state is one small row per machine. So the
result does not depend on how the input was cut into micro-batches, the calls to the state store follow the pieces and not the rows or slots, and memory holds the pieces of
one group that overlap in time, not its whole buffer.

A row older than what its machine has already been folded up to cannot be put in order any more; it is returned at once, marked late, for a side
table. The watermark trails the newest event by the ordering delay and ``late`` and a slot on top: slots are released at the delay, and rows that
are late by more than all of that are dropped by Spark and counted in the query's progress.

Operators can be chained in one query: rows leave with their event time, so a second one behind puts them in order again.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


_NEVER = -(1 << 62)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GROUPS = 256  # keys of the state; fixed, as they must be the same for as long as a checkpoint lives
PIECE = 1024  # rows of a buffered piece at most
HELD = 16 * PIECE  # rows of a group that are gathered before a release goes on to the fold


class Fold(Protocol):
    """What is done with a machine's rows in event-time order."""

    state: T.StructType  # one row per machine
    made: T.StructType  # columns it adds

    def start(self) -> tuple: ...

    def step(self, state: tuple, rows: list[dict[str, Any]]) -> tuple[tuple, list[tuple | None]]:
        """New state, and the added columns of each row; None keeps a row back."""
        ...


@dataclass(frozen=True)
class Delays:
    """How long rows are waited for: put in order up to ``order`` minutes, told to be late up to ``late`` more."""

    order: float = 120
    late: float = 60
    slot: float | None = None  # minutes of a slot; an eighth of the order delay by default

    @property
    def slot_ms(self) -> int:
        return max(1, int((self.slot or self.order / 8) * 60_000))

    @property
    def behind_ms(self) -> int:
        """How far the watermark is behind the release of slots: by a slot at least, since Spark takes no row from an operator that is older."""
        return int(self.late * 60_000) + self.slot_ms


def arriving(telemetry: DataFrame, delays: Delays) -> DataFrame:
    """Adds ``event_time`` with the watermark that ``in_order`` needs, once at the head of a query.

    Watermarks need a timestamp with zone; naive clocks are read in the session zone, which must be UTC.
    """
    marked = telemetry.withColumn("event_time", F.col("ts").cast("timestamp"))
    return marked.withWatermark("event_time", f"{int(delays.order * 60_000) + delays.behind_ms} milliseconds")


def _plain(value):
    """A value as the state keeps it: nested ones as tuples, which are also their order; NaN, pandas' missing number, as None."""
    if isinstance(value, dict):
        return tuple(value.values())
    if isinstance(value, (list, tuple)):
        return tuple(value)
    return None if isinstance(value, float) and value != value else value


def _listed(values: pd.Series) -> list:
    plain = values.dtype.kind in "ib" or values.dtype.kind == "f" and not values.isna().any()
    return values.tolist() if plain else [_plain(v) for v in values.tolist()]


def _shown(value, kind: T.DataType):
    return dict(zip(kind.names, value, strict=True)) if isinstance(kind, T.StructType) and isinstance(value, tuple) else value


def _series(values, kind: T.DataType) -> pd.Series:
    if isinstance(kind, T.DoubleType):
        return pd.Series(np.array(values, dtype=float))  # Spark reads pandas' missing number as NULL
    return pd.Series([_shown(v, kind) for v in values] if isinstance(kind, T.StructType) else values, dtype=object)


@dataclass
class _Buffer:
    """What is known of a group's buffered pieces: number, first and last slot of each, and the timer that is set."""

    pieces: list[tuple[int, int, int]]
    done: dict[Any, int]  # the newest slot of each machine that was folded
    following: int  # number of the next piece
    timer: int | None


class _Ordered(StatefulProcessor):
    """Rows are kept as tuples of their machine (the key itself, if they don't name one) and the ``kept`` columns, of which ``tick`` and ``reading_id`` are the first."""

    def __init__(self, fold: Fold, kept: T.StructType, delays: Delays):
        self.fold, self.kept, self.delays = fold, kept, delays
        self.slot = delays.slot_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getMapState("pieces", "piece long", "rows binary")
        self.folded = handle.getValueState("folded", "states binary")
        self.pending = handle.getValueState("pending", "pieces array<long>, done binary, following long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        buffer = self._pending()
        for batch in rows:
            machines = _listed(batch["well_id"]) if "well_id" in batch else [key[0]] * len(batch)
            values = zip(machines, *[_listed(batch[n]) for n in self.kept.names], strict=True)
            values = [(r[0], int(r[1]), *r[2:]) for r in values if r[1] is not None]
            late = [r for r in values if r[1] // self.slot <= buffer.done.get(r[0], _NEVER)]
            if late:
                yield self._frame([(r, None) for r in late], True)
                values = [r for r in values if r[1] // self.slot > buffer.done.get(r[0], _NEVER)]
            self._store(buffer, values)
        self._settle(buffer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        buffer = self._pending()
        passed = (timerValues.getCurrentWatermarkInMs() + self.delays.behind_ms) // self.delays.slot_ms - 1
        due = sorted((p for p in buffer.pieces if p[1] <= passed), key=lambda p: p[1])
        buffer.pieces = [p for p in buffer.pieces if p[1] > passed]
        if buffer.timer is not None and buffer.timer <= timerValues.getCurrentWatermarkInMs():
            buffer.timer = None  # Spark takes expired timers away
        states = pickle.loads(bytes(self.folded.get()[0])) if self.folded.exists() else {}
        held: list[tuple] = []
        for number, (piece, _, _) in enumerate(due, start=1):
            held += pickle.loads(bytes(self.stored.getValue((piece,))[0]))
            self.stored.removeKey((piece,))
            last = number == len(due)
            if not last and len(held) < HELD:
                continue
            until = (passed + 1 if last else due[number][1]) * self.slot  # no unread piece has an earlier slot
            made = self._folded(buffer, states, [r for r in held if r[1] < until])
            held = [r for r in held if r[1] >= until]
            if made:
                yield self._frame(made, False)
        if due:
            self.folded.update((pickle.dumps(states, 5),))
        self._store(buffer, held)
        self._settle(buffer)

    def _folded(self, buffer: _Buffer, states: dict[Any, tuple], rows: list[tuple]) -> list[tuple[tuple, tuple]]:
        """Rows that are complete up to their newest slot, with what the fold adds; ``states`` and ``buffer.done`` go on."""
        machines: dict[Any, list[tuple]] = {}
        for r in rows:
            machines.setdefault(r[0], []).append(r)
        out: list[tuple[tuple, tuple]] = []
        for machine, own in machines.items():
            own.sort(key=lambda r: r[1:3])
            buffer.done[machine] = max(buffer.done.get(machine, _NEVER), own[-1][1] // self.slot)
            records = [dict(zip(self.kept.names, r[1:], strict=True)) for r in own]
            states[machine], made = self.fold.step(states.get(machine) or self.fold.start(), records)
            out += [x for x in zip(own, made, strict=True) if x[1] is not None]
        return out

    def _store(self, buffer: _Buffer, rows: list[tuple]) -> None:
        rows = sorted(rows, key=lambda r: r[1])
        for low in range(0, len(rows), PIECE):
            part = rows[low : low + PIECE]
            self.stored.updateValue((buffer.following,), (pickle.dumps(part, 5),))
            buffer.pieces.append((buffer.following, part[0][1] // self.slot, part[-1][1] // self.slot))
            buffer.following += 1

    def _settle(self, buffer: _Buffer) -> None:
        """Sets the timer of the earliest buffered slot and stores what is known of the buffer."""
        wanted = None
        if buffer.pieces:
            wanted = max(1, (min(p[1] for p in buffer.pieces) + 1) * self.delays.slot_ms - self.delays.behind_ms)
        if wanted != buffer.timer:
            if buffer.timer is not None:
                self.handle.deleteTimer(buffer.timer)
            if wanted is not None:
                self.handle.registerTimer(wanted)
        self.pending.update(([n for p in buffer.pieces for n in p], pickle.dumps(buffer.done, 5), buffer.following, wanted))

    def _pending(self) -> _Buffer:
        if not self.pending.exists():
            return _Buffer([], {}, 0, None)
        pieces, done, following, timer = self.pending.get()
        numbers = [int(n) for n in (pieces if pieces is not None else [])]
        return _Buffer(list(zip(*[iter(numbers)] * 3, strict=True)), pickle.loads(bytes(done)), int(following), None if timer is None else int(timer))

    def _frame(self, rows: list[tuple[tuple, tuple | None]], late: bool) -> pd.DataFrame:
        """Rows with what the fold adds to them, if they are not late."""
        machines, ticks, *columns = zip(*[r for r, _ in rows], strict=True)
        out = {"well_id": pd.Series(machines, dtype=object), "event_time": pd.to_datetime(ticks, unit="us"), "tick": ticks}
        for field, values in zip(self.kept.fields[1:], columns, strict=True):
            out[field.name] = _series(values, field.dataType)
        out["late"] = [late] * len(rows)
        added = [[None] * len(rows)] * len(self.fold.made.fields) if late else zip(*[m for _, m in rows], strict=True)
        for field, values in zip(self.fold.made.fields, added, strict=True):
            out[field.name] = _series(values, field.dataType)
        return pd.DataFrame(out)

    def close(self) -> None:
        pass


def in_order(arrived: DataFrame, fold: Fold, columns: list[str], delays: Delays) -> DataFrame:
    """``well_id, event_time, tick, reading_id``, the named columns, ``late``, and what the fold adds.

    ``arrived`` has an ``event_time`` with a watermark (see ``arriving``), ``well_id`` and ``reading_id``, which breaks ties.
    Late rows have no added columns. Needs ``state_store`` around the start of the query.
    """
    tick = F.unix_micros("event_time").alias("tick")
    group = F.pmod(F.xxhash64("well_id"), F.lit(GROUPS)).alias("_group")
    slim = arrived.select(group, "well_id", "event_time", tick, "reading_id", *columns)
    kept = T.StructType([f for f in slim.schema.fields if f.name not in ("_group", "well_id", "event_time")])
    shape = T.StructType(
        [slim.schema["well_id"], slim.schema["event_time"], *kept.fields, T.StructField("late", T.BooleanType()), *fold.made.fields]
    )
    return slim.groupBy("_group").transformWithStateInPandas(
        _Ordered(fold, kept, delays), shape, "Append", "EventTime", eventTimeColumnName="event_time"
    )


@contextmanager
def state_store(spark: SparkSession, partitions: int | None = None):
    """The state store that timers and lists need, and into how many partitions state is dealt (for as long as a query's checkpoint lives).

    Queries started inside keep both, the session does not.
    """
    wanted = {_PROVIDER: _ROCKS} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
