"""Frames of readings over Arrow batches: what ``features.engineer_features`` makes of Spark windows, for tables that are trained on.

Spark partitions and sorts the readings; a task walks through them batch by batch and keeps the newest readings of the machine it is at, as many as
the longest frame looks back. Moments of a frame are put together from frames of 1, 2, 4, ... readings, so a reading costs the logarithm of the
frame's length, and a value outside a frame never touches it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rotaflow.fixed_values import PARAMETERS


def _shifted(values: np.ndarray, k: int, room: np.ndarray, missing: float) -> np.ndarray:
    """Values ``k`` rows earlier, ``missing`` where the machine has none."""
    out = np.full_like(values, missing)
    if k < len(values):
        out[k:] = values[:-k] if k else values
    out[room < k] = missing
    return out


def _united(a: tuple, b: tuple) -> tuple:
    """Count, mean and squared deviation of two adjoining frames together."""
    (n, mean, m2), (m, other, more) = a, b
    total = n + m
    some = np.maximum(total, 1.0)
    gap = np.where((n > 0) & (m > 0), other - mean, 0.0)
    return total, (n * mean + m * other) / some, m2 + more + gap * gap * (n * m / some)


def frames(x: np.ndarray, room: np.ndarray, windows: Sequence[int]) -> dict[int, tuple]:
    """Per window: count, mean, squared deviation, max and min of each row's last readings.

    ``x`` has a row per reading and NaN for missing values, ``room`` the number of earlier readings of the row's machine.
    """
    known = ~np.isnan(x)
    moments = (known.astype(float), np.where(known, x, 0.0), np.zeros_like(x))
    largest, smallest = np.where(known, x, -np.inf), np.where(known, x, np.inf)
    made: dict[int, list] = {n: [None, 0] for n in windows}
    ends: dict[int, tuple] = {}
    size = 1
    while True:
        for n in windows:
            if n & size:
                held, taken = made[n]
                part = tuple(_shifted(v, taken, room, 0.0) for v in moments)
                made[n] = [part if held is None else _united(held, part), taken + size]
            if size <= n < 2 * size:
                back = n - size
                ends[n] = (np.maximum(largest, _shifted(largest, back, room, -np.inf)), np.minimum(smallest, _shifted(smallest, back, room, np.inf)))
        if 2 * size > max(windows):
            return {n: (*made[n][0], *ends[n]) for n in windows}
        moments = _united(moments, tuple(_shifted(v, size, room, 0.0) for v in moments))
        largest = np.maximum(largest, _shifted(largest, size, room, -np.inf))
        smallest = np.minimum(smallest, _shifted(smallest, size, room, np.inf))
        size *= 2


def names(windows: Sequence[int]) -> list[str]:
    """Columns that ``over_batches`` adds."""
    stats = [f"{p}_rolling_{s}_{n}h" for n in windows for p in PARAMETERS for s in ("mean", "std", "max", "min")]
    changes = [f"{p}_{s}_{n}h" for n in windows for p in PARAMETERS for s in ("slope", "acceleration")]
    return [*stats, *changes, *[f"{p}_cumulative_deviation" for p in PARAMETERS]]


def _nullable(values: np.ndarray, there: np.ndarray | None = None) -> pa.Array:
    return pa.array(values, pa.float64(), mask=None if there is None else ~there)


def over_batches(keys: Sequence[str], windows: Sequence[int], sliced: bool = False):
    """A function for ``mapInArrow`` over rows sorted by ``keys`` and time; adds ``names(windows)`` to their columns.

    With ``sliced`` rows that are there for others to look back at (not ``_core``) go, and sums go on from ``_carry_*``.
    """
    columns = [f"{p}_deviation_pct" for p in PARAMETERS]
    reach = max(windows) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tail = None, np.empty((0, len(columns)))
        total = np.zeros(len(columns))
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            own = [batch.column(k) for k in keys]
            opens = np.zeros(rows, bool)
            for column in own:
                opens[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            key = tuple(c[0].as_py() for c in own)
            if key != last:
                opens[0], tail = True, tail[:0]
            last = tuple(c[-1].as_py() for c in own)

            arrays = [batch.column(c) for c in columns]
            there = np.column_stack([a.is_valid().to_numpy(zero_copy_only=False) for a in arrays])
            new = np.column_stack([a.to_numpy(zero_copy_only=False).astype(float) for a in arrays])
            before = len(tail)
            x = np.concatenate([tail, new])
            first = np.zeros(len(x), int)
            first[before:][opens] = np.flatnonzero(opens) + before
            room = np.arange(len(x)) - np.maximum.accumulate(first)

            made = []
            for n, (count, mean, m2, largest, smallest) in frames(x, room, windows).items():
                some = count > 0
                with np.errstate(invalid="ignore"):
                    deviation = np.where(count > 1, np.sqrt(m2 / np.maximum(count - 1, 1)), 0.0)
                for k in range(len(columns)):
                    here = some[before:, k]
                    made += [_nullable(mean[before:, k], here), _nullable(deviation[before:, k]), _nullable(largest[before:, k], here), _nullable(smallest[before:, k], here)]
            for n in windows:
                slope = (x - _shifted(x, n, room, np.nan)) / n
                slope = np.where(np.isnan(slope), 0.0, slope)
                change = np.where((room > 0)[:, None], slope - _shifted(slope, 1, room, 0.0), 0.0)
                for k in range(len(columns)):
                    made += [_nullable(slope[before:, k]), _nullable(change[before:, k])]

            core = batch.column("_core").to_numpy(zero_copy_only=False) if sliced else np.ones(rows, bool)
            values = np.where(there & core[:, None], new, 0.0)
            totals = np.empty_like(values)
            edges = [0, *np.flatnonzero(opens[1:]) + 1, rows]
            for low, high in zip(edges, edges[1:]):
                if opens[low]:
                    total = np.zeros(len(columns))
                part = values[low:high].copy()
                part[0] += total
                np.add.accumulate(part, axis=0, out=totals[low:high])
                total = totals[high - 1].copy()
            if sliced:
                totals += np.nan_to_num(np.column_stack([batch.column(f"_carry_{c}").to_numpy(zero_copy_only=False).astype(float) for c in columns]))
            made += [_nullable(totals[:, k], there[:, k]) for k in range(len(columns))]
            tail = x[max(before + edges[-2] if opens[edges[-2]] else 0, len(x) - reach) :]
            whole = pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names(windows)])
            yield whole.filter(batch.column("_core")) if sliced else whole

    return run


def last_of_each(keys: Sequence[str]):
    """A function over batches of rows sorted by ``keys``: of each batch the last rows with the same keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ends = np.ones(batch.num_rows, bool)
                ends[:-1] = False
                for column in (batch.column(k) for k in keys):
                    ends[:-1] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(ends))

    return run
