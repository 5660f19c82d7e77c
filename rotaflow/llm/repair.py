"""Conversation structure repair: the cheapest edits that give a conversation the role initials ``(s?(ua)+)?``.

Rows are kept (0), reroled to user or assistant (2), deleted (3; blank and repeated rows must be), and empty user or assistant rows are
inserted (2); a truncated row that stays costs 1 more. Of equally cheap edits the ASCII-least string of their initials (D, I, K, R) is chosen.

The dynamic program runs backwards over four states (start, after s, after u, after a). Square-root checkpointing: the vector of costs to
the end is stored before every block of about the square root of the rows only; walking forward, a block's vectors are
computed again from the checkpoint behind it, and in each state the ASCII-least tight edit is emitted. Vectors differ from their minimum by a few
units only, so there are few of them, and steps are looked up.

No conversation is held in one task: rows are sorted and cut by Spark's range partitioning, a conversation's rows in one partition are
a *piece*, and only the fault codes of a piece (a byte each) meet in a task. Pieces of one conversation are chained by small
tables: the costs of a piece from state to state (min-plus), then the state in which each piece begins; a chain has as many rows as there are
range partitions at most. The last step, the SHA-256 of a repaired conversation, is sequential by nature and streams the sorted
rows with constant memory, but for the audit that is returned.

Defined results: null turns come first; rows of one turn are ordered by role and text; equal rows (same turn, role and text) are one row with
a count up to the end; a null ``conv_id`` is a conversation of its own; an empty role has no initial, so such rows are reroled or deleted;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotaflow.llm.common import release, stored

# Initials in the order of their codes, edit costs, and the characters that end a turn and that are blank.
INITIALS = "sua"
REROLE, DELETE, INSERT, TRUNCATED_STAYS = 2, 3, 2, 1
STOPS, BLANKS = ".!?", "\x20\x09\x0a\x0b\x0c\x0d"

OTHER = 3  # code of any other initial; codes of kept rows are initial + 4 * truncated, forced deletions are FORCED
FORCED = 8
# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. NEXT[state][initial] is the state after a row of that initial.
NEXT = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
WANTED = (1, 1, 2, 1)  # the initial that a reroled or inserted row takes in each state
NO_WAY = 1 << 40
LAST = (0, 2 * INSERT, INSERT, 0)  # costs behind the last row: what is open is closed by inserting

Vector = tuple[int, ...]


class Steps:
    """Steps of the dynamic program, remembered: vectors are relative to their minimum, so there are few."""

    def __init__(self):
        self.back: dict[tuple[Vector, int], tuple[Vector, int]] = {}
        self.forward: dict[tuple[Vector, int, int], tuple[str, int, int]] = {}

    @staticmethod
    def _row(vector: Vector, code: int) -> list[int]:
        """Cheapest edit of the row itself in each state, without insertions before it."""
        if code == FORCED:
            return [DELETE + v for v in vector]
        initial, more = code & 3, TRUNCATED_STAYS * (code >> 2)
        out = []
        for state in range(4):
            kept = NEXT[state][initial]
            out.append(min(DELETE + vector[state], REROLE + more + vector[NEXT[state][WANTED[state]]], more + vector[kept] if kept is not None else NO_WAY))
        return out

    @staticmethod
    def _inserted(costs: list[int]) -> list[int]:
        """With insertions: no state is visited twice, so three rounds are enough."""
        for _ in range(3):
            costs = [min(c, INSERT + costs[NEXT[state][WANTED[state]]]) for state, c in enumerate(costs)]
        return [min(c, NO_WAY) for c in costs]

    def before(self, vector: Vector, code: int) -> tuple[Vector, int]:
        """The vector before a row from the one behind it, less its minimum, and that minimum."""
        found = self.back.get((vector, code))
        if found is None:
            costs = self._inserted(self._row(vector, code))
            least = min(costs)
            found = tuple(NO_WAY if c >= NO_WAY else c - least for c in costs), least
            self.back[vector, code] = found
        return found

    def edit(self, vector: Vector, code: int, state: int) -> tuple[str, int, int]:
        """ASCII-least tight edits at a row (insertions before it included), the state behind it and the row's new initial (-1 if it goes)."""
        found = self.forward.get((vector, code, state))
        if found is None:
            row = self._row(vector, code)
            costs, edits, at = self._inserted(row), "", state
            while True:
                initial, more = code & 3, TRUNCATED_STAYS * (code >> 2)
                if costs[at] == DELETE + vector[at]:
                    found = edits + "D", at, -1
                elif costs[at] == INSERT + costs[NEXT[at][WANTED[at]]]:
                    edits, at = edits + "I", NEXT[at][WANTED[at]]
                    continue
                elif code != FORCED and NEXT[at][initial] is not None and costs[at] == more + vector[NEXT[at][initial]]:
                    found = edits + "K", NEXT[at][initial], initial
                else:
                    found = edits + "R", NEXT[at][WANTED[at]], WANTED[at]
                break
            self.forward[vector, code, state] = found
        return found


def relative(vector) -> Vector:
    least = min(vector)
    return tuple(NO_WAY if v >= NO_WAY else int(v - least) for v in vector)


def vector_before(codes: bytes, behind: Vector, steps: Steps) -> tuple[Vector, int]:
    """The vector before the first of ``codes`` and its minimum, given the relative vector behind the last."""
    vector, total = behind, 0
    for code in reversed(codes):
        vector, least = steps.before(vector, code)
        total += least
    return vector, total


def walk(codes: bytes, behind: Vector, state: int, steps: Steps) -> Iterator[tuple[str, int, int]]:
    """``edit`` of each row from ``state`` on; vectors are stored at checkpoints only and computed again block by block."""
    block = max(1, isqrt(len(codes)))
    checkpoints, vector = [behind], behind
    for low in range((len(codes) - 1) // block * block, 0, -block):
        vector, _ = vector_before(codes[low : low + block], vector, steps)
        checkpoints.append(vector)
    for low in range(0, len(codes), block):
        vectors = [checkpoints.pop()]
        part = codes[low : low + block]
        for code in reversed(part[1:]):
            vectors.append(steps.before(vectors[-1], code)[0])
        for code in part:
            found = steps.edit(vectors.pop(), code, state)
            state = found[1]
            yield found


def trailing(state: int) -> str:
    """Insertions behind the last row."""
    return "I" * (LAST[state] // INSERT)


def across(codes: bytes, steps: Steps) -> list[int]:
    """Costs from each state before ``codes`` to each state behind them (row by row): a min-plus matrix."""
    columns = []
    for target in range(4):
        vector, least = vector_before(codes, tuple(0 if s == target else NO_WAY for s in range(4)), steps)
        columns.append([min(NO_WAY, v + least) for v in vector])
    return [columns[target][state] for state in range(4) for target in range(4)]


# ---------------------------------------------------------------- damage (part of the query, not of the operator)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with planted faults, by the CRC-32 of ``conv_id:turn``; nulls in what is hashed, role and text are a blank."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times)).drop("col")


# ---------------------------------------------------------------- the operator


def _faulty(rows: DataFrame) -> DataFrame:
    """Equal rows once, with their number ``copies``, their first fault and their code."""
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    word = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = rows.withColumns({"word": word, "key": F.struct(F.col("turn").isNotNull().alias("given"), F.coalesce("turn", F.lit(0)).alias("turn"))})
    # the smallest turn of each role and text by partial aggregation; only those that occur in several turns are joined back
    firsts = rows.groupBy(F.col("conv_id").alias("of"), F.col("word").alias("same")).agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.where("n > 1").drop("n")
    rows = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("word") == F.col("same")), "left")
    filled = F.rtrim("text", F.lit(BLANKS))
    again = F.coalesce(F.col("first") != F.col("key"), F.lit(False))
    cut = ~F.right(filled, F.lit(1)).isin(*STOPS)
    fault = F.when(filled == "", "blank").when(again, "duplicate").when(cut, "truncated")
    rows = rows.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))
    initial = F.coalesce(*[F.when(F.col("role").startswith(x), F.lit(k)) for k, x in enumerate(INITIALS)], F.lit(OTHER))
    stays = F.col("fault").isNull() | (F.col("fault") == "truncated")
    return rows.withColumn("code", F.when(stays, initial + F.when(F.col("fault") == "truncated", 4).otherwise(0)).otherwise(FORCED).cast("int"))


def _mapped(df: DataFrame, fn, shape: str, schema: pa.Schema) -> DataFrame:
    """mapInArrow: ``fn(row, steps)`` gives the tuple of a row's results."""

    def run(batches):
        steps = Steps()
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                found = [fn(row, steps) for row in batch.slice(low, 512).to_pylist()]
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, f, strict=True)) for f in found], schema)

    return df.mapInArrow(run, shape)


def _chain_costs(row, _):
    """Relative vector behind each of a conversation's pieces."""
    vectors, vector = [], list(LAST)
    for piece in reversed(row["chain"]):
        vectors.append(list(relative(vector)))
        costs = np.array(piece["costs"]).reshape(4, 4) + np.array(vector)
        vector = np.minimum(costs.min(axis=1), NO_WAY).tolist()
    vectors.reverse()
    return [p["piece"] for p in row["chain"]], vectors


def _exits(row, steps):
    out = []
    for state in range(4):
        for _, state, _ in walk(row["codes"], tuple(row["behind"]), state, steps):  # noqa: B020
            pass
        out.append(state)
    return row["piece"], out


def _chain_states(row, _):
    """The state in which each of a conversation's pieces begins."""
    states, state = [], 0
    for piece in row["chain"]:
        states.append(state)
        state = piece["exits"][state]
    return [p["piece"] for p in row["chain"]], states


def _edits(row, steps):
    behind = tuple(row["behind"]) if row["behind"] is not None else LAST
    found = list(walk(row["codes"], behind, row["state"], steps))
    tail = trailing(found[-1][1]) if row["ends"] else ""
    return row["places"], [f[0] for f in found], [f[2] for f in found], [""] * (len(found) - 1) + [tail]


def edits(rows: DataFrame) -> DataFrame:
    """The distinct rows of all conversations with ``copies``, ``fault``, ``place`` (their order) and what is done with them.

    ``rows``: conv_id, turn, role, text. ``edits``: insertions before the row and the row's own edit; further copies are deleted. ``initial``: code of the
    row's initial afterwards, -1 if it goes. ``tail``: insertions behind it.
    """
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = _faulty(rows).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = stored(placed, "turns")
    codes = placed.select("conv_id", "place", "code", F.shiftright("place", 33).alias("part"))
    pieces = codes.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("place", "code"))).alias("rows"))
    binary = F.unhex(F.array_join(F.transform("rows", lambda r: F.lpad(F.hex(r["code"]), 2, "0")), ""))
    pieces = pieces.select("conv_id", F.col("rows")[0]["place"].alias("piece"), binary.alias("codes"), F.transform("rows", lambda r: r["place"]).alias("places"))
    pieces = stored(pieces, "pieces")

    # conversations that lie in several range partitions: at most two of their pieces per partition
    shared = pieces.groupBy("conv_id").agg(F.max("piece").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("of"), "last")
    several = stored(pieces.join(shared, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", "piece", "last", "codes"), "several")
    costs = _mapped(several.select("conv_id", "piece", "codes"), lambda r, s: (r["conv_id"], r["piece"], across(r["codes"], s)), _shape(placed, "piece long, costs array<long>"), _arrow(placed, [("piece", pa.int64()), ("costs", pa.list_(pa.int64()))]))
    chains = costs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("piece", "costs"))).alias("chain"))
    behind = _mapped(chains.select("chain"), _chain_costs, "piece array<long>, behind array<array<long>>", pa.schema([("piece", pa.list_(pa.int64())), ("behind", pa.list_(pa.list_(pa.int64())))]))
    behind = stored(behind.select(F.explode(F.arrays_zip("piece", "behind")).alias("z")).select(F.col("z.piece").alias("at"), "z.behind"), "behind")
    ready = several.join(behind, F.col("piece") == F.col("at")).select("conv_id", "piece", "codes", "behind")
    exits = _mapped(ready.select("piece", "codes", "behind"), _exits, "at long, exits array<int>", pa.schema([("at", pa.int64()), ("exits", pa.list_(pa.int32()))]))
    chains = several.join(exits, F.col("piece") == F.col("at")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("piece", "exits"))).alias("chain"))
    states = _mapped(chains.select("chain"), _chain_states, "piece array<long>, state array<int>", pa.schema([("piece", pa.list_(pa.int64())), ("state", pa.list_(pa.int32()))]))
    states = states.select(F.explode(F.arrays_zip("piece", "state")).alias("z")).select(F.col("z.piece").alias("at"), "z.state")
    ends = several.select(F.col("piece").alias("at"), (F.col("piece") == F.col("last")).alias("ends"))
    links = stored(behind.join(states, "at").join(ends, "at"), "links")

    ready = pieces.join(links, F.col("piece") == F.col("at"), "left").select("codes", "places", "behind", F.coalesce("state", F.lit(0)).alias("state"), F.coalesce("ends", F.lit(True)).alias("ends"))
    fields = [("place", pa.list_(pa.int64())), ("edits", pa.list_(pa.string())), ("initial", pa.list_(pa.int32())), ("tail", pa.list_(pa.string()))]
    found = _mapped(ready, _edits, "place array<long>, edits array<string>, initial array<int>, tail array<string>", pa.schema(fields))
    found = found.select(F.explode(F.arrays_zip("place", "edits", "initial", "tail")).alias("z")).select(F.col("z.place").alias("at"), "z.edits", "z.initial", "z.tail")
    found = stored(found, "edits")
    release(pieces, several, behind, links)
    return placed.join(found, F.col("place") == F.col("at")).drop("at", "code")


def _shape(df: DataFrame, more: str) -> str:
    return f"conv_id {df.schema['conv_id'].dataType.simpleString()}, {more}"


def _arrow(df: DataFrame, more: list) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.schema([("conv_id", to_arrow_type(df.schema["conv_id"].dataType)), *more])


LEGAL = {"su", "ua", "au"}
ROLE = {"u": "user", "a": "assistant"}


class _Report:
    """What is counted while a conversation's rows stream by."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.first, self.last = conv_id, 0, None, None
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.cost = self.state = 0
        self.before, self.audit, self.hash, self.empty = None, [], hashlib.sha256(), True

    def _emit(self, role: str, text: str) -> None:
        self.hash.update((("" if self.empty else "\n") + role + ":" + text).encode())
        self.empty = False

    def _insert(self, n: int) -> None:
        for _ in range(n):
            initial = WANTED[self.state]
            self._emit(ROLE[INITIALS[initial]], "")
            self.state = NEXT[self.state][initial]
        self.cost += INSERT * n

    def add(self, row: dict) -> None:
        turn, fault, copies, edit = row["turn"], row["fault"], row["copies"], row["edits"]
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        if fault:
            self.faults[fault] += copies if fault == "blank" or fault == "duplicate" else 1
        if fault not in ("blank", "duplicate"):
            self.faults["duplicate"] += copies - 1
        initial = row["role"][:1]
        self.illegal += (self.before is not None and self.before + initial not in LEGAL) + (copies - 1)
        self.before = initial
        self._insert(edit.count("I"))
        own = edit[-1]
        if own == "D":
            self.cost += DELETE
        else:
            self.cost += (REROLE if own == "R" else 0) + (TRUNCATED_STAYS if fault == "truncated" else 0)
            self._emit(row["role"] if own == "K" else ROLE[INITIALS[row["initial"]]], row["text"])
            self.state = NEXT[self.state][row["initial"]]
        self.cost += DELETE * (copies - 1)
        self.audit.append(edit + "D" * (copies - 1) + row["tail"])
        self._insert(len(row["tail"]))

    def row(self) -> dict:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return {"conv_id": self.conv_id, "gaps": gaps, **self.faults, "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def _fold(schema: pa.Schema):
    def run(batches):
        report, out = None, []
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                for row in batch.slice(low, 512).to_pylist():
                    if report is None or report.conv_id != row["conv_id"]:
                        if report is not None:
                            out.append(report.row())
                        report = _Report(row["conv_id"])
                    report.add(row)
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if report is not None:
            yield pa.RecordBatch.from_pylist([report.row()], schema)

    return run


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation in ``rows``."""
    found = edits(rows)
    schema = _arrow(found, [*[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    shape = _shape(found, ", ".join([*[f"{c} long" for c in COUNTS], "audit string", "repaired_sha256 string"]))
    streamed = found.select("conv_id", "turn", "role", "text", "copies", "fault", "place", "edits", "initial", "tail")
    return streamed.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_fold(schema), shape)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """``repair`` of the damaged rows, with a row for every original conversation."""
    found = repair(damaged(conversations)).withColumnRenamed("conv_id", "of")
    every = conversations.select("conv_id").distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in COUNTS}
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *[v.alias(c) for c, v in zeros.items()], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
