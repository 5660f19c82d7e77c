"""Folders of CSV files whose columns may be in any order, file by file.

Spark reads CSV by position: one header for all files. Here a *header index* is made first: a distributed job in which
a task reads the first line of one file and nothing more. Files whose wanted columns stand at the same positions form a
layout; each layout is scanned with its own pinned schema, and the scans are united by name. A folder of one layout, the usual
case, is one scan of the given path.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHOLE = str(1 << 40)  # no file is larger: a split per file, and one file per task
_NAMED = 5  # files that an error names


@dataclass(frozen=True)
class Layout:
    """The names of the cells of a row ("" for those not wanted) and the files that are so; no files means the given path."""

    names: tuple[str, ...]
    files: tuple[str, ...]


def _first_lines(batches):
    first = next((b.slice(0, 1) for b in batches if b.num_rows), None)
    if first is not None:
        yield pa.RecordBatch.from_arrays([first.column("file"), first.column("value")], ["file", "line"])


def header_index(spark: SparkSession, path) -> DataFrame:
    """``file, line``: the first line of each file that has one, by a job with a task per file.

    A task stops after its first line, so a file's rest is not read. The settings that keep files
    whole belong to a session of their own, which shares nothing else.
    """
    probe = spark.newSession()
    probe.conf.set("spark.sql.files.maxPartitionBytes", _WHOLE)
    probe.conf.set("spark.sql.files.openCostInBytes", _WHOLE)
    probe.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    lines = probe.read.text(path).selectExpr("_metadata.file_path AS file", "value")
    return lines.mapInArrow(_first_lines, "file string, line string")


def _cells(line: str) -> list[str]:
    return next(csv.reader([line.removeprefix("﻿").rstrip("\r\n")]), [])


def _literal(file: str) -> str:
    """A file's address as a path without patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(file))


def layouts(
    spark: SparkSession, path, wanted: Sequence[str], clean: Callable[[str], str] = str.strip, others: bool = False
) -> list[Layout]:
    """The layouts of the files under ``path``; raises, naming files, if a file lacks a wanted column.

    With ``others`` all columns are wanted, but need not be there. What reaches the driver is a line per file, as Spark's own file listing does. Of columns of one name the first counts.
    """
    found: dict[tuple, list[str]] = {}
    faults = []
    for row in header_index(spark, path).collect():
        names = [clean(c) for c in _cells(row["line"])]
        missing = [c for c in wanted if c not in names]
        if missing:
            faults.append((row["file"], missing, names))
            continue
        own = {names.index(c): c for c in (names if others else wanted)}
        found.setdefault(tuple(own.get(k, "") for k in range(len(names))), []).append(_literal(row["file"]))
    if faults:
        told = "; ".join(f"{file} lacks {missing}, has {names}" for file, missing, names in sorted(faults)[:_NAMED])
        raise ValueError(f"Missing required columns in {len(faults)} of {len(faults) + sum(map(len, found.values()))} files: {told}")
    if len(found) == 1:
        return [Layout(next(iter(found)), ())]
    return [Layout(names, tuple(sorted(files))) for names, files in sorted(found.items())]


def scan_by_name(
    spark: SparkSession,
    path,
    schema: T.StructType,
    clean: Callable[[str], str] = str.strip,
    others: bool = False,
    **options: str,
) -> DataFrame:
    """The columns of ``schema`` from all CSV files under ``path``, by header name in every file.

    With ``others`` the files' other columns follow as text, null where a file has none of that name. Without any file that has a line the
    result is empty.
    """
    by_name = {f.name: f for f in schema.fields}
    parts = []
    for layout in layouts(spark, path, schema.fieldNames(), clean, others):
        text = T.StringType()
        cells = [by_name.get(n) or T.StructField(n or f"_unused_{k}", text) for k, n in enumerate(layout.names)]
        reader = spark.read.options(header=True, **options).schema(T.StructType(cells))
        more = [n for n in layout.names if n and n not in by_name]
        parts.append(reader.csv(list(layout.files) or path).select(*[F.col(_quoted(n)) for n in (*by_name, *more)]))
    union = lambda a, b: a.unionByName(b, allowMissingColumns=others)
    return reduce(union, parts) if parts else spark.createDataFrame([], schema)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
