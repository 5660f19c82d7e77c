"""WARC archives: a writer of deduplicated records and a splittable reader.

Writer: one gzip member per record. Of rows with equal payloads of at least ``least`` bytes the one with the smallest
``page_id`` (nulls last) is a response, the others are revisits of it without the payload; rows that repeat the smallest
``page_id`` are responses too. Files are written by Spark's text writer, so task retries and commits are Spark's.

Reader: the files are divided into byte ranges, a task each. A task looks for gzip magic in its range, accepts a
candidate if its member decodes to a WARC header, decodes to the end with a right checksum, and is followed by another
member or the end of the file; it owns the records that start inside its range, and reads beyond it to finish the last.
A damaged member is passed over, and reading goes on behind it; ``rejected_spans`` tells which bytes of which file were passed over.

Null html is an empty payload, null url an empty target, null page_id is left out of the record and read back as null;
control characters and blanks of a url are percent-encoded. An empty table gives no records.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rotaflow.llm.common import column, slices, stored

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 32 << 20
READ_BYTES = 1 << 20
EMPTY_MEMBER = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 255, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])


# ---------------------------------------------------------------- writing


def plan_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, payload, digest, record_type and refers_to of each page.

    Only digests that occur more than once are joined back; they are stored first, so that both sides of the join are plain
    exchanges and adaptive execution splits a digest that holds much of the table.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= least
    first = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = stored(first.where("n > 1").drop("n"), "first-pages").withColumnRenamed("digest", "same")
    rows = rows.join(first, large & (F.col("digest") == F.col("same")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select(
        "page_id", "url", "payload", "digest",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def _record(page_id, url: str, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Payload-Digest: sha256:{digest}"]
    head += [f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = http if kind == "revisit" else http + payload
    head += [f"Content-Length: {len(block)}", "", ""]
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = gz.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + gz.flush()
    return member if member[-1] == 0 else member + EMPTY_MEMBER  # the last byte is 0 below 16 MiB


def write_archives(records: DataFrame, path: str) -> None:
    """Writes ``plan_records`` as gzip WARC files.

    A member ends in a zero byte, which is left to the text writer as its line separator; so the files hold members and nothing else.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "payload"):
                names = ("page_id", "url", "payload", "digest", "record_type", "refers_to")
                rows = zip(*[column(part, n).to_pylist() for n in names], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([_record(*r)[:-1] for r in rows], pa.binary())], ["member"])

    members = records.mapInArrow(run, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


# ---------------------------------------------------------------- reading


class _Window:
    """Bytes of a file from a moving start on, read as they are asked for."""

    def __init__(self, file, at: int, size: int):
        self.file, self.at, self.size, self.held = file, at, size, b""
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(min(READ_BYTES, self.size - self.at - len(self.held)))
        self.held += got
        return bool(got)

    def move(self, at: int) -> None:
        self.held, self.at = self.held[at - self.at :], at


def _member(w: _Window, at: int) -> tuple[bytes, int] | None:
    """Content of the member at ``at`` and the place behind it; None if it isn't a whole, valid member."""
    decoder, content, fed = zlib.decompressobj(31), [], at - w.at
    try:
        while not decoder.eof:
            if fed >= len(w.held) and not w.more():
                return None
            content.append(decoder.decompress(w.held[fed:]))
            fed = len(w.held)
            if len(content) == 1 and len(content[0]) >= 5 and content[0][:5] != b"WARC/":
                return None
    except zlib.error:
        return None
    end = w.at + fed - len(decoder.unused_data)
    while len(w.held) < end - w.at + 3 and w.more():
        pass
    follows = w.held[end - w.at : end - w.at + 3]
    return (b"".join(content), end) if not follows or MAGIC.startswith(follows[:3]) and follows else None


def _headers(record: bytes) -> tuple[dict[str, str], bytes] | None:
    head, gap, block = record.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/"):
        return None
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, block


def owned_records(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Place, headers and block of the records that start in [start, end) of a file."""
    w, at = _Window(file, start, size), start
    while at < end:
        found = w.held.find(MAGIC, at - w.at)
        if found < 0:
            at = max(at, w.at + len(w.held) - 2)
            w.move(at)
            if not w.more():
                return
            continue
        at += found - (at - w.at)
        if at >= end:
            return
        w.move(at)
        if (member := _member(w, at)) is None or (parsed := _headers(member[0])) is None:
            at += 1  # not a record: part of compressed data, or an empty member
            continue
        yield at, *parsed
        at = member[1]
        w.move(at)


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, place, headers and block of all records, one task per byte range."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    starts = F.explode(F.expr(f"sequence(0L, length - 1, {range_bytes}L)"))
    ranges = files.where("length > 0").select("path", "length", starts.alias("start"))
    count = ranges.count()
    ranges = ranges.repartition(max(1, min(count, 100_000)), "path", "start")

    def run(batches):
        from pyarrow.fs import FileSystem

        for batch in batches:
            for row in batch.to_pylist():
                system, place = FileSystem.from_uri(row["path"])
                with system.open_input_file(place) as file:
                    out, held = [], 0
                    for at, headers, block in owned_records(file, row["length"], row["start"], row["start"] + range_bytes):
                        out.append((row["path"], at, list(headers.items()), block))
                        held += len(block)
                        if held >= READ_BYTES:
                            yield _batch(out)
                            out, held = [], 0
                    yield _batch(out)

    return ranges.mapInArrow(run, "path string, place bigint, headers map<string,string>, block binary")


def covered_spans(file, size: int, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Start and end of the members that start in [start, end): records, and empty members as fill a separator."""
    at = start
    for place, _, _ in owned_records(file, size, start, end):
        w = _Window(file, place, size)
        yield from _empty_members(file, at, place)
        at = _member(w, place)[1]
        yield place, at
    yield from _empty_members(file, at, end)


def _empty_members(file, start: int, end: int) -> Iterator[tuple[int, int]]:
    if end - start >= len(EMPTY_MEMBER):
        file.seek(start)
        held, at = file.read(min(end - start, READ_BYTES)), 0
        while (at := held.find(EMPTY_MEMBER, at)) >= 0:
            yield start + at, start + at + len(EMPTY_MEMBER)
            at += len(EMPTY_MEMBER)


def rejected_spans(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, start and end of all bytes that belong to no valid member: damaged records, and anything else that ``read_archives`` passes over.

    Each range reports where its members begin and end; what is missing between ranges follows from the rows of a file's ranges, a few
    per file. An archive without damage has no row.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", "length", F.explode(F.expr(f"sequence(0L, length - 1, {range_bytes}L)")).alias("start"))
    ranges = ranges.repartition("path", "start")

    def run(batches):
        from pyarrow.fs import FileSystem

        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                system, place = FileSystem.from_uri(row["path"])
                with system.open_input_file(place) as file:
                    first, last, gaps = None, None, []
                    for a, b in covered_spans(file, row["length"], row["start"], min(row["length"], row["start"] + range_bytes)):
                        if last is not None and a > last:
                            gaps.append({"start": last, "end": a})
                        first, last = a if first is None else first, b if last is None else max(b, last)
                rows.append((row["path"], row["length"], row["start"], first, last, gaps))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), span]
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["path", "length", "start", "first", "last", "gaps"])

    shape = "path string, length bigint, start bigint, first bigint, last bigint, gaps array<struct<start: bigint, end: bigint>>"
    found = ranges.mapInArrow(run, shape)
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("last").over(before), F.lit(0).cast("long"))
    ends = F.max(F.struct("start", F.greatest(F.coalesce("last", F.lit(0).cast("long")), "reached").alias("last"), "length")).alias("e")
    found = stored(found.withColumn("reached", reached), "member-ends")
    inside = found.select("path", F.explode("gaps").alias("g")).select("path", "g.start", "g.end")
    between = found.where("first > reached").select("path", F.col("reached").alias("start"), F.col("first").alias("end"))
    behind = found.groupBy("path").agg(ends).where("e.last < e.length").select("path", F.col("e.last").alias("start"), F.col("e.length").alias("end"))
    return inside.unionByName(between).unionByName(behind)


def _batch(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    kinds = [pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["path", "place", "headers", "block"])


def pages_of(records: DataFrame) -> DataFrame:
    """page_id, payload, payload_bytes, payload_digest, record_type and refers_to of records.

    Payload, length and digest of a response come from its block; a revisit has those of its headers.
    """
    header = lambda name: F.col("headers")[name]
    number = lambda name: F.nullif(F.regexp_extract(header(name), "<urn:page:(-?\\d*)>", 1), F.lit("")).cast("long")
    response = header("warc-type") == "response"
    http = F.expr("octet_length(substring_index(cast(block as string), '\\r\\n\\r\\n', 1))")
    size = header("content-length").cast("long")
    payload = F.when(response, F.col("block").substr(http + 5, (size - http - 4).cast("int")))
    rows = records.withColumn("payload", payload)
    return rows.select(
        number("warc-record-id").alias("page_id"),
        "payload",
        F.when(response, F.octet_length("payload").cast("long")).otherwise(header("x-payload-length").cast("long")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.regexp_replace(header("warc-payload-digest"), "^sha256:", "")).alias("payload_digest"),
        header("warc-type").alias("record_type"),
        number("warc-refers-to").alias("refers_to"),
    )
