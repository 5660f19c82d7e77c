"""Helpers the operators share: stored tables, bounded Arrow slices, words and their hashes.

Words are maximal runs of bytes other than blank and 0x09-0x0D. They are found and hashed on
the UTF-8 buffer of an Arrow column, a bounded number of bytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotaflow.session import fresh_path, shared_folder

SLICE_BYTES = 1 << 20  # text handled at once in a Python worker; one longer text is handled alone
HASH_BYTES = 1 << 20  # bytes hashed at once, also within one long text

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; at most ``HASH_BYTES`` (or one span) are expanded at once.

    A span is cut into chunks of 8 bytes. Each chunk is mixed with a key of its place in the span, and the mixed chunks are summed: nothing
    is linear in places or bytes, so structured texts do not collide, and spans of up to 8 bytes of one length never do.
    """
    out = np.zeros(len(start), np.uint64)
    if not len(start):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    length = end - start
    chunks = (length + 7) >> 3
    ends = np.cumsum(chunks)
    at = 0
    while at < len(start):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + HASH_BYTES // 8, "right")))
        n = chunks[at:stop]
        place = np.arange(int(ends[stop - 1]) - before) - np.repeat(ends[at:stop] - n - before, n)
        left = np.repeat(length[at:stop], n) - 8 * place
        chunk = eight[np.repeat(start[at:stop], n) + 8 * place]
        cut = left < 8
        chunk[cut] &= (np.uint64(1) << (8 * left[cut]).astype(np.uint64)) - np.uint64(1)
        mixed = mix(chunk ^ mix((place + 1).astype(np.uint64) * GOLD))
        sums = np.zeros(len(mixed) + 1, np.uint64)
        np.cumsum(mixed, out=sums[1:])
        edge = ends[at:stop] - before
        out[at:stop] = mix(sums[edge] - sums[edge - n] + length[at:stop].astype(np.uint64) * GOLD)
        at = stop
    return out


def same_spans(data: np.ndarray, start: np.ndarray, length: np.ndarray, other: np.ndarray, other_start: np.ndarray) -> np.ndarray:
    """Which spans of ``data`` equal, byte by byte, the spans of ``other`` that have the same ``length`` and start at ``other_start``."""
    out = np.ones(len(start), bool)
    ends = np.cumsum(length)
    at = 0
    while at < len(start):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + HASH_BYTES, "right")))
        n = length[at:stop]
        within = np.arange(int(ends[stop - 1]) - before) - np.repeat(ends[at:stop] - n - before, n)
        differ = data[np.repeat(start[at:stop], n) + within] != other[np.repeat(other_start[at:stop], n) + within]
        out[at + np.repeat(np.arange(stop - at), n)[differ]] = False
        at = stop
    return out


@dataclass
class Words:
    """Words of a slice of texts: byte spans in ``data``, and ``first[d]:first[d + 1]`` of text d."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offset of each; null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, content = texts.buffers()
    if not len(texts) or content is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(content, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words_of(texts: pa.Array) -> Words:
    data, offsets = buffer_of(texts)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, np.zeros(len(offsets), np.int64))
    inside = ~_SPACE[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
    opens[heads] = inside[heads]
    closes[tails] = inside[tails]
    start = np.flatnonzero(opens)
    return Words(data, offsets, start, np.flatnonzero(closes) + 1, np.searchsorted(start, offsets))


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all windows of ``size`` words inside one text, and their hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = hashes[:n].copy()
    for k in range(1, size):
        total = total * GOLD + hashes[k : n + k]
    last = np.repeat(first[1:], np.diff(first))[:n]
    at = np.flatnonzero(np.arange(n) + size <= last)
    return at, mix(total[at])


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with at most ``SLICE_BYTES`` of text each, or one long text alone."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.diff(buffer_of(column)[1])
    ends, low = np.cumsum(sizes), 0
    while low < len(sizes):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield batch.slice(low, high - low)
        low = high


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def quoted(name: str):
    """A column by its name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(taken: list[str], name: str) -> str:
    """``name``, with as many underscores more as keep it apart from the names taken (in any case)."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def tokenizer(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_texts(texts: pa.Array) -> pa.Array:
    """Each text compressed by itself: less to shuffle and store. ``unpack_texts`` needs the sizes in bytes."""
    return pa.array([pa.compress((t or "").encode(), codec="zstd", asbytes=True) for t in texts.to_pylist()], pa.binary())


def unpack_texts(packed: pa.Array, sizes: pa.Array) -> pa.Array:
    pairs = zip(packed.to_pylist(), sizes.to_pylist(), strict=True)
    return pa.array([pa.decompress(p, decompressed_size=s, codec="zstd", asbytes=True) for p, s in pairs], pa.binary()).cast(pa.string())


def sized_slices(batch: pa.RecordBatch, *sizes: str) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch whose named sizes add up to ``SLICE_BYTES``, or one large row alone."""
    ends = np.cumsum(sum(column(batch, s).to_numpy(zero_copy_only=False) for s in sizes))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SLICE_BYTES, "right")))
        yield batch.slice(low, high - low)
        low = high


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Joins of a large table with the few keys that are wanted of it: Spark drops other rows before the exchange by a Bloom filter of bounded size.
BLOOM = "spark.sql.optimizer.runtime.bloomFilter"
FILTERED = {f"{BLOOM}.enabled": "true", f"{BLOOM}.applicationSideScanSizeThreshold": "0", f"{BLOOM}.creationSideThreshold": "1g"}


def stored(df: DataFrame, name: str, filtered: bool = False) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: a lost executor costs no recomputation.

    The shuffle files of the write go when it has ended; nothing reads them again. With ``filtered`` joins with stored keys under a
    condition drop rows early by a Bloom filter.
    """
    spark = df.sparkSession
    path, wanted = fresh_path(spark, f"llm-{name}"), {CLEANUP: "true"} | (FILTERED if filtered else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Deletes the stored tables that ``tables`` read. No frame that is evaluated later may depend on them; other files are left alone."""
    for df in tables:
        spark = df.sparkSession
        ours = f"{shared_folder(spark).rstrip('/')}/rotaflow/llm-".split(":", 1)[-1].lstrip("/")
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            if ours in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ranked(df: DataFrame, group: str, tie: list, spread, name: str, buckets: int = 256) -> DataFrame:
    """``df`` with ``name``: gapless ranks from 0 within ``group``, without a task per group.

    Rows of a group are dealt to ``buckets`` by the column ``spread``; a row's rank is its rank in
    its bucket plus the rows in earlier buckets. ``group`` must have a bounded number of values:
    the table of offsets has at most values x ``buckets`` rows and is broadcast. ``df`` is read twice.
    """
    from pyspark.sql import Window

    df = df.withColumn("_bucket", F.pmod(spread, F.lit(buckets)).cast("int"))
    sizes = df.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(group).alias("_group"), F.col("_bucket").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inner = Window.partitionBy(group, "_bucket").orderBy(*tie)
    out = df.withColumn("_rank", F.row_number().over(inner).cast("long") - 1)
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_bucket") == F.col("_at"))
    out = out.join(F.broadcast(offsets), same)
    return out.withColumn(name, F.col("_rank") + F.col("_before")).drop("_rank", "_before", "_group", "_at", "_bucket")
