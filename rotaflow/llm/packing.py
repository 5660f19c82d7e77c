"""Best-fit packing, planned on the histogram of lengths.

Documents are cut into pieces of at most ``capacity`` tokens (the first takes the remainder). Best fit
by decreasing length is planned over the counts of the lengths, which is a table of at most ``capacity``
rows; a step places many equal pieces into many equal bins at once. Pieces then take the planned slots
by joining on their rank within their length.

Null and empty texts are documents of the end id alone; null and repeated ``doc_id`` are ordinary rows;
an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotaflow.llm.common import column, ranked, slices, stored

# The byte-level pre-tokenizer's pattern: a fixed value of the public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# For texts of these characters alone (all letters above U+00BF here are \p{L}) the same split in classes that `re` handles.
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_BLANK = "\t-\r "
_SIMPLE = re.compile(f"[\t-\r -~{_LETTER}]*")
_SIMPLE_PATTERN = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^{_BLANK}0-9{_LETTER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)
CACHED = 300_000  # words whose ids a Python worker keeps


class ByteBpe:
    """Ids of whole texts under a byte-level vocabulary file, equal to the `tokenizers` library's.

    A text is split by the pattern and each different word is merged once; a worker keeps
    the ids of a bounded number of words.
    """

    _loaded: dict[str, ByteBpe] = {}

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the file shows as themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in piece): n for piece, n in spec["model"]["vocab"].items() if piece not in self.special}
        self.merge = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.full = regex.compile(PATTERN)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> ByteBpe:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _word(self, word: str) -> bytes:
        ids = np.array(self.merge(word.encode()), "<u4").tobytes()
        if len(self.known) >= CACHED:
            self.known.clear()
        if len(word) < 100:
            self.known[word] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        split = _SIMPLE_PATTERN.findall if _SIMPLE.fullmatch(text) else self.full.findall
        known, word = self.known, self._word
        return b"".join([known.get(w) or word(w) for w in split(text)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(
            self.special[t].to_bytes(4, "little") if t in self.special else self._plain(t) for t in self.cut.split(text)
        )


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece of each document."""

    def run(batches):
        bpe, end = ByteBpe.load(tokenizer), end_id.to_bytes(4, "little")
        for batch in batches:
            for part in slices(batch, "text"):
                texts = column(part, "text").to_pylist()
                row, number, start, length, crc, kept = [], [], [], [], [], []
                for k, text in enumerate(texts):
                    ids = bpe.encode(text or "") + end
                    low, total = 0, len(ids) // 4
                    high = total % capacity or capacity
                    for n in range(-(-total // capacity)):
                        raw = ids[4 * low : 4 * high]
                        row.append(k), number.append(n), start.append(low), length.append(high - low), crc.append(zlib.crc32(raw))
                        if with_ids:
                            kept.append(np.frombuffer(raw, "<u4").astype(np.int32))
                        low, high = high, high + capacity
                found = [column(part, "doc_id").take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(found + [pa.array(kept, pa.list_(pa.int32()))] * with_ids, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, fields)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit by decreasing length over counts: (length, first rank, pieces, first sequence, offset).

    ``pieces`` consecutive ranks of that length go to as many consecutive sequences. Bins with
    the same rest that were opened together form a run; a step fills a run or splits it once.
    """
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # rest -> (first sequence, bins)
    steps, opened = [], 0
    rests: set[int] = set()
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            fit = min((r for r in rests if r >= length), default=None)
            if fit is None:
                first, bins, fit = opened, left, capacity
                opened += bins
            else:
                first, bins = runs[fit].pop()
            used = min(bins, left)
            if used < bins:
                runs[fit].append((first + used, bins - used))
            elif not runs[fit]:
                rests.discard(fit)
            steps.append((length, rank, used, first, capacity - fit))
            if rest := fit - length:
                runs[rest].append((first, used))
                rests.add(rest)
            rank, left = rank + used, left - used
    return steps


def pack(parts: DataFrame, capacity: int = 1024) -> DataFrame:
    """``parts`` (from ``pieces``) with sequence_id and offset.

    To the driver go at most ``capacity`` counts. The plan has a step per length and run of bins; each
    step uses up a length or a run, so it grows with capacity squared at most, never with the documents, and is broadcast.
    """
    parts = stored(parts, "pieces")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    steps = plan(counts, capacity)
    spark = parts.sparkSession
    table = spark.createDataFrame(steps, "of bigint, low bigint, n bigint, first bigint, offset bigint")
    numbered = ranked(parts, "length", ["doc_id", "piece", "ids_crc32"], F.xxhash64("doc_id", "piece", "ids_crc32"), "rank")
    same = (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + F.col("n"))
    placed = numbered.join(F.broadcast(table), same)
    return placed.select(*parts.columns, (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")
