"""Substring dedup: words covered by a window that occurs earlier are removed.

Earlier means a smaller ``doc_id`` (null is smallest), or an earlier start in the same document; rows that share a
``doc_id`` count as one document that starts anew. Steps:

1. Equal texts: all but those of the smallest ``doc_id`` are repeats as a whole (if they hold a window at all).
2. Windows in a row that share the same smallest hash of ``ANCHOR`` words form a segment. Equal windows have equal anchors, so
   only segments whose anchor occurs at least twice are looked at; their texts are cut out of the documents.
3. Equal segments collapse to the earliest; the windows of the others are repeats.
4. The different segments are dealt to shards by anchor. A shard builds a compressed FM-index of its segments, streams each
   of them backwards through it for its matching statistics, and reports the windows whose class of matches has an earlier
   member. An anchor with more than ``HOT_WORDS`` words is dealt out by single windows, which again collapse when equal.

Null and wordless texts have nothing to remove; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotaflow.llm.common import GOLD, Words, buffer_of, column, mix, pack_texts, quoted, release, sized_slices, slices, stored, unpack_texts, unused, windows, words_of
from rotaflow.llm.fm_index import FmIndex

ANCHOR = 6  # words whose hashes anchor a segment
SEGMENT = 64  # windows in a segment at most
SHARD_WORDS = 400_000
HOT_WORDS = 200_000
FIRST = np.iinfo(np.int64).min  # stands for a null doc_id


def _segments(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first word (in the slice) and number of windows of each segment, and whether it may repeat itself."""
    hashes = w.hashes()
    at, _ = windows(hashes, w.first, window)
    if not len(at):
        return np.zeros(0, np.int64), at, at, np.zeros(0, bool)
    places, grams = windows(hashes, w.first, ANCHOR)
    least = np.full(len(hashes), np.iinfo(np.uint64).max)
    least[places] = grams
    lowest = least[at]
    for k in range(1, window - ANCHOR + 1):
        np.minimum(lowest, least[at + k], out=lowest)
    new = np.ones(len(at), bool)
    new[1:] = (lowest[1:] != lowest[:-1]) | (at[1:] != at[:-1] + 1)
    run = np.flatnonzero(new)
    within = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
    begin = np.flatnonzero(within % SEGMENT == 0)
    return lowest[begin].view(np.int64), at[begin], np.diff(np.append(begin, len(at))), _anchored_twice(least, lowest, at, begin, window)


def _anchored_twice(least: np.ndarray, lowest: np.ndarray, at: np.ndarray, begin: np.ndarray, window: int) -> np.ndarray:
    """Segments that hold their anchor at two places, as those must that repeat a window of their own."""
    times = np.zeros(len(at), np.int8)
    for k in range(window - ANCHOR + 1):
        times += least[at + k] == lowest
    n = np.diff(np.append(begin, len(at)))
    return (np.maximum.reduceat(times, begin) > 1) | (n > window - ANCHOR + 1)


def _kept(w: Words, keep: np.ndarray) -> list[bytes]:
    """Each text's kept words joined by blanks."""
    out, data = [], w.data.tobytes()
    start, end, first = w.start.tolist(), w.end.tolist(), w.first.tolist()
    for d in range(len(first) - 1):
        chosen = np.flatnonzero(keep[first[d] : first[d + 1]]) + first[d]
        out.append(b" ".join([data[start[k] : end[k]] for k in chosen.tolist()]))
    return out


def _scan(window: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = words_of(column(part, "text"))
                anchors, at, _, twice = _segments(w, window)
                times = 1 + twice  # listed twice, the anchor counts as repeated
                anchors, at = np.repeat(anchors, times), np.repeat(at, times)
                of = np.searchsorted(at, w.first)
                lists = pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.array(anchors, pa.int64()))
                whole = [hashlib.sha256(x).hexdigest() for x in _kept(w, np.ones(len(w.start), bool))]
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), column(part, "content"), pa.array(np.diff(w.first)), pa.array(whole, pa.string()), lists],
                    ["doc_id", "content", "n_words", "whole_sha256", "anchors"],
                )

    return run


def _pack(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            texts = column(part, "text")
            found = [pack_texts(texts), pa.array(np.diff(buffer_of(texts)[1]))]
            yield pa.RecordBatch.from_arrays([column(part, "doc"), column(part, "content"), *found], ["doc", "content", "packed", "bytes"])


def _cut(window: int, named: bool):
    """The segments of packed texts: by name those whose anchor is among the ``repeated`` ones, or by text the ``wanted`` ones."""

    def run(batches):
        for batch in batches:
            for part in sized_slices(batch, "bytes"):
                w = words_of(unpack_texts(column(part, "packed"), column(part, "bytes")))
                anchors, at, count, twice = _segments(w, window)
                doc = np.searchsorted(w.first, at, "right") - 1
                own = at - w.first[doc]
                if named:
                    sets = [set(x) for x in column(part, "repeated").to_pylist()]
                    picked = [k for k, (a, d) in enumerate(zip(anchors.tolist(), doc.tolist(), strict=True)) if a in sets[d]]
                else:
                    maps = [{x["start"]: x["hot"] for x in row} for row in column(part, "wanted").to_pylist()]
                    picked = [k for k, (s, d) in enumerate(zip(own.tolist(), doc.tolist(), strict=True)) if s in maps[d]]
                picked = np.array(picked, np.int64)
                owner, size = doc[picked], count[picked] + window - 1
                found = [column(part, "content").take(pa.array(owner)), column(part, "first_id").take(pa.array(owner)), pa.array(own[picked]), pa.array(anchors[picked], pa.int64())]
                if named:
                    names = _span_names(w.hashes(), at[picked], size)
                    yield pa.RecordBatch.from_arrays([*found, pa.array(names.view(np.int64)), pa.array(size), pa.array(twice[picked])], ["content", "first_id", "start", "anchor", "name", "size", "twice"])
                    continue
                data, start, end = w.data.tobytes(), w.start.tolist(), w.end.tolist()
                spans = zip(at[picked].tolist(), size.tolist(), strict=True)
                texts = [b" ".join([data[start[j] : end[j]] for j in range(k, k + n)]) for k, n in spans]
                hot = [maps[d][s] for d, s in zip(owner.tolist(), own[picked].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*found, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(hot, pa.bool_())], ["content", "doc", "start", "anchor", "words", "hot"])

    return run


def _span_names(hashes: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each run of words."""
    out = size.astype(np.uint64)
    for k in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > k)
        out[live] = mix(out[live] * GOLD + hashes[at[live] + k])
    return out


def _shard_repeats(window: int):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["doc", "start", "words"], ignore_index=True)
        index = FmIndex(shard["words"].tolist(), window)
        doc, start = shard["doc"].to_numpy(), shard["start"].to_numpy()
        patterns = [index.text[s : s + n] for s, n in zip(index.start, index.length, strict=True)]
        found = index.matches(patterns)
        row = np.repeat(np.arange(len(shard)), index.length)
        place = np.concatenate([np.arange(n) for n in index.length])
        group = np.concatenate([c for _, c in found])
        row, place, group = (x[group >= 0] for x in (row, place, group))
        d, at = doc[row], start[row] + place
        order = np.lexsort([at, d, group])
        head = np.ones(len(order), bool)
        head[1:] = group[order][1:] != group[order][:-1]
        first = order[head][np.cumsum(head) - 1]  # the earliest window of each class, in sorted order
        repeat = np.zeros(len(row), bool)
        repeat[order] = (d[order] != d[first]) | (at[order] != at[first])
        row, at = row[repeat], at[repeat]
        if not len(row):
            return pd.DataFrame({"content": [], "start": [], "n": []}).astype({"content": object, "start": "int64", "n": "int64"})
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        n = np.diff(np.append(begin, len(row)))
        return pd.DataFrame({"content": shard["content"].to_numpy()[row[begin]], "start": at[begin], "n": n})

    return run


def _remove(window: int):
    """Flags the covered words, and keeps the others."""

    def run(batches):
        for batch in batches:
            for part in sized_slices(batch, "bytes"):
                w = words_of(unpack_texts(column(part, "packed"), column(part, "bytes")))
                cover = np.zeros(len(w.start) + 1, np.int64)
                for first, spans in zip(w.first.tolist(), column(part, "spans").to_pylist(), strict=False):
                    for s in spans:
                        cover[first + s["start"]] += 1
                        cover[first + s["start"] + s["n"] + window - 1] -= 1
                keep = np.cumsum(cover[:-1]) == 0
                texts = _kept(w, keep)
                removed = np.add.reduceat(np.append(~keep, False), w.first[:-1]) if len(w.first) > 1 else []
                removed = np.where(np.diff(w.first) > 0, removed, 0)
                yield pa.RecordBatch.from_arrays(
                    [column(part, "content"), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(texts, pa.binary()).cast(pa.string())],
                    ["content", "n_removed", "kept_sha256", "kept_text"],
                )

    return run


def repeats(docs: DataFrame, window: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What repeats in ``docs`` (doc_id, text), as three tables.

    ``scanned``: doc_id, content (MD5 of the text), n_words, whole_sha256 and first_id (the smallest doc_id with that text) of each row.
    ``spans``: content and the array ``spans`` of (start, n): n repeated windows from that word on.
    ``texts``: content and packed text of those contents that may have spans.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumns({"content": F.unhex(F.md5("text")), "doc": F.coalesce("doc_id", F.lit(FIRST))})
    fields = "doc_id bigint, content binary, n_words bigint, whole_sha256 string, anchors array<bigint>"
    scanned = keyed.select("doc_id", "text", "content").mapInArrow(_scan(window), fields)
    scanned = stored(scanned.withColumn("row", F.monotonically_increasing_id()), "scanned")
    own = F.coalesce("doc_id", F.lit(FIRST))
    firsts = scanned.groupBy("content").agg(F.min(own).alias("first_id"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    copied = stored(firsts.select(F.col("content").alias("same"), "first_id"), "contents")
    whole = scanned.drop("anchors").join(copied, F.col("content") == F.col("same"), "left").drop("same")
    whole = stored(whole.withColumn("first_id", F.coalesce("first_id", own)), "whole")
    release(copied)

    # anchors that occur twice, in different texts or in one
    used = scanned.select(F.explode("anchors").alias("anchor"), "row")
    often = used.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("anchor").alias("shared"))
    often = stored(often, "shared-anchors")
    flagged = used.join(often, F.col("anchor") == F.col("shared")).groupBy("row").agg(F.collect_set("anchor").alias("repeated"))
    flagged = whole.where(own == F.col("first_id")).select("row", F.col("content").alias("same"), "first_id").join(flagged, "row").drop("row")
    flagged = stored(flagged.dropDuplicates(["same"]), "flagged")
    release(scanned, often)
    packed = keyed.select("doc", "content", "text").mapInArrow(_pack, "doc bigint, content binary, packed binary, bytes bigint")
    same = (F.col("content") == F.col("same")) & (F.col("doc") == F.col("first_id"))
    texts = packed.join(flagged, same).select("content", "first_id", "packed", "bytes", "repeated")
    texts = stored(texts, "flagged-texts")
    release(flagged)

    # all but the earliest of equal segments repeat as a whole; segments are named by anchor and hash here
    fields = "content binary, first_id bigint, start bigint, anchor bigint, name bigint, size bigint, twice boolean"
    named = texts.mapInArrow(_cut(window, named=True), fields)
    key = F.struct(F.col("first_id").alias("doc"), "start", "content")
    different = named.groupBy("anchor", "name").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.max("twice").alias("twice"))
    different = stored(different, "segments")
    multiple = different.where("n > 1").select(F.col("anchor").alias("anchor2"), F.col("name").alias("name2"), "first.doc", F.col("first.start").alias("start2"))
    later = named.join(multiple, (F.col("name") == F.col("name2")) & (F.col("anchor") == F.col("anchor2")))
    later = later.where("first_id != doc OR start != start2").select("content", "start", (F.col("size") - (window - 1)).alias("n"))

    # only anchors with several different segments, or one that may repeat itself, are searched
    sums = different.groupBy("anchor").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("kinds"), F.max("twice").alias("twice"))
    sums = stored(sums.where("kinds > 1 OR twice").select(F.col("anchor").alias("sought"), "total"), "sought-anchors")
    wanted = different.join(sums, F.col("anchor") == F.col("sought")).select("first.content", "first.start", F.col("total") > HOT_WORDS)
    wanted = wanted.toDF("same", "start", "hot").groupBy("same").agg(F.collect_set(F.struct("start", "hot")).alias("wanted"))
    wanted = stored(wanted, "sought-segments")
    sought = texts.drop("repeated").join(wanted, F.col("content") == F.col("same")).drop("same")
    sought = sought.dropDuplicates(["content"])
    fields = "content binary, doc bigint, start bigint, anchor bigint, words string, hot boolean"
    sized = stored(sought.mapInArrow(_cut(window, named=False), fields), "sought-texts")
    release(wanted)
    all_words = sums.agg(F.sum("total")).first()[0] or 0
    shards = max(1, -(-all_words // SHARD_WORDS))
    parts = F.expr(f"transform(sequence(0, size(split(words, ' ')) - {window}), i -> struct(i AS i, array_join(slice(split(words, ' '), CAST(i + 1 AS int), {window}), ' ') AS w))")
    single = sized.where("hot").select("doc", "start", "content", F.explode(parts).alias("p"))
    single = single.select("doc", (F.col("start") + F.col("p.i")).alias("start"), "content", F.col("p.w").alias("words"))
    leads = stored(single.groupBy("words").agg(F.min(F.struct("doc", "start")).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1"), "hot-windows")
    single = single.join(leads.select(F.col("words").alias("words2"), "lead"), F.col("words") == F.col("words2"))
    single = single.where("doc != lead.doc OR start != lead.start").select("content", "start", F.lit(1).cast("long").alias("n"))
    rest = sized.where("NOT hot").select("doc", "start", "content", "words", F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
    inner = rest.groupBy("shard").applyInPandas(_shard_repeats(window), "content binary, start bigint, n bigint")
    every = later.unionByName(inner).unionByName(single)
    spans = stored(every.groupBy("content").agg(F.collect_set(F.struct("start", "n")).alias("spans")), "spans")
    release(different, sums, sized, leads)
    return whole, spans, texts.select("content", "packed", "bytes")


def deduplicate(docs: DataFrame, window: int = 20, with_text: bool = True) -> DataFrame:
    """doc_id, content, n_words, n_removed, kept_sha256 and, if asked for, kept_text (null: the text's words are all kept) of each row."""
    whole, spans, texts = repeats(docs, window)
    repeated = texts.dropDuplicates(["content"]).join(spans, "content")
    cleaned = repeated.mapInArrow(_remove(window), "content binary, n_removed bigint, kept_sha256 string, kept_text string")
    cleaned = stored(cleaned if with_text else cleaned.drop("kept_text"), "cleaned").withColumnRenamed("content", "same")
    release(spans, texts)
    copy = (F.coalesce("doc_id", F.lit(FIRST)) != F.col("first_id")) & (F.col("n_words") >= window)
    out = whole.join(cleaned, F.col("content") == F.col("same"), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id",
        "content",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
        *([F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []),
    )


def cleaned_documents(docs: DataFrame, window: int = 20) -> DataFrame:
    """``docs`` (all columns and rows) with the kept words as text where words go; other texts stay as they are, to the byte.

    ``n_chars``, if there is such a column, is counted anew for changed texts.
    """
    found = deduplicate(docs, window).where("n_removed > 0")
    own, same, kept = (unused(docs.columns, n) for n in ("_id", "_content", "_kept"))
    changes = found.select(F.col("doc_id").alias(own), F.col("content").alias(same), F.col("kept_text").alias(kept)).distinct()
    changes = stored(changes, "changes")
    release(found)
    content = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    out = docs.join(changes, (content == F.col(same)) & F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left")
    text = F.when(F.col(same).isNotNull(), F.col(kept)).otherwise(F.col("text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col(same).isNotNull(), F.length(kept).cast(kind)).otherwise(F.col("n_chars"))
    return out.select(*[new[c].alias(c) if c in new else quoted(c) for c in docs.columns])
