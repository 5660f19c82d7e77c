"""Near-duplicates by BagMinHash: signatures for weighted Jaccard similarity, bands, and exact verification.

A document is the bag of its runs of ``SHINGLE`` words with their counts (a shorter text is one shingle; a text without words has
none and is alike only to itself). The weight axis of a shingle is discretised in unit steps and cut into a hierarchy of octaves
[0, 1), [1, 2), [2, 4), [4, 8) ...; each octave is a Poisson process of its own whose points carry a time, a register and a place, drawn evenly
over the octave's steps. Octaves wholly below the weight keep all their points; in the one that holds the weight, points at or above it are
rejected, which is at most every second one. A register keeps its earliest point, so two documents agree in it with probability equal to their
weighted Jaccard similarity. Processes stop as soon as they are later than all registers of their document.

Documents with equal bags collapse to one node. Near copies meet in many of their ``BANDS`` buckets; of buckets with the same members (told by their number
and two order-free fingerprints of 64 bits) one stays. A bucket proposes links of its members to one centre; what is verified
is merged into components, and the other components try a member of the bucket's largest one, ``STARS`` times. What is still outside is
compared with all texts of that component, in blocks whose tasks return links only. Documents outside after that are compared with the others that were
outside in their bucket, again in blocks whose tasks return only links that join components. Only texts whose sizes allow the similarity meet: sizes are
dealt to classes that grow by the threshold, and a class meets itself and its neighbours. So what a link between different texts in a common
bucket connects is connected, and no pairs are made. Only documents of a bucket with others are ever joined with their texts; these are stored once.
A pair at the threshold shares none of ``BANDS`` bands of ``ROWS`` with a probability of 1.3e-7.

Null texts count as empty; null ``doc_id`` may be in a class but names it only if all are null; repeated rows are copies of each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rotaflow.llm.common import GOLD, Words, buffer_of, column, mix, pack_texts, quoted, release, sized_slices, slices, stored, unpack_texts, windows, words_of
from rotaflow.llm.components import components

SHINGLE = 5
BANDS, ROWS = 40, 5
STARS = 2  # rounds that propose one centre per bucket before the rest is compared in blocks
BLOCK = 500  # texts of a side that are compared in one task group, on average
BLOCK_WORDS = 400_000  # words of a side that are compared in one task group, on average


def bags(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document (in the slice), shingle and count, ordered by document and shingle."""
    hashes = w.hashes()
    at, keys = windows(hashes, w.first, SHINGLE)
    n_words = np.diff(w.first)
    doc = w.doc[at]
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE):
            some = n_words[short] > k
            own[some] = mix(own[some] * GOLD + hashes[w.first[short[some]] + k] + np.uint64(1))
        doc, keys = np.concatenate([doc, short]), np.concatenate([keys, own])
    order = np.lexsort([keys, doc])
    doc, keys = doc[order], keys[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])
    begin = np.flatnonzero(new)
    return doc[begin], keys[begin], np.diff(np.append(begin, len(doc)))


def signatures(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n_docs: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """The earliest point of each register: an array of documents x registers, 0 where a document has no shingles."""
    octaves = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64), 0) + 1
    d = np.repeat(doc, octaves)
    level = np.arange(len(d)) - np.repeat(np.cumsum(octaves) - octaves, octaves)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)  # the octave is [low, low + width)
    width = np.maximum(low, 1)
    most = np.repeat(weight, octaves)
    seed = mix(np.repeat(key, octaves) + level.astype(np.uint64) * GOLD)
    first = np.full(n_docs * registers, np.inf)
    name = np.zeros(n_docs * registers, np.uint64)
    time = np.zeros(len(d))
    while len(d):
        seed = seed + GOLD
        drawn = mix(seed)
        time = time - np.log(((drawn >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / width
        more = mix(drawn ^ GOLD)
        register = ((more >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)
        place = low + ((more & np.uint64(0xFFFFFFFF)).astype(np.int64) * width >> 32)
        slot = d * registers + register.astype(np.int64)
        better = np.flatnonzero((place < most) & (time < first[slot]))
        better = better[np.argsort(-time[better], kind="stable")]  # the last, earliest one stays
        first[slot[better]], name[slot[better]] = time[better], drawn[better]
        latest = first.reshape(n_docs, registers).max(axis=1)
        live = time < latest[d]
        d, time, seed, width, low, most = (x[live] for x in (d, time, seed, width, low, most))
    return name.reshape(n_docs, registers)


def _sign(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            texts, n = column(part, "text"), part.num_rows
            doc, key, weight = bags(words_of(texts))
            names = signatures(doc, key, weight, n)
            size = np.bincount(doc, weight, n).astype(np.int64)
            bands = np.zeros((n, BANDS), np.uint64) + mix(np.arange(1, BANDS + 1, dtype=np.uint64))
            for r in range(ROWS):
                bands = mix(bands * GOLD + names[:, r::ROWS])
            count = weight.astype(np.uint64)
            sums = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
            for s, salt in zip(sums, (1, 2), strict=True):  # order-free hashes of the bag
                np.add.at(s, doc, mix(mix(key + np.uint64(salt)) + count * GOLD))
            bag = np.stack([*sums, size.astype(np.uint64)], axis=1)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(bands.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
            content = pa.array([b.tobytes() for b in bag], pa.binary())
            others = [c for c in part.schema.names if c != "text"]
            found = [pc.if_else(pa.array(size > 0), content, pa.scalar(None, pa.binary())), pa.array(size), lists, pack_texts(texts), pa.array(np.diff(buffer_of(texts)[1])), texts.is_valid()]
            yield pa.RecordBatch.from_arrays([*[column(part, c) for c in others], *found], [*others, "_bag", "_size", "_bands", "_packed", "_bytes", "_given"])


def overlap(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair of texts: the size of the intersection and of the union of their bags."""
    sides = []
    for texts in (left, right):
        doc, key, weight = bags(words_of(texts))
        sides.append((key ^ mix(doc.astype(np.uint64) + np.uint64(1)), doc, weight))
    (ka, da, wa), (kb, db, wb) = sides
    order = np.argsort(kb)
    at = np.searchsorted(kb[order], ka)
    at[at == len(kb)] = 0
    hit = kb[order][at] == ka if len(kb) else np.zeros(len(ka), bool)
    common = np.minimum(wa[hit], wb[order[at[hit]]])
    n = len(left)
    both = np.bincount(da[hit], common, n).astype(np.int64)
    total = np.bincount(da, wa, n).astype(np.int64) + np.bincount(db, wb, n).astype(np.int64)
    return both, total - both


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            for part in sized_slices(batch, "bytes_a", "bytes_b"):
                texts = [unpack_texts(column(part, f"packed_{x}"), column(part, f"bytes_{x}")) for x in "ab"]
                both, union = overlap(*texts)
                near = pa.array(100 * both >= percent * union)
                yield pa.RecordBatch.from_arrays([column(part, "a").filter(near), column(part, "b").filter(near)], ["a", "b"])

    return run


def _similar(own: pa.Array, others: pa.Array, percent: int) -> Iterator[np.ndarray]:
    """For each text of ``own`` the places of all similar ones among ``others``."""
    doc, key, weight = bags(words_of(others))
    order = np.argsort(key, kind="stable")
    doc, key, weight = doc[order], key[order], weight[order]
    size = np.bincount(doc, weight, len(others))
    d, k, c = bags(words_of(own))
    edge = np.searchsorted(d, np.arange(len(own) + 1))
    low, high = np.searchsorted(key, k, "left"), np.searchsorted(key, k, "right")
    for s in range(len(own)):
        mine = slice(edge[s], edge[s + 1])
        n = high[mine] - low[mine]
        at = np.repeat(low[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(doc[at], np.minimum(weight[at], np.repeat(c[mine], n)), len(others))
        yield np.flatnonzero((common > 0) & (100 * common >= percent * (size + c[mine].sum() - common)))


def first_links(own: pa.Array, others: pa.Array, percent: int) -> list[int]:
    """For each text of ``own`` the first of ``others`` that is similar, or -1."""
    return [int(near[0]) if len(near) else -1 for near in _similar(own, others, percent)]


def joining_links(own: pa.Array, others: pa.Array, own_part: np.ndarray, others_part: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Of all links between ``own`` and ``others`` as many as join the components they join: fewer than there are components."""
    part = np.unique(np.concatenate([own_part, others_part]), return_inverse=True)[1]
    out = []
    for s, near in enumerate(_similar(own, others, percent)):
        other = part[len(own) + near]
        for p, at in zip(*np.unique(other, return_index=True), strict=True):
            if p != part[s]:
                out.append((s, int(near[at])))
        part[np.isin(part, other)] = part[s]
    return out


def _links_in_block(percent: int):
    def run(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        texts = [unpack_texts(pa.array(x["packed"]), pa.array(x["bytes"])) for x in (own, others)]
        hit = np.array(first_links(*texts, percent), np.int64) if len(own) and len(others) else np.zeros(0, np.int64)
        found = np.flatnonzero(hit >= 0)
        return pd.DataFrame({"a": own["node"].to_numpy()[found], "b": others["node"].to_numpy()[hit[found]]})

    return run


def _joins_in_block(percent: int):
    def run(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        texts = [unpack_texts(pa.array(x["packed"]), pa.array(x["bytes"])) for x in (own, others)]
        parts = [x["part"].to_numpy() for x in (own, others)]
        found = np.array(joining_links(*texts, *parts, percent) if len(own) and len(others) else [], np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": own["node"].to_numpy()[found[:, 0]], "b": others["node"].to_numpy()[found[:, 1]]})

    return run


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, _class (the smallest doc_id of the class), _keeper, the packed text and the struct _others of all columns of ``docs`` but text.

    Columns of any name may be there, since they are in the struct. One row of each class is the keeper: the first with the smallest doc_id. Two documents are linked if their weighted Jaccard similarity is
    ``percent`` or more; classes are the connected components.
    """
    own = docs.select(F.struct(*[quoted(c) for c in docs.columns if c != "text"]).alias("_others"), "doc_id", "text")
    made = StructType.fromDDL("_bag binary, _size bigint, _bands array<bigint>, _packed binary, _bytes bigint, _given boolean")
    fields = StructType([*[f for f in own.schema.fields if f.name != "text"], *made.fields])
    signed = stored(own.mapInArrow(_sign, fields).withColumn("_row", F.monotonically_increasing_id()), "signed")

    # one row per bag: the first with the smallest doc_id, and its bands
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("_row").alias("row"), F.col("_bands").alias("bands"))).alias("lead")
    signed_nodes = signed.where("_bag IS NOT NULL").groupBy("_bag", "_size").agg(lead)
    signed_nodes = stored(signed_nodes.select(F.col("_bag").alias("bag"), F.col("lead.no").alias("no"), F.col("lead.id").alias("id"), F.col("lead.row").alias("node"), F.col("_size").alias("size"), "lead.bands"), "nodes")
    nodes = signed_nodes.drop("bands")
    heads = signed_nodes.select("node", "size", F.explode("bands").alias("bucket"))
    full = stored(heads.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("bucket").alias("same")), "buckets")
    members = stored(heads.join(full.where("same <> 0"), F.col("bucket") == F.col("same")).select("bucket", "node", "size"), "members", filtered=True)
    release(full)
    prints = [F.bit_xor(F.xxhash64("node", F.lit(salt))).alias(f"x{salt}") for salt in (1, 2)]
    sets = members.groupBy("bucket").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n"), *prints)
    sets = stored(sets.groupBy("n", "x1", "x2").agg(F.min(F.struct("bucket", "centre")).alias("one")).select(F.col("one.bucket").alias("same"), "one.centre"), "member-sets")
    every = members
    members = stored(every.join(sets, F.col("bucket") == F.col("same")).select("bucket", "node", "size", "centre"), "members")
    release(every, sets)
    wanted = stored(members.select(F.col("node").alias("_row")).distinct(), "wanted")
    linked = signed.select("_row", "_packed", "_bytes").join(wanted.where("_row >= 0"), "_row")
    linked = stored(linked.select(F.col("_row").alias("node"), F.col("_packed").alias("packed"), F.col("_bytes").alias("bytes")), "linked-texts", filtered=True)
    release(wanted)

    def verified(pairs: DataFrame) -> DataFrame:
        for x in "ab":
            pairs = pairs.join(linked.withColumnsRenamed({"node": x, "packed": f"packed_{x}", "bytes": f"bytes_{x}"}), x)
        return stored(pairs.mapInArrow(_verify(percent), "a bigint, b bigint"), "links")

    alike = (100 * F.col("size") >= percent * F.col("size2")) & (100 * F.col("size2") >= percent * F.col("size"))

    def mixed_buckets(members: DataFrame, found: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
        """Members of the buckets with several components, and a member of each one's largest component.

        Components only grow, so a bucket with one component is done: the next turn looks at the members returned here.
        """
        where = members.join(found, "node", "left").select("bucket", "node", "size", F.coalesce("component", "node").alias("part"))
        where = stored(where, "placed-members")
        mixed = where.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p != q").select(F.col("bucket").alias("same"))
        mixed = stored(mixed, "mixed")
        left = stored(where.join(mixed, F.col("bucket") == F.col("same")).drop("same"), "mixed-members")
        release(members, where, mixed)
        drawn = F.min(F.struct(F.xxhash64("node", "bucket", F.lit(turn)).alias("h"), "node", "size")).alias("drawn")
        parts = left.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"), drawn)
        centre = parts.groupBy(F.col("bucket").alias("same")).agg(F.max(F.struct("n", "part", "drawn")).alias("c"))
        columns = [F.col("c.part").alias("part2"), F.col("c.drawn.node").alias("node2"), F.col("c.drawn.size").alias("size2")]
        return left, stored(centre.select("same", *columns), "centres")

    def classed(df: DataFrame, asks: bool) -> DataFrame:
        """``df`` with the class of its size; rows that ask go to all classes of sizes that allow the similarity (a millionth more, for rounding)."""
        if percent >= 100:
            return df.withColumn("class", F.col("size"))
        place = F.log(F.col("size").cast("double")) / math.log(100 / percent)
        near = F.sequence(F.floor(place - 1 - 1e-6), F.floor(place + 1 + 1e-6))
        return df.withColumn("class", F.explode(near) if asks else F.floor(place))

    def n_blocks(df: DataFrame, group: list[str], name: str) -> DataFrame:
        return df.groupBy(*group).agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_WORDS)).alias(name))

    def in_blocks(own: DataFrame, others: DataFrame, among: str, several: DataFrame | None, compare, name: str) -> DataFrame:
        """The links that ``compare`` finds between the rows of both sides that have ``among`` in common and sizes that allow them."""
        group = [among, "class"]
        own, others = classed(own, True), classed(others, False)
        found = n_blocks(others, group, "blocks")
        blocks = n_blocks(own, group, "askers").join(found if several is None else found.join(several, among), group)
        blocks = stored(blocks, "blocks")
        asker, block = F.pmod(F.xxhash64("node"), "askers").alias("asker"), F.pmod(F.xxhash64("node"), "blocks").alias("block")
        part = [c for c in ("part",) if c in own.columns]
        own = own.join(blocks, group).select(*group, "node", *part, asker, F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
        others = others.join(blocks, group).select(*group, "node", *part, block, F.explode(F.expr("sequence(0L, askers - 1)")).alias("asker"))
        texts = lambda: linked.select("node", F.col("packed").alias("packed"), F.col("bytes").alias("bytes"))  # noqa: E731  columns of each side's own
        own, others = (x.join(texts(), "node").groupBy(*group, "block", "asker") for x in (own, others))
        links = stored(own.cogroup(others).applyInPandas(compare(percent), "a bigint, b bigint"), name)
        release(blocks)
        return links

    def within_buckets(still: DataFrame, right: DataFrame) -> DataFrame:
        """Links that join the components of ``still`` and ``right`` in each bucket; both have bucket, node, size and part."""
        several = right.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p != q").select("bucket")
        return in_blocks(still, right, "bucket", several, _joins_in_block, "bucket-links")

    def against_whole(asked: DataFrame, found: DataFrame) -> DataFrame:
        """A link, if there is one, between each node asked for and each block of the component ``whole``."""
        inside = nodes.select("node", "size").join(found, "node", "left")  # a node without links is a component of its own
        inside = inside.select("node", "size", F.coalesce("component", "node").alias("whole"))
        return in_blocks(asked, inside, "whole", None, _links_in_block, "block-links")

    tested = stored(members.where("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "first-pairs")
    links = verified(tested)
    for turn in range(STARS):
        found = components(links)
        members, centre = mixed_buckets(members, found, turn)
        across = (F.col("bucket") == F.col("same")) & (F.col("part") != F.col("part2")) & alike
        more = members.join(centre, across).select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()
        more = stored(more.join(tested, ["a", "b"], "left_anti"), "more-pairs")
        release(found, centre)
        tested = tested.union(more)
        links = links.union(verified(more))

    # what is still outside the largest component of a bucket meets all of that component, and the others outside, in blocks
    found = components(links)
    members, centre = mixed_buckets(members, found, STARS)
    outside = members.join(centre, F.col("bucket") == F.col("same")).where("part != part2")
    outside = stored(outside.select("bucket", "node", "size", "part", "part2"), "outside")
    links = links.union(against_whole(outside.select("node", "size", F.col("part2").alias("whole")).distinct(), found))
    release(found, centre)
    found = components(links)
    members, centre = mixed_buckets(members, found, STARS + 1)
    still = members.join(centre, F.col("bucket") == F.col("same")).where("part != part2").select("bucket", "node", "size", "part")
    right = outside.select("bucket", "node", "size").join(found, "node", "left").select("bucket", "node", "size", F.coalesce("component", "node").alias("part"))
    still, right = stored(still, "still-outside"), stored(right, "were-outside")
    release(found, centre, members, outside)
    links = links.union(within_buckets(still, right))
    release(tested, still, right, linked)
    found = components(links)
    release(links)

    first = F.min(F.struct("no", "id", "node")).alias("first")
    named = nodes.join(found, "node", "left").withColumn("part", F.coalesce("component", "node"))
    classes = stored(named.groupBy("part").agg(first).select("part", "first"), "classes")
    named = stored(named.join(classes, "part").select(F.col("bag").alias("_same"), F.col("first.id").alias("_named"), F.col("first.node").alias("_first")), "names")
    release(signed_nodes, found, classes)
    out = signed.join(named, F.col("_bag") == F.col("_same"), "left")
    alone = F.col("_same").isNull()
    keeper = alone | (F.col("_row") == F.col("_first"))
    name = F.when(alone, F.col("doc_id")).otherwise(F.col("_named")).alias("_class")
    return out.select("doc_id", name, keeper.alias("_keeper"), "_others", "_packed", "_bytes", "_given")


def unpacked(found: DataFrame, columns: list[str], schema) -> DataFrame:
    """Rows of ``near_duplicates`` with their texts again, in the columns of the documents."""

    def run(batches):
        for batch in batches:
            for part in sized_slices(batch, "_bytes"):
                texts = unpack_texts(column(part, "_packed"), column(part, "_bytes"))
                texts = pc.if_else(column(part, "_given"), texts, pa.scalar(None, pa.string()))
                given = column(part, "_others")
                yield pa.RecordBatch.from_arrays([texts if c == "text" else given.field(c) for c in columns], columns)

    return found.mapInArrow(run, schema)
