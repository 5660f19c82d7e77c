"""Ranked lexical search by NRA over a document-partitioned index.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased. Two passes over
stored tables: ``index_of`` finds, in every document, the terms that the queries use (hashes are looked up, then compared byte by byte) and
stores them with the document's length; ``search`` takes corpus statistics from that index and runs NRA in every task on the documents it holds:

* each query term has a list of documents by falling impact; lists are read from their heads in growing steps, never by document;
* a document's lower bound is what was seen of it, its upper bound adds the impact at the head of each list it was not seen in;
* documents whose upper bound is below the k-th best lower bound go; reading goes on until the bounds of all others meet, so that
  membership, ties and scores are exact. Scores that a task has found before are bounds for the next documents it takes.

A task returns ``k`` documents a query at most, and Spark merges them. Queries are taken in blocks of ``BLOCK_TERMS`` different terms (one longer
query alone), each block read with one broadcast of that size and searched over all documents. Memory in a task is bounded by ``SHARD_DOCS`` documents,
``SHARD_POSTINGS`` postings and ``CELLS`` pairs of term and document at a time.

Defined results: null and term-less texts are not documents and find nothing; each row is a document or a query of its own, also if
ids repeat; null ids stay null, and null ``doc_id`` comes last among equal scores; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rotaflow.llm.common import Words, buffer_of, column, release, same_spans, slices, span_hashes, stored

BLOCK_TERMS = 200_000  # different query terms that are broadcast at once
BLOCK_BYTES = 16 << 20  # bytes of these terms
SHARD_DOCS, SHARD_POSTINGS = 8192, 1 << 20
CELLS = 1 << 24  # pairs of a query's terms and documents held at once
FIRST_STEP = 32  # postings of each list read in the first step; each further step reads twice as many
NO_ID = np.iinfo(np.int64).max  # stands for a null doc_id: the last of equal scores

_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms_of(texts: pa.Array) -> Words:
    """Terms of a slice of texts, on the lower-cased bytes."""
    data, offsets = buffer_of(texts)
    data = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _TERM[data]
    opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    filled = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
    opens[heads], closes[tails] = inside[1:-1][heads], inside[1:-1][tails]
    start = np.flatnonzero(opens)
    return Words(data, offsets, start, np.flatnonzero(closes) + 1, np.searchsorted(start, offsets))


@dataclass
class Queries:
    """A block of queries: ids, the term numbers of each, and the terms' bytes ordered by hash."""

    number: list[int]
    item_id: list
    terms: list[np.ndarray]
    hashes: np.ndarray
    data: np.ndarray
    start: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, number: list[int], item_id: list, terms: list[set[bytes]]) -> Queries:
        every = sorted(set().union(*terms))
        length = np.array([len(t) for t in every], np.int64)
        data = np.frombuffer(b"".join(every), np.uint8)
        start = np.cumsum(length) - length
        hashes = span_hashes(data, start, start + length)
        order = np.argsort(hashes, kind="stable")
        place = {every[k]: n for n, k in enumerate(order.tolist())}
        own = [np.array(sorted(place[t] for t in ts), np.int64) for ts in terms]
        return cls(number, item_id, own, hashes[order], data, start[order], length[order])

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Words that are query terms, and the terms' numbers; terms of one hash are told apart by their bytes."""
        hashes = w.hashes()
        low, high = np.searchsorted(self.hashes, hashes, "left"), np.searchsorted(self.hashes, hashes, "right")
        n = high - low
        word = np.repeat(np.arange(len(hashes)), n)
        term = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        size = (w.end - w.start)[word]
        fits = np.flatnonzero(size == self.length[term])
        word, term = word[fits], term[fits]
        same = same_spans(w.data, w.start[word], self.length[term], self.data, self.start[term])
        return word[same], term[same]


def query_blocks(items: DataFrame) -> Iterator[Queries]:
    """The queries in blocks of a bounded number of terms; rows come to the driver one partition at a time."""
    number, ids, terms, every, size = [], [], [], set(), 0
    for k, row in enumerate(items.select("item_id", "text").toLocalIterator()):
        w = terms_of(pa.array([row["text"]], pa.string()))
        data = w.data.tobytes()
        own = {data[s:e] for s, e in zip(w.start.tolist(), w.end.tolist(), strict=True)}
        if not own:
            continue
        new = own - every
        if every and (len(every) + len(new) > BLOCK_TERMS or size + sum(map(len, new)) > BLOCK_BYTES):
            yield Queries.of(number, ids, terms)
            number, ids, terms, every, size, new = [], [], [], set(), 0, own
        number.append(k), ids.append(row["item_id"]), terms.append(own)
        every |= new
        size += sum(map(len, new))
    if number:
        yield Queries.of(number, ids, terms)


def _index(shared):
    def run(batches):
        queries = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                w = terms_of(column(part, "text"))
                n = np.diff(w.first)
                word, term = queries.find(w)
                doc = np.searchsorted(w.first, word, "right") - 1
                key, tf = np.unique(doc * np.int64(len(queries.hashes)) + term, return_counts=True)
                doc, term = key // max(1, len(queries.hashes)), key % max(1, len(queries.hashes))
                edge = np.searchsorted(doc, np.arange(len(n) + 1))
                lists = [pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(x, pa.int32())) for x in (term, tf)]
                found = pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])
                yield found.filter(pa.array(n > 0))

    return run


def index_of(docs: DataFrame, shared) -> DataFrame:
    """doc_id, n (terms), and the numbers and frequencies of the broadcast queries' terms of each document that has a term; stored."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(slim.mapInArrow(_index(shared), "doc_id long, n long, terms array<int>, tfs array<int>"), "lexical-index")


def _frequencies(size: int):
    """Per task: in how many documents each term occurs; -1 counts documents and -2 all terms."""

    def run(batches):
        df, docs, total = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            df += np.bincount(column(batch, "terms").flatten().to_numpy(), minlength=size)
            docs, total = docs + batch.num_rows, total + int(column(batch, "n").to_numpy().sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [docs, total]))], ["term", "df"])

    return run


@dataclass
class Corpus:
    """Numbers of documents and terms, and the weight of each query term."""

    docs: int
    terms: int
    weight: np.ndarray

    @classmethod
    def of(cls, index: DataFrame, size: int) -> Corpus:
        counted = index.select("n", "terms").mapInArrow(_frequencies(size), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        term, df = (counted.column(c).to_numpy() for c in ("term", "df"))
        found = dict(zip(term.tolist(), df.tolist(), strict=True))
        n = found.get(-1, 0)
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * found.get(t, 0) + 1))) for t in range(size)], np.int64)
        return cls(n, found.get(-2, 0), weight)

    def impacts(self, n: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Impact of ``tf`` occurrences in a document of ``n`` terms."""
        if len(n) and 90 * int(n.max()) * self.docs >= 1 << 63:  # beyond 64 bits: Python's integers
            n = n.astype(object)
        m = (100 - 90 + 90 * n * self.docs // self.terms).astype(np.int64)
        return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def nra(docs: list[np.ndarray], scores: list[np.ndarray], size: int, k: int, bound: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Documents (numbers below ``size``) that may be among the ``k`` best, with exact scores above 0; all of score ``bound`` or more that are.

    ``docs[t]`` and ``scores[t]`` are the list of term t by falling score. ``read`` is how far all lists have been read.
    """
    lists = len(docs)
    lower = np.zeros(size, np.int64)
    unseen = np.ones((lists, size), bool)
    active = np.arange(size)
    low, step = 0, FIRST_STEP
    while True:
        for t in range(lists):
            got = docs[t][low : low + step]
            if len(got):
                lower[got] += scores[t][low : low + step]
                unseen[t, got] = False
        low, step = low + step, 2 * step
        heads = np.array([s[low] if low < len(s) else 0 for s in scores], float)  # sums stay below 2**53
        own = lower[active]
        upper = own + (heads @ unseen[:, active]).astype(np.int64)
        least = max(1, bound)
        if len(own) > k:
            least = max(least, int(np.partition(own, len(own) - k)[len(own) - k]))
        stay = upper >= least
        active, own, upper = active[stay], own[stay], upper[stay]
        if not len(active) or (own == upper).all():
            return active, own


def _search(shared, corpus: Corpus, k: int):
    """Per task: the best documents of each query among all it was given."""

    def run(batches):
        queries, weight = shared.value, corpus.weight
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries.terms)  # score, doc_id
        most = max(map(len, queries.terms))
        for batch in batches:
            sizes = np.cumsum(np.diff(column(batch, "terms").offsets.to_numpy()))
            low = 0
            while low < batch.num_rows:
                before = int(sizes[low - 1]) if low else 0
                high = int(np.searchsorted(sizes, before + SHARD_POSTINGS, "right"))
                high = max(low + 1, min(high, low + SHARD_DOCS, low + CELLS // most))
                _search_shard(batch.slice(low, high - low), queries, corpus, weight, best, k)
                low = high
        found = [(number, score, doc_id) for number, (score, doc_id) in zip(queries.number, best, strict=True)]
        number = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
        score, doc_id = (np.concatenate([f[x] for f in found]) for x in (1, 2))
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(score), pa.array(doc_id, mask=doc_id == NO_ID)], ["number", "score", "doc_id"])

    return run


def _search_shard(shard: pa.RecordBatch, queries: Queries, corpus: Corpus, weight: np.ndarray, best: list, k: int) -> None:
    lists = column(shard, "terms")
    term, tf = lists.flatten().to_numpy(), column(shard, "tfs").flatten().to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(shard.num_rows), np.diff(lists.offsets.to_numpy()))
    ids = column(shard, "doc_id").fill_null(NO_ID).to_numpy()
    impact = corpus.impacts(column(shard, "n").to_numpy()[doc], tf)
    order = np.lexsort([-impact, term])
    doc, impact = doc[order], impact[order]
    edge = np.searchsorted(term[order], np.arange(len(weight) + 1))
    for q, own in enumerate(queries.terms):
        own = [t for t in own.tolist() if edge[t] < edge[t + 1] and weight[t] > 0]
        if not own:
            continue
        score, doc_id = best[q]
        bound = int(score[-1]) if len(score) >= k else 0
        spans = [slice(edge[t], edge[t + 1]) for t in own]
        if bound and sum(int(weight[t]) * int(impact[s.start]) for t, s in zip(own, spans, strict=True)) < bound:
            continue
        found, scores = nra([doc[s] for s in spans], [weight[t] * impact[s] for t, s in zip(own, spans, strict=True)], shard.num_rows, k, bound)
        score, doc_id = np.concatenate([score, scores]), np.concatenate([doc_id, ids[found]])
        keep = np.lexsort([doc_id, -score])[:k]
        best[q] = score[keep], doc_id[keep]


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``k`` best documents (score above 0) of each item, a query."""
    spark: SparkSession = docs.sparkSession
    kind = items.schema["item_id"].dataType
    shape = f"item_id {kind.simpleString()}, rank int, doc_id long, score long"
    out = None
    for queries in query_blocks(items):
        shared = spark.sparkContext.broadcast(queries)
        index = index_of(docs, shared)
        corpus = Corpus.of(index, len(queries.hashes))
        if not corpus.terms:
            release(index)
            continue
        found = index.mapInArrow(_search(shared, corpus, k), "number long, score long, doc_id long")
        by_score = Window.partitionBy("number").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(zip(queries.number, queries.item_id, strict=True)), f"of long, item_id {kind.simpleString()}")
        found = stored(found.join(F.broadcast(names), F.col("number") == F.col("of")).select("item_id", "rank", "doc_id", "score"), "lexical-found")
        release(index)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], shape)
