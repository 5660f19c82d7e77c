"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, what is not a letter becomes one blank (also before and behind the text), and the runs of one to ``ORDER`` characters are
hashed into buckets. Training counts buckets per language over all labelled documents: each task keeps one matrix of counts and the sums
of all tasks are added by Spark. The matrix of log-probabilities (languages x buckets) is broadcast; ``cells`` bounds its size, since many
languages get fewer buckets each. A batch of texts is scored sparsely: log-probabilities of its n-grams are gathered and summed per text.

Long texts are handled in pieces of ``PIECE`` bytes, so memory does not grow with them. Defined results:

* null texts and texts without a letter, and all texts if nothing could be learned: ``und`` with score 0;
* ties between languages: the smallest name; ``score`` is the posterior probability of the language given;
* a null ``lang`` teaches nothing; repeated rows teach as often as they occur and are each predicted;
* a null ``doc_id`` has no remainder: its row is neither learned from nor held out;
* an empty table gives no rows; other columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotaflow.llm.common import buffer_of, column, mix, slices

ORDER = 3  # longest n-gram
BUCKETS = 1 << 16  # hash buckets, if the number of languages allows it
CELLS = 1 << 23  # languages x buckets at most: 64 MB as doubles
PIECE = 1 << 20  # bytes of one text handled at once
SMOOTHING = 0.5  # added to each count
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Is this code point a letter; made once per process."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def buckets_for(languages: int, cells: int = CELLS) -> int:
    """The largest power of two, ``BUCKETS`` at most, that keeps the matrix within ``cells``."""
    return min(BUCKETS, 1 << max(0, (cells // max(1, languages)).bit_length() - 1))


def _code_points(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points and the text of each, in pieces: several short texts together, or a part of a long one."""
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + PIECE, "right")) - 1)
        if offsets[high] - offsets[low] <= PIECE:
            each = [_code_points(data[offsets[d] : offsets[d + 1]].tobytes()) for d in range(low, high)]
            yield np.concatenate(each), np.repeat(np.arange(low, high), [len(x) for x in each])
        else:
            at, end = int(offsets[low]), int(offsets[low + 1])
            while at < end:
                stop = min(end, at + PIECE)
                while stop < end and data[stop] & 0xC0 == 0x80:  # not within a character
                    stop -= 1
                points = _code_points(data[at:stop].tobytes())
                yield points, np.full(len(points), low)
                at = stop
        low = high


def ngrams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text and bucket of all n-grams of a slice of texts, piece by piece; texts without a letter have none."""
    letter = _letter_table()
    tail, tail_doc = np.zeros(0, np.uint32), -1  # last characters of an unfinished text
    for points, doc in _pieces(data, offsets):
        if not len(points):
            continue
        points = np.where(letter[points], points, np.uint32(32))
        carried = len(tail) if doc[0] == tail_doc else 0
        if carried:
            points, doc = np.concatenate([tail, points]), np.concatenate([np.full(carried, tail_doc), doc])
        heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        if carried:
            heads = heads[1:]
        points, doc = np.insert(points, heads, 32), np.insert(doc, heads, doc[heads])  # each text begins with a blank
        keep = np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32) | (doc[1:] != doc[:-1])])
        keep[:carried] = True  # these were kept before
        points, doc = points[keep], doc[keep]
        value = points.astype(np.uint64)
        key = np.zeros(len(points), np.uint64)
        for n in range(1, ORDER + 1):
            if len(points) < n:
                break
            key = key[: len(points) - n + 1] * np.uint64(0x110001) + value[n - 1 :]
            whole = doc[n - 1 :] == doc[: len(doc) - n + 1]
            if n == 1:
                whole &= points != 32  # a blank alone says nothing
            if carried:
                whole[: max(0, carried - n + 1)] = False  # counted with the piece before
            yield doc[n - 1 :][whole], (mix(key[whole] + np.uint64(n << 32)) >> np.uint64(40)).astype(np.int64) & (buckets - 1)
        tail_doc = int(doc[-1])
        own = points[doc == tail_doc] if doc[0] != tail_doc else points
        tail = own[-(ORDER - 1) :]


@dataclass
class NaiveBayes:
    """``languages`` in ascending order, the log-probabilities of their buckets, and their log-priors."""

    languages: list[str]
    table: np.ndarray
    prior: np.ndarray

    @classmethod
    def of(cls, languages: list[str], counts: np.ndarray, documents: np.ndarray) -> NaiveBayes:
        smooth = counts + SMOOTHING
        return cls(languages, np.log(smooth / smooth.sum(axis=1, keepdims=True)), np.log(documents / documents.sum()))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and posterior probability of each text."""
        n, k = len(texts), len(self.languages)
        data, offsets = buffer_of(texts)
        total, seen = np.tile(self.prior, (n, 1)), np.zeros(n, bool)
        if not k:
            return [UNKNOWN] * n, np.zeros(n)
        for doc, bucket in ngrams(data, offsets, self.table.shape[1]):
            if not len(doc):
                continue
            begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            seen[doc[begin]] = True
            for j in range(k):
                total[doc[begin], j] += np.add.reduceat(self.table[j][bucket], begin)
        best = total.argmax(axis=1)  # the first of equal ones
        posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), seen.tolist(), strict=True)], np.where(seen, posterior, 0.0)


def _counts(buckets: int):
    """Per task: how often each language has each bucket, and at -1 its number of documents."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                names, own = np.unique(column(part, "lang").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
                for name in names.tolist():
                    sums.setdefault(name, np.zeros(buckets + 1, np.int64))
                for j, name in enumerate(names.tolist()):
                    sums[name][buckets] += np.count_nonzero(own == j)
                for doc, bucket in ngrams(*buffer_of(column(part, "text")), buckets):
                    language = own[doc]
                    for j, name in enumerate(names.tolist()):
                        sums[name][:buckets] += np.bincount(bucket[language == j], minlength=buckets)
        for name, own in sums.items():
            at = np.flatnonzero(own)
            for low in range(0, len(at), 8192):
                some = at[low : low + 8192]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(np.where(some == buckets, -1, some)), pa.array(own[some])], ["lang", "bucket", "n"])

    return run


def train(docs: DataFrame, learn: Column, cells: int = CELLS) -> NaiveBayes:
    """The model of all rows of ``docs`` (text, lang) that ``learn`` holds for and that have a language.

    Two passes: the names of the languages, then the counts. ``cells`` numbers at most reach the driver.
    """
    known = docs.where(learn & F.col("lang").isNotNull()).select("text", "lang")
    n = known.agg(F.countDistinct("lang")).first()[0]
    if not n:
        return NaiveBayes([], np.zeros((0, 1)), np.zeros(0))
    if n > cells:
        raise ValueError(f"{n} languages do not fit into a matrix of {cells} cells")
    buckets = buckets_for(n, cells)
    counted = known.mapInArrow(_counts(buckets), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages, row = np.unique(counted.column("lang").to_numpy().astype(str), return_inverse=True)
    bucket, number = counted.column("bucket").to_numpy(), counted.column("n").to_numpy()
    table, documents = np.zeros((len(languages), buckets)), np.zeros(len(languages))
    whole = bucket < 0
    documents[row[whole]] = number[whole]
    table[row[~whole], bucket[~whole]] = number[~whole]
    return NaiveBayes.of(languages.tolist(), table, documents)


def predict(docs: DataFrame, model: NaiveBayes, id_column: str = "doc_id") -> DataFrame:
    """id_column, lang_pred and score of each row of ``docs``; only that column and the text are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                languages, score = own.predict(column(part, "text"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(languages, pa.string()), pa.array(score)], [part.schema.names[0], "lang_pred", "score"])

    slim = docs.select(id_column, "text")
    shape = slim.select(id_column).schema.add("lang_pred", "string").add("score", "double")
    return slim.mapInArrow(run, shape)


def remainder(doc_id: str = "doc_id", parts: int = 4) -> Column:
    """The part of the split that a document belongs to; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def identify(docs: DataFrame, held_out: int = 2, parts: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred and score of all documents; those held out teach nothing."""
    model = train(docs, remainder(parts=parts) != held_out)
    apart = F.coalesce(remainder(parts=parts) == held_out, F.lit(False))
    return predict(docs, model).withColumn("held_out", apart).select("doc_id", "held_out", "lang_pred", "score")

