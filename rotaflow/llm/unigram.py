"""Token counts of a unigram vocabulary: a Viterbi search that keeps counts, not paths.

Aho-Corasick enumerates all vocabulary matches; at each place the search carries the best score of a
segmentation that ends there and its number of pieces. Rules of the exact tokenizer: scores are added in
double precision from left to right; of equal scores the one whose last piece is longest wins; a character
that is no piece scores the lowest score minus 10 and counts as its UTF-8 bytes (byte fallback).

Blanks become U+2581 and one is put in front. If no piece has U+2581 after another character, segmentations of
the parts between are independent; each different part is searched once and a bounded number is kept.

Null and empty texts have no tokens. Null and repeated ``doc_id`` are ordinary rows.
"""

from __future__ import annotations

import re
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame

from rotaflow.llm.common import column, slices
from rotaflow.llm.merge_bpe import MARK, NORMAL, read_model

UNKNOWN_PENALTY = 10.0  # a fixed value of the tokenizer
CACHED = 300_000


class UnigramCounter:
    """Counts for a list of pieces and scores."""

    _loaded: dict[str, UnigramCounter] = {}

    def __init__(self, pieces: dict[str, float], prefix: bool = True):
        import ahocorasick

        self.prefix = prefix
        self.trie = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.trie.add_word(piece, (len(piece), score))
        self.trie.make_automaton()
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        self.single = {p for p in pieces if len(p) == 1}
        whole = any(MARK in p.lstrip(MARK) for p in pieces)
        self.parts = (lambda t: [t]) if whole else re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        self.known: dict[str, int] = {}

    @classmethod
    def load(cls, path: str) -> UnigramCounter:
        """The pieces and scores of a model file, read as a unigram vocabulary."""
        if path not in cls._loaded:
            cls._loaded[path] = cls({p: s for p, s, kind in read_model(path)[0] if kind == NORMAL})
        return cls._loaded[path]

    def search(self, part: str) -> int:
        """Pieces of the best segmentation."""
        size = len(part)
        score, count = [0.0] + [-inf] * size, [0] * (size + 1)
        matches = self.trie.iter(part)
        end, match = next(matches, (size, None))
        for at in range(size):
            best, n = -inf, 0
            while end == at:  # longest first, so a shorter one must be better to win
                length, own = match
                start = at + 1 - length
                if (s := score[start] + own) > best:
                    best, n = s, count[start] + 1
                end, match = next(matches, (size, None))
            if part[at] not in self.single and (s := score[at] + self.unknown) > best:
                best, n = s, count[at] + len(part[at].encode())
            score[at + 1], count[at + 1] = best, n
        return count[size]

    def _part(self, part: str) -> int:
        n = self.search(part)
        if len(part) < 100:
            if len(self.known) >= CACHED:
                self.known.clear()
            self.known[part] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        known, part = self.known, self._part
        return sum([known.get(p) or part(p) for p in self.parts((MARK if self.prefix else "") + text.replace(" ", MARK))])


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and n_tokens of each whole text."""

    def run(batches):
        counter = UnigramCounter.load(model)
        for batch in batches:
            for part in slices(batch, "text"):
                counts = [counter.count(t or "") for t in column(part, "text").to_pylist()]
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint")
