"""SentencePiece encoding and decoding for merge-type models, without re-running all merges.

A text is normalised (blanks become U+2581, one is put in front) and cut where no piece of the
vocabulary reaches across: before a U+2581 that follows another character (only if no piece has one
inside) and around characters that are no piece. Each part is encoded by backtracking: the longest
vocabulary match is taken if it is compatible with the token before it, that is if merging the two
texts again gives just these two tokens; otherwise the next shorter match is tried, and a bitfield keeps
the positions from which no way leads on. A worker keeps the ids of a bounded number of parts.

Null texts count as empty; their ids are the end id alone. Null and repeated ``doc_id`` are ordinary rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from rotaflow.llm.common import column, slices

MARK = "▁"
CACHED = 400_000  # parts whose ids, and pairs whose compatibility, a Python worker keeps


def read_model(path: str) -> tuple[list[tuple[str, float, int]], dict[int, object], dict[int, object]]:
    """Pieces (text, score, type), trainer and normaliser fields of a model file (protocol buffer wire format)."""
    import struct

    def fields(raw: bytes):
        at = 0

        def number() -> int:
            nonlocal at
            value = shift = 0
            while True:
                byte = raw[at]
                at += 1
                value |= (byte & 127) << shift
                if byte < 128:
                    return value
                shift += 7

        while at < len(raw):
            tag = number()
            if tag & 7 == 0:
                yield tag >> 3, number()
                continue
            size = {1: 8, 5: 4}.get(tag & 7) or number()
            yield tag >> 3, raw[at : at + size]
            at += size

    pieces, trainer, normaliser = [], {}, {}
    with open(path, "rb") as file:
        model = file.read()
    for name, raw in fields(model):
        if name == 1:
            own = dict(fields(raw))
            pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, 1)))
        elif name in (2, 3):
            (trainer if name == 2 else normaliser).update(fields(raw))
    return pieces, trainer, normaliser


NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)  # piece types, fixed values of the format


class MergeBpe:
    """Encoder and decoder of one model file of the merge type with byte fallback and no rewriting of characters."""

    _loaded: dict[str, MergeBpe] = {}

    def __init__(self, path: str):
        import ahocorasick

        pieces, trainer, normaliser = read_model(path)
        if trainer.get(3, 1) != 2 or normaliser.get(2) or normaliser.get(4, 1) or any(t in (USER, UNUSED) for *_, t in pieces):
            raise ValueError(f"{path}: only merge-type models that keep all characters are supported")
        self.prefix = bool(normaliser.get(3, 1))
        self.unknown = next(n for n, p in enumerate(pieces) if p[2] == UNKNOWN)
        self.control = {n for n, p in enumerate(pieces) if p[2] == CONTROL}
        self.byte_ids = {int(p[0][1:-1], 16): n for n, p in enumerate(pieces) if p[2] == BYTE}
        self.id_byte = {n: b for b, n in self.byte_ids.items()}
        self.score = {p[0]: p[1] for p in pieces if p[2] == NORMAL}
        self.ids = {p[0]: n for n, p in enumerate(pieces) if p[2] == NORMAL}
        self.text = [p[0].replace(MARK, " ") for p in pieces]
        self.text[self.unknown] = " ⁇ "  # the surface of an unknown id, a fixed value of the format
        single = "".join(re.escape(c) for c in self.ids if len(c) == 1 and c != MARK)
        inside = any(MARK in p.lstrip(MARK) for p in self.ids)
        self.parts = re.compile(f"[{single}{MARK}]+|[^{single}{MARK}]" if inside else f"{MARK}+[{single}]*|[{single}]+|[^{single}{MARK}]").findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.piece = [p[0] for p in pieces]
        self.size = [len(p[0]) for p in pieces]
        self.trie = ahocorasick.Automaton()
        usable = {p: n for p, n in self.ids.items() if len(p) == 1 or self.merge(p) == [p]}  # merging reaches no others
        for piece, n in usable.items():
            self.trie.add_word(piece, n)
        self.trie.make_automaton()
        self.shorter = [-1] * len(pieces)  # the longest usable piece that a piece starts with
        for piece, n in usable.items():
            self.shorter[n] = next((usable[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in usable), -1)

    @classmethod
    def load(cls, path: str) -> MergeBpe:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def merge(self, text: str) -> list[str]:
        """The definition: join the adjacent pair with the highest score, the leftmost of equals, until none is left."""
        token, score = list(text), self.score
        after, before = list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap = [(-score[p], k, p) for k in range(len(text) - 1) if (p := text[k : k + 2]) in score]
        heapq.heapify(heap)
        while heap:
            _, k, p = heapq.heappop(heap)
            n = after[k]
            if token[k] is None or n >= len(token) or token[k] + token[n] != p:
                continue
            token[k], token[n], after[k] = p, None, after[n]
            if after[k] < len(token):
                before[after[k]] = k
                if (q := p + token[after[k]]) in score:
                    heapq.heappush(heap, (-score[q], k, q))
            if before[k] >= 0 and (q := token[before[k]] + p) in score:
                heapq.heappush(heap, (-score[q], before[k], q))
        return [t for t in token if t is not None]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined texts of two tokens gives these two tokens again."""
        texts = [self.piece[left], self.piece[right]]
        if len(self.pairs) >= CACHED:
            self.pairs.clear()
        found = self.pairs[left << 32 | right] = self.merge(texts[0] + texts[1]) == texts
        return found

    def backtrack(self, part: str) -> list[int]:
        """Ids of a part whose characters all are pieces."""
        longest, size, shorter, pairs = self.trie.iter_long, self.size, self.shorter, self.pairs
        stop = len(part)
        failed = bytearray((stop >> 3) + 1)  # a bit for each place from which no token leads on
        tokens: list[int] = []
        at = 0
        token = next(longest(part))[1]
        while True:
            while token >= 0:
                end = at + size[token]
                if not failed[end >> 3] >> (end & 7) & 1:
                    if not tokens:
                        break
                    fits = pairs.get(tokens[-1] << 32 | token)
                    if fits or fits is None and self.compatible(tokens[-1], token):
                        break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                if end == stop:
                    return tokens
                at = end
                token = next(longest(part, at))[1]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                token = tokens.pop()
                at -= size[token]
                token = shorter[token]

    def _part(self, part: str) -> tuple[int, ...]:
        if part[0] in self.ids:
            found = tuple(self.backtrack(part))
        else:
            found = tuple(self.byte_ids[b] for b in part.encode())
        if len(part) < 100:
            if len(self.known) >= CACHED:
                self.known.clear()
            self.known[part] = found
        return found

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        text = (MARK if self.prefix else "") + text.replace(" ", MARK)
        known, part = self.known, self._part
        return list(chain.from_iterable([known.get(p) or part(p) for p in self.parts(text)]))

    def decode(self, ids: list[int]) -> str:
        """Text of the ids: controls vanish, byte ids join to UTF-8 (each byte that fits nowhere becomes U+FFFD)."""
        text, id_byte, control = self.text, self.id_byte, self.control
        out, raw = [], bytearray()
        for n in ids:
            if n in id_byte:
                raw.append(id_byte[n])
                continue
            if raw:
                out.append(_utf8(raw))
                raw = bytearray()
            if n not in control:
                out.append(text[n])
        if raw:
            out.append(_utf8(raw))
        whole = "".join(out)
        return whole[1:] if self.prefix and whole[:1] == " " and self._starts_with_mark(ids) else whole

    def _starts_with_mark(self, ids: list[int]) -> bool:
        first = next((n for n in ids if n not in self.control), None)
        return first is not None and first not in self.id_byte and self.text[first][:1] == " " and first != self.unknown


def _utf8(raw: bytearray) -> str:
    """Bytes as text; every byte that is no part of a valid character becomes U+FFFD by itself."""
    try:
        return raw.decode()
    except UnicodeDecodeError as bad:
        return raw[: bad.start].decode() + "�" + _utf8(raw[bad.start + 1 :])


def encode(docs: DataFrame, model: str, end_id: bool = True, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids, decoded and the digests ids_sha256 and decoded_sha256 of each whole text.

    ``with_ids=False`` leaves ids and decoded out. The decoded text comes from decoding the ids.
    """

    def run(batches):
        bpe = MergeBpe.load(model)
        end = [next(n for n in sorted(bpe.control) if bpe.text[n] == "</s>")] if end_id else []
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [bpe.encode(t or "") + end for t in column(part, "text").to_pylist()]
                back = [bpe.decode(x) for x in ids]
                found = [column(part, "doc_id"), pa.array(list(map(len, ids)), pa.int64())]
                found += [pa.array([sha(" ".join(map(str, x))) for x in ids]), pa.array(list(map(sha, back)))]
                if with_ids:
                    found += [pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(found, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids)

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", ids array<int>, decoded string" if with_ids else ""
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}")
