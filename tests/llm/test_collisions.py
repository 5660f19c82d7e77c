"""Texts that polynomial hashes modulo a power of two cannot tell apart (a Thue-Morse word and its complement)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from rotaflow.llm import common, minhash, quality, substring

ONE = "a"
while len(ONE) < 1024:
    ONE += ONE.translate(str.maketrans("ab", "ba"))
OTHER = ONE.translate(str.maketrans("ab", "ba"))


def test_words_differ():
    w = common.words_of(pa.array([f"{ONE} {OTHER}", *["".join(x) for x in ("a" * 9, "a" * 17, "\0", "\0\0", "b" * 8)]]))
    assert len(set(w.hashes().tolist())) == len(w.start)
    data = np.frombuffer((ONE + OTHER + ONE).encode(), np.uint8)
    at = np.array([0, 0, 5]), np.array([1024, 1024, 20])
    assert common.same_spans(data, at[0], at[1], data, np.array([1024, 2048, 2053])).tolist() == [False, True, True]


def test_lines_and_runs_of_words_differ():
    text = "\n".join([ONE, OTHER]) + "\n" + " ".join(f"{w} b c d e" for w in (ONE, OTHER))
    s = quality.statistics(pa.array([text]))
    assert (s["n_dup_lines"][0], s["n_repeat_words"][0]) == (0, 0)


def test_documents_keep_their_words(spark):
    texts = [" ".join([w, *[f"w{i}" for i in range(12)], w, *[f"v{i}" for i in range(17)]]) for w in (ONE, OTHER)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in substring.deduplicate(docs).collect():
        assert (r["n_removed"], r["kept_sha256"]) == (0, hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())
    texts = [" ".join([w] * 30) for w in (ONE, OTHER)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["_class"] for r in minhash.near_duplicates(docs).collect()} == {0, 1}
