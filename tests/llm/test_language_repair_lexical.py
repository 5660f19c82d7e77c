"""Language identification, conversation repair and lexical search against brute force, on small fixtures with awkward rows."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rotaflow.llm import language, lexical, repair
from rotaflow.llm.common import buffer_of
from rotaflow.session import tune


@pytest.fixture(scope="module", autouse=True)
def tuned(spark):
    tune(spark)


# ---------------------------------------------------------------- language identification


def grams(text: str | None) -> Counter:
    plain = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()))
    return Counter(plain[i : i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1) if plain[i : i + n] != " ")


def bucket_of(gram: str, buckets: int) -> int:
    (_, found), *_ = [x for x in language.ngrams(*buffer_of(pa.array([gram])), buckets)][len(gram) - 1 :]
    return found.tolist()[-1]


AWKWARD = [None, "", " 12 !? ", "a", "İstanbul ǅ ß Ω", "x\x00y", "日本語 text", "one two  three\nfour", "Ab" * 50]


def test_ngrams_are_those_of_each_text_alone():
    data, offsets = buffer_of(pa.array(AWKWARD))
    found = [Counter() for _ in AWKWARD]
    for doc, bucket in language.ngrams(data, offsets, 1 << 16):
        for d, b in zip(doc.tolist(), bucket.tolist(), strict=True):
            found[d][b] += 1
    for d, text in enumerate(AWKWARD):
        assert sum(found[d].values()) == sum(grams(text).values())
        alone = Counter(b for _, bucket in language.ngrams(*buffer_of(pa.array([text], pa.string())), 1 << 16) for b in bucket.tolist())
        assert found[d] == alone


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("ab é日 1,") for _ in range(5000))
    whole = Counter(b for _, bucket in language.ngrams(*buffer_of(pa.array([text])), 1 << 16) for b in bucket.tolist())
    for piece in (7, 64, 1000):
        monkeypatch.setattr(language, "PIECE", piece)
        parts = Counter(b for _, bucket in language.ngrams(*buffer_of(pa.array(["ab", text, "é"])), 1 << 16) for d, b in zip(_.tolist(), bucket.tolist(), strict=True) if d == 1)
        assert parts == whole


def labelled(n: int = 400):
    rng = random.Random(2)
    syllables = {"aa": ["the", "ing", "ow"], "bb": ["le", "que", "eau"], "cc": ["sch", "ung", "ei"]}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(syllables))
        words = ["".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 40))]
        rows.append((i, " ".join(words) + ".", lang if rng.random() > 0.05 else None, lang))
    return rows


def test_naive_bayes_equals_brute_force(spark):
    given = labelled() + [(1000 + i, t, None, None) for i, t in enumerate(AWKWARD)] + [(None, "the ing", "zz", None), (7, "ow ow", None, None)]
    docs = spark.createDataFrame([(i, t, g, "x", "y") for i, t, g, _ in given], "doc_id long, text string, lang string, score string, bucket string").repartition(4)
    rows = language.identify(docs).collect()
    assert len(rows) == len(given)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    counts, documents = {}, Counter()
    for i, text, lang, _ in given:
        if lang is not None and i is not None and not held(i):
            counts.setdefault(lang, Counter()).update(grams(text))
            documents[lang] += 1
    names = sorted(counts)
    assert names == ["aa", "bb", "cc"]
    model = language.train(docs, language.remainder() != 2)
    assert model.languages == names
    for gram in ("t", "th", "the", " l", "que"):
        own = bucket_of(gram, language.BUCKETS)
        for k, name in enumerate(names):
            collide = sum(n for g, n in counts[name].items() if bucket_of(g, language.BUCKETS) == own)
            want = math.log((collide + 0.5) / (sum(counts[name].values()) + 0.5 * language.BUCKETS))
            assert math.isclose(model.table[k, own], want, rel_tol=1e-12)
    by = {(r["doc_id"], r["lang_pred"]) for r in rows}
    truth = {i: true for i, _, _, true in given if true}
    right = sum((i, true) in by for i, true in truth.items() if held(i)) / sum(map(held, truth))
    assert right >= 0.97
    for r in rows:
        assert r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1
        if r["doc_id"] in (1000, 1001, 1002):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in names


def test_nothing_to_learn_and_many_languages(spark):
    docs = spark.createDataFrame([(1, "a b", None), (2, None, "xx")], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in language.identify(docs.where("doc_id = 1")).collect()} == {("und", 0.0)}
    assert language.identify(docs.where("doc_id = 0")).count() == 0
    assert language.buckets_for(4) == 1 << 16 and language.buckets_for(3000) * 3000 <= language.CELLS
    many = spark.createDataFrame([(i, f"w{i % 50} " * 3, f"l{i % 50}") for i in range(400)], "doc_id long, text string, lang string")
    model = language.train(many, F.lit(True), cells=50 * 256)
    assert model.table.shape == (50, 256)


# ---------------------------------------------------------------- conversation repair

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FULL = {"u": "user", "a": "assistant"}
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damage(rows):
    out, plain = [], lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{plain(conv)}:{plain(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else plain(role), "" if kind == 1 else re.sub("[.!?]", "", plain(text)) if kind == 2 else plain(text)
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """Uniform-cost search over (cost, audit)."""
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        filled = text.rstrip(BLANKS)
        faults.append("b" if not filled else "d" if (role, text) in seen else "t" if filled[-1] not in ".!?" else "")
        seen.add((role, text))
    initials, turns = [r[2][:1] for r in rows], [r[1] for r in rows if r[1] is not None]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
        if (i, state) in done:
            continue
        done.add((i, state))
        for c in "ua":
            if (state, c) in NEXT:
                heapq.heappush(heap, (cost + 2, audit + "I", i, NEXT[state, c], (*out, FULL[c] + ":")))
        if i < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if faults[i] in ("", "t"):
                (role, text), more = rows[i][2:], faults[i] == "t"
                if (state, initials[i]) in NEXT:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, NEXT[state, initials[i]], (*out, role + ":" + text)))
                for c in "ua":
                    if (state, c) in NEXT:
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, NEXT[state, c], (*out, FULL[c] + ":" + text)))


def repaired(rows):
    by = {r[0]: [] for r in rows}
    for r in damage(rows):
        by[r[0]].append(r)
    return {c: cheapest(v) for c, v in by.items()}


def conversations():
    rng = random.Random(1)
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "agent", "sys", "User"]
    said = ["Hi.", "a", "b!", "", None, "\t\n", "x? \n", "é", "日。", "ok.", "long text. " * 3]
    rows = [(c, rng.choice([t, t, t, None, t // 2, -t * 3]), rng.choice(roles), rng.choice(said)) for c in [*range(60), None] for t in range(rng.randint(0, 14))]
    return rows + [(99, 1, "user", "same.")] * 5 + [(99, 2, "assistant", "a.")] * 4 + [(98, None, "user", "no turn")]


SHAPE = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("parts", [3, 40])
def test_repair_equals_uniform_cost_search(spark, parts):
    """With 40 range partitions conversations lie in several of them, and their pieces are chained."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = conversations()
        rng = random.Random(8)
        rows += [(500, i, rng.choice(["user", "assistant", "system"]), rng.choice(["Hi.", "a", f"ok.{i}.", f"{i}", ""])) for i in range(600)]
        table = spark.createDataFrame([(*r, "x", 1) for r in rows], SHAPE + ", copies string, place int").repartition(5)
        found = repair.repair_damaged(table).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = repaired(rows)
    assert len(found) == len(want)
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in found} == want


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], SHAPE)
    assert repair.repair(none).count() == 0 and repair.repair_damaged(none).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    (row,) = repair.repair_damaged(spark.createDataFrame([(gone, 0, "user", "x")], SHAPE)).collect()
    assert tuple(row)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_walk_recomputes_from_checkpoints():
    rng, steps = random.Random(3), repair.Steps()
    for n in (1, 2, 5, 50, 333):
        codes = bytes(rng.choice([0, 1, 2, 3, 5, 6, 8]) for _ in range(n))
        vectors = [repair.LAST]
        for code in reversed(codes):
            vectors.append(steps.before(vectors[-1], code)[0])
        state, plain = 0, []
        for code in codes:
            plain.append(steps.edit(vectors[-2], code, state))
            state = plain[-1][1]
            vectors.pop()
        assert list(repair.walk(codes, repair.LAST, 0, steps)) == plain
    assert len({v for v, _ in steps.back}) < 100


# ---------------------------------------------------------------- lexical search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, total = len(counted), sum(n for *_, n in counted)
    df, out = Counter(t for _, c, _ in counted for t in c), []
    for item, text in items:
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(terms(text))}
        scores = [(-sum(w * (10**9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // total))) for t, w in weight.items() if t in c), i is None, i) for i, c, n in counted]
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:k])]
    return sorted(out, key=str)


DOCS = [(1, None), (2, ""), (3, "!!! ,,"), (4, "Hello wörld Ünï ABC123"), (4, "hello HELLO"), (None, "hello hello"), (5, "日本 語。 hello"), (6, "hello wörld"), (7, "hello wörld"), (8, "a\x00b\x7fc a")]
DOCS += [(10 + i, f"hello x{i} y " * 3) for i in range(40)] + [(60, "hello " * 3000 + "x1")]
ITEMS = [(1, "Hello WÖRLD hello"), (2, None), (3, "zzz"), (None, "b c 語"), (1, "x3 x4 y"), (9, "日本 語。")]


@pytest.mark.parametrize("block,shard,step", [(lexical.BLOCK_TERMS, 8192, 32), (3, 4, 1)])
def test_search_equals_all_scores(spark, monkeypatch, block, shard, step):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    monkeypatch.setattr(lexical, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical, "FIRST_STEP", step)
    docs = spark.createDataFrame([(*d, "x", 1.5) for d in DOCS], "doc_id long, text string, score string, n double").repartition(3)
    items = spark.createDataFrame([(*i, 3) for i in ITEMS], "item_id long, text string, rank int")
    assert sorted((tuple(r) for r in lexical.search(docs, items).collect()), key=str) == ranked(DOCS, ITEMS)
    assert lexical.search(docs.where("doc_id = 0"), items).count() == 0
    assert lexical.search(docs, items.where("item_id = 0")).count() == 0


def test_nra_reads_until_scores_are_exact():
    rng = np.random.default_rng(5)
    for _ in range(30):
        size, lists = 300, int(rng.integers(1, 6))
        impact = rng.integers(0, 6, (lists, size)) * (rng.random((lists, size)) < rng.random((lists, 1)))  # many ties
        order = [np.lexsort([np.arange(size), -x])[: np.count_nonzero(x)] for x in impact]
        total = impact.sum(axis=0)
        best = np.sort(total[total > 0])[::-1][:10]
        least = best[-1] if len(best) == 10 else 1
        found, score = lexical.nra(order, [impact[t][o] for t, o in enumerate(order)], size, 10)
        assert (score == total[found]).all() and set(np.flatnonzero(total >= max(1, least))) <= set(found.tolist())


def test_terms_of_one_hash_are_told_apart(monkeypatch):
    queries = lexical.Queries.of([0], [0], [{b"ab", b"abc", b"xyz"}])
    queries.hashes[:] = 7
    w = lexical.terms_of(pa.array(["ab xyz abd abc"]))
    monkeypatch.setattr(type(w), "hashes", lambda self: np.full(len(self.start), 7, np.uint64))
    word, term = queries.find(w)
    data = queries.data.tobytes()
    assert [(k, data[queries.start[t] : queries.start[t] + queries.length[t]]) for k, t in zip(word.tolist(), term.tolist(), strict=True)] == [(0, b"ab"), (1, b"xyz"), (3, b"abc")]
