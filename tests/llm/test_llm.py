"""The training-data operators against brute force, on small fixtures with awkward rows."""

from __future__ import annotations

import hashlib
import io
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from rotaflow.llm import ann, chat, common, components, fm_index, merge_bpe, minhash, packing, quality, sharding, substring, unigram, warc
from rotaflow.session import fresh_path, tune

WORD = re.compile("[^\\x20\\x09-\\x0D]+")
MODEL, BYTES = common.tokenizer("piece_bpe_32k.model"), common.tokenizer("byte_bpe_50k.json")


def texts(n: int = 60, seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    out: list[str | None] = [None, "", " \n\t", "one", "x " * 700, "a#$ b\nsame line\nsame line\n\nA<|endoftext|>b", "日本語 😀 \x00\x1f ½²"]
    while len(out) < n:
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 120, 900]))]
        kind = rng.random()
        if kind < 0.2:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        text = rng.choice([" ", " ", "\n"]).join(words)
        out.append(text)
        if kind > 0.7:
            copy = text.split()
            copy[rng.randrange(len(copy))] = "edited"
            out.append(rng.choice([text, " ".join(copy)]))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    tune(spark)
    rows = [(i, t, "src") for i, t in enumerate(texts())] + [(None, "a null id " * 20, None), (5, "repeated id", "x"), (5, "repeated id", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, size string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id = -1")


def words(text):
    return WORD.findall(text or "")


def test_words_and_hashes_are_those_of_each_text_alone():
    column = pa.array(texts())
    w = common.words_of(column)
    data = w.data.tobytes()
    found = [[data[w.start[k] : w.end[k]].decode() for k in range(w.first[d], w.first[d + 1])] for d in range(len(column))]
    assert found == [words(t) for t in texts()]
    alone = np.concatenate([common.words_of(column.slice(d, 1)).hashes() for d in range(len(column))])
    assert (alone == w.hashes()).all()


def test_quality_counts(docs, empty):
    rows = quality.judge(docs, None).select("doc_id", "text", "size", "quality.*").collect()
    assert len(rows) == docs.count() and quality.judge(empty, None).count() == 0
    for r in rows:
        ws = words(r["text"])
        lines = [x for x in (r["text"] or "").split("\n") if words(x)]
        runs = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
        again = {j for i in range(len(ws) - 4) if runs[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
        want = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", r["text"] or "")), len(lines) - len(set(lines)), len(again))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (len(ws) < 10 or 100 * len(again) > 20 * len(ws)) and r["kept"] == (not r["base_failed"])


def test_trees_learn_and_are_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] < 0.5) & (x[:, 1] + 0.2 * rng.random(2000) < 0.8)).astype(float)
    trees = quality.fit_trees(x[:1500], y[:1500], falling=[0, 1])
    assert ((trees.score(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.95
    grid = np.tile(rng.random((50, 1, 3)), (1, 40, 1))
    for f in (0, 1):
        line = grid.copy()
        line[:, :, f] = np.linspace(0, 1, 40)
        assert (np.diff(trees.score(line.reshape(-1, 3)).reshape(50, 40), axis=1) <= 1e-9).all()


def test_sharding_keeps_rows_groups_and_balance(docs, empty):
    rows = sharding.shard(docs, 4).collect()
    assert len(rows) == docs.count() and sharding.shard(empty, 4).count() == 0
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    by = {r["doc_id"]: r for r in rows}
    for i, t in enumerate(texts()):
        if i != 5:
            raw = (t or "").encode()
            assert (by[i]["size"], by[i]["text_crc32"], by[i]["tokens"]) == (len(raw) + 1, zlib.crc32(raw), len(words(t)))
    load = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(4)]
    assert max(load) - min(load) <= 0.1 * sum(load)


def test_sharding_keeps_copies_that_fit_together(spark):
    """40 pairs, a group of 12 and one of 50 in 200 rows: 4 shards hold 50 rows each."""
    texts = [f"pair {i // 2:03d}" for i in range(80)] + ["twelve ."] * 12 + ["fifty  ."] * 50 + [f"lone {i:03d}" for i in range(58)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    for shards, parts in ((4, 1), (8, 2)):  # 8 shards hold 25 rows each
        at: dict[str, Counter] = {}
        for r in sharding.shard(table, shards).collect():
            at.setdefault(texts[r["doc_id"]], Counter())[r["shard"]] += 1
        assert all(len(s) == 1 for t, s in at.items() if t != "fifty  .")
        assert sorted(at["fifty  ."].values()) == [50 // parts] * parts
        load = sum(at.values(), Counter())
        assert sum(load.values()) == 200 and max(load.values()) - min(load.values()) <= 4


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    rows = packing.pack(packing.pieces(docs, BYTES, 64), 64).collect()
    assert packing.pack(packing.pieces(empty, BYTES, 64), 64).count() == 0
    exact, full = Tokenizer.from_file(BYTES), {}
    for i, t in enumerate(texts()):
        full[i] = exact.encode(t or "", add_special_tokens=False).ids + [2]
    for i, ids in full.items():
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        if i == 5:
            continue  # a repeated id
        assert sum(r["length"] for r in own) == len(ids) and all(r["length"] == 64 for r in own[1:])
        for r in own:
            raw = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(raw)
    for q in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == q), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    plain: list[int] = []  # best fit piece by piece needs as many sequences
    for n in sorted((r["length"] for r in rows), reverse=True):
        fit = min((k for k in range(len(plain)) if plain[k] >= n), key=lambda k: plain[k], default=None)
        if fit is None:
            plain.append(64 - n)
        else:
            plain[fit] -= n
    assert len({r["sequence_id"] for r in rows}) == len(plain)


def test_merge_encoding_equals_the_library(docs):
    import sentencepiece

    exact = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    once = docs.select("doc_id", "text").where("doc_id IS DISTINCT FROM 5")
    for r in merge_bpe.encode(once, MODEL).join(once, "doc_id").collect():
        ids = exact.encode(r["text"] or "") + [2]
        assert r["ids"] == ids and r["decoded"] == exact.decode(ids) and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    own, rng = merge_bpe.MergeBpe.load(MODEL), random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("abetin ▁=-\n日é") for _ in range(rng.randint(0, 40)))
        ids = [rng.choice([rng.randrange(32000), rng.randrange(300), 2]) for _ in range(6)]
        assert own.encode(text) == exact.encode(text) and own.decode(ids) == exact.decode(ids)


def test_unigram_counts_equal_the_library(docs):
    from tokenizers import Tokenizer, models

    pieces = [(p, s) for p, s, kind in merge_bpe.read_model(MODEL)[0] if kind in (merge_bpe.NORMAL, merge_bpe.BYTE)]
    low = min(s for p, s in pieces if not p.startswith("<0x"))
    vocabulary = [("<unk>", low)] + [(p, s if not p.startswith("<0x") else 0.0) for p, s in pieces if p != "<unk>"]
    vocabulary = [("<unk>", low)] + [(p, low - 1000.0 if p.startswith("<0x") else s) for p, s in vocabulary[1:]]
    counter = unigram.UnigramCounter({p: s for p, s in vocabulary[1:]})
    exact = Tokenizer(models.Unigram(vocabulary, 0, True))
    for t in texts():
        if t:
            assert counter.count(t) == len(exact.encode("▁" + t.replace(" ", "▁")).ids)
    rows = unigram.token_counts(docs, MODEL).collect()
    assert len(rows) == docs.count() and {r["n_tokens"] for r in rows if r["doc_id"] in (0, 1)} == {0}


def test_warc_ranges_find_each_record_once(spark):
    body = random.Random(5).randbytes(40_000).hex()
    rows = [(1, "http://a b\n", body), (2, "u", body), (3, None, None), (None, "n", "x" * 200), (4, "v", "x" * 200), (5, "w", "short"), (6, "w", "short")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    path = fresh_path(spark, "archives")
    warc.write_archives(warc.plan_records(pages), path)
    for size in (700, 1 << 20):
        found = warc.pages_of(warc.read_archives(spark, path, size)).collect()
        got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found}
        sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
        assert len(found) == len(rows)
        for i, _, html in rows:
            kind = ("revisit", {2: 1, None: 4}[i]) if i in (2, None) else ("response", None)
            assert got[i] == (len(html or ""), sha(html), *kind)
    none = fresh_path(spark, "archives")
    warc.write_archives(warc.plan_records(pages.where("page_id = 0")), none)
    assert warc.read_archives(spark, none).count() == 0
    member = warc._record(1, "u", b"y" * 500, "d", "response", None)
    nested = warc._record(2, "u", member * 2, "d", "response", None)
    raw = nested + member
    owned = [x for s in range(0, len(raw), 97) for x in warc.owned_records(io.BytesIO(raw), len(raw), s, s + 97)]
    assert [x[0] for x in owned][:1] == [0] and owned[-1][0] == len(nested)


def test_chat_keeps_maximal_conversations(spark):
    a, b, c = ("user", "hi"), ("assistant", "yo"), ("user", None)
    logs = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [b], None: [a, c]}
    rows = [(k, 10 * n, *t) for k, ts in logs.items() for n, t in enumerate(ts)] + [(3, 0, *a)]
    found = chat.render(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert {r["conv_id"] for r in found} == {3, 5, None}
    for k in (3, 5, None):
        own = sorted((r for r in found if r["conv_id"] == k), key=lambda r: r["position"])
        assert "".join(r["piece"] for r in own) == "".join(f"<|im_start|>{role}\n{text or ''}<|im_end|>\n" for role, text in logs[k])
        assert [r["place"] for r in own] == [sum(len(x["piece"]) for x in own[:i]) for i in range(len(own))]


@pytest.mark.parametrize("parts", [2, 30])
def test_chat_of_awkward_rows(spark, parts):
    """Null turns, several turns of one number, and columns with inner names; blocks of a few rows or of all."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    rng, rows = random.Random(7), []
    for conv in (1, 2, None):
        rows += [(conv, rng.choice([None, 0, 5, 5, 7000 * i]), rng.choice(["user", None]), f"t{rng.randrange(40)}") for i in range(50)]
    rows += [(9, *r[1:]) for r in rows if r[0] == 1] + rows[:3]
    want = {}
    for c in (1, 2, 9, None):
        own = {(t is not None, t or 0, role or "", text or "") for conv, t, role, text in rows if conv == c}
        want[c] = [(role, text) for *_, role, text in sorted(own)]
    for k, v in (("spark.sql.shuffle.partitions", parts), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(k, v)
    try:
        table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id bigint, turn bigint, role string, text string, block string, one int, h1 int")
        found = chat.render(table).collect()
        assert chat.render(table.where("conv_id = -1")).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["conv_id"] for r in found} == {1, 2, None}  # 9 equals 1
    for c in (1, 2, None):
        own = sorted((r for r in found if r["conv_id"] == c), key=lambda r: r["position"])
        assert [r["piece"] for r in own] == [f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in want[c]]
        assert [r["place"] for r in own] == [sum(len(x["piece"]) for x in own[:i]) for i in range(len(own))]


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    vectors = [v.tolist() for v in rng.normal(size=(400, 8)).astype("float32")]
    vectors[10:40] = [vectors[10]] * 30
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0]), (None, vectors[0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    from pyspark.sql import functions as F

    found = ann.neighbours(table, F.col("vec_id") % 10 == 0, 5).collect()
    x, hits = np.array(vectors, float), 0
    for q in range(0, 400, 10):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort([np.arange(400), d])[:5].tolist()
        got = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["score"] for r in got] == d[[r["vec_id"] for r in got]].tolist()
        hits += len(set(want) & {r["vec_id"] for r in got})
    assert hits >= 0.9 * 200
    assert ann.neighbours(table.where("vec_id > 999"), F.col("vec_id") % 10 == 0, 5).count() <= 1


def test_recall_with_a_part_of_the_lists_visited(spark):
    """Vectors without clusters, the hardest case: a part of 400 lists is visited, and the share of points compared is below one."""
    from pyspark.sql import functions as F

    x = np.random.default_rng(6).normal(size=(20_000, 32))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype("float32").astype(float)
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>, list string, point int").repartition(8)
    found, hits = ann.neighbours(table, F.col("vec_id") % 200 == 0, 10).collect(), 0
    for q in range(0, 20_000, 200):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & {r["vec_id"] for r in found if r["query_id"] == q})
    assert ann.probes_of(400) < 80 and hits >= 0.9 * 1_000


def test_probes_grow_slower_than_lists():
    shares = [ann.probes_of(n) / n for n in (256, 1024, 4096, 16_384, 65_536)]
    assert all(b < 0.7 * a for a, b in zip(shares, shares[1:], strict=False)) and ann.probes_of(10) == 10
    assert ann.most_lists(64) == ann.SAMPLE and ann.most_lists(4096) * 4096 * 8 <= ann.GRAPH_BYTES


def test_the_graph_finds_the_nearest_centroids():
    rng = np.random.default_rng(3)
    graph = ann.CentroidGraph.fit(rng.normal(size=(8_000, 16)), 2_000)
    x = rng.normal(size=(300, 16))
    exact = ann._squares(x, graph.centroids)
    for k in (4, 100):
        ids, squares = graph.search(x, k)
        assert np.allclose(squares, np.take_along_axis(exact, ids, axis=1)) and (np.diff(squares, axis=1) >= 0).all()
        assert all(len(set(r)) == k for r in ids.tolist())
        right = [len(set(a) & set(b)) for a, b in zip(ids.tolist(), exact.argsort(axis=1)[:, :k].tolist(), strict=True)]
        assert sum(right) >= 0.9 * k * len(x)
    few = ann.CentroidGraph.fit(rng.normal(size=(5, 16)), 3)
    assert np.isfinite(few.search(x, 3)[1]).all()


def test_neighbours_of_nothing_and_of_copies(spark):
    from pyspark.sql import functions as F

    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(0, [1.0, 0.0]), (100, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = sorted(tuple(r) for r in ann.neighbours(table, F.col("vec_id") % 100 == 0, 3).collect())
    assert found[:3] == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 3, 0.0)] and [r[2] for r in found[3:]] == [0, 1, 2]
    assert ann.neighbours(table.where("vec_id = -1"), F.col("vec_id") % 100 == 0, 3).count() == 0
    nulls = table.withColumn("embedding", F.lit(None).cast("array<double>"))
    assert ann.neighbours(nulls, F.col("vec_id") % 100 == 0, 3).count() == 0


def similarity(x, y):
    a, b = (Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter() for w in (x, y))
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0


def test_near_duplicates(docs, empty):
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count() and minhash.near_duplicates(empty).count() == 0
    given = [(r["doc_id"], words(r["text"])) for r in docs.collect()]
    parent = list(range(len(given)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(given)):
        for j in range(i):
            if given[i][1] and similarity(given[i][1], given[j][1]) >= 0.8:
                parent[root(i)] = root(j)
    for i, (own, _) in enumerate(given):
        ids = [given[j][0] for j in range(len(given)) if root(j) == root(i) and given[j][0] is not None]
        assert (min(ids) if ids else None) in {r["_class"] for r in rows if r["doc_id"] == own}
    assert sum(r["_keeper"] for r in rows) == len({root(i) for i in range(len(given))})


def test_a_single_node_is_met_as_a_component(spark, monkeypatch):
    """The last two texts are alike (0.8), the others not (0.79 at most) though they share their buckets, where the last node is the one chosen."""
    monkeypatch.setattr(minhash, "STARS", 0)
    spots, rows = iter(range(7, 899, 5)), []  # each edit changes 5 shingles of its own
    for k, edits in enumerate([11] * 14 + [10] * 2):
        text = [f"w{i}" for i in range(904)]
        for _ in range(edits):
            text[next(spots)] = f"edit{k}"
        rows.append(text)
    assert [(i, j) for i in range(16) for j in range(i) if similarity(rows[i], rows[j]) >= 0.8] == [(15, 14)]
    table = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(rows)], "doc_id bigint, text string")
    found = {r["doc_id"]: r["_class"] for r in minhash.near_duplicates(table).collect()}
    assert found == {i: min(i, 14) for i in range(16)}


def test_signatures_estimate_weighted_jaccard():
    key = np.arange(1, 201, dtype=np.uint64)
    a, b = np.random.default_rng(1).integers(1, 30, 200), np.random.default_rng(2).integers(1, 30, 200)
    doc = np.repeat([0, 1], 200)
    names = minhash.signatures(doc, np.concatenate([key, key]), np.concatenate([a, b]), 2, 4000)
    assert abs((names[0] == names[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_first_links_and_components(spark):
    own, others = ["a b c d e f g h i j", "z"], ["q r s t u v", "a b c d e f g h i j", "z"]
    assert minhash.first_links(pa.array(own), pa.array(others), 80) == [1, 2]
    edges = [(i, i + 1) for i in range(30)] + [(100, 101 + i) for i in range(20)]
    found = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {(r["node"], r["component"]) for r in found} == {(i, 0) for i in range(31)} | {(100 + i, 100) for i in range(21)}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_joining_links_connect_what_all_links_connect():
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[k : k + 40]) for k in (0, 0, 1, 2, 3, 20, 20, 4)] + ["", "alone"]
    n = len(texts)
    every = [(i, int(j)) for i, near in enumerate(minhash._similar(pa.array(texts), pa.array(texts), 80)) for j in near]
    few = minhash.joining_links(pa.array(texts), pa.array(texts), np.arange(n), np.arange(n), 80)

    def classes(links):
        part = list(range(n))
        for a, b in links:
            part = [part[a] if p == part[b] else p for p in part]
        return [[p == q for q in part] for p in part]

    assert classes(few) == classes(every) and len(few) < n
    assert minhash.joining_links(pa.array(texts), pa.array(texts), np.zeros(n, int), np.zeros(n, int), 80) == []


def test_fm_index_matching_statistics():
    rng = random.Random(4)
    base = [" ".join(rng.choice("abc") for _ in range(rng.randint(4, 40))) for _ in range(12)]
    index = fm_index.FmIndex(base, 4)
    known = {tuple(t.split()[i : i + 4]) for t in base for i in range(len(t.split()) - 3)}
    for _ in range(30):
        pattern = [rng.choice("abcx") for _ in range(30)]
        ids = np.array([index.names.get_loc(w) + 1 if w in index.names else 0 for w in pattern])
        (length, group), = index.matches([ids])
        assert [g >= 0 for g in group] == [tuple(pattern[i : i + 4]) in known for i in range(30)]
        assert all((n >= 4) == (g >= 0) for n, g in zip(length, group, strict=True))


@pytest.mark.parametrize("hot_words", [substring.HOT_WORDS, 50])
def test_substring_removes_later_windows(docs, empty, monkeypatch, hot_words):
    monkeypatch.setattr(substring, "HOT_WORDS", hot_words)
    rows = substring.deduplicate(docs).collect()
    assert len(rows) == docs.count() and substring.deduplicate(empty).count() == 0
    first: dict[tuple, tuple] = {}
    given = {r["doc_id"]: words(r["text"]) for r in docs.collect() if r["doc_id"] != 5}
    order = lambda i: (i is not None, i or 0)
    for i in sorted(given, key=order):
        for k in range(len(given[i]) - 19):
            first.setdefault(tuple(given[i][k : k + 20]), (i, k))
    for r in rows:
        if r["doc_id"] == 5:
            continue
        ws = given[r["doc_id"]]
        gone = {j for k in range(len(ws) - 19) if first[tuple(ws[k : k + 20])] != (r["doc_id"], k) for j in range(k, k + 20)}
        kept = " ".join(w for j, w in enumerate(ws) if j not in gone)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_pipeline_stages_take_effect(spark, tmp_path, docs):
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    steps, now = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        now = common.stored(stage(spark, now, str(tmp_path)), "step")
        steps[name] = now
    kept = steps["quality rules"]
    assert kept.columns == ["doc_id", "text"] and kept.count() == quality.judge(docs, None).where("quality.kept").count()
    single = steps["near-duplicates"]
    assert minhash.near_duplicates(single).where("NOT _keeper").count() == 0 and single.count() == minhash.near_duplicates(kept).where("_keeper").count()
    cleaned = steps["repeated passages"]
    assert cleaned.count() == single.count() and cleaned.columns == ["doc_id", "text"]
    total = sum(r["n_words"] - r["n_removed"] for r in substring.deduplicate(single).collect())
    assert sum(len(words(r["text"])) for r in cleaned.collect()) == total
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == steps["best-fit packing"].count()
