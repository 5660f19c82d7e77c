"""Quality rules: counts over whole texts, and boosted trees over them.

The trees are fitted on a bounded sample of labelled rows with numpy, may only fall in features
declared monotone, and are flattened to arrays of nodes, so that a batch of documents walks all
trees level by level without a Python loop over documents.

Null texts count as empty (no words, hence ``base_failed``); a null ``doc_id`` is kept as it is; repeated
rows are judged each; an empty table gives no rows; other columns of any name stay. Without usable labels (none, or of one class) the verdict is "kept".
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from rotaflow.llm.common import Words, column, mix, slices, span_hashes, windows, words_of

FEATURES = (
    "log_words", "mean_word_chars", "symbol_share", "dup_line_share", "repeat_word_share",
    "upper_share", "digit_share", "exclamation_share", "mean_line_words", "distinct_word_share",
)
#: Features that may only lower the score as they grow.
FALLING = ("symbol_share", "dup_line_share", "repeat_word_share", "upper_share", "exclamation_share")
SAMPLE_ROWS = 20_000  # most labelled rows that are fitted; the choice is by hash of doc_id

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per key: does it occur at least twice; is it not the first of its kind."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order[1:]] = later[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def _in_doc(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return hashes ^ mix(doc.astype(np.uint64) + np.uint64(1))


def _lines(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of the \\n-split lines that have a word, and the text of each."""
    breaks = np.flatnonzero(w.data == 10)
    edges = np.unique(np.concatenate([w.offsets, breaks + 1]))
    line = np.unique(np.searchsorted(edges, w.start, "right") - 1)
    start, end = edges[line], edges[line + 1]
    end = end - (w.data[end - 1] == 10)
    return start, end, np.searchsorted(w.offsets, start, "right") - 1


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Exact counts of each text, and the features of the trees."""
    w = words_of(texts)
    n_texts, n_words = len(texts), np.diff(w.first)
    in_word = np.zeros(len(w.data) + 1, np.int8)
    in_word[w.start] += 1
    in_word[w.end] -= 1  # a word that starts where another text's ends adds up to 0
    in_word = np.cumsum(in_word[:-1], dtype=np.int8).astype(bool)
    chars = _per_text(in_word & ((w.data & 0xC0) != 0x80), w.offsets)
    symbols = _per_text(_SYMBOL[w.data], w.offsets)

    start, end, owner = _lines(w)
    _, again = _repeats(_in_doc(span_hashes(w.data, start, end), owner))
    lines, dup_lines = (np.bincount(x, minlength=n_texts) for x in (owner, owner[again]))

    hashes, doc = w.hashes(), w.doc
    at, keys = windows(hashes, w.first, 5)
    twice, _ = _repeats(_in_doc(keys, doc[at]))
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 5, -1)
    repeated = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n_texts)
    _, seen = _repeats(_in_doc(hashes, doc))
    distinct = n_words - np.bincount(doc[seen], minlength=n_texts)

    some = np.maximum(n_words, 1)
    share = lambda lut: _per_text(lut[w.data], w.offsets) / np.maximum(chars, 1)
    exclaims = np.arange(256) == 33
    features = np.stack([
        np.log1p(n_words), chars / some, symbols / np.maximum(chars, 1), dup_lines / np.maximum(lines, 1), repeated / some,
        share(_UPPER), share(_DIGIT), share(exclaims), n_words / np.maximum(lines, 1), distinct / some,
    ], axis=1)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeated, "features": features}


# ---------------------------------------------------------------- boosted trees


@dataclass
class Trees:
    """All trees as node arrays; leaves point to themselves. ``root`` is each tree's first node."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    depth: int
    base: float

    def score(self, features: np.ndarray) -> np.ndarray:
        """Log-odds of each row: all trees step down together."""
        node = np.broadcast_to(self.root, (len(features), len(self.root))).copy()
        rows = np.arange(len(features))[:, None]
        for _ in range(self.depth):
            low = features[rows, self.feature[node]] <= self.limit[node]
            node = np.where(low, self.left[node], self.right[node])
        return self.base + self.value[node].sum(axis=1)


def fit_trees(x: np.ndarray, y: np.ndarray, falling: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 5) -> Trees:
    """Logistic boosting on binned features; splits that would let a falling feature raise the score are refused.

    Children of such a split are bounded by the mean of both values, so the constraint holds for whole trees.
    """
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    rate_one = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(rate_one / (1 - rate_one)))
    margin, nodes, roots = np.full(len(y), base), [], []
    leaf = lambda g, h, low, high: float(np.clip(-g / (h + 1.0), low, high))

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        own = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        nodes.append([0, np.inf, own, own, rate * leaf(gs, hs, low, high)])
        best = None
        for f, cut in enumerate(edges):
            if level == depth or not len(cut):
                continue
            sums = [np.bincount(codes[rows, f], z, len(cut) + 1)[:-1].cumsum() for z in (g[rows], h[rows], np.ones(len(rows)))]
            gl, hl, nl = sums
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            allowed = (nl >= least) & (len(rows) - nl >= least)
            if f in falling:
                allowed &= np.clip(-gl / (hl + 1), low, high) >= np.clip(-(gs - gl) / (hs - hl + 1), low, high)
            k = int(np.argmax(np.where(allowed, gain, -np.inf)))
            if allowed[k] and gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                best = (gain[k], f, k, leaf(gl[k], hl[k], low, high), leaf(gs - gl[k], hs - hl[k], low, high))
        if best:
            _, f, k, vl, vr = best
            mid, left = (vl + vr) / 2, codes[rows, f] <= k
            bounds = ((mid, high), (low, mid)) if f in falling else ((low, high), (low, high))
            nodes[own][:2] = [f, edges[f][k]]
            nodes[own][2] = grow(rows[left], g, h, level + 1, *bounds[0])
            nodes[own][3] = grow(rows[~left], g, h, level + 1, *bounds[1])
        return own

    flat = None
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        feature, limit, left, right, value = (np.array(c) for c in zip(*nodes, strict=True))
        flat = Trees(feature.astype(np.int64), limit.astype(float), left.astype(np.int64), right.astype(np.int64), value.astype(float), np.array(roots), depth, base)
        last = Trees(flat.feature, flat.limit, flat.left, flat.right, flat.value, flat.root[-1:], depth, 0.0)
        margin = margin + last.score(x)
    return flat


def _feature_rows(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            found = statistics(column(part, "text"))["features"]
            yield pa.RecordBatch.from_arrays([column(part, "y"), pa.array(list(found), pa.list_(pa.float64()))], ["y", "x"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees | None:
    """Trees for the label ``quality``, fitted on at most ``sample_rows`` labelled rows; None without both classes.

    The labels are thinned first (their doc_id and class, at most ``sample_rows`` rows, are broadcast), so texts are
    not shuffled but for those. Labels with nulls are left out; of contradicting labels of one document the worse counts, and of texts that share a
    ``doc_id`` the one of the smallest hash.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    first = F.min_by(F.struct("text"), F.struct(F.xxhash64("text"), "text")).alias("first")  # of repeated ids one text, whatever the order of rows
    rows = rows.groupBy("doc_id").agg(F.first("y").alias("y"), first).select("first.text", "y")
    rows = rows.mapInArrow(_feature_rows, "y double, x array<double>").toPandas()
    y = rows["y"].to_numpy()
    if len(set(y > 0)) < 2:
        return None
    x = np.stack(rows["x"].to_numpy())
    order = np.lexsort(np.column_stack([x, y]).T)  # the fit doesn't depend on the order of arrival
    return fit_trees(x[order], (y[order] > 0).astype(float), [FEATURES.index(f) for f in FALLING])


def judge(docs: DataFrame, trees: Trees | None, least_words: int = 10, repeat_percent: int = 20, into: str = "quality") -> DataFrame:
    """Rows of ``docs`` (all columns) with the struct ``into``: counts, score, base_failed and kept.

    A column that has the name ``into`` already is replaced.
    """
    docs = docs.drop(into)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # Spark's Python functions take no names with back-ticks
    text, verdict_name = f"c{names.index('text')}", "verdict"

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                s = statistics(column(part, text))
                failed = (s["n_words"] < least_words) | (100 * s["n_repeat_words"] > repeat_percent * s["n_words"])
                score = trees.score(s["features"]) if trees else np.zeros(len(failed))
                counted = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
                found = [pa.array(s[n].astype(np.int64)) for n in counted] + [pa.array(score), pa.array(failed), pa.array(~failed & (score >= 0))]
                struct = pa.StructArray.from_arrays(found, [*counted, "score", "base_failed", "kept"])
                yield pa.RecordBatch.from_arrays([*part.columns, struct], [*part.schema.names, verdict_name])

    counts = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
    verdict = StructType.fromDDL(f"{counts}, score double, base_failed boolean, kept boolean")
    return plain.mapInArrow(run, StructType([*plain.schema.fields, StructField(verdict_name, verdict)])).toDF(*names, into)
