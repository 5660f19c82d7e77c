"""Approximate nearest neighbours by balanced posting lists on disk.

Index: centroids come from hierarchical balanced splits of a bounded sample; every vector is indexed. A vector goes to its
nearest list and, if it lies near a boundary, to the others whose centroid is at most ``COPY_RATIO`` times as far (``COPIES`` at
most). Centroids are searched by a graph of nearest centroids held in memory, best first with a beam; nothing is compared with all of them. The graph is
broadcast and takes ``GRAPH_BYTES`` at most, which bounds the number of lists. A query visits the lists whose centroid is at most ``PROBE_RATIO`` times
as far as the nearest, up to ``probes_of`` lists: a number that grows as the lists to the power 2/3, so the visited share falls as
lists are added; on vectors without any clusters, the hardest case, recall stays above 0.9 (see the README). Lists are
small and handled many at a time; long lists and many queries of a list are cut into blocks, a task group each, so no list is held whole.

Equal vectors are one point that carries its ``k + 1`` smallest ids: by nearness and then id no other can be among
the nearest of a query. Distances are exact, in double precision, on the original vectors.

Rows whose vector is null, zero, or holds null or non-finite components take no part, nor do rows without ``vec_id`` and vectors of another
length than the most common one. Rows that share the query's ``vec_id`` count as the query's own. An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotaflow.llm.common import column, stored

SAMPLE = 65_536  # vectors the centroids are fitted on, at most; fewer if they exceed ``GRAPH_BYTES``
GRAPH_BYTES = 64 << 20  # of centroids and edges, which are broadcast
LIST_ROWS = 50  # points a list should have, as long as the graph may grow
DEGREE, FAR, WIDTH = 24, 4, 32  # near and far edges of a centroid; least candidates that the search keeps
EXPANDED = 4  # candidates whose edges are followed in one step
COPIES, COPY_RATIO = 4, 1.1
PROBES, PROBE_LISTS, PROBE_RATIO = 40, 256, 1.6  # so many probes among so many lists
BLOCK_POINTS, BLOCK_QUERIES = 10_000, 2_000


def most_lists(dims: int) -> int:
    """Centroids that fit into ``GRAPH_BYTES`` with their edges, and that the sample can tell apart."""
    return max(1, min(SAMPLE, GRAPH_BYTES // (8 * dims + 4 * (DEGREE + FAR))))


def _split(x: np.ndarray, leaves: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Means of ``leaves`` equally large parts: two-means splits, cut where both sides get their share."""
    if leaves <= 1 or len(x) < 2:
        return [x.mean(axis=0)] if len(x) else []
    centres = x[rng.choice(len(x), 2, replace=False)]
    share = len(x) * (leaves // 2) // leaves
    for _ in range(6):
        lean = x @ (centres[1] - centres[0])
        order = np.argsort(lean, kind="stable")
        low, high = order[:share], order[share:]
        centres = np.stack([x[low].mean(axis=0), x[high].mean(axis=0)])
    return _split(x[low], leaves // 2, rng) + _split(x[high], leaves - leaves // 2, rng)


@dataclass
class CentroidGraph:
    centroids: np.ndarray
    edges: np.ndarray
    entry: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int) -> CentroidGraph:
        rng = np.random.default_rng(7)
        centroids = np.array(_split(sample, lists, rng))
        degree = min(DEGREE, len(centroids))
        near = []
        for low in range(0, len(centroids), 512):
            d = _squares(centroids[low : low + 512], centroids)
            near.append(np.argpartition(d, degree - 1, axis=1)[:, :degree].astype(np.int32))
        far = rng.integers(0, len(centroids), (len(centroids), FAR), np.int32)  # a few far edges keep the graph connected
        entry = rng.choice(len(centroids), min(8, len(centroids)), replace=False).astype(np.int32)
        return cls(centroids, np.hstack([np.concatenate(near), far]), entry)

    def search(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and squared distances of about the ``k`` nearest centroids of each row, nearest first (infinite where there are fewer).

        Best first: a step follows the edges of the nearest candidates that are not expanded yet; a row ends when all it keeps are. All rows step
        together. It keeps ``WIDTH`` candidates, or ``k`` if that is more.
        """
        n, c = len(x), len(self.centroids)
        width = min(max(WIDTH, k), c)
        seen = np.zeros((n, c), bool)
        ids, d = np.zeros((n, width), np.int32), np.full((n, width), np.inf)
        done = np.zeros((n, width), bool)
        who, fresh = np.arange(n), np.broadcast_to(self.entry, (n, len(self.entry)))
        while len(who):
            fresh = np.sort(fresh, axis=1)
            new = ~seen[who[:, None], fresh]
            new[:, 1:] &= fresh[:, 1:] != fresh[:, :-1]
            seen[who[:, None], fresh] = True
            row, at = np.nonzero(new)
            found = np.full(fresh.shape, np.inf)
            gap = x[who[row]] - self.centroids[fresh[row, at]]
            found[row, at] = np.einsum("ij,ij->i", gap, gap)
            all_d, all_ids = np.hstack([d[who], found]), np.hstack([ids[who], fresh])
            all_done = np.hstack([done[who], np.zeros(fresh.shape, bool)])
            best = np.argpartition(all_d, width - 1, axis=1)[:, :width] if all_d.shape[1] > width else np.tile(np.arange(width), (len(who), 1))
            d[who], ids[who], done[who] = (np.take_along_axis(a, best, axis=1) for a in (all_d, all_ids, all_done))
            todo = np.where(done[who], np.inf, d[who])
            some = min(EXPANDED, width)
            nearest = np.argpartition(todo, some - 1, axis=1)[:, :some]
            open_ = np.isfinite(np.take_along_axis(todo, nearest, axis=1))
            go = open_.any(axis=1)
            who, nearest, open_ = who[go], nearest[go], open_[go]
            done[who[:, None], nearest] = True
            chosen = np.where(open_, ids[who[:, None], nearest], ids[who, nearest[:, 0]][:, None])
            fresh = self.edges[chosen].reshape(len(who), some * self.edges.shape[1])
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(d, order, axis=1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T, 0)


def _matrix(values: pa.Array) -> np.ndarray:
    return np.asarray(values.flatten()).astype(float).reshape(len(values), -1) if len(values) else np.zeros((0, 1))


def probes_of(lists: int) -> int:
    """Lists a query visits at most, of ``lists`` in all."""
    return min(lists, math.ceil(PROBES * (lists / PROBE_LISTS) ** (2 / 3) + 8))


def _lists(graph, copies: int, ratio: float, least: int):
    """Adds the posting lists of each vector: those within ``ratio`` of the nearest distance, ``least`` at any rate."""
    def run(batches):
        index = graph.value
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                ids, squares = index.search(_matrix(column(part, "vector")), copies)
                keep = squares <= ratio**2 * squares[:, :1]
                keep[:, :least] = True
                keep &= np.isfinite(squares)
                found = [row[k].tolist() for row, k in zip(ids, keep, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.int32()))], [*part.schema.names, "lists"])

    return run


def nearest_in_block(queries: np.ndarray, points: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, point and exact distance of the ``k`` nearest points of each query; ties by ``first``."""
    rows, cols, dists = [], [], []
    scale = 1e-12 * (points**2).sum(axis=1).max(initial=0)
    for low in range(0, len(queries), 64):
        q = queries[low : low + 64]
        d = _squares(q, points)
        cut = min(k, len(points)) - 1
        limit = np.partition(d, cut, axis=1)[:, cut] + scale + 1e-12 * (q**2).sum(axis=1)  # rounding of the fast form
        for i, j in enumerate(np.flatnonzero(row) for row in d <= limit[:, None]):
            exact = np.sqrt(((points[j] - q[i]) ** 2).sum(axis=1))
            order = np.lexsort([first[j], exact])[:k]
            rows.append(np.full(len(order), low + i)), cols.append(j[order]), dists.append(exact[order])
    return tuple(np.concatenate([*x, np.zeros(0, kind)]) for x, kind in ((rows, int), (cols, int), (dists, float)))


def _search(k: int):
    """The ``k`` nearest ids of each query in the lists of a group, list by list."""

    def run(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype=float)})
        if not len(queries) or not len(points):
            return none
        queries, points = (x.sort_values("list", kind="stable", ignore_index=True) for x in (queries, points))
        stack = lambda s: np.stack(s.to_numpy()).astype(float)
        asked, held, first = stack(queries["vector"]), stack(points["vector"]), points["point"].to_numpy()
        own, theirs = queries["list"].to_numpy(), points["list"].to_numpy()
        found = []
        for number in np.intersect1d(own, theirs).tolist():
            a, b = np.searchsorted(own, [number, number + 1]), np.searchsorted(theirs, [number, number + 1])
            q, p, d = nearest_in_block(asked[a[0] : a[1]], held[b[0] : b[1]], first[b[0] : b[1]], k)
            found.append((q + a[0], p + b[0], d))
        if not found:
            return none
        q, p, d = (np.concatenate(x) for x in zip(*found, strict=True))
        ids = points["ids"].to_numpy()[p]
        n = np.array([len(x) for x in ids])
        out = pd.DataFrame({"query": np.repeat(queries["point"].to_numpy()[q], n), "id": np.concatenate(ids), "score": np.repeat(d, n)})
        out = out.drop_duplicates(["query", "id"]).sort_values(["query", "score", "id"])
        return out.groupby("query", sort=False).head(k)

    return run


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and vector (double) of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("vector", lambda v: v != 0)
    rows = rows.select("vec_id", vector.alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL").where(fine)
    size = rows.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return rows.where(F.size("vector") == (size["size"] if size else 0))


def neighbours(rows: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows found for each row that ``is_query`` (a condition on vec_id)."""
    spark = rows.sparkSession
    rows = usable(rows)
    numbered = rows.distinct().withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    points = numbered.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = stored(points.withColumn("point", F.col("ids")[0]).withColumn("row", F.monotonically_increasing_id()), "points")
    total = points.count()
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dims = points.select(F.size("vector")).first()[0]
    sample = points.orderBy(F.xxhash64("vector"), "row").limit(most_lists(dims)).select("vector").toArrow()
    lists = max(1, min(most_lists(dims), -(-total // LIST_ROWS)))
    graph = spark.sparkContext.broadcast(CentroidGraph.fit(_matrix(sample.column("vector").combine_chunks()), lists))

    kinds = "row bigint, point bigint, ids array<bigint>, vector array<double>, lists array<int>"
    placed = points.select("row", "point", "ids", "vector").mapInArrow(_lists(graph, COPIES, COPY_RATIO, 1), kinds)
    placed = stored(placed.withColumn("list", F.explode("lists")).drop("lists"), "postings")
    asked = rows.where(is_query).select(F.col("vector").alias("asked")).distinct()
    asked = points.join(asked, F.col("vector") == F.col("asked")).select("row", "point", "ids", "vector")
    probes = asked.mapInArrow(_lists(graph, probes_of(lists), PROBE_RATIO, 8), kinds)
    probes = stored(probes.select(F.col("row").alias("point"), "vector", "lists"), "probes")  # a query's vector once, not once a list
    probes = probes.select("point", "vector", F.explode("lists").alias("list"))

    # a row per list, so their number is bounded as the graph is
    sizes = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_POINTS).alias("blocks"))
    sizes = sizes.join(probes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).alias("askers")), "list")
    sizes = F.broadcast(stored(sizes, "list-sizes"))
    bins = max(1, -(-COPIES * total // BLOCK_POINTS))  # lists are small; a group holds many
    group = ["bin", "block", "asker"]
    spread = F.pmod("list", F.lit(bins)).alias("bin")
    spots = placed.join(sizes, "list").select(spread, "list", F.pmod(F.xxhash64("row"), "blocks").alias("block"), F.explode(F.expr("sequence(0L, askers - 1)")).alias("asker"), "point", "ids", "vector")
    probes = probes.join(sizes, "list").select(spread, "list", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), F.pmod(F.xxhash64("point"), "askers").alias("asker"), "point", "vector")
    found = probes.groupBy(*group).cogroup(spots.groupBy(*group)).applyInPandas(_search(k + 1), "query bigint, id bigint, score double")
    found = found.groupBy("query", "id").agg(F.min("score").alias("score"))
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))).where(F.col("n") <= k + 1)
    best = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("near"))
    best = stored(points.select("row", F.col("vector").alias("of")).join(best, F.col("row") == F.col("query")).select("of", "near"), "found")
    out = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "vector").distinct().join(best, F.col("vector") == F.col("of"))
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))
