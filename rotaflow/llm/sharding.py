"""Sharding by vector bin packing: bytes, tokens and rows of the shards are balanced together.

Equal texts form a group that stays in one shard, unless it alone is more than an equal share of the bytes, tokens
or rows; then its rows are dealt in turn to as few parts as fit such a share (a single row always does). There are
at most 3 x shards such groups, whatever the input, so their table is broadcast.

Groups are placed by decreasing size where the dot product of their vector and the residual capacity is
highest. That is done in packs of at most ``PACK`` groups by tasks; every pack fills its own ``shards`` bins
evenly, and the bins are the groups of the next level, until at most ``PACK`` bins are left, which the driver places.

Null texts have size 1 and form one group; null and repeated ``doc_id`` are ordinary rows; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotaflow.llm.common import ranked, stored

PACK = 20_000  # groups placed one after another in one task
MEASURES = ["size", "tokens", "rows"]


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each group: the highest dot product with what is left of the equal capacities."""
    total = vectors.sum(axis=0)
    share = vectors / np.where(total > 0, total, 1) * shards
    left = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), np.int32)
    for k in np.argsort(-share.max(axis=1), kind="stable"):
        out[k] = best = int(np.argmax(left @ share[k]))
        left[best] -= share[k]
    return out


def _pack(groups: DataFrame, keys: list[str], shards: int) -> DataFrame:
    """``groups`` with a ``shard``. Columns: keys and MEASURES; one row per group."""
    groups = stored(groups, "groups")
    packs = max(1, -(-groups.count() // PACK))

    def fill(pack: pd.DataFrame) -> pd.DataFrame:
        pack = pack.sort_values(keys, ignore_index=True)
        return pack.assign(bin=place(pack[MEASURES].to_numpy(float), shards))

    kinds = ", ".join(f"{n} {t}" for n, t in groups.dtypes)
    filled = groups.withColumn("pack", F.pmod(F.xxhash64(*keys), F.lit(packs)))
    filled = stored(filled.groupBy("pack").applyInPandas(fill, f"{kinds}, pack bigint, bin int"), "packs")
    bins = filled.groupBy("pack", "bin").agg(*[F.sum(m).alias(m) for m in MEASURES])
    if packs * shards > PACK:
        placed = _pack(bins, ["pack", "bin"], shards).select("pack", "bin", "shard")
        return filled.join(placed, ["pack", "bin"]).select(*keys, *MEASURES, "shard")
    rows = bins.orderBy("pack", "bin").toPandas()  # at most PACK rows
    found = place(rows[MEASURES].to_numpy(float), shards)
    placed = list(zip(rows["pack"].tolist(), rows["bin"].tolist(), found.tolist(), strict=True))
    placed = groups.sparkSession.createDataFrame(placed, "pack bigint, bin int, shard int")
    return filled.join(F.broadcast(placed), ["pack", "bin"]).select(*keys, *MEASURES, "shard")


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, tokens, text_crc32, shard and slot of every row of ``docs`` (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))
    rows = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            words.cast("long").alias("tokens"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2("text", 256)).alias("content"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "rows",
    )
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    total = rows.agg(*sums).first()
    # rows of a group that fit a shard: equal texts are equally large
    fit = F.least(*[F.when(F.col(m) > 0, F.floor(F.lit(float(total[m] or 0)) * F.col("rows") / (F.col(m) * shards))) for m in MEASURES])
    groups = rows.groupBy("content").agg(*sums)
    large = groups.select(F.col("content").alias("of"), F.ceil(F.col("rows") / F.greatest(fit, F.lit(1))).alias("parts")).where("parts > 1")
    large = F.broadcast(stored(large, "large-groups"))
    same = F.col("content").eqNullSafe(F.col("of"))
    whole = rows.join(large, same, "left_anti").withColumn("part", F.lit(0).cast("long"))
    split = ranked(rows.join(large, same), "content", ["row"], F.xxhash64("row"), "rank")
    rows = whole.unionByName(split.select(*rows.columns, F.pmod("rank", "parts").alias("part")))
    keys = ["content", "part"]
    rows = rows.withColumn("content", F.coalesce("content", F.lit(b"")))
    placed = _pack(rows.groupBy(*keys).agg(*sums), keys, shards).select(*keys, "shard")
    rows = stored(rows.join(placed, keys), "placed")
    return ranked(rows, "shard", ["doc_id", "row"], F.xxhash64("row"), "slot").select("doc_id", "size", "tokens", "text_crc32", "shard", "slot")
