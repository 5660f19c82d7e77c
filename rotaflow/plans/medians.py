"""Exact medians per key, also for a key too large for one task.

Spark's ``median`` keeps all distinct values of a group in memory. That is fine
for ordinary keys; for a hot key the middle ranks are narrowed down by
histograms (partial aggregation, ``BUCKETS`` rows per key) until the remaining
bucket is small or holds a single value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rotaflow.plans.timeline import MAX_ROWS
from rotaflow.session import cut_lineage

BUCKETS = 1024
ROUNDS = 200  # each divides a finite range by BUCKETS; doubles need far fewer


def medians(
    df: DataFrame, key: str, columns: dict[str, Column], max_rows: int = MAX_ROWS
) -> DataFrame:
    """One row per key with the interpolated median of each column.

    NaN and infinite values count as missing, rows without a key are left out.
    """
    df = df.where(F.col(key).isNotNull())
    columns = {name: _finite(c) for name, c in columns.items()}
    plain = lambda part: part.groupBy(key).agg(
        *[F.median(c).alias(name) for name, c in columns.items()]
    )
    hot = df.groupBy(key).count().where(F.col("count") > max_rows).select(key)
    if hot.isEmpty():
        return plain(df)
    hot = cut_lineage(hot)  # at most rows / max_rows keys
    large = df.join(F.broadcast(hot), key, "left_semi")
    found = hot
    for name, column in columns.items():
        values = large.select(key, column.cast("double").alias("v")).where("v is not null")
        found = found.join(_middle(values, key, max_rows).withColumnRenamed("m", name), key, "left")
    ordinary = df.join(F.broadcast(hot), key, "left_anti")
    return plain(ordinary).unionByName(found)


def _finite(column: Column) -> Column:
    value = column.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def _middle(values: DataFrame, key: str, max_rows: int) -> DataFrame:
    ranks = F.array(
        F.struct(F.lit(0).alias("side"), F.ceil(F.col("n") / 2).alias("rank")),
        F.struct(F.lit(1).alias("side"), (F.floor(F.col("n") / 2) + 1).alias("rank")),
    )
    goal = cut_lineage(
        values.groupBy(key)
        .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .withColumn("goal", F.explode(ranks))
        .select(key, "goal.side", "goal.rank", "lo", "hi", F.lit(0).cast("long").alias("below"), "n")
    )
    for _ in range(ROUNDS):
        if goal.where(f"n > {max_rows} and lo < hi").isEmpty():
            break
        goal = cut_lineage(_narrow(values, goal, key, max_rows))
    else:
        raise RuntimeError(f"medians not found after {ROUNDS} rounds")

    # two rows per key are left; ranks within the narrowed range finish the search
    single = goal.where("lo = hi").select(key, "side", F.col("lo").alias("v"))
    inside = values.join(F.broadcast(goal.where("lo < hi")), key).where("v between lo and hi")
    order = W.partitionBy(key, "side").orderBy("v")
    ranked = (
        inside.withColumn("rn", F.row_number().over(order) + F.col("below"))
        .where("rn = rank")
        .select(key, "side", "v")
    )
    return single.unionByName(ranked).groupBy(key).agg(F.avg("v").alias("m"))


def _narrow(values: DataFrame, goal: DataFrame, key: str, max_rows: int) -> DataFrame:
    open_goals = goal.where(f"n > {max_rows} and lo < hi")
    share = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))
    counts = (
        values.join(F.broadcast(open_goals), key)
        .where("v between lo and hi")
        .groupBy(key, "side", "rank", "below", bucket.alias("bucket"))
        .agg(F.count("*").alias("c"), F.min("v").alias("new_lo"), F.max("v").alias("new_hi"))
    )
    upto = W.partitionBy(key, "side").orderBy("bucket")
    located = (
        counts.withColumn("upto", F.col("below") + F.sum("c").over(upto))
        .where("rank <= upto and rank > upto - c")
        .select(
            key,
            "side",
            "rank",
            F.col("new_lo").alias("lo"),
            F.col("new_hi").alias("hi"),
            (F.col("upto") - F.col("c")).alias("below"),
            F.col("c").alias("n"),
        )
    )
    return goal.where(f"not (n > {max_rows} and lo < hi)").unionByName(located)
