"""The machine dimension: baselines, categories and limits, one row per machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaflow import fixed_values as V
from rotaflow.fixed_values import PARAMETERS
from rotaflow.functions import rules
from rotaflow.plans.timeline import Timeline


def default_tolerances(spark: SparkSession) -> DataFrame:
    """The built-in tolerance table: one row per category and parameter (24)."""
    limit = lambda v: "CAST(NULL AS DOUBLE)" if v is None else f"{v}D"
    rows = ", ".join(
        f"('{category}', '{p}', {mandatory}, {limit(upper)}, {limit(lower)}, {both})"
        for category, cells in V.TOLERANCES.items()
        for p, (mandatory, upper, lower, both) in cells.items()
    )
    return spark.sql(
        f"SELECT * FROM VALUES {rows} "
        "AS t(category, param, mandatory, max_deviation, min_deviation, bidirectional)"
    )


def wide_tolerances(tolerances: DataFrame) -> DataFrame:
    """One row per category with four limits and flags per parameter."""
    aggs = []
    for p in PARAMETERS:
        mine = F.col("param") == p
        aggs += [
            F.max(F.when(mine, F.col("max_deviation"))).alias(f"{p}_max"),
            F.max(F.when(mine, F.col("min_deviation"))).alias(f"{p}_min"),
            F.coalesce(F.bool_or(F.when(mine, F.col("mandatory"))), F.lit(False)).alias(
                f"{p}_mandatory"
            ),
        ]
    # a few dozen rows: one partition saves the exchange
    return tolerances.coalesce(1).groupBy("category").agg(*aggs)


def machine_registry(baselines: DataFrame, category_override: str | None = None) -> DataFrame:
    """Baselines with the derived tolerance category."""
    category = (
        F.lit(category_override)
        if category_override
        else rules.tolerance_category(F.col("application"), F.col("horsepower"))
    )
    return baselines.withColumn("category", category)


def one_baseline(baselines: DataFrame) -> DataFrame:
    """One row per machine: of repeated baselines the smallest, column by column in order; rows without a machine go."""
    others = [c for c in baselines.columns if c != "well_id"]
    chosen = baselines.where("well_id IS NOT NULL").groupBy("well_id").agg(F.min(F.struct(*others)).alias("_one"))
    return chosen.select(*["well_id" if c == "well_id" else F.col(f"_one.{c}").alias(c) for c in baselines.columns])


def fleet_limits(
    baselines: DataFrame, tolerances: DataFrame, category_override: str | None = None
) -> DataFrame:
    """Registry with the limits of each machine's category, one row per machine whatever ``baselines`` repeats.

    The tolerance table is a handful of categories, so it is always broadcast.
    """
    registry = machine_registry(one_baseline(baselines), category_override)
    return registry.join(F.broadcast(wide_tolerances(tolerances)), "category", "left")


def baseline_from_early(
    telemetry: DataFrame,
    timeline: Timeline,
    rows: int = V.EARLY_ROWS,
    horsepower: float = 100.0,
    application: str = "Municipal Water and Wastewater",
    pump_type: str = "Unknown",
) -> DataFrame:
    """Medians of each machine's first readings; no group is larger than ``rows``."""
    early = timeline.first_rows(telemetry, rows)
    return early.groupBy("well_id").agg(
        F.lit(pump_type).alias("pump_type"),
        F.lit(float(horsepower)).alias("horsepower"),
        F.lit(application).alias("application"),
        *[F.median(p).alias(f"baseline_{p}") for p in PARAMETERS],
    )


def with_early_baseline(registry: DataFrame, early: DataFrame) -> DataFrame:
    """Registry attributes with baselines measured from early operation."""
    return registry.select("well_id", "pump_type", "horsepower", "application").join(
        early.select("well_id", *[f"baseline_{p}" for p in PARAMETERS]), "well_id"
    )


def unmatched_machines(telemetry: DataFrame, baselines: DataFrame) -> DataFrame:
    """Machines that send readings but have no baseline."""
    seen = telemetry.groupBy("well_id").agg(F.count("*").alias("readings"))
    return seen.join(baselines.select("well_id"), "well_id", "left_anti")


def machine_tolerances(fleet: DataFrame, tolerances: DataFrame) -> DataFrame:
    """Long form: one row per machine and parameter with its limits and baseline."""
    baseline = F.create_map(
        *[x for p in PARAMETERS for x in (F.lit(p), F.col(f"baseline_{p}"))]
    )
    return (
        fleet.select("well_id", "category", baseline.alias("_baselines"))
        .join(F.broadcast(tolerances), "category")
        .withColumn("baseline", F.col("_baselines")[F.col("param")])
        .drop("_baselines")
    )


def early_warning_thresholds(fleet: DataFrame, tolerances: DataFrame) -> DataFrame:
    """Half of the limit for each mandatory parameter: the upper one, else the lower."""
    return machine_tolerances(fleet, tolerances).where("mandatory").select(
        "well_id",
        "category",
        "param",
        F.coalesce(F.col("max_deviation") / 2, F.col("min_deviation") / 2).alias("alert_at"),
    )


def tolerance_summary(fleet: DataFrame, tolerances: DataFrame) -> DataFrame:
    """Readable limits per machine, one text of at most four lines."""
    number = lambda c: F.format_string("%.0f", c)
    upper, lower = F.col("max_deviation"), F.col("min_deviation")
    limits = F.when(
        F.col("bidirectional"), F.concat(F.lit("+/- "), number(upper), F.lit("%"))
    ).otherwise(
        F.concat_ws(
            ", ",
            F.when(upper.isNotNull(), F.concat(F.lit("+"), number(upper), F.lit("%"))),
            F.when(lower == 0, F.lit("-0% (no negative deviation allowed)")).when(
                lower.isNotNull(), F.concat(number(lower), F.lit("%"))
            ),
        )
    )
    position = F.array_position(F.array(*[F.lit(p) for p in PARAMETERS]), F.col("param"))
    need = F.when(F.col("mandatory"), "mandatory").otherwise("optional")
    line = F.concat(rules.title_of(F.col("param")), F.lit(" ("), need, F.lit("): "), limits)
    by_category = tolerances.coalesce(1).groupBy("category").agg(
        F.array_sort(F.collect_list(F.struct(position.alias("pos"), line.alias("line")))).alias("l")
    )
    text = by_category.select(
        "category", F.array_join(F.transform("l", lambda x: x["line"]), "; ").alias("summary")
    )
    return fleet.select("well_id", "category").join(F.broadcast(text), "category")
