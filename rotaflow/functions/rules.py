"""Column expressions of the monitoring rules; all stay inside codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rotaflow import fixed_values as V
from rotaflow.fixed_values import PARAMETERS


def clean(value: Column) -> Column:
    """NaN counts as missing; Spark would order it above every number."""
    return F.when(~F.isnan(value), value)


def deviation(current: Column, baseline: Column) -> Column:
    """Percentage deviation; NULL for a zero baseline."""
    return F.try_divide(current - baseline, baseline) * 100


def two_places(value: Column) -> Column:
    """Rounded to two places, halves to even, never -0.0; plain double arithmetic."""
    return F.rint(value * 100) / 100 + 0.0


def edge_deviation(current: Column, baseline: Column) -> Column:
    """As ``deviation`` but 0 for a zero baseline, rounded to two places."""
    ratio = F.try_divide(current - baseline, baseline) * 100
    return F.when(baseline == 0, F.lit(0.0)).otherwise(two_places(ratio))


def tolerance_category(application: Column, horsepower: Column) -> Column:
    """Category of a machine; NULL for an unknown application."""
    by_power = F.when(
        horsepower < V.HORSEPOWER_SPLIT, F.lit(V.BELOW_SPLIT_CATEGORY)
    ).otherwise(F.lit(V.FROM_SPLIT_CATEGORY))
    chosen = F.when(application.isin(*V.HORSEPOWER_APPLICATIONS), by_power)
    for name, category in V.APPLICATION_CATEGORY.items():
        chosen = chosen.when(application == name, F.lit(category))
    return chosen


def above(dev: Column, upper: Column) -> Column:
    return F.coalesce(dev > upper, F.lit(False))


def below(dev: Column, lower: Column) -> Column:
    return F.coalesce(dev < lower, F.lit(False))


def severity(dev: Column, upper: Column, lower: Column) -> Column:
    """How far outside: a ratio above, a relative excess below; 0 inside."""
    over = F.abs(dev) / upper
    under = (
        F.when(lower == 0, F.abs(dev) / V.ZERO_LIMIT_SCALE)
        .otherwise(F.abs(dev - lower) / F.abs(lower))
    )
    return F.when(above(dev, upper), over).when(below(dev, lower), under).otherwise(0.0)


def count_true(flags: Sequence[Column]) -> Column:
    total = flags[0].cast("int")
    for flag in flags[1:]:
        total = total + flag.cast("int")
    return total


def status_from_counts(
    mandatory: Column, severe: Column, total: Column, sustained: Column
) -> Column:
    return (
        F.when(total == 0, "Normal")
        .when((mandatory >= 2) | (severe >= 2), "Failure")
        .when((severe >= 1) | (total >= 3), "Critical")
        .when((mandatory >= 1) & sustained, "Critical")
        .otherwise("Warning")
    )


def edge_limit(dev: Column, upper: Column, lower: Column) -> Column:
    """The limit a reading violates (the upper one first), or NULL."""
    return F.when(above(dev, upper), upper).when(below(dev, lower), lower)


def edge_side(dev: Column, upper: Column, lower: Column) -> Column:
    return F.when(above(dev, upper), "max").when(below(dev, lower), "min")


def edge_status(hit: dict[str, Column], dev: dict[str, Column], limit: dict[str, Column],
                mandatory_exceeded: Column) -> Column:
    """Status at the edge: ratio of the largest deviation to the largest limit hit."""
    worst = F.greatest(*[F.when(hit[p], F.abs(dev[p])) for p in PARAMETERS])
    largest = F.greatest(*[F.when(limit[p] != 0, F.abs(limit[p])) for p in PARAMETERS])
    ratio = worst / F.coalesce(largest, F.lit(V.ZERO_LIMIT_SCALE))
    return (
        F.when(worst.isNull(), "Normal")
        .when(~mandatory_exceeded, "Warning")
        .when(ratio > V.EDGE_FAILURE_ABOVE, "Failure")
        .when(ratio > V.EDGE_CRITICAL_ABOVE, "Critical")
        .otherwise("Warning")
    )


def chosen(flags: dict[str, Column], element: dict[str, Column]) -> Column:
    """Array of the elements whose flag holds, in parameter order."""
    return F.flatten(
        F.array(
            *[
                F.when(flags[p], F.array(element[p])).otherwise(F.slice(F.array(element[p]), 1, 0))
                for p in PARAMETERS
            ]
        )
    )


def one_decimal(value: Column) -> Column:
    """Text with one decimal; a small negative value keeps its sign."""
    text = value.cast("decimal(20,1)").cast("string")
    return F.when((value < 0) & (text == "0.0"), "-0.0").otherwise(text)


def band_upper(baseline: Column, upper: Column, largest: Column) -> Column:
    return F.when(upper.isNotNull(), baseline * (1 + upper / 100)).otherwise(largest * 1.1)


def band_lower(baseline: Column, lower: Column) -> Column:
    return F.when(lower.isNotNull(), baseline * (1 + lower / 100)).otherwise(0.0)


def status_code(status: Column) -> Column:
    code = F.when(status == V.STATUSES[0], 0)
    for number, name in enumerate(V.STATUSES[1:], start=1):
        code = code.when(status == name, number)
    return code


def failure_probability(rul: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - rul / V.RUL_HORIZON_DAYS))


def edge_prediction(rul: Column) -> Column:
    """Floored RUL, stepped probability and confidence, as the edge reports them."""
    floored = F.greatest(F.lit(0.0), rul)
    (first, p_first), *rest = V.RUL_BUCKETS
    probability = F.when(floored < first, p_first)
    for limit, p in rest:
        probability = probability.when(floored < limit, p)
    confidence = F.greatest(
        F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(rul) / V.RUL_HORIZON_DAYS)
    )
    return F.struct(
        two_places(floored).alias("rul_days"),
        probability.otherwise(V.RUL_BEYOND).alias("probability"),
        two_places(confidence).alias("confidence"),
    )


def amps_to_hp(current: Column) -> Column:
    """Three-phase motor power from its current."""
    return (
        current * V.VOLTAGE * F.sqrt(F.lit(3.0)) * V.POWER_FACTOR * V.MOTOR_EFFICIENCY
        / V.WATTS_PER_HP
    )


def hz_to_rpm(frequency: Column) -> Column:
    return frequency / 60 * 1800


def flow_from_current(current: Column, median_current: Column) -> Column:
    return F.lit(V.NOMINAL_FLOW) * F.try_divide(current, median_current)


def efficiency_from_vibration(vibration: Column, largest: Column) -> Column:
    share = 1 - vibration / (largest * 1.2)
    return F.when(largest > 0, 75 + share * 15).otherwise(V.DEFAULT_EFFICIENCY)


def hydraulic_efficiency(flow: Column, head_ft: Column, power: Column) -> Column:
    low, high = V.EFFICIENCY_CLAMP
    ratio = F.try_divide(flow * head_ft / V.HYDRAULIC_CONSTANT, power) * 100
    raw = F.when(power > 0, ratio).otherwise(V.DEFAULT_EFFICIENCY)
    return F.greatest(F.lit(low), F.least(F.lit(high), raw))


def horsepower_rating(power: Column) -> Column:
    return F.ceil(power / V.TYPICAL_LOADING)


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days, NULL if either side is missing."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / 86_400_000_000


def unit_of(column_name: Column) -> Column:
    """``gpm`` of ``Flow (gpm)``; empty if there is no unit."""
    return F.regexp_extract(column_name, r"\(([^()]*)\)[^(]*$", 1)


def label_of(column_name: Column) -> Column:
    return F.trim(F.split(column_name, r"\(").getItem(0))


def title_of(parameter: Column) -> Column:
    return F.initcap(parameter)


def slug_of(identifier: Column) -> Column:
    return F.lower(F.replace(identifier, F.lit(" "), F.lit("_")))


def iso_z(ts: Column) -> Column:
    """ISO text with a ``Z``; fractions of a second, six digits, only where there are any."""
    text = F.translate(ts.cast("timestamp_ntz").cast("string"), " ", "T")
    full = F.when(F.length(text) == 19, text).otherwise(F.rpad(text, 26, "0"))
    return F.concat(full, F.lit("Z"))


def first_violated(flags: dict[str, Column]) -> Column:
    """Name of the first parameter whose flag holds, in parameter order."""
    return F.coalesce(*[F.when(flag, F.lit(p)) for p, flag in flags.items()])


def per_parameter(make) -> dict[str, Column]:
    return {p: make(p) for p in PARAMETERS}
