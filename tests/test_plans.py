"""Balanced ordering, exact medians, debouncing and streams against brute force."""

import random
import re
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rotaflow.operators import features, status
from rotaflow.operators.debounce import debounce
from rotaflow.plans.medians import medians
from rotaflow.plans.timeline import Timeline
from rotaflow.session import cut_lineage
from rotaflow.sources.writers import save_bucketed
from rotaflow.streaming import live
from rotaflow.streaming.edge import stream_decisions
from rotaflow.streaming.ordered import Delays, arriving
from suite.queries import Given

START = datetime(2024, 1, 1)


@pytest.mark.parametrize("shape", ["distinct", "two values", "clustered"])
def test_medians_of_hot_keys(spark, shape):
    rng = random.Random(1)
    make = {
        "distinct": lambda i: rng.uniform(-5, 5),
        "two values": lambda i: float(i % 2),
        "clustered": lambda i: 1e6 if i == 0 else rng.gauss(1, 1e-6),
    }[shape]
    hot = [make(i) for i in range(500)]
    rows = [("hot", v) for v in hot] + [("cold", 1.0), ("cold", 4.0), ("cold", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    made = {r["k"]: r["m"] for r in medians(df, "k", {"m": F.col("v")}, max_rows=40).collect()}
    assert made == {"hot": pytest.approx(statistics.median(hot), rel=1e-12), "cold": 2.5}


def test_slices_are_bounded_and_whole(spark):
    """One machine has nearly all rows, most of them within one hour."""
    hot = [("hot", START + timedelta(seconds=i // 2), i) for i in range(3000)]
    hot += [("hot", START + timedelta(days=i), 10_000 + i) for i in range(1, 200)]
    cold = [("cold", START + timedelta(days=i), i) for i in range(50)]
    df = spark.createDataFrame(hot + cold, "well_id string, ts timestamp_ntz, reading_id long")
    timeline = Timeline.of(df, max_rows=200, halo=30)
    assert timeline.sliced
    attached = timeline.attach(df)
    sizes = attached.where("_core").groupBy("well_id", "_slice").count()
    assert sizes.agg(F.max("count")).first()[0] <= 400
    numbered = timeline.core(timeline.number(df))
    made = [
        (r["reading_id"], r["reading_number"])
        for r in numbered.where("well_id = 'hot'").orderBy("ts", "reading_id").collect()
    ]
    ordered = sorted(hot, key=lambda r: (r[1], r[2]))
    assert made == [(r[2], i + 1) for i, r in enumerate(ordered)]
    assert numbered.where("well_id = 'cold'").count() == 50


def test_classification_exchanges_readings_once(spark, folder, capsys):
    given = Given(spark, folder)
    machines = cut_lineage(given.fleet)  # the machine dimension has an exchange of its own
    status.analyse(given.telemetry, machines, given.timeline).select(
        "well_id", "ts", "status"
    ).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning(well_id") == 1
    assert plan.count("+- Sort [") == 1


def test_features_exchange_readings_once(spark, folder, capsys):
    from rotaflow.operators.features import engineer_features

    given = Given(spark, folder)
    machines = cut_lineage(given.fleet)
    engineer_features(status.deviation_pct(given.telemetry, machines), given.timeline).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning(well_id") == 1
    assert plan.count("+- Sort [") == 1


def test_rolling_moments_read_few_rows(spark, folder, capsys):
    """Frames that are read again for every reading are short, and long ones need one sort less than they have orders."""
    given = Given(spark, folder)
    features.engineer_features(given.deviations, given.timeline).explain()
    frames = {int(n) for n in re.findall(r"RowFrame, -(\d+), currentrow", capsys.readouterr().out)}
    assert max(frames) < features.SMALLEST
    long = features.engineer_features(given.deviations, given.timeline, (35, 480))
    long.select("ts", "flow_rolling_std_480h").explain()
    assert len(re.findall(r"\+- Sort \[well_id#\d+ ASC NULLS FIRST, .*ts#", capsys.readouterr().out)) == 3


def test_united_moments_against_brute_force(spark):
    """Missing values, a constant stretch and a machine shorter than its window."""
    rng = random.Random(8)
    rows = [(f"Well {m}", START + timedelta(hours=i), i, None if rng.random() < 0.2 else 7.3 if i % 90 < 45 else rng.uniform(-80, 80)) for m, n in enumerate((400, 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "well_id string, ts timestamp_ntz, reading_id int, x double")
    df = df.select("well_id", "ts", "reading_id", *[F.col("x").alias(c) for c in status.DEVIATIONS])
    names = [f"flow_rolling_{s}_{n}h" for n in (24, 168) for s in ("mean", "std", "max", "min")]
    for max_rows in (10**6, 60):
        made = features.engineer_features(df, Timeline.of(df, max_rows=max_rows)).select("well_id", "reading_id", *names)
        for got in made.collect():
            own = [r[3] for r in rows if r[0] == got["well_id"]]
            for n in (24, 168):
                frame = [x for x in own[max(0, got["reading_id"] + 1 - n) : got["reading_id"] + 1] if x is not None]
                want = (statistics.fmean(frame) if frame else None, statistics.stdev(frame) if len(frame) > 1 else 0.0, max(frame, default=None), min(frame, default=None))
                assert [got[f"flow_rolling_{s}_{n}h"] for s in ("mean", "std", "max", "min")] == pytest.approx(list(want), abs=1e-9)


def test_bucketed_table_needs_no_exchange(spark, folder, capsys):
    given = Given(spark, folder)
    save_bucketed(given.telemetry.drop("reading_id"), "bucketed_readings", 4)
    table = spark.table("bucketed_readings").withColumn("reading_id", F.lit(0))
    timeline = Timeline.of(table)
    table.withColumn("n", timeline.row_number()).explain()
    assert "Exchange" not in capsys.readouterr().out
    spark.sql("DROP TABLE bucketed_readings")


def brute_debounce(rows, minutes, reset=False, bypass=False):
    """rows: (well, ts, id, mask, level) -> {id: blocked parameter or None}."""
    names = ("flow", "head", "power", "efficiency")
    out, last, level_of = {}, {}, {}
    for well, ts, rid, mask, level in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if mask == 0:
            if reset:
                last = {k: v for k, v in last.items() if k[0] != well}
                level_of.pop(well, None)
            continue
        hit = [n for i, n in enumerate(names) if mask >> i & 1]
        free = bypass and level > level_of.get(well, 0)
        near = [
            n for n in hit
            if (well, n) in last and ts - last[well, n] < timedelta(minutes=minutes)
        ]
        out[rid] = near[0] if near and not free else None
        if out[rid] is None:
            level_of[well] = level
            for n in hit:
                last[well, n] = ts
    return out


def alarm_rows(seed, count=400):
    rng = random.Random(seed)
    rows, ts = [], START
    for i in range(count):
        ts += timedelta(minutes=rng.choice([1, 5, 20, 59, 60, 61, 130]))
        mask = rng.choice([0, 1, 2, 3, 4, 8, 9, 12])
        rows.append((f"Well {rng.randrange(3)}", ts, i, mask, 0 if mask == 0 else rng.randint(1, 3)))
    return rows


def alarm_frame(spark, rows):
    names = ["Normal", "Warning", "Critical", "Failure"]
    return spark.createDataFrame(
        [(w, t, i, m, names[level]) for w, t, i, m, level in rows],
        "well_id string, ts timestamp_ntz, reading_id long, mask int, status string",
    )


@pytest.mark.parametrize("max_rows", [10**6, 20])
@pytest.mark.parametrize("reset, bypass", [(False, False), (True, False), (False, True)])
def test_debounce(spark, max_rows, reset, bypass):
    rows = alarm_rows(5)
    frame = alarm_frame(spark, rows)
    timeline = Timeline.of(frame, max_rows=max_rows)
    made = debounce(frame, timeline, 60, reset, bypass).collect()
    assert {r["reading_id"]: r["blocked_by"] for r in made} == brute_debounce(
        rows, 60, reset, bypass
    )


@pytest.mark.parametrize("reset, bypass", [(False, False), (True, True)])
@pytest.mark.parametrize("masks", [(1,), (1, 2, 3, 8, 12)])
def test_debounce_of_a_chain_without_pauses(spark, monkeypatch, masks, reset, bypass):
    """An alarm a minute, for ever in step, so states never coincide; and mixed ones, whose reports overlap."""
    rng = random.Random(2)
    rows = [("Well 1", START + timedelta(minutes=i if len(masks) == 1 else i + i % 3), i, rng.choice(masks), rng.randint(1, 3)) for i in range(3000)]
    if reset:
        rows[1500] = (*rows[1500][:3], 0, 0)
    rows += [("Well 2", START + timedelta(minutes=70 * i), 5000 + i, 1, 1) for i in range(300)]
    frame = alarm_frame(spark, rows).repartition(4)
    timeline = Timeline.of(frame, max_rows=200)
    assert timeline.sliced
    made = debounce(frame, timeline, 60, reset, bypass).collect()
    assert {r["reading_id"]: r["blocked_by"] for r in made} == brute_debounce(rows, 60, reset, bypass)
    assert len(made) == sum(1 for r in rows if r[3])


def test_stream_debounce_over_many_batches(spark, tmp_path):
    """State carries over micro-batches: 4 files, one per batch, and a last one that ends the stream."""
    rows = alarm_rows(9)
    source = str(tmp_path / "in")
    # an alarm: Spark filters Normal readings before the watermark, so they do not move it
    end = ("end", START + timedelta(days=9999), 99_999, 1, 1)
    for part in (*(rows[i : i + 100] for i in range(0, len(rows), 100)), [end]):
        alarm_frame(spark, part).coalesce(1).write.mode("append").parquet(source)
    stream = (
        spark.readStream.schema(alarm_frame(spark, rows[:1]).schema)
        .option("maxFilesPerTrigger", 1)
        .parquet(source)
    )
    delays = Delays()
    made = live.run_to_table(
        stream_decisions(arriving(stream, delays), delays, 60), str(tmp_path / "out"), str(tmp_path / "state")
    )
    assert {r["reading_id"]: r["blocked_by"] for r in made.collect()} == brute_debounce(rows, 60)
