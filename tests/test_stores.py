"""Tables of parts: the keyed outbox, retention by day, the rank index, and the state carried from batch to batch."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rotaflow.plans import carry
from rotaflow.sources.log_store import DatedLog, RankedLog
from rotaflow.sources.manifest import Conflict, Part, PartTable
from rotaflow.sources.outbox import Outbox, with_reported
from suite.queries import Given

START = datetime(2024, 1, 1)


def payloads(spark, n, start=0):
    rows = [(f"Well {i % 3}", START + timedelta(minutes=i), f"text {i}", {"a": i}) for i in range(start, n)]
    return spark.createDataFrame(rows, "well_id string, ts timestamp_ntz, description string, more map<string,long>")


def test_outbox_holds_each_reading_once(spark, tmp_path):
    box = Outbox(spark, str(tmp_path / "box"), payloads(spark, 1).schema, buckets=4)
    box.add(payloads(spark, 20))
    box.add(payloads(spark, 20))  # the same batch under another run
    again = payloads(spark, 30, 10).withColumn("description", F.lit("changed"))
    box.add(again.unionByName(again))
    assert box.read().count() == 30 and box.read().where("description = 'changed'").count() == 10
    told = lambda status, low, high: payloads(spark, high, low).select("well_id", "ts", F.lit(status).alias("delivery_status"))
    box.mark(told("sent", 0, 5).unionByName(told("failed", 3, 8)))
    box.mark(told("unsent", 0, 2).unionByName(told("sent", 7, 8)).unionByName(told("sent", 900, 901)))
    found = {r["delivery_status"]: r["count"] for r in box.read().groupBy("delivery_status").count().collect()}
    assert found == {"sent": 6, "failed": 2, "unsent": 22} and box.pending().count() == 24
    box.add(payloads(spark, 30))
    assert box.read().where("delivery_status = 'sent'").count() == 6
    results = payloads(spark, 40).withColumn("reported_to_api", F.lit(False))
    assert with_reported(results, box.read()).where("reported_to_api").count() == 6


def test_outbox_leaves_what_is_there(spark, tmp_path):
    """Adding and marking do not write again what is there already."""
    box = Outbox(spark, str(tmp_path / "box"), payloads(spark, 1).schema, buckets=2)
    nothing = spark.createDataFrame([(None, None, "no key", None), (None, None, "a key", None)], payloads(spark, 1).schema)
    box.add(payloads(spark, 20).unionByName(nothing))
    first = box.table.parts()
    box.add(payloads(spark, 30).unionByName(nothing))
    second = box.table.parts()
    assert first.items() <= second.items() and sum(p.rows for p in second.values()) == 31
    told = box.read().select("well_id", "ts", F.lit("sent").alias("delivery_status"))
    box.mark(told.where("well_id IS NULL OR well_id = 'Well 1'"))
    assert box.table.parts() == second and box.read().where("delivery_status = 'sent'").count() == 11
    assert [r["description"] for r in box.read().where("well_id IS NULL").collect()] == ["a key"]


def test_outbox_unites_the_pieces_of_a_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("rotaflow.sources.outbox.PIECES", 3)
    box = Outbox(spark, str(tmp_path / "box"), payloads(spark, 1).schema, buckets=1)
    for k in range(5):
        box.add(payloads(spark, 4 * k + 4, 4 * k))
    assert len(box.table.parts()) == 2 and box.read().count() == 20 == box.read().select("well_id", "ts").distinct().count()


def test_two_writers_of_a_version_do_not_both_win(spark, tmp_path):
    table = PartTable(spark, str(tmp_path / "t"), payloads(spark, 1).schema)
    assert table.version() == 0 and table.read().count() == 0
    made = table.write_parts(payloads(spark, 5), F.col("well_id"))
    assert sorted((p.key, p.rows) for p in made) == [("Well 0", 2), ("Well 1", 2), ("Well 2", 1)] or len(made) == 3
    assert table.commit(0, made) == 1
    with pytest.raises(Conflict):
        table.commit(0, [Part("x", "y", 0)])
    assert table.version() == 1 and len(table.parts()) == 3


def test_retention_touches_the_boundary_day_only(spark, tmp_path):
    log = spark.range(240).select("id", (F.lit(START).cast("timestamp_ntz") + F.expr("make_dt_interval(0, cast(id as int))")).alias("ts"))
    store = DatedLog(spark, str(tmp_path / "log"), log.schema)
    store.append(log.where("id < 200"))
    store.append(log.where("id >= 200"))
    before, reader = store.table.parts(), store.read()
    now = START + timedelta(days=9, hours=12)
    store.retain(now, 5)
    after = store.table.parts()
    assert store.read().exceptAll(log.where(F.col("ts") >= F.lit(now - timedelta(days=5)))).isEmpty()
    assert store.read().count() == log.where(F.col("ts") >= F.lit(now - timedelta(days=5))).count()
    changed = [k for k in after if after[k] != before[k]]
    assert changed == ["2024-01-05"] and set(before) - set(after) == {f"2024-01-0{d}" for d in range(1, 5)}
    assert reader.count() == 240


def test_deep_pages_read_few_ranges(spark, tmp_path):
    log = spark.range(5000).select("id", (F.lit(START).cast("timestamp_ntz") + F.expr("make_dt_interval(0, 0, cast(id % 700 as int))")).alias("ts"))
    store = RankedLog(spark, str(tmp_path / "log"), log.schema)
    store.build(log.repartition(7), 20)
    assert store.total() == 5000
    every = [tuple(r) for r in log.orderBy(F.desc("ts"), F.desc("id")).collect()]
    for skip, take in ((0, 30), (2490, 50), (4990, 50), (6000, 5)):
        page = store.page(skip, take)
        assert [tuple(r) for r in page.collect()] == every[skip : skip + take]
        assert len({f.rsplit("/", 2)[1] for f in page.inputFiles()}) <= 2


def test_a_batch_reads_itself_and_the_table(spark, folder, tmp_path):
    given, path = Given(spark, folder), str(tmp_path / "carry")
    cuts = ["1900-01-01", "1998-01-01", "2000-01-01", "2200-01-01"]
    for k, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        given.telemetry.where(f"ts >= timestamp_ntz'{low}' AND ts < timestamp_ntz'{high}'").write.parquet(f"{tmp_path}/in/{k}")
        batch = spark.read.parquet(f"{tmp_path}/in/{k}")
        made = carry.advance(batch, given.fleet, path, k)
        files = made.classified.inputFiles()
        read = {f.split("/in/")[1].split("/")[0] for f in files if "/in/" in f} | {f.split("/carry/")[1].split("/")[0] for f in files if "/carry/" in f}
        assert read == {str(k)} | ({f"version={k - 1}"} if k else set())
        assert made.aside.count() == 0
    state = {r["well_id"]: r["readings"] for r in carry.read_state(spark, path).collect()}
    again = carry.advance(batch, given.fleet, path, 2)  # the last batch runs again
    assert {r["well_id"]: r["readings"] for r in carry.read_state(spark, path).collect()} == state
    assert again.classified.count() == batch.count()
    late = carry.advance(batch, given.fleet, path, 3)  # all of it is old by now
    assert late.classified.count() == 0 and late.aside.count() == batch.count()
    assert {r["well_id"]: r["readings"] for r in carry.read_state(spark, path).collect()} == state
    carry.drop_versions(spark, path, keep=1)
    assert carry.versions(spark, path) == [3]
    with pytest.raises(ValueError, match="no committed version"):
        carry.read_state(spark, path, 0)
