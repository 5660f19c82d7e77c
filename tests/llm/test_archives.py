"""Archives: damaged members are told, large payloads and repeated ids are read back."""

from __future__ import annotations

import glob
import random

from pyspark.sql import functions as F

from rotaflow.llm import warc
from rotaflow.session import fresh_path


def _written(spark, rows):
    path = fresh_path(spark, "archives")
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    warc.write_archives(warc.plan_records(pages), path)
    return path


def test_damaged_members_are_told(spark):
    rng = random.Random(3)
    path = _written(spark, [(i, "u", rng.randbytes(300).hex()) for i in range(40)])
    places = sorted((r["path"], r["place"]) for r in warc.read_archives(spark, path).collect())
    for size in (1000, 1 << 20):
        assert warc.rejected_spans(spark, path, size).count() == 0
    name = places[0][0]
    own = [p for n, p in places if n == name]
    file = glob.glob(path.removeprefix("file:") + "/part-*")
    raw = {f: bytearray(open(f, "rb").read()) for f in file}
    victim = next(f for f in file if name.endswith(f.rsplit("/", 1)[1]))
    hit = (0, len(own) // 2, len(own) - 1)
    for k in hit:
        raw[victim][own[k] + 200] ^= 0x55
    open(victim, "wb").write(raw[victim])
    ends = [*own[1:], len(raw[victim])]
    for size in (1000, 1 << 20):
        assert warc.read_archives(spark, path, size).count() == 40 - len(hit)
        found = sorted((r["start"], r["end"]) for r in warc.rejected_spans(spark, path, size).collect())
        assert found == [(own[k], ends[k]) for k in hit]


def test_large_payloads_and_repeated_ids(spark):
    body = "x" * (17 << 20)
    rows = [(1, "u", body), (2, "u", "y" * 200), (2, "v", "y" * 200), (3, "w", "y" * 200), (4, None, None)]
    path = _written(spark, rows)
    found = warc.pages_of(warc.read_archives(spark, path)).select("page_id", "payload_bytes", "record_type", "refers_to").collect()
    assert sorted(map(tuple, found)) == [(1, 17 << 20, "response", None), (2, 200, "response", None), (2, 200, "response", None), (3, 200, "revisit", 2), (4, 0, "response", None)]
    assert warc.rejected_spans(spark, path).count() == 0
    empty = spark.createDataFrame([], "page_id bigint, url string, html string, place int, headers string")
    none = fresh_path(spark, "archives")
    warc.write_archives(warc.plan_records(empty.withColumn("digest", F.lit("x"))), none)
    assert warc.read_archives(spark, none).count() == 0 and warc.rejected_spans(spark, none).count() == 0
