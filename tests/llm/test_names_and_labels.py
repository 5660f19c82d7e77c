"""Columns whose names clash with inner ones, and labels that contradict each other or are missing."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from rotaflow.llm import quality
from rotaflow.session import tune

NAMES = ["doc_id", "text", "_row", "_size", "_bag", "_same", "_id", "_content", "_kept", "_verdict", "quality", "a`b", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    tune(spark)
    good = " ".join(f"word{i} and more{i * 7 % 13}" for i in range(40))
    rows = [(i, f"{good} {i} {i * 3} ending{i}.", *[f"{n}{i}" for n in NAMES[2:-1]], 1) for i in range(6)]
    rows += [(10, rows[0][1], *rows[0][2:])]
    return spark.createDataFrame(rows, ", ".join(f"`{n.replace('`', '``')}` {'bigint' if n in ('doc_id', 'n_chars') else 'string'}" for n in NAMES))


def test_names_of_any_kind_pass_all_stages(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, given = docs, {r["doc_id"]: tuple(r) for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == NAMES
        for r in now.collect():
            assert tuple(r)[2:-1] == given[r["doc_id"]][2:-1]
    assert {r["doc_id"] for r in now.collect()} <= set(range(6))


def test_trees_of_real_contradicting_and_missing_labels(spark):
    good = [f"a plain text of number {i} with words that differ like w{i} and v{i * 7} and others" for i in range(120)]
    bad = [f"BUY NOW {i}!!! $$$ ### CLICK HERE!!! {i} && %% WIN {i * 3}!!!" for i in range(120)]
    rows = list(enumerate([*good, *bad, None, ""])) + [(5, "another text of the same id"), (None, "no id at all here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    labels = [(i, 1) for i in range(0, 120, 2)] + [(i, 0) for i in range(120, 240, 2)] + [(2, 0), (None, 1), (4, None), (5, 1), (999, 1), (240, 0)]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int")
    trees = quality.train(docs, table)
    again = quality.train(docs.repartition(2), table.repartition(3))
    verdicts = {r["doc_id"]: r["quality"] for r in quality.judge(docs.where("doc_id IS DISTINCT FROM 5"), trees).collect()}
    held = [i for i in range(1, 240, 2) if i != 5]
    assert sum((verdicts[i]["score"] >= 0) == (i < 120) for i in held) >= 0.95 * len(held)
    assert (trees.limit == again.limit).all() and (trees.value == again.value).all()  # the order of rows does not matter
    assert quality.train(docs, table.where("quality = 1")) is None and quality.train(docs.where("doc_id = -1"), table) is None
    assert quality.train(docs, table.where("doc_id IS NULL")) is None
    limited = quality.train(docs, table, sample_rows=40)
    assert limited is not None and len(limited.root) == len(trees.root)
    assert quality.judge(docs, trees).where(F.col("quality.kept") & F.col("quality.base_failed")).count() == 0
