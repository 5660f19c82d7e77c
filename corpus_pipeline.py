"""The corpus pipeline: quality rules, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. The first three return the columns of
documents; the last returns a row per packed piece. ``run`` stores what a stage returns in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaflow.llm import minhash, packing, quality, substring
from rotaflow.llm.common import quoted, stored, tokenizer, unused
from rotaflow.session import tune

ORACLE_SQL = None  # the trees and the token ids are not expressible in SQL; tests hold each stage against brute force


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the trees, fitted on the labels, reject go."""
    tune(spark)
    trees = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    verdict = unused(docs.columns, "_verdict")
    return quality.judge(docs, trees, into=verdict).where(F.col(verdict)["kept"]).select(*[quoted(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    tune(spark)
    kept = minhash.near_duplicates(docs).where("_keeper")
    return minhash.unpacked(kept, docs.columns, docs.schema)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a window of 20 that occurs earlier go; all documents stay."""
    tune(spark)
    return substring.cleaned_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    tune(spark)
    return packing.pack(packing.pieces(docs, tokenizer("byte_bpe_50k.json")), 1024)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
