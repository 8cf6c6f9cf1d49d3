"""Disk and memory that long runs give back."""

from __future__ import annotations

import time

import corpus_pipeline
from conftest import DATA
from pyspark.sql import functions as F

from textloom.llm import jaccard_join
from textloom.session import give_back


def files(spark):
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()


def test_shuffles_of_frames_that_are_gone_are_deleted(spark):
    df = spark.range(0, 10_000, 1, 8).groupBy((F.col("id") % 97).alias("k")).count()
    assert df.count() == 97
    many = files(spark)
    assert many
    del df
    give_back(spark)
    until = time.time() + 20
    while files(spark) >= many and time.time() < until:
        time.sleep(0.2)
    assert files(spark) < many


def test_every_stage_begins_with_memory_given_back(spark, monkeypatch):
    called = []
    monkeypatch.setattr(corpus_pipeline, "give_back", called.append)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(20)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[2:]):
        stage(spark, docs, DATA)
        assert len(called) == k + 1, name


def test_rounds_of_the_join_delete_their_shuffles(spark, monkeypatch):
    called = []
    monkeypatch.setattr(jaccard_join, "sweep", called.append)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "x"])), (3, "other words here alone now")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_documents(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    assert len(called) >= 2
