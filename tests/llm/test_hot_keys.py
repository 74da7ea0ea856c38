"""Joins on hot keys are split among tasks, and results don't hang on ANSI."""

import random

import pytest
from pyspark.sql import functions as F

from loomwright.llm import components, linededup

LINE = "a line that is long enough to be a passage of its own, in all documents"
LOW = {
    "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def low(spark):
    for k, v in LOW.items():
        spark.conf.set(k, v)
    yield
    for k in LOW:
        spark.conf.unset(k)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_line(spark, low):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit(LINE + "\nown line of document number "), F.col("id").cast("string"), F.lit(" and of no other one")).alias("text")).repartition(16)
    hits = linededup.repeated_lines(docs)
    assert "skew=true" in final_plan(hits) and hits.count() == 19999


def test_hot_root(spark, low, monkeypatch):
    """A star of 20,000 leaves and some chains: no join on its root stays in one task."""
    plans, real = [], components.checkpoint

    def watched(df):
        plans.append(final_plan(df))
        return real(df)

    monkeypatch.setattr(components, "checkpoint", watched)
    edges = [(0, i) for i in range(1, 20000)] + [(30000 + i, 30001 + i) for i in range(20)]
    random.Random(1).shuffle(edges)
    found = components.components(spark.createDataFrame(edges, "u long, v long").repartition(16))
    assert any("skew=true" in p for p in plans)
    assert {r["root"] for r in found.collect()} == {0, 30000} and found.count() == 19999 + 20


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_dropped_lines_without_ansi(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        docs = spark.createDataFrame([(i, f"{LINE}\nmine {i}") for i in range(6)] + [(8, None), (9, "one\ntwo")], "doc_id long, text string")
        got = {r["doc_id"]: tuple(r["line_dedup"])[:2] for r in linededup.drop_repeated_lines(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    assert got == {**{i: (2, 1) for i in range(5)}, 5: (2, 0), 8: (1, 0), 9: (2, 0)}
