"""Whole runs as one lazy plan each: packaging, repair phases, scoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curate, neardup


def package(records: DataFrame, bench: DataFrame, checks: dict[str, Column], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Adds exact_match, jaccard_max, reasons and decision (accept, reject, quarantine); nothing is raised or dropped."""
    texts = records.select(id_col, F.col(text_col).alias("text"))
    found = neardup.contamination(texts, bench, id_col).select(id_col, "jaccard_max", F.col("decision").alias("_near"))
    exact = neardup.exact_matches(texts, bench, id_col)
    out = records.join(found, id_col).join(exact, id_col).withColumn("reasons", curate.violations(checks))
    return out.withColumn("decision", F.when(F.col("exact_match") | (F.col("_near") == "reject"), "reject").when(F.size("reasons") > 0, "quarantine").otherwise("accept")).drop("_near")


def run_phases(spark: SparkSession, phases: list[tuple[str, Callable[[], object]]], skip: tuple[str, ...] = ()) -> DataFrame:
    """(phase, status): runs phases in order and stops at the first failure; passed, failed, skipped or not_run."""
    rows, over = [], False
    for name, f in phases:
        if over or name in skip:
            rows.append((name, "not_run" if over else "skipped", None))
            continue
        try:
            f()
            rows.append((name, "passed", None))
        except Exception as e:  # the report says so, and later phases don't run
            rows.append((name, "failed", str(e)[:300]))
            over = True
    return spark.createDataFrame(rows, "phase string, status string, error string")


def score_families(predictions: DataFrame, rules: dict[str, Column], family: str = "family") -> DataFrame:
    """(family, metric, value): each family's own 0/1 or 0..1 rule averaged."""
    value = None
    for name, rule in rules.items():
        c = F.when(F.col(family) == name, rule.cast("double"))
        value = c if value is None else F.coalesce(value, c)
    return predictions.withColumn("_v", value).groupBy(family).agg(F.coalesce(F.avg("_v"), F.lit(0.0)).alias("value"), F.count("*").alias("n")).select(family, F.lit("score").alias("metric"), F.round("value", 6).alias("value"), "n")
