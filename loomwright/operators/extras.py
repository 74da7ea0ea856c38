"""Smaller operators: multi-hop scores, guards, rates, targets, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import occurrences
from .score import mean_or_zero, set_f1


def multihop_scores(df: DataFrame, answer: str, gold: str, sources: str, gold_sources: str) -> DataFrame:
    """One row: exact match (case and outer space ignored), F1 of the source sets, and the mean of their products."""
    norm = lambda c: F.lower(F.trim(c))
    em = F.coalesce(norm(answer) == norm(gold), F.lit(False)).cast("double")
    each = df.select(em.alias("_em"), set_f1(F.col(sources), F.col(gold_sources)).alias("_f1"))
    return each.agg(mean_or_zero(F.col("_em")).alias("em"), mean_or_zero(F.col("_f1")).alias("source_f1"), mean_or_zero(F.col("_em") * F.col("_f1")).alias("joint"), F.count("*").alias("n"))


def mean_logprob(tokens: DataFrame, keys: list[str], logprob: str = "logprob") -> DataFrame:
    return tokens.groupBy(*keys).agg(F.avg(logprob).alias("mean_logprob"), F.count(logprob).alias("n_tokens"))


def share_guard(df: DataFrame, holds: Column, least: float) -> DataFrame:
    """One row: how many rows the condition holds for, their share, and whether it is large enough (of no rows: not)."""
    return df.agg(F.count_if(holds).alias("n_holds"), F.count("*").alias("n")).select("n_holds", "n", F.round(F.coalesce(F.try_divide("n_holds", "n"), F.lit(0.0)), 6).alias("share"), F.coalesce(F.try_divide("n_holds", "n") >= least, F.lit(False)).alias("ok"))


def decisions(df: DataFrame, decision: Column, notes: Column) -> DataFrame:
    """One row: accepted, rejected and quarantined rows, and those with a reviewer's note."""
    return df.agg(*[F.count_if(decision == d).alias(d) for d in ("accept", "reject", "quarantine")], F.count_if(notes.isNotNull() & (notes != "")).alias("with_notes"))


def rates(log: DataFrame, accepted: Column, seconds: Column, cost: Column, by: str) -> DataFrame:
    """(by, accepted, per_second, cost, cost_per_row); a rate over nothing is null."""
    g = log.groupBy(by).agg(F.sum(accepted).alias("accepted"), F.sum(seconds).alias("_s"), F.round(F.sum(cost), 6).alias("cost"))
    return g.select(by, "accepted", F.round(F.try_divide("accepted", "_s"), 6).alias("per_second"), "cost", F.round(F.try_divide("cost", "accepted"), 6).alias("cost_per_row"))


def join_by_prefix(df: DataFrame, rules: DataFrame, text: str, rule_text: str, order: str, chars: int = 200) -> DataFrame:
    """Left join on the first characters; of several rules for a prefix, the last in order."""
    others = [c for c in rules.columns if c not in (rule_text, order)]
    last = rules.groupBy(F.substring(rule_text, 1, chars).alias("_p")).agg(F.max_by(F.struct(*others), order).alias("_r"))
    return df.withColumn("_p", F.substring(text, 1, chars)).join(last, "_p", "left").select(*df.columns, "_r.*")


def fixed_weights(counts: DataFrame, key: str, table: dict[str, float], default: float = 0.0) -> DataFrame:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return counts.withColumn("weight", F.coalesce(m[F.col(key)], F.lit(default)))


def raised_targets(weighted: DataFrame, n: str = "n", weight: str = "weight", times: float = 3.0) -> DataFrame:
    """Adds target: n times the weight's ratio to the largest weight, raised `times`-fold, and n at least."""
    t = F.floor(F.col(n) * F.col(weight) * F.lit(times) / F.max(weight).over(Window.partitionBy(F.lit(0)))).cast("long")
    return weighted.withColumn("target", F.greatest(t, F.col(n)))


def provenance(df: DataFrame, id_col: str = "id", sources: str = "sources") -> DataFrame:
    """A row for each source of an item."""
    return df.select(id_col, F.explode(sources).alias("_s")).select(id_col, "_s.url", "_s.license", "_s.used_for")


def has_marker(x: Column, markers: list[str], times: int = 1) -> Column:
    """Whether the text has the markers so many times in all."""
    n = F.lit(0).cast("long")
    for m in markers:
        n = n + occurrences(x, m)
    return n >= times


def by_substring(x: Column, table: list[tuple[str, str]], default: str | None = None) -> Column:
    """Label of the first listed part that the text has."""
    out = F.lit(default)
    for part, label in reversed(table):
        out = F.when(F.contains(x, F.lit(part)), label).otherwise(out)
    return out


def numeric_suffix(x: Column, pattern: str = r"(\d+)$") -> Column:
    """The number at a name's end: newest by number, not by text (v10 after v9)."""
    s = F.regexp_extract(x, pattern, 1)
    return F.when(s != "", s.cast("long"))


def status_counts(df: DataFrame, status: Column, names: tuple[str, ...] = ("OK", "WARN", "FAIL")) -> DataFrame:
    """(status, n) of all names, with zeros."""
    wanted = df.sparkSession.createDataFrame([(n,) for n in names], "status string")
    return wanted.join(df.groupBy(status.alias("status")).agg(F.count("*").alias("_n")), "status", "left").select("status", F.coalesce("_n", F.lit(0)).cast("long").alias("n"))
