"""Judging and voting over predictions: accuracy, F1, pass rates, votes, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def mean_or_zero(x: Column, when: Column | None = None) -> Column:
    v = F.when(when, x.cast("double")) if when is not None else x.cast("double")
    return F.coalesce(F.avg(v), F.lit(0.0))


def strict_loose(checks: DataFrame, prompt: str = "prompt_id", ok: str = "ok") -> DataFrame:
    """One row: strict (all of a prompt's constraints), loose (mean of prompts' means), n_prompts."""
    per = checks.groupBy(prompt).agg(F.bool_and(ok).alias("_all"), F.avg(F.col(ok).cast("int")).alias("_mean"))
    return per.agg(mean_or_zero(F.col("_all").cast("int")).alias("strict"), mean_or_zero(F.col("_mean")).alias("loose"), F.count("*").alias("n_prompts"))


def set_f1(predicted: Column, gold: Column) -> Column:
    """F1 of two sets; 1 if both are empty, 0 if one is."""
    p, g = F.array_distinct(predicted), F.array_distinct(gold)
    both = F.size(F.array_intersect(p, g))
    return F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).when(both == 0, 0.0).otherwise(2.0 * both / (F.size(p) + F.size(g)))


def rollup_accuracy(df: DataFrame, by: str, ok: Column, total: str = "overall") -> DataFrame:
    """(by, n, accuracy) of every group, and of all rows (not the mean of the groups) as `total`."""
    out = df.withColumn("_ok", ok.cast("int")).rollup(by).agg(F.count("*").alias("n"), F.avg("_ok").alias("accuracy"), F.grouping(by).alias("_g"))
    return out.select(F.when(F.col("_g") == 1, total).otherwise(F.coalesce(F.col(by).cast("string"), F.lit("unknown"))).alias(by), "n", "accuracy")


def pass_rate(df: DataFrame, passed: Column, failed_to_run: Column) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_if(passed).alias("n_pass"), F.count_if(failed_to_run).alias("n_error"), mean_or_zero(F.coalesce(passed, F.lit(False)).cast("int")).alias("pass_at_1"))


def majority_vote(samples: DataFrame, item: str, answer: str, order: str) -> DataFrame:
    """(item, vote, votes): the most frequent answer, the first seen of equal ones; null answers don't vote."""
    c = samples.where(F.col(answer).isNotNull()).groupBy(item, answer).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    best = c.groupBy(item).agg(F.max_by(answer, F.struct("_n", -F.col("_first"))).alias("vote"), F.max("_n").alias("votes"))
    return samples.select(item).distinct().join(best, item, "left").select(item, "vote", F.coalesce("votes", F.lit(0)).alias("votes"))


def confidence_vote(samples: DataFrame, item: str, answer: str, logprob: str, order: str, drop: float = 0.25) -> DataFrame:
    """(item, vote, weight): the least sure share is dropped, the rest vote with exp(log-probability)."""
    w = Window.partitionBy(item).orderBy(F.desc(logprob), order)  # for the count too, so that a task sorts its rows once
    some = samples.where(F.col(answer).isNotNull())
    n = F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = some.select("*", n.alias("_n"), F.row_number().over(w).alias("_r"))
    kept = ranked.where(F.col("_r") <= F.greatest(F.floor(F.col("_n") * F.lit(1 - drop)), F.lit(1)))
    sums = kept.groupBy(item, answer).agg(F.round(F.sum(F.exp(logprob)), 6).alias("_w"), F.min(order).alias("_first"))
    return sums.groupBy(item).agg(F.max_by(answer, F.struct("_w", -F.col("_first"))).alias("vote"), F.max("_w").alias("weight"))


def best_of_n(scores: DataFrame, item: str, candidate: str, score: str) -> DataFrame:
    """(item, best, best_score, first_score): the best candidate, the first of equal ones; a missing score is 0."""
    s = F.coalesce(F.col(score), F.lit(0.0))
    return scores.groupBy(item).agg(F.max_by(candidate, F.struct(s, -F.col(candidate))).alias("best"), F.max(s).alias("best_score"), F.min_by(s, candidate).alias("first_score"))


def pairwise_winner(forward: Column, swapped: Column) -> Column:
    """The winner if both orders agree (the second names A what the first names B), else tie."""
    back = F.when(swapped == "A", "B").when(swapped == "B", "A").otherwise(swapped)
    return F.when(forward == back, forward).otherwise("tie")


def baseline_delta(scores: DataFrame, baselines: DataFrame, keys: list[str], score: str = "score", base: str = "baseline") -> DataFrame:
    """Adds delta and its text: +x, -x or `not published` where there is no baseline."""
    d = F.round(F.col(score) - F.col(base), 4)
    out = scores.join(baselines, keys, "left").withColumn("delta", d)
    return out.withColumn("delta_text", F.when(F.col("delta").isNull(), "not published").otherwise(F.format_string("%+.4f", "delta")))


def score_candidates(candidates: DataFrame, scores: DataFrame, prompt: str, candidate: str, score: str) -> DataFrame:
    """Every (prompt, candidate) with its score; one without a score gets 0."""
    return candidates.join(scores.select(prompt, candidate, score), [prompt, candidate], "left").withColumn(score, F.coalesce(score, F.lit(0.0)))


def accuracy_by_method(df: DataFrame, method: Column, ok: Column, methods: tuple[str, ...] = ("strict", "rational", "judge")) -> DataFrame:
    """One row: accuracy, n, and how many rows each method settled."""
    return df.agg(mean_or_zero(F.coalesce(ok, F.lit(False)).cast("int")).alias("accuracy"), F.count("*").alias("n"), *[F.count_if(method == m).alias(f"n_{m}") for m in methods])


def choice_split_accuracy(df: DataFrame, is_choice: Column, ok: Column) -> DataFrame:
    """One row: accuracy of choices, of other answers and of all; 0 where there are none."""
    right = F.coalesce(ok, F.lit(False)).cast("int")
    return df.agg(mean_or_zero(right, is_choice).alias("choice_acc"), mean_or_zero(right, ~is_choice).alias("analytic_acc"), mean_or_zero(right).alias("overall_acc"), F.count_if(is_choice).alias("n_choice"), F.count_if(~is_choice).alias("n_analytic"))


def rank_models(results: DataFrame, targets: DataFrame, model: str, bench: str, acc: str = "accuracy", target: str = "target") -> DataFrame:
    """(model, score, rank): mean of accuracy over target, nulls left out, descending. A few rows."""
    s = results.join(targets, bench).groupBy(model).agg(F.round(F.avg(F.col(acc) / F.col(target)), 6).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), model)))


def weakest(df: DataFrame, by: str, ok: Column, least: int = 3, k: int = 5) -> DataFrame:
    """The k groups of `least` rows or more with the lowest accuracy (a top-k report)."""
    out = df.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(ok.cast("int")), 6).alias("accuracy")).where(F.col("n") >= least)
    return out.orderBy("accuracy", by).limit(k)


def running_sum(df: DataFrame, by: str, order: list[str], value: Column, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over a group's rows so far, in an order that tells all of them apart.

    Rows lie in ranges by group and order, so a group of any size is spread over tasks:
    each sums up its own part, and gets what the parts before it (a row for each) come to.
    """
    ranges = stored(df.withColumn("_value", value).repartitionByRange(F.col(by), *order))
    rows = ranges.withColumn("_part", F.spark_partition_id())
    sums = rows.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_of")).agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy("_by").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_by", "_of", F.sum("_sum").over(earlier).alias("_before"))
    here = F.sum("_value").over(Window.partitionBy(by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("_here", here).join(before, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_of")))
    total = F.when(F.col("_before").isNull(), F.col("_here")).when(F.col("_here").isNull(), F.col("_before")).otherwise(F.col("_here") + F.col("_before"))
    return found.withColumn(out, total).drop("_value", "_part", "_by", "_of", "_before", "_here")


def running_spend(calls: DataFrame, by: str, order: list[str], cost: Column, cap: float) -> DataFrame:
    """Adds spent (so far, in order) and over_cap."""
    return running_sum(calls, by, order, cost, "spent").withColumn("spent", F.round("spent", 6)).withColumn("over_cap", F.col("spent") > cap)


def rescored(df: DataFrame, old: str, new: str) -> DataFrame:
    """Mean old score (a missing one is 0) and mean new score (a missing one is left out)."""
    return df.agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col(old), F.lit(0.0))).alias("old_mean"), F.avg(new).alias("new_mean"), F.count(new).alias("n_rescored"))
