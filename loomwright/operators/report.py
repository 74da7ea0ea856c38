"""Counts, distributions and progress reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, tokens

#: Rows of a table of starts up to which it is sent to the tasks.
SENT_STARTS = 100_000


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, value, n): independent counts of each column, in one pass over the data."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])).alias("_p"))
    return pairs.groupBy("_p.dimension", "_p.value").agg(F.count("*").alias("n"))


def pivot_counts(df: DataFrame, row: str, col: Column, values: list[str]) -> DataFrame:
    return df.groupBy(row).agg(*[F.count_if(col == v).alias(v) for v in values])


def pass_rates(df: DataFrame, by: str, passed: Column, gate: float = 0.99, exempt: tuple[str, ...] = ("unknown",)) -> DataFrame:
    """(by, total, passed, failed, rate, gate_ok) of every group and of TOTAL, whose gate holds if all groups' do."""
    base = df.withColumn("_ok", F.coalesce(passed, F.lit(False)).cast("int")).groupBy(by).agg(F.count("*").alias("total"), F.sum("_ok").alias("passed"))
    base = base.withColumn("rate", F.round(F.col("passed") / F.col("total"), 6)).withColumn("gate_ok", F.col(by).isin(*exempt) | (F.col("rate") >= gate))
    every = base.agg(F.sum("total").alias("total"), F.sum("passed").alias("passed"), F.bool_and("gate_ok").alias("gate_ok")).select(F.lit("TOTAL").alias(by), "total", "passed", F.round(F.col("passed") / F.col("total"), 6).alias("rate"), "gate_ok")
    return base.unionByName(every).withColumn("failed", F.col("total") - F.col("passed"))


def nearest_rank(df: DataFrame, by: str, value: Column, percents: tuple[int, ...] = (10, 50, 90)) -> DataFrame:
    """(by, n, p10, ...): the value at place round-half-even(q * (n - 1)).

    From counts of each value: no group's rows are gathered, only its distinct values ordered.
    """
    counts = df.select(by, value.alias("_v")).where("_v is not null").groupBy(by, "_v").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(by)
    c = counts.withColumn("_to", F.sum("_c").over(w.orderBy("_v"))).withColumn("_n", F.sum("_c").over(w))
    at = lambda p: F.bround((F.col("_n") - 1) * F.lit(p) / F.lit(100.0))
    return c.groupBy(by).agg(F.max("_n").alias("n"), *[F.min(F.when(F.col("_to") > at(p), F.col("_v"))).alias(f"p{p}") for p in percents])


def lexical_diversity(df: DataFrame, by: str, text: str = "text") -> DataFrame:
    """(by, n_tokens, n_types, ratio). Types are counted per group from (group, token) sums, not gathered."""
    t = df.select(by, F.lower(F.col(text)).alias("_t")).select(by, F.explode_outer(tokens(F.col("_t"))).alias("_w")).where("_w is not null")
    types = t.groupBy(by, "_w").agg(F.count("*").alias("_c"))
    return types.groupBy(by).agg(F.sum("_c").alias("n_tokens"), F.count("*").alias("n_types")).withColumn("ratio", F.round(F.col("n_types") / F.col("n_tokens"), 6))


def token_budget(df: DataFrame, by: str, chars: Column) -> DataFrame:
    """(by, chars, tokens) of every group, and of all from the total of characters."""
    g = df.groupBy(by).agg(F.sum(chars).alias("chars"))
    every = g.agg(F.sum("chars").alias("chars")).select(F.lit("TOTAL").alias(by), "chars")
    return g.unionByName(every).withColumn("tokens", estimate_tokens(F.col("chars")))


def coverage(ours: DataFrame, bench: DataFrame, mapping: DataFrame, family: str = "family", target: str = "benchmark") -> DataFrame:
    """(family, ours, bench, ratio); mapping (family, benchmark) may give a family several benchmarks. Ratio null without any."""
    a = ours.groupBy(family).agg(F.count("*").alias("ours"))
    b = mapping.join(bench.groupBy(target).agg(F.count("*").alias("_n")), target, "left").groupBy(family).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("bench"))
    return a.join(b, family, "left").select(family, "ours", F.coalesce("bench", F.lit(0)).alias("bench"), F.round(F.try_divide(F.col("ours"), F.col("bench")), 6).alias("ratio"))


def shard_progress(df: DataFrame, by: str, shard: str, id_col: str, order: list[str]) -> DataFrame:
    """(by, n, last_shard, next_shard, last_id): shards compare as text, the next is one more of 3 digits; the last id in order."""
    g = df.groupBy(by).agg(F.count("*").alias("n"), F.max(shard).alias("last_shard"), F.max_by(id_col, F.struct(*order)).alias("last_id"))
    return g.withColumn("next_shard", F.lpad((F.col("last_shard").cast("int") + 1).cast("string"), 3, "0"))


def remaining(counts: DataFrame, targets: DataFrame, key: str, n: str = "n", target: str = "target") -> DataFrame:
    """(key, target, n, remaining) of every target; a group without rows has none yet, and a target that is passed leaves 0."""
    return targets.join(counts, key, "left").select(key, target, F.coalesce(n, F.lit(0)).alias(n), F.greatest(F.lit(0).cast("long"), F.col(target) - F.coalesce(n, F.lit(0))).alias("remaining"))


def checkpoint_summary(df: DataFrame, targets: DataFrame, decisions: DataFrame, by: str, shard: str, id_col: str, order: list[str]) -> DataFrame:
    """A row for each target: rows so far and remaining, last and next shard, last id, and decisions by name.

    targets: (by, target); decisions: (id, decision) of some rows. A group without rows begins at shard 000.
    """
    named = df.join(decisions, id_col, "left").groupBy(by, "decision").agg(F.count("*").alias("_n")).where("decision is not null")
    counts = named.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("decision", "_n")))).alias("decisions"))  # a few names
    progress = shard_progress(df, by, shard, id_col, order)
    out = remaining(progress, targets, by).join(progress.drop("n"), by, "left").join(counts, by, "left")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return out.withColumn("next_shard", F.coalesce("next_shard", F.lit("000"))).withColumn("decisions", F.coalesce("decisions", empty))


def gate_progress(df: DataFrame, starts: DataFrame, by: str, id_col: str, split: str = "split") -> DataFrame:
    """(by, n): training rows whose id's last number is at or after the group's start; starts has (by, start), a row for each group.

    Rows are counted where they lie if the starts can be sent (SENT_STARTS), else by a join of counts by number.
    """
    seq = F.regexp_extract(id_col, r"-(\d+)$", 1)
    rows = df.where(F.col(split) == "train").select(by, F.when(seq != "", seq.cast("long")).alias("_seq")).where("_seq is not null")
    if starts.count() <= SENT_STARTS:
        counts = rows.join(F.broadcast(starts), by).where("_seq >= start").groupBy(by).agg(F.count("*").alias("n"))
    else:
        counts = rows.groupBy(by, "_seq").agg(F.count("*").alias("_n")).join(starts, by).where("_seq >= start").groupBy(by).agg(F.sum("_n").alias("n"))
    return starts.select(by).join(counts, by, "left").select(by, F.coalesce("n", F.lit(0)).alias("n"))


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A Markdown table of a small report frame; refuses more than `most` rows."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows for a table")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in got]) + "\n"


def fingerprint(df: DataFrame, order: list[str], first: int = 10_000) -> DataFrame:
    """(sha256) over the JSON of the first rows in order, with sorted keys: one hash for at most `first` rows (64 bytes each)."""
    cols = sorted(df.columns)
    top = df.orderBy(*order).limit(first).select(*order, F.sha2(F.to_json(F.struct(*cols)).cast("binary"), 256).alias("_h"))
    packed = top.agg(F.array_sort(F.collect_list(F.struct(*order, "_h"))).alias("_all"))
    return packed.select(F.sha2(F.array_join(F.transform("_all", lambda x: x["_h"]), "\n").cast("binary"), 256).alias("sha256"))
