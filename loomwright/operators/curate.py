"""Splits, dedup, gates, weights and samples of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_rank

REQUIRED = ("id", "benchmark_family", "task_type", "language", "difficulty", "messages", "final_answer", "concise_solution", "verifier", "sources", "contamination_audit", "quality_scores", "training_tags")
# Caps on scores, and weights of the mixes.
QUALITY_CAPS = {"correctness": 0.99, "thai_naturalness": 0.99, "benchmark_alignment": 0.94, "novelty": 0.95, "instruction_clarity": 0.99}
DETERMINISTIC = ("symbolic_math", "unit_tests", "json_schema", "regex", "exact_match", "retrieval_evidence")
SIMPLE_AIME_TAGS = ("area", "centroid", "divisors", "identities", "inradius", "mean", "pythagorean", "recurrence", "sequences")
SIMPLE_MATH_TAGS = ("prealgebra", "arithmetic", "sequence", "quadratic", "linear_equations")
TUTOR_WEIGHTS = {"openthaieval": 2.0, "teacher_loop_th": 2.0, "mt_bench": 1.5, "ifeval_ifbench": 1.5, "aime_th": 0.8, "math500_th": 1.0, "livecodebench_th": 0.5, "hotpotqa_agentic": 1.0}


def public_item(df: DataFrame, keys: tuple[str, ...] = REQUIRED) -> DataFrame:
    """The published columns in order; missing ones are null, others go."""
    return df.select(*[F.col(k) if k in df.columns else F.lit(None).cast("string").alias(k) for k in keys])


def hash_ranked(df: DataFrame, by: list[str], key: Column, id_col: str, rank: str = "_rank", size: str | None = None) -> DataFrame:
    """Adds the rank (from 1) in the order of a hex key and the id within each group, and the group's size.

    Rows are counted by group and the key's first digits, and ranked within
    those small parts: a group may hold any share of all rows.
    """
    keyed = df.withColumn("_key", key).withColumn("_part", F.substring("_key", 1, 3))
    sums = keyed.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    sums = sums.withColumn("_before", F.sum("_n").over(w.orderBy("_part")) - F.col("_n")).withColumn("_all", F.sum("_n").over(w))
    on = keyed["_part"] == sums["_part"]
    for c in by:
        on = on & keyed[c].eqNullSafe(sums[c])
    joined = keyed.join(sums, on).select(keyed["*"], "_before", "_all")
    inside = F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_key", id_col))
    out = joined.withColumn(rank, (F.col("_before") + inside).cast("long"))
    return (out.withColumn(size, F.col("_all")) if size else out).drop("_key", "_part", "_before", "_all")


def first_of(df: DataFrame, keys: list[Column], order: list[Column | str], k: int = 1, keep_null_keys: bool = False) -> DataFrame:
    """The first k rows of each key. With keep_null_keys, rows without a key all stay and are nobody's copies.

    For k = 1 (and an ascending order) by a partial aggregate, so that a frequent key isn't gathered in one task.
    """
    if k == 1 and all(isinstance(o, str) for o in order):
        rows = df
        if keep_null_keys:
            none = F.lit(False)
            for key in keys:
                none = none | key.isNull() | (key.cast("string") == "")
            rows = df.where(~none)
        first = rows.groupBy(*[key.alias(f"_k{i}") for i, key in enumerate(keys)]).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")).select("_row.*")
        return first.unionByName(df.where(none)) if keep_null_keys else first
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    none = F.lit(False)
    if keep_null_keys:
        for key in keys:
            none = none | key.isNull() | (key.cast("string") == "")
        rank = F.when(none, 1).otherwise(rank)
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def later_copies(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """Every row but the first of its key. `order` names columns that tell the rows of a key apart (equal rows are all first)."""
    names = [f"_k{i}" for i in range(len(keys))]
    first = df.groupBy(*[k.alias(x) for k, x in zip(keys, names, strict=True)]).agg(F.min(F.struct(*order)).alias("_first"))
    on = F.lit(True)
    for k, x in zip(keys, names, strict=True):
        on = on & k.eqNullSafe(F.col(x))
    return df.join(first, on).where(F.struct(*order) > F.col("_first")).drop("_first", *names)


def stratified_split(df: DataFrame, id_col: str, strata: list[str], ratio: float = 0.1) -> DataFrame:
    """Adds split: in each stratum the first by SHA-256 of the id are validation.

    10 rows or more: max(1, round half even of n * ratio); 3 to 9: one; fewer: none.
    """
    ranked = hash_ranked(df, strata, F.substring(F.sha2(F.col(id_col).cast("string").cast("binary"), 256), 1, 16), id_col, "_r", "_size")
    n = F.col("_size")
    n_val = F.when(n >= 10, F.greatest(F.lit(1), F.bround(n * F.lit(ratio)).cast("int"))).when(n >= 3, 1).otherwise(0)
    return ranked.withColumn("split", F.when(F.col("_r") <= n_val, "validation").otherwise("train")).drop("_r", "_size")


def violations(checks: dict[str, Column]) -> Column:
    """Names of the checks that hold, in order; null counts as not holding."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())


def schema_checks(df: DataFrame, required: tuple[str, ...] = REQUIRED, enums: dict[str, list[str]] | None = None, least_items: dict[str, int] | None = None) -> dict[str, Column]:
    """Checks for violations(): missing fields, values outside of an enum, too few items, fields too many."""
    out: dict[str, Column] = {}
    for c in required:
        out[f"missing:{c}"] = F.col(c).isNull() if c in df.columns else F.lit(True)
    for c, values in (enums or {}).items():
        out[f"enum:{c}"] = ~F.col(c).isin(*values)
    for c, n in (least_items or {}).items():
        out[f"items:{c}"] = F.size(c) < n
    for c in df.columns:
        if c not in required:
            out[f"extra:{c}"] = F.col(c).isNotNull()
    return out


def cap_checks(scores: Column, caps: dict[str, float] = QUALITY_CAPS) -> dict[str, Column]:
    """Scores (map of strings) over their caps, or not numbers."""
    out = {}
    for k, cap in caps.items():
        v = scores[k].try_cast("double")
        out[f"not_numeric:{k}"] = scores[k].isNotNull() & v.isNull()
        out[f"over_cap:{k}"] = v > cap + 1e-9
    return out


def recalibrated_difficulty(family: Column, difficulty: Column, task_type: Column, tags: Column, prompt: Column, solution: Column) -> Column:
    overlap = lambda names: F.arrays_overlap(tags, F.array(*map(F.lit, names)))
    cases = F.contains(solution, F.lit("C(")) | F.contains(solution, F.lit("modulo")) | F.contains(solution, F.lit("กรณี"))
    short = (F.size(F.split(solution, "\n")) < 5) & (F.length(prompt) < 180)
    aime = F.when(overlap(SIMPLE_AIME_TAGS) | (F.array_contains(tags, "probability") & ~cases), "medium").when((difficulty == "hard") & short, "medium").otherwise(difficulty)
    math = F.when(overlap(SIMPLE_MATH_TAGS) & (difficulty == "medium"), "easy").when(overlap(SIMPLE_MATH_TAGS) & (difficulty == "hard"), "medium").otherwise(difficulty)
    code = F.when((task_type == "output_prediction") & (difficulty == "hard"), "medium").otherwise(difficulty)
    return F.when(family == "aime_th", aime).when(family == "math500_th", math).when(family == "livecodebench_th", code).otherwise(difficulty)


def calibrated_scores(family: Column, verifier: Column, language: Column, tags: Column, scores: Column, changed: Column) -> Column:
    """struct of the five scores under their caps. scores: map<string,double>; changed: the difficulty was recalibrated."""
    capped = lambda k, default, cap: F.least(F.coalesce(scores[k], F.lit(default)), cap)
    thai = language.startswith("th")
    align = F.least(
        F.when(changed, 0.88).otherwise(0.93),
        F.when(family.isin("mt_bench", "hotpotqa_agentic"), 0.91).otherwise(0.93),
        F.when((family == "ifeval_ifbench") & F.array_contains(tags, "line_count"), 0.90).otherwise(0.93),
    )
    return F.struct(
        capped("correctness", 0.95, F.when(verifier.isin(*DETERMINISTIC), 0.99).otherwise(0.96)).alias("correctness"),
        F.when(thai, capped("thai_naturalness", 0.9, F.lit(0.97))).otherwise(capped("thai_naturalness", 1.0, F.lit(0.95))).alias("thai_naturalness"),
        capped("novelty", 0.9, F.lit(0.95)).alias("novelty"),
        capped("instruction_clarity", 0.9, F.lit(0.98)).alias("instruction_clarity"),
        capped("benchmark_alignment", 0.85, align).alias("benchmark_alignment"),
    )


def reviewer_note(family: Column, verifier: Column, before: Column, after: Column, old_scores: Column, correctness: Column) -> Column:
    changed = F.format_string("Difficulty recalibrated from %s to %s.", before, after)
    kept = F.format_string("Difficulty retained as %s after curator review.", after)
    return F.concat(family, F.lit(" item verified with "), verifier, F.lit("; correctness "), correctness.cast("string"), F.lit(". "), F.when(before != after, changed).otherwise(kept), F.lit(" Original scores: "), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(old_scores)))), F.lit("."))


def quarantine(df: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Kept rows and the others; a null verdict quarantines."""
    ok = F.coalesce(keep, F.lit(False))
    return df.where(ok), df.where(~ok)


def loop_filter(df: DataFrame, corrections: str, converged: str) -> DataFrame:
    """Adds drop_reason: no_corrections, not_converged or null (kept)."""
    return df.withColumn("drop_reason", F.when(F.coalesce(F.col(corrections), F.lit(0)) == 0, "no_corrections").when(~F.coalesce(F.col(converged), F.lit(False)), "not_converged"))


def excluding(df: DataFrame, id_col: str, *lists: DataFrame) -> DataFrame:
    """Rows whose id is in none of the one-column lists (allow-lists, failed audits, known ids)."""
    ids = lists[0].toDF("_id")
    for x in lists[1:]:
        ids = ids.union(x.toDF("_id"))
    return df.join(ids.where("_id is not null").distinct(), F.col(id_col) == F.col("_id"), "left_anti")


def weights(counts: DataFrame, n_col: str = "n", strategy: str = "sqrt", multipliers: dict[str, float] | None = None, key: str | None = None) -> DataFrame:
    """Adds weight: root, size or equal shares, times a key's multiplier, summing to 1, to 6 places. Rows are groups, not records."""
    base = {"sqrt": F.sqrt(F.col(n_col)), "linear": F.col(n_col).cast("double"), "uniform": F.lit(1.0)}[strategy]
    if multipliers:
        m = F.create_map(*[F.lit(x) for kv in multipliers.items() for x in kv])
        base = base * F.coalesce(m[F.col(key)], F.lit(1.0))
    return counts.withColumn("_w", base).withColumn("weight", F.round(F.col("_w") / F.sum("_w").over(Window.partitionBy(F.lit(0))), 6)).drop("_w")


def sample_plan(weighted: DataFrame, target: int, n_col: str = "n") -> DataFrame:
    """Adds take (whole part of target * weight), and whole copies and rest to reach it."""
    take = F.floor(F.lit(target) * F.col("weight")).cast("long")
    return weighted.withColumn("take", take).withColumn("copies", F.floor(take / F.col(n_col)).cast("long")).withColumn("rest", (take % F.col(n_col)).cast("long"))


def resample(df: DataFrame, plan: DataFrame, key: str, id_col: str, seed: str = "0") -> DataFrame:
    """Rows by plan(key, copies, rest): all of them `copies` times, and the first `rest` by hash once more. Adds copy."""
    ranked = hash_ranked(df, [key], hash_rank(F.lit(seed), F.col(id_col).cast("string")), id_col, "_r").join(plan.select(key, "copies", "rest"), key)
    n = F.col("copies") + F.when(F.col("_r") <= F.col("rest"), 1).otherwise(0)
    return ranked.where(n > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), n))).drop("_r", "copies", "rest")


def shuffled(df: DataFrame, id_col: str, seed: str, k: int) -> DataFrame:
    """The first k rows, with their place, in the order of a hash of seed and id.

    Reproducible anywhere; not the order of any random number generator.
    """
    top = df.withColumn("_key", hash_rank(F.lit(seed), F.col(id_col).cast("string"))).orderBy("_key", id_col).limit(k)
    return top.withColumn("place", F.row_number().over(Window.orderBy("_key", id_col)).cast("long")).drop("_key")


def capped_source(df: DataFrame, order: list[Column], total: int, least: int = 2000) -> DataFrame:
    """At most max(least, total // 5) rows of a source, the first in order."""
    return df.orderBy(*order).limit(max(least, total // 5))


def few_shot(df: DataFrame, pool: DataFrame, id_col: str, group: str, k: int = 3) -> DataFrame:
    """(id, example_id, place): k others of the same group from the pool, in the order of SHA-256 of id and example.

    Candidates are first narrowed by rank in the pool's own hash order: from a
    place given by the id's hash, k + 1 consecutive ones are taken, so that the
    join makes k + 1 rows for a record and not its whole group.
    """
    ranked = hash_ranked(pool.select(F.col(id_col).alias("example_id"), group), [group], hash_rank(F.col("example_id").cast("string")), "example_id", "_p").withColumn("_p", F.col("_p") - 1)
    sizes = pool.groupBy(group).agg(F.count("*").alias("_n"))
    start = F.pmod(F.conv(F.substring(hash_rank(F.col(id_col).cast("string")), 1, 15), 16, 10).cast("long"), F.col("_n"))
    want = df.select(id_col, group).join(sizes, group).withColumn("_s", start).select(id_col, group, "_n", "_s", F.explode(F.sequence(F.lit(0), F.least(F.lit(k), F.col("_n") - 1).cast("int"))).alias("_i"))
    found = want.withColumn("_p", (F.col("_s") + F.col("_i")) % F.col("_n")).join(ranked, [group, "_p"]).where(F.col("example_id") != F.col(id_col))
    place = F.row_number().over(Window.partitionBy(id_col).orderBy("_i"))
    return found.withColumn("place", place).where(F.col("place") <= k).select(id_col, "example_id", "place")
