"""Rows of public benchmarks as prediction inputs: (family, id, prompt, gold) and what a family has besides.

Each family says which source columns a field may come from, in order. Columns
that a table doesn't have count as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The source columns of each field.
FIELDS = {
    "aime": {"id": ["id", "Problem Number"], "prompt": ["problem", "question"], "gold": ["answer"]},
    "math500": {"id": ["unique_id", "id"], "prompt": ["problem"], "gold": ["answer"]},
    "ifeval": {"id": ["key", "id"], "prompt": ["prompt"], "gold": ["response"], "constraints": ["instruction_id_list"]},
    "mt_bench": {"id": ["question_id"], "prompt": ["turns[0]", "prompt"], "gold": [], "category": ["category"], "reference_answer": ["reference[0]"]},
    "openthaieval": {"id": ["id"], "prompt": ["instruction", "question"], "gold": ["answer", "result"], "subject": ["subject"]},
    "livecodebench": {"id": ["question_id"], "prompt": ["question_content", "prompt"], "gold": [], "public_tests": ["public_test_cases"], "hidden_tests": ["private_test_cases"]},
    "hotpotqa": {"id": ["id"], "prompt": ["question"], "gold": ["answer"]},
}
EXAM_LETTERS, EXAM_ORDER = "abcde", "ตอบเฉพาะตัวอักษรของคำตอบ (a, b, c, d, หรือ e)"


def _column(df: DataFrame, name: str) -> Column | None:
    base = name.removesuffix("[0]")
    if base not in df.columns:
        return None
    return F.get(F.col(f"`{base}`"), F.lit(0)) if name.endswith("[0]") else F.col(f"`{base}`")


def mapped(df: DataFrame, family: str, as_family: str | None = None) -> DataFrame:
    """(family, id, prompt, gold, ...) of a family's rows; empty texts give way to the next source, a missing one is empty."""
    out = [F.lit(as_family or family).alias("family")]
    for field, sources in FIELDS[family].items():
        found = [c for s in sources if (c := _column(df, s)) is not None]
        if field in ("id", "prompt", "gold"):
            texts = [F.nullif(c.cast("string"), F.lit("")) for c in found]
            out.append(F.coalesce(*texts, F.lit("")).alias(field))
        elif found:
            out.append(F.coalesce(*found).alias(field))
    return df.select(*out)


def exam_mapped(df: DataFrame) -> DataFrame:
    """Choices a to e as one prompt; the gold answer is a letter."""
    options = F.array_compact(F.array(*[F.when(F.trim(F.col(x).cast("string")) != "", F.concat(F.lit(f"({x}) "), F.col(x).cast("string"))) for x in EXAM_LETTERS if x in df.columns]))
    subject = F.coalesce("subject", F.lit("unknown"))
    prompt = F.concat(F.coalesce("question", F.lit("")), F.lit("\n\n"), F.array_join(options, "\n"), F.lit(f"\n\n{EXAM_ORDER}"))
    return df.select(
        F.concat(F.lit("thai_exam_"), subject).alias("family"), F.concat_ws("_", F.coalesce("subject", F.lit("")), F.coalesce(F.col("no").cast("string"), F.lit(""))).alias("id"),
        prompt.alias("prompt"), F.lower(F.trim(F.coalesce(F.col("answer").cast("string"), F.lit("")))).alias("gold"), subject.alias("subject"),
    )


def all_mapped(tables: dict[str, DataFrame]) -> DataFrame:
    """The union of all families' rows by name (`thai_exam` by exam_mapped); a field that a family hasn't is null."""
    out = None
    for name, df in tables.items():
        one = exam_mapped(df) if name == "thai_exam" else mapped(df, name)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
