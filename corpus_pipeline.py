"""A corpus pipeline of five stages; part of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps,
with the columns of `documents`; the last returns the packed pieces. Nulls in any
column, repeated rows and empty tables pass as the operators say: a null or blank
text fails the quality rules, of repeated rows one stays, an empty table gives no
pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import decontam, linededup, packing, quality, simhash
from loomwright.llm.common import checkpoint, fresh, table
from loomwright.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or their group's thresholds reject go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated across documents go; n_chars follows the text. A document stays, if only as an empty text."""
    (lines,) = fresh(docs, 1)
    out = linededup.drop_repeated_lines(docs, out=lines).withColumn("text", F.col(f"{lines}.text"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    (overlap,) = fresh(docs, 1)
    found = decontam.find_items(docs, table(spark, sf_dir, "benchmark"), out=overlap)
    return found.where(~decontam.contaminated(overlap)).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; what a stage returns is checkpointed before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SimHash's XXH64 and the tokenizer are outside of SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None
