"""Writers: partitioned JSONL, manifests, side tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTITIONS = ("split", "family", "shard")


def write_partitions(df: DataFrame, path: str, by: tuple[str, ...] = PARTITIONS, dry_run: bool = False) -> DataFrame:
    """Counts by partition; unless dry_run, also overwrites just the partitions that df has. Nulls are left out of the JSON."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    if not dry_run:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).json(path)
    return counts


def write_shard(df: DataFrame, path: str, name: str, order: list[str]) -> None:
    """One JSONL (or, of a single `value` column, text) file of that name, rows in order: a shard is small by nature."""
    spark = df.sparkSession
    folder = f"{path}/_{name}"
    rows = df.coalesce(1).sortWithinPartitions(*order)
    rows.select("value").write.mode("overwrite").text(folder) if "value" in df.columns else rows.write.mode("overwrite").json(folder)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(hadoop(folder)) if s.getPath().getName().startswith("part-"))
    fs.delete(hadoop(f"{path}/{name}"), True)
    fs.rename(part, hadoop(f"{path}/{name}"))
    fs.delete(hadoop(folder), True)


def write_shards(df: DataFrame, path: str, name: str, order: list[str]) -> None:
    """JSONL shards, a folder of part-files for each value of `name`; column `value` has the lines. One job over many tasks.

    Part-files of a shard follow each other in `order`, so a large shard is written by several tasks.
    """
    rows = df.repartitionByRange(name, *order).sortWithinPartitions(name, *order)
    rows.select(name, "value").write.mode("overwrite").partitionBy(name).text(path)


def write_if_changed(df: DataFrame, path: str, order: list[str]) -> bool:
    """Writes JSON unless the same rows are there already (an order-free hash is kept beside them)."""
    spark = df.sparkSession
    now = df.agg(F.count("*"), F.sum(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)"))).first()
    mark = f"{path}.hash"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(mark)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    text = f"{now[0]} {now[1]}"
    if fs.exists(p) and [r[0] for r in spark.read.text(mark).collect()] == [text]:
        return False
    df.sortWithinPartitions(*order).write.mode("overwrite").json(path)
    spark.range(1).select(F.lit(text)).coalesce(1).write.mode("overwrite").text(mark)
    return True


def append_family(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def manifest(counts: DataFrame, key: str, n: str, weight: str, strategy: str, files: str | None = None) -> DataFrame:
    """One JSON row: strategy, counts and weights by key (and files by key). Rows of counts are groups, few by nature."""
    entry = lambda v: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col(v)))))
    cols = [entry(n).alias("train_counts"), entry(weight).alias("weights")] + ([entry(files).alias("sft_files")] if files else [])
    return counts.agg(*cols).select(F.to_json(F.struct(F.lit(strategy).alias("strategy"), "*")).alias("manifest"))


def side_tables(df: DataFrame, kind: str = "verifier_type") -> dict[str, DataFrame]:
    """Filtered views by verifier: unit tests, instruction checks, retrieval."""
    t = F.col(kind)
    return {"unit_tests": df.where(t == "unit_tests"), "instructions": df.where(t.isin("regex", "json_schema")), "retrieval": df.where(t == "retrieval_evidence")}


def read_manifest(text: str) -> dict:
    return json.loads(text)
