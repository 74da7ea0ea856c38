"""Incremental loops as Structured Streaming: state lives in the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.score import running_sum


def cycles(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Calls step(batch, cycle number) for every batch; a restart goes on from the checkpoint. every=None: until what is there is done."""
    w = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def watch_files(spark: SparkSession, path: str, schema: str, fmt: str = "json", files_per_batch: int = 100) -> DataFrame:
    """New files of a folder, each once (the source's own log remembers them)."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path)


def first_seen(stream: DataFrame, key: str, time: str | None = None, late: str = "1 day") -> DataFrame:
    """The first row of each key. With a time column, keys are forgotten after `late`, and state stays bounded."""
    if time:
        return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def _written(spark: SparkSession, out: str, number: int) -> DataFrame | None:
    """What other batches than this one have written; None before the first."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p) or not any(s.isDirectory() for s in fs.listStatus(p)):
        return None
    return spark.read.parquet(out).where(F.col("batch") != number)


def append_until(stream: DataFrame, out: str, rejects: str, accept, target: int, checkpoint: str, order: list[str] | None = None) -> StreamingQuery:
    """Appends accepted rows until the output has `target` of them, and logs all others with a reason.

    Of a batch that passes the target, the first rows in `order` (all columns by
    default) are taken; the log has the rest as `over_target`. Each batch writes
    to a folder named by its number and counts only the folders of others, so a
    repeated batch overwrites its own with the same rows.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        before = _written(spark, out, number)
        have = before.count() if before is not None else 0
        ok = F.coalesce(accept, F.lit(False))
        good, left = batch.where(ok), max(0, target - have)
        over = good.limit(0)
        if good.count() > left:
            ranked = good.orderBy(*(order or batch.columns)).select("*", F.monotonically_increasing_id().alias("_at")).persist()
            places = ranked.select("_at").orderBy("_at").limit(left).agg(F.max("_at")).first()[0]  # of the last row that is taken
            good, over = ranked.where(F.col("_at") <= F.lit(-1 if places is None else places)).drop("_at"), ranked.where(F.col("_at") > F.lit(-1 if places is None else places)).drop("_at")
        good.write.mode("overwrite").parquet(f"{out}/batch={number}")
        log = batch.where(~ok).withColumn("reason", F.lit("rejected")).unionByName(over.withColumn("reason", F.lit("over_target")))
        log.write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        batch.unpersist()

    return cycles(stream, step, checkpoint)


def append_capped(streams: dict[str, DataFrame], out: str, rejects: str, accept, caps: dict[str, int], checkpoint: str, order: list[str], source: str = "source") -> StreamingQuery:
    """Several streams of one shape as one: each source's accepted rows are appended until it has as many as its cap.

    A source without a cap is taken whole. The rest is logged with a reason (`rejected`,
    `over_cap`). Of a batch that passes a cap, the first rows in `order` are taken: places within a
    source are counted over ranges, so a batch of one source is spread over tasks. A
    repeated batch overwrites its own folder with the same rows.
    """
    parts = [df.withColumn(source, F.lit(name)) for name, df in streams.items()]
    stream, spark = parts[0], parts[0].sparkSession
    for p in parts[1:]:
        stream = stream.unionByName(p)
    limits = spark.createDataFrame(list(caps.items()) or [("", 0)], f"{source} string, _cap long")

    def step(batch: DataFrame, number: int) -> None:
        before = _written(spark, out, number)
        have = limits.select(source, F.lit(0).cast("long").alias("_have")) if before is None else before.groupBy(source).agg(F.count("*").alias("_have"))
        ok = F.coalesce(accept, F.lit(False))
        placed = running_sum(batch.withColumn("_ok", ok), source, ["_ok", *order], F.col("_ok").cast("long"), "_place")
        known = placed.join(limits, source, "left").join(have, source, "left")  # a row for each source
        free = F.col("_cap").isNull() | (F.col("_place") + F.coalesce("_have", F.lit(0)) <= F.col("_cap"))
        judged = known.withColumn("reason", F.when(~F.col("_ok"), "rejected").when(~free, "over_cap")).drop("_ok", "_place", "_cap", "_have")
        judged = judged.persist()
        judged.where("reason is null").drop("reason").write.mode("overwrite").parquet(f"{out}/batch={number}")
        judged.where("reason is not null").write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        judged.unpersist()

    return cycles(stream, step, checkpoint)


def skip_existing(df: DataFrame, path: str) -> bool:
    """Writes unless the output is there; tells whether it wrote."""
    try:
        df.write.mode("errorifexists").parquet(path)
        return True
    except Exception as e:
        if "PATH_ALREADY_EXISTS" in str(e):
            return False
        raise
