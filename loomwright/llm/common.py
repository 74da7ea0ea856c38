"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha1
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The six characters [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    A temporary one is set only where the session has none and runs in local
    mode (tests); on a cluster executors could not see it, so there it is an error.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir is not set: a folder that all executors share is needed")
            import tempfile

            folder = tempfile.mkdtemp(prefix="loomwright-checkpoints-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def lasting_folder(spark: SparkSession, *key: str) -> str:
    """A folder that later sessions find again by its key: beside the sessions' own in spark.checkpoint.dir."""
    name = sha1("\n".join(key).encode()).hexdigest()
    return f"{spark.conf.get('spark.checkpoint.dir', None) or shared_folder(spark)}/{name}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, n: int, *taken: str) -> list[str]:
    """n column names that `df` doesn't have, and that aren't `taken`."""
    used = {c.lower() for c in (*df.columns, *taken)}
    return list(islice((x for i in count() if (x := f"_lw{i}") not in used), n))


def quoted(name: str) -> str:
    """A column's name where a dot in it is no field."""
    return f"`{name.replace('`', '``')}`"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; the plain lower() is the same on pure ASCII and faster."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def crc32_of_id(c: Column) -> Column:
    """CRC-32 of an id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def add_columns(
    df: DataFrame,
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Adds `fields` to every row in Arrow batches; a same-named input column is replaced.

    `make` runs once in each Python task and returns the function of a batch.
    Columns in `drop` are read but don't travel back.
    """
    new = {f.name.lower() for f in fields} | {x.lower() for x in drop}
    keep = [f for f in df.schema.fields if f.name.lower() not in new]
    names = [f.name for f in keep] + [f.name for f in fields]
    old, all_names = [f.name for f in keep], df.columns
    if any("." in c for c in all_names):  # mapInArrow takes a dot for a field's
        df = df.toDF(*(f"_{i}" for i in range(len(all_names))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            b = b.rename_columns(all_names)
            yield pa.RecordBatch.from_arrays([b.column(n) for n in old] + f(b), names=names)

    return df.mapInArrow(run, T.StructType(keep + fields))


def values(column: pa.Array, rows: int = 256) -> Iterator:
    """A column's values as Python objects, of a few rows at a time."""
    for k in range(0, len(column), rows):
        yield from column.slice(k, rows).to_pylist()


def utf8(column: pa.Array) -> Iterator[bytes | None]:
    """A text column's bytes, without decoding them."""
    return values(column.cast(pa.binary()))
