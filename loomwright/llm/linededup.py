"""Line dedup across documents, in DataFrame functions only.

Lines are exploded, normalised and hashed; the distinct documents of each hash
are counted; lines whose hash is found in many documents are dropped from all
of them but one, and the rest is put together again in line order.

Shuffles: (hash, doc) pairs once, the pairs against the frequent hashes once, the
documents once. A hot line is counted by partial aggregates, and no group of rows is
ever gathered. Pairs and frequent hashes are stored before they are joined: then
both sides of the join are plain shuffles, and AQE splits a hot hash among tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, checkpoint, fresh


def line_key(line: Column) -> Column:
    """The line, stripped of [\\x20\\x09-\\x0D] at both ends, with A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _hash(key: Column) -> list[Column]:
    """128 bits: two XXH64 with unlike seeds."""
    return [F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit(7), key).alias("_h2")]


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """Per document with lines to drop: (_id, _hits array<struct<_h1,_h2>>)."""
    lines = docs.select(F.col(id_col).alias("_id"), F.explode_outer(F.split(F.col(text_col), "\n")).alias("_line"))
    # explode_outer: for explode, the optimizer would split each text twice.
    keys = lines.select("_id", line_key(F.col("_line")).alias("_key")).where((F.length("_key") >= min_chars) & F.col("_id").isNotNull())
    pairs = checkpoint(keys.select("_id", *_hash(F.col("_key"))).distinct())
    often = checkpoint(pairs.groupBy("_h1", "_h2").agg(F.count("*").alias("_n"), F.max("_id").alias("_last")).where(F.col("_n") >= min_docs))
    hits = pairs.join(often, ["_h1", "_h2"]).where(F.col("_id") < F.col("_last"))
    return hits.groupBy("_id").agg(F.collect_list(F.struct("_h1", "_h2")).alias("_hits"))


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "line_dedup", min_docs: int = 5, min_chars: int = 40
) -> DataFrame:
    """`docs` with the struct column `out`: n_lines, n_dropped, text (what stays).

    A key of at least `min_chars` code points found in at least `min_docs`
    documents loses its lines everywhere but in the largest id that holds it.
    Defined cases: a null or empty text is one empty line. Rows of the same id
    are one document. A null id is no document: it is not counted and loses
    nothing. A document whose lines all go keeps an empty text. An input column
    named like `out` is replaced; other columns pass unchanged, whatever their
    names. An empty table gives no rows.
    """
    doc, hits, kept = fresh(docs, 3, out)
    found = repeated_lines(docs, id_col, text_col, min_docs, min_chars).select(F.col("_id").alias(doc), F.col("_hits").alias(hits))
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n")

    def stays(line: Column) -> Column:
        key = line_key(line)
        return (F.length(key) < min_chars) | ~F.array_contains(F.col(hits), F.struct(*_hash(key)))

    joined = docs.join(found, F.col(id_col) == F.col(doc), "left").withColumn(kept, F.when(F.col(hits).isNotNull(), F.filter(lines, stays)))
    n = F.size(lines).cast("long")
    result = F.struct(
        n.alias("n_lines"),
        F.when(F.col(kept).isNotNull(), n - F.size(kept)).otherwise(0).cast("long").alias("n_dropped"),  # size(null) is -1 without ANSI
        F.when(F.col(kept).isNotNull(), F.array_join(kept, "\n")).otherwise(text).alias("text"),
    )
    return joined.withColumn(out, result).drop(doc, hits, kept)
