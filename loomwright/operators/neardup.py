"""Similarity with protected benchmark texts: exact, character n-grams, SimHash, embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard_of_counts, normalize
from ..session import stored
from .setjoin import by_index, by_join, grams_of
from .vectors import nearest

REJECT_JACCARD, SIMHASH_JACCARD, REJECT_COSINE = 0.35, 0.25, 0.92
#: Characters of a benchmark up to which an index of its grams is sent to the tasks (some 100 bytes each).
INDEX_CHARS = 4_000_000


def exact_matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", bench_text: str = "text") -> DataFrame:
    """(id, exact_match): the normalised text is one of the benchmark's. Joined by hash; AQE broadcasts the small side."""
    hashes = bench.select(F.sha2(normalize(F.col(bench_text)).cast("binary"), 256).alias("_h")).where("_h is not null").distinct().withColumn("_hit", F.lit(True))
    return docs.withColumn("_h", F.sha2(normalize(F.col("text")).cast("binary"), 256)).join(hashes, "_h", "left").select(id_col, F.coalesce("_hit", F.lit(False)).alias("exact_match"))


def _sums(docs: DataFrame, bench: DataFrame, id_col: str, item_col: str, n: int, keep: str, least: float) -> DataFrame:
    """(id, item, _a, _b, _both): grams of both and shared ones, of the pairs to keep."""
    return (by_index if _small(bench) else by_join)(docs, bench, id_col, item_col, n, keep, least)


def _small(bench: DataFrame) -> bool:
    return (bench.agg(F.sum(F.length("text"))).first()[0] or 0) <= INDEX_CHARS


def jaccard_pairs(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", n: int = 5, least: float = 0.0) -> DataFrame:
    """(id, item, jaccard) of pairs that share a gram and have a Jaccard of `least` or more."""
    sums = _sums(docs, bench, id_col, item_col, n, "jaccard", least)
    j = jaccard_of_counts(F.col("_both"), F.col("_a"), F.col("_b"))
    return sums.select(id_col, item_col, j.alias("jaccard")).where(F.col("jaccard") >= least)


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", n: int = 5, reject: float = REJECT_JACCARD) -> DataFrame:
    """(id, jaccard_max, item, decision) of every document; of equal items the least. Ids are unique on both sides, of any type."""
    if _small(bench):
        sums = by_index(docs, bench, id_col, item_col, n, "best", 0.0)
        best = sums.select(id_col, item_col, jaccard_of_counts(F.col("_both"), F.col("_a"), F.col("_b")).alias("jaccard_max"))
    else:
        pairs = jaccard_pairs(docs, bench, id_col, item_col, n)
        best = pairs.groupBy(id_col).agg(F.max("jaccard").alias("jaccard_max"), F.min_by(F.col(item_col), F.struct(-F.col("jaccard"), F.col(item_col))).alias(item_col))
    out = docs.select(id_col).join(best, id_col, "left").select(id_col, item_col, F.round(F.coalesce("jaccard_max", F.lit(0.0)), 6).alias("jaccard_max"))
    return out.withColumn("decision", F.when(F.col("jaccard_max") >= reject, "reject").otherwise("accept"))


def containment(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", n: int = 5, least: float = 0.0) -> DataFrame:
    """(id, item, containment): share of the item's grams in the document; finds passages in long texts, which Jaccard can't."""
    sums = _sums(docs, bench, id_col, item_col, n, "containment", least)
    return sums.select(id_col, item_col, (F.col("_both") / F.col("_b")).alias("containment")).where(F.col("containment") >= least)


def simhash64(grams: DataFrame, id_col: str) -> DataFrame:
    """(id, simhash binary string of 64 signs) from rows of grams: SHA-256 bits vote, ties give 0."""
    half = lambda at: F.conv(F.substring("_h", at, 8), 16, 10).cast("long")
    bits = grams.select(id_col, F.sha2(F.col("gram").cast("binary"), 256).alias("_h")).select(id_col, half(1).alias("_w0"), half(9).alias("_w1"))
    votes = bits.groupBy(id_col).agg(*[F.sum(F.shiftright(f"_w{k // 32}", 31 - k % 32).bitwiseAND(1) * 2 - 1).alias(f"_v{k}") for k in range(64)])
    return votes.select(id_col, F.concat(*[F.when(F.col(f"_v{k}") > 0, "1").otherwise("0") for k in range(64)]).alias("simhash"))


def simhash_similarity(a: Column, b: Column) -> Column:
    """1 - unlike bits / 64, of two strings of 64 bits."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return same / F.lit(64.0)


def simhash_of_similar(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", least: float = SIMHASH_JACCARD) -> DataFrame:
    """(id, item, jaccard, similarity) of pairs with a Jaccard of `least` or more; hashes are made only for those."""
    pairs = stored(jaccard_pairs(docs, bench, id_col, item_col, least=least))
    a = simhash64(grams_of(docs.join(pairs.select(id_col).distinct(), id_col, "left_semi"), id_col), id_col)
    b = simhash64(grams_of(bench.join(pairs.select(item_col).distinct(), item_col, "left_semi"), item_col), item_col)
    return pairs.join(a, id_col).join(b.withColumnRenamed("simhash", "_s"), item_col).select(id_col, item_col, F.round("jaccard", 6).alias("jaccard"), F.round(simhash_similarity(F.col("simhash"), F.col("_s")), 6).alias("similarity"))


def corpus_maxima(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """One row: the largest n-gram Jaccard of the corpus with a benchmark, and the largest SimHash similarity of similar pairs (0 without any)."""
    top = contamination(docs, bench, id_col, item_col).agg(F.max("jaccard_max").alias("jaccard_max"))
    near = simhash_of_similar(docs, bench, id_col, item_col).agg(F.coalesce(F.max("similarity"), F.lit(0.0)).alias("simhash_max"))
    both = top.select("jaccard_max", F.lit(None).cast("double").alias("simhash_max")).unionByName(near.select(F.lit(None).cast("double").alias("jaccard_max"), "simhash_max"))
    return both.agg(F.max("jaccard_max").alias("jaccard_max"), F.max("simhash_max").alias("simhash_max"))


def nearest_vectors(queries: DataFrame, base: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", reject: float = REJECT_COSINE, others: bool = False) -> DataFrame:
    """(id, match_id, cosine, decision): the most similar base vector of every query, the least id of equal ones.

    others: a query's own id in the base is left out. Query ids are unique; without a
    vector or a match, match and cosine are null. The base stays where it is (see vectors.py).
    """
    best = nearest(queries, base, id_col, vec_col, others).select(F.col("id").alias("_id"), "match_id", F.round("cosine", 6).alias("cosine"))
    out = queries.select(id_col).join(best, F.col(id_col).cast("long") == F.col("_id"), "left")
    return out.select(id_col, "match_id", "cosine", F.when(F.col("cosine") >= reject, "quarantine").otherwise("accept").alias("decision"))


def hash_manifest(bench: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct SHA-256 hashes of normalised texts: a list to check against that shows no text."""
    return bench.select(F.sha2(normalize(F.col(text_col)).cast("binary"), 256).alias("sha256")).where("sha256 is not null").distinct()
