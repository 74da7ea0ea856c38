"""Facts against fetched pages, and answers against search hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fact_keywords


def supported_facts(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, fact_no, n_keywords, hits, url): the source page with most of the fact's keywords, the first of equal ones.

    facts: (id, fact_no, fact, urls array<string>); pages: (url, body), one row for a fetched url.
    """
    asked = facts.select("id", "fact_no", fact_keywords(F.col("fact")).alias("_k"), F.posexplode_outer("urls").alias("_at", "url"))
    hits = F.size(F.filter("_k", lambda k: F.contains(F.col("body"), k)))
    joined = asked.join(pages, "url", "left").withColumn("_hits", F.coalesce(F.when(F.col("body").isNotNull(), hits), F.lit(0)))
    best = joined.groupBy("id", "fact_no").agg(F.max(F.size("_k")).alias("n_keywords"), F.max("_hits").alias("hits"), F.max_by("url", F.struct("_hits", -F.col("_at"))).alias("url"))
    return best.withColumn("url", F.when(F.col("hits") > 0, F.col("url")))


def fact_status(facts: DataFrame, pages: DataFrame, least: int = 2) -> DataFrame:
    """(id, broken, weak, status): FAIL if a source is missing, WARN if a fact has fewer than `least` keywords in a page, else OK."""
    f = supported_facts(facts, pages).groupBy("id").agg(F.count_if(F.col("hits") < least).alias("weak"))
    urls = facts.select("id", F.explode("urls").alias("url")).distinct().join(pages.select("url").distinct().withColumn("_ok", F.lit(True)), "url", "left")
    broken = urls.groupBy("id").agg(F.count_if(F.col("_ok").isNull()).alias("broken"))
    out = f.join(broken, "id", "left").withColumn("broken", F.coalesce("broken", F.lit(0)))
    return out.withColumn("status", F.when(F.col("broken") > 0, "FAIL").when(F.col("weak") > 0, "WARN").otherwise("OK"))


def answer_in_hits(claims: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, supported): the answer is in a hit's title or snippet, whatever the case."""
    text = F.lower(F.concat_ws(" ", "title", "snippet"))
    found = claims.join(hits, "id").where(F.contains(text, F.lower("answer"))).select("id").distinct().withColumn("supported", F.lit(True))
    return claims.select("id").join(found, "id", "left").select("id", F.coalesce("supported", F.lit(False)).alias("supported"))
