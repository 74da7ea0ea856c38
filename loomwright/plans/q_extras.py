"""Queries: smaller operators on the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, chat
from ..functions import text as tx
from ..operators import extras, report
from .registry import query, table


@query("""
WITH w AS (SELECT lower(a.text) AS a, lower(a.text) || CASE WHEN a.item_id % 2 = 0 THEN '' ELSE 'x' END AS g, list_distinct(string_split(lower(a.text), ' ')) AS p, list_distinct(string_split(lower(b.text), ' ')) AS q FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
s AS (SELECT (trim(a) = trim(g))::INT AS em, CASE WHEN len(list_intersect(p, q)) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(p, q)) / (len(p) + len(q)) END AS f FROM w)
SELECT round(avg(em), 6) AS em, round(avg(f), 6) AS source_f1, round(avg(em * f), 6) AS joint, count(*) AS n FROM s
""")
def multihop_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("a"))
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.split("a", " ").alias("q"))
    b = items.join(after, "item_id").select("a", F.concat("a", F.when(F.col("item_id") % 2 == 0, "").otherwise("x")).alias("g"), F.split("a", " ").alias("p"), "q")
    out = extras.multihop_scores(b, "a", "g", "p", "q")
    return out.select(*[F.round(c, 6).alias(c) for c in ("em", "source_f1", "joint")], "n")


@query("SELECT user_id, round(avg(value), 6) AS mean_logprob, count(value) AS n_tokens FROM events GROUP BY 1")
def mean_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extras.mean_logprob(table(spark, sf_dir, "events"), ["user_id"], "value").withColumn("mean_logprob", F.round("mean_logprob", 6))


@query("SELECT count(*) FILTER (quality = 1) AS n_holds, count(*) AS n, round(count(*) FILTER (quality = 1) / count(*), 6) AS share, count(*) FILTER (quality = 1) / count(*) >= 0.3 AS ok FROM labels")
def diversity_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extras.share_guard(table(spark, sf_dir, "labels"), F.col("quality") == 1, 0.3)


@query("SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS accept, count(*) FILTER (toxic = 1) AS reject, count(*) FILTER (toxic = 0 AND quality = 0) AS quarantine, count(*) FILTER (doc_id % 2 = 0) AS with_notes FROM labels")
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "accept").otherwise("quarantine")
    return extras.decisions(table(spark, sf_dir, "labels"), d, F.when(F.col("doc_id") % 2 == 0, "note").otherwise(""))


@query("SELECT event_type, count(*) FILTER (value > 0) AS accepted, round(count(*) FILTER (value > 0) / sum(user_id % 7), 6) AS per_second, round(sum(event_id % 5), 6)::DOUBLE AS cost, round(sum(event_id % 5) / count(*) FILTER (value > 0), 6) AS cost_per_row FROM events GROUP BY 1")
def generation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extras.rates(table(spark, sf_dir, "events"), F.when(F.col("value") > 0, 1).otherwise(0), F.col("user_id") % 7, F.col("event_id") % 5, "event_type")
    return out.withColumn("cost", F.col("cost").cast("double"))


@query("""
WITH r AS (SELECT substring(text, 1, 200) AS p, arg_max(source, doc_id) AS rule FROM documents GROUP BY 1)
SELECT d.doc_id, rule FROM documents d LEFT JOIN r ON substring(d.text, 1, 200) = r.p
""")
def constraints_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = table(spark, sf_dir, "documents").select(F.col("text").alias("rt"), F.col("doc_id").alias("o"), F.col("source").alias("rule"))
    return extras.join_by_prefix(docs, rules, "text", "rt", "o", 200).select("doc_id", "rule")


@query("""
WITH g AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), w AS (SELECT *, CASE lang WHEN 'en' THEN 0.5 WHEN 'de' THEN 0.3 ELSE 0.1 END AS weight FROM g)
SELECT lang, n, weight::DOUBLE AS weight, greatest(floor(n * weight::DOUBLE * 3 / max(weight::DOUBLE) OVER ())::BIGINT, n) AS target FROM w
""")
def raised_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return extras.raised_targets(extras.fixed_weights(g, "lang", {"en": 0.5, "de": 0.3}, 0.1))


@query("SELECT doc_id, contains(text, ' th') OR contains(text, ' la ') AS any_marker, ((length(text) - length(replace(text, ' th', ''))) // 3 + (length(text) - length(replace(text, ' la ', ''))) // 4) >= 5 AS many, CASE WHEN contains(text, 'ß') THEN 'german' WHEN contains(text, 'ç') THEN 'french' ELSE 'none' END AS label FROM documents")
def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, t = [" th", " la "], F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", extras.has_marker(t, m).alias("any_marker"), extras.has_marker(t, m, 5).alias("many"), extras.by_substring(t, [("ß", "german"), ("ç", "french")], "none").alias("label"))


@query("SELECT s.status, coalesce(n, 0) AS n FROM (VALUES ('OK'), ('WARN'), ('FAIL')) s(status) LEFT JOIN (SELECT CASE WHEN toxic = 1 THEN 'WARN' ELSE 'OK' END AS status, count(*) AS n FROM labels GROUP BY 1) USING (status)")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extras.status_counts(table(spark, sf_dir, "labels"), F.when(F.col("toxic") == 1, "WARN").otherwise("OK"))


@query("SELECT event_id, value, sha256('m' || chr(30) || 'point' || chr(30) || event_type || chr(30) || user_id) AS key, round(CASE WHEN abs(value) <= 1 THEN abs(value) * 100 ELSE abs(value) END, 2) AS percent FROM events")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "value", tx.cache_key(F.lit("m"), F.lit("point"), F.col("event_type"), F.col("user_id").cast("string")).alias("key"), tx.percent(F.abs("value")).alias("percent"))


@query(r"WITH n AS (SELECT doc_id, list_transform(regexp_extract_all(text, '-?\d{1,18}'), lambda x: x::BIGINT) AS v FROM documents) SELECT doc_id, list_min(v) AS low, list_max(v) AS high FROM n")
def numeric_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "documents").select("doc_id", chat.numeric_bounds(F.array("text")).alias("_b"))
    return b.select("doc_id", "_b.low", "_b.high")


@query("SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")
def shard_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return report.pivot_counts(e, "user_id", F.col("event_type"), ["click", "view"]).join(e.groupBy("user_id").agg(F.count("*").alias("n")), "user_id")


_BLANK = "chr(32)||chr(9)||chr(10)||chr(13)"


@query(f"SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN coalesce(nullif(substring(text, 1, 2000), ''), nullif(text, '')) WHEN 1 THEN trim(text, {_BLANK}) ELSE coalesce(nullif(text, ''), 'from the prompt') END AS seed FROM conversations WHERE text IS NOT NULL")
def extract_user_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain texts, tagged texts, and (for the empty third) the first user message, or else the prompt."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    k = F.col("turn") % 3
    tagged = F.concat(F.lit("<|im_start|>user\nfirst<|im_end|>\n<|im_start|>user  "), F.col("text"), F.lit(" <|im_end|>more"))
    text = F.when(k == 0, F.col("text")).when(k == 1, tagged).otherwise("")
    message = lambda role, x: F.struct(F.lit(role).alias("role"), x.alias("content"))
    messages = F.array(message("system", F.lit("s")), message("user", F.col("text")), message("user", F.lit("a later one")))
    prompt = F.when(k == 2, "from the prompt")
    return c.select("conv_id", "turn", chat.user_text(text, messages, prompt).alias("seed"))


@query(f"SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN text WHEN length(trim(text, {_BLANK})) >= 100 THEN trim(text, {_BLANK}) ELSE '<think>x</think>' || text END AS said FROM conversations WHERE text IS NOT NULL")
def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second turn gets a reasoning block before it, which goes unless little follows."""
    x = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<think>x</think>"), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", answers.visible(x).alias("said"))
