"""Queries: distributions, percentiles, weights, gates, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import curate, evidence, report
from .registry import query, table


@query("SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def dataset_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.distribution(table(spark, sf_dir, "documents"), ["lang", "source"])


_BAND = "CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'medium' ELSE 'long' END"


def _band():
    return F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 3000, "medium").otherwise("long")


@query(f"SELECT lang, count(*) FILTER (b = 'short') AS short, count(*) FILTER (b = 'medium') AS medium, count(*) FILTER (b = 'long') AS long FROM (SELECT lang, {_BAND} AS b FROM documents) GROUP BY lang")
def family_difficulty_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.pivot_counts(table(spark, sf_dir, "documents"), "lang", _band(), ["short", "medium", "long"])


@query("""
SELECT source, n, v[1 + round_even((n - 1) * 10 / 100.0, 0)::INT] AS p10, v[1 + round_even((n - 1) * 50 / 100.0, 0)::INT] AS p50, v[1 + round_even((n - 1) * 90 / 100.0, 0)::INT] AS p90
FROM (SELECT source, count(*) AS n, list(n_chars ORDER BY n_chars) AS v FROM documents GROUP BY 1)
""")
def length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.nearest_rank(table(spark, sf_dir, "documents"), "source", F.col("n_chars"))


@query(r"""
WITH t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[\x{0e00}-\x{0e7f}]+')) AS w FROM documents)
SELECT lang, count(*) AS n_tokens, count(DISTINCT w) AS n_types, round(count(DISTINCT w) / count(*), 6) AS ratio FROM t GROUP BY 1
""")
def lexical_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.lexical_diversity(table(spark, sf_dir, "documents"), "lang")


@query("""
WITH g AS (SELECT source, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1), a AS (SELECT * FROM g UNION ALL SELECT 'TOTAL', sum(chars)::BIGINT FROM g)
SELECT source, chars, floor(chars / 3.5)::BIGINT AS tokens FROM a
""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.token_budget(table(spark, sf_dir, "documents"), "source", F.length("text"))


@query("""
WITH o AS (SELECT lang AS family, count(*) AS ours FROM documents GROUP BY 1),
m AS (SELECT * FROM (VALUES ('en', 0), ('en', 1), ('de', 2), ('fr', 3)) t(family, benchmark)),
b AS (SELECT family, coalesce(sum(n), 0) AS bench FROM m LEFT JOIN (SELECT item_id % 5 AS benchmark, count(*) AS n FROM benchmark GROUP BY 1) USING (benchmark) GROUP BY 1)
SELECT family, ours, coalesce(bench, 0)::BIGINT AS bench, CASE WHEN coalesce(bench, 0) > 0 THEN round(ours / bench, 6) END AS ratio FROM o LEFT JOIN b USING (family)
""")
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.createDataFrame([("en", 0), ("en", 1), ("de", 2), ("fr", 3)], "family string, benchmark long")
    bench = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 5).alias("benchmark"))
    return report.coverage(table(spark, sf_dir, "documents").withColumnRenamed("lang", "family"), bench, mapping)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))


for _name, _sql in {"sqrt": "sqrt(n)", "linear": "n", "uniform": "1.0"}.items():

    @query(f"WITH g AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1) SELECT lang, n, round({_sql} / sum({_sql}) OVER (), 6) AS weight FROM g", name=f"family_weights_{_name}")
    def _weights(spark: SparkSession, sf_dir: str, strategy: str = _name) -> DataFrame:
        return curate.weights(_counts(spark, sf_dir), strategy=strategy)


@query("""
WITH g AS (SELECT lang, count(*) AS n FROM documents WHERE source <> 'src0' AND length(text) >= 200 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY 1),
w AS (SELECT lang, n, sqrt(n) * CASE lang WHEN 'en' THEN 0.5 WHEN 'de' THEN 2.0 ELSE 1.0 END AS x FROM g)
SELECT lang, n, round(x / sum(x) OVER (), 6) AS weight FROM w
""")
def variant_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix: predicates, without documents that failed an audit, with weights by group."""
    failed = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    docs = curate.excluding(table(spark, sf_dir, "documents").where((F.col("source") != "src0") & (F.length("text") >= 200)), "doc_id", failed)
    counts = docs.groupBy("lang").agg(F.count("*").alias("n"))
    return curate.weights(counts, multipliers={"en": 0.5, "de": 2.0}, key="lang")


@query("""
WITH g AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), w AS (SELECT lang, n, round(sqrt(n) / sum(sqrt(n)) OVER (), 6) AS weight FROM g),
t AS (SELECT *, floor(1000 * weight)::BIGINT AS take FROM w) SELECT lang, n, weight, take, take // n AS copies, take % n AS rest FROM t
""")
def weighted_sample_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.sample_plan(curate.weights(_counts(spark, sf_dir)), 1000)


@query("""
WITH g AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), w AS (SELECT lang, n, round(sqrt(n) / sum(sqrt(n)) OVER (), 6) AS weight FROM g),
t AS (SELECT lang, n, floor(1000 * weight)::BIGINT AS take FROM w), p AS (SELECT lang, take // n AS copies, take % n AS rest FROM t),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('7|' || doc_id), doc_id) AS r FROM documents),
c AS (SELECT doc_id, lang, copies + CASE WHEN r <= rest THEN 1 ELSE 0 END AS k FROM r JOIN p USING (lang))
SELECT doc_id, lang, unnest(range(1, k + 1)) AS copy FROM c WHERE k > 0
""")
def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = weighted_sample_plan(spark, sf_dir)
    return curate.resample(table(spark, sf_dir, "documents").select("doc_id", "lang"), plan, "lang", "doc_id", seed="7")


@query("""
WITH b AS (SELECT source, count(*) AS total, count(*) FILTER (quality = 1 AND toxic = 0) AS passed FROM documents JOIN labels USING (doc_id) GROUP BY 1),
g AS (SELECT source, total, passed, round(passed / total, 6) AS rate, source = 'unknown' OR round(passed / total, 6) >= 0.99 AS gate_ok FROM b),
t AS (SELECT * FROM g UNION ALL SELECT 'TOTAL', sum(total)::BIGINT, sum(passed)::BIGINT, round(sum(passed) / sum(total), 6), bool_and(gate_ok) FROM g)
SELECT *, total - passed AS failed FROM t
""")
def audit_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return report.pass_rates(joined, "source", (F.col("quality") == 1) & (F.col("toxic") == 0))


@query("SELECT doc_id, quality, toxic FROM labels WHERE NOT (quality = 1 AND toxic = 0) AND doc_id NOT IN (SELECT doc_id FROM documents WHERE source IN ('src1', 'src2'))")
def allowlist_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures that are on no allow-list (here: those of two sources)."""
    failures = table(spark, sf_dir, "labels").where("not (quality = 1 and toxic = 0)").select("doc_id", "quality", "toxic")
    allowed = table(spark, sf_dir, "documents").where(F.col("source").isin("src1", "src2")).select("doc_id")
    return curate.excluding(failures, "doc_id", allowed)


_GATE = "list_filter(['over_cap:novelty', 'low_quality', 'toxic', 'short', 'repeats'], lambda x: (x = 'over_cap:novelty' AND coalesce(doc_id % 100 > 95, false)) OR (x = 'low_quality' AND coalesce(quality = 0, false)) OR (x = 'toxic' AND coalesce(toxic = 1, false)) OR (x = 'short' AND length(text) < 100) OR (x = 'repeats' AND len(list_distinct(string_split(text, chr(10)))) < len(string_split(text, chr(10)))))"


@query(f"SELECT doc_id, array_to_string({_GATE}, ',') AS violations, len({_GATE}) = 0 AS accepted FROM documents LEFT JOIN labels USING (doc_id)")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    lines = F.split("text", "\n")
    caps = curate.cap_checks(F.create_map(F.lit("novelty"), (F.col("doc_id") % 100 / 100).cast("string")), {"novelty": curate.QUALITY_CAPS["novelty"]})
    v = curate.violations(caps | {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1, "short": F.length("text") < 100, "repeats": F.size(F.array_distinct(lines)) < F.size(lines)})
    return df.select("doc_id", v.alias("_v")).select("doc_id", F.array_join("_v", ",").alias("violations"), (F.size("_v") == 0).alias("accepted"))


@query(f"SELECT CASE WHEN len({_GATE}) = 0 THEN 'accepted' ELSE 'quarantined' END AS decision, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def quarantine_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = curate.quarantine(quality_gate(spark, sf_dir), F.col("accepted"))
    return good.withColumn("decision", F.lit("accepted")).unionByName(bad.withColumn("decision", F.lit("quarantined"))).groupBy("decision").agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT lang, doc_id, lpad((doc_id % 7)::VARCHAR, 3, '0') AS shard FROM documents),
c AS (SELECT lang, count(*) AS n, max(shard) AS last_shard, arg_max(doc_id, (shard, doc_id)) AS last_id FROM s GROUP BY 1)
SELECT lang, n, last_shard, lpad((last_shard::INT + 1)::VARCHAR, 3, '0') AS next_shard, last_id, greatest(0, 400 - n) AS remaining FROM c
""")
def progress_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("lang", "doc_id", F.lpad((F.col("doc_id") % 7).cast("string"), 3, "0").alias("shard"))
    p = report.shard_progress(s, "lang", "shard", "doc_id", ["shard", "doc_id"])
    return p.withColumn("remaining", F.greatest(F.lit(0).cast("long"), 400 - F.col("n")))


_DECISION = "CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'accept' ELSE 'hold' END"


@query(f"""
WITH s AS (SELECT source, doc_id, lpad((doc_id % 7)::VARCHAR, 3, '0') AS shard FROM documents WHERE doc_id % 20 <> 3),
d AS (SELECT source, {_DECISION} AS decision, count(*) AS n FROM s JOIN labels USING (doc_id) GROUP BY 1, 2),
t AS (SELECT source, count(*) * 2 - max(length(lang)) * 20 AS target FROM documents GROUP BY 1),
c AS (SELECT source, count(*) AS n, max(shard) AS last_shard, arg_max(doc_id, (shard, doc_id)) AS last_id FROM s GROUP BY 1)
SELECT source, target, coalesce(n, 0) AS n, greatest(0, target - coalesce(n, 0)) AS remaining, last_shard, coalesce(lpad((last_shard::INT + 1)::VARCHAR, 3, '0'), '000') AS next_shard, last_id, coalesce(decisions, '') AS decisions
FROM t LEFT JOIN c USING (source) LEFT JOIN (SELECT source, string_agg(decision || ':' || n, ',' ORDER BY decision) AS decisions FROM d GROUP BY 1) USING (source)
""")
def checkpoint_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress against targets by source (one source has no rows yet), with the labels' decisions."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    s = docs.where("doc_id % 20 <> 3").select("source", "doc_id", F.lpad((F.col("doc_id") % 7).cast("string"), 3, "0").alias("shard"))
    targets = docs.groupBy("source").agg((F.count("*") * 2 - F.max(F.length("lang")) * 20).cast("long").alias("target"))
    decisions = labels.select("doc_id", F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "accept").otherwise("hold").alias("decision"))
    out = report.checkpoint_summary(s, targets, decisions, "source", "shard", "doc_id", ["shard", "doc_id"])
    pairs = F.transform(F.map_entries("decisions"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return out.withColumn("decisions", F.array_join(pairs, ","))


@query("SELECT source, count(*) FILTER (doc_id >= 100) AS n FROM documents GROUP BY 1")
def gate_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", F.concat(F.lit("x-"), F.col("doc_id").cast("string")).alias("id"), F.lit("train").alias("split"))
    starts = docs.select("source").distinct().withColumn("start", F.lit(100))
    return report.gate_progress(docs, starts, "source", "id")


@query("SELECT doc_id, round(length(regexp_replace(text, '[^\\x{e0}-\\x{ff}]', '', 'g')) / greatest(length(text), 1), 6) AS share, regexp_matches(substring(text, 1, 500), '[\\x{e0}-\\x{ff}]') AS has FROM documents WHERE length(regexp_replace(text, '[^\\x{e0}-\\x{ff}]', '', 'g')) / greatest(length(text), 1) >= 0.05".replace("\\\\", "\\"))
def script_ratio_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = "à-ÿ"
    df = table(spark, sf_dir, "documents").select("doc_id", tx.script_share(F.col("text"), r).alias("share"), tx.has_script(F.col("text"), r, 500).alias("has"))
    return df.where("share >= 0.05").withColumn("share", F.round("share", 6))


@query("SELECT doc_id, length(substring(text, 1, 8000)) AS n FROM documents WHERE length(text) > 200")
def length_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A least length and a cut, both the feature."""
    return table(spark, sf_dir, "documents").where(F.length("text") > 200).select("doc_id", F.length(F.substring("text", 1, 8000)).cast("long").alias("n"))


_HTML = r"substring(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&[a-zA-Z]+;', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')), 1, 8000)"


@query(f"SELECT page_id, sha256({_HTML}) AS text_sha256, length({_HTML}) AS n FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tx.html_to_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", t.alias("_t")).select("page_id", F.sha2(F.col("_t").cast("binary"), 256).alias("text_sha256"), F.length("_t").cast("long").alias("n"))


_KW = r"list_slice(regexp_extract_all(regexp_replace(fact, '[^\p{L}\p{N}_\s\x{0e00}-\x{0e7f}]', ' ', 'g'), '[\x{0e00}-\x{0e7f}A-Za-z][\x{0e00}-\x{0e7f}A-Za-z0-9_]{3,}'), 1, 5)"


@query(f"""
WITH f AS (SELECT a.page_id AS id, [CASE WHEN a.page_id % 3 = 0 THEN coalesce(b.url, a.url) ELSE a.url END, 'http://missing.example'][1:1 + (a.page_id % 2)::INT] AS urls, a.fact
           FROM (SELECT *, {_HTML} AS fact FROM pages) a LEFT JOIN pages b ON b.page_id = a.page_id + 1),
p AS (SELECT url, any_value(body ORDER BY page_id) AS body FROM (SELECT page_id, url, {_HTML} AS body FROM pages) GROUP BY url),
k AS (SELECT id, urls, {_KW} AS kw FROM f), u AS (SELECT id, kw, unnest(urls) AS url FROM k),
h AS (SELECT id, max(CASE WHEN body IS NULL THEN 0 ELSE len(list_filter(kw, lambda x: contains(body, x))) END) AS hits, count(*) FILTER (body IS NULL) AS broken FROM u LEFT JOIN p USING (url) GROUP BY 1)
SELECT id, broken, (hits < 2)::BIGINT AS weak, CASE WHEN broken > 0 THEN 'FAIL' WHEN hits < 2 THEN 'WARN' ELSE 'OK' END AS status FROM h
""".replace("any_value(body ORDER BY page_id)", "arg_min(body, page_id)"))
def fact_keyword_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's text as its fact; every third cites the next page, and every second also a missing one."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", tx.html_to_text(F.col("html")).alias("body"))
    after = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("_after"))
    cited = F.when(F.col("page_id") % 3 == 0, F.coalesce("_after", "url")).otherwise(F.col("url"))
    urls = F.when(F.col("page_id") % 2 == 1, F.array(cited, F.lit("http://missing.example"))).otherwise(F.array(cited))
    facts = pages.join(after, "page_id", "left").select(F.col("page_id").alias("id"), F.lit(0).alias("fact_no"), F.col("body").alias("fact"), urls.alias("urls"))
    return evidence.fact_status(facts, pages.groupBy("url").agg(F.min_by("body", "page_id").alias("body"))).select("id", "broken", "weak", "status")
