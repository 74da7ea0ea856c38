"""Queries: answer extraction, voting, judging, ranking, spending, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers
from ..operators import score
from ..session import scratch
from . import pipelines
from .registry import query, table

_MATH = """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'So \\boxed{1} and then $\\boxed{' || o_custkey || '}$.' WHEN 1 THEN 'The final answer is ' || o_custkey || '/4.'
 WHEN 2 THEN 'work' || chr(10) || '= ' || o_custkey WHEN 3 THEN o_orderpriority || chr(10) || 'no number here' WHEN 4 THEN 'คำตอบคือ ' || o_custkey || ' และ' || chr(10) || o_orderstatus ELSE 'Answer: ' || o_custkey || '/4' END AS raw,
 CASE o_orderkey % 6 WHEN 1 THEN 'is ' || o_custkey || '/4' WHEN 3 THEN 'no number here' WHEN 4 THEN o_custkey || ' และ' WHEN 5 THEN o_custkey || '/4' ELSE o_custkey || '' END AS answer,
 CASE WHEN o_orderkey % 6 = 5 THEN 2 * o_custkey || '/8' ELSE o_custkey || '' END AS gold, o_orderkey % 6 AS k FROM orders"""


@query(f"SELECT id, answer, CASE WHEN k IN (0, 2) THEN 'strict' WHEN k = 5 THEN 'rational' END AS method FROM ({_MATH})".replace("\\\\", "\\"))
def math_answer_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses made of orders in six wordings; the oracle knows the answer that went in."""
    k, n = F.col("o_orderkey") % 6, F.col("o_custkey").cast("string")
    words = [
        F.concat(F.lit(r"So \boxed{1} and then $\boxed{"), n, F.lit("}$.")), F.concat(F.lit("The final answer is "), n, F.lit("/4.")), F.concat(F.lit("work\n= "), n),
        F.concat("o_orderpriority", F.lit("\nno number here")), F.concat(F.lit("คำตอบคือ "), n, F.lit(" และ\n"), "o_orderstatus"), F.concat(F.lit("Answer: "), n, F.lit("/4")),
    ]
    gold = F.when(k == 5, F.concat((2 * F.col("o_custkey")).cast("string"), F.lit("/8"))).otherwise(n)
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.get(F.array(*words), k.cast("int")).alias("raw"), gold.alias("gold"))
    return df.withColumn("answer", answers.extract_math(F.col("raw"))).select("id", "answer", answers.same_math(F.col("answer"), F.col("gold")).alias("method"))


@query("""
WITH p AS (SELECT p_partkey AS id, p_partkey % 4 AS k, 1 + p_partkey % 5 AS n FROM part), l AS (SELECT *, substring('abcde', n::INT, 1) AS c FROM p)
SELECT id, CASE k WHEN 3 THEN NULL ELSE c END AS choice, CASE k WHEN 0 THEN 'a' WHEN 1 THEN c WHEN 2 THEN '' ELSE 'e' END AS first,
 CASE k WHEN 0 THEN '(' || n || ')' WHEN 1 THEN '(' || c || ') is right' WHEN 2 THEN '(ค)' ELSE 'entailment' END AS exam FROM l
""")
def mcq_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices made of parts in four wordings."""
    k, n = F.col("p_partkey") % 4, (1 + F.col("p_partkey") % 5).cast("int")
    letter = lambda s: F.substr(F.lit(s), n, F.lit(1))
    words = [F.concat(F.lit("Answer is ("), letter("abcde"), F.lit(") not ("), n.cast("string"), F.lit(")")), F.concat(F.lit("("), letter("abcde"), F.lit(") is right")), F.concat(F.lit("คำตอบคือ "), letter("๑๒๓๔๕")), F.lit("entailment")]
    x = F.col("raw")
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.get(F.array(*words), k.cast("int")).alias("raw"))
    return df.select("id", answers.extract_choice(x).alias("choice"), answers.first_letter(x).alias("first"), answers.extract_exam(x).alias("exam"))


@query("""
WITH w AS (SELECT a.item_id, string_split(lower(a.text), ' ') AS p, string_split(lower(b.text), ' ') AS g FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
s AS (SELECT item_id, list_distinct(p) AS p, list_distinct(g) AS g, len(list_intersect(p, g)) AS b FROM w)
SELECT item_id, round(CASE WHEN b = 0 THEN 0.0 ELSE 2.0 * b / (len(p) + len(g)) END, 6) AS f1 FROM s
""")
def set_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each item against those of the next."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.split(F.lower("text"), " ").alias("p"))
    both = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("p").alias("g")), "item_id")
    return both.select("item_id", F.round(score.set_f1(F.col("p"), F.col("g")), 6).alias("f1"))


_SAMPLES = "SELECT l_orderkey AS item, CASE WHEN l_quantity::INT % 5 = 0 THEN NULL ELSE (l_quantity::INT % 4)::VARCHAR END AS answer, l_linenumber::BIGINT * 1000000000000 + l_partkey * 1000000 + l_suppkey AS no, -l_discount::DOUBLE AS lp FROM lineitem"


def _no() -> Column:
    """An order of an item's rows without ties."""
    return F.col("l_linenumber").cast("long") * 1_000_000_000_000 + F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.when(q % 5 != 0, (q % 4).cast("string")).alias("answer"), _no().alias("no"), (-F.col("l_discount").cast("double")).alias("lp"))


@query(f"""
WITH s AS ({_SAMPLES}), c AS (SELECT item, answer, count(*) AS n, min(no) AS f FROM s WHERE answer IS NOT NULL GROUP BY 1, 2),
b AS (SELECT item, arg_max(answer, (n, -f)) AS vote, max(n) AS votes FROM c GROUP BY 1)
SELECT i.item, vote, coalesce(votes, 0)::BIGINT AS votes FROM (SELECT DISTINCT item FROM s) i LEFT JOIN b USING (item)
""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.majority_vote(_samples(spark, sf_dir), "item", "answer", "no")


@query(f"""
WITH s AS ({_SAMPLES}), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY lp DESC, no) AS r, greatest(floor(count(*) OVER (PARTITION BY item) * 0.75), 1) AS k FROM s WHERE answer IS NOT NULL),
c AS (SELECT item, answer, round(sum(exp(lp)), 6) AS w, min(no) AS f FROM r WHERE r <= k GROUP BY 1, 2)
SELECT item, arg_max(answer, (w, -f)) AS vote, max(w) AS weight FROM c GROUP BY 1
""")
def confidence_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.confidence_vote(_samples(spark, sf_dir), "item", "answer", "lp", "no")


@query("WITH s AS (SELECT l_orderkey AS item, l_linenumber::BIGINT * 1000000000000 + l_partkey * 1000000 + l_suppkey AS no, l_extendedprice::DOUBLE AS score FROM lineitem) SELECT item, arg_max(no, (score, -no)) AS best, max(score) AS best_score, arg_min(score, no) AS first_score FROM s GROUP BY 1")
def best_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), _no().alias("no"), F.col("l_extendedprice").cast("double").alias("score"))
    return score.best_of_n(s, "item", "no", "score")


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'A' WHEN l_returnflag = 'R' THEN 'B' ELSE 'tie' END AS f, CASE WHEN l_quantity::INT % 2 = 0 THEN 'B' ELSE 'A' END AS b FROM lineitem)
SELECT CASE WHEN f = CASE b WHEN 'A' THEN 'B' ELSE 'A' END THEN f ELSE 'tie' END AS winner, count(*) AS n FROM p GROUP BY 1
""")
def pairwise_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    f = F.when(flag == "N", "A").when(flag == "R", "B").otherwise("tie")
    b = F.when(F.col("l_quantity").cast("int") % 2 == 0, "B").otherwise("A")
    return table(spark, sf_dir, "lineitem").select(score.pairwise_winner(f, b).alias("winner")).groupBy("winner").agg(F.count("*").alias("n"))


_SCORES = "SELECT p_brand AS bench, round(avg(p_retailprice::DOUBLE) / 2000, 6) AS score FROM part GROUP BY 1"


@query(f"""
WITH s AS ({_SCORES}), b AS (SELECT DISTINCT p_brand AS bench, 0.5 AS baseline FROM part WHERE p_size % 2 = 0 AND p_brand < 'Brand#4'), j AS (SELECT bench, score, round(score - baseline, 4)::DOUBLE AS delta FROM s LEFT JOIN b USING (bench))
SELECT bench, score, delta, CASE WHEN delta IS NULL THEN 'not published' ELSE printf('%+.4f', delta) END AS delta_text FROM j
""")
def baseline_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    s = part.groupBy(F.col("p_brand").alias("bench")).agg(F.round(F.avg(F.col("p_retailprice").cast("double")) / 2000, 6).alias("score"))
    b = part.where("p_size % 2 = 0 and p_brand < 'Brand#4'").select(F.col("p_brand").alias("bench")).distinct().withColumn("baseline", F.lit(0.5))
    return score.baseline_delta(s, b, ["bench"]).drop("baseline")


@query("""
WITH r AS (SELECT c_mktsegment AS model, n_name AS bench, avg(c_acctbal::DOUBLE) AS accuracy FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), t AS (SELECT n_name AS bench, 1000.0 + n_nationkey AS target FROM nation),
s AS (SELECT model, round(avg(accuracy / target), 6) AS score FROM r JOIN t USING (bench) GROUP BY 1) SELECT model, score, row_number() OVER (ORDER BY score DESC, model)::INT AS rank FROM s
""")
def model_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("c_mktsegment").alias("model"), F.col("n_name").alias("bench")).agg(F.avg(F.col("c_acctbal").cast("double")).alias("accuracy"))
    return score.rank_models(r, nation.select(F.col("n_name").alias("bench"), (F.col("n_nationkey") + 1000.0).alias("target")), "model", "bench")


_CATEGORIES = [("money", ["spam", "pills", "bets"]), ("people", ["the "]), ("places", [" en ", " der "])]


@query("""
WITH c AS (SELECT doc_id, CASE WHEN contains(s, 'spam') OR contains(s, 'pills') OR contains(s, 'bets') THEN 'money' WHEN contains(s, 'the ') THEN 'people' WHEN contains(s, ' en ') OR contains(s, ' der ') THEN 'places' ELSE 'other' END AS category
FROM (SELECT doc_id, lower(substring(text, 1, 500)) AS s FROM documents))
SELECT category, count(*) AS n, round(avg((quality = 1)::INT), 6) AS accuracy FROM c JOIN labels USING (doc_id) GROUP BY 1 HAVING count(*) >= 3 ORDER BY accuracy, category LIMIT 5
""")
def weakest_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import first_match

    c = table(spark, sf_dir, "documents").select("doc_id", first_match(F.col("text"), _CATEGORIES, "other").alias("category")).join(table(spark, sf_dir, "labels"), "doc_id")
    return score.weakest(c, "category", F.col("quality") == 1)


@query("""
WITH s AS (SELECT event_id, user_id, round(sum(value::DECIMAL(18,4)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4)::DOUBLE AS spent FROM events)
SELECT event_id, user_id, spent, spent > 500 AS over_cap FROM s
""")
def judge_spend_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    s = score.running_spend(e, "user_id", ["ts", "event_id"], F.col("value").cast("decimal(18,4)"), 500)
    return s.select("event_id", "user_id", F.round(F.col("spent").cast("double"), 4).alias("spent"), (F.col("spent") > 500).alias("over_cap"))


@query("SELECT coalesce(source, 'overall') AS source, count(*) AS n, round(avg((quality = 1)::INT), 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (source)")
def subject_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return score.rollup_accuracy(j, "source", F.col("quality") == 1).withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT count(*) AS n, count(*) FILTER (quality = 1) AS n_pass, count(*) FILTER (toxic = 1) AS n_error, round(avg((quality = 1)::INT), 6) AS pass_at_1 FROM labels")
def pass_at_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = score.pass_rate(table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 1)
    return p.withColumn("pass_at_1", F.round("pass_at_1", 6))


@query("SELECT count(*) AS n, round(avg(CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END), 4) AS old_mean, round(avg(CASE WHEN event_id % 4 <> 0 THEN value END), 4) AS new_mean, count(CASE WHEN event_id % 4 <> 0 THEN value END) AS n_rescored FROM events")
def rescore_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("old"), F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("new"))
    return score.rescored(e, "old", "new").withColumn("old_mean", F.round("old_mean", 4)).withColumn("new_mean", F.round("new_mean", 4))


@query("SELECT count(DISTINCT user_id) AS n FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event of each user by a stream over the events file, run to its end into a table of the shared folder."""
    from ..streaming.loops import first_seen

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = scratch(spark, "stream")
    q = first_seen(stream.select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", late="3650 days").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/rows").agg(F.count("*").alias("n"))


_RULES = "CASE lang WHEN 'en' THEN quality::DOUBLE WHEN 'de' THEN 1 - toxic::DOUBLE WHEN 'fr' THEN least(length(text) / 1000, 1) END"


@query(f"SELECT lang AS family, 'score' AS metric, round(coalesce(avg({_RULES}), 0.0), 6) AS value, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def family_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each family by its own rule; a family without one scores 0."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumnRenamed("lang", "family")
    rules = {"en": F.col("quality"), "de": 1 - F.col("toxic"), "fr": F.least(F.length("text") / 1000, F.lit(1.0))}
    return pipelines.score_families(rows, rules)
