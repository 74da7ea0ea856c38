"""Queries: duplicates, contamination, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..operators import curate, neardup
from . import pipelines
from .registry import ORACLES, query, table

#: The white space that Spark's (?U)\s removes, for RE2.
_WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_NORM = f"regexp_replace(lower(text), '{_WS}', '', 'g')"
_GRAMS = """
dn AS (SELECT doc_id, {norm} AS n FROM documents WHERE text IS NOT NULL),
bn AS (SELECT item_id, {norm} AS n FROM benchmark WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, substring(n, i, 5) AS g FROM (SELECT doc_id, n, unnest(range(1, length(n) - 3)) AS i FROM dn WHERE length(n) >= 5)
       UNION SELECT doc_id, n FROM dn WHERE length(n) BETWEEN 1 AND 4),
bg AS (SELECT DISTINCT item_id, substring(n, i, 5) AS g FROM (SELECT item_id, n, unnest(range(1, length(n) - 3)) AS i FROM bn WHERE length(n) >= 5)
       UNION SELECT item_id, n FROM bn WHERE length(n) BETWEEN 1 AND 4),
ds AS (SELECT doc_id, count(*) AS a FROM dg GROUP BY 1), bs AS (SELECT item_id, count(*) AS b FROM bg GROUP BY 1),
both_ AS (SELECT doc_id, item_id, count(*) AS i FROM dg JOIN bg USING (g) GROUP BY 1, 2),
j AS (SELECT doc_id, item_id, i / (a + b - i) AS jac, i / b AS con FROM both_ JOIN ds USING (doc_id) JOIN bs USING (item_id))
""".format(norm=_NORM)


@query(f"""
WITH {_GRAMS},
best AS (SELECT doc_id, max(jac) AS jac, arg_max(item_id, (jac, -item_id)) AS item_id FROM j GROUP BY 1)
SELECT d.doc_id, item_id, round(coalesce(jac, 0.0), 6) AS jaccard_max,
       CASE WHEN round(coalesce(jac, 0.0), 6) >= 0.35 THEN 'reject' ELSE 'accept' END AS decision
FROM documents d LEFT JOIN best USING (doc_id)
""")
def ngram_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(f"""
WITH {_GRAMS}
SELECT doc_id, item_id, round(con, 6) AS containment FROM j WHERE con >= 0.5
""")
def benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = neardup.containment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least=0.5)
    return c.withColumn("containment", F.round("containment", 6))


@query(f"""
WITH {_GRAMS},
p AS (SELECT doc_id, item_id, jac FROM j WHERE jac >= 0.25),
db AS (SELECT doc_id, unnest(range(0, 64)) AS k, sha256(g) AS h FROM dg WHERE doc_id IN (SELECT doc_id FROM p)),
bb AS (SELECT item_id, unnest(range(0, 64)) AS k, sha256(g) AS h FROM bg WHERE item_id IN (SELECT item_id FROM p)),
dv AS (SELECT doc_id, k, sum(CASE WHEN (('0x' || h[1 + k // 4])::INT >> (3 - k % 4)) & 1 = 1 THEN 1 ELSE -1 END) > 0 AS v FROM db GROUP BY 1, 2),
bv AS (SELECT item_id, k, sum(CASE WHEN (('0x' || h[1 + k // 4])::INT >> (3 - k % 4)) & 1 = 1 THEN 1 ELSE -1 END) > 0 AS v FROM bb GROUP BY 1, 2)
SELECT p.doc_id, p.item_id, round(any_value(jac), 6) AS jaccard, round(count(*) FILTER (dv.v = bv.v) / 64, 6) AS similarity
FROM p JOIN dv USING (doc_id) JOIN bv ON bv.item_id = p.item_id AND bv.k = dv.k GROUP BY 1, 2
""")
def simhash_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.simhash_of_similar(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(f"SELECT (SELECT max(jaccard_max) FROM ({ORACLES['ngram_contamination']})) AS jaccard_max, (SELECT coalesce(max(similarity), 0.0) FROM ({ORACLES['simhash_similarity']})) AS simhash_max")
def corpus_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest similarities of the corpus with the benchmark."""
    return neardup.corpus_maxima(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(f"""
SELECT doc_id, coalesce(sha256({_NORM}) IN (SELECT sha256({_NORM}) FROM benchmark WHERE text IS NOT NULL), false) AS exact_match FROM documents
""")
def benchmark_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.exact_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(f"SELECT DISTINCT sha256({_NORM}) AS sha256 FROM benchmark WHERE text IS NOT NULL")
def hash_blacklist_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.hash_manifest(table(spark, sf_dir, "benchmark"))


@query("""
WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id, b.vec_id AS match_id, round(list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS c FROM q JOIN embeddings b ON q.vec_id <> b.vec_id)
SELECT vec_id, arg_max(match_id, (c, -match_id)) AS match_id, round(max(c), 6) AS cosine,
       CASE WHEN round(max(c), 6) >= 0.92 THEN 'quarantine' ELSE 'accept' END AS decision FROM s GROUP BY 1
""")
def embedding_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set (every 50th id) against all other vectors."""
    e = table(spark, sf_dir, "embeddings")
    return neardup.nearest_vectors(e.where("vec_id % 50 = 0"), e, others=True)


@query(f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY {_NORM} ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def exact_dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(normalize(F.col("text")).cast("binary"), 256).alias("_h"))
    return curate.first_of(docs, [F.col("_h")], ["doc_id"]).drop("_h")


@query(f"SELECT doc_id, 'duplicate text' AS reason FROM (SELECT *, row_number() OVER (PARTITION BY {_NORM} ORDER BY doc_id) AS r FROM documents) WHERE r > 1")
def duplicate_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(normalize(F.col("text")).cast("binary"), 256).alias("_h"))
    return curate.later_copies(docs, [F.col("_h")], ["doc_id"]).select("doc_id", F.lit("duplicate text").alias("reason"))


@query("SELECT doc_id, prefix_chars FROM (SELECT doc_id, length(substring(text, 1, 200)) AS prefix_chars, row_number() OVER (PARTITION BY substring(text, 1, 200) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def prefix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.substring("text", 1, 200)
    docs = table(spark, sf_dir, "documents").select("doc_id", key.alias("_p"), F.length(key).cast("long").alias("prefix_chars"))
    return curate.first_of(docs, [F.col("_p")], ["doc_id"]).drop("_p")


_SPLIT = """
SELECT doc_id, lang, source, CASE WHEN r <= CASE WHEN n >= 10 THEN greatest(1, round_even(n * 0.1, 0)) WHEN n >= 3 THEN 1 ELSE 0 END THEN 'validation' ELSE 'train' END AS split
FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY substring(sha256(doc_id::VARCHAR), 1, 16), doc_id) AS r, count(*) OVER (PARTITION BY lang, source) AS n FROM documents)
"""


@query(_SPLIT)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", ["lang", "source"])


@query(f"SELECT split, lang, count(*) AS n FROM ({_SPLIT}) GROUP BY 1, 2")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_split(spark, sf_dir).groupBy("split", "lang").agg(F.count("*").alias("n"))


@query("SELECT doc_id, ('0x' || substring(sha256(doc_id::VARCHAR), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 < 0.1 AS in_tenth FROM documents")
def stable_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import stable_bucket as bucket

    return table(spark, sf_dir, "documents").select("doc_id", (bucket(F.col("doc_id").cast("string")) < 0.1).alias("in_tenth"))


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 3")
def first_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return curate.first_of(docs, [F.col("source")], [F.col("doc_id")], k=3)


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND length(text) >= 200 ORDER BY doc_id LIMIT 50")
def cap_after_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap is the feature: it counts accepted rows."""
    return table(spark, sf_dir, "documents").where((F.col("lang") == "en") & (F.length("text") >= 200)).select("doc_id").orderBy("doc_id").limit(50)


@query("SELECT source, doc_id, replace(substring(text, 1, 160), chr(10), ' ') AS sample FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 2")
def side_by_side_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.replace(F.substring("text", 1, 160), F.lit("\n"), F.lit(" ")).alias("sample"))
    return curate.first_of(docs, [F.col("source")], [F.col("doc_id")], k=2)


@query(f"""
WITH {_GRAMS},
best AS (SELECT doc_id, max(jac) AS jac FROM j GROUP BY 1),
e AS (SELECT doc_id, coalesce({_NORM.replace("text", "d.text")} IN (SELECT {_NORM} FROM benchmark WHERE text IS NOT NULL), false) AS exact FROM documents d)
SELECT d.doc_id, exact AS exact_match, round(coalesce(jac, 0.0), 6) AS jaccard_max,
       array_to_string(list_concat(CASE WHEN coalesce(length(text) < 400, false) THEN ['short'] ELSE [] END, CASE WHEN coalesce(source = 'src3', false) THEN ['source'] ELSE [] END), ',') AS reasons,
       CASE WHEN exact OR coalesce(jac, 0.0) >= 0.35 THEN 'reject' WHEN coalesce(length(text) < 400, false) OR coalesce(source = 'src3', false) THEN 'quarantine' ELSE 'accept' END AS decision
FROM documents d JOIN e USING (doc_id) LEFT JOIN best USING (doc_id)
""")
def package_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packaging run: contamination and exact matches reject, broken rules quarantine, all with reasons."""
    checks = {"short": F.length("text") < 400, "source": F.col("source") == "src3"}
    out = pipelines.package(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), checks, "doc_id")
    return out.select("doc_id", "exact_match", "jaccard_max", F.array_join("reasons", ",").alias("reasons"), "decision")
