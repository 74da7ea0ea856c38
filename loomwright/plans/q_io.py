"""Queries: files written and read back, streams, benchmark rows as prediction inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extras, report
from ..session import scratch
from ..sources import mappers, readers, sinks
from ..streaming import loops, topics
from .registry import query, table

_ROW = "doc_id long, lang string, n_chars long"


def _shards(spark: SparkSession, sf_dir: str) -> str:
    """Documents as shards train_<lang>_00<k>.jsonl and val_..., with a blank and a broken line in each, before the others."""
    path, langs = scratch(spark, "shards"), ("de", "en", "es", "fr")
    docs = table(spark, sf_dir, "documents").where(F.col("lang").isin(*langs)).select("doc_id", "lang", F.length("text").cast("long").alias("n_chars"))
    k = F.col("doc_id") % 3
    name = F.concat(F.when(k == 2, "val").otherwise("train"), F.lit("_"), "lang", F.lit("_00"), F.when(k == 2, 0).otherwise(k).cast("string"), F.lit(".jsonl"))
    lines = docs.select(name.alias("name"), "doc_id", F.to_json(F.struct("doc_id", "lang", "n_chars")).alias("value"))
    names = [f"{split}_{lang}_{n}.jsonl" for lang in langs for split, n in (("train", "000"), ("train", "001"), ("val", "000"))]
    extra = spark.createDataFrame([(n, i, v) for n in names for i, v in ((-2, ""), (-1, '{"doc_id": broken'))], "name string, doc_id long, value string")
    sinks.write_shards(lines.unionByName(extra), path, "name", ["doc_id"])
    return path


_PLACED = "SELECT doc_id, lang, length(text)::BIGINT AS n_chars, CASE WHEN doc_id % 3 = 2 THEN 'val' ELSE 'train' END AS split, '00' || CASE WHEN doc_id % 3 = 2 THEN 0 ELSE doc_id % 3 END AS shard FROM documents WHERE lang IN ('de', 'en', 'es', 'fr')"
_GROUPS = f"SELECT split, lang AS family, shard, count(*) AS n, sum(doc_id)::BIGINT AS ids, sum(n_chars)::BIGINT AS chars FROM ({_PLACED}) GROUP BY ALL"
#: Every shard is there, with documents or without.
_ALL = "SELECT split, family, shard FROM (VALUES ('train', '000'), ('train', '001'), ('val', '000')) a(split, shard), (VALUES ('de'), ('en'), ('es'), ('fr')) b(family)"


@query(f"SELECT split, family, shard, coalesce(n, 0) + 1 AS n, coalesce(ids, 0) AS ids, coalesce(chars, 0) AS chars, 1 AS n_corrupt FROM ({_ALL}) LEFT JOIN ({_GROUPS}) USING (split, family, shard)")
def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of the shards with provenance from the file names; broken ones are kept apart, blank ones skipped."""
    df = readers.read_jsonl(spark, _shards(spark, sf_dir), _ROW)
    bad = F.count_if(F.col("_corrupt_record").isNotNull()).alias("n_corrupt")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(x) for c, x in (("doc_id", "ids"), ("n_chars", "chars"))]
    return df.groupBy(F.col("_split").alias("split"), F.col("_family").alias("family"), F.col("_shard").alias("shard")).agg(F.count("*").alias("n"), *sums, bad)


@query(f"SELECT doc_id, lang, n_chars, split FROM ({_PLACED})")
def jsonl_drop_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = readers.read_jsonl(spark, _shards(spark, sf_dir), _ROW, "drop")
    return df.where("doc_id is not null").select("doc_id", "lang", "n_chars", F.col("_split").alias("split"))


@query(f"SELECT split || '_' || family || '_' || shard || '.jsonl:2' AS id, 'load_error: ' || split || '_' || family || '_' || shard || '.jsonl:2' AS reason FROM ({_ALL})")
def jsonl_load_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An error row with file and line for each broken line (the second of each shard)."""
    return readers.load_errors(readers.read_numbered(spark, _shards(spark, sf_dir))).select("id", "reason")


@query("SELECT count(*) + 12 AS n_lines, count(*) + 24 AS with_blank FROM documents WHERE lang IN ('de', 'en', 'es', 'fr')")
def jsonl_line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _shards(spark, sf_dir)
    return spark.createDataFrame([(readers.count_lines(spark, path), readers.count_lines(spark, path, blank=True))], "n_lines long, with_blank long")


@query("SELECT doc_id, lang, coalesce(source, 'none') AS source, 1 AS version FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def recovered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materialised records (each twice, and one without an id) that aren't known yet, with defaults."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    nameless = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))
    return readers.recovered(docs.union(docs).union(nameless), table(spark, sf_dir, "labels"), "doc_id", {"source": F.lit("none"), "version": F.lit(1)})


@query("SELECT text FROM documents WHERE trim(text, ' ') <> '' UNION ALL SELECT lang FROM documents UNION ALL SELECT source FROM documents UNION ALL SELECT '{\"id\":' || doc_id || '}' FROM documents")
def benchmark_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text, an array (with an empty element) and a struct of each row as texts; an unknown field is passed over."""
    df = table(spark, sf_dir, "documents").select("text", F.array("lang", F.lit(" "), "source").alias("names"), F.struct(F.col("doc_id").alias("id")).alias("key"))
    return readers.texts_of(df, ["text", "names", "key", "not there"])


@query("SELECT 'first' AS load, count(*) AS n FROM benchmark UNION ALL SELECT 'again', count(*) FROM benchmark")
def cached_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loaded, stored, and then taken from the store (the second way to load would give nothing)."""
    cache = scratch(spark, "cache")
    first = readers.cached_or(spark, cache, lambda: table(spark, sf_dir, "benchmark"))
    first.write.parquet(cache)
    again = readers.cached_or(spark, cache, lambda: table(spark, sf_dir, "benchmark").limit(0))
    return first.agg(F.lit("first").alias("load"), F.count("*").alias("n")).union(again.agg(F.lit("again"), F.count("*")))


@query("SELECT doc_id, substring(text, 1, 1200) AS text FROM documents ORDER BY doc_id LIMIT 120")
def prefix_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 120 rows, cut to 1,200 characters (both are the feature)."""
    return readers.prefix_sample(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], "text")


@query("SELECT item_id FROM benchmark")
def split_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first split that exists."""
    return readers.first_available(lambda: table(spark, sf_dir, "benchmark_test"), lambda: table(spark, sf_dir, "benchmark")).select("item_id")


@query("""
SELECT 'aime' AS family, p_partkey || '' AS id, p_name AS prompt, p_size || '' AS gold, NULL AS subject FROM part UNION ALL
SELECT 'math500', 'u' || o_orderkey, o_orderpriority, o_custkey || '', NULL FROM orders UNION ALL
SELECT 'mt_bench', c_custkey || '', c_name, '', NULL FROM customer UNION ALL
SELECT 'openthaieval', s_suppkey || '', s_name, s_nationkey || '', 'law' FROM supplier UNION ALL
SELECT 'ifeval', conv_id || '', coalesce(text, ''), '', NULL FROM conversations UNION ALL
SELECT 'livecodebench', event_id || '', event_type, '', NULL FROM events UNION ALL
SELECT 'hotpotqa', item_id || '', coalesce(text, ''), 'a', NULL FROM benchmark UNION ALL
SELECT 'thai_exam_onet', 'onet_' || n_nationkey, n_name || chr(10) || chr(10) || '(a) ' || n_nationkey || chr(10) || '(c) ' || n_regionkey || chr(10) || chr(10) || 'ตอบเฉพาะตัวอักษรของคำตอบ (a, b, c, d, หรือ e)', 'c', 'onet' FROM nation
""")
def prediction_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables in the shapes of eight benchmarks, mapped to one."""
    t = lambda name: table(spark, sf_dir, name)
    tables = {
        "aime": t("part").select(F.col("p_partkey").alias("Problem Number"), F.lit("").alias("problem"), F.col("p_name").alias("question"), F.col("p_size").alias("answer")),
        "math500": t("orders").select(F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("unique_id"), F.col("o_orderpriority").alias("problem"), F.col("o_custkey").alias("answer")),
        "mt_bench": t("customer").select(F.col("c_custkey").alias("question_id"), F.array("c_name", F.lit("second")).alias("turns"), F.lit("x").alias("category")),
        "openthaieval": t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("instruction"), F.col("s_nationkey").alias("result"), F.lit("law").alias("subject")),
        "ifeval": t("conversations").select(F.col("conv_id").alias("key"), F.col("text").alias("prompt")),
        "livecodebench": t("events").select(F.col("event_id").alias("question_id"), F.col("event_type").alias("question_content")),
        "hotpotqa": t("benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"), F.lit("a").alias("answer")),
        "thai_exam": t("nation").select(F.lit("onet").alias("subject"), F.col("n_nationkey").alias("no"), F.col("n_name").alias("question"), F.col("n_nationkey").alias("a"), F.lit(" ").alias("b"), F.col("n_regionkey").alias("c"), F.lit(" C ").alias("answer")),
    }
    return mappers.all_mapped(tables).select("family", "id", "prompt", "gold", "subject")


_ALIASES = ", ".join(f"('{k}', {v})" for k, v in readers.ALIASES.items())
_ASKED = "CASE c_custkey % 5 WHEN 0 THEN 'aime' WHEN 1 THEN 'thai_exam' WHEN 2 THEN 'aime24' WHEN 3 THEN 'all' ELSE c_name END"


@query(f"""
WITH w AS (SELECT c_custkey AS a, {_ASKED} AS n FROM customer), al(k, v) AS (VALUES {_ALIASES}),
p AS (SELECT a, unnest(range(len(coalesce(v, [n])))) AS b, unnest(coalesce(v, [n])) AS n FROM w LEFT JOIN al ON k = n WHERE n <> 'all'
      UNION ALL SELECT (SELECT min(a) FROM w WHERE n = 'all'), n_nationkey, n_name FROM nation WHERE EXISTS (SELECT 1 FROM w WHERE n = 'all'))
SELECT a AS place, b::BIGINT AS part, n AS name FROM p QUALIFY row_number() OVER (PARTITION BY n ORDER BY a, b) = 1
""")
def family_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that customers ask for, with aliases and `all` written out, each where it comes first."""
    k = F.col("c_custkey") % 5
    asked = F.when(k == 0, "aime").when(k == 1, "thai_exam").when(k == 2, "aime24").when(k == 3, "all").otherwise(F.col("c_name"))
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("place"), asked.alias("name"))
    known = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("name"))
    out = readers.names_expanded(wanted, known)
    return out.select(F.col("place").cast("long").alias("place"), F.col("part").cast("long").alias("part"), "name")


@query("SELECT max(p_partkey) AS newest, count(*) AS n FROM part")
def newest_by_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.concat(F.lit("checkpoint-"), F.col("p_partkey").cast("string")).alias("name"))
    return names.agg(F.max(extras.numeric_suffix(F.col("name"))).alias("newest"), F.count("*").alias("n"))


@query("SELECT lang, count(*) AS n, 2 * count(*) AS after_append FROM documents GROUP BY 1")
def partition_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions counted without writing, written, written anew (nothing is added), then appended to."""
    path = scratch(spark, "parts")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit("train").alias("split"))
    counts = sinks.write_partitions(docs, path, ("split", "lang"), dry_run=True)
    for _ in range(2):
        sinks.write_partitions(docs, path, ("split", "lang"))
    extra = scratch(spark, "more")
    sinks.append_family(docs, extra)
    sinks.append_family(docs, extra)
    back = spark.read.schema("doc_id long, split string, lang string").json(path).groupBy("lang").agg(F.count("*").alias("_once"))
    twice = spark.read.schema("doc_id long, lang string").json(extra).groupBy("lang").agg(F.count("*").alias("after_append"))
    return counts.select("lang", "n").join(back, "lang").where("_once = n").join(twice, "lang").select("lang", "n", "after_append")


@query("SELECT true AS wrote, false AS again, true AS changed")
def write_if_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "same")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = [tuple(sinks.write_if_changed(df, path, ["doc_id"]) for df in (docs, docs.repartition(3), docs.where("doc_id > 0")))]
    return spark.createDataFrame(rows, "wrote boolean, again boolean, changed boolean")


@query("""
WITH g AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), w AS (SELECT lang, n, round(n / sum(n) OVER (), 6) AS w FROM g)
SELECT 'linear' AS strategy, sum(n)::BIGINT AS total, round(sum(w), 4) AS weights, string_agg(lang || ':' || n, ',' ORDER BY lang) AS counts FROM w
""")
def mix_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest written as JSON, read back field by field."""
    from ..operators import curate

    counts = curate.weights(table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")), strategy="linear")
    m = F.from_json("manifest", "strategy string, train_counts map<string,long>, weights map<string,double>")
    sums = lambda c, kind: F.aggregate(F.map_values(c), F.lit(0).cast(kind), lambda a, x: a + x)
    entries = F.array_sort(F.transform(F.map_entries("m.train_counts"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))))
    return sinks.manifest(counts, "lang", "n", "weight", "linear").select(m.alias("m")).select("m.strategy", sums("m.train_counts", "long").alias("total"), F.round(sums("m.weights", "double"), 4).alias("weights"), F.array_join(entries, ",").alias("counts"))


_KINDS = ["unit_tests", "regex", "json_schema", "retrieval_evidence", "exact_match"]


@query(f"SELECT CASE k WHEN 0 THEN 'unit_tests' WHEN 3 THEN 'retrieval' ELSE 'instructions' END AS side, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id, doc_id % 5 AS k FROM documents) WHERE k < 4 GROUP BY 1")
def verifier_side_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.get(F.array(*map(F.lit, _KINDS)), (F.col("doc_id") % 5).cast("int")).alias("verifier_type"))
    out = None
    for name, part in sinks.side_tables(docs).items():
        one = part.agg(F.lit(name).alias("side"), F.count("*").alias("n"), F.sum("doc_id").alias("ids"))
        out = one if out is None else out.union(one)
    return out


@query("SELECT '| lang | n |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || lang || ' | ' || n || ' |' || chr(10), '' ORDER BY lang) AS report FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang")
    return spark.createDataFrame([(report.markdown(g),)], "report string")


@query("""
SELECT sha256(string_agg(sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '"}'), chr(10) ORDER BY doc_id)) AS sha256 FROM (SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 10000)
""")
def dataset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash of the first 10,000 rows (the cut is the feature)."""
    return report.fingerprint(table(spark, sf_dir, "documents").select("lang", "doc_id"), ["doc_id"])


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loop of batches, each appending its counts to a table; the batch number is the cycle."""
    out = scratch(spark, "cycles")

    def step(batch: DataFrame, cycle: int) -> None:
        batch.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/rows/cycle={cycle}")

    loops.cycles(_events(spark, sf_dir).select("event_type"), step, f"{out}/log").awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy("event_type").agg(F.sum("n").alias("n"))


@query("SELECT n_nationkey AS id, 'n' || n_nationkey AS name FROM nation UNION ALL SELECT r_regionkey, 'r' || r_regionkey FROM region")
def stream_watched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder in turn, one to a batch; a second run reads only what is new."""
    folder, out = scratch(spark, "watched"), scratch(spark, "seen")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("name"))

    def run() -> None:
        loops.cycles(loops.watch_files(spark, folder, "id int, name string", files_per_batch=1), lambda b, k: b.write.mode("overwrite").parquet(f"{out}/rows/batch={k}"), f"{out}/log").awaitTermination()

    sinks.append_family(n.coalesce(2), folder)
    run()
    sinks.append_family(r.coalesce(1), folder)
    run()
    return spark.read.parquet(f"{out}/rows").select("id", "name")


@query("""
WITH a AS (SELECT event_id, event_type = 'click' AS ok, row_number() OVER (PARTITION BY event_type = 'click' ORDER BY event_id) AS r FROM events)
SELECT CASE WHEN NOT ok THEN 'rejected' WHEN r <= 150 THEN 'taken' ELSE 'over_target' END AS status, count(*) AS n, sum(event_id)::BIGINT AS ids FROM a GROUP BY 1
""")
def stream_until_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted rows until there are 150 (the cap is the feature); all others are logged with a reason."""
    out = scratch(spark, "target")
    stream = _events(spark, sf_dir).select("event_id", "event_type")
    loops.append_until(stream, f"{out}/rows", f"{out}/log", F.col("event_type") == "click", 150, f"{out}/state", ["event_id"]).awaitTermination()
    rows = spark.read.parquet(f"{out}/rows").select(F.lit("taken").alias("status"), "event_id")
    log = spark.read.parquet(f"{out}/log").select(F.col("reason").alias("status"), "event_id")
    return rows.unionByName(log).groupBy("status").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT true AS first, false AS again, count(*) AS n FROM nation")
def skip_if_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, nation = scratch(spark, "once"), table(spark, sf_dir, "nation")
    first, again = loops.skip_existing(nation, path), loops.skip_existing(nation.limit(1), path)
    return spark.read.parquet(path).agg(F.lit(first).alias("first"), F.lit(again).alias("again"), F.count("*").alias("n"))


_TOPICS = ["view", "click", "purchase", "error", "signup"]


@query(f"""
WITH e AS (SELECT event_type AS topic, event_id % 3 + 1 AS c, (value > 50)::INT AS ok, (value > 99)::INT AS failed FROM events),
t(topic, pos) AS (VALUES {", ".join(f"('{t}', {k})" for k, t in enumerate(sorted(_TOPICS)))}),
s AS (SELECT x.c AS cycle, topic, sum(ok)::BIGINT AS correct, count(*) AS total, sum(failed)::BIGINT AS failed FROM e JOIN (VALUES (1), (2), (3)) x(c) ON e.c <= x.c GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY cycle ORDER BY correct / total, topic) - 1 AS place FROM s WHERE total >= 3 QUALIFY place < 2),
r AS (SELECT x.c AS cycle, t.topic, row_number() OVER (PARTITION BY x.c ORDER BY (t.pos - x.c + 1 + 50) % {len(_TOPICS)}) + 1 AS place FROM t, (VALUES (1), (2), (3)) x(c) WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.cycle = x.c AND w.topic = t.topic) QUALIFY place < 4)
SELECT cycle, place, topic, 'weak' AS reason, round(correct / total, 6) AS accuracy, total, failed FROM w
UNION ALL SELECT r.cycle, place, r.topic, 'turn', round(correct / total, 6), coalesce(total, 0), coalesce(failed, 0) FROM r LEFT JOIN s ON s.cycle = r.cycle AND s.topic = r.topic
""")
def stream_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loop over three batches of events, stopped and started again after each: what it takes next depends on all before."""
    folder, out = scratch(spark, "results"), scratch(spark, "plans")
    e = table(spark, sf_dir, "events")
    rows = e.select(F.lit("loop").alias("loop"), F.col("event_type").alias("topic"), (F.col("value") > 50).cast("long").alias("correct"), F.lit(1).cast("long").alias("total"), (F.col("value") > 99).cast("long").alias("failed"), (F.col("event_id") % 3).alias("k"))
    for k in range(3):
        rows.where(F.col("k") == k).drop("k").write.mode("append").parquet(folder)
        stream = loops.watch_files(spark, folder, "loop string, topic string, correct long, total long, failed long", "parquet", 10_000)
        found = topics.plans(stream, sorted(_TOPICS), weakest=2, chosen=4)
        found.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("cycle", "place", "topic", "reason", F.round("accuracy", 6).alias("accuracy"), "total", "failed")


@query("""
WITH e AS (SELECT *, event_type IN ('view', 'click') AS capped FROM events WHERE event_type IN ('view', 'click', 'error')),
r AS (SELECT *, CASE WHEN value <= 10 THEN 'rejected' WHEN capped AND sum((value > 10)::INT) OVER (PARTITION BY event_type ORDER BY event_id) > 40 THEN 'over_cap' END AS reason FROM e)
SELECT event_type AS source, coalesce(reason, 'taken') AS reason, count(*) AS n, sum(event_id)::BIGINT AS ids FROM r GROUP BY ALL
""")
def stream_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three streams over two batches each, two of them with a cap of 40 rows that the second batch passes."""
    folder, out = scratch(spark, "sources"), scratch(spark, "capped")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    middle = e.where("event_type = 'view' and value > 10").orderBy("event_id").limit(30).agg(F.coalesce(F.max("event_id"), F.lit(0))).first()[0]
    for late in (False, True):
        for kind in ("view", "click", "error"):
            e.where((F.col("event_type") == kind) & ((F.col("event_id") > middle) == late)).select("event_id", "value").write.mode("append").parquet(f"{folder}/{kind}")
        streams = {kind: loops.watch_files(spark, f"{folder}/{kind}", "event_id long, value double", "parquet", 10_000) for kind in ("view", "click", "error")}
        loops.append_capped(streams, f"{out}/rows", f"{out}/rest", F.col("value") > 10, {"view": 40, "click": 40}, f"{out}/log", ["event_id"]).awaitTermination()
    taken = spark.read.parquet(f"{out}/rows").withColumn("reason", F.lit("taken"))
    rest = spark.read.parquet(f"{out}/rest")
    return taken.unionByName(rest).groupBy("source", "reason").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
