"""Queries: curated records (made of documents), their checks, verifiers, scores and verse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, prosody
from ..operators import curate, evidence, extras, report, score, verify
from .registry import query, table


def _one_of(k: Column, *options: Column | str) -> Column:
    return F.get(F.array(*[F.lit(o) if isinstance(o, str) else o for o in options]), k.cast("int"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: every seventh has no answer, every fifth an unknown difficulty, every third a field too many."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        _text("r-", i).alias("id"), F.col("source").alias("benchmark_family"), F.lit("prose").alias("task_type"), F.col("lang").alias("language"),
        F.when(i % 5 == 0, "odd").otherwise("hard").alias("difficulty"), F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages"),
        F.when(i % 7 > 0, i.cast("string")).alias("final_answer"), F.lit("so").alias("concise_solution"), F.lit("exact_match").alias("verifier"),
        F.slice(F.array(F.struct(_text("https://a.example/", i).alias("url"), F.lit("cc").alias("license"), F.lit("facts").alias("used_for")), F.struct(F.lit("https://b.example").alias("url"), F.lit("own").alias("license"), F.lit("style").alias("used_for"))), F.lit(1), (i % 3).cast("int")).alias("sources"),
        F.lit("clean").alias("contamination_audit"), F.lit("0.9").alias("quality_scores"), F.array("lang", "source").alias("training_tags"), F.when(i % 3 == 0, "x").alias("loop_metadata"),
    )


@query("SELECT 'r-' || doc_id AS id, 13 AS n_columns, lang AS language, false AS has_loop FROM documents")
def public_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published columns only."""
    p = curate.public_item(_records(spark, sf_dir))
    return p.select("id", F.lit(len(p.columns)).alias("n_columns"), "language", F.lit("loop_metadata" in p.columns).alias("has_loop"))


@query("""
SELECT 'r-' || doc_id AS id, array_to_string(list_filter([CASE WHEN doc_id % 7 = 0 THEN 'missing:final_answer' END, CASE WHEN doc_id % 5 = 0 THEN 'enum:difficulty' END, CASE WHEN doc_id % 3 = 0 THEN 'items:sources' END,
 CASE WHEN doc_id % 3 = 0 THEN 'extra:loop_metadata' END], lambda x: x IS NOT NULL), ',') AS violations FROM documents
""")
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _records(spark, sf_dir)
    checks = curate.schema_checks(df, enums={"difficulty": ["easy", "medium", "hard", "olympiad"]}, least_items={"sources": 1})
    return df.select("id", F.array_join(curate.violations(checks), ",").alias("violations"))


@query("""
SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 9 = 0 THEN 'not_numeric:correctness' END, CASE WHEN doc_id % 100 / 100.0 > 0.95 + 1e-9 THEN 'over_cap:novelty' END], lambda x: x IS NOT NULL), ',') AS issues FROM documents
""")
def quality_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores over their caps (a value just at the cap passes) or not numbers; missing scores pass."""
    i = F.col("doc_id")
    scores = F.create_map(F.lit("correctness"), F.when(i % 9 == 0, "high").otherwise("0.99"), F.lit("novelty"), (i % 100 / 100).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(curate.violations(curate.cap_checks(scores)), ",").alias("issues"))


@query("SELECT CASE WHEN doc_id % 4 = 0 THEN 'no_corrections' WHEN doc_id % 3 > 0 THEN 'not_converged' END AS drop_reason, count(*) AS n FROM documents GROUP BY 1")
def loop_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(F.when(i % 8 > 0, i % 4).alias("n"), F.when(i % 3 == 0, True).when(i % 3 == 1, False).alias("done"))
    return curate.loop_filter(d, "n", "done").groupBy("drop_reason").agg(F.count("*").alias("n"))


@query("SELECT 'r-' || doc_id AS id, unnest(['https://a.example/' || doc_id, 'https://b.example'][1:(doc_id % 3)::INT]) AS url, unnest(['cc', 'own'][1:(doc_id % 3)::INT]) AS license, unnest(['facts', 'style'][1:(doc_id % 3)::INT]) AS used_for FROM documents WHERE doc_id % 3 > 0")
def source_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extras.provenance(_records(spark, sf_dir))


@query("""
WITH s AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY substring(sha256(doc_id::VARCHAR), 1, 16), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS c FROM documents),
v AS (SELECT *, r <= CASE WHEN c >= 10 THEN greatest(1, round_even(c * 0.1, 0)) WHEN c >= 3 THEN 1 ELSE 0 END AS val FROM s),
pool AS (SELECT doc_id AS example_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR), doc_id) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM v WHERE NOT val),
n AS (SELECT lang, count(*) AS n FROM v WHERE NOT val GROUP BY 1),
want AS (SELECT doc_id, lang, n, ('0x' || substring(sha256(doc_id::VARCHAR), 1, 15))::BIGINT % n AS s, unnest(range(0, least(2, n - 1)::INT + 1)) AS i FROM v JOIN n USING (lang) WHERE val)
SELECT doc_id, example_id, place FROM (SELECT w.doc_id, e.example_id, row_number() OVER (PARTITION BY w.doc_id ORDER BY i) AS place FROM want w JOIN pool e ON e.lang = w.lang AND e.p = (w.s + w.i) % w.n) WHERE place <= 2
""")
def few_shot_from_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples for validation rows, from training rows alone."""
    d = curate.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", ["lang"])
    return curate.few_shot(d.where("split = 'validation'"), d.where("split = 'train'"), "doc_id", "lang", 2)


@query("SELECT l_orderkey AS prompt, l_linenumber AS candidate, avg(CASE WHEN l_linenumber % 2 = 0 THEN l_discount ELSE 0 END) AS score FROM lineitem GROUP BY 1, 2")
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores joined by prompt and candidate; every second candidate has none and gets 0."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("prompt"), F.col("l_linenumber").alias("candidate")).agg(F.avg("l_discount").alias("score"))
    return score.score_candidates(c.select("prompt", "candidate"), c.where("candidate % 2 = 0"), "prompt", "candidate", "score")


@query("SELECT p_partkey AS id, p_partkey % 3 <> 0 AS supported FROM part")
def answer_in_search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers looked for in the titles and snippets of two hits, whatever the case; a third of them has none."""
    p = table(spark, sf_dir, "part")
    claims = p.select(F.col("p_partkey").alias("id"), F.upper(_text(F.col("p_name"), " ", F.col("p_partkey"), ".")).alias("answer"))
    k = F.col("p_partkey") % 3
    said = _text("of ", F.col("p_name"), " ", F.col("p_partkey"), ". it is")
    one = p.select(F.col("p_partkey").alias("id"), F.when(k == 1, said).otherwise("x").alias("title"), F.lit("y").alias("snippet"))
    two = p.select(F.col("p_partkey").alias("id"), F.lit(None).cast("string").alias("title"), F.when(k > 0, said).otherwise(_text(F.col("p_partkey"), "0.")).alias("snippet"))
    return evidence.answer_in_hits(claims, one.union(two))


@query("SELECT 'verifier' AS dimension, value, count(*) AS n FROM (SELECT ['unit_tests', 'regex', 'exact_match'][1 + (doc_id % 3)::INT] AS value FROM documents) GROUP BY 1, 2")
def verifier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(_one_of(F.col("doc_id") % 3, "unit_tests", "regex", "exact_match").alias("verifier"))
    return report.distribution(d, ["verifier"])


@query("SELECT round(avg((k IN (0, 1) OR (k = 2 AND o_orderstatus = 'F'))::INT), 6) AS accuracy, count(*) AS n, count(*) FILTER (k = 0) AS n_strict, count(*) FILTER (k = 1) AS n_rational, count(*) FILTER (k > 1) AS n_judge FROM (SELECT *, o_orderkey % 4 AS k FROM orders)")
def accuracy_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal, equal as numbers, or for a judge (who says yes to the finished orders of one kind)."""
    k, n = F.col("o_orderkey") % 4, F.col("o_custkey") + 1
    gold = n.cast("string")
    o = table(spark, sf_dir, "orders").select(answers.same_math(_one_of(k, _text("$", n, "$"), _text(2 * n, "/2"), F.lit("x"), F.lit("y")), gold).alias("m"), k.alias("k"), "o_orderstatus")
    out = score.accuracy_by_method(o, F.coalesce("m", F.lit("judge")), F.col("m").isNotNull() | ((F.col("k") == 2) & (F.col("o_orderstatus") == "F")))
    return out.withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT round(avg(ok::INT) FILTER (p_partkey % 2 = 0), 6) AS choice_acc, round(avg(ok::INT) FILTER (p_partkey % 2 = 1), 6) AS analytic_acc, round(avg(ok::INT), 6) AS overall_acc, count(*) FILTER (p_partkey % 2 = 0) AS n_choice, count(*) FILTER (p_partkey % 2 = 1) AS n_analytic FROM (SELECT p_partkey, p_size % 3 = 0 AS ok FROM part)")
def choice_split_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _one_of(F.col("p_partkey") % 4, "(3)", "12 apples", "ก", "12")
    out = score.choice_split_accuracy(table(spark, sf_dir, "part"), answers.is_choice(gold), F.col("p_size") % 3 == 0)
    return out.select(*[F.round(c, 6).alias(c) for c in ("choice_acc", "analytic_acc", "overall_acc")], "n_choice", "n_analytic")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 2000")
def capped_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 2,000 rows or a fifth of the total (the cap is the feature)."""
    return curate.capped_source(table(spark, sf_dir, "documents").select("doc_id"), [F.col("doc_id")], 5000)


_LEVELS = "['easy', 'medium', 'hard', 'olympiad'][1 + (doc_id % 4)::INT]"
_TAGS = "['pythagorean', 'probability', 'quadratic', 'other'][1 + (doc_id // 4 % 4)::INT]"
_FAMILY = "['aime_th', 'math500_th', 'livecodebench_th', 'mt_bench'][1 + (doc_id // 16 % 4)::INT]"
_AFTER = f"""CASE WHEN family = 'aime_th' AND (tag = 'pythagorean' OR (tag = 'probability' AND doc_id % 3 > 0)) THEN 'medium'
 WHEN family = 'aime_th' AND level = 'hard' AND length(text) < 180 THEN 'medium' WHEN family = 'math500_th' AND tag = 'quadratic' AND level = 'medium' THEN 'easy'
 WHEN family = 'math500_th' AND tag = 'quadratic' AND level = 'hard' THEN 'medium' WHEN family = 'livecodebench_th' AND level = 'hard' AND doc_id % 3 = 0 THEN 'medium' ELSE level END"""
_LEVELLED = f"SELECT doc_id, text, {_LEVELS} AS level, {_TAGS} AS tag, {_FAMILY} AS family FROM documents"


def _levelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(
        "doc_id", "text", _one_of(i % 4, "easy", "medium", "hard", "olympiad").alias("level"), F.array(_one_of(F.floor(i / 4) % 4, "pythagorean", "probability", "quadratic", "other")).alias("tags"),
        _one_of(F.floor(i / 16) % 4, "aime_th", "math500_th", "livecodebench_th", "mt_bench").alias("family"), F.when(i % 3 == 0, "by C(5, 2)").otherwise("plain").alias("solution"), F.when(i % 3 == 0, "output_prediction").otherwise("code").alias("task"),
    )
    return d.withColumn("after", curate.recalibrated_difficulty(F.col("family"), F.col("level"), F.col("task"), F.col("tags"), F.col("text"), F.col("solution")))


@query(f"SELECT doc_id, family, level, {_AFTER} AS after FROM ({_LEVELLED})")
def difficulty_recalibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levelled(spark, sf_dir).select("doc_id", "family", "level", "after")


_RAW = "doc_id % 100 / 100.0"


@query(f"""
SELECT doc_id, least({_RAW}, CASE WHEN doc_id % 2 = 0 THEN 0.99 ELSE 0.96 END)::DOUBLE AS correctness, CASE WHEN doc_id % 5 = 0 THEN 0.9 ELSE 0.95 END::DOUBLE AS thai_naturalness, 0.9::DOUBLE AS novelty, least({_RAW}, 0.98)::DOUBLE AS instruction_clarity,
 least({_RAW}, CASE WHEN after <> level THEN 0.88 ELSE 0.93 END, CASE WHEN family = 'mt_bench' THEN 0.91 ELSE 0.93 END)::DOUBLE AS benchmark_alignment,
 family || ' item verified with ' || CASE WHEN doc_id % 2 = 0 THEN 'regex' ELSE 'judge' END || '; correctness ' || CASE WHEN after <> level THEN 'Difficulty recalibrated from ' || level || ' to ' || after || '.' ELSE 'Difficulty retained as ' || after || ' after curator review.' END AS note
FROM (SELECT *, {_AFTER} AS after FROM ({_LEVELLED}))
""")
def score_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores under their caps, with defaults for missing ones, and the reviewer's note (its numbers left out)."""
    i = F.col("doc_id")
    d = _levelled(spark, sf_dir)
    raw = (i % 100 / 100).cast("double")
    scores = F.create_map(F.lit("correctness"), raw, F.lit("instruction_clarity"), raw, F.lit("benchmark_alignment"), raw)
    kind = F.when(i % 2 == 0, "regex").otherwise("judge")
    changed = F.col("level") != F.col("after")
    s = curate.calibrated_scores(F.col("family"), kind, F.when(i % 5 == 0, "th-TH").otherwise("en"), F.col("tags"), scores, changed)
    d = d.withColumn("_s", s).withColumn("_note", curate.reviewer_note(F.col("family"), kind, F.col("level"), F.col("after"), scores, F.col("_s.correctness")))
    note = F.regexp_replace(F.regexp_replace("_note", r"correctness [0-9.]+\. ", "correctness "), r" Original scores: .*$", "")
    return d.select("doc_id", *[f"_s.{c}" for c in ("correctness", "thai_naturalness", "novelty", "instruction_clarity", "benchmark_alignment")], note.alias("note"))


#: A Thai syllable of two signs, and one with a tone mark.
_KA, _KHA = "กา", "ข่า"


@query("SELECT doc_id, 1 + doc_id % 3 AS n_marks, 3 * (1 + doc_id % 3) - 2 AS last_place, 'mai_ek' AS name FROM documents")
def tone_mark_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", prosody.tone_marks(F.repeat(F.lit(_KHA), (1 + F.col("doc_id") % 3).cast("int"))).alias("_m"))
    last = F.element_at("_m", -1)
    return t.select("doc_id", F.size("_m").cast("long").alias("n_marks"), last["at"].cast("long").alias("last_place"), last["name"].alias("name"))


@query("SELECT doc_id, doc_id % 3 <> 1 AS formal, doc_id % 3 = 1 AS informal, CASE doc_id % 3 WHEN 0 THEN 'เรียน' ELSE '' END AS formal_markers FROM documents")
def register_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Casual particles and formal markers."""
    x = _one_of(F.col("doc_id") % 3, "เรียน ท่าน", "ไปแล้วครับ", "ไปแล้ว")
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", prosody.register_ok(x, "formal").alias("formal"), prosody.register_ok(x, "informal").alias("informal"), F.array_join(prosody.markers_in(x, prosody.FORMAL_MARKERS), ",").alias("formal_markers"))


@query("SELECT doc_id, doc_id % 2 = 0 AS rhymes, CASE WHEN doc_id % 5 = 0 THEN 'ก' ELSE 'นา' END AS key FROM documents")
def rhyme_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two signs of a word."""
    a, b = F.when(F.col("doc_id") % 5 == 0, "ก").otherwise("ชาวนา"), F.when(F.col("doc_id") % 2 == 0, F.when(F.col("doc_id") % 5 == 0, "ก").otherwise("คนนา")).otherwise("ปี")
    return table(spark, sf_dir, "documents").select("doc_id", (prosody.rhyme_key(a) == prosody.rhyme_key(b)).alias("rhymes"), prosody.rhyme_key(a).alias("key"))


#: Words that stand for a table's words by their length, and their syllables.
_THAI_WORDS = [("ปลา", 1), ("เดือน", 1), ("โรงเรียน", 2), ("น้ำ", 1), ("พระ", 1), ("ดอกไม้", 2), ("เกาะ", 1), ("วิทยา", 3), ("กล้วย", 1), ("สวัสดี", 3), ("จันทร์", 1), ("ใหญ่", 1), ("หนังสือ", 2), ("ครับ", 1), ("ตลาดน้ำ", 3), ("รัฐบาล", 3)]
_LINES = r"filter(string_split_regex(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]'), lambda l: regexp_matches(l, '[^ ]'))"
_AS_THAI = f"list_transform(filter(string_split(l, ' '), lambda w: w <> ''), lambda w: {[w for w, _ in _THAI_WORDS]}[1 + length(w) % 16])"
_COUNT = f"list_transform(filter(string_split(l, ' '), lambda w: w <> ''), lambda w: {[n for _, n in _THAI_WORDS]}[1 + length(w) % 16])"


def _thai_lines(text: Column, between: str) -> Column:
    """Lines of a text with a Thai word for each of its words, `between` them."""
    thai = F.array(*[F.lit(w) for w, _ in _THAI_WORDS])
    words = lambda line: F.filter(F.split(line, " "), lambda w: w != "")
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda line: F.array_join(F.transform(words(line), lambda w: F.get(thai, F.length(w) % 16)), between))


@query(f"SELECT doc_id, len(c)::BIGINT AS n_lines, coalesce(list_sum(c), 0)::BIGINT AS n_syllables, coalesce(list_max(c), 0)::BIGINT AS longest FROM (SELECT doc_id, list_transform({_LINES}, lambda l: list_sum({_COUNT})) AS c FROM documents)")
def thai_syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in Thai words without spaces, parsed into syllables: lead vowels, clusters, silent signs, linking syllables."""
    lines = F.filter(_thai_lines(F.col("text"), ""), lambda x: x != "")
    d = table(spark, sf_dir, "documents").select("doc_id", prosody.line_syllables()(lines).alias("c"))
    return d.select("doc_id", F.size("c").cast("long").alias("n_lines"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_syllables"), F.coalesce(F.array_max("c"), F.lit(0)).cast("long").alias("longest"))


_TASKS = ["klon_composition", "klon_8_composition", "kap_yani_composition", "formal_register", "informal_register"]
_FORM = "CASE doc_id % 5 WHEN 0 THEN [4, 3, 5] WHEN 1 THEN [4, 7, 9] ELSE [2, 10, 12] END"
_KEY = "right({}, 2)"


def _klon_oracle() -> str:
    """Lines of Thai words in SQL: syllables from the words' table, rhymes by the last two signs."""
    rhyme = f"""CASE WHEN doc_id % 5 <> 1 THEN [] ELSE flatten(list_transform(range(0, (len(w) - 1) // 4 + 1), lambda k: list_concat(
        CASE WHEN k * 4 + 2 <= len(w) AND len(filter(w[k * 4 + 2][2:-2], lambda t: {_KEY.format("t")} = {_KEY.format("w[k * 4 + 1][-1]")})) = 0 THEN ['rhyme ' || (k + 1) || ':1'] ELSE [] END,
        CASE WHEN k * 4 + 3 <= len(w) AND {_KEY.format("w[k * 4 + 2][-1]")} <> {_KEY.format("w[k * 4 + 3][-1]")} THEN ['rhyme ' || (k + 1) || ':2'] ELSE [] END))) END"""
    return f"""
WITH d AS (SELECT doc_id, {_FORM} AS f, list_transform({_LINES}, lambda l: {_AS_THAI}) AS w, list_transform({_LINES}, lambda l: list_sum({_COUNT})) AS c FROM documents)
SELECT doc_id, CASE WHEN doc_id % 5 = 3 AND len(filter(flatten(w), lambda t: t = 'ครับ')) > 0 THEN 'register formal' WHEN doc_id % 5 = 4 AND len(filter(flatten(w), lambda t: t = 'ครับ')) = 0 THEN 'register informal' WHEN doc_id % 5 > 2 THEN ''
    WHEN len(w) = 0 THEN 'empty' WHEN len(w) % f[1] <> 0 THEN 'stanza'
    ELSE array_to_string(list_concat(filter(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN c[i] < f[2] OR c[i] > f[3] THEN 'line ' || i || ': ' || c[i]::BIGINT END), lambda x: x IS NOT NULL), {rhyme}), ',') END AS issues
FROM d"""


@query(_klon_oracle())
def klon_prosody(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as verse or prose by task, word by word in Thai: syllables of each line, stanzas, rhymes, register."""
    d = table(spark, sf_dir, "documents").select("doc_id", _one_of(F.col("doc_id") % 5, *_TASKS).alias("task"), F.array_join(_thai_lines(F.col("text"), " "), "\n").alias("verse"))
    return d.select("doc_id", F.array_join(prosody.prosody_issues(F.col("task"), F.col("verse")), ",").alias("issues"))


_VERSE = "CASE doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'line 2: 6' WHEN 2 THEN 'stanza' WHEN 3 THEN '' WHEN 4 THEN 'rhyme 1:1,rhyme 1:2' WHEN 5 THEN 'line 1: 8' WHEN 6 THEN 'register formal' ELSE 'empty' END"


@query(f"SELECT doc_id, {_VERSE} AS issues FROM documents")
def klon_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poems in each form, kept and broken: syllables, stanzas, rhymes, register, and a text without lines."""
    four = [_KA * 4, _KA * 4, _KA * 5, _KA * 3]
    first, inner, second, other = _KA * 7 + "มี", f"{_KA * 2} {_KA}มี {_KA * 5}", f"{_KA * 7}ดี", f"{_KA * 7}ปู"
    rhymed = [first, f"{inner[:-2]}ดี", second, other]
    poems = ["\n".join(x) for x in ([*four], [four[0], _KA * 6, *four[2:]], four[:3], rhymed, [first, f"{_KA * 3} {_KA * 2} {_KA * 3}", second, other], [_KA * 8, _KA * 11], ["ไปแล้วครับ"], [" ", ""])]
    tasks = ["klon_composition", "klon_4_composition", "klon_4_composition", "klon_8_composition", "klon_8_composition", "kap_yani_composition", "formal_register", "kap_composition"]
    d = table(spark, sf_dir, "documents").select("doc_id", _one_of(F.col("doc_id") % 8, *tasks).alias("task"), _one_of(F.col("doc_id") % 8, *poems).alias("poem"))
    return d.select("doc_id", F.array_join(prosody.prosody_issues(F.col("task"), F.col("poem")), ",").alias("issues"))


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as records of every verifier type; those with an even number keep their rule."""
    i = F.col("item_id")
    ok, k = i % 2 == 0, F.floor(i / 2) % 9
    good = lambda a, b: F.when(ok, a).otherwise(b)
    quoted = lambda x: F.to_json(F.array(x))
    details = _one_of(
        k,
        _text('{"reference_solution": "print(sum(map(int, input().split())))", "public_tests": [{"input": "1 ', i, '", "output": "', good(i + 1, i), '"}]}'),
        _text('{"reference_solution": "def f(x): return (x, x)", "function_name": "f", "function_tests": [{"args": [', i, '], "expected": [', i, ", ", good(i, i + 1), "]}]}"),
        _text('{"program": "print(', i, ' * 2)", "expected_stdout": "', good(2 * i, i), '"}'),
        _text('{"python_asserts": ["int(answer) == ', good(i, i + 1), '"]}'),
        _text('{"python_asserts": ["len(response.split()) ', good(F.lit("=="), F.lit(">")), ' 2"]}'),
        _text('{"accepted_answers": ', quoted(good(i, i + 1).cast("string")), "}"),
        _text('{"required_supporting_facts": ["a", "', good(F.lit('b"]}'), F.lit('b"], "x": "y"}')), ""),
        _text('{"criteria": ["a", "b"', good(F.lit(', "c"'), F.lit("")), "]}"),
        F.lit("{}"),
    )
    kind = _one_of(k, "unit_tests", "unit_tests", "unit_tests", "symbolic_math", "regex", "exact_match", "retrieval_evidence", "llm_judge_rubric", "human_review")
    urls = F.when((k == 6) & ~ok, F.array(F.lit("ftp://a"))).otherwise(F.array(F.lit("http://a")))
    return table(spark, sf_dir, "benchmark").select(
        i.alias("id"), F.when((k == 8) & ~ok, "guess").otherwise(kind).alias("verifier_type"), details.alias("details"), i.cast("string").alias("final_answer"), F.lit("two words").alias("response"), urls.alias("urls"), F.lit("x").alias("family"), F.lit(4).alias("n_messages")
    )


@query("""
SELECT item_id AS id, ['unit_tests', 'unit_tests', 'unit_tests', 'symbolic_math', 'regex', 'exact_match', 'retrieval_evidence', 'llm_judge_rubric', CASE WHEN item_id % 2 = 0 THEN 'human_review' ELSE 'guess' END][1 + (item_id // 2 % 9)::INT] AS verifier_type, item_id % 2 = 0 AS passed FROM benchmark
""")
def unit_test_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every verifier type on records that keep their rule and records that don't; an unknown type fails."""
    return verify.verify(_verified(spark, sf_dir)).select("id", "verifier_type", F.col("reason").isNull().alias("passed"))


@query("""
WITH r AS (SELECT item_id, item_id % 10 = 3 AS bad_line, item_id % 10 = 5 AS again FROM benchmark)
SELECT CASE WHEN bad_line THEN 'load_error' WHEN again THEN 'duplicate id' WHEN item_id % 2 = 1 THEN 'verifier' WHEN item_id % 10 = 8 THEN 'verse' END AS reason, count(*) AS n, count(*) FILTER (item_id % 4 = 0) AS warned FROM r GROUP BY 1
""")
def audit_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reason a record, in the order of an audit: load error, later copy, verifier, verse; caps only warn."""
    i = F.col("item_id")
    df = table(spark, sf_dir, "benchmark").select("item_id", F.when(i % 10 == 5, i - 1).otherwise(i).alias("id"))
    caps = curate.violations(curate.cap_checks(F.create_map(F.lit("novelty"), F.when(i % 4 == 0, "0.96").otherwise("0.5"))))
    out = verify.audit(df, "id", ["item_id"], F.when(i % 10 == 3, "load_error"), F.when(i % 2 == 1, "verifier"), caps, F.when(i % 10 == 8, "verse"))
    return out.groupBy("reason").agg(F.count("*").alias("n"), F.count_if(F.size("warnings") > 0).alias("warned"))
