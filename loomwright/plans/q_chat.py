"""Queries: conversations, templates, few-shot prompts, instruction constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chat, constraints
from ..operators import curate, score
from .registry import query, table


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, messages) with turns in order. A conversation is one record: its turns are gathered, as its consumers need."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_m")).select("conv_id", F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))


@query("""
SELECT conv_id, sha256(coalesce(string_agg(text, chr(10) ORDER BY turn, role, text) FILTER (role = 'user'), '')) AS prompt_sha256,
       sha256(coalesce(string_agg(text, chr(10) ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS answer_sha256 FROM conversations GROUP BY 1
""")
def prompt_answer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    c = conversations(spark, sf_dir)
    return c.select("conv_id", sha(chat.prompt_text(F.col("messages"))).alias("prompt_sha256"), sha(chat.answer_text(F.col("messages"))).alias("answer_sha256"))


@query("""
SELECT conv_id, arg_min(text, (turn, role, text)) FILTER (role = 'user' AND text IS NOT NULL) AS first_user, arg_max(text, (turn, role, text)) FILTER (role = 'assistant' AND text IS NOT NULL) AS last_assistant
FROM conversations GROUP BY 1
""")
def first_user_last_assistant(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conversations(spark, sf_dir)
    return c.select("conv_id", chat.first_user(F.col("messages")).alias("first_user"), chat.last_assistant(F.col("messages")).alias("last_assistant"))


_RENDER = "'<|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10) || string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY turn, role, text)"


@query(f"SELECT conv_id, sha256({_RENDER}) AS rendered_sha256, length({_RENDER}) AS n_chars FROM conversations GROUP BY 1")
def chat_template_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = conversations(spark, sf_dir).select("conv_id", chat.render_template(F.col("messages")).alias("_r"))
    return r.select("conv_id", F.sha2(F.col("_r").cast("binary"), 256).alias("rendered_sha256"), F.length("_r").cast("long").alias("n_chars"))


@query("SELECT conv_id, count(*) AS n_messages, true AS same FROM conversations WHERE role <> 'system' GROUP BY 1")
def chat_template_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conversations(spark, sf_dir)
    back = chat.parse_template(chat.render_template(F.col("messages")))
    plain = F.filter(F.col("messages"), lambda m: m["role"] != "system")
    return c.select("conv_id", back.alias("_b"), plain.alias("_p")).select("conv_id", F.size("_b").cast("long").alias("n_messages"), (F.to_json("_b") == F.to_json("_p")).alias("same"))


@query("""
WITH m AS (SELECT conv_id, CASE lower(role) WHEN 'human' THEN 'user' WHEN 'user' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'assistant' THEN 'assistant' WHEN 'bot' THEN 'assistant' END AS role, trim(text, ' ') AS content FROM conversations)
SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS n_user FROM m WHERE role IS NOT NULL AND content <> '' GROUP BY 1 HAVING count(*) >= 2
""")
def role_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = conversations(spark, sf_dir).select("conv_id", chat.normalize_roles(F.col("messages")).alias("_m")).where("_m is not null")
    return c.select("conv_id", F.size("_m").cast("long").alias("n"), F.size(F.filter("_m", lambda m: m["role"] == "user")).cast("long").alias("n_user"))


_PICK = """
pool AS (SELECT doc_id AS example_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR), doc_id) - 1 AS p FROM documents),
n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1),
want AS (SELECT doc_id, lang, n, ('0x' || substring(sha256(doc_id::VARCHAR), 1, 15))::BIGINT % n AS s, unnest(range(0, least(3, n - 1)::INT + 1)) AS i FROM documents JOIN n USING (lang)),
pick AS (SELECT w.doc_id, e.example_id, row_number() OVER (PARTITION BY w.doc_id ORDER BY i) AS place FROM want w JOIN pool e ON e.lang = w.lang AND e.p = (w.s + w.i) % w.n WHERE e.example_id <> w.doc_id)
"""


@query(f"WITH {_PICK} SELECT doc_id, example_id, place FROM pick WHERE place <= 3")
def few_shot_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return curate.few_shot(docs, docs, "doc_id", "lang", 3)


@query(f"""
WITH {_PICK}, t AS (SELECT doc_id, text AS q, lang || ' ' || source AS a FROM documents),
b AS (SELECT p.doc_id, string_agg('# Example' || chr(10) || '## Question' || chr(10) || t.q || chr(10) || '## Answer' || chr(10) || t.a, chr(10) || chr(10) ORDER BY place) AS blocks FROM pick p JOIN t ON t.doc_id = p.example_id WHERE place <= 3 GROUP BY 1)
SELECT t.doc_id, sha256('<|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || coalesce(blocks || chr(10) || chr(10) || '# Your task' || chr(10), '') || q || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || a || '<|im_end|>') AS sft_sha256
FROM t LEFT JOIN b USING (doc_id)
""")
def few_shot_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question is a whole text, its answer the language and source."""
    qa = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("q"), F.concat_ws(" ", "lang", "source").alias("a"))
    picks = few_shot_pick(spark, sf_dir).join(qa.toDF("example_id", "eq", "ea"), "example_id")
    blocks = picks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", chat.example_block(F.col("eq"), F.col("ea")).alias("b")))).alias("_b"))
    df = qa.join(blocks.select("doc_id", F.transform("_b", lambda x: x["b"]).alias("_b")), "doc_id", "left").withColumn("_b", F.coalesce("_b", F.array().cast("array<string>")))
    messages = F.array(F.struct(F.lit("user").alias("role"), F.col("q").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("a").alias("content")))
    return df.select("doc_id", F.sha2(chat.render_template(chat.with_examples(messages, F.col("_b"))).cast("binary"), 256).alias("sft_sha256"))


def constraint_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, k, ok_a, ok_b): assistant turns against six constraints of each rule set."""
    exact = [("keyword_frequency", "the", 2), ("exact_line_count", None, 1), ("ends_with", ".", None), ("forbid_substring", "!", None), ("no_arabic_digits", None, None), ("language", "english", None)]
    lenient = [("length_constraints:number_words", None, 40, "at most"), ("length_constraints:number_sentences", None, 2, "at least"), ("punctuation:no_comma", None, None, None), ("keywords:frequency", "the", 1, "at least"), ("change_case:english_lowercase", None, None, None), ("startend:end_checker", ".", None, None)]

    def c(kind, word=None, n=None, relation=None):
        return F.struct(F.lit(kind).alias("type"), F.lit(word).cast("string").alias("word"), F.lit(n).cast("long").alias("n"), F.lit(relation).cast("string").alias("relation"), F.lit(None).cast("array<string>").alias("words"))

    pairs = F.array(*[F.struct(F.lit(k).alias("k"), c(*a).alias("a"), c(*b).alias("b")) for k, (a, b) in enumerate(zip(exact, lenient, strict=True))])
    t = table(spark, sf_dir, "conversations").where("role = 'assistant' and text is not null").select("conv_id", "turn", "text", F.explode(pairs).alias("_c"))
    return t.select("conv_id", "turn", "_c.k", constraints.check_exact(F.col("text"), F.col("_c.a")).alias("ok_a"), constraints.check_lenient(F.col("text"), F.col("_c.b")).alias("ok_b"))


_CHECKS = r"""
WITH t AS (SELECT conv_id, turn, text AS x, trim(text, chr(32)||chr(9)||chr(10)||chr(13)) AS r, unnest(range(0, 6)) AS k FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
c AS (SELECT conv_id, turn, k, CASE k
 WHEN 0 THEN (length(x) - length(replace(x, 'the', ''))) // 3 = 2
 WHEN 1 THEN CASE WHEN x = '' THEN 0 ELSE len(string_split(x, chr(10))) - (right(x, 1) = chr(10))::INT END = 1
 WHEN 2 THEN rtrim(x, chr(32)||chr(9)||chr(10)||chr(13)) LIKE '%.' WHEN 3 THEN NOT contains(x, '!') WHEN 4 THEN NOT regexp_matches(x, '[0-9]')
 ELSE regexp_matches(x, '[A-Za-z]') AND NOT regexp_matches(x, '[\x{0e00}-\x{0e7f}]') END AS ok_a, CASE k
 WHEN 0 THEN len(regexp_extract_all(r, '[^ \t\n\r]+')) <= 40 WHEN 1 THEN len(regexp_extract_all(r, '[.!?]+')) >= 2 WHEN 2 THEN NOT contains(r, ',')
 WHEN 3 THEN (length(r) - length(replace(lower(r), 'the', ''))) // 3 >= 1 WHEN 4 THEN r = lower(r) ELSE r LIKE '%.' END AS ok_b FROM t)
"""


@query(f"{_CHECKS} SELECT conv_id, turn, k::INT AS k, ok_a, ok_b FROM c")
def constraint_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraint_rows(spark, sf_dir)


@query(f"{_CHECKS}, p AS (SELECT conv_id, bool_and(ok_b) AS a, avg(ok_b::INT) AS m FROM c GROUP BY 1) SELECT round(avg(a::INT), 6) AS strict, round(avg(m), 6) AS loose, count(*) AS n_prompts FROM p")
def strict_loose_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score.strict_loose(constraint_rows(spark, sf_dir), "conv_id", "ok_b")
    return out.select(F.round("strict", 6).alias("strict"), F.round("loose", 6).alias("loose"), "n_prompts")


@query("SELECT doc_id, length(regexp_replace(text, '[^,]', '', 'g')) AS commas, length(text) - length(replace(text, 'th', '')) AS th2 FROM documents")
def occurrence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import occurrences

    return table(spark, sf_dir, "documents").select("doc_id", occurrences(F.col("text"), ",").alias("commas"), (2 * occurrences(F.col("text"), "th")).alias("th2"))
