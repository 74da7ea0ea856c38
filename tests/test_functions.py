"""Fixed cases of functions and operators."""

import pytest
from pyspark.sql import functions as F

from loomwright.functions import answers, chat, constraints, prosody
from loomwright.functions import text as tx
from loomwright.operators import curate, evidence, neardup, report, score, verify
from loomwright.plans import pipelines


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) else 'double'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("family", "raw", "want"),
    [
        ("aime24", r"so \boxed{42}", "42"),
        ("math500", "The answer is 7.", "7"),
        ("math500", "steps\n= 3.5", "3.5"),
        ("openthaieval", "คำตอบ: (2)", "(2)"),
        ("openthaieval", "3", "(3)"),
        ("openthaieval", "this is entailment", "entailment"),
        ("ifeval", "```text\nhello\n```", "hello"),
        ("ifeval", "ครับ\nนี่คือคำตอบ: สวัสดี", "สวัสดี"),
        ("livecodebench", "a\n```python\nprint(1)\n```\n```py\nprint(1234)\n```", "print(1234)"),
        ("mt_bench", "hi<|im_end|>", "hi"),
        ("other", "  x ", "x"),
        ("other", None, ""),
    ],
)
def test_extract(spark, family, raw, want):
    assert one(spark, answers.extract(F.lit(family), F.col("x")), x=raw) == want


def test_extract_multihop(spark):
    got = one(spark, answers.extract_multihop(F.col("x")), x="Answer: Paris\nhttps://a.b/c [source: Wiki] https://a.b/c")
    assert (got["answer"], got["sources"]) == ("Paris", ["https://a.b/c", "Wiki"])


@pytest.mark.parametrize(("x", "want"), [(r"\boxed{\frac{1}{2}} \boxed{x", r"\frac{1}{2}"), (r"\boxed{1} \boxed{{2}}", "{2}"), ("none", None), (None, None)])
def test_boxed(spark, x, want):
    assert one(spark, answers.extract_boxed(F.col("x")), x=x) == want


@pytest.mark.parametrize(("x", "want"), [("  {(A B)}. ", "ab"), ("$1\\,000$", "1000"), (None, None)])
def test_normalize_answer(spark, x, want):
    assert one(spark, answers.normalize_answer(F.col("x")), x=x) == want


@pytest.mark.parametrize(("a", "b", "want"), [("$1 2$", "12", "strict"), (r"\frac{1}{2}", "0.5", "rational"), ("1/0", "1", None), ("x", "y", None), ("2/4", "1/2", "rational")])
def test_same_math(spark, a, b, want):
    assert one(spark, answers.same_math(F.col("a"), F.col("b")), a=a, b=b) == want


def test_json_items(spark):
    assert one(spark, answers.json_items(F.col("x")), x='say {"items": [{"a": "}"}]} end') == '{"items": [{"a": "}"}]}'
    assert one(spark, answers.json_span(F.col("x")), x="a {b} c} d") == "{b} c}"


def test_lines_and_grams(spark):
    assert one(spark, tx.split_lines(F.col("x")), x="a\x0bb c\r\n") == ["a", "b", "c"]
    assert one(spark, tx.char_ngrams(F.col("x")), x="abcdefabcdef") == ["abcde", "bcdef", "cdefa", "defab", "efabc", "fabcd"]
    assert one(spark, tx.char_ngrams(F.col("x")), x="abc") == ["abc"]
    assert one(spark, tx.char_ngrams(F.col("x")), x="") == []
    assert one(spark, tx.tokens(F.col("x")), x="ที่ a_1, b") == ["ท", "ี่", "a_1", "b"]


def test_jaccard_paths_agree(spark, sf, monkeypatch):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet").limit(20), spark.read.parquet(f"{sf}/benchmark.parquet").limit(8)
    a = {tuple(r) for r in neardup.jaccard_pairs(docs, bench).where("jaccard > 0").withColumn("jaccard", F.round("jaccard", 9)).collect()}
    monkeypatch.setattr(neardup, "INDEX_CHARS", 0)
    b = {tuple(r) for r in neardup.jaccard_pairs(docs, bench).where("jaccard > 0").withColumn("jaccard", F.round("jaccard", 9)).collect()}
    assert a == b and len(a) > 50


def test_chat(spark):
    m = F.expr("array(named_struct('role', 'user', 'content', 'q\\n1'), named_struct('role', 'assistant', 'content', 'a'))").cast(chat.MESSAGES)
    assert [tuple(x) for x in one(spark, chat.parse_template(chat.render_template(m)))] == [("user", "q\n1"), ("assistant", "a")]
    text = one(spark, chat.render_template(chat.with_examples(m, F.array(F.lit("E")))))
    assert "E\n\n# Your task\nq\n1" in text
    got = one(spark, chat.seed_of(F.col("x")), x="x# Your task\nP<|im_end|>\n<|im_start|>assistant\n\\boxed{7}<|im_end|>")
    assert tuple(got) == ("P", "7")
    assert one(spark, chat.user_text(F.col("x")), x="<|im_start|>user\nA<|im_end|><|im_start|>user\nB<|im_end|>") == "B"


def test_padding(spark):
    pad = chat.pad_math(F.col("p"), F.lit("f"), F.col("t"), {"f": "intro"}, {"x": "hint", "y": "hint"}, ("## C", "## H", "## F"), "- do")
    out = one(spark, pad, p="Q", t=["x", "y", "z"])
    assert out == "Q\n\n## C\nintro\n\n## H\n- hint\n\n## F\n- do"
    assert one(spark, pad, p=out, t=["x"]) == out


@pytest.mark.parametrize(
    ("kind", "word", "n", "rel", "x", "want"),
    [
        ("length_constraints:number_words", None, 2, "less than", "a b", True),
        ("length_constraints:number_words", None, 3, "at least", "a b", False),
        ("punctuation:no_comma", None, None, None, "a, b", False),
        ("detectable_format:title", None, None, None, "<<T>>", True),
        ("detectable_format:json_format", None, None, None, "{bad", False),
        ("keywords:frequency", "A", 2, "at least", "a a", True),
        ("startend:quotation", None, None, None, '"q"', True),
        ("unknown:thing", None, None, None, "x", True),
    ],
)
def test_lenient(spark, kind, word, n, rel, x, want):
    c = F.struct(F.lit(kind).alias("type"), F.lit(word).cast("string").alias("word"), F.lit(n).cast("long").alias("n"), F.lit(rel).cast("string").alias("relation"), F.lit(None).cast("array<string>").alias("words"))
    assert one(spark, constraints.check_lenient(F.col("x"), c), x=x) is want


def test_exact_unknown_fails(spark):
    c = F.struct(F.lit("zzz").alias("type"), F.lit("a").alias("word"), F.lit(1).cast("long").alias("n"))
    assert one(spark, constraints.check_exact(F.col("x"), c), x="a") is False


def test_prosody(spark):
    assert [tuple(x) for x in one(spark, prosody.tone_marks(F.col("x")), x="น้ำ")] == [(1, "mai_tho")]
    assert one(spark, prosody.register_ok(F.col("x"), "formal"), x="ขอบคุณครับ") is False
    assert one(spark, prosody.register_ok(F.col("x"), "informal"), x="ขอบคุณครับ") is True


@pytest.mark.parametrize(("n", "want"), [(2, 0), (3, 1), (9, 1), (10, 1), (25, 2), (35, 4)])
def test_split_sizes(spark, n, want):
    df = curate.stratified_split(spark.range(n).withColumn("s", F.lit("a")), "id", ["s"])
    assert df.where("split = 'validation'").count() == want
    again = curate.stratified_split(spark.range(n).repartition(3).withColumn("s", F.lit("a")), "id", ["s"])
    assert set(map(tuple, df.collect())) == set(map(tuple, again.collect()))


def test_sqrt_weights(spark):
    counts = [("a", 1166), ("b", 64), ("c", 625), ("d", 626), ("e", 627), ("f", 86), ("g", 663), ("h", 410)]
    got = {r["k"]: r["weight"] for r in curate.weights(spark.createDataFrame(counts, "k string, n long")).collect()}
    assert got["a"] == 0.197978 and got["b"] == 0.046383 and abs(sum(got.values()) - 1) < 1e-5


def test_votes(spark):
    df = spark.createDataFrame([(1, "b", 1, -1.0), (1, "a", 2, -0.1), (1, None, 3, 0.0), (2, None, 1, 0.0)], "item int, a string, no int, lp double")
    assert {tuple(r) for r in score.majority_vote(df, "item", "a", "no").collect()} == {(1, "b", 1), (2, None, 0)}
    assert score.confidence_vote(df, "item", "a", "lp", "no").first()["vote"] == "a"


def test_set_f1(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, score.set_f1(empty, empty)) == 1.0
    assert one(spark, score.set_f1(F.array(F.lit("a")), empty)) == 0.0
    assert one(spark, score.pairwise_winner(F.lit("A"), F.lit("A"))) == "tie"
    assert one(spark, score.pairwise_winner(F.lit("A"), F.lit("B"))) == "A"


def test_gate_and_audit(spark):
    rows = [(1, "x", True), (2, "x", False), (3, "unknown", False)]
    got = {r["f"]: (r["total"], r["failed"], r["gate_ok"]) for r in report.pass_rates(spark.createDataFrame(rows, "id int, f string, ok boolean"), "f", F.col("ok")).collect()}
    assert got == {"x": (2, 1, False), "unknown": (1, 1, True), "TOTAL": (3, 2, False)}
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "id string, line int")
    out = verify.audit(df, "id", ["line"], F.lit(None).cast("string"), F.when(F.col("id") == "b", "bad"), F.lit(0), F.lit(None).cast("string"))
    assert {(r["line"], r["reason"]) for r in out.collect()} == {(1, None), (2, "duplicate id"), (3, "bad")}


def test_quality_scores(spark):
    s = F.create_map(F.lit("correctness"), F.lit(1.0), F.lit("novelty"), F.lit(0.5))
    got = one(spark, curate.calibrated_scores(F.lit("mt_bench"), F.lit("unit_tests"), F.lit("th"), F.array(F.lit("x")), s, F.lit(False)))
    assert got.asDict() == {"correctness": 0.99, "thai_naturalness": 0.9, "novelty": 0.5, "instruction_clarity": 0.9, "benchmark_alignment": 0.85}
    d = curate.recalibrated_difficulty(F.lit("math500_th"), F.lit("hard"), F.lit("t"), F.array(F.lit("sequence")), F.lit("p"), F.lit("s"))
    assert one(spark, d) == "medium"


def test_evidence(spark):
    claims = spark.createDataFrame([(1, "Paris"), (2, "Rome")], "id int, answer string")
    hits = spark.createDataFrame([(1, "t", "in paris now"), (2, "t", "x")], "id int, title string, snippet string")
    assert {tuple(r) for r in evidence.answer_in_hits(claims, hits).collect()} == {(1, True), (2, False)}


def test_phases(spark):
    def bad():
        raise ValueError("no")

    got = [tuple(r)[:2] for r in pipelines.run_phases(spark, [("a", lambda: 1), ("b", lambda: 1), ("c", bad), ("d", lambda: 1)], skip=("b",)).collect()]
    assert got == [("a", "passed"), ("b", "skipped"), ("c", "failed"), ("d", "not_run")]


def test_code_is_contained():
    ok, _, err = verify.run_code("import subprocess\nsubprocess.run(['ls'])")
    assert not ok and "not allowed" in err
    assert verify.run_code("x = 'a' * (1 << 31)")[0] is False


def test_invalid_patterns(spark):
    """A record's own pattern that isn't valid fails that record, not the job."""
    rows = [("abc 12", r"\d+"), ("abc", r"\d+"), ("abc", "(["), (None, "x"), ("abc", None)]
    df = spark.createDataFrame(rows, "x string, p string")
    c = F.struct(F.lit("regex").alias("type"), F.col("p").alias("word"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("relation"), F.lit(None).cast("array<string>").alias("words"))
    assert [r[0] for r in df.select(constraints.check_exact(F.col("x"), c)).collect()] == [True, False, False, False, False]
