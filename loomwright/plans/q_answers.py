"""Queries: responses made of table rows in known wordings, read back by the extractors.

The oracles know what went in; none reads the response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, chat
from ..functions import text as tx
from .registry import query, table


def _one_of(k: Column, *options: Column) -> Column:
    return F.get(F.array(*options), k.cast("int"))


def _text(*parts: Column | str) -> Column:
    """Strings are literal."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("SELECT p_partkey AS id, p_name AS said FROM part")
def instruction_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fences and up to four preambles around a name."""
    n = F.col("p_name")
    raw = _one_of(F.col("p_partkey") % 5, n, _text("```text\n", n, "\n```"), _text("  Sure, here it goes: ", n), _text("ครับ นี่คือ: ", n), _text("Certainly. Of course: Answer: Output = ", n, "\n"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), answers.extract_instruction(raw).alias("said"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'print(' || p_partkey || ')' || chr(10) || 'x = 1' END AS code FROM part")
def code_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No fence, one fence, or the longest of three (the first of equal ones)."""
    program = _text("print(", F.col("p_partkey"), ")\nx = 1")
    one = _text("Here:\n```python\n", program, "\n```\nDone.")
    three = _text("```\nx\n```\n```py\n", program, "\n```\n```\n", F.translate(program, "0123456789", "abcdefghij"), "\n```")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), answers.extract_code(_one_of(F.col("p_partkey") % 3, F.col("p_name"), one, three)).alias("code"))


@query("""
SELECT s_suppkey AS id, s_name AS answer, ['https://a.example/' || s_suppkey, 'Page ' || s_nationkey][1:1 + (s_suppkey % 2)::INT] AS sources FROM supplier
""")
def multihop_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer phrase or a first short line, links (one twice) and named sources."""
    k, link = F.col("s_suppkey") % 2, _text("https://a.example/", F.col("s_suppkey"))
    raw = _one_of(k, _text(F.col("s_name"), "\n", link, "\nsee ", link), _text("It is known.\nAnswer: ", F.col("s_name"), "\n(", link, ") [Source: Page ", F.col("s_nationkey"), "]"))
    got = answers.extract_multihop(raw)
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), got["answer"].alias("answer"), got["sources"].alias("sources"))


@query("SELECT c_custkey AS id, c_mktsegment || ' ' || c_custkey AS said FROM customer")
def chat_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outer fences and chat end tags."""
    x = _text(F.col("c_mktsegment"), " ", F.col("c_custkey"))
    raw = _one_of(F.col("c_custkey") % 3, _text(" ", x, "<|im_end|>"), _text("```\n", x, "\n```"), _text(x, "<|eot_id|><|endoftext|>\n"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), answers.extract_chat(raw).alias("said"))


_FAMILIES = ["aime24", "openthaieval", "ifeval", "livecodebench", "hotpotqa", "mt_bench", "another"]


@query(f"SELECT o_orderkey AS id, {_FAMILIES}[1 + (o_orderkey % 7)::INT] AS family, CASE o_orderkey % 7 WHEN 1 THEN '(' || (1 + o_custkey % 5) || ')' ELSE o_custkey || '' END AS answer FROM orders")
def family_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each family's extractor by the dispatcher; another family's response is stripped."""
    n = F.col("o_custkey")
    family = _one_of(F.col("o_orderkey") % 7, *map(F.lit, _FAMILIES))
    raw = _one_of(
        F.col("o_orderkey") % 7, _text(r"\boxed{", n, "}"), _text("answer is ", 1 + n % 5), _text("Answer: ", n), _text("```python\n", n, "\n```"), _text("The thing\nfinal answer ", n, "\nhttps://x.y"), _text(n, "<|im_end|>"), _text(" ", n, "\n")
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), family.alias("family"), answers.extract(family, raw).alias("answer"))


@query(r"SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '\frac{' || o_custkey || '}{7}' WHEN 1 THEN o_custkey || '' WHEN 2 THEN '{' || o_custkey || '}' END AS boxed FROM orders")
def boxed_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last box with balanced braces; none where no box closes."""
    n = F.col("o_custkey")
    raw = _one_of(F.col("o_orderkey") % 4, _text(r"\boxed{1} so \boxed{\frac{", n, "}{7}}"), _text(r"\boxed{ ", n, r" } and \boxed{never"), _text(r"\boxed{{", n, "}}"), _text(r"\boxed{", n))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), answers.extract_boxed(raw).alias("boxed"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN o_custkey || '' WHEN 1 THEN '-' || o_custkey || '.5' WHEN 2 THEN substring('abcde', 1 + (o_custkey % 5)::INT, 1) END AS answer FROM orders")
def marker_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows the last place of the first marker that has a number or letter."""
    n = F.col("o_custkey")
    letter = F.substr(F.lit("abcde"), (1 + n % 5).cast("int"), F.lit(1))
    raw = _one_of(F.col("o_orderkey") % 4, _text("Answer: 1 or rather Answer: ", n), _text("คำตอบคือ: -", n, ".5 ANS: 3"), _text("ANS: (", letter, ")"), _text("it is ", n))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), answers.extract_after_marker(raw).alias("answer"))


@query("SELECT o_orderkey AS id, lower(o_orderstatus) || o_custkey AS answer FROM orders")
def answer_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dollars, end dots, white space and up to twelve pairs of braces around an answer."""
    deep = (F.col("o_orderkey") % 13).cast("int")
    raw = F.concat(F.lit("  $"), F.repeat(F.lit("{("), deep), F.lit(" "), "o_orderstatus", F.lit("\t\\, \\!"), F.col("o_custkey").cast("string"), F.repeat(F.lit(") }"), deep), F.lit("$.' "))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), answers.normalize_answer(raw).alias("answer"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey || '' ELSE substring('abcde', 1 + (o_custkey % 5)::INT, 1) END AS answer FROM orders")
def kind_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mathematics by box or marker, choices by phrase or marker."""
    n, odd = F.col("o_custkey"), F.col("o_orderkey") % 2 == 1
    letter = F.substr(F.lit("ABCDE"), (1 + n % 5).cast("int"), F.lit(1))
    third = F.col("o_orderkey") % 3 == 0
    raw = F.when(odd, F.when(third, _text("the answer is ", letter, ".")).otherwise(_text("คำตอบคือ (", letter, ")"))).otherwise(F.when(third, _text(r"\boxed{(", n, ")}")).otherwise(_text("final answer is ", n)))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), answers.extract_kind(F.when(odd, "mcq").otherwise("math"), raw).alias("answer"))


@query("SELECT conv_id, turn, trim(text, chr(32)||chr(9)||chr(10)||chr(13)) AS said FROM conversations WHERE text IS NOT NULL")
def think_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasoning blocks, one or two, before each turn."""
    x = _one_of(F.col("turn") % 2, _text("<think>a</think>", F.col("text")), _text("<think>a</think> b </think>\n", F.col("text"), " "))
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", answers.strip_think(x).alias("said"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE '{"k": ' || user_id || ', "v": {"t": "' || event_type || '"}}' END AS span, CASE WHEN event_id % 3 = 1 THEN '{"items": [{"a": "} ' || user_id || '"}]}' END AS items FROM events""")
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First to last brace of a reply, and the balanced object that begins with "items" (strings hold braces)."""
    obj = _text('{"k": ', F.col("user_id"), ', "v": {"t": "', F.col("event_type"), '"}}')
    items = _text('{"items": [{"a": "} ', F.col("user_id"), '"}]}')
    k = F.col("event_id") % 3
    e = table(spark, sf_dir, "events").select("event_id", _one_of(k, _text("so: ", obj, " ok"), _text("```json\n", obj, "\n```"), F.lit("none } here {")).alias("a"), _one_of(k, F.lit("no"), _text("x ", items, " } y"), _text('{"items": [', F.col("user_id"))).alias("b"))
    return e.select("event_id", answers.json_span(F.col("a")).alias("span"), answers.json_items(F.col("b")).alias("items"))


@query("SELECT p_partkey AS id, p_name || ' ?' AS problem, CASE p_partkey % 3 WHEN 0 THEN p_size || '' WHEN 1 THEN '-' || p_size END AS answer FROM part WHERE p_partkey % 5 > 0")
def seed_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem and answer of rendered texts with a task mark; every fifth has none."""
    said = _one_of(F.col("p_partkey") % 3, _text(r"so \boxed{", F.col("p_size"), "}"), _text("คำตอบคือ -", F.col("p_size")), F.lit("I can't say"))
    text = _text("<|im_start|>user\n# Example\nx\n\n", F.when(F.col("p_partkey") % 5 > 0, "# Your task\n").otherwise(""), F.col("p_name"), " ?\n<|im_end|>\n<|im_start|>assistant\n", said, "<|im_end|>")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), chat.seed_of(text).alias("_s")).where("_s is not null").select("id", "_s.problem", "_s.answer")


_CHOICES = "[p_name, p_brand, p_type, p_size || '', CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'none' END]"


def _choices() -> Column:
    return F.array("p_name", "p_brand", "p_type", F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 4 == 0, "").otherwise("none"))


@query("SELECT p_partkey AS id, p_partkey % 4 <> 0 AND p_partkey % 6 BETWEEN 1 AND 5 AND p_partkey % 7 <> 0 AS valid FROM part")
def choice_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five non-empty choices, an answer 1 to 5, and no word about files."""
    question = _text(F.when(F.col("p_partkey") % 7 == 0, "What does the FILE say of ").otherwise("What is "), F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), chat.valid_choice(question, _choices(), F.col("p_partkey") % 6, ("file", "ocr")).alias("valid"))


@query(f"""
SELECT p_partkey AS id, 'Which?' || chr(10) || array_to_string(list_transform({_CHOICES}, lambda c, i: '(' || substring('abcde', i, 1) || ') ' || c), chr(10)) AS prompt,
 CASE p_partkey % 3 WHEN 0 THEN 'คำตอบคือ (' || substring('abcde', 1 + (p_partkey % 5)::INT, 1) || ')' WHEN 1 THEN 'as คำตอบคือ x' ELSE 'so' || chr(10) || 'คำตอบคือ (' || substring('abcde', 1 + (p_partkey % 5)::INT, 1) || ')' END AS answer FROM part
""")
def choice_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lettered choices; the answer phrase is added where it is missing. Answers come as digits and letters."""
    given = F.when(F.col("p_partkey") % 2 == 0, (1 + F.col("p_partkey") % 5).cast("string")).otherwise(F.substr(F.lit(" A B C D E"), (2 + 2 * (F.col("p_partkey") % 5)).cast("int"), F.lit(1)))
    why = _one_of(F.col("p_partkey") % 3, F.lit(""), F.lit("as คำตอบคือ x"), F.lit("so"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), chat.render_choices(F.lit("Which?"), _choices()).alias("prompt"), chat.choice_answer(why, chat.choice_letter(given)).alias("answer"))


_HINTS = {"BRASS": "metal", "ECONOMY": "cheap", "small": "little"}


@query("""
SELECT p_partkey AS id, CASE WHEN p_brand = 'Brand#3' THEN p_name ELSE p_name || chr(10) || chr(10) || '## About' || chr(10) || 'parts' || chr(10) || chr(10)
 || CASE WHEN p_type = 'ECONOMY' OR p_name LIKE 'small%' THEN '## Hints' || chr(10) || array_to_string(list_filter([CASE WHEN p_type = 'ECONOMY' THEN '- cheap' END, CASE WHEN p_name LIKE 'small%' THEN '- little' END], lambda x: x IS NOT NULL), chr(10)) || chr(10) || chr(10) ELSE '' END
 || '## Form' || chr(10) || 'a number' END AS prompt FROM part
""")
def math_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context, hints by tag and the form, once only; a family without a context stays."""
    family, tags = F.col("p_brand"), F.array("p_type", F.split("p_name", " ")[0], "p_type")
    pad = lambda x: chat.pad_math(x, family, tags, {f"Brand#{i}": "parts" for i in range(100) if i != 3}, _HINTS, ("## About", "## Hints", "## Form"), "a number")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), pad(F.col("p_name")).alias("_p"), "p_brand", "p_type", "p_name").select("id", pad(F.col("_p")).alias("prompt"))


_WORDS = {"examples": "Example", "input": "In:", "output": "Out:", "limits": "Limits", "range": "numbers in", "small": "small", "middle": "middle", "large": "large", "nested": "nested", "search": "search", "notes": "Notes", "edge": "edges", "counts": "counts", "sort": "sort"}


@query("""
SELECT event_id AS id, 'Do ' || event_type || chr(10) || chr(10) || 'Example 2' || chr(10) || 'In:' || chr(10) || user_id || chr(10) || 'Out:' || chr(10) || '1' || chr(10) || chr(10)
 || 'Limits' || chr(10) || 'numbers in [' || least(user_id, 5) || ', ' || greatest(user_id, 5) || ']' || chr(10) || 'small' || chr(10) || 'search' || chr(10) || chr(10) || 'Notes' || chr(10) || 'edges' || chr(10) || 'sort' AS prompt FROM events
""")
def code_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples, bounds and notes for short prompts, from tests and the reference program."""
    test = lambda i, o: F.struct(i.alias("input"), o.alias("output"))
    public, hidden = F.array(test(F.lit("5"), F.lit("0"))), F.array(test(F.col("user_id").cast("string"), F.lit("1")))
    prompt = chat.pad_code(_text("Do ", F.col("event_type")), public, hidden, F.lit("while x: y = sorted(x)"), _WORDS)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), prompt.alias("prompt"))


@query("SELECT c_custkey AS id, lower(c_mktsegment) || '-7b-v1-' || c_nationkey AS slug FROM customer")
def model_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), tx.slug(_text("org/sub/", F.col("c_mktsegment"), ".7B_v1-", F.col("c_nationkey"))).alias("slug"))


@query("SELECT doc_id, sha256(concat_ws('|', lang, source, doc_id)) AS seed FROM documents")
def record_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's reproducible seed, of family, difficulty and id."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.stable_seed(F.col("lang"), F.col("source"), F.col("doc_id")).alias("seed"))


@query("SELECT doc_id, row_number() OVER (ORDER BY sha256('42|' || doc_id), doc_id) AS place FROM documents QUALIFY place <= 100")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred of a reproducible shuffle (the cut is the feature)."""
    from ..operators import curate

    return curate.shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "42", 100)


#: Pairs made of a number n and digits d: are they equal, and how is that seen.
_PAIRS = [(True, "symbolic"), (True, "symbolic"), (True, "rational"), (False, "symbolic"), (True, "symbolic"), (None, None), (True, "rational"), (False, "symbolic"), (True, "symbolic"), (True, "strict"), (True, "symbolic"), (None, None)]


@query(f"SELECT o_orderkey AS id, {[{'ok': ok, 'method': how} for ok, how in _PAIRS]}[1 + (o_orderkey % 12)::INT].ok AS ok, {[how for _, how in _PAIRS]}[1 + (o_orderkey % 12)::INT] AS method FROM orders".replace("None", "NULL"))
def math_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in two forms: products, roots, 30 digits and more, fractions in LaTeX, powers; unequal ones, and words."""
    n, d = F.col("o_custkey") + 1, F.lpad(F.col("o_orderkey").cast("string"), 15, "7")
    k = F.col("o_orderkey") % 12
    a = _one_of(
        k, _text("2x+", n * 2), _text(r"\sqrt{8}", "*", n), _text(d, d, "/3"), _text(d, d), _text(r"\frac{x^2-", n * n, "}{x-", n, "}"), _text("the value ", n),
        _text(r"\frac{", n, "}{10000000}"), _text("(x+", n, ")^2"), _text(n, r"\sqrt{3}\cdot\sqrt{6}"), _text("$", n, " y$"), _text(r"\frac{", n, r"}{\sqrt{5}}"), _text("(", n, ", 1)"),
    )
    b = _one_of(
        k, _text("2(x+", n, ")"), _text(n * 2, r"\sqrt{2}"), _text("2*", d, d, "/6"), _text(d, d, "+1"), _text("x+", n), n.cast("string"),
        F.concat(F.floor(n / 10000000).cast("string"), F.lit("."), F.lpad((n % 10000000).cast("string"), 7, "0")), _text("x^2+", n * n), _text(n * 3, r"\sqrt{2}"), _text(n, "Y"), _text(n, r"\sqrt{5}/5"), _text("(", n, ", 2)"),
    )
    verdict = answers.math_verdict(a, b)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), verdict.alias("v")).select("id", "v.ok", "v.method")
