"""Answer extraction from model responses. Columns, but for what needs balanced braces."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import mathexpr

# The patterns and cue words that responses are read by.
FINAL_ANSWER = r"(?i)(?:final\s+answer|the\s+answer\s+is|answer\s*[:=]|คำตอบคือ|คำตอบ\s*[:：])\s*([^\n.]{1,200})"
NUMBER_AT_END = r"([-+]?\d+(?:\.\d+)?(?:/\d+)?)\s*$"
XNLI_CUES = {
    "entailment": "entailment",
    "contradiction": "contradiction",
    "neutral": "neutral",
    "สรุปได้": "entailment",
    "ตามมา": "entailment",
    "เป็นไปตาม": "entailment",
    "ขัดแย้ง": "contradiction",
    "ไม่สอดคล้อง": "contradiction",
    "เป็นกลาง": "neutral",
    "ไม่เกี่ยว": "neutral",
    "ไม่แน่ชัด": "neutral",
}
PREAMBLES = [
    r"(?i)^(?:certainly|sure|of course|okay|ok|alright|here'?s?\s+(?:is|are|the))\b.*?[:.](\s*|$)",
    r"(?i)^(?:ครับ|ค่ะ|ได้ครับ|ได้ค่ะ)\s*[,，]?\s*",
    r"(?i)^(?:นี่คือ|นี้คือ|นี่คือคำตอบ|นี้คือคำตอบ|คำตอบ)\s*[:：,，]?\s*",
    r"(?i)^(?:answer|response|output)\s*[:=]\s*",
]
END_TAGS = ["<|im_end|>", "<|endoftext|>", "<|eot_id|>"]
ANSWER_MARKERS = ["คำตอบคือ", "Answer:", "ANS:", "final answer is"]
FENCED = r"(?s)^```[a-zA-Z]*\n(.*?)\n```$"
CODE_BLOCK = r"(?s)```(?:python|py)?\n(.*?)\n```"
LINK, NAMED_SOURCE = r"https?://[^\s)\]]+", r"(?i)\[(?:source|แหล่ง|wiki|wikipedia)\s*[:：]\s*([^\]]+)\]"
EXAM_CHOICE = r"\(([1-9]|[ก-ง])\)"
EXAM_PHRASE = r"(?i)(?:ตอบ|คำตอบ|answer|choice|select)\s*(?:คือ|is|:|=)?\s*\(?([1-9]|[ก-ง])\)?"
CHOICE_PHRASES = [r"คำตอบคือ\s*[(\[]?([a-eA-E])[)\]]?", r"(?i)answer\s+is\s+[(\[]?([a-eA-E])[)\]]?"]
CHOICE_DIGITS = [r"คำตอบคือ\s*[(\[]?([1-5๑๒๓๔๕])[)\]]?", r"(?i)answer\s+is\s+([1-5])"]
THAI_CHOICE = {"๑": "a", "๒": "b", "๓": "c", "๔": "d", "๕": "e"}


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _found(x: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null without one."""
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, group))


def _last(x: Column, pattern: str, group: int = 1) -> Column:
    every = F.regexp_extract_all(x, F.lit(pattern), group)
    return F.when(F.size(every) > 0, F.element_at(every, -1))


def _no_end_dots(x: Column) -> Column:
    return F.regexp_replace(strip(x), r"\.+$", "")


def last_line(x: Column) -> Column:
    """The last line that isn't blank, stripped."""
    lines = F.filter(F.transform(F.split(x, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), strip), lambda y: y != "")
    return F.when(F.size(lines) > 0, F.element_at(lines, -1))


def extract_math(x: Column) -> Column:
    """The last plain \\boxed{}, or an answer phrase in the last 1,000 characters, or the last line's number, or that line."""
    tail = F.when(F.length(x) > 1000, F.substring(x, -1000, 1000)).otherwise(x)
    line = last_line(x)
    return F.coalesce(_no_end_dots(_last(x, r"\\boxed\{([^{}]+)\}")), _no_end_dots(_found(tail, FINAL_ANSWER)), _found(line, NUMBER_AT_END), line, F.lit(""))


def extract_exam(x: Column) -> Column:
    """An inference class, or a choice as (n), or the text itself."""
    t = strip(x)
    low = F.lower(t)
    options: list[Column] = []
    for cue in ("entailment", "contradiction", "neutral"):
        options.append(F.when(F.array_contains(F.split(low, r"(?U)\s+"), cue) | low.startswith(cue), cue))
    options += [F.when(F.contains(t, F.lit(cue)), label) for cue, label in XNLI_CUES.items()]
    choices = [
        _found(t, EXAM_CHOICE),
        _found(t, EXAM_PHRASE),
        _found(t, r"^([1-9])"),
        _found(F.substring(t, 1, 30), r"(?U)\b([1-9])\b"),
    ]
    options += [F.concat(F.lit("("), c, F.lit(")")) for c in choices]
    return F.coalesce(*options, t, F.lit(""))


def extract_instruction(x: Column) -> Column:
    """A wholly fenced response is unwrapped; else preambles go, stacked up to four deep."""
    t = strip(x)
    plain = t
    for _ in range(4):
        for p in PREAMBLES:
            plain = strip(F.regexp_replace(plain, p, ""))
    return F.coalesce(F.when(t.rlike(FENCED), strip(F.regexp_extract(t, FENCED, 1))).otherwise(plain), F.lit(""))


def extract_code(x: Column) -> Column:
    """The longest fenced block, the first of equal ones; the whole text without a fence."""
    blocks = F.regexp_extract_all(x, F.lit(CODE_BLOCK), 1)
    longest = F.aggregate(blocks, F.lit(None).cast("string"), lambda a, b: F.when(a.isNull() | (F.length(b) > F.length(a)), b).otherwise(a))
    return F.coalesce(strip(F.coalesce(longest, x)), F.lit(""))


def extract_multihop(x: Column) -> Column:
    """struct<answer, sources>: an answer phrase or else the first short line before a source; links and [source: ...] marks."""
    t = strip(x)
    lines = F.filter(F.transform(F.split(t, "\n"), strip), lambda y: y != "")
    is_source = lambda y: y.rlike(r"^(http|\[source|\[wiki|\[แหล่ง)")
    before = F.aggregate(lines, F.struct(F.lit(False).alias("over"), F.lit(None).cast("string").alias("line")), lambda a, y: F.struct((a["over"] | is_source(y) | (F.length(y) <= 200)).alias("over"), F.when(~a["over"] & ~is_source(y) & (F.length(y) <= 200), y).otherwise(a["line"]).alias("line")))["line"]
    short = _no_end_dots(F.regexp_replace(before, r"^[^:]*:", ""))
    sources = F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit(LINK), 0), F.regexp_extract_all(t, F.lit(NAMED_SOURCE), 1)))
    return F.struct(F.coalesce(_no_end_dots(_found(t, FINAL_ANSWER)), short, F.lit("")).alias("answer"), F.coalesce(sources, F.array().cast("array<string>")).alias("sources"))


def extract_chat(x: Column) -> Column:
    """Without an outer fence, or else without chat end tags."""
    t = strip(x)
    plain = t
    for tag in END_TAGS:
        plain = F.replace(plain, F.lit(tag), F.lit(""))
    return F.coalesce(F.when(t.rlike(FENCED), strip(F.regexp_extract(t, FENCED, 1))).otherwise(strip(plain)), F.lit(""))


#: family: its extractor; `extract` sends other families' responses through stripped.
EXTRACTORS = {
    "aime24": extract_math,
    "aime25": extract_math,
    "math500": extract_math,
    "math500_th": extract_math,
    "aime_th": extract_math,
    "openthaieval": extract_exam,
    "ifeval": extract_instruction,
    "ifeval_ifbench": extract_instruction,
    "livecodebench": extract_code,
    "livecodebench_th": extract_code,
    "hotpotqa": lambda x: extract_multihop(x)["answer"],
    "hotpotqa_agentic": lambda x: extract_multihop(x)["answer"],
    "mt_bench": extract_chat,
}


def extract(family: Column, x: Column) -> Column:
    out = F.coalesce(strip(x), F.lit(""))
    for name, f in EXTRACTORS.items():
        out = F.when(family == name, f(x)).otherwise(out)
    return out


def _last_boxed(text: str | None) -> str | None:
    if text is None:
        return None
    found, at = None, 0
    for m in re.finditer(r"\\boxed(?=\{)", text):
        if m.start() < at:
            continue
        depth = 0
        for i in range(m.end(), len(text)):
            depth += {"{": 1, "}": -1}.get(text[i], 0)
            if not depth:
                found, at = text[m.end() + 1 : i].strip(), i
                break
        else:
            break
    return found


@F.pandas_udf(T.StringType())
def extract_boxed(x: pd.Series) -> pd.Series:
    """What the last \\boxed{} with balanced braces holds (a regular expression can't balance)."""
    return x.map(_last_boxed)


def extract_after_marker(x: Column) -> Column:
    """The number or letter after the last place of the first marker that has one."""
    options = []
    for m in ANSWER_MARKERS:
        tail = F.when(F.contains(x, F.lit(m)), strip(F.element_at(F.split(x, re.escape(m)), -1)))
        options.append(F.translate(_found(tail, r"^[^\d\-+]*([\-+]?\d+(?:\.\d+)?(?:/\d+)?|\([a-eA-E]\)|[a-eA-E])"), "()", ""))
    return F.coalesce(*options)


def extract_choice(x: Column) -> Column:
    """A letter a to e: after an answer phrase, or in brackets, or a digit after a phrase."""
    letters = [F.lower(_last(x, p)) for p in [*CHOICE_PHRASES, r"[(\[]([a-eA-E])[)\]]"]]
    return F.coalesce(*letters, *(F.translate(_last(x, p), "12345" + "".join(THAI_CHOICE), "abcde" + "".join(THAI_CHOICE.values())) for p in CHOICE_DIGITS))


def normalize_answer(x: Column) -> Column:
    """Compact form: lower case, no dollars, end dots or quotes, outer braces (however many) or white space."""
    s = F.regexp_replace(F.replace(F.lower(strip(x)), F.lit("$"), F.lit("")), r"[.\"']+$", "")
    bare = lambda t: F.when(t.rlike(r"(?s)^(\{.*\}|\(.*\))$"), strip(F.substr(t, F.lit(2), F.length(t) - 2))).otherwise(t)
    opening = F.length(F.regexp_extract(s, r"^[\s{(]+", 0))  # as many pairs at most
    s = F.when(opening > 0, F.aggregate(F.sequence(F.lit(1), opening), s, lambda t, _: bare(t))).otherwise(s)
    s = F.regexp_replace(F.regexp_replace(s, r"\\ ", " "), r"\\[,!]", "")
    return F.regexp_replace(s, r"(?U)\s+", "")


def extract_kind(kind: Column, x: Column) -> Column:
    boxed = F.coalesce(extract_boxed(x), extract_after_marker(x))
    return normalize_answer(F.when(kind == "mcq", F.coalesce(extract_choice(x), extract_after_marker(x))).otherwise(boxed))


def strict_norm(x: Column) -> Column:
    return F.regexp_replace(F.replace(F.replace(F.lower(x), F.lit("$"), F.lit("")), F.lit("\\,"), F.lit("")), r"(?U)\s+", "")


@F.pandas_udf(T.StringType())
def _compared(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([mathexpr.compare(x, y) for x, y in zip(a, b, strict=True)], dtype=object)


def math_verdict(a: Column, b: Column) -> Column:
    """struct<ok, method> of two answers: `strict` if alike after normalising, `rational` or `symbolic` if both are read as expressions.

    Equal expressions are ok, others not; both null where one can't be read (for a judge), or is null.
    """
    same = strict_norm(a) == strict_norm(b)
    found = _compared(F.when(~same, a), b)  # a null is not read
    verdict = lambda ok, method: F.struct(ok.alias("ok"), method.alias("method"))
    how = F.when(found == "different", "symbolic").otherwise(found)
    return F.when(same, verdict(F.lit(True), F.lit("strict"))).otherwise(verdict(found != "different", how))


def same_math(a: Column, b: Column) -> Column:
    """'strict' if alike after normalising, 'rational' if equal as numbers, 'symbolic' as expressions, else null."""
    found = _compared(F.when(strict_norm(a) != strict_norm(b), a), b)
    return F.when(strict_norm(a) == strict_norm(b), "strict").when(found != "different", found)


def is_choice(x: Column) -> Column:
    return strip(x).rlike(r"^\(?[1-9]\)?$|^\(?[ก-ฮ]\)?$")


def first_letter(x: Column) -> Column:
    """The first a to e anywhere (so `answer: c` gives a)."""
    return F.regexp_extract(F.lower(strip(x)), r"\(?([a-e])\)?", 1)


def visible(x: Column, least: int = 100) -> Column:
    """After the reasoning block, unless what follows is shorter than `least`."""
    at = F.instr(x, "</think>")
    after = strip(F.substr(x, at + 8))
    return F.when((at > 0) & (F.length(after) >= least), after).otherwise(x)


def strip_think(x: Column) -> Column:
    return F.when(F.instr(x, "</think>") > 0, strip(F.element_at(F.split(x, "</think>"), -1))).otherwise(x)


def json_span(x: Column, opening: str = "{", closing: str = "}") -> Column:
    """From the first opening to the last closing bracket; null without both."""
    a = F.instr(x, opening)
    b = F.length(x) - F.instr(F.reverse(x), closing) + 1
    return F.when((a > 0) & (F.instr(x, closing) > 0) & (b > a), F.substr(x, a, b - a + 1))


def _balanced(text: str | None) -> str | None:
    at = (text or "").find('{"items"')
    if at < 0:
        return None
    depth, quoted, skip = 0, False, False
    for i in range(at, len(text)):
        c = text[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[at : i + 1]
    return None


@F.pandas_udf(T.StringType())
def json_items(x: pd.Series) -> pd.Series:
    """The balanced object that begins with {"items" (strings may hold braces)."""
    return x.map(_balanced)
