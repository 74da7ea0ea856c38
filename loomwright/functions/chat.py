"""Conversations: message arrays, chat templates, few-shot prompts, prompt padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .answers import strip

MESSAGES = "array<struct<role:string,content:string>>"
# Template tags and role names.
SYSTEM_PROMPT = "You are a helpful assistant."
ROLE_NAMES = {"human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant", "bot": "assistant"}
TASK_MARK = "# Your task"
LETTERS = "abcde"


def _of(messages: Column, role: str) -> Column:
    return F.transform(F.filter(messages, lambda m: m["role"] == role), lambda m: m["content"])


def prompt_text(messages: Column) -> Column:
    return F.array_join(_of(messages, "user"), "\n")


def answer_text(messages: Column) -> Column:
    return F.array_join(_of(messages, "assistant"), "\n")


def first_user(messages: Column) -> Column:
    return F.try_element_at(_of(messages, "user"), F.lit(1))


def last_assistant(messages: Column) -> Column:
    return F.try_element_at(_of(messages, "assistant"), F.lit(-1))


def turn(role: Column, content: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), content, F.lit("<|im_end|>"))


def render_template(messages: Column, system: str = SYSTEM_PROMPT) -> Column:
    """The system turn and all messages, one tagged turn after another."""
    return F.array_join(F.concat(F.array(turn(F.lit("system"), F.lit(system))), F.transform(messages, lambda m: turn(m["role"], m["content"]))), "\n")


def parse_template(x: Column) -> Column:
    """Messages of a rendered text, the system turn left out."""
    p = F.lit(r"(?s)<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>")
    both = F.arrays_zip(F.regexp_extract_all(x, p, 1).alias("role"), F.regexp_extract_all(x, p, 2).alias("content"))
    return F.filter(both, lambda m: m["role"] != "system").cast(MESSAGES)


def normalize_roles(messages: Column, must_match: str | None = None) -> Column:
    """Known roles under one name, others and empty turns dropped; null with fewer than two, or none matching."""
    name = F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv])
    kept = F.filter(F.transform(messages, lambda m: F.struct(name[F.lower(m["role"])].alias("role"), F.trim(m["content"]).alias("content"))), lambda m: m["role"].isNotNull() & (m["content"] != ""))
    ok = F.size(kept) >= 2
    if must_match:
        ok = ok & F.exists(kept, lambda m: m["content"].rlike(must_match))
    return F.when(ok, kept)


def user_text(text: Column, messages: Column | None = None, prompt: Column | None = None, most: int = 2000) -> Column:
    """The last user turn of a tagged text, or the beginning of an untagged one; else the first of messages; else the prompt."""
    last = F.element_at(F.split(text, r"<\|im_start\|>user"), -1)
    tagged = strip(F.split(last, r"<\|im_end\|>")[0])
    out = F.when(F.contains(text, F.lit("<|im_start|>user")), tagged).when(F.length(text) > 0, F.substring(text, 1, most))
    more = [F.nullif(x, F.lit("")) for x in (F.try_element_at(_of(messages, "user"), F.lit(1)) if messages is not None else None, prompt) if x is not None]
    return F.coalesce(out, *more)


def example_block(user: Column, assistant: Column) -> Column:
    return F.concat(F.lit("# Example\n## Question\n"), user, F.lit("\n## Answer\n"), assistant)


def with_examples(messages: Column, blocks: Column) -> Column:
    """Example blocks set before the first user turn; unchanged without blocks."""
    prefix = F.concat(F.array_join(blocks, "\n\n"), F.lit(f"\n\n{TASK_MARK}\n"))
    at = F.array_position(F.transform(messages, lambda m: m["role"]), "user")
    patched = F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), F.when(i + 1 == at, F.concat(prefix, m["content"])).otherwise(m["content"]).alias("content")))
    return F.when(F.size(blocks) > 0, patched).otherwise(messages)


def seed_of(text: Column) -> Column:
    """struct<problem, answer> of a rendered text with a task mark; null without."""
    tail = F.element_at(F.split(text, TASK_MARK), -1)
    problem = strip(F.split(F.split(tail, r"<\|im_end\|>")[0], r"<\|im_start\|>")[0])
    said = F.split(F.element_at(F.split(text, r"<\|im_start\|>assistant"), -1), r"<\|im_end\|>")[0]
    said = F.when(F.contains(text, F.lit("<|im_start|>assistant")), said)
    boxed = F.nullif(F.regexp_extract(said, r"\\boxed\{([^{}]+)\}", 1), F.lit(""))
    phrase = F.nullif(F.regexp_extract(said, r"คำตอบคือ\s*([0-9\-+]+)", 1), F.lit(""))
    return F.when(F.contains(text, F.lit(TASK_MARK)), F.struct(problem.alias("problem"), F.coalesce(strip(boxed), phrase).alias("answer")))


def choice_letter(answer: Column) -> Column:
    """1 to 5 as a to e; a letter stays; else null."""
    a = F.lower(strip(answer))
    return F.when(a.rlike("^[1-5]$"), F.translate(a, "12345", LETTERS)).when(a.rlike("^[a-e]$"), a)


def render_choices(question: Column, choices: Column) -> Column:
    lines = F.transform(choices, lambda c, i: F.concat(F.lit("("), F.substr(F.lit(LETTERS), i + 1, F.lit(1)), F.lit(") "), c))
    return F.concat(question, F.lit("\n"), F.array_join(lines, "\n"))


def choice_answer(explanation: Column, letter: Column, mark: str = "คำตอบคือ") -> Column:
    """The explanation, with the answer phrase added where it is missing."""
    end = F.concat(F.lit(f"{mark} ("), letter, F.lit(")"))
    return F.when(F.contains(explanation, F.lit(mark)), explanation).when(F.coalesce(explanation, F.lit("")) == "", end).otherwise(F.concat(explanation, F.lit("\n"), end))


def valid_choice(question: Column, choices: Column, answer: Column, meta_words: tuple[str, ...] = ()) -> Column:
    """Five non-empty choices, an answer 1 to 5, a question, and no word that talks about the task."""
    ok = (F.length(strip(question)) > 0) & (F.size(choices) == 5) & F.forall(choices, lambda c: F.length(strip(c)) > 0) & answer.cast("string").rlike("^[1-5]$")
    for w in meta_words:
        ok = ok & ~F.contains(F.lower(question), F.lit(w.lower()))
    return F.coalesce(ok, F.lit(False))


def pad_math(prompt: Column, family: Column, tags: Column, preambles: dict[str, str], hints: dict[str, str], titles: tuple[str, str, str], reminder: str, most: int = 3) -> Column:
    """Adds context, up to three distinct hints by tag, and the answer format; once only. Opt-in: it changes prompts."""
    known = F.create_map(*[F.lit(x) for kv in hints.items() for x in kv]) if hints else None
    picked = F.slice(F.array_distinct(F.filter(F.transform(tags, lambda t: known[t]), lambda h: h.isNotNull())), 1, most) if hints else F.array().cast("array<string>")
    intro = F.create_map(*[F.lit(x) for kv in preambles.items() for x in kv])[family]
    parts = F.array_compact(
        F.array(
            F.concat(F.lit(titles[0] + "\n"), intro),
            F.when(F.size(picked) > 0, F.concat(F.lit(titles[1] + "\n"), F.array_join(F.transform(picked, lambda h: F.concat(F.lit("- "), h)), "\n"))),
            F.lit(f"{titles[2]}\n{reminder}"),
        )
    )
    fits = intro.isNotNull() & ~F.contains(prompt, F.lit(titles[0])) & ~F.contains(prompt, F.lit(titles[1]))
    return F.when(fits, F.concat(prompt, F.lit("\n\n"), F.array_join(parts, "\n\n"))).otherwise(prompt)


def numeric_bounds(texts: Column) -> Column:
    """struct<low, high, most> of all integers in an array of texts; null without any."""
    nums = F.flatten(F.transform(texts, lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"-?\d{1,18}"), 0), lambda n: n.cast("long"))))
    return F.when(F.size(nums) > 0, F.struct(F.array_min(nums).alias("low"), F.array_max(nums).alias("high"), F.array_max(F.transform(nums, F.abs)).alias("most")))


def pad_code(prompt: Column, public: Column, hidden: Column, reference: Column, words: dict[str, str], most_chars: int = 700) -> Column:
    """Adds examples, bounds and notes to short code prompts. `words` has the wording (keys: examples, input, output,
    limits, range, small, middle, large, nested, search, notes, edge, counts, sort). Opt-in: it changes prompts."""
    empty = F.array().cast("array<struct<input:string,output:string>>")
    pub, hid = F.coalesce(public, empty), F.coalesce(hidden, empty)
    extra = F.slice(F.concat(F.when(F.size(pub) > 1, F.slice(pub, F.lit(2), F.size(pub) - 1)).otherwise(empty), F.slice(hid, 1, 2)), 1, 3)
    examples = F.array_join(F.transform(extra, lambda t, i: F.format_string(words["examples"] + " %d\n" + words["input"] + "\n%s\n" + words["output"] + "\n%s", (i + 2).cast("int"), t["input"], t["output"])), "\n\n")
    bounds = numeric_bounds(F.transform(F.concat(pub, hid), lambda t: t["input"]))
    ref = F.coalesce(reference, F.lit(""))
    size = F.when(bounds["most"] <= 200_000, words["small"]).when(bounds["most"] <= 1_000_000, words["middle"]).when(bounds.isNotNull(), words["large"])
    shape = F.when(ref.rlike("(?s)for .*for "), words["nested"]).when(F.contains(ref, F.lit("while ")) | F.contains(F.lower(ref), F.lit("binary")), words["search"])
    limits = F.array_compact(F.array(F.when(bounds.isNotNull(), F.concat(F.lit(words["range"] + " ["), bounds["low"].cast("string"), F.lit(", "), bounds["high"].cast("string"), F.lit("]"))), size, shape))
    notes = F.array_compact(F.array(F.when(F.size(pub) > 0, words["edge"]), F.when(F.contains(ref, F.lit("Counter")) | F.contains(ref, F.lit("set(")), words["counts"]), F.when(F.contains(F.lower(ref), F.lit("sort")), words["sort"])))
    from .text import occurrences

    many = occurrences(F.lower(prompt), words["examples"].lower()) >= 2
    parts = F.array_compact(
        F.array(
            F.when((F.size(extra) > 0) & ~many, examples),
            F.when((ref != "") & (F.size(limits) > 0) & ~F.contains(prompt, F.lit(words["limits"])), F.concat(F.lit(words["limits"] + "\n"), F.array_join(limits, "\n"))),
            F.when(F.size(notes) > 0, F.concat(F.lit(words["notes"] + "\n"), F.array_join(notes, "\n"))),
        )
    )
    return F.when((F.length(prompt) < most_chars) & (F.size(parts) > 0), F.concat(prompt, F.lit("\n\n"), F.array_join(parts, "\n\n"))).otherwise(prompt)
