"""Thai verse and register. Syllables are counted by `thai.count_syllables`, or by what the caller has instead."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .answers import strip
from .text import split_lines
from .thai import count_syllables, parts

# Tone marks, particles and markers.
TONE_MARKS = {"\u0e48": "mai_ek", "\u0e49": "mai_tho", "\u0e4a": "mai_tri", "\u0e4b": "mai_chattawa"}
CASUAL_PARTICLES = ["ครับ", "ค่ะ", "นะคะ", "จ้ะ", "จ้า", "จ๊ะ", "นะจ๊ะ", "เนอะ", "เด้อ"]
FORMAL_MARKERS = ["ขอบพระคุณ", "ขออนุญาต", "เรียน", "ตามที่", "ด้วยความเคารพ", "ในนามของ", "อนึ่ง"]
#: form: (lines to a stanza, least and most syllables in a line, whether lines rhyme)
FORMS = {"klon_4": (4, 3, 5, False), "klon_8": (4, 7, 9, True), "kap_yani_11": (2, 10, 12, False)}

def syllable_counter(count: Callable[[str], int] = count_syllables):
    """A UDF for the syllables of a text; a null has none."""

    def of_each(x: pd.Series) -> pd.Series:
        return x.map(lambda s: count(s or "")).astype("int64")

    return F.pandas_udf(of_each, T.LongType())


def line_syllables(count: Callable[[str], int] = count_syllables):
    """A UDF for the syllables of each of an array of lines."""

    def of_each(x: pd.Series) -> pd.Series:
        return x.map(lambda lines: None if lines is None else [count(s or "") for s in lines])

    return F.pandas_udf(of_each, T.ArrayType(T.LongType()))


def syllable_parts(x: Column) -> Column:
    """array<struct<part, n>>: the parts of a text and their syllables, in order; null for null."""

    def of_each(x: pd.Series) -> pd.Series:
        return x.map(lambda s: None if s is None else [{"part": p, "n": n} for p, n in parts(s)])

    return F.pandas_udf(of_each, "array<struct<part: string, n: int>>")(x)


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), for which x is computed once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def verse_lines(x: Column) -> Column:
    at_ends = lambda y: F.concat(F.left(y, F.lit(1)), F.right(y, F.lit(1))).rlike(r"(?U)\s")
    return F.filter(F.transform(split_lines(x), lambda y: F.when(at_ends(y), strip(y)).otherwise(y)), lambda y: y != "")


def tone_marks(x: Column) -> Column:
    """array<struct<at, name>>, places from 0."""
    name = F.create_map(*[F.lit(v) for kv in TONE_MARKS.items() for v in kv])
    every = F.transform(F.split(x, ""), lambda c, i: F.struct(i.alias("at"), name[c].alias("name")))
    return F.filter(every, lambda m: m["name"].isNotNull())


def rhyme_key(word: Column) -> Column:
    return F.when(F.length(word) > 2, F.substring(word, -2, 2)).otherwise(word)


def words_of(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit("[\u0e00-\u0e7f]+"), 0)


def rhyme_failures(lines: Column) -> Column:
    """Numbers of stanza rules broken in the first four lines of each stanza: 1 (line 1 with inside line 2), 2 (line 2 with line 3)."""

    def broken(words: Column) -> Column:
        w = [F.get(words, F.lit(j)) for j in range(3)]
        last = [F.try_element_at(x, F.lit(-1)) for x in w]
        inner = F.when(F.size(w[1]) > 2, F.slice(w[1], F.lit(2), F.size(w[1]) - 2)).otherwise(F.array().cast("array<string>"))
        one = last[0].isNotNull() & last[1].isNotNull() & ~F.exists(inner, lambda t: rhyme_key(t) == rhyme_key(last[0]))
        two = last[1].isNotNull() & last[2].isNotNull() & (rhyme_key(last[1]) != rhyme_key(last[2]))
        return F.filter(F.array(F.when(one, 1), F.when(two, 2)), lambda x: x.isNotNull())

    def of_stanzas(lines: Column) -> Column:
        stanza = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 4).cast("int"))
        words = lambda k: F.array(*[words_of(F.get(lines, k * 4 + j)) for j in range(3)])
        every = F.flatten(F.transform(stanza, lambda k: _once(words(k), broken)))
        return F.when(F.size(lines) > 0, every).otherwise(F.array().cast("array<int>"))

    return _once(lines, of_stanzas)


def check_verse(lines: Column, syllables: Column, form: str) -> Column:
    """array<string> of what a poem breaks: `empty`, `stanza`, `line n: s`, `rhyme stanza:rule`; none if it keeps the form.

    lines: of verse_lines(); syllables: of line_syllables() on them.
    """
    size, least, most, rhymed = FORMS[form]
    words = F.array().cast("array<string>")

    def broken(verse: Column) -> Column:
        lines = verse["lines"]
        each = F.transform(verse["syllables"], lambda s, i: F.when((s < least) | (s > most), F.format_string("line %d: %d", i + 1, s)))
        found = F.filter(each, lambda x: x.isNotNull())
        if rhymed:
            stanzas = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / size).cast("int"))
            of = lambda k: F.transform(rhyme_failures(F.slice(lines, k * size + 1, F.lit(size))), lambda r: F.format_string("rhyme %d:%d", k + 1, r))
            found = F.concat(found, F.flatten(F.transform(stanzas, of)))
        return F.when(F.size(lines) == 0, F.array(F.lit("empty"))).when(F.size(lines) % size != 0, F.array(F.lit("stanza"))).otherwise(F.coalesce(found, words))

    return _once(F.struct(lines.alias("lines"), syllables.alias("syllables")), broken)


#: Task types with a verse form or a register (fixed values); other types are not checked.
VERSE_TASKS = {"klon_composition": "klon_4", "klon_4_composition": "klon_4", "klon_8_composition": "klon_8", "kap_composition": "kap_yani_11", "kap_yani_composition": "kap_yani_11"}
REGISTER_TASKS = {"formal_register": "formal", "informal_register": "informal"}


def prosody_issues(task_type: Column, text: Column, count=None) -> Column:
    """What a record's text breaks, by its task type; none for other types. count: of line_syllables()."""
    lines = F.when(task_type.isin(*VERSE_TASKS), verse_lines(text))
    syllables = (count or line_syllables())(lines)
    out = F.array().cast("array<string>")
    for task, form in VERSE_TASKS.items():
        out = F.when(task_type == task, check_verse(lines, syllables, form)).otherwise(out)
    for task, target in REGISTER_TASKS.items():
        out = F.when((task_type == task) & ~register_ok(text, target), F.array(F.lit(f"register {target}"))).otherwise(out)
    return out


def register_ok(x: Column, target: str) -> Column:
    """Formal: no casual particle. Informal: one at least. Another target fails."""
    casual = F.lit(False)
    for p in CASUAL_PARTICLES:
        casual = casual | F.contains(x, F.lit(p))
    return {"formal": ~casual, "informal": casual}.get(target, F.lit(False))


def markers_in(x: Column, words: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, words)), lambda p: F.contains(x, p))
