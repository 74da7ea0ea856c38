"""Instruction constraints: two rule sets over typed columns.

A constraint is struct<type, word, n, relation, words> (unused fields null).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .answers import strip
from .text import THAI, occurrences, split_lines

CONSTRAINT = "struct<type:string,word:string,n:long,relation:string,words:array<string>>"
SOFT = ("register", "tone", "style", "semantic", "soft")


def is_json(x: Column) -> Column:
    return F.try_parse_json(x).isNotNull()


@F.pandas_udf(T.BooleanType())
def has_match(text: pd.Series, pattern: pd.Series) -> pd.Series:
    """Whether a record's own pattern is found in its text; a pattern that isn't valid is found nowhere. Null for nulls."""

    def one(x: str | None, p: str | None) -> bool | None:
        if x is None or p is None:
            return None
        try:
            return re.search(p, x) is not None
        except re.error:
            return False

    return pd.Series([one(x, p) for x, p in zip(text, pattern, strict=True)], dtype=object)


def check_exact(response: Column, c: Column, soft_score: Column | None = None) -> Column:
    """Set A: nine exact rules; soft ones pass from a judged score of 7; an unknown type fails."""
    lines = split_lines(response)
    n_lines = F.when(response == "", 0).otherwise(F.size(lines))
    word = c["word"]
    thai = response.rlike(f"[{THAI}]")
    kind = c["type"]
    out = (
        F.when(kind == "keyword_frequency", occurrences(response, word) == c["n"])
        .when(kind == "exact_line_count", n_lines == c["n"])
        .when(kind == "starts_with", F.forall(F.filter(lines, lambda x: strip(x) != ""), lambda x: x.startswith(word)))
        .when(kind == "ends_with", F.regexp_replace(response, r"(?U)\s+$", "").endswith(word))
        .when(kind == "forbid_substring", ~F.contains(response, word))
        .when(kind == "no_arabic_digits", ~response.rlike("[0-9]"))
        .when(kind == "regex", has_match(F.when(kind == "regex", response), word))
        .when(kind == "json_schema", is_json(response))
        .when((kind == "language") & (word == "thai"), thai)
        .when((kind == "language") & (word == "english"), response.rlike("[A-Za-z]") & ~thai)
        .when(kind.isin(*SOFT), (soft_score if soft_score is not None else F.lit(None).cast("double")) >= 7.0)
        .otherwise(False)
    )
    return F.coalesce(out, F.lit(False))


def n_sentences(r: Column) -> Column:
    return F.size(F.regexp_extract_all(r, F.lit(r"[.!?]+"), 0))


def n_words(r: Column) -> Column:
    return F.size(F.regexp_extract_all(r, F.lit(r"(?U)\S+"), 0))


def n_bullets(r: Column) -> Column:
    return F.size(F.regexp_extract_all(r, F.lit(r"(?m)^\s*[*\-]\s+"), 0))


def n_paragraphs(r: Column) -> Column:
    return F.size(F.filter(F.split(r, "\n\n"), lambda p: strip(p) != ""))


def check_lenient(response: Column, c: Column) -> Column:
    """Set B: fourteen rules found in the constraint's id; `less than` is at most; an unknown id passes."""
    r = strip(response)
    low = F.lower(r)
    n, kind = F.coalesce(c["n"], F.lit(0)), F.lower(c["type"])
    has = lambda part: F.contains(kind, F.lit(part))
    words = F.coalesce(c["words"], F.when(c["word"].isNotNull(), F.array(c["word"])), F.array().cast("array<string>"))
    at_least = F.coalesce(c["relation"], F.lit("at least")) == "at least"
    compare = lambda x: F.when(at_least, x >= n).otherwise(x <= n)
    by_words = F.when(c["relation"].isNull(), True).when(c["relation"] == "at least", n_words(r) >= n).when(c["relation"].isin("at most", "less than"), n_words(r) <= n).otherwise(n_words(r) == n)
    count = F.when(F.coalesce(c["word"], F.lit("")) == "", F.length(r) + 1).otherwise(occurrences(low, F.lower(c["word"])))
    out = (
        F.when(has("length_constraints:number_words"), by_words)
        .when(has("length_constraints:number_sentences"), compare(n_sentences(r)))
        .when(has("length_constraints:number_paragraphs"), n_paragraphs(r) >= F.coalesce(c["n"], F.lit(1)))
        .when(has("punctuation:no_comma"), ~F.contains(r, F.lit(",")))
        .when(has("detectable_format:number_bullet_lists"), n_bullets(r) >= n)
        .when(has("detectable_format:title"), r.rlike("<<.+>>") | r.rlike(r"(?m)^#\s+.+$"))
        .when(has("detectable_format:json_format"), is_json(r))
        .when(has("keywords:existence"), F.forall(words, lambda w: F.contains(low, F.lower(w))))
        .when(has("keywords:forbidden_words"), ~F.exists(words, lambda w: F.contains(low, F.lower(w))))
        .when(has("keywords:frequency"), compare(count))
        .when(has("change_case:english_capital"), r == F.upper(r))
        .when(has("change_case:english_lowercase"), r == low)
        .when(has("startend:end_checker"), r.endswith(F.coalesce(c["word"], F.lit(""))))
        .when(has("startend:quotation"), r.startswith('"') & r.endswith('"'))
        .otherwise(True)
    )
    return F.coalesce(out, F.lit(False))


def is_checked(c: Column) -> Column:
    """Whether set B has a rule for the id (it passes the others)."""
    return F.lower(c["type"]).rlike("length_constraints:number_(words|sentences|paragraphs)|punctuation:no_comma|detectable_format:(number_bullet_lists|title|json_format)|keywords:(existence|forbidden_words|frequency)|change_case:english_(capital|lowercase)|startend:(end_checker|quotation)")
