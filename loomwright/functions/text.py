"""Text functions: normalising, n-grams, hashes, tokens, script shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thai block.
THAI = "\u0e00-\u0e7f"
#: A word: letters, digits and underscore, or a run of Thai (whose combining marks are no letters).
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[{THAI}]+"


def normalize(x: Column) -> Column:
    """Lower-cased, without any white space (Unicode)."""
    return F.regexp_replace(F.lower(x), r"(?U)\s+", "")


def _let(value: Column, then) -> Column:
    """then(value) with the value worked out once: a lambda's variable is never inlined."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def char_ngrams(x: Column, n: int = 5) -> Column:
    """Distinct character n-grams; a shorter text is its own single gram, an empty one has none.

    Text and characters are bound to lambda variables, so that neither what `x`
    is made of nor the split is repeated for every gram. Use explode_outer on
    it: explode would work the whole out twice.
    """

    def grams(t: Column) -> Column:
        every = _let(F.split(t, ""), lambda c: F.transform(F.sequence(F.lit(0), F.length(t) - n), lambda i: F.concat(*(F.get(c, i + k) for k in range(n)))))
        return F.when(F.length(t) >= n, F.array_distinct(every)).when(F.length(t) > 0, F.array(t)).otherwise(F.array().cast("array<string>"))

    return _let(x, grams)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct elements; 0 if either is empty."""
    i = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(i / (F.size(a) + F.size(b) - i))


def jaccard_of_counts(both: Column, a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(both / (a + b - both))


def stable_bucket(x: Column) -> Column:
    """First 64 bits of SHA-256, as a number in [0, 1]."""
    return F.conv(F.substring(F.sha2(x.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def hash_rank(*parts: Column) -> Column:
    """A hex key whose order is a reproducible shuffle."""
    return F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)


def stable_seed(family: Column, difficulty: Column, record: Column) -> Column:
    """A record's seed as hex: the same for the same three parts."""
    return hash_rank(*(x.cast("string") for x in (family, difficulty, record)))


def occurrences(x: Column, part: str | Column) -> Column:
    """Non-overlapping occurrences of a non-empty part."""
    p = F.lit(part) if isinstance(part, str) else part
    return ((F.length(x) - F.length(F.replace(x, p, F.lit("")))) / F.length(p)).cast("long")


def estimate_tokens(chars: Column, chars_per_token: float = 3.5) -> Column:
    return F.floor(chars / F.lit(chars_per_token)).cast("long")


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(TOKEN), 0)


def script_share(x: Column, ranges: str = THAI, first: int | None = None) -> Column:
    """Share of characters in the ranges, of the whole text or its first so many."""
    s = x if first is None else F.substring(x, 1, first)
    return F.length(F.regexp_replace(s, f"[^{ranges}]", "")) / F.greatest(F.length(s), F.lit(1))


def has_script(x: Column, ranges: str = THAI, first: int | None = None) -> Column:
    s = x if first is None else F.substring(x, 1, first)
    return s.rlike(f"[{ranges}]")


def html_to_text(x: Column, most: int | None = 8000) -> Column:
    """Scripts, styles, tags and character references out, white space squeezed."""
    s = F.regexp_replace(x, r"(?is)<script[^>]*>.*?</script>", " ")
    s = F.regexp_replace(s, r"(?is)<style[^>]*>.*?</style>", " ")
    s = F.regexp_replace(s, r"(?s)<[^>]+>", " ")
    s = F.regexp_replace(s, r"&[a-zA-Z]+;", " ")
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.substring(s, 1, most) if most else s


def strip_punctuation(x: Column) -> Column:
    """Everything but letters, digits, underscore, white space and Thai becomes a space."""
    return F.regexp_replace(x, rf"[^\p{{L}}\p{{N}}_\s{THAI}]", " ")


def fact_keywords(x: Column, most: int = 5) -> Column:
    """The first runs of four or more Thai or Latin word characters."""
    return F.slice(F.regexp_extract_all(strip_punctuation(x), F.lit(rf"[{THAI}A-Za-z][{THAI}A-Za-z0-9_]{{3,}}"), 0), 1, most)


def split_lines(x: Column) -> Column:
    """At every line boundary of Unicode and the ASCII separators, without an empty last line."""
    parts = F.split(x, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def slug(x: Column) -> Column:
    """A model's short name: after the last slash, in lower case, dots and underscores as dashes."""
    return F.translate(F.lower(F.element_at(F.split(x, "/"), -1)), "._", "--")


def percent(x: Column) -> Column:
    """Scores of 0 to 1 or 0 to 100 on the scale of 100, to 2 places."""
    return F.round(F.when(x <= 1, x * 100).otherwise(x), 2)


def cache_key(model: Column, mode: Column, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1e", model, mode, *parts).cast("binary"), 256)


def first_match(x: Column, lists: list[tuple[str, list[str]]], default: str, first: int = 500) -> Column:
    """Name of the first list with a keyword in the (lower-cased) beginning of the text."""
    s = F.lower(F.substring(x, 1, first))
    out = F.lit(default)
    for name, words in reversed(lists):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(s, F.lit(w.lower()))
        out = F.when(hit, name).otherwise(out)
    return out
