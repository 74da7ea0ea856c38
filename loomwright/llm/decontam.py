"""Benchmark decontamination by one Aho-Corasick automaton.

Test items and documents are normalised alike: A-Z lower-cased, words of
[0-9a-z] and non-ASCII characters, one space between words. Every window of 13
item words is a pattern between two spaces; one automaton over all patterns
reads each whole document once. Word numbers of the matches are mapped back to
places in the original text.

No shuffle: the automaton travels to the documents. Patterns are sent only up
to `max_pattern_chars`; a larger benchmark is cut into blocks by item, each
with an automaton of its own, that the documents pass one after another.
"""

from __future__ import annotations

import hashlib
import re
import threading
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, utf8

WINDOW = 13
#: Characters of patterns in one automaton (some 40 bytes of memory each).
MAX_PATTERN_CHARS = 8_000_000
_WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: ASCII: letters in lower case, digits, and a space for all else.
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))
_built: dict[str, object] = {}
_lock = threading.Lock()

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return raw.translate(_TABLE).split()


def windows_of(text: str | None, window: int = WINDOW) -> set[bytes]:
    """Windows of an item; fewer words make one window, none make none."""
    w = words_of(text)
    return {b" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else set()


def _automaton(key: str, patterns: list[tuple[str, tuple[int, int]]]):
    """Built once in each Python worker. A value: (words in the pattern, number of the pattern)."""
    import ahocorasick

    with _lock:
        if key not in _built:
            _built.clear()
            a = ahocorasick.Automaton()
            for p, v in patterns:
                a.add_word(p, v)
            if patterns:
                a.make_automaton()
            _built[key] = a
    return _built[key]


def _patterns(items: DataFrame, id_col: str, text_col: str, window: int) -> tuple[list, list]:
    by: dict[bytes, set[str]] = {}
    for item, text in items.select(F.col(id_col).cast("string"), text_col).toLocalIterator():  # bounded by the caller
        for w in windows_of(text, window):
            by.setdefault(w, set()).update({item} - {None})
    ordered = sorted(by)
    return [((b" " + w + b" ").decode("latin-1"), (w.count(b" ") + 1, n)) for n, w in enumerate(ordered)], [sorted(by[w]) for w in ordered]


def _merge(runs: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def find_items(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", out: str = "overlap", window: int = WINDOW, max_pattern_chars: int = MAX_PATTERN_CHARS, keep_text: bool = True
) -> DataFrame:
    """`docs` with the struct column `out`: n_words, hits, items.

    hits: runs [from, to) of document words inside an occurrence of a window,
    apart and in order. items: ids, as text, of the items with an occurring
    window, sorted. Defined cases: a null, empty or wordless text has no words
    and no hits; an item without words has no window; a null item id marks
    words but is not named; repeated items count once; an empty benchmark hits
    nothing; repeated documents are read each, an empty table gives no rows; other
    columns pass unchanged. An input column named like `out` is replaced; without `keep_text`
    the text column is left out of the result.
    """
    chars = benchmark.agg(F.sum(F.length(item_text_col) * window)).first()[0] or 0
    n_blocks = int(-(-chars // max_pattern_chars)) or 1
    state = T.StructField(out, RESULT)
    for k in range(n_blocks):
        block = benchmark if n_blocks == 1 else benchmark.where(F.pmod(F.xxhash64(item_text_col), F.lit(n_blocks)) == k)
        patterns, owners = _patterns(block, item_col, item_text_col, window)
        sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, patterns, owners))

        def make(sent=sent, first=k == 0):
            key, patterns, owners = sent.value
            auto = _automaton(key, patterns)

            def scan(text: bytes | None, was: dict | None) -> dict:
                w = words_of(text)
                s = (b" " + b" ".join(w) + b" ").decode("latin-1")
                found = list(auto.iter(s)) if w and patterns else []
                runs, items = [tuple(x) for x in was["hits"]] if was else [], set(was["items"]) if was else set()
                if found:
                    ends = np.flatnonzero(np.frombuffer(s.encode("latin-1"), np.uint8) == 32)
                    last = np.searchsorted(ends, [e for e, _ in found])  # the space after word last - 1
                    runs += [(int(e) - v[0], int(e)) for e, (_, v) in zip(last, found, strict=True)]
                    for n in {v[1] for _, v in found}:
                        items.update(owners[n])
                return {"n_words": len(w), "hits": _merge(runs), "items": sorted(items)}

            kind = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])

            def batch(b: pa.RecordBatch) -> list[pa.Array]:
                was = [None] * b.num_rows if first else b.column(out).to_pylist()
                return [pa.array([scan(t, x) for t, x in zip(utf8(b.column(text_col)), was, strict=True)], kind)]

            return batch

        docs = add_columns(docs, [state], make, () if keep_text or k < n_blocks - 1 else (text_col,))
    return docs


def n_hit(overlap: str = "overlap"):
    """Words in hits."""
    return F.aggregate(F.col(f"{overlap}.hits"), F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])


def contaminated(overlap: str = "overlap", least_share: int = 20):
    """Some hit, and hits are 1 / least_share of the words at least."""
    n = n_hit(overlap)
    return (n > 0) & (least_share * n >= F.col(f"{overlap}.n_words"))


def original_spans(text: str | None, hits: list[list[int]]) -> list[tuple[int, int]]:
    """Runs of words as [from, to) in code points of the original text."""
    if not hits:
        return []
    raw = (text or "").encode("utf-8", "surrogatepass")
    at = [m.span() for m in re.finditer(_WORD, raw.translate(_TABLE))]
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(chars[at[a][0]]), int(chars[at[b - 1][1]])) for a, b in hits]


def with_spans(found: DataFrame, text_col: str = "text", overlap: str = "overlap", out: str = "spans") -> DataFrame:
    """Adds the places of the hits in the original text: array<array<long>> of [from, to)."""

    def make():
        def batch(b: pa.RecordBatch) -> list[pa.Array]:
            hits = b.column(overlap).to_pylist()
            return [pa.array([original_spans(t.as_py(), h["hits"]) for t, h in zip(b.column(text_col), hits, strict=True)], pa.list_(pa.list_(pa.int64())))]

        return batch

    return add_columns(found, [T.StructField(out, T.ArrayType(T.ArrayType(T.LongType())))], make)


def items_digest(overlap: str = "overlap"):
    return F.sha2(F.array_join(f"{overlap}.items", ","), 256)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
