"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle, 1994).

A profile is a language's most frequent character n-grams (1 to 3, within words
set between blanks), in order. A document's own most frequent n-grams are
compared with each profile: the out-of-place distance adds up how far each
n-gram's rank is from its rank in the profile, or the most for a missing one.

N-grams of whole texts are counted by sorting arrays of many texts at once.
Training sums counts of (language, n-gram) in partial aggregates over all
training rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, checkpoint, crc32_of_id

#: N-grams in a language's profile, and in a document's.
PROFILE, DOCUMENT = 400, 300
#: Languages whose profiles are sent and compared at once; further ones follow in blocks.
LANGUAGES = 2000
UNKNOWN = "und"
#: Characters of texts whose n-grams are sorted together.
_CHARS = 1_000_000
_BITS = 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def count_grams(texts: list[str], groups: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, code, count), by group, of the n-grams of all texts of each group. Groups don't decrease.

    All texts are one array of characters in which whatever is no letter is a
    blank, and runs of blanks are one. An n-gram lies within a word and the
    blanks at its sides; it belongs to the group of its letters. A code has
    21 bits for each character. A group may come in two runs of rows.
    """
    low = [t.lower() for t in texts]
    raw = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    group = np.repeat(np.array([*groups, *groups[-1:]], np.int64), [len(t) + 1 for t in low] + [1] * (len(groups) > 0))
    group = np.concatenate([group[:1], group])[: len(raw)]
    letter = _letters()[raw]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    raw, letter, group = np.where(letter, raw, 32)[keep], letter[keep], group[keep]
    there = np.zeros(0x110000, bool)
    there[raw] = True
    chars = np.concatenate([[0], np.flatnonzero(there)])  # 0: no character
    number = np.zeros(0x110000, np.int64)
    number[chars[1:]] = np.arange(1, len(chars))
    c = number[raw]
    w = len(chars).bit_length()
    base = groups[0] if groups else 0
    if 3 * w + int(group.max() - base).bit_length() > 63:  # halves have fewer groups; a single one always fits
        half = len(texts) // 2
        return tuple(np.concatenate(x) for x in zip(count_grams(texts[:half], groups[:half]), count_grams(texts[half:], groups[half:]), strict=True))
    pair = (c[:-1] << w) | c[1:]
    own = np.where(letter[:-1], group[:-1], group[1:])
    inner = letter[1:-1]
    group, own = group - base, own - base
    keys = np.concatenate([(group[letter] << 3 * w) | c[letter], (own << 3 * w) | pair, ((group[1:-1] << 3 * w) | (pair[:-1] << w) | c[2:])[inner]]) if len(c) > 2 else np.empty(0, np.int64)
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    k, n, mask = keys[first], np.diff(np.append(first, len(keys))), (1 << w) - 1
    code = (chars[k >> 2 * w & mask] << 2 * _BITS) | (chars[k >> w & mask] << _BITS) | chars[k & mask]
    return (k >> 3 * w) + base, code, n


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs [from, to) of texts of about _CHARS characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _CHARS or i - start >= 4000:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def grams_of_each(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, counts) of every text in turn."""
    for a, b in _parts(texts):
        group, code, n = count_grams(texts[a:b], list(range(b - a)))
        cut = np.searchsorted(group, np.arange(b - a + 1))
        for i in range(b - a):
            yield code[cut[i] : cut[i + 1]], n[cut[i] : cut[i + 1]]


def ranked(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent codes in order; ties by code."""
    if len(codes) > most:
        least = np.partition(counts, -most)[-most]
        some = counts >= least
        codes, counts = codes[some], counts[some]
    return codes[np.lexsort((codes, -counts))][:most]


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", profile: int = PROFILE) -> dict[str, list[int]]:
    """A profile for each non-null language of `docs`, from all its rows.

    The driver holds `profile` integers a language. Defined cases: null texts
    and languages teach nothing; repeated rows count each; a language whose texts
    have no letter has no profile; an empty table gives no profiles.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: defaultdict[str, Counter] = defaultdict(Counter)

        def out() -> pa.RecordBatch:
            rows = [(lang, code, n) for lang, c in sums.items() for code, n in c.items()]
            cols = zip(*rows, strict=True) if rows else ([], [], [])
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["lang", "code", "n"])

        for b in batches:
            by_lang = sorted(zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True), key=lambda x: x[0])
            names = sorted({x[0] for x in by_lang})
            number = {x: i for i, x in enumerate(names)}
            for i, j in _parts([t for _, t in by_lang]):
                group, codes, counts = count_grams([t for _, t in by_lang[i:j]], [number[x] for x, _ in by_lang[i:j]])
                for g, k, n in zip(group.tolist(), codes.tolist(), counts.tolist(), strict=True):
                    sums[names[g]][k] += n
            if sum(map(len, sums.values())) > 500_000:
                yield out()
        yield out()

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sums = checkpoint(rows.mapInArrow(counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")))
    top = sums.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= profile)
    out: dict[str, list[int]] = defaultdict(list)
    for r in sorted(top.select("lang", "rank", "code").collect()):  # `profile` rows a language
        out[r.lang].append(r.code)
    return dict(out)


class Profiles:
    """Ranks of all profiles' n-grams as one matrix."""

    def __init__(self, profiles: dict[str, list[int]], most: int) -> None:
        self.langs = sorted(profiles)
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
        self.most = most  # n-grams of the longest of all profiles
        self.rank = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.codes, np.array(profiles[lang], np.int64)), j] = np.arange(len(profiles[lang]))

    def distances(self, mine: np.ndarray) -> np.ndarray:
        """Out-of-place distance of ranked codes to each language."""
        at = np.searchsorted(self.codes, mine)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == mine[known]
        rank = self.rank[np.where(known, at, len(self.codes))]
        return np.where(rank < 0, self.most, np.minimum(np.abs(rank - np.arange(len(mine))[:, None]), self.most)).sum(axis=0)


def predict(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", out: str = "language", document: int = DOCUMENT, keep_text: bool = True, languages: int = LANGUAGES) -> DataFrame:
    """Adds the struct column `out`: lang, score.

    score: 1 - distance / the largest distance possible (0 to 1). Defined cases:
    a null text, one without a letter, or no profiles: (`und`, 0.0). Of
    languages at equal distance, the first by name. Only the text is looked at:
    repeated rows get the same, other columns pass unchanged, a column named like
    `out` is replaced. An empty table gives no rows.
    """
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])
    field = T.StructField(out, T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    names, most = sorted(profiles), max(map(len, profiles.values()), default=0)
    blocks = [names[i : i + languages] for i in range(0, len(names), languages)] or [[]]
    for k, block in enumerate(blocks):
        sent = docs.sparkSession.sparkContext.broadcast({x: profiles[x] for x in block})  # languages * PROFILE integers at most

        def make(sent=sent, first=k == 0):
            known = Profiles(sent.value, most)

            def one(codes: np.ndarray, counts: np.ndarray, was: dict | None) -> dict:
                if not len(codes) or not known.langs:
                    return {"lang": UNKNOWN, "score": 0.0}
                mine = ranked(codes, counts, document)
                d = known.distances(mine)
                k = int(d.argmin())
                found = {"lang": known.langs[k], "score": 1 - float(d[k]) / (known.most * len(mine))}
                return found if was is None or found["score"] > was["score"] else was

            def batch(b: pa.RecordBatch) -> list[pa.Array]:
                was = [None] * b.num_rows if first else b.column(out).to_pylist()
                return [pa.array([one(*x, y) for x, y in zip(grams_of_each([t or "" for t in b.column(text_col).to_pylist()]), was, strict=True)], kind)]

            return batch

        docs = add_columns(docs, [field], make, () if keep_text or k < len(blocks) - 1 else (text_col,))
    return docs


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from training: CRC-32 of the id as text leaves 2 when divided by 4."""
    return crc32_of_id(F.col(id_col)) % 4 == 2
