"""Best-fit packing by exact complements.

Documents are tokenized and only those over the length of a sequence are cut.
What fits together depends on lengths alone, and there are no more lengths than
tokens in a sequence: the plan is made from the histogram of lengths, whatever
the number of documents. Lengths are taken from the longest down; the gap it
leaves is looked up among single lengths, sums of two and sums of three that
are still available, and such combinations are used up as often as the counts
allow. What finds no exact complement is placed best-fit decreasing.

A plan's row says that pieces of a length, from one rank to another, go to
consecutive sequences at an offset. Ranks are counted in the cluster, by length
and hash bucket, so no length is gathered into one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint

CAPACITY, END_ID = 2048, 0
#: Bytes of texts whose ids are in memory at once (and at least one text).
SLICE_BYTES = 2_000_000
#: Bytes of parts and ids that a Python worker remembers (some 40 a part), twice over: when full, the older half goes.
CACHE_BYTES = 10_000_000
#: Longer chunks (lines of a script without spaces) are not remembered.
LONGEST_KEPT = 200
#: At the end of a token that ends a word.
WORD_END = "</w>"


class _Known:
    """Distinct parts and their ids in arrays: the runs of ids, of `size` each, follow one another."""

    def __init__(self, names: pa.Array | None = None, ids: np.ndarray | None = None, size: np.ndarray | None = None) -> None:
        self.names = pa.array([], pa.large_string()) if names is None else names
        self.ids = np.empty(0, "<u4") if ids is None else ids
        self.size = np.empty(0, np.int64) if size is None else size

    def __len__(self) -> int:
        return len(self.size)

    @property
    def n_bytes(self) -> int:
        return self.names.nbytes + self.ids.nbytes + self.size.nbytes

    def find(self, parts: pa.Array) -> np.ndarray:
        """Each part's place, or -1."""
        return pc.index_in(parts, value_set=self.names).fill_null(-1).to_numpy().astype(np.int64)

    def only(self, use: np.ndarray) -> _Known:
        return self if use.all() else _Known(self.names.filter(pa.array(use)), self.ids[np.repeat(use, self.size)], self.size[use])

    def at(self, places: np.ndarray) -> _Known:
        return _Known(self.names.take(pa.array(places)), _gather(self.ids, self.size, places)[0], self.size[places])

    def __add__(self, other: _Known) -> _Known:
        return _Known(pa.concat_arrays([self.names, other.names]), np.concatenate([self.ids, other.ids]), np.concatenate([self.size, other.size]))


class ChunkTokenizer:
    """Ids of texts by a tokenizer for which ids never span a space or line break.

    Its normalizer must lower-case and treat the sides of a space apart, its
    pre-tokenizer must part letters and digits from other characters but for
    contractions, and its tokens must mark the end of a word. The ids of a text
    are then those of its space-separated chunks, and the ids of an ASCII chunk
    those of what comes before its last signs, lower-cased, and of the signs.
    Each distinct part of many texts is looked up or encoded once. Parts and ids
    are kept and put together as arrays: as Python objects, a part would take
    some five times the memory.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.now, self.before = _Known(), _Known()

    def _words(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Encodes words of a-z side by side in one text, and parts the ids at the word ends."""
        for part in _runs(words):
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            yield ids, np.diff(np.flatnonzero(self.ends_word[ids]) + 1, prepend=0)

    def _chunks(self, chunks: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Encodes any chunks side by side in one text, and parts the ids by where they begin."""
        for part in _runs(chunks):
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ends = np.cumsum([len(c) + 1 for c in part])
            yield np.array(e.ids, "<u4"), np.bincount(np.searchsorted(ends, [a for a, _ in e.offsets], side="right"), minlength=len(part))

    def _encoded(self, parts: pa.Array) -> _Known:
        """New parts, words first."""
        is_word = pc.match_substring_regex(parts, "^[a-z]+$")
        out = _Known()
        for names, encode in ((parts.filter(is_word), self._words), (parts.filter(pc.invert(is_word)), self._chunks)):
            ids, size = zip((np.empty(0, "<u4"), np.empty(0, np.int64)), *encode(names.to_pylist()), strict=True)
            found = _Known(names, np.concatenate(ids), np.concatenate(size))
            if len(found) != len(names) or found.size.sum() != len(found.ids):
                raise ValueError("the tokenizer's ids span a space, or don't mark a word's end")
            out += found
        return out

    def _table(self, parts: pa.Array) -> tuple[_Known, np.ndarray]:
        """Distinct parts with their ids, and the place of each of `parts` among them."""
        if self.now.n_bytes > CACHE_BYTES:
            self.now, self.before = _Known(), self.now
        places = self.now.find(parts)
        missing = parts.filter(pa.array(places < 0))
        old = self.before.find(missing)
        more = self.before.at(old[old >= 0]) + self._encoded(missing.filter(pa.array(old < 0)))
        places[places < 0] = len(self.now) + more.find(missing)
        table = self.now + more
        self.now += more.only(pc.less_equal(pc.utf8_length(more.names), LONGEST_KEPT).to_numpy(zero_copy_only=False))
        return table, places

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts, one after another, and where each text's end. No text is null."""
        split = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        chunks = split.flatten().dictionary_encode()
        names = chunks.dictionary
        plain = pc.and_(pc.string_is_ascii(names), pc.invert(pc.match_substring(names, "<|")))  # no special token
        low = pc.if_else(plain, pc.ascii_lower(names), names)
        signs = pc.extract_regex(pc.if_else(plain, low, pa.scalar(None, pa.large_string())), r"(?s)^(?P<head>.*[0-9a-z])(?P<tail>[^0-9a-z]+)$")
        heads = pc.if_else(signs.is_valid(), signs.field("head"), low)
        tails = pc.if_else(signs.is_valid(), signs.field("tail"), "")
        parts = pa.concat_arrays([heads, tails.cast(heads.type)]).dictionary_encode()
        found, places = self._table(parts.dictionary)
        which = places[parts.indices.to_numpy()].reshape(2, -1).T.ravel()  # head and tail of each chunk
        ids, ends = _gather(found.ids, found.size, which)
        ids, ends = _gather(ids, np.diff(ends[1::2], prepend=0), chunks.indices.to_numpy())
        last = split.offsets.to_numpy()[1:] - split.offsets[0].as_py() - 1
        return ids, ends[last]


def _gather(flat: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs `which` of runs of `size` in `flat`, one after another, and where each ends."""
    n = size[which]
    ends = np.cumsum(n)
    at = np.repeat((np.cumsum(size) - size)[which] - ends + n, n) + np.arange(len(n) and ends[-1])
    return flat[at], ends


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> ChunkTokenizer:
    """One in each Python worker, so that a task knows the chunks of those before it."""
    return ChunkTokenizer(path)


def _runs(chunks: list[str]) -> Iterator[list[str]]:
    """Up to 1000 chunks, or a million characters and a chunk, at a time."""
    part, size = [], 0
    for c in chunks:
        part.append(c)
        size += len(c)
        if len(part) == 1000 or size > 1_000_000:
            yield part
            part, size = [], 0
    if part:
        yield part


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs [from, to) of texts of some SLICE_BYTES bytes together."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n
        if size >= SLICE_BYTES or i - start >= 4000:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of n tokens."""
    return [capacity] * (n // capacity) + [n % capacity] * (n % capacity > 0)


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids binary]) of every document, an end id included.

    A null text is empty: its only token is the end id.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    fields = [T.StructField("_id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.BinaryType())] * with_ids

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = _tokenizer(tokenizer_path)
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            texts = b.column("_text")
            for lo, hi in _slices(texts):
                at, out = [], []
                all_ids, stops = tokenizer.ids(texts.slice(lo, hi - lo))
                first = 0
                for i, stop in enumerate(stops.tolist(), lo):
                    ids = all_ids[first:stop].tobytes() + end
                    first = stop
                    for p, s in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[s : s + 4 * capacity]
                        at.append(i)
                        out.append((p, s // 4, len(own) // 4, zlib.crc32(own), own))
                cols = list(zip(*out, strict=True))
                arrays = [b.column("_id").take(pa.array(at, pa.int64()))]
                arrays += [pa.array(c, t) for c, t in zip(cols[: 4 + with_ids], (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, T.StructType(fields))


class Plan:
    """Patterns of lengths and how many sequences have each; rows() places the ranks."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY) -> None:
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for n, c in counts.items():
            self.left[n] = c
        self.patterns: list[tuple[list[tuple[int, int]], int]] = []  # ([(length, times)], sequences)
        self._index()
        self._exact()
        self._best_fit()

    def _index(self) -> None:
        """pairs[s]: the longer lengths of pairs that sum to s; triples[s]: the longest ones of triples.

        Of lengths that are there at the start; what is used up since is left
        out when a sum is looked up. At most capacity ** 2 / 4 entries each.
        """
        there = np.flatnonzero(self.left)
        a, b = (x.ravel() for x in np.meshgrid(there, there, indexing="ij"))
        use = (a >= b) & (a + b < self.capacity)
        self.pairs = self._by_sum(a[use] + b[use], a[use])
        sums = np.array([s for s in range(self.capacity) if len(self.pairs[s])], np.int64)
        a, s = (x.ravel() for x in np.meshgrid(there, sums, indexing="ij"))
        use = (a + s < self.capacity) & (2 * a >= s)
        self.triples = self._by_sum(a[use] + s[use], a[use])

    def _by_sum(self, sums: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        order = np.lexsort((-first, sums))
        return np.split(first[order], np.searchsorted(sums[order], np.arange(1, self.capacity)))

    def _take(self, lengths: list[int]) -> None:
        """As many sequences of just these lengths as there are pieces for."""
        need = {n: lengths.count(n) for n in lengths}
        m = min(int(self.left[n]) // k for n, k in need.items())
        for n, k in need.items():
            self.left[n] -= k * m
        self.patterns.append((sorted(need.items(), reverse=True), m))

    def _pair(self, total: int, held: list[int]) -> tuple[int, int] | None:
        """Of the pairs that sum to `total`, the one with the most pieces beside those held."""
        a = self.pairs[total]
        if not len(a):
            return None
        b = total - a
        left = lambda x: self.left[x] - sum((x == h).astype(np.int64) for h in held)
        enough = np.where(a == b, left(a) // 2, np.minimum(left(a), left(b)))
        k = int(enough.argmax())
        return (int(a[k]), int(b[k])) if enough[k] > 0 else None

    def _triple(self, gap: int, n: int) -> tuple[int, int, int] | None:
        """Of the triples that fill the gap beside one n, one with the longest length that is left."""
        first = self.triples[gap]
        for a in first[self.left[first] > (first == n)].tolist():
            if pair := self._pair(gap - a, [n, a]):
                return a, *pair
        return None

    def _exact(self) -> None:
        """Lengths that no longer combination could use stay behind, so those in the index are at most n."""
        full = self.capacity
        if self.left[full]:
            self._take([full])
        for n in range(full - 1, 0, -1):
            while self.left[n]:
                gap = full - n
                if self.left[gap] > (gap == n):
                    self._take([n, gap])
                elif pair := self._pair(gap, [n]):
                    self._take([n, *pair])
                elif triple := self._triple(gap, n):
                    self._take([n, *triple])
                else:
                    break

    def _best_fit(self) -> None:
        """Best-fit decreasing over what is left, for equal lengths and equal sequences at once."""
        gaps: list[int] = []  # sorted
        open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}

        def put(gap: int, pattern: tuple[tuple[int, int], ...], m: int) -> None:
            if gap not in open_:
                insort(gaps, gap)
            open_.setdefault(gap, []).append((pattern, m))

        for n in range(self.capacity - 1, 0, -1):
            c = int(self.left[n])
            while c:
                k = bisect_left(gaps, n)
                if k == len(gaps):
                    per = self.capacity // n
                    if m := c // per:
                        put(self.capacity - per * n, ((n, per),), m)
                    if c % per:
                        put(self.capacity - c % per * n, ((n, c % per),), 1)
                    break
                gap = gaps[k]
                pattern, m = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap], gaps[k]
                per = min(gap // n, c)
                used = min(m, c // per)
                put(gap - per * n, (*pattern, (n, per)), used)
                if m > used:
                    put(gap, pattern, m - used)
                c -= per * used
            self.left[n] = 0
        for items in open_.values():
            self.patterns += [(list(p), m) for p, m in items]

    @property
    def n_sequences(self) -> int:
        return sum(m for _, m in self.patterns)

    def rows(self) -> np.ndarray:
        """(length, first rank, first sequence, offset) sorted; each row holds to the next first rank."""
        out, used, seq = [], np.zeros(self.capacity + 1, np.int64), 0
        for pattern, m in self.patterns:
            offset = 0
            for n, times in pattern:
                for _ in range(times):
                    out.append((n, int(used[n]), seq, offset))
                    used[n] += m
                    offset += n
            seq += m
        return np.array(sorted(out), np.int64).reshape(-1, 4)


def place(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to stored pieces (with columns _id, piece, length).

    The pieces of a length are ranked in as many hash buckets as a bucket has
    pieces, about: so neither the buckets of a frequent length nor their sums
    meet in one task.
    """
    counts = {int(r["length"]): int(r["n"]) for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
    buckets = F.split(F.lit(",".join(str(max(1, isqrt(counts.get(n, 0)))) for n in range(capacity + 1))), ",").cast("array<bigint>")
    marked = cut_pieces.withColumn("_b", F.pmod(F.xxhash64("_id", "piece", "ids_crc32"), buckets[F.col("length").cast("int")]))
    sums = marked.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("length", "_b", "_before")
    plan = Plan(counts, capacity).rows()
    sent = cut_pieces.sparkSession.sparkContext.broadcast(plan)
    rank = F.row_number().over(Window.partitionBy("length", "_b").orderBy("_id", "piece", "ids_crc32"))
    ranked = marked.withColumn("_rank", rank - 1).join(offsets, ["length", "_b"]).withColumn("_rank", (F.col("_rank") + F.col("_before")).cast("long")).drop("_b", "_before")
    keep = [f for f in ranked.schema.fields if f.name != "_rank"]

    def run(batches):
        rows = sent.value
        key = (rows[:, 0] << 44) + rows[:, 1] if len(rows) else np.empty(0, np.int64)
        for b in batches:
            length, r = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            at = np.searchsorted(key, (length << 44) + r, side="right") - 1
            seq, off = rows[at, 2] + r - rows[at, 1], rows[at, 3]
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in keep] + [pa.array(seq), pa.array(off)], names=[f.name for f in keep] + ["sequence_id", "offset"])

    return ranked.mapInArrow(run, T.StructType([*keep, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces of all rows.

    Defined cases: null and empty texts are one end id; null or repeated ids and
    repeated rows are packed each; an empty table gives no rows; other columns
    of `docs` are ignored. The pieces' places are stored once (texts and ids
    are not), so tokenizing isn't repeated.
    """
    return place(checkpoint(pieces(docs, tokenizer_path, id_col, text_col, capacity)), capacity).withColumnRenamed("_id", id_col)
