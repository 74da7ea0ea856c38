"""SimHash near-dedup with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. A segment is a
word of the perfect binary Golay code [23, 12, 7]; decoding it and its
neighbours at one flipped bit gives at most 6 codeword indices, and two
segments with at most 2 unlike bits share one of them. At most 4 unlike bits
fall on the segments in one of two ways:

* a segment has none: of the other two, one has at most 2, so the fingerprints
  share that segment and an index of one of the others;
* every segment has one: two segments have exactly 1 and the third at most 2,
  so the fingerprints share a triple of indices. For 1 unlike bit, a segment's
  own index and its lesser neighbours' are enough: one of both owns the least.

So every link is found (no candidate is left out), by keys of 33 to 36 bits.
Keys are computed for distinct fingerprints only: a group of exact copies is one
fingerprint. The keyed fingerprints are sorted by key, and each bucket yields a
spanning forest of its true links (at most 4 unlike bits), never all its pairs.
A bucket is held as 8 bytes a distinct fingerprint (80 MB for ten million).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, checkpoint, fresh, utf8
from .components import components

SEED, SHINGLE, MAX_BITS = 42, 4, 4
#: (first bit, bits) of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, the generator of the Golay code.
_GENERATOR = 0b101011100011
#: At most so many indices has a segment.
_MOST = 6
#: Up to this many fingerprints in a bucket, all its pairs are compared at once.
_SMALL = 24
_LANES = np.uint64(0x0101010101010101)


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= _GENERATOR << bit - 11
    return word


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the upper 12 bits, and the error of each remainder (3 bits at most: the code is perfect)."""
    upper = np.array([_remainder(x << 11) for x in range(4096)], np.uint32)
    error = np.zeros(2048, np.uint32)
    for n in (1, 2, 3):
        for bits in combinations(range(23), n):
            e = sum(1 << b for b in bits)
            error[_remainder(e)] = e
    return upper, error


_UPPER, _ERROR = _tables()


def golay_index(words: np.ndarray) -> np.ndarray:
    """Number (12 bits) of the codeword nearest to each 23-bit word."""
    return (words ^ _ERROR[_UPPER[words >> 11] ^ (words & 2047)]) >> 11


def nearby_indices(segment: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices (n, 6) of each segment and its neighbours; which of them are there; which are for 1 unlike bit."""
    flips = np.array([0, *(1 << b for b in range(bits))], np.uint32)
    index = np.sort(golay_index(segment.astype(np.uint32)[:, None] ^ flips).astype(np.int64), axis=1)
    index[:, 1:][index[:, 1:] == index[:, :-1]] = 1 << 40
    index = np.sort(index, axis=1)[:, :_MOST]
    there = index < 1 << 40
    own = golay_index(segment.astype(np.uint32)).astype(np.int64)[:, None]
    return index, there, there & (index <= own)


def bucket_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of uint64 fingerprints."""
    segments = [(prints >> np.uint64(at)) & np.uint64((1 << bits) - 1) for at, bits in SEGMENTS]
    found = [nearby_indices(s, bits) for s, (_, bits) in zip(segments, SEGMENTS, strict=True)]
    rows, keys = [], []
    for n, (k, j) in enumerate(permutations(range(3), 2), 1):
        index, there, _ = found[j]
        at = np.nonzero(there)
        rows.append(at[0])
        keys.append(segments[k].astype(np.int64)[at[0]] << 12 | index[at] | n << 40)
    (a, ta, sa), (b, tb, sb), (c, tc, sc) = (
        tuple(x.reshape(len(prints), *(_MOST if j == k else 1 for j in range(3))) for x in found[k]) for k in range(3)
    )
    use = ta & tb & tc & ((sa & sb) | (sa & sc) | (sb & sc))
    triple = np.nonzero(use)
    rows.append(triple[0])
    keys.append(((a << 24) | (b << 12) | c)[triple])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of UTF-8 text; 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()  # bytes: A-Z only, and exactly [\x20\x09-\x0D]
    if not words:
        return 0
    joined = b" ".join(words)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    width = min(shingle, len(words))
    h = np.array([xxh64_intdigest(joined[i : j - 1], SEED) for i, j in zip(starts, starts[width:])], np.uint64)
    n, count = len(h), np.zeros((8, 8), np.int64)
    if n % 255:
        h = np.concatenate([h, np.zeros(-n % 255, np.uint64)]) if n > 255 else h
    h = h.reshape(-1, min(len(h), 255))
    for k in range(8):  # eight counters of a byte each in a lane
        lanes = ((h >> np.uint64(k)) & _LANES).sum(axis=1, dtype=np.uint64)
        count[k] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    most = 2 * count > n  # [bit % 8, bit // 8]
    return int.from_bytes(np.packbits(most.T, axis=1, bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint", keep_text: bool = True) -> DataFrame:
    """Adds the fingerprint as a (signed) long."""

    def make():
        def batch(b: pa.RecordBatch) -> list[pa.Array]:
            prints = np.array([fingerprint(t) for t in utf8(b.column(text_col))], np.uint64)
            return [pa.array(prints.view(np.int64))]

        return batch

    return add_columns(docs, [T.StructField(out, T.LongType())], make, () if keep_text else (text_col,))


def _spanning(members: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    rest = members
    while len(rest):
        front, rest = [rest[:1]], rest[1:]
        while front and len(rest):
            block = front.pop()
            step = max(1, 4_000_000 // len(rest))
            if len(block) > step:
                front.append(block[step:])
                block = block[:step]
            near = np.bitwise_count(block[:, None] ^ rest[None, :]) <= MAX_BITS
            hit = near.any(axis=0)
            if hit.any():
                yield block[near.argmax(axis=0)[hit]], rest[hit]
                front.append(rest[hit])
                rest = rest[~hit]


def _links(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the buckets of rows sorted by key."""
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(start, len(keys)))
    u, v = [], []
    small = np.repeat((size > 1) & (size <= _SMALL), size)
    k, p = keys[small], prints[small]
    for lag in range(1, min(_SMALL, len(k))):
        near = (k[lag:] == k[:-lag]) & (np.bitwise_count(p[lag:] ^ p[:-lag]) <= MAX_BITS)
        if near.any():
            u.append(p[lag:][near])
            v.append(p[:-lag][near])
        if not (k[lag:] == k[:-lag]).any():
            break
    for i in np.flatnonzero(size > _SMALL):
        for a, b in _spanning(prints[start[i] : start[i] + size[i]]):
            u.append(a)
            v.append(b)
    if not u:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pairs = np.unique(np.stack([np.concatenate(u).view(np.int64), np.concatenate(v).view(np.int64)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _edges_of_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []  # the last bucket so far

    def flush():
        k, p = (np.concatenate(x) for x in zip(*held, strict=True))
        u, v = _links(k, p)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for b in batches:
        k, p = b.column("key").to_numpy(), b.column("print").to_numpy().view(np.uint64)
        if not len(k):
            continue
        cut = int(np.searchsorted(k, k[-1]))  # where the batch's last bucket begins
        if cut:
            held.append((k[:cut], p[:cut]))
            yield flush()
            held = []
        elif held and held[-1][0][-1] != k[-1]:
            yield flush()
            held = []
        held.append((k[cut:], p[cut:]))
    if held:
        yield flush()


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """prints: (print long), distinct. Returns edges (u, v) that connect what links connect."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_prints = b.column("print").to_numpy().view(np.uint64)
            for i in range(0, len(all_prints), 4096):
                part = all_prints[i : i + 4096]
                rows, keys = bucket_keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows].view(np.int64))], names=["key", "print"])

    keyed = prints.mapInArrow(spread, "key long, print long")
    return keyed.repartition("key").sortWithinPartitions("key", "print").mapInArrow(_edges_of_sorted, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint long, component_id): component_id is the smallest id reachable over links.

    Defined cases: a null text, like a text without words, has fingerprint 0 and
    links like any other. Copies share a fingerprint and so a component. Rows of
    a null id take part in linking; a component of null ids only has a null
    component_id. Repeated rows stay. An empty table gives no rows.
    """
    prints = with_fingerprints(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text", "print", keep_text=False)
    return components_of(checkpoint(prints), "_id").withColumnRenamed("_id", id_col).withColumnRenamed("print", "fingerprint")


def components_of(prints: DataFrame, id_col: str) -> DataFrame:
    """Adds component_id to rows with (id, print)."""
    first = prints.groupBy("print").agg(F.min(id_col).alias("_first"))
    roots = components(fingerprint_links(first.select("print")))
    rooted = first.join(roots, F.col("print") == F.col("node"), "left").select("print", F.coalesce("root", "print").alias("_root"), "_first")
    # Stored, so that the join has plain shuffles on both sides and a large component is split among tasks.
    least = checkpoint(rooted.groupBy("_root").agg(F.min("_first").alias("component_id")))
    return prints.join(rooted.join(least, "_root").select("print", "component_id"), "print")


def hex_of(fingerprint_col: str = "fingerprint") -> Column:
    return F.lower(F.lpad(F.hex(fingerprint_col), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays, that of its smallest id; columns as in `docs`.

    Of rows with the same smallest id, the least by text hash stays, and of rows
    alike in both, one. Rows are matched by (id, hash of the text). Defined cases:
    null and wordless texts are near-duplicates of each other; a component of
    null ids only keeps one row; columns of `docs` may have any names; an empty
    table stays empty.
    """
    mark, ki, km = fresh(docs, 3)
    hashed = F.xxhash64(F.lit(3), F.col(text_col))
    prints = with_fingerprints(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), hashed.alias("_mark")), "_text", "print", keep_text=False)
    prints = checkpoint(prints)
    linked = components_of(prints.select("_id", "_mark", "print"), "_id")
    # A component without ids has the null component_id; it then goes by its root's text hash.
    rooted = linked.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("print")).alias("_alone")).agg(
        F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_mark").alias("m"))).alias("_k")
    )
    kept = rooted.select(F.col("_k.i").alias(ki), F.col("_k.m").alias(km)).distinct()
    out = docs.withColumn(mark, hashed).join(kept, F.col(id_col).eqNullSafe(F.col(ki)) & (F.col(mark) == F.col(km)), "left_semi")
    if prints.groupBy("_id", "_mark").count().where("count > 1").limit(1).count():  # repeated rows
        out = out.dropDuplicates([id_col, mark])
    return out.drop(mark)
