"""Token ids in binary files: frequency-ranked, byte-aligned codes with separate control bytes.

Ids are counted over all documents, and an id is stored as its rank by frequency
in the least number of whole bytes (1 to 4): the data bytes. How many bytes each
rank has lies apart, 2 bits a rank, four in a control byte. A reader looks up four
lengths at a time in a table of 256 control bytes, so decoding is a few numpy
operations on the bytes of many documents.

A dataset is a folder with three Parquet tables, written by Spark so that any of
its file systems will do and a lost task leaves nothing half-written:

    codes   (id, row, n_tokens, control, data, part, before): a row for each document; part-files ascend by id
    parts   (part, first): ids before each part (a row for each part-file)
    ranks   (rank, token_id, n): the code table, no larger than the vocabulary
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import utf8

_LINES = re.compile("\n+")

END_ID = 0
#: Bytes of texts (and ids) that are worked on together, and at least one text.
SLICE_BYTES = 6_000_000
#: Chunks that a Python worker remembers, twice over: when so many are known, the older half goes.
KEPT_CHUNKS = 250_000
#: Longer chunks are not remembered.
LONGEST_KEPT = 100
#: The lengths (1 to 4) of the four ranks of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
#: ASCII punctuation.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Latin letters, which are letters to every version of Unicode that may be at work.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_WHOLE = re.compile(f"\n?(?:[{LETTERS}]+|[A-Za-z0-9]+)")


class ByteTokenizer:
    """Ids of texts by a byte-level BPE tokenizer (no normalizer, no space put before a text).

    Its pre-tokenizer parts a text before each space that a character other than
    white space follows, and before and after line breaks between such characters.
    So the ids of a text are those of its chunks, one after another: a chunk begins
    with its space (left out in this class) or its line breaks. A chunk of Latin
    letters (or ASCII letters and digits) and then ASCII signs falls apart between
    both. Each distinct part is encoded once for many texts: letters alone by the
    tokenizer's model, as the pre-tokenizer would give them to it whole, others by the
    tokenizer. A text with other white space at the ends of a chunk is encoded directly.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        if any(not (w := t.content.rstrip(SIGNS)) or w.isalnum() for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("an added token of letters and then signs may lie across two parts")
        self.begins = {}
        for first, sign in ((" ", "\u0120"), ("\n", "\u010a")):  # how byte-level tokens show both
            self.begins[first] = np.zeros(max(vocabulary.values()) + 1, bool)
            self.begins[first][[i for t, i in vocabulary.items() if t.startswith(sign)]] = True
        self.words: tuple[dict, dict] = ({}, {})  # to ids: the newer half and the older one
        self.chunks: tuple[dict, dict] = ({}, {})  # those whose words may not fall apart from their signs
        self.tails: dict[str, bytes] = {}
        self.model, (self.line_break,) = self.tokenizer.model, self._direct(["\n"])
        shown = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {ord(c): shown(c)[0][0] for c in map(chr, range(128, 0x250)) if c.isalpha()}

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, parts: list[str], first: str) -> Iterator[bytes]:
        """Ids of parts that begin with their only `first`: encoded in one text, and parted where a token begins so."""
        for lo in range(0, len(parts), 1000):
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(parts[lo : lo + 1000])], add_special_tokens=False)[0].ids, "<u4")
            at, raw = (np.flatnonzero(self.begins[first][ids]) * 4).tolist(), ids.tobytes()
            yield from (raw[a:b] for a, b in zip(at, [*at[1:], len(raw)], strict=True))

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of Latin letters alone behind a space or line break: the pre-tokenizer leaves them whole, so the model reads them at once."""
        tokenize, letters, ids, n = self.model.tokenize, self.letters, [], []
        for w in words:
            shown = w if w.isascii() else w.translate(letters)
            found = tokenize(shown[1:] if shown[0] == "\n" else f"\u0120{shown}")
            ids += [t.id for t in found]
            n.append(len(found) * 4)
        raw, ends = np.array(ids, "<u4").tobytes(), np.cumsum([0, *n]).tolist()
        return [self.line_break + raw[a:z] if w[0] == "\n" else raw[a:z] for w, a, z in zip(words, ends, ends[1:])]

    def _known(self, kept: str, parts: list[str]) -> tuple[list[bytes | None], list[int]]:
        """What is remembered of parts, and which are new."""
        now, before = getattr(self, kept)
        out = list(map(now.get, parts))
        fresh = []
        for i in (i for i, x in enumerate(out) if x is None):
            if (x := before.get(parts[i])) is not None:
                out[i] = now[parts[i]] = x
            else:
                fresh.append(i)
        return out, fresh

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words before their signs; none for what may not fall apart from them."""
        out, fresh = self._known("words", words)
        latin, spaced, lines = [], [], []  # letters alone; with digits: behind a space, and in a line of their own
        for i in fresh:
            w = words[i]
            if len(w) > LONGEST_KEPT or not _WHOLE.fullmatch(w):
                out[i] = b""
            else:
                (latin if w[w[0] == "\n" :].isalpha() else lines if w[0] == "\n" else spaced).append(i)
        for at, ids in ((latin, self._letters([words[i] for i in latin])), (spaced, self._joined([f" {words[i]}" for i in spaced], " ")), (lines, self._joined([words[i] for i in lines], "\n"))):
            for i, x in zip(at, ids, strict=True):
                out[i] = x
        self.words[0].update((words[i], out[i]) for i in fresh if len(words[i]) <= LONGEST_KEPT)
        return out

    def _others(self, chunks: list[str]) -> list[bytes | None]:
        """Ids of chunks, each as a text of its own; None where there is white space at the ends."""
        out, fresh = self._known("chunks", chunks)
        fresh = [i for i in fresh if (c := chunks[i]) and not ((x := c.lstrip("\n")) and (x[0].isspace() or x[-1].isspace()))]
        for i, x in zip(fresh, self._direct([c if c[0] == "\n" else f" {c}" for c in map(chunks.__getitem__, fresh)]), strict=True):
            out[i] = x
        self.chunks[0].update((chunks[i], out[i]) for i in fresh if len(chunks[i]) <= LONGEST_KEPT)
        return out

    def _tails(self, tails: list[str]) -> list[bytes]:
        new = list(set(tails).difference(self.tails))
        self.tails.update(zip(new, self._direct(new), strict=True))
        return [self.tails[t] for t in tails]

    def _chunks(self, chunks: pa.Array) -> list[bytes | None]:
        """Ids of distinct chunks; None where there is white space at the ends."""
        bare, texts = pc.ascii_rtrim(chunks, SIGNS), chunks.to_numpy(zero_copy_only=False)
        words = bare.dictionary_encode()
        word = words.indices.to_numpy()
        found = self._words(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        out = list(map(found.__getitem__, word.tolist()))
        whole = np.fromiter(map(bool, found), bool, len(found))[word]
        signed = np.flatnonzero(whole & (pc.binary_length(bare).to_numpy() < pc.binary_length(chunks).to_numpy()))
        for i, x in zip(signed.tolist(), self._tails([c[k:] for c, k in zip(texts[signed], pc.utf8_length(bare).to_numpy()[signed].tolist(), strict=True)]), strict=True):
            out[i] += x
        rest = np.flatnonzero(~whole)
        for i, x in zip(rest.tolist(), self._others(texts[rest].tolist()), strict=True):
            out[i] = x
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Arrow parts and numbers the chunks of all texts and their words, so that only
        distinct ones are looked up; their ids are put side by side by these numbers.
        """
        self.words, self.chunks = (({}, x[0]) if len(x[0]) > KEPT_CHUNKS else x for x in (self.words, self.chunks))
        if len(self.tails) > KEPT_CHUNKS:
            self.tails = {}
        heads = [(_LINES.sub(r" \g<0>", t) if "\n\n" in t else t.replace("\n", " \n")).partition(" ") for t in texts]  # what comes before the first chunk
        split = pc.split_pattern(pa.array([rest if space else None for _, space, rest in heads], pa.large_string()), " ")
        numbered = split.flatten().dictionary_encode()
        number, found = numbered.indices.to_numpy(), self._chunks(numbered.dictionary)
        bounds = np.concatenate([[0], np.cumsum(split.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        odd = np.fromiter((x is None for x in found), np.int64, len(found))
        found = [x or b"" for x in found]
        first = dict(zip(each := list({h for h, _, _ in heads}), self._direct(each), strict=True))
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        sizes, ids = n[number], np.frombuffer(b"".join(found), "<u4")
        ends = np.concatenate([[0], np.cumsum(sizes)])
        raw = memoryview(ids[np.repeat((np.cumsum(n) - n)[number] - ends[:-1], sizes) + np.arange(ends[-1])]).cast("B")
        at = (ends[bounds] * 4).tolist()
        out = [first[h] + raw[a:z] for (h, _, _), a, z in zip(heads, at, at[1:])]
        with_odd = np.diff(np.concatenate([[0], np.cumsum(odd[number])])[bounds]).tolist()
        direct = [i for i, ((h, _, _), k) in enumerate(zip(heads, with_odd, strict=True)) if k or h[-1:].isspace()]
        for i, x in zip(direct, self._direct([texts[i] for i in direct]), strict=True):
            out[i] = x
        return out


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> ByteTokenizer:
    """One in each Python worker, so that a task knows the chunks of those before it."""
    return ByteTokenizer(path)


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of some SLICE_BYTES together, each with where it begins; a null is empty."""
    part, size, start = [], 0, 0
    for i, t in enumerate(utf8(texts)):
        part.append((t or b"").decode())
        size += len(t or b"")
        if size >= SLICE_BYTES:
            yield start, part
            part, size, start = [], 0, i + 1
    if part:
        yield start, part


def id_type(n: int) -> str:
    """The least type that holds n ids."""
    return "<u2" if n <= 1 << 16 else "<u4"


def token_ids(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, ids, counts) of every document, and a row with the task's counts of all ids.

    ids: little-endian unsigned integers (of id_type()) with the end id; row: any distinct number.
    The last row of a task has neither, but `counts`: 64-bit numbers, one for each id up to the greatest.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("_text"))
    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("row", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("counts", T.BinaryType())]
    names = [f.name for f in fields]

    def run(batches):
        import gc
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer, end, n, kind = _tokenizer(tokenizer_path), np.array([END_ID], "<u4").tobytes(), np.zeros(0, np.int64), None
        stored = id_type(len(tokenizer.begins[" "]))
        gc.disable()  # millions of strings in lists and dicts, and no cycles
        try:
            for b in batches:
                kind = b.schema.field("id").type
                for lo, texts in _slices(b.column("_text")):
                    each = [x + end for x in tokenizer.ids(texts)]
                    flat = np.frombuffer(b"".join(each), "<u4").astype(stored)
                    more = np.bincount(flat, minlength=len(n))
                    more[: len(n)] += n
                    n = more
                    ids = _column(flat.view(np.uint8), np.fromiter(map(len, each), np.int64, len(each)) // 4 * flat.itemsize)
                    yield pa.RecordBatch.from_arrays([b.column("id").slice(lo, len(texts)), b.column("row").slice(lo, len(texts)), ids, pa.nulls(len(texts), pa.binary())], names=names)
        finally:
            gc.enable()
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([n.tobytes()], pa.binary())], names=names)

    return rows.mapInArrow(run, T.StructType(fields))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, one after another, and the size of each; no value is null."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]], np.diff(ends)


def _column(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of values of `sizes`, which stand one after another in `data`."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _places(n: np.ndarray) -> np.ndarray:
    """Where each of the ranks of documents of n ranks is when each document is filled up to whole control bytes."""
    full, ends = -(-n // 4) * 4, np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(np.cumsum(full) - full - ends + n, n)


def encode(ranks: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(control bytes, their number for each document, data bytes, their number) of the ranks of documents of n ranks."""
    size, greatest = np.ones(len(ranks), np.uint8), int(ranks.max(initial=0))
    for k in (8, 16, 24):
        if greatest >= 1 << k:
            size += ranks >= 1 << k
    two_bits = np.zeros(int((-(-n // 4)).sum()) * 4, np.uint8)
    two_bits[_places(n)] = size - 1
    control = (two_bits.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    ends = np.cumsum(size, dtype=np.int64)
    at = ends - size
    data = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    data[at] = ranks & 255
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        if not len(longer):
            break
        data[at[longer] + k] = ranks[longer] >> np.uint32(8 * k) & 255
    bounds = np.concatenate([[0], ends])
    return control, -(-n // 4), data, np.diff(bounds[np.concatenate([[0], np.cumsum(n)])])


def decode(control: np.ndarray, data: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ranks of documents of n ranks, one document after another."""
    size = LENGTHS[control].ravel()[_places(n)]
    at = np.cumsum(size, dtype=np.int64) - size
    ranks = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        if not len(longer):
            break
        ranks[longer] |= data[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def _parts(columns: list[pa.Array], weight: pa.Array) -> Iterator[list[pa.Array]]:
    """Runs of rows of some 2 * SLICE_BYTES bytes (of `weight`) together, so that few arrays are in memory."""
    groups = np.cumsum(weight.to_numpy()) // (2 * SLICE_BYTES)
    cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield [c.slice(a, b - a) for c in columns]


def rank_ids(tokens: DataFrame) -> DataFrame:
    """(rank, token_id, n): the ids found, the most frequent first, of equal ones the least. No more rows than the vocabulary has ids."""

    def explode(batches):
        for b in batches:
            for counts in b.column(0).to_pylist():
                n = np.frombuffer(counts, np.int64)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["token_id", "n"])

    counts = tokens.select("counts").where("counts is not null").mapInArrow(explode, "token_id long, n long").groupBy("token_id").agg(F.sum("n").alias("n"))
    ordered = counts.orderBy(F.desc("n"), "token_id").collect()  # bounded by the vocabulary
    rows = [(k, r["token_id"], r["n"]) for k, r in enumerate(ordered)]
    return tokens.sparkSession.createDataFrame(rows, "rank long, token_id long, n long")


def cuts(tokens: DataFrame, parts: int) -> list:
    """Ids that part the documents into `parts` ranges of about one size, from a bounded sample; they decide on the files' sizes only."""
    some = tokens.select("id", "row").where("row is not null and id is not null").orderBy(F.xxhash64("row")).limit(50 * parts).collect()
    ids = sorted(r["id"] for r in some)
    return [ids[k * len(ids) // parts] for k in range(1, parts)] if ids else []


def _table(ranks: DataFrame) -> np.ndarray:
    """token_id by rank."""
    found = ranks.select("rank", "token_id").orderBy("rank").toArrow()
    return found.column("token_id").to_numpy().astype(np.uint32)


def write(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every document and stores the dataset in `folder`, which all executors share; what is there is replaced.

    Documents ascend by id. Defined cases: a null text is empty (its only token is
    the end id); null ids come first; rows with one id stay apart, in the order of
    their place in the input; an empty table gives an empty dataset; other columns
    are ignored. A document of any length is one row, encoded in slices of documents;
    its ids are in a worker's memory at once.
    """
    spark, packed = docs.sparkSession, {"compression": "zstd"}
    stored = id_type(len(_tokenizer(tokenizer_path).begins[" "]))
    token_ids(docs, tokenizer_path, id_col, text_col).write.mode("overwrite").options(**packed).parquet(f"{folder}/_tokens")
    tokens = spark.read.parquet(f"{folder}/_tokens")
    ranks, n_parts = rank_ids(tokens), int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = cuts(tokens, n_parts)
    ranks.coalesce(1).write.mode("overwrite").parquet(f"{folder}/ranks")
    ids = _table(ranks)
    rank_of = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
    rank_of[ids] = np.arange(len(ids), dtype=np.uint32)
    sent = spark.sparkContext.broadcast(rank_of)  # 4 bytes for each id of the vocabulary
    kind = tokens.schema["id"]

    def part_of(id_, row: int) -> int:
        """By the bounds; an id that is several of them (or null) is spread over all its parts."""
        first = bisect_left(bounds, id_) if id_ is not None else 0
        last = bisect_right(bounds, id_) if id_ is not None else 0
        return first + (row * 2654435761 >> 16) % (last - first + 1) if last > first else first

    def pack(batches):
        for b in batches:
            for id_, row, raw in _parts(b.columns, pc.binary_length(b.column(2))):
                flat, size = _bytes_of(raw)
                n = size // np.dtype(stored).itemsize
                control, n_control, data, n_data = encode(sent.value[flat.view(stored)], n)
                parts = pa.array(map(part_of, id_.to_pylist(), row.to_pylist()), pa.int32())
                yield pa.RecordBatch.from_arrays([id_, row, pa.array(n), _column(control, n_control), _column(data, n_data), parts], names=names)

    def place(batches):
        before = 0
        for b in batches:
            n = b.column(2).to_numpy()
            starts = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(starts)], names=[*names, "before"])

    fields = [tokens.schema["id"], *(T.StructField(c, t) for c, t in (("row", T.LongType()), ("n_tokens", T.LongType()), ("control", T.BinaryType()), ("data", T.BinaryType()), ("part", T.IntegerType())))]
    names = [f.name for f in fields]
    packed_rows = tokens.where("row is not null").select("id", "row", "ids").mapInArrow(pack, T.StructType(fields))
    codes = packed_rows.repartitionById(n_parts, F.col("part")).sortWithinPartitions("part", "id", "row")
    codes.mapInArrow(place, T.StructType([*fields, T.StructField("before", T.LongType())])).write.mode("overwrite").options(**packed).parquet(f"{folder}/codes")
    sums = spark.read.parquet(f"{folder}/codes").groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row for each part-file
    first = np.concatenate([[0], np.cumsum([r["n"] for r in sums])]).tolist()
    spark.createDataFrame([(r["part"], f) for r, f in zip(sums, first)], "part int, first long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/parts")
    remove(spark, f"{folder}/_tokens")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of one's own in a file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of every document of a stored dataset; start: the ids of all documents before it."""
    sent = spark.sparkContext.broadcast(_table(spark.read.parquet(f"{folder}/ranks")))
    codes = spark.read.parquet(f"{folder}/codes")
    rows = codes.join(spark.read.parquet(f"{folder}/parts"), "part").select("id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "control", "data")
    fields = [codes.schema["id"], *(T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32"))] + [T.StructField("ids", T.BinaryType())] * with_ids

    def run(batches):
        for b in batches:
            for id_, start, n, control, data in _parts(b.columns, pc.multiply(b.column(2), 4)):
                ids = sent.value[decode(_bytes_of(control)[0], _bytes_of(data)[0], n.to_numpy())].astype("<u4", copy=False)
                raw, ends = memoryview(ids).cast("B"), (np.cumsum(n.to_numpy()) * 4).tolist()
                each = [raw[a:z] for a, z in zip([0, *ends], ends)]
                columns = [id_, start, n, pa.array(list(map(zlib.crc32, each)), pa.int64()), *([pa.array(list(map(bytes, each)), pa.binary())] if with_ids else [])]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields))
