"""Token files: ids against direct encoding, codes and whole datasets as round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loomwright.llm import tokenfile

from .test_brute_force import texts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = "a B é İ i̇ , . 's ' 'll ́ ß ς Σ ก า 漢 字 1 ² ½ <|endoftext|> <| |> 😀 the ING don't. x's, 12. Ⅳ. ª, ... ” “".split() + [" ", " ", " ", "  ", "\n", "\n", "\n\n", "\t", "\xa0", "　", "\x1c", "\r", "\x0b", "\x85"]


@pytest.mark.parametrize("kept", [5, tokenfile.KEPT_CHUNKS])
def test_ids_are_those_of_direct_encoding(monkeypatch, kept):
    monkeypatch.setattr(tokenfile, "KEPT_CHUNKS", kept)
    rng, tokenizer, direct = random.Random(5), tokenfile.ByteTokenizer(PATH), Tokenizer.from_file(PATH)
    for _ in range(25):
        some = ["".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 3, 10, 40]))) for _ in range(300)]
        for t, got in zip(some, tokenizer.ids(some), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == direct.encode(t, add_special_tokens=False).ids, repr(t)
    long = ["ภาษาไทย" * 3000, "漢字。" * 2000 + "\n" + "漢字", "a" * 5000 + ",", "x. " * 5000, "\n" * 3000, "x\n\ny " * 2000]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokenizer.ids(long)] == [direct.encode(t, add_special_tokens=False).ids for t in long]


def test_codes():
    rng = random.Random(6)
    for _ in range(200):
        n = np.array([rng.choice([1, 2, 3, 4, 5, 9, 100]) for _ in range(rng.randint(0, 20))], np.int64)
        ranks = np.array([rng.choice([0, 5, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1]) for _ in range(n.sum())], np.uint32)
        control, n_control, data, n_data = tokenfile.encode(ranks, n)
        assert n_control.sum() == len(control) == sum(-(-n // 4)) and n_data.sum() == len(data)
        assert len(data) == sum(1 if r < 1 << 8 else 2 if r < 1 << 16 else 3 if r < 1 << 24 else 4 for r in ranks.tolist())
        assert (tokenfile.decode(control, data, n) == ranks).all()


def test_dataset(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "SLICE_BYTES", 5000)
    data = [(i, t) for i, t in enumerate(texts())] + [(9, "again"), (9, "again"), (None, "none"), (None, None), (-5, "first")]
    random.Random(1).shuffle(data)
    docs = spark.createDataFrame([(i, t, b"x", 1, 2) for i, t in data], "doc_id long, text string, data binary, id int, part int").repartition(6)
    for name in ("one", "two"):  # a second dataset in the same folder replaces the first
        tokenfile.write(docs if name == "two" else docs.limit(3), PATH, f"{tmp_path}/set")
    got = sorted(tokenfile.read(spark, f"{tmp_path}/set").collect(), key=lambda r: r["start"])
    direct = Tokenizer.from_file(PATH)
    ids = lambda t: np.array([*direct.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
    want = sorted(((i, ids(t)) for i, t in data), key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted((str(r["id"]), bytes(r["ids"])) for r in got) == sorted((str(i), x) for i, x in want)
    assert [r["id"] for r in got] == [i for i, _ in want]
    start = 0
    for r in got:
        assert r["start"] == start and r["n_tokens"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        start += r["n_tokens"]
    ranks = spark.read.parquet(f"{tmp_path}/set/ranks").orderBy("rank").collect()
    every = np.concatenate([np.frombuffer(x, "<u4") for _, x in want])
    assert [r["n"] for r in ranks] == sorted(np.unique(every, return_counts=True)[1].tolist(), reverse=True)
    # part-files ascend by id
    parts = spark.read.parquet(f"{tmp_path}/set/codes").groupBy("part").agg({"id": "max"}).orderBy("part").collect()
    tops = [r[1] for r in parts if r[1] is not None]
    assert tops == sorted(tops)
    tokenfile.write(docs.limit(0), PATH, f"{tmp_path}/none")
    assert tokenfile.read(spark, f"{tmp_path}/none").count() == 0


def test_column_bytes():
    flat, size = tokenfile._bytes_of(pa.array([b"ab", b"", b"cde"], pa.binary()))
    assert bytes(flat) == b"abcde" and size.tolist() == [2, 0, 3]
    assert tokenfile._column(flat, size).to_pylist() == [b"ab", b"", b"cde"]


def test_column_bytes_of_slices():
    flat, size = tokenfile._bytes_of(pa.array([b"ab", b"", b"cde", b"f"], pa.binary()).slice(1, 2))
    assert bytes(flat) == b"cde" and size.tolist() == [0, 3]
    flat, size = tokenfile._bytes_of(pa.array([], pa.binary()))
    assert not len(flat) and not len(size)


def test_distinct_words_are_read_once():
    """A word behind a space is read once, whatever signs follow it; no chunk of letters goes to the whole tokenizer."""
    tokenizer, direct = tokenfile.ByteTokenizer(PATH), Tokenizer.from_file(PATH)
    texts = ["x größe größe, größe. (größe) größe!? GRÖSSE\nñandú ñandú. a1 a1; ªº º' don't größe's ÆØ×÷ß"] * 3
    read, whole = [], []
    tokenizer._letters = lambda words, of=tokenizer._letters: read.extend(words) or of(words)
    tokenizer._direct = lambda some, of=tokenizer._direct: whole.extend(some) or of(some)
    for t, got in zip(texts, tokenizer.ids(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == direct.encode(t, add_special_tokens=False).ids
    assert sorted(read) == sorted(["größe", "GRÖSSE", "\nñandú", "ñandú", "ªº", "º"])
    assert sorted(whole) == sorted(["x", ",", ".", "!?", ";", "'", " (größe)", " don't", " größe's", " ÆØ×÷ß"])
    assert tokenizer.ids(texts) and len(read) == 6
