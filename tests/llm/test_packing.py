"""Token ids of the chunk tokenizer against direct encoding."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loomwright.llm import packing, queries

PIECES = "a B é İ i̇ , . 's ' \u0301 ß ς Σ ก า 漢 字 1 ² ½ <|endoftext|> <| ẖ H̱ Ǆ ﬁ 😀 the ING TEŞEKKÜRLERİ. BİZİ, KK x's, 12. don't. \u0345 ΑΣ. Ⅳ. ª, ...".split() + [" ", " ", " ", "\n", "\t", "\xa0", "\u3000", "\x1c", "\r", "\x0b", "\u2028"]


def same(texts, tokenizer, direct):
    ids, stops = tokenizer.ids(pa.array(texts, pa.string()))
    first = 0
    for t, stop in zip(texts, stops.tolist(), strict=True):
        assert ids[first:stop].tolist() == direct.encode(t, add_special_tokens=False).ids, repr(t)
        first = stop


@pytest.mark.parametrize("cache", [0, packing.CACHE_BYTES])
def test_ids_are_those_of_direct_encoding(monkeypatch, cache):
    monkeypatch.setattr(packing, "CACHE_BYTES", cache)
    rng = random.Random(11)
    path = queries.tokenizer_path()
    tokenizer, direct = packing.ChunkTokenizer(path), Tokenizer.from_file(path)
    for _ in range(20):
        same(["".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 3, 10, 40]))) for _ in range(300)], tokenizer, direct)
    same(["TEŞEKKÜRLERİ. BİZİ, SENİ.", "ภาษาไทย" * 3000, "漢字。" * 2000 + "\n" + "漢字", "", "a" * 5000 + ",", "x. " * 5000], tokenizer, direct)


def test_slices_hold_all_rows(monkeypatch):
    monkeypatch.setattr(packing, "SLICE_BYTES", 10)
    texts = pa.array(["", "x" * 25, "ab", "", "cdefghijklmn", ""])
    runs = list(packing._slices(texts))
    assert runs[0][0] == 0 and runs[-1][1] == len(texts) and all(a[1] == b[0] for a, b in zip(runs, runs[1:]))
    assert list(packing._slices(pa.array([], pa.string()))) == []


def test_remembered_parts_take_little_memory():
    rng, n = random.Random(5), 60_000
    words = list({"".join(rng.choices("abcdefghij", k=10)) for _ in range(n)})
    tokenizer = packing.ChunkTokenizer(queries.tokenizer_path())
    tokenizer.ids(pa.array(["a warm start"]))
    arrow = pa.total_allocated_bytes()
    tracemalloc.start()
    for i in range(0, len(words), 10_000):
        tokenizer.ids(pa.array([" ".join(words[i : i + 10_000])]))
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert len(tokenizer.now) > 0.9 * n and held < 100 * n


def test_memory_limit_forgets_the_older_half(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 2000)
    path = queries.tokenizer_path()
    tokenizer, direct = packing.ChunkTokenizer(path), Tokenizer.from_file(path)
    rng = random.Random(6)
    for k in range(40):
        same([" ".join(f"w{rng.randrange(10 * k + 20)}x" for _ in range(30)) + " " + "long" * 100], tokenizer, direct)
        assert tokenizer.now.n_bytes < 2000 + 5000 and max(map(len, tokenizer.now.names.to_pylist())) <= packing.LONGEST_KEPT
    assert len(tokenizer.before)
