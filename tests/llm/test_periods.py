"""Runs of words against a search of every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.llm import periods

WORD = re.compile("[^\x20\x09-\x0d]+")


def runs_of(w, least=24):
    out, n = set(), len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] == w[i + q]:
                j = i
                while j + q < n and w[j] == w[j + q]:
                    j += 1
                size = j - i + q
                part = w[i : i + size]
                if size >= max(least, 3 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.add((i, size, q))
                i = j
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(words, seed):
    n, g = len(words), seed // 10
    if seed % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def sample(rng):
    n, kind = rng.choice([0, 1, 2, 3, 8, 25, 60, 150]), rng.random()
    if kind < 0.4:
        return [rng.randrange(rng.choice([1, 2, 3])) for _ in range(n)]
    if kind < 0.6:  # a Fibonacci word: many nested repetitions
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    unit = [rng.randrange(3) for _ in range(rng.randint(1, 12))]
    return [9] * rng.randrange(3) + unit * rng.randint(1, 9) + [rng.randrange(3) for _ in range(rng.randrange(9))]


@pytest.mark.parametrize("least", [2, 24])
def test_runs(monkeypatch, least):
    monkeypatch.setattr(periods, "LEAST_WORDS", least)
    rng = random.Random(least)
    for _ in range(60):
        texts = [sample(rng) for _ in range(rng.randint(1, 25))]
        for t, got in zip(texts, periods.find_runs([np.array(t, np.int64) for t in texts]), strict=True):
            assert [tuple(r) for r in got.tolist()] == runs_of(t, least), t


def test_few_moves():
    """A position moves some log2(n) times, however many levels there are."""
    words = np.concatenate([np.tile(np.arange(50), 60), [99]])
    r = periods.Refinement(words, np.full(len(words), 1000))
    moves, split = 0, r._split

    def counted(moved, *rest):
        nonlocal moves
        moves += len(moved)
        split(moved, *rest)

    r._split = counted
    assert [tuple(map(int, x)) for x in zip(*r.runs(), strict=True)] == [(0, 3000, 50)] and moves < 12 * len(words)


def test_detect(spark):
    rng = random.Random(4)

    def spelt(numbers):
        names = [f"{rng.choice(['a', 'É', chr(0x1C) + 'b', 'c d', 'e.'])}{x}" for x in range(10)]
        return rng.choice([" ", "\n", "\t "]).join(names[x] for x in numbers)

    texts = [None, "", " \n\t", "x " * 100, "x\x0by\x0c" * 30 + "z", "one two"]
    texts += [spelt(sample(rng)) for _ in range(150)]
    texts += [" ".join(f"w{rng.randrange(900)}" for _ in range(700)) for _ in range(40)] + [texts[3]] * 2
    docs = spark.createDataFrame([(i, t, 5, "c") for i, t in enumerate(texts)] + [(None, "n", 5, "c")], "doc_id long, text string, periods int, `a.b` string")
    seed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    given = docs.select("doc_id", periods.periodic_from("text", seed).alias("text"), "periods", "`a.b`").repartition(3)
    out = periods.detect(given)
    assert out.columns == ["doc_id", "text", "a.b", "periods"]
    with_runs = 0
    for r in out.collect():
        t = "n" if r["doc_id"] is None else texts[r["doc_id"]]
        w = periodic(WORD.findall(t or ""), zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()))
        found = runs_of(w)
        p = r["periods"]
        assert p["n_words"] == len(w) and [tuple(x) for x in p["runs"]] == found
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        text = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert p["collapsed"] == text and p["collapsed_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert p["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        assert p["strongest"] == best or tuple(p["strongest"]) == best
        with_runs += bool(found)
    assert with_runs > 40
    assert periods.detect(docs.limit(0)).count() == 0 and periods.detect(docs, with_text=False).columns == ["doc_id", "a.b", "periods"]
