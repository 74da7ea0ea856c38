"""The Kneser-Ney model and its scores against a plain version on strings."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomwright.llm import lm_quality as lm

VERSES = ["the cat sat on a mat and slept", "my dog ran to the old barn at dawn", "кот спал на тёплой печи всю ночь", "we sold two of his red boats last year", "漢字 と 仮名 の 文 です", "x\0y \U0001F600 z"]


class Plain:
    """Interpolated modified Kneser-Ney over strings; "\1" stands before a text (no test text has it)."""

    def __init__(self, texts):
        self.seen = [Counter() for _ in range(lm.ORDER + 1)]  # of each order, in the text
        for t in texts:
            for g, n in grams(t).items():
                for k in range(1, lm.ORDER + 1):
                    self.seen[k][g[-k:]] += n
        count = [None] * (lm.ORDER + 1)
        count[lm.ORDER] = self.seen[lm.ORDER]
        for k in range(lm.ORDER - 1, 0, -1):
            count[k] = Counter(g[1:] for g in count[k + 1])
        self.p, self.back = [{} for _ in count], [{} for _ in count]
        for k in range(1, lm.ORDER + 1):
            r = Counter(min(n, 5) for n in count[k].values())
            y = r[1] / (r[1] + 2 * r[2]) if r[1] else 0.5
            raw = [(r[1], 1 - 2 * y * r[2] / max(r[1], 1)), (r[2], 2 - 3 * y * r[3] / max(r[2], 1)), (r[3], 3 - 4 * y * r[4] / max(r[3], 1))]
            d = [min(max(x, 0.05), i - 0.05) if there else 0.5 * i for i, (there, x) in enumerate(raw, 1)]
            total, off = defaultdict(int), defaultdict(float)
            for g, n in count[k].items():
                total[g[:-1]] += n
                off[g[:-1]] += d[min(n, 3) - 1]
            for g, n in count[k].items():
                c = g[:-1]
                lower = self.p[k - 1][g[1:]] if k > 1 else 1 / (len(count[1]) + 1)
                self.p[k][g] = (n - d[min(n, 3) - 1] + off[c] * lower) / total[c]
            for c in total:
                self.back[k - 1][c] = off[c] / total[c]
        self.unseen = self.back[0][""] / (len(count[1]) + 1) if texts else 1.0

    def log(self, g, least=0):
        out = 0.0
        for k in range(lm.ORDER, 0, -1):
            if self.seen[k][g[-k:]] > least:
                return out + math.log(self.p[k][g[-k:]])
            if k > 1:
                out += math.log(self.back[k - 1].get(g[-k:-1], 1.0))
        return out + math.log(self.unseen)


def grams(text):
    t = "\1" * (lm.ORDER - 1) + " ".join(text.lower().split())
    return Counter(t[i : i + lm.ORDER] for i in range(len(t) - lm.ORDER + 1))


def made(rng, n=6):
    return " ".join(rng.choice(VERSES) for _ in range(n))


@pytest.fixture(scope="module")
def case():
    rng = random.Random(5)
    texts = [made(rng, rng.randint(1, 8)) for _ in range(90)]
    texts += [" ".join(rng.sample(t.split(), len(t.split()))) for t in texts[:5]] + ["zqx jjw kkv " * 20, "", None, " \n", "İ" * 30]
    return [(i, t, ["en", "ru", None][i % 3], "clash", 1.5) for i, t in enumerate(texts)], list(range(60))


@pytest.mark.parametrize("broadcast", [0, 10**9])
def test_scores(spark, case, broadcast):
    """Both sides of the broadcast switches, with columns of the names used inside, repeated rows and repeated labels."""
    rows, good = case
    rows = [*rows, rows[3], rows[3], (None, "null id the cat", "en", "c", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, limit string, log_perplexity double").withColumnRenamed("limit", "_good")
    labels = spark.createDataFrame([(i, 1, 0) for i in good] + [(1, 1, 0), (70, 1, 1), (71, 0, 0), (72, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = lm.classify(docs, labels, broadcast_ids=broadcast, model_rows=broadcast).collect()
    assert len(got) == len(rows)
    used = [r for r in rows if r[0] in set(good)]
    plain = Plain([r[1] for r in used])
    for r, (i, t, *_) in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"])), sorted(rows, key=lambda r: (r[0] is None, r[0]))):
        g = grams(t or "")
        if not g:
            assert r["log_perplexity"] is None and not r["kept"]
            continue
        times = sum(x[0] == i for x in rows)
        want = -sum(n * plain.log(x, times * n if i in set(good) and times == 1 else n if i in set(good) else 0) for x, n in g.items()) / sum(g.values())
        assert r["log_perplexity"] == pytest.approx(want, abs=1e-9), (i, t)
        assert r["kept"] == (r["log_perplexity"] <= r["limit"])
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["kept"] for i in range(90)) and not any(by[i]["kept"] for i in range(90, 96))  # word order and unlike letters count


def test_probabilities_sum_to_one(spark, case):
    rows, good = case
    texts = [r[1] for r in rows if r[0] in set(good)]
    model, unseen = lm.kneser_ney(lm.count_grams(spark.createDataFrame([(t,) for t in texts], "text string")))
    table = model.collect()
    p1 = {r["lo"]: math.exp(r["log_p"]) for r in table if r["order"] == 1 and r["log_p"] is not None}
    assert sum(p1.values()) + math.exp(unseen) == pytest.approx(1)
    two = defaultdict(dict)
    for r in table:
        if r["order"] == 2 and r["log_p"] is not None:
            two[r["lo"] >> lm.BITS][r["lo"] & (1 << lm.BITS) - 1] = math.exp(r["log_p"])
    back = {r["lo"]: math.exp(r["log_backoff"]) for r in table if r["order"] == 1 and r["log_backoff"] is not None}
    assert two.keys() == back.keys()
    for c, seen in two.items():
        assert sum(seen.get(w, back[c] * p) for w, p in p1.items()) + back[c] * math.exp(unseen) == pytest.approx(1)
    assert sum(r["order"] == lm.ORDER for r in table) == len({g for t in texts for g in grams(t)})  # no n-gram is left out


def test_grams_of_large_alphabets():
    """Both ways of sorting give the same n-grams."""
    rng = random.Random(3)
    small = ["".join(rng.choice("abc \0") for _ in range(rng.choice([0, 1, 4, 50]))) for _ in range(40)]
    large = ["".join(chr(rng.randint(0x4E00, 0x4E00 + 9000)) for _ in range(9000)), *small, "漢漢漢漢漢漢", ""]
    for texts in (small, large, [""], ["a"]):
        which, hi, lo, n = lm.grams_of(texts)
        got = Counter()
        for d, h, x, c in zip(which.tolist(), hi.tolist(), lo.tolist(), n.tolist()):
            full = h << 2 * lm.BITS | x
            got[d, tuple((full >> lm.BITS * k & (1 << lm.BITS) - 1) for k in range(lm.ORDER - 1, -1, -1))] += c
        want = Counter()
        for d, t in enumerate(texts):
            points = [0] * (lm.ORDER - 1) + [ord(c) + 1 for c in t]
            want.update((d, tuple(points[i : i + lm.ORDER])) for i in range(len(t)))
        assert got == want and lm._starts(hi, lo).sum() == len({g for _, g in want})


def test_without_trusted_text_all_stay(spark):
    docs = spark.createDataFrame([(1, "a b c", "en"), (2, "", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in lm.classify(docs, labels).collect()}
    assert got == {1: True, 2: False}


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "ab cd " * 300_000, "en"), (2, "ab cd", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["log_perplexity"] for r in lm.classify(docs, labels).collect()}
    assert np.isfinite(list(got.values())).all()
