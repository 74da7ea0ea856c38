"""Set-similarity joins and nearest vectors against brute force, on every path."""

import random

import numpy as np
import pytest

from loomwright.operators import neardup, setjoin, vectors


def grams(t, n=5):
    t = "".join((t or "").lower().split())
    return {t[i : i + n] for i in range(len(t) - n + 1)} if len(t) >= n else {t} - {""}


@pytest.fixture(scope="module")
def sides():
    rng = random.Random(2)
    words = ["the", "hot", "and", "rare", "é", "Of", "x", "question", "answer", "what", "is"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    bench = [(i, text(rng.choice([1, 3, 12, 40]))) for i in range(60)] + [(100, None), (101, ""), (102, "the hot")]
    docs = [(i, text(rng.choice([1, 2, 10, 40, 400]))) for i in range(80)]
    for k in range(60):  # near copies, at all degrees, and passages in long texts
        t = bench[k][1].split()
        for j in range(rng.randrange(len(t) + 1)):
            t[rng.randrange(len(t))] = rng.choice(["new", "words", "here"])
        docs.append((1000 + k, " ".join(t)))
        docs.append((2000 + k, text(30) + " " + bench[k][1]))
    return docs + [(3000, None), (3001, ""), (3002, "ab")], bench


@pytest.mark.parametrize("most", [neardup.INDEX_CHARS, -1])
@pytest.mark.parametrize("least", [0.0, 0.25, 0.5, 1.0])
def test_pairs(spark, monkeypatch, sides, most, least):
    monkeypatch.setattr(neardup, "INDEX_CHARS", most)
    docs, bench = sides
    a, b = {i: grams(t) for i, t in docs}, {i: grams(t) for i, t in bench}
    both = {(i, j): len(x & y) for i, x in a.items() for j, y in b.items() if x & y}
    d, e = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(bench, "item_id long, text string")
    want = {(i, j): n / (len(a[i]) + len(b[j]) - n) for (i, j), n in both.items()}
    got = {(r[0], r[1]): r[2] for r in neardup.jaccard_pairs(d, e, least=least).collect()}
    assert got == {k: x for k, x in want.items() if x >= least}
    contained = {(r[0], r[1]): r[2] for r in neardup.containment(d, e, least=least).collect()}
    assert contained == {(i, j): n / len(b[j]) for (i, j), n in both.items() if n / len(b[j]) >= least}


@pytest.mark.parametrize("matrix", [0, 4 * 63 * 5, setjoin.MATRIX_BYTES])
def test_best(spark, monkeypatch, sides, matrix):
    """The same best item whatever share of the grams is counted by the matrix."""
    monkeypatch.setattr(setjoin, "MATRIX_BYTES", matrix)
    docs, bench = sides
    b = {i: grams(t) for i, t in bench}
    got = neardup.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert len(got) == len(docs)
    for r in got:
        x = grams(dict(docs)[r["doc_id"]])
        j = max(((len(x & y) / len(x | y), -i) for i, y in b.items() if x & y), default=(0.0, None))
        assert r["jaccard_max"] == round(j[0], 6) and r["item_id"] == (None if j[1] is None else -j[1])


def test_common_grams_are_not_expanded():
    """A gram of every item is in no prefix."""
    texts = [f"common passage of all items {k * 7919} {k}" for k in range(200)]
    index = setjoin.GramIndex(texts, 5, 0.8)
    assert (index.start[1:] - index.start[:-1]).max() < 40 and len(index.items) < index.sizes.sum()


def exact(queries, base, others):
    out = {}
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-300)
    rows = [(i, unit(v)) for i, v in base if i is not None and v is not None]
    for i, v in queries:
        if v is not None:
            c = [(round(float(unit(v) @ w), 9) + 0.0, -j) for j, w in rows if not (others and i == j)]
            if c:
                out[i] = (round(max(c)[0], 6), -max(c)[1])
    return out


@pytest.mark.parametrize("others", [False, True])
@pytest.mark.parametrize("most,block", [(50_000, 4096), (0, 4096), (0, 7)])
def test_nearest(spark, monkeypatch, others, most, block):
    monkeypatch.setattr(vectors, "BROADCAST_VECTORS", most)
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "PIVOTS", 20)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 8)) * 4
    base = [(i, (centers[i % 6] + rng.normal(size=8)).tolist()) for i in range(400)]
    base += [(1000 + i, base[3][1]) for i in range(60)] + [(2000, [0.0] * 8), (2001, [0.0] * 8), (2002, None), (None, base[5][1])]
    queries = base[:90] + base[400:410] + [(2000, [0.0] * 8), (5000, [0.0] * 8), (5001, None), (5002, (-centers.sum(axis=0)).tolist()), (5003, [2 * x for x in base[7][1]])]
    frame = lambda rows, n: spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(n)
    got = neardup.nearest_vectors(frame(queries, 3), frame(base, 5), others=others).collect()
    want = exact(queries, base, others)
    assert len(got) == len(queries)
    for r in got:
        assert (r["cosine"], r["match_id"]) == want.get(r["vec_id"], (None, None)), r
    empty = neardup.nearest_vectors(frame(queries, 2), frame(base, 2).limit(0), others=others).collect()
    assert all(r["match_id"] is None and r["decision"] == "accept" for r in empty) and len(empty) == len(queries)


def test_far_clusters_are_skipped(spark, monkeypatch):
    """Queries of one tight cluster aren't dealt to the others."""
    monkeypatch.setattr(vectors, "BROADCAST_VECTORS", 0)
    monkeypatch.setattr(vectors, "PIVOTS", 40)
    rng, dealt = np.random.default_rng(6), []
    eye = np.eye(8)
    base = spark.createDataFrame([(i, (eye[i % 8] * 10 + rng.normal(size=8) * 0.1).tolist()) for i in range(800)], "vec_id long, embedding array<double>")
    meet = vectors._meet
    monkeypatch.setattr(vectors, "_meet", lambda q, b, o: dealt.append((q.count(), b.select("cluster").distinct().count())) or meet(q, b, o))
    assert neardup.nearest_vectors(base.where("vec_id < 400"), base, others=True).count() == 400
    (home, clusters), (rest, _) = dealt
    assert home == 400 and rest < 400 * clusters / 4
