"""Defined cases: clashing names, repeated rows, wide alphabets, long texts, ties, empty tables."""

import random
import time

import numpy as np
import pytest

from loomwright.llm import decontam, langid, linededup, packing, queries, sharding, simhash

CLASH = ["doc_id", "text", "lang", "_id", "_hits", "_kept", "_mark", "_ki", "_lw0", "_lw1", "_v", "_row", "print", "a.b"]


def clashing(spark, rows):
    return spark.createDataFrame([(*r, "en", *([7] * (len(CLASH) - 3))) for r in rows], f"doc_id long, text string, lang string, {', '.join(f'c{i} int' for i in range(len(CLASH) - 3))}").toDF(*CLASH)


LINE = "a line that is long enough to be a passage of its own"


def test_names_are_free(spark):
    rows = [(i, f"{LINE}\nown words {i} {i * i}") for i in range(8)] + [(8, None), (9, ""), (9, "")]
    docs = clashing(spark, rows)
    out = linededup.drop_repeated_lines(docs)
    assert out.columns == [*CLASH, "line_dedup"] and all(r["_kept"] == r["_hits"] == 7 for r in out.collect())
    assert sorted(r["line_dedup"]["n_dropped"] for r in out.collect()) == [0] * 4 + [1] * 7
    kept = simhash.keep_one(docs)
    assert kept.columns == CLASH and {r["doc_id"] for r in kept.collect()} >= {0, 8} and kept.where("doc_id > 7").count() == 1
    bench = spark.createDataFrame([("x", LINE, 1)], "item_id string, text string, doc_id int")
    found = decontam.find_items(docs, bench)
    assert found.columns == [*CLASH, "overlap"] and found.where(decontam.contaminated()).count() == 8
    assert langid.predict(docs, langid.train(docs)).columns == [*CLASH, "language"]
    assert packing.pack(docs, queries.tokenizer_path()).count() == len(rows)
    assert sharding.shard_by_slots(docs, 8)[0].count() == len(rows)


def test_pipeline_cases(spark, tmp_path):
    """Empty table, null columns and repeated rows through all stages."""
    import corpus_pipeline as cp

    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(300)]
    text = lambda: " ".join(rng.choice(words) for _ in range(60))
    rows = [(i, text(), "en", "s", 1) for i in range(30)]
    rows += [rows[0], rows[0], (40, rows[1][1], None, None, None), (None, text(), "en", "s", 1), (None, None, None, None, None), (41, None, "en", "s", 1), (42, "", None, "s", 0)]
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data in (("full", rows), ("none", [])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(data, ddl).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, rows[5][1])], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        got = sorted((r["doc_id"] is None, r["doc_id"]) for r in cp.run(spark, d).collect())
        assert got == ([(False, i) for i in range(30) if i != 5] + [(True, None)] if data else [])


def test_wide_alphabets():
    """More distinct letters than fit beside a group's number: same as each text alone."""
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha()]
    texts = ["".join(letters[i::3]) for i in range(3)] + ["abc abd", "".join(letters)]
    each = list(langid.grams_of_each(texts))
    for t, (codes, counts) in zip(texts, each):
        _, c, n = langid.count_grams([t], [0])
        assert np.array_equal(codes, c) and np.array_equal(counts, n)
    assert len(set("".join(texts).lower())) > 131_071


@pytest.mark.parametrize("languages", [1, 2, 100])
def test_languages_in_blocks(spark, languages):
    """However many are compared at once; of equal distances the first by name wins."""
    rows = [(1, "hello there world", "en"), (2, "bonjour le monde", "fr"), (3, "hello there world", "ax"), (4, "hallo welt da", "de"), (5, None, "de"), (1, "hello there world", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r["doc_id"], r["language"]["lang"], round(r["language"]["score"], 12)) for r in langid.predict(docs, langid.train(docs), languages=languages).collect()}
    assert {x[:2] for x in got} == {(1, "ax"), (2, "fr"), (3, "ax"), (4, "de"), (5, "und")}
    whole = {(r["doc_id"], r["language"]["lang"], round(r["language"]["score"], 12)) for r in langid.predict(docs, langid.train(docs)).collect()}
    assert got == whole


def test_predictions_by_plain_distance(spark):
    """Out-of-place distance on strings."""
    from collections import Counter

    rng = random.Random(8)
    vocab = {k: ["".join(rng.choice(a) for _ in range(rng.randint(2, 6))) for _ in range(60)] for k, a in (("xa", "abcde"), ("xb", "bcdéf"), ("xc", "abçef"))}
    rows = [(i, " ".join(rng.choice(vocab[k]) for _ in range(rng.randint(3, 40))), k) for i, k in enumerate(sorted(vocab) * 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def grams(t):
        c = Counter(f" {w} "[i : i + n] for w in t.split() for n in (1, 2, 3) for i in range(len(w) + 3 - n))
        del c[" "]
        return c

    code = lambda g: [ord(x) for x in g.rjust(3, chr(0))]
    order = lambda c, n: sorted(c, key=lambda g: (-c[g], code(g)))[:n]
    profiles = {k: {g: i for i, g in enumerate(order(sum((grams(t) for _, t, x in rows if x == k), Counter()), langid.PROFILE))} for k in vocab}
    most = max(map(len, profiles.values()))
    got = {r["doc_id"]: r["language"] for r in langid.predict(docs, langid.train(docs)).collect()}
    for i, t, _ in rows:
        mine = order(grams(t), langid.DOCUMENT)
        d = {k: sum(min(abs(p[g] - j), most) if g in p else most for j, g in enumerate(mine)) for k, p in profiles.items()}
        best = min(sorted(d), key=d.get)
        assert got[i]["lang"] == best and got[i]["score"] == pytest.approx(1 - d[best] / (most * len(mine)))


def test_a_document_of_many_repeated_lines(spark):
    many = "\n".join(f"{LINE} number {i}" for i in range(4_000))
    docs = spark.createDataFrame([(i, many + f"\nown {i}") for i in range(5)], "doc_id long, text string")
    began = time.perf_counter()
    got = {r["doc_id"]: r["line_dedup"] for r in linededup.drop_repeated_lines(docs).collect()}
    assert {i: (r["n_lines"], r["n_dropped"]) for i, r in got.items()} == {i: (4_001, 4_000 * (i < 4)) for i in range(5)}
    assert got[0]["text"] == "own 0" and time.perf_counter() - began < 120


def test_long_texts(spark):
    long = "word " * 200_000 + LINE
    docs = spark.createDataFrame([(1, long, "en"), (2, long, "en"), (3, "other words here", "fr")], "doc_id long, text string, lang string")
    bench = spark.createDataFrame([(1, LINE)], "item_id long, text string")
    assert {r["doc_id"]: r["n"] for r in decontam.find_items(docs, bench).select("doc_id", decontam.n_hit().alias("n")).collect()} == {1: 13, 2: 13, 3: 0}
    assert simhash.keep_one(docs).count() == 2
    assert {r["doc_id"]: r["language"]["lang"] for r in langid.predict(docs, langid.train(docs)).collect()} == {1: "en", 2: "en", 3: "fr"}


def test_slot_map_is_found_again(spark, sf):
    """A second run of the query starts from the first one's map; a map that doesn't fit is an error."""
    rows = [sorted(map(tuple, queries.op2_sharding(spark, sf).collect())) for _ in range(2)]
    versions = [{r[-1] for r in x} for x in rows]
    assert versions[1] == {v + 1 for v in versions[0]} and len(versions[0]) == 1
    assert [r[4] for r in rows[0]] == [r[4] for r in rows[1]]  # balanced already: no row moves
    folder = queries.lasting_folder(spark, "slot-maps", sf, "bytes", "8")
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for shards, slots in ((4, sharding.N_SLOTS), (8, 100)):
        with pytest.raises(ValueError):
            sharding.shard_by_slots(docs, shards, n_slots=slots, map_path=folder)
