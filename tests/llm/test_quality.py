"""Adaptive limits: they follow the groups, merge, and don't depend on names or joins."""

import random

from pyspark.sql import functions as F

from loomwright.llm import quality


def made(seed=6):
    """Two languages with unlike habits, a source that repeats lines often, and a source of which all is noise."""
    rng = random.Random(seed)
    rows = []

    def words(n, size):
        return ["".join(rng.choice("abcdefgh") for _ in range(max(1, size + rng.choice([-1, 0, 0, 1])))) for _ in range(n)]

    def add(lang, source, n, size=5, twice=0.0, noise=0.0):
        for _ in range(n):
            lines = [" ".join(words(12, size)) for _ in range(8)]
            if rng.random() < twice:
                lines.append(lines[0])
            if rng.random() < noise:
                lines = [x.replace(" ", " #$% ") for x in lines]
            rows.append((len(rows), "\n".join(lines), lang, source))

    add("en", "a", 700)
    add("en", "forum", 700, twice=0.05)
    add("de", "a", 700, size=9, noise=0.05)
    add("de", "junk", 60, size=9, noise=1.0)
    add(None, "b", 60)
    add("xx", None, 5)
    return rows


def test_limits_follow_the_groups(spark):
    docs = spark.createDataFrame(made(), "doc_id long, text string, lang string, source string")
    measured = quality.with_base_metrics(docs, keep_text=False).cache()
    by = {(r["lang"], r["source"]): {k: (v["lo"], v["hi"]) for k, v in r["limits"].items()} for r in quality.limits_of(measured).collect()}
    assert by["de", "a"]["word_length"][1] > by["en", "a"]["word_length"][1]
    assert by["en", "forum"]["dup_lines"][1] > by["en", "a"]["dup_lines"][1]  # its own high quantile
    assert by["de", "junk"]["symbols"] == by["de", "a"]["symbols"]  # no usual text of its own: its language's
    assert by["xx", None].keys() == set(quality.METRICS) and all(hi is not None for x in by.values() for _, hi in x.values())
    kept = {r["doc_id"] for r in quality.keep_good(docs).collect()}
    assert kept == {r[0] for r in made() if "#$%" not in r[1]}


def test_names_and_both_joins(spark):
    rows = [(*r, "x", "y", 1.5, True) for r in made()] + [(None, None, None, None, "x", "y", 1.5, True)]
    names = ["doc_id", "text", "lang", "source", "quality", "_lw0", "a.b", "kept"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, c1 string, c2 string, c3 double, c4 boolean").toDF(*names)
    out = quality.keep_good(docs)
    assert out.columns == names and {r["quality"] for r in out.collect()} == {"x"}
    measured = quality.with_base_metrics(docs.select("doc_id", "lang", "source", "text"), keep_text=False).cache()
    limits = quality.limits_of(measured)
    few, many = (quality.judged(measured, limits, broadcast_rows=n).select("doc_id", "kept") for n in (0, 10**9))
    assert sorted(map(tuple, few.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)
    assert out.count() == few.where("kept").count()


def test_sketches_merge(spark):
    docs = spark.createDataFrame(made(), "doc_id long, text string, lang string, source string")
    m = quality.with_base_metrics(docs, keep_text=False).cache()
    halves = quality.sketches(m.where("doc_id % 2 = 0")).union(quality.sketches(m.where("doc_id % 2 = 1"))).groupBy("lang", "source", "metric", "low").agg(F.sum("n").alias("n"))
    assert set(map(tuple, quality.sketches(m).collect())) == set(map(tuple, halves.collect()))
