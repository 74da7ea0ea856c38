"""Both sides of every size switch, recovery of repeated batches, ranks of hot groups."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.functions import answers, prosody
from loomwright.operators import curate, neardup, vectors, verify
from loomwright.streaming import loops


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_contamination_paths(spark, monkeypatch, kind):
    """An index in the tasks or a join on grams; ids of any type, repeated rows, null and short texts."""
    texts = ["The quick brown fox jumps", "the quick brown fox sleeps", None, "", "abc", "ABC", "nothing alike", "the quick brown fox jumps", "𝔘𝔫𝔦 ist drin 😀"]
    make = lambda t, name: spark.createDataFrame([(i if kind == "long" else f"k{i}", x) for i, x in enumerate(t)], f"{name} {kind}, text string")
    docs, bench = make(texts, "doc_id"), make(["the quick brown fox jumps", "abc", None, "𝔘𝔫𝔦 ist", "the quick brown fox jumps"], "item_id")
    found = []
    for most in (neardup.INDEX_CHARS, -1):
        monkeypatch.setattr(neardup, "INDEX_CHARS", most)
        found.append([rows(f(docs, bench)) for f in (neardup.contamination, neardup.containment, neardup.jaccard_pairs, neardup.simhash_of_similar)])
    assert found[0] == found[1]
    assert [r[2] for r in found[0][0]] == [1.0, 0.521739, 0.0, 0.0, 1.0, 1.0, 0.0, 1.0, 0.285714]


def test_vectors_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8))
    v[7] = v[3]
    base = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    queries = base.where("vec_id < 10")
    whole = [rows(neardup.nearest_vectors(queries, base, others=o)) for o in (False, True)]
    monkeypatch.setattr(vectors, "BROADCAST_VECTORS", 7)
    assert whole == [rows(neardup.nearest_vectors(queries, base, others=o)) for o in (False, True)]
    assert {r[0]: r[1] for r in whole[0]}[7] == 3 and {r[0]: r[1] for r in whole[1]}[7] == 3 and all(r[0] != r[1] for r in whole[1])


def test_ranks_of_hot_groups(spark):
    df = spark.createDataFrame([(i, "hot" if i % 10 else None, i % 3) for i in range(3000)], "id long, g string, h int")
    key = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    got = curate.hash_ranked(df, ["g"], key, "id", "r", "n")
    want = df.selectExpr("id", "row_number() over (partition by g order by sha2(cast(cast(id as string) as binary), 256), id) as r", "count(*) over (partition by g) as n")
    assert rows(got.select("id", "r", "n")) == rows(want)
    first = curate.first_of(df, [F.col("g")], ["id"], keep_null_keys=True)
    assert first.count() == 301 and first.where("g is not null").first()["id"] == 1
    assert curate.later_copies(df, [F.col("g")], ["id"]).count() == 2998


def test_repeated_batch(spark, tmp_path):
    """A batch that runs again after a failure leaves the same rows, near the target too."""
    out, log = f"{tmp_path}/out", f"{tmp_path}/log"
    steps = []

    class Caught:
        sparkSession = spark

    real = loops.cycles
    loops.cycles = lambda stream, step, checkpoint: steps.append(step)
    try:
        loops.append_until(Caught(), out, log, F.col("id") % 10 > 0, 100, "unused", ["id"])
    finally:
        loops.cycles = real
    batch = lambda k: spark.range(40 * k, 40 * k + 40)
    for number, k in ((0, 0), (1, 1), (2, 2), (2, 2), (1, 1), (3, 3), (3, 3)):
        steps[0](batch(k), number)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [i for i in range(120) if i % 10][:100]
    logged = {(r["id"], r["reason"]) for r in spark.read.parquet(log).collect()}
    assert logged == {(i, "rejected") for i in range(0, 160, 10)} | {(i, "over_target") for i in range(160) if i % 10 and i not in [i for i in range(120) if i % 10][:100]}


def test_answers_in_deep_braces(spark):
    x = "{(" * 30 + "a b" + ")}" * 30
    df = spark.createDataFrame([(x,), ("{a}{b}",), ("((",), ("",), (None,), ("(a}",)], "x string")
    assert [r[0] for r in df.select(answers.normalize_answer(F.col("x"))).collect()] == ["ab", "a}{b", "((", "", None, "(a}"]


def test_verse_forms(spark):
    df = spark.createDataFrame([("klon_8_composition", "กา"), ("kap_composition", ""), ("prose", "กา"), ("informal_register", "กา")], "t string, x string")
    assert [r[0] for r in df.select(prosody.prosody_issues(F.col("t"), F.col("x"))).collect()] == [["stanza"], ["empty"], [], ["register informal"]]


@pytest.mark.parametrize("code", ["import _socket; _socket.socket()", "import os; os.posix_spawn('/bin/true', ['true'], {})", "import os; os.fork()", "import subprocess; subprocess.run(['true'])"])
def test_guarded_code(code):
    ok, _, error = verify.run_code(code)
    assert not ok and "PermissionError" in error


def test_a_vote_sorts_its_samples_once(spark):
    from loomwright.operators import score

    rows = [(1, "a", -0.1, 1), (1, "b", -0.1, 2), (1, "b", -0.3, 3), (1, "a", -0.2, 4), (2, None, -0.1, 5), (3, "c", -9.0, 6)] + [(4, "xy"[i % 2], -i / 100, i) for i in range(41)]
    df = spark.createDataFrame(rows, "item long, answer string, lp double, no long")
    got = score.confidence_vote(df, "item", "answer", "lp", "no")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") <= 2 and plan.count("Sort [item#") == 2, plan  # one for both windows, one for the groups
    x = sum(math.exp(-i / 100) for i in range(0, 30, 2))
    assert {r["item"]: (r["vote"], r["weight"]) for r in got.collect()} == {1: ("a", round(math.exp(-0.1) + math.exp(-0.2), 6)), 3: ("c", round(math.exp(-9), 6)), 4: ("x", round(x, 6))}
