"""Line numbers of split files, sharded writes, and sums over ranges."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomwright.operators import report, score, verify
from loomwright.sources import readers, sinks


@pytest.mark.parametrize("size", ["64", "1000", "128m"])
def test_numbers_of_split_files(spark, tmp_path, size):
    """Files cut into many splits, lines over their ends: numbers as in a plain read."""
    rng, want = random.Random(3), set()
    for name, ending in (("train_a_000.jsonl", "\n"), ("val_b_c_001.jsonl", "\r\n"), ("train_d_002.jsonl", "\n")):
        lines = [rng.choice(["", "  ", json.dumps({"x": "é" * rng.randrange(60)}), "{broken", "x" * rng.randrange(200)]) for _ in range(300)]
        (tmp_path / name).write_bytes(ending.join(lines).encode() + (b"" if name[0] == "v" else ending.encode()))
        want |= {(name, i, t) for i, t in enumerate(lines, 1) if t.strip(" ")}
    (tmp_path / "train_empty_000.jsonl").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        numbered = readers.read_numbered(spark, str(tmp_path))
        got = [tuple(r) for r in numbered.collect()]
        assert len(got) == len(want) and set(got) == want
        errors = {r["id"] for r in readers.load_errors(numbered).collect()}
        if size == "64":
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 100
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    bad = set()
    for name, i, t in want:
        try:
            json.loads(t)
        except ValueError:
            bad.add(f"{name}:{i}")
    assert errors == bad and len(bad) > 100


def test_shards_of_part_files(spark, tmp_path):
    """A shard written by several tasks reads as one: provenance, numbers over its part-files, counts."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "val_b_001.jsonl").otherwise("train_a_x_000.jsonl").alias("name"), "id", F.to_json(F.struct("id")).alias("value")).repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sinks.write_shards(rows, str(tmp_path / "s"), "name", ["id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(list((tmp_path / "s" / "name=train_a_x_000.jsonl").glob("part-*"))) > 1
    got = readers.read_numbered(spark, str(tmp_path / "s"))
    numbers = {(r["path"], r["line_no"]): json.loads(r["line"])["id"] for r in got.collect()}
    for name, ids in (("val_b_001.jsonl", [i for i in range(3000) if i % 3 == 0]), ("train_a_x_000.jsonl", [i for i in range(3000) if i % 3])):
        assert [numbers[name, k + 1] for k in range(len(ids))] == ids
    read = readers.read_jsonl(spark, str(tmp_path / "s"), "id long")
    assert {tuple(r) for r in read.groupBy("_split", "_family", "_shard").count().collect()} == {("train", "a_x", "000", 2000), ("val", "b", "001", 1000)}
    assert readers.count_lines(spark, str(tmp_path / "s")) == 3000


def test_running_sum(spark):
    """One group with nearly all rows, null groups and null values; the group is spread over tasks."""
    rng = random.Random(4)
    rows = [(i, "hot" if i % 50 else rng.choice(["a", None]), None if i % 97 == 0 else rng.randrange(1000)) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, k string, cost long").repartition(5)
    got = score.running_sum(df, "k", ["id"], F.col("cost").cast("decimal(18,2)"), "spent")
    assert got.columns == ["id", "k", "cost", "spent"]
    so_far, want = {}, {}
    for i, k, c in rows:
        so_far[k] = so_far.get(k) if c is None else (so_far.get(k) or 0) + c
        want[i] = so_far[k]
    assert {r["id"]: None if r["spent"] is None else int(r["spent"]) for r in got.collect()} == want
    assert got.select("id", "k").where("k = 'hot'").count() == sum(k == "hot" for _, k, _ in rows)


def test_names(spark):
    wanted = spark.createDataFrame([(3, "aime"), (5, "all"), (4, "aime24"), (9, "all"), (7, "math"), (1, "zzz")], "place int, name string")
    known = spark.createDataFrame([(0, "math"), (1, "aime25"), (2, "new")], "place int, name string")
    got = sorted(tuple(r) for r in readers.names_expanded(wanted, known).collect())
    assert got == [(1, 0, "zzz"), (3, 0, "aime24"), (3, 1, "aime25"), (5, 0, "math"), (5, 2, "new")]
    assert readers.names_expanded(wanted.where("name <> 'all'"), known).count() == 4


def test_gates_and_copies(spark, monkeypatch):
    df = spark.createDataFrame([("a", "x-5", "train"), ("a", "x-12", "train"), ("a", "x", "train"), ("b", "x-99999999999", "train"), ("b", "x-3", "val")], "g string, id string, split string")
    starts = spark.createDataFrame([("a", 10), ("b", 1), ("c", 0)], "g string, start int")
    for most in (report.SENT_STARTS, 0):
        monkeypatch.setattr(report, "SENT_STARTS", most)
        assert {tuple(r) for r in report.gate_progress(df, starts, "g", "id").collect()} == {("a", 1), ("b", 1), ("c", 0)}
    rows = spark.createDataFrame([(None, i) for i in range(200)] + [("k", 300), ("k", 301)], "id string, n int")
    none = F.lit(None).cast("string")
    out = verify.audit(rows, "id", ["n"], none, none, F.array().cast("array<string>"), none)
    assert [r["n"] for r in out.where("reason = 'duplicate id'").collect()] == [301]
