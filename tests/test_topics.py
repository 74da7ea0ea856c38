"""The topic loop: choice by rule, state over batches, recovery."""

from loomwright.streaming import loops, topics


def test_choice():
    stats = {"a": (1, 10, 0), "b": (9, 10, 0), "c": (0, 2, 0), "d": (1, 10, 5)}
    names = ["a", "b", "c", "d", "e"]
    assert topics.choose(stats, names, 1, 2, 4) == [("a", "weak"), ("d", "weak"), ("b", "turn"), ("c", "turn")]
    assert topics.choose(stats, names, 5, 1, 3) == [("a", "weak"), ("e", "turn"), ("b", "turn")]
    assert topics.choose(stats, names, 1, 2, 9, most_failures=4) == [("a", "weak"), ("b", "weak"), ("c", "turn"), ("e", "turn")]
    assert topics.choose({}, [], 1) == [] and topics.choose({}, ["x"], 7) == [("x", "turn")]


def test_state_and_restart(spark, tmp_path):
    """The second run knows the first one's results; each result counts once; loops don't mix."""
    folder, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    schema = "loop string, topic string, correct long, total long, failed long"

    def run(rows):
        if rows:
            spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(folder)
        stream = topics.plans(loops.watch_files(spark, folder, schema, "parquet"), ["x", "y", "z"], weakest=1, chosen=2)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
        return {(r["loop"], r["cycle"], r["place"]): (r["topic"], r["reason"], r["total"], r["failed"]) for r in spark.read.parquet(out).collect()}

    first = run([("one", "x", 1, 1, 0)] * 40 + [("one", "y", 0, 1, 1)] * 30 + [("two", "z", 1, 1, 0), (None, "x", 0, 9, 0), ("one", None, 0, 9, 0)])
    assert first == {("one", 1, 0): ("y", "weak", 30, 30), ("one", 1, 1): ("x", "turn", 40, 0), ("two", 1, 0): ("x", "turn", 0, 0), ("two", 1, 1): ("y", "turn", 0, 0)}
    # y's later results lift it above x only together with nothing forgotten
    second = run([("one", "x", 0, 1, 0)] * 60 + [("one", "y", 1, 1, 0)] * 30)
    assert {k: v for k, v in second.items() if k[1] == 2} == {("one", 2, 0): ("x", "weak", 100, 0), ("one", 2, 1): ("y", "turn", 60, 30)}
    assert run([]) == second  # nothing new, no cycle


def test_caps_by_source(spark, tmp_path):
    """Each source stops at its own cap, a source without one is taken whole, and a repeated batch changes nothing."""
    from pyspark.sql import functions as F

    steps = []
    real, loops.cycles = loops.cycles, lambda stream, step, checkpoint: steps.append((stream, step))
    out, rest = str(tmp_path / "out"), str(tmp_path / "rest")
    try:
        given = {k: spark.range(0).select("id") for k in ("a", "b", "free")}
        loops.append_capped(given, out, rest, F.col("id") % 10 != 0, {"a": 25, "b": 0}, "unused", ["id"])
    finally:
        loops.cycles = real
    stream, step = steps[0]
    assert stream.columns == ["id", "source"]
    batch = lambda k: spark.range(20 * k, 20 * k + 20).select("id", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("free"))).alias("source"))
    for number, k in ((0, 0), (1, 1), (1, 1), (0, 0), (2, 2)):
        step(batch(k), number)
    good = [i for i in range(60) if i % 10]
    got = sorted((r["source"], r["id"]) for r in spark.read.parquet(out).collect())
    assert got == [("a", i) for i in good[:25]] + [("free", i) for i in good]
    left = {(r["source"], r["id"], r["reason"]) for r in spark.read.parquet(rest).collect()}
    assert left == {(s, i, "rejected") for s in ("a", "b", "free") for i in range(0, 60, 10)} | {("a", i, "over_cap") for i in good[25:]} | {("b", i, "over_cap") for i in good}
