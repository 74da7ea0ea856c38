"""Readers, sinks and streams on files."""

from pyspark.sql import functions as F

from loomwright.operators import report
from loomwright.sources import readers, sinks
from loomwright.streaming import loops


def test_jsonl(spark, tmp_path):
    p = tmp_path / "train_aime_th_003.jsonl"
    p.write_text('{"id": "a-1"}\n\n{"id": bad\n{"id": "a-2"}\n', encoding="utf-8")
    schema = "id string"
    df = readers.read_jsonl(spark, str(tmp_path), schema).cache()
    assert df.count() == 3 and df.where("_corrupt_record is not null").count() == 1
    r = df.where("id = 'a-1'").first()
    assert (r["_split"], r["_family"], r["_shard"]) == ("train", "aime_th", "003")
    assert readers.read_jsonl(spark, str(tmp_path), schema, "drop").where("id is not null").count() == 2
    errors = readers.load_errors(readers.read_numbered(spark, str(tmp_path))).collect()
    assert [e["id"] for e in errors] == ["train_aime_th_003.jsonl:3"]
    assert readers.count_lines(spark, str(p)) == 3 and readers.count_lines(spark, str(p), blank=True) == 4


def test_recovery_and_texts(spark):
    m = spark.createDataFrame([("a", None), ("b", "y"), (None, "z"), ("b", "y")], "id string, x string")
    known = spark.createDataFrame([("a",)], "id string")
    assert [tuple(r) for r in readers.recovered(m, known, defaults={"n": F.lit(1)}).collect()] == [("b", "y", 1)]
    df = spark.sql("select 'q' as a, array('x', '') as b, named_struct('k', 1) as c")
    assert sorted(r[0] for r in readers.texts_of(df, ["a", "b", "c", "none"]).collect()) == ["q", "x", '{"k":1}']
    assert readers.expand_aliases(["aime", "aime24", "x"], []) == ["aime24", "aime25", "x"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("train", "a", "000", 1), ("val", "a", "001", 2)], "split string, family string, shard string, n int")
    out = str(tmp_path / "out")
    assert sinks.write_partitions(df, out, dry_run=True).count() == 2
    assert not (tmp_path / "out").exists()
    sinks.write_partitions(df, out)
    assert spark.read.json(out).count() == 2
    assert sinks.write_if_changed(df, str(tmp_path / "j"), ["n"]) and not sinks.write_if_changed(df, str(tmp_path / "j"), ["n"])
    text = sinks.manifest(spark.createDataFrame([("a", 2, 0.5), ("b", 3, 0.5)], "f string, n int, w double"), "f", "n", "w", "sqrt").first()[0]
    assert sinks.read_manifest(text) == {"strategy": "sqrt", "train_counts": {"a": 2, "b": 3}, "weights": {"a": 0.5, "b": 0.5}}
    assert report.markdown(df.select("n").orderBy("n")) == "| n |\n| --- |\n| 1 |\n| 2 |\n"
    assert report.fingerprint(df, ["n"]).first()[0] == report.fingerprint(df.repartition(2), ["n"]).first()[0]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, k string").write.json(src)
    schema = "id long, k string"
    seen = []
    loops.cycles(loops.watch_files(spark, src, schema), lambda b, n: seen.append((n, b.count())), str(tmp_path / "c1")).awaitTermination()
    assert sum(n for _, n in seen) == 3
    loops.append_until(loops.watch_files(spark, src, schema, files_per_batch=1), str(tmp_path / "o"), str(tmp_path / "r"), F.col("id") != 2, 10, str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/o/batch=*").count() == 2 and spark.read.parquet(f"{tmp_path}/r/batch=*").count() == 1
    assert loops.skip_existing(spark.range(1), str(tmp_path / "s")) and not loops.skip_existing(spark.range(1), str(tmp_path / "s"))
