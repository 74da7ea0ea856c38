"""Mountain ranges, merged over partitions, against trees built in one piece."""

import hashlib
import random
import zlib
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from loomwright.llm import manifest

DDL = "doc_id long, text string, lang string, source string, n_chars long, group string, id int"


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row, text=None):
    part = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    return H("".join(map(part, (row[0], row[3], row[2], row[4], row[1] if text is None else text))))


def tree(leaves):
    """Levels of nodes, the leaves first."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][k : k + 16])) for k in range(0, len(out[-1]), 16)])
    return out


def fold(levels, i, held):
    """(digests of the siblings on the way, the root that `held` leads to) of leaf i."""
    siblings = ""
    for nodes in levels[:-1]:
        run, at = nodes[i // 16 * 16 : i // 16 * 16 + 16], i % 16
        siblings += "".join(run[:at] + run[at + 1 :])
        held, i = H("".join([*run[:at], held, *run[at + 1 :]])), i // 16
    return siblings, held


def expected(rows, tampered):
    of = {}
    for r in rows:
        of.setdefault(r[3], []).append(r)
    groups = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    mine = {g: sorted(of[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in groups}
    trees = {g: tree([leaf(r) for r in mine[g]]) for g in groups}
    top = tree([trees[g][-1][0] for g in groups])
    out = []
    for k, g in enumerate(groups):
        for i, r in enumerate(mine[g]):
            held = leaf(r, r[1].lower()) if r[1] is not None and tampered(r[0]) else leaf(r)
            a, sub = fold(trees[g], i, held)
            b, root = fold(top, k, sub)
            out.append((str(r[0]), leaf(r), trees[g][-1][0], top[-1][0], H(a + b), root, root == top[-1][0]))
    return sorted(out)


def five(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 5 == 0


@pytest.mark.parametrize("sizes,parts", [([1], 1), ([16], 3), ([17], 3), ([2, 1, 300], 7), ([1] * 40, 3), ([4100, 1, 33, 256], 1), ([4100, 1, 33, 256], 7), ([300], 24), ([15, 16, 17, 257, 272, 3], 7)])
def test_trees(spark, sizes, parts):
    rng = random.Random(len(sizes) + parts)
    names = [None, *(f"s{k}" for k in range(len(sizes)))] if len(sizes) % 2 else [f"é{k}" for k in range(len(sizes))]
    rows = [(k * 10000 + i, rng.choice(["A b", "a", "", None, "É"]), rng.choice(["en", None]), g, rng.choice([1, None]), "x", 1) for k, (g, n) in enumerate(zip(names, sizes)) for i in range(n)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        low = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lower("text")).otherwise(F.col("text"))
        docs = spark.createDataFrame(rows, DDL)
        got = sorted((str(r[0]), *r[2:]) for r in manifest.prove_documents(docs, held={"text": low}).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ascii_low = [(r[0], r[1], *r[2:]) for r in rows]
    assert [g for g in got] == [tuple(x) for x in expected_lower(ascii_low)]


def expected_lower(rows):
    return expected(rows, five)


def test_repeats_nulls_and_nothing(spark):
    rows = [(1, "same", "en", "s", 4, None, None)] * 40 + [(None, None, None, None, None, None, None)] * 3 + [(1, "other", "en", "s", 5, None, None), (2, "", "", "", 0, None, None)]
    got = sorted((str(r[0]), *r[2:]) for r in manifest.prove_documents(spark.createDataFrame(rows, DDL)).collect())
    assert got == expected(rows, lambda i: False) and all(r[-1] for r in got)
    none = spark.createDataFrame([], DDL)
    assert manifest.prove_documents(none).columns == ["id", "group", *(f.name for f in manifest.PROOF)] and manifest.prove_documents(none).count() == 0


def test_node_records(spark):
    """Stored nodes: each level's digests are the next one's children."""
    records = spark.range(700).select(F.lit("s").alias("group"), "id", F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("leaf"), F.lit(None).cast("binary").alias("held"))
    nodes = [r.asDict() for r in manifest.build(records).nodes().collect()]
    assert sorted((r["tree"], r["level"]) for r in nodes) == [("dataset", 0)] + [("source", 0)] * 44 + [("source", 1)] * 3 + [("source", 2)]
    for level in (1, 2):
        below = [bytes(r["digest"]) for r in sorted((r for r in nodes if r["tree"] == "source" and r["level"] == level - 1), key=lambda r: r["run"])]
        here = b"".join(bytes(r["children"]) for r in sorted((r for r in nodes if r["tree"] == "source" and r["level"] == level), key=lambda r: r["run"]))
        assert here == b"".join(below)


def test_edges():
    row = lambda part, groups, first_n, last_n, first, last: {"part": part, "groups": groups, "first_n": first_n, "last_n": last_n, "first": first, "last": last}
    sums = [row(0, 1, 5, 5, None, None), row(2, 2, 3, 4, None, "a"), row(3, 1, 6, 6, "a", "a"), row(4, 3, 1, 2, "a", "c"), row(7, 1, 9, 9, "d", "d")]
    assert manifest.edges(sums) == {0: (0, 8, 8), 2: (5, 8, 11), 3: (4, 11, 11), 4: (10, 11, 2), 7: (0, 9, 9)}
    assert list(accumulate(manifest.top_level(n) for n in (1, 16, 17, 256, 257))) == [0, 0, 1, 2, 4]
