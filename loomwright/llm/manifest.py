"""Merkle manifest of a dataset: a mountain range of digests for each indexed partition.

Records are ordered by source and id over range partitions. One number for each
partition says at which leaf of its first source it begins, so each partition
knows the place of all its leaves. It keeps a stack of unfinished runs, one for
each level, as in adding one in base 16: the sixteenth child of a run completes a
peak, which is carried into the level above; a run that ends with its source is
closed as it is (no padding). Runs that begin in an earlier partition or go on in
a later one are handed on in pieces, a few for each partition and level, and
merged level by level with ordinary aggregations. The roots of the sources are
the leaves of one more tree of the same kind, whose root is the manifest's.

A node record is a run: its children's digests and its own. From the top down each
run gets the path above it, so a record's proof is the run that holds it and the
path of that run: 16 records share one path, and no node has more than 16 rows in a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, quoted

FANOUT = 16
#: Node records in an Arrow batch.
BATCH = 2000


def joined_digest(children: Column) -> Column:
    """Digest (32 bytes) of digests that stand one after another: of their hexadecimal text."""
    return F.unhex(F.sha2(F.lower(F.hex(children)).cast("binary"), 256))


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """A record's digest: each field is `-` if null, else its UTF-8 bytes' number, a colon and its text."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*map(part, fields)).cast("binary"), 256))


class Range:
    """The mountain range over consecutive leaves of one tree, from leaf `first` on. Its records gather in `out`.

    A record: [level, run, place of the first child in the run, children, whole,
    leaves of the tree, rows]. Records that begin or go on elsewhere, and the first
    run of each level (which may be the root) are held back until the tree's
    size is known; the size is None in all others. rows: of the leaves' runs, what came with each leaf.
    """

    def __init__(self, first: int, out: list[list]) -> None:
        self.next, self.out, self.held_back = first, out, []
        self.open: list[tuple[int, list[bytes]]] = []  # for each level the first child's index, and the children
        self.rows: list = []

    def add(self, digest: bytes, row) -> None:
        self.rows.append(row)
        self._put(0, self.next, digest)
        self.next += 1

    def _put(self, level: int, index: int, digest: bytes) -> None:
        if level == len(self.open):
            self.open.append((0, []))
        if not self.open[level][1]:
            self.open[level] = (index, [])
        first, children = self.open[level]
        children.append(digest)
        if index % FANOUT == FANOUT - 1:
            self._end(level, first % FANOUT == 0)

    def _end(self, level: int, whole: bool) -> None:
        first, children = self.open[level]
        self.open[level] = (0, [])
        rows, self.rows = (self.rows, []) if level == 0 else (None, self.rows)
        record = [level, first // FANOUT, first % FANOUT, b"".join(children), whole, None, rows]
        (self.out if whole and first >= FANOUT else self.held_back).append(record)
        if whole:
            self._put(level + 1, first // FANOUT, bytes.fromhex(_digest(record[3].hex())))

    def close(self, total: int) -> None:
        """After the last leaf that is here; if it is the tree's last, the open runs that began here are whole."""
        ended, level = self.next == total, 0
        while level <= top_level(total) and level < len(self.open):
            first, children = self.open[level]
            if children:
                self._end(level, ended and first % FANOUT == 0)
            level += 1
        for record in self.held_back:
            record[5] = total
        self.out += self.held_back


def top_level(total: int) -> int:
    """The level of the run whose digest is the root; a lone leaf counts as such a run."""
    level = 0
    while total > FANOUT ** (level + 1):
        level += 1
    return level


_NUMBERS = ("part", "rows", "groups", "first_n", "last_n", "most")


def _summaries(ordered: DataFrame) -> list:
    """A row for each partition that isn't empty: its rows, groups, rows of its first, last and largest group, and those groups' names."""
    kind = pa.schema([*((c, pa.int64()) for c in _NUMBERS), ("first", pa.string()), ("last", pa.string())])

    def scan(batches):
        names, sizes, most = [], [], 0  # of the first group and of the one that is being counted
        rows = groups = 0
        for b in batches:
            for name, n in zip(*_stretches(b.column(0)), strict=True):
                if names and name == names[-1]:
                    sizes[-1] += n
                else:
                    groups += 1
                    names, sizes = [*names[:1], name], [*sizes[:1], n]
                most, rows = max(most, sizes[-1]), rows + n
        if rows:
            numbers = (TaskContext.get().partitionId(), rows, groups, sizes[0], sizes[-1], most)
            yield pa.RecordBatch.from_pylist([dict(zip(_NUMBERS, numbers, strict=True)) | {"first": names[0], "last": names[-1]}], schema=kind)

    return ordered.select("group").mapInArrow(scan, f"{', '.join(f'{c} long' for c in _NUMBERS)}, first string, last string").orderBy("part").collect()


def _stretches(column: pa.Array) -> tuple[list, list[int]]:
    """Equal values that stand together, and their numbers."""
    if not len(column):
        return [], []
    runs = pc.run_end_encode(column)
    ends = runs.run_ends.to_pylist()
    return runs.values.to_pylist(), [b - a for a, b in zip([0, *ends], ends)]


def edges(sums: list) -> dict[int, tuple[int, int, int]]:
    """{partition: (leaves of its first group before it, all leaves of that group, all leaves of its last group)}."""
    spans: list[int] = []  # leaves of each group that is first or last in a partition
    of, last = {}, None
    for r in sums:
        offset = spans[-1] if last and last["last"] == r["first"] else 0
        spans[len(spans) - (offset > 0) :] = [offset + r["first_n"]]
        first = len(spans) - 1
        spans += [r["last_n"]] * (r["groups"] > 1)
        of[r["part"]] = (offset, first, len(spans) - 1)
        last = r
    return {p: (offset, spans[a], spans[b]) for p, (offset, a, b) in of.items()}


def node_records(ordered: DataFrame, sums: list) -> DataFrame:
    """(group, level, run, at, children, whole, total, ids, held) of every partition's mountain ranges."""
    id_field, at_edges = ordered.schema["id"], edges(sums)
    fields = [T.StructField("group", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("children", T.BinaryType()), T.StructField("whole", T.BooleanType()), T.StructField("total", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(id_field.dataType)), T.StructField("held", T.ArrayType(T.BinaryType()))]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.int64()]

    def run(batches):
        offset, first_total, last_total = at_edges.get(TaskContext.get().partitionId(), (0, 0, 0))
        mountain, group, n_groups, out, id_kind = None, None, 0, [], None

        def records() -> pa.RecordBatch:
            ids = pa.array([r and [x[0] for x in r] for *_, r in out], pa.list_(id_kind))
            held = pa.array([r and [x[1] for x in r] for *_, r in out], pa.list_(pa.binary()))
            columns = zip(*(r[:7] for r in out), strict=True)
            batch = pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), ids, held], names=[f.name for f in fields])
            out.clear()
            return batch

        def finished(known: int | None) -> None:
            """The open range is done: of `known` leaves, or of those that were here."""
            made: list[list] = mountain.out
            mountain.close(mountain.next if known is None else known)
            out.extend([group, *r] for r in made)
            made.clear()

        for b in batches:
            id_kind, at = b.schema.field(1).type, 0
            ids, leaves, held = (b.column(k).to_pylist() for k in (1, 2, 3))
            for name, n in zip(*_stretches(b.column(0)), strict=True):
                if mountain is None or name != group:
                    if mountain is not None:
                        finished(first_total if n_groups == 1 else None)
                    group, n_groups = name, n_groups + 1
                    mountain = Range(offset if n_groups == 1 else 0, [])
                for k in range(at, at + n):
                    mountain.add(leaves[k], (ids[k], held[k]))
                at += n
                out.extend([group, *r] for r in mountain.out)
                mountain.out.clear()
                if len(out) >= BATCH:
                    yield records()
        if mountain is not None:
            finished(last_total)
            if out:
                yield records()

    return ordered.select("group", "id", "leaf", "held").mapInArrow(run, T.StructType(fields))


def grow(leaves: DataFrame) -> list[DataFrame]:
    """Trees over (group string, id, leaf, held, row long), one for each group, by id, leaf and row. Returns their node records by level."""
    order = ("group", "id", "leaf", "row")
    ordered = checkpoint(leaves.repartitionByRange(*order).sortWithinPartitions(*order))
    sums = _summaries(ordered)  # a row for each partition
    most = max([r["most"] for r in sums] + [n for x in edges(sums).values() for n in x[1:]], default=0)
    records = checkpoint(node_records(ordered, sums))
    in_pieces = {r["level"] for r in records.where(~F.col("whole")).select("level").distinct().collect()}  # one row for each level
    levels, carried = [], None
    for level in range(top_level(most) + 1):
        own = records.where(F.col("level") == level)
        runs = own.where("whole").withColumn("digest", F.when(_is_lone(level), F.col("children")).otherwise(joined_digest(F.col("children"))))
        if carried is not None or level in in_pieces:
            pieces = own.where(~F.col("whole"))
            merged = checkpoint(_merge(pieces if carried is None else pieces.unionByName(carried)))
            runs = runs.unionByName(merged)
            up = merged.where(F.col("total") > FANOUT ** (level + 1))
            carried = up.select("group", (F.col("level") + 1).alias("level"), F.floor(F.col("run") / FANOUT).alias("run"), (F.col("run") % FANOUT).cast("int").alias("at"), F.col("digest").alias("children"), F.lit(False).alias("whole"), "total", F.lit(None).cast(records.schema["ids"].dataType).alias("ids"), F.lit(None).cast("array<binary>").alias("held"))
        levels.append(runs.withColumn("top", F.coalesce(F.col("total") <= FANOUT ** (level + 1), F.lit(False))))
    return levels


def _is_lone(level: int) -> Column:
    return F.coalesce(F.col("total") == 1, F.lit(False)) if level == 0 else F.lit(False)


def _merge(pieces: DataFrame) -> DataFrame:
    """Whole runs from their pieces, 16 at most for each."""
    each = F.sort_array(F.collect_list(F.struct("at", "children", "ids", "held")))
    runs = pieces.groupBy("group", "level", "run").agg(each.alias("p"), F.max("total").alias("total"))
    children = F.aggregate("p", F.lit(b""), lambda x, p: F.concat(x, p["children"]))
    flat = lambda c: F.flatten(F.transform("p", lambda p: p[c]))
    runs = runs.select("group", "level", "run", F.lit(0).alias("at"), children.alias("children"), F.lit(True).alias("whole"), "total", flat("ids").alias("ids"), flat("held").alias("held"))
    return runs.withColumn("digest", joined_digest(F.col("children")))


def paths(levels: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """(group, ids, held, children, lone, subroot, path, root) of the leaves' runs. path: [(children, at)] of the runs above, the lowest first.

    above: (group, path, root), what lies above the roots of the groups; else they are the roots.
    """
    step, upper, out = "array<struct<children: binary, at: int>>", None, None
    for level in reversed(range(len(levels))):
        runs = levels[level]
        tops = runs.where("top").withColumn("subroot", F.col("digest"))
        if above is None:
            tops = tops.withColumns({"path": F.array().cast(step), "root": F.col("digest")})
        else:
            a = above.select(F.col("group").alias("_g"), "path", "root")
            tops = tops.join(a, F.col("group").eqNullSafe(F.col("_g"))).drop("_g")
        out = tops
        if upper is not None:
            u = upper.select(F.col("group").alias("_g"), F.col("run").alias("_run"), F.col("children").alias("_c"), "subroot", F.col("path").alias("_p"), "root")
            low = runs.where(~F.col("top")).join(u, F.col("group").eqNullSafe(F.col("_g")) & (F.floor(F.col("run") / FANOUT) == F.col("_run")))
            one = F.array(F.struct(F.col("_c").alias("children"), (F.col("run") % FANOUT).cast("int").alias("at")))
            out = tops.unionByName(low.withColumn("path", F.concat(one, "_p").cast(step)).select(*tops.columns))
        if level:
            upper = checkpoint(out.select("group", "run", "children", "subroot", "path", "root"))
    return out.withColumn("lone", _is_lone(0)).select("group", "ids", "held", "children", "lone", "subroot", "path", "root")


@dataclass(frozen=True)
class Manifest:
    """Node records of the sources' trees by level, of the tree over sources, and the leaves' runs with all that lies above."""

    levels: list[DataFrame]
    top_levels: list[DataFrame]
    leaf_paths: DataFrame

    def nodes(self) -> DataFrame:
        """(tree, group, level, run, digest, children, n_leaves) of every run, to be stored as the manifest; tree: `source` or `dataset`."""
        out = None
        for tree, levels in (("source", self.levels), ("dataset", self.top_levels)):
            for level in levels:
                rows = level.select(F.lit(tree).alias("tree"), "group", "level", "run", "digest", "children", F.size("ids").alias("n_leaves"))
                out = rows if out is None else out.unionByName(rows)
        return out


def build(records: DataFrame) -> Manifest:
    """The manifest of (group string, id, leaf, held): sources' trees, and one tree over their roots.

    Groups ascend in the order of their UTF-8 bytes, null first; leaves by id (null
    first), then by digest. held: the digest of what a checker holds in place of
    a record, or null if it is the record. Defined cases: records with one id are leaves
    of their own; a group of one leaf has that leaf as its root, and a manifest of
    one group that group's root; an empty table has no nodes.
    """
    leaves = checkpoint(records.select("group", "id", "leaf", "held", F.monotonically_increasing_id().alias("row")))  # each record is read once
    levels = grow(leaves)
    if not levels:
        return Manifest([], [], None)
    subroots = None
    for level in levels:
        rows = level.where("top").select("group", "digest")
        subroots = rows if subroots is None else subroots.unionByName(rows)
    tops = grow(subroots.select(F.lit("").alias("group"), F.col("group").alias("id"), F.col("digest").alias("leaf"), F.lit(None).cast("binary").alias("held"), F.lit(0).cast("long").alias("row")))
    of_source = paths(tops).select(F.posexplode("ids").alias("at", "group"), "children", "lone", "path", "root")
    own = F.array(F.struct("children", "at")).cast("array<struct<children: binary, at: int>>")
    above = checkpoint(of_source.select("group", F.when(F.col("lone"), F.col("path")).otherwise(F.concat(own, "path")).alias("path"), "root"))
    return Manifest(levels, tops, paths(levels, above))


PROOF = [T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")] + [T.StructField("verified", T.BooleanType())]


def prove(manifest: Manifest, empty: DataFrame) -> DataFrame:
    """(id, group, leaf, subroot, root, proof_sha256, folded_root, verified) of every record.

    proof_sha256: the digest of all siblings on the way to the root, level by level
    and left to right. folded_root: the root that the held digest (else the leaf) leads to
    with those siblings; verified: it is the root. `empty` has the schema of the records.
    """
    id_field, group = empty.schema["id"], T.StructField("group", T.StringType())
    schema = T.StructType([id_field, group, *PROOF])
    if manifest.leaf_paths is None:
        return empty.sparkSession.createDataFrame([], schema)

    def run(batches):
        for b in batches:
            out, at = [[] for _ in PROOF], []
            ids, id_kind = [], b.schema.field(1).type.value_type
            for i, (_, own, held, children, lone, subroot, path, root) in enumerate(values_of(b)):
                digests, root = children.hex(), root.hex()
                above = [(x["children"].hex(), x["at"]) for x in path]
                rest = "".join(c[: 64 * k] + c[64 * k + 64 :] for c, k in above)  # the siblings that the whole run shares
                for k, (id_, other) in enumerate(zip(own, held, strict=True)):
                    leaf_digest = digests[64 * k : 64 * k + 64]
                    siblings = digests[: 64 * k] + digests[64 * k + 64 :] + rest
                    folded = leaf_digest if other is None else other.hex()
                    for c, place in [(digests, k)] * (not lone) + above:
                        folded = _digest(c[: 64 * place] + folded + c[64 * place + 64 :])
                    ids.append(id_)
                    at.append(i)
                    for column, x in zip(out, (leaf_digest, subroot.hex(), root, _digest(siblings), folded, folded == root), strict=True):
                        column.append(x)
            groups = b.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_kind), groups, *(pa.array(c, pa.string()) for c in out[:-1]), pa.array(out[-1], pa.bool_())], names=schema.names)

    return manifest.leaf_paths.mapInArrow(run, schema)


def values_of(b: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch, some at a time."""
    for k in range(0, b.num_rows, 256):
        yield from zip(*(c.slice(k, 256).to_pylist() for c in b.columns), strict=True)


def prove_documents(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "source", held: dict[str, Column] | None = None) -> DataFrame:
    """prove() of a table's rows: a leaf is made of `columns`; held: columns as a checker holds them, where they are not as recorded.

    A row is read once and its text isn't shuffled, only its digests.
    """
    plain = [F.col(quoted(c)) for c in columns]
    changed = leaf(*((held or {}).get(c, x) for c, x in zip(columns, plain, strict=True))) if held else F.lit(None).cast("binary")
    records = docs.select(F.col(quoted(group_col)).cast("string").alias("group"), F.col(quoted(id_col)).alias("id"), leaf(*plain).alias("leaf"), changed.alias("held"))
    return prove(build(records), records.limit(0))
