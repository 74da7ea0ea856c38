"""The most similar vector of a base for each query, exactly, with the base left where it is.

Up to BROADCAST_VECTORS queries are sent to the tasks as one matrix, and the base
streams past it: a task keeps the best match of each query and gives a row for each.

More queries are searched by clusters. Every base vector belongs to the nearest of
some pivots (a bounded sample). A query is searched in the cluster of its nearest
pivot first; members of a cluster lie within its radius of the pivot, so the
triangle inequality says which of the others can hold a nearer one, and only those
are searched. Clusters and the queries sent to them are cut into blocks by hash, so
the work on a hot cluster is spread, and equal vectors are one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Queries up to which they are sent to the tasks.
BROADCAST_VECTORS = 50_000
#: Base vectors drawn as pivots, at most; rows of a block of a cluster; rows of base that are multiplied at once.
PIVOTS, BLOCK, ROWS_AT_ONCE = 1024, 4096, 512
#: Cosines are compared to so many digits; what that may change in a distance.
DIGITS, SLACK = 9, 1e-4


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows; a vector of zeros stays."""
    m = np.array(column.to_pylist(), np.float64)
    if not len(m):
        return m.reshape(0, 0)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


class Best:
    """The best match so far of each query: the greatest cosine, of equal ones the least id."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, others: bool) -> None:
        self.ids, self.matrix, self.others = ids, matrix, others
        self.cosine = np.full(len(ids), -np.inf)
        self.match = np.full(len(ids), np.iinfo(np.int64).max)

    def see(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        for k in range(0, len(ids), ROWS_AT_ONCE):
            own = ids[k : k + ROWS_AT_ONCE]
            order = np.argsort(own, kind="stable")
            own = own[order]
            s = np.round(self.matrix @ matrix[k : k + ROWS_AT_ONCE][order].T, DIGITS) + 0.0
            if self.others:
                s[self.ids[:, None] == own] = -np.inf
            at = s.argmax(axis=1)  # the least id of equal ones
            top = s[np.arange(len(at)), at]
            better = (top > self.cosine) | (top == self.cosine) & (own[at] < self.match) & (top > -np.inf)
            self.cosine[better], self.match[better] = top[better], own[at[better]]

    def rows(self) -> pa.RecordBatch:
        some = np.flatnonzero(self.cosine > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[some]), pa.array(self.match[some]), pa.array(self.cosine[some])], names=["id", "match_id", "cosine"])


_FOUND = "id long, match_id long, cosine double"


def _streamed(queries: DataFrame, base: DataFrame, others: bool) -> DataFrame:
    """The queries go to the tasks, the base streams past them."""
    rows = queries.toArrow()  # the caller has counted them
    sent = queries.sparkSession.sparkContext.broadcast((rows.column(0).to_numpy(), _matrix(rows.column(1))))

    def search(batches):
        best = Best(*sent.value, others)
        for b in batches:
            if b.num_rows:
                best.see(b.column(0).to_numpy(), _matrix(b.column(1)))
        yield best.rows()

    return base.mapInArrow(search, _FOUND)


def _distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((m * m).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * (m @ pivots.T), 0))


def _clustered(queries: DataFrame, base: DataFrame, others: bool) -> DataFrame:
    """Queries and base meet by clusters that the triangle inequality leaves open."""
    spark = base.sparkSession
    # Of equal vectors the two least ids are enough: the second one where a query is the first itself.
    firsts = F.slice(F.array_sort(F.collect_set("id")), 1, 2)
    parts = base.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(64)).alias("_k")).agg(firsts.alias("ids"))  # a hot vector's ids in 64 parts
    base = stored(parts.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, 2).alias("ids")))
    sample = base.orderBy(F.xxhash64("v")).limit(PIVOTS).select("v").toArrow().column(0)
    pivots = _matrix(sample)
    sent = spark.sparkContext.broadcast(pivots)

    def assign(batches):
        for b in batches:
            if b.num_rows:
                d = _distances(_matrix(b.column(0)), sent.value)
                at = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at), pa.array(d[np.arange(len(at)), at])], names=["v", "ids", "cluster", "far"])

    base = stored(base.mapInArrow(assign, f"v {base.schema['v'].dataType.simpleString()}, ids array<long>, cluster long, far double"))
    sums = base.groupBy("cluster").agg(F.max("far").alias("radius"), F.sum(F.size("ids")).alias("m")).collect()  # PIVOTS rows at most
    numbers, radius, m = (np.array([r[c] for r in sums], t) for c, t in (("cluster", np.int64), ("radius", float), ("m", np.int64)))

    vector = queries.schema["v"].dataType.simpleString()

    def home(batches):
        """The nearest cluster that has a match for sure."""
        for b in batches:
            if b.num_rows and (m > others).any():
                d = _distances(_matrix(b.column(1)), sent.value[numbers])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers[np.where(m > others, d, np.inf).argmin(axis=1)])], names=["id", "v", "cluster"])

    def still_open(batches):
        """The other clusters that can hold something nearer than what was found at home."""
        for b in batches:
            if b.num_rows and len(numbers):
                d = _distances(_matrix(b.column(1)), sent.value[numbers])
                found = np.sqrt(np.maximum(2 - 2 * b.column(3).to_numpy(), 0))
                at, which = np.nonzero((d - radius <= found[:, None] + SLACK) & (numbers != b.column(2).to_numpy()[:, None]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(numbers[which])], names=["id", "v", "cluster"])

    at_home = stored(queries.select("id", "v").mapInArrow(home, f"id long, v {vector}, cluster long"))
    first = stored(_meet(at_home, base, others))
    bounds = first.groupBy("id").agg(F.max("cosine").alias("cosine"))
    # A query whose home held no other vector than its own keeps every cluster open.
    known = at_home.join(bounds, "id", "left").select("id", "v", "cluster", F.coalesce("cosine", F.lit(-1.0)).alias("cosine"))
    rest = stored(known.mapInArrow(still_open, f"id long, v {vector}, cluster long"))
    return first.unionByName(_meet(rest, base, others))


def _meet(queries: DataFrame, base: DataFrame, others: bool) -> DataFrame:
    """Best matches of (id, v, cluster) in the base's vectors of that cluster, block by block on both sides."""
    sizes = base.groupBy("cluster").agg(F.count("*").alias("n_b")).join(queries.groupBy("cluster").agg(F.count("*").alias("n_q")), "cluster")
    cuts = F.broadcast(sizes.select("cluster", F.ceil(F.col("n_b") / BLOCK).alias("b_blocks"), F.ceil(F.col("n_q") / BLOCK).alias("q_blocks")))  # PIVOTS rows at most
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = base.join(cuts, "cluster").select("v", "ids", "cluster", F.pmod(F.xxhash64("v"), F.col("b_blocks")).alias("bb"), every("q_blocks").alias("qb"))
    right = queries.join(cuts, "cluster").select("v", "id", "cluster", F.pmod(F.xxhash64("id"), F.col("q_blocks")).alias("qb"), every("b_blocks").alias("bb"))

    def search(b: pa.Table, q: pa.Table) -> pa.Table:
        best = Best(q.column("id").to_numpy(), _matrix(q.column("v")), others)
        if q.num_rows and b.num_rows:
            ids = b.column("ids").to_pylist()
            best.see(np.array([i for x in ids for i in x], np.int64), np.repeat(_matrix(b.column("v")), [len(x) for x in ids], axis=0))
        return pa.Table.from_batches([best.rows()])

    keys = ["cluster", "bb", "qb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, _FOUND)


def nearest(queries: DataFrame, base: DataFrame, id_col: str, vec_col: str, others: bool = False) -> DataFrame:
    """(id, match_id, cosine) of every query that has a vector and a match. Ids are whole numbers.

    others: a query's own id in the base is no match. Null vectors and null ids of the
    base are left out; a vector of zeros has the cosine 0 with all.
    """
    named = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id is not null and v is not null")
    queries, base = named(queries), named(base)
    if queries.count() <= BROADCAST_VECTORS:
        found = _streamed(queries, base, others)
    else:
        is_zero = F.forall("v", lambda x: x == 0)
        found = _clustered(queries.where(~is_zero), base.where(~is_zero), others)
        # Zeros: two least ids answer for them on either side.
        least = lambda df: [r["id"] for r in df.select("id").distinct().orderBy("id").limit(2).collect()]
        for side, ids in ((queries.where(~is_zero), least(base.where(is_zero))), (queries.where(is_zero), least(base))):
            for i in ids:
                rows = side.select("id", F.lit(i).cast("long").alias("match_id"), F.lit(0.0).alias("cosine"))
                found = found.unionByName(rows.where("id <> match_id") if others else rows)
    best = F.max_by("match_id", F.struct("cosine", -F.col("match_id")))
    return found.groupBy("id").agg(best.alias("match_id"), F.max("cosine").alias("cosine"))
