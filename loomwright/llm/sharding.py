"""Sharding by fixed virtual slots, in DataFrame functions only.

A record's id gives one of thousands of virtual slots, whatever the number of
shards. Bytes and rows are summed per virtual slot; a versioned map says which
shard owns each virtual slot. Version 1 deals the slots out evenly, and each
rebalancing edits the map into the next version, so that few records move. Maps
are stored as (version, slot, shard) rows; a reader finds an id's shard by the
stored map alone.

A hot slot, with more than 1 / (8 * shards) of all bytes or rows (an id that
many rows share, null ids), is not owned by one shard: its rows are dealt out by
row number over the spill slots, which the map holds after the others.

Only the sums of the fixed number of virtual slots reach the driver, never a
row of the data. Places within a shard are gapless: an offset for each virtual
slot, plus the row's rank in its slot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Virtual slots; more of them make smaller groups and a finer balance. SPILL of them more take the rows of hot slots.
N_SLOTS, SPILL = 16384, 4096
#: A hot slot has more than this share of a shard.
HOT_SHARE = 1 / 8


@dataclass(frozen=True)
class SlotMap:
    """owner[v] is the shard of virtual slot v; the spill slots come last."""

    version: int
    n_shards: int
    owner: tuple[int, ...]

    @staticmethod
    def even(n_shards: int, n_slots: int = N_SLOTS + SPILL) -> SlotMap:
        return SlotMap(1, n_shards, tuple(v % n_shards for v in range(n_slots)))

    def loads(self, weight: list[int]) -> list[int]:
        out = [0] * self.n_shards
        for v, s in enumerate(self.owner):
            out[s] += weight[v]
        return out

    def rebalanced(self, weight: list[int]) -> SlotMap:
        """Moves, and then swaps, slots between the fullest and the emptiest shard while the spread shrinks."""
        import bisect

        owner, load = list(self.owner), self.loads(weight)
        held = [sorted((weight[v], v) for v in range(len(owner)) if owner[v] == s and weight[v]) for s in range(self.n_shards)]
        for _ in range(4 * len(owner)):
            hi, lo = max(range(self.n_shards), key=load.__getitem__), min(range(self.n_shards), key=load.__getitem__)
            gap = load[hi] - load[lo]
            best, gain = None, 0  # what to carry from hi to lo, at best gap / 2
            i = bisect.bisect_right(held[hi], (gap // 2, len(owner)))
            for j in (i - 1, i):
                if 0 <= j < len(held[hi]) and (g := min(held[hi][j][0], gap - held[hi][j][0])) > gain:
                    best, gain = (held[hi][j], None), g
            if best is None or gain < gap // 4:
                for x in held[hi]:
                    i = bisect.bisect_left(held[lo], (x[0] - gap // 2, -1))
                    for j in (i - 1, i):
                        if 0 <= j < len(held[lo]) and (g := min(x[0] - held[lo][j][0], gap - x[0] + held[lo][j][0])) > gain:
                            best, gain = (x, held[lo][j]), g
            if best is None:
                break
            for x, a, b in ((best[0], hi, lo), (best[1], lo, hi)):
                if x:
                    held[a].remove(x)
                    bisect.insort(held[b], x)
                    owner[x[1]] = b
                    load[a] -= x[0]
                    load[b] += x[0]
        return SlotMap(self.version + 1, self.n_shards, tuple(owner))

    def grown(self, n_shards: int, weight: list[int]) -> SlotMap:
        """More shards: slots move only into the new ones, from the fullest shard each time."""
        owner, load = list(self.owner), self.loads(weight) + [0] * (n_shards - self.n_shards)
        fair = sum(load) / n_shards
        held = [sorted((weight[v], v) for v in range(len(owner)) if owner[v] == s) for s in range(self.n_shards)]
        for new in range(self.n_shards, n_shards):
            while True:
                hi = max((s for s in range(self.n_shards) if held[s]), key=load.__getitem__, default=None)
                if hi is None or not held[hi][-1][0] or load[new] + held[hi][-1][0] / 2 > fair:
                    break
                w, v = held[hi].pop()
                owner[v], load[hi], load[new] = new, load[hi] - w, load[new] + w
        return SlotMap(self.version + 1, n_shards, tuple(owner))

    def frame(self, spark: SparkSession) -> DataFrame:
        """(slot, shard, n_shards), to be stored beside the shards."""
        return spark.range(len(self.owner)).select(F.col("id").cast("int").alias("slot"), lookup(self.owner, F.col("id")).cast("int").alias("shard"), F.lit(self.n_shards).alias("n_shards"))

    def write(self, spark: SparkSession, path: str) -> None:
        """Stores this version under `path`; other versions stay."""
        self.frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={self.version}")

    @staticmethod
    def read(spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
        """A stored version, the last by default; None where there is none."""
        try:
            stored = spark.read.schema("slot int, shard int, n_shards int, version int").parquet(path)
        except AnalysisException:
            return None
        if version is None:
            version = stored.agg(F.max("version")).first()[0]
        rows = stored.where(F.col("version") == version).orderBy("slot").collect()  # the fixed number of slots
        return SlotMap(version, rows[0]["n_shards"], tuple(r["shard"] for r in rows)) if rows else None


def lookup(values: tuple[int, ...] | list[int], index: Column) -> Column:
    """values[index] from a literal that the optimizer folds once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")[index.cast("int")]


def virtual_slot(id_col: str, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_slots)).cast("int")


def shard_of(id_col: str, slot_map: SlotMap, spill: int = SPILL) -> Column:
    """The shard of an id by the map alone (rows of a hot slot may lie in any)."""
    return lookup(slot_map.owner, virtual_slot(id_col, len(slot_map.owner) - spill)).cast("int")


def slot_sums(records: DataFrame, n_slots: int) -> tuple[list[int], list[int]]:
    """Bytes and rows of each virtual slot."""
    size, rows = [0] * n_slots, [0] * n_slots
    for v, b, n in records.groupBy("_v").agg(F.sum("size"), F.count("*")).collect():  # n_slots rows at most
        size[v], rows[v] = b, n
    return size, rows


def shard_by_slots(
    docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS, spill: int = SPILL, slot_map: SlotMap | None = None, map_path: str | None = None
) -> tuple[DataFrame, SlotMap]:
    """Places (id, size, text_crc32, shard, slot) of all rows, and the map used.

    size: UTF-8 bytes of the text plus 1. slot: the place in the shard, gapless
    from 0. `slot_map` is used as it is. Otherwise the last version stored under
    `map_path`, or else the even map, is rebalanced to the bytes found, stored
    there as the next version, and used as read back; a stored map of more shards, or of
    another number of slots, is an error. Defined cases: a null text
    has size 1 and the checksum of no bytes (0); null and repeated ids and
    repeated rows are rows like any other; an empty table gives no rows. Other
    columns of `docs` are ignored.
    """
    text = F.col(text_col).cast("binary")
    records = docs.select(
        F.col(id_col).alias("_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"),
        virtual_slot(id_col, n_slots).alias("_v"),
        F.monotonically_increasing_id().alias("_row"),
    )
    records = checkpoint(records)  # row numbers hold from here on
    spark = docs.sparkSession
    size, rows = slot_sums(records, n_slots)
    most = HOT_SHARE / (slot_map.n_shards if slot_map else n_shards)
    hot = [v for v in range(n_slots) if rows[v] > 1 and (size[v] > most * sum(size) or rows[v] > most * sum(rows))]
    if hot:  # 16 * n_shards slots at most
        spilt = n_slots + F.pmod(F.xxhash64("_row"), F.lit(spill))
        records = records.withColumn("_v", F.when(F.col("_v").isin(hot), spilt).otherwise(F.col("_v")).cast("int"))
    size, rows = slot_sums(records, n_slots + spill)
    used = slot_map
    if used is None:
        before = (SlotMap.read(spark, map_path) if map_path else None) or SlotMap.even(n_shards, n_slots + spill)
        if before.n_shards > n_shards or len(before.owner) != n_slots + spill:
            raise ValueError(f"the stored map has {before.n_shards} shards and {len(before.owner)} slots, not {n_shards} and {n_slots + spill}")
        if before.n_shards < n_shards:
            before = before.grown(n_shards, size)
        used = before.rebalanced(size)
        if map_path:
            used.write(spark, map_path)
            used = SlotMap.read(spark, map_path, used.version)
    offset, start = [0] * (n_slots + spill), [0] * used.n_shards
    for v, s in enumerate(used.owner):
        offset[v], start[s] = start[s], start[s] + rows[v]
    rank = F.row_number().over(Window.partitionBy("_v").orderBy("_id", "text_crc32", "_row"))
    placed = records.withColumn("slot", (lookup(offset, F.col("_v")) + rank - 1).cast("long"))
    return placed.select(F.col("_id").alias(id_col), "size", "text_crc32", lookup(used.owner, F.col("_v")).cast("int").alias("shard"), "slot"), used
