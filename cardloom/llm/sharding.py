"""Sharding by fixed virtual slots.

A record belongs to one of thousands of virtual slots for ever: ``hash(id, text) mod slots``. Only the map from
slot to shard changes, and every change makes a new version of it. Bytes are summed per slot (a table of at
most ``slots`` rows), and the map is made, or edited, from those sums alone; records are never compared with
one another, so a hot source or a group of copies spreads over all slots.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 8192
#: Bytes that a record costs besides its text.
OVERHEAD = 8


def virtual_slot(key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> Column:
    """Virtual slot of a record. The text counts as well, so the records of an id that many share spread over all slots."""
    return F.pmod(F.xxhash64(F.col(key).isNull(), F.col(key), F.col(text)), F.lit(slots)).cast("int")


def record_bytes(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + OVERHEAD).cast("long")


@dataclass
class SlotMap:
    """One version of the slot-to-shard map: ``owner[slot]`` is a shard, ``load[slot]`` the slot's bytes."""

    owner: list[int]
    load: list[int]
    shards: int
    version: int = 1
    edits: list[str] = field(default_factory=list)

    @classmethod
    def balanced(cls, load: list[int], shards: int) -> SlotMap:
        """Largest slot first, each to the shard with the fewest bytes (ties: the lowest number)."""
        heap = [(0, s) for s in range(shards)]
        owner = [0] * len(load)
        for slot in sorted(range(len(load)), key=lambda i: (-load[i], i)):
            total, shard = heapq.heappop(heap)
            owner[slot] = shard
            heapq.heappush(heap, (total + load[slot], shard))
        return cls(owner, load, shards, edits=["created"])

    def totals(self) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.owner):
            out[shard] += self.load[slot]
        return out

    def rebalance(self, load: list[int], tolerance: float = 0.01) -> SlotMap:
        """The next version, for new sums: as few slots as needed move from the fullest to the emptiest shard."""
        owner, new = list(self.owner), SlotMap(list(self.owner), load, self.shards, self.version + 1, [])
        totals, mean = new.totals(), sum(load) / max(1, self.shards)
        by_shard: list[list[int]] = [[] for _ in range(self.shards)]
        for slot in sorted(range(len(load)), key=lambda i: (load[i], i)):
            by_shard[owner[slot]].append(slot)
        for _ in range(len(load)):
            full, empty = max(range(self.shards), key=totals.__getitem__), min(range(self.shards), key=totals.__getitem__)
            gap = totals[full] - totals[empty]
            if gap <= tolerance * mean:
                break
            fitting = [s for s in by_shard[full] if 0 < load[s] < gap]
            if not fitting:
                break
            slot = min(fitting, key=lambda s: (abs(load[s] - gap / 2), s))
            by_shard[full].remove(slot)
            by_shard[empty].append(slot)
            owner[slot] = empty
            totals[full] -= load[slot]
            totals[empty] += load[slot]
            new.edits.append(f"{slot}: {full} -> {empty}")
        new.owner = owner
        return new

    def grow(self) -> SlotMap:
        """The next version, with one more shard: slots move into the new shard only, from the fullest ones."""
        owner, new = list(self.owner), self.shards
        totals = self.totals() + [0]
        want = sum(totals) / (new + 1)
        by_shard: list[list[int]] = [[] for _ in range(new)]
        for slot in sorted(range(len(owner)), key=lambda i: (self.load[i], i)):
            by_shard[owner[slot]].append(slot)
        edits = []
        while True:
            full = max(range(new), key=totals.__getitem__)
            if not by_shard[full] or totals[new] >= want:
                break
            slot = by_shard[full].pop()
            if totals[new] + self.load[slot] > want * 1.05 and totals[new]:
                break
            owner[slot] = new
            totals[full] -= self.load[slot]
            totals[new] += self.load[slot]
            edits.append(f"{slot}: {full} -> {new}")
        return SlotMap(owner, self.load, new + 1, self.version + 1, edits)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, slot, shard, self.load[slot], self.shards) for slot, shard in enumerate(self.owner)]
        return spark.createDataFrame(rows, "version int, virtual_slot int, shard int, slot_bytes long, shards int")

    def store(self, spark: SparkSession, path: str) -> DataFrame:
        """Keep this version beside the earlier ones under ``path`` and return it as a table."""
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={self.version}")
        return spark.read.parquet(f"{path}/version={self.version}")

    @classmethod
    def stored(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
        """A version of the map under ``path``, the last one by default; None if there is none."""
        try:
            table = spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        version = table.agg(F.max("version")).first()[0] if version is None else version
        rows = table.where(F.col("version") == version).select("virtual_slot", "shard", "slot_bytes", "shards").orderBy("virtual_slot").collect()  # a row for each slot
        return cls([r["shard"] for r in rows], [r["slot_bytes"] for r in rows], rows[0]["shards"], version) if rows else None


def slot_loads(records: DataFrame, slots: int = SLOTS) -> list[tuple[int, int, int]]:
    """``(slot, bytes, rows)`` of the slots in use: at most ``slots`` rows reach the driver, however many records there are."""
    return [tuple(r) for r in records.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect()]


def current_map(spark: SparkSession, load: list[int], shards: int, store: str | None) -> SlotMap:
    """The map for these sums: the stored one, edited where it has become uneven and grown to more shards, or else a
    balanced one. A version that has changed is stored beside the earlier ones."""
    last = SlotMap.stored(spark, store) if store else None
    if last is None:
        chosen = SlotMap.balanced(load, shards)
    elif len(last.owner) != len(load) or last.shards > shards:
        raise ValueError(f"the stored map has {len(last.owner)} slots and {last.shards} shards; slots are fixed, and shards can only be added")
    else:
        chosen = SlotMap(last.owner, load, last.shards, last.version)
        while chosen.shards < shards:
            chosen = chosen.grow()
        edited = chosen.rebalance(load)
        if edited.edits:
            chosen = edited
    if store and (last is None or chosen.version != last.version):
        chosen.store(spark, store)
    return chosen


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS, store: str | None = None) -> DataFrame:
    """Each row of ``docs`` (``doc_id``, ``text``; others are ignored) with its shard, by near-equal bytes.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version``. ``slot`` is
    the row's place in its shard, from 0 without gaps, by virtual slot, then ``doc_id``. A NULL text has size 8
    and the checksum of an empty one; rows without an id are told apart by their text; an empty table gives no row. Each
    row gets one place; repeated rows share a slot and follow one another. ``store`` is the folder of the map's versions:
    the last one is taken and edited for the present bytes. Without it the map is made for this table alone.
    """
    spark = docs.sparkSession
    records = docs.select(
        "doc_id",
        record_bytes().alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        virtual_slot(slots=slots).alias("virtual_slot"),
    )
    sums = slot_loads(records.select("virtual_slot", "size"), slots)
    load, rows = [0] * slots, [0] * slots
    for slot, size, n in sums:
        load[slot], rows[slot] = size, n
    chosen = current_map(spark, load, shards, store)
    before, offset = [0] * shards, [0] * slots
    for slot, owner in enumerate(chosen.owner):
        offset[slot] = before[owner]
        before[owner] += rows[slot]
    # one row per virtual slot: bounded by the fixed number of slots
    places = spark.createDataFrame([(s, chosen.owner[s], offset[s]) for s in range(slots)], "virtual_slot int, shard int, offset long")
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        records.withColumn("place", F.row_number().over(within))
        .join(F.broadcast(places), "virtual_slot")
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(chosen.version).alias("map_version"),
        )
    )
