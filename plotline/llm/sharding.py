"""Sharding by fixed virtual slots.

Records are hashed by id, size and checksum into thousands of virtual slots whose number never changes, so
that rows of a frequent id spread; rows that repeat all three spread by a salt. Bytes and rows
are summed per slot, and a versioned slot-to-shard map says where each slot lives. Rebalancing reads the
newest map and edits it, never the hash: it moves slots from full shards to empty ones, and each edit is a new
version, stored beside the older ones. The map has one row for each slot, however large the table is.

Cases: a null text has size 16 and the checksum of no bytes; null ids are ids like any other; repeated rows
each get a place of their own, in one of SALTS slots; an empty table gives an empty result and an even map.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plotline.llm.common import materialize, shared_dir

VIRTUAL_SLOTS = 8192
ROW_OVERHEAD = 16
SALTS = 1024
EVEN = 0.005  # of the mean: shards that differ from it by no more stay as they are
WORTH_MOVING = 0.9  # an edit is made if it leaves less than this of the unevenness


def virtual_slot(*key: str | Column, slots: int = VIRTUAL_SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def initial_map(shards: int, slots: int = VIRTUAL_SLOTS) -> list[int]:
    """Version 0: slots dealt out in turn."""
    return [s % shards for s in range(slots)]


def rebalance(owner: list[int], weight: dict[int, int], shards: int) -> list[int]:
    """The next version of the map: sizes near equal, by editing only slots that have to move.

    Each shard keeps its slots, largest first, while they fit under the mean; the slots left over go,
    largest first, to the emptiest shard. ``shards`` may be larger or smaller than before.
    """
    target = sum(weight.values()) / shards
    load, new, over = [0] * shards, list(owner), []
    for slot in sorted(range(len(owner)), key=lambda s: (-weight.get(s, 0), s)):
        at, size = owner[slot], weight.get(slot, 0)
        if at < shards and load[at] + size <= target:
            load[at] += size
        else:
            over.append(slot)
    heap = [(load[k], k) for k in range(shards)]
    heapq.heapify(heap)
    for slot in over:
        size, at = heapq.heappop(heap)
        new[slot] = at
        heapq.heappush(heap, (size + weight.get(slot, 0), at))
    return new


def unevenness(owner: list[int], weight: dict[int, int], shards: int) -> float:
    """How far the fullest or emptiest shard is from the mean; infinite if slots live in a shard that is no more."""
    if max(owner) >= shards:
        return float("inf")
    load = [0] * shards
    for slot, at in enumerate(owner):
        load[at] += weight.get(slot, 0)
    mean = sum(load) / shards
    return max(max(load) - mean, mean - min(load))


def store_map(spark: SparkSession, path: str, version: int, owner: list[int]) -> None:
    """Write one version beside those that ``path`` has; a version that is there already is an error, so two edits can't both win."""
    rows = [(s, k) for s, k in enumerate(owner)]
    spark.createDataFrame(rows, "virtual_slot int, shard int").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def read_maps(spark: SparkSession, path: str) -> DataFrame | None:
    """``virtual_slot, shard, version`` of all versions; None if there are none."""
    try:
        return spark.read.schema("virtual_slot int, shard int, version int").option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def latest_map(spark: SparkSession, path: str) -> tuple[int, list[int]] | None:
    """The newest version and its shards by slot, a row for each slot."""
    maps = read_maps(spark, path)
    last = maps.agg(F.max("version")).first()[0] if maps is not None else None
    if last is None:
        return None
    rows = {r.virtual_slot: r.shard for r in maps.where(F.col("version") == last).collect()}
    return last, [rows[s] for s in range(len(rows))]


@dataclass(frozen=True)
class Edit:
    """What a rebalancing did: the version it made (or found good), and the slots and bytes that change their shard."""

    version: int
    moved_slots: int
    moved_bytes: int
    total_bytes: int


def edit_map(spark: SparkSession, path: str, weight: dict[int, int], shards: int, slots: int = VIRTUAL_SLOTS) -> tuple[Edit, list[int]]:
    """Rebalance the newest map below ``path`` (the even one if there is none) and store it as the next version.

    A map that is even, or that rebalancing would not make clearly more even, stays as it is.
    """
    found = latest_map(spark, path)
    if found is None:
        found = 0, initial_map(shards, slots)
        store_map(spark, path, *found)
    version, owner = found
    if len(owner) != slots:
        raise ValueError(f"the stored map has {len(owner)} virtual slots, which never change; asked for {slots}")
    new = rebalance(owner, weight, shards)
    now = unevenness(owner, weight, shards)
    if now <= EVEN * sum(weight.values()) / shards or unevenness(new, weight, shards) > WORTH_MOVING * now:
        new = owner
    moved = [s for s in range(slots) if new[s] != owner[s]]
    if moved:
        version += 1
        store_map(spark, path, version, new)
    return Edit(version, len(moved), sum(weight.get(s, 0) for s in moved), sum(weight.values())), new


def shard(docs: DataFrame, shards: int = 40, slots: int = VIRTUAL_SLOTS, map_path: str | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot, map_version, shard, slot`` of every row; see :func:`place`."""
    return place(docs, shards, slots, map_path)[0]


def place(docs: DataFrame, shards: int = 40, slots: int = VIRTUAL_SLOTS, map_path: str | None = None) -> tuple[DataFrame, Edit]:
    """``doc_id, size, text_crc32, virtual_slot, map_version, shard, slot`` of every row, and what the map's edit moved.

    The map below ``map_path`` is read, rebalanced to the rows' sizes and to ``shards``, and stored as a new version
    beside the old ones; a path without a map, or no path, starts one. ``slot`` is the row's place within its shard,
    gapless from 0: the place within the virtual slot (a window over a few thousandths of the rows) after the rows of
    the shard's earlier virtual slots (a running sum over the map). Only ids, sizes and checksums are shuffled.
    """
    spark = docs.sparkSession
    record = ["doc_id", "size", "text_crc32"]
    rows = materialize(
        docs.select(
            F.col("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("text_crc32"),
            F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt"),
        )
    )
    repeated = rows.groupBy(*record).agg(F.count("*").alias("n")).where("n > 1").select(*(F.col(c).alias(f"r_{c}") for c in record), F.lit(True).alias("again"))
    same = F.expr(" and ".join(f"{c} <=> r_{c}" for c in record))
    salted = rows.join(repeated, same, "left").select(*record, F.when(F.col("again"), F.col("salt")).otherwise(0).alias("salt"))
    rows = materialize(salted.select(*record, virtual_slot(*record, "salt", slots=slots).alias("virtual_slot")))
    usage = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()  # one row a slot
    path = map_path or shared_dir(spark)
    edit, owner = edit_map(spark, path, {u.virtual_slot: u.bytes for u in usage}, shards, slots)
    count, before, at = {u.virtual_slot: u.rows for u in usage}, [], [0] * shards
    for s, k in enumerate(owner):
        before.append((s, at[k]))
        at[k] += count.get(s, 0)
    live = read_maps(spark, path).where(F.col("version") == edit.version).join(F.broadcast(spark.createDataFrame(before, "virtual_slot int, rows_before long")), "virtual_slot")
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")) - 1
    placed = (
        rows.withColumn("_within", within)
        .join(F.broadcast(live), "virtual_slot")  # as many rows as virtual slots
        .select("doc_id", "size", "text_crc32", "virtual_slot", F.col("version").alias("map_version"), "shard", (F.col("rows_before") + F.col("_within")).alias("slot"))
    )
    return placed, edit
