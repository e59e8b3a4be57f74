"""Sharding by fixed virtual slots: rows hash into slots, slots are mapped to shards by weight.

The slot of a row never changes. What changes is the slot-to-shard map, a table
of one row a slot with a version; rebalancing edits that map and moves whole
slots, few of them. A map is read where one is stored, else made and stored. Built from DataFrame functions only; the driver sees one row a slot.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder

SLOTS = 4096


#: A stored map is edited once its fullest shard is so much above the mean.
TOLERANCE = 0.01


def slot_of(*key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def first_map(weights: list[int], shards: int) -> list[int]:
    """Version 1: slots, heaviest first, each to the shard with the fewest bytes so far.

    Of equal weights the lower slot goes first, of equal loads the lower shard is taken. No slots give an empty map.
    """
    heap = [(0, s) for s in range(shards)]
    out = [0] * len(weights)
    for slot in sorted(range(len(weights)), key=lambda s: (-weights[s], s)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + weights[slot], shard))
    return out


def grow(slot_map: list[int], weights: list[int], shards: int) -> list[int]:
    """An edit of the map for more shards: slots move to the new shards only.

    Each new shard takes slots from the fullest old ones while that brings both
    nearer to the mean. Of equal loads the lower shard gives, of equal weights the lower
    slot. An empty map, or no more shards than it has, stays as it is.
    """
    out, loads = list(slot_map), [0] * shards
    own: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(out):
        loads[shard] += weights[slot]
        own[shard].append(slot)
    for x in own:
        x.sort(key=lambda s: (weights[s], -s))
    mean, old = sum(weights) / shards, max(slot_map, default=-1) + 1
    for new in range(old, shards):
        while True:
            full = max(range(old), key=lambda s: (loads[s], -s))
            fits = [s for s in own[full] if loads[new] + weights[s] <= mean and loads[full] - weights[s] >= 0]
            if not fits or loads[full] <= mean:
                break
            slot = fits[-1]
            own[full].remove(slot)
            out[slot], loads[full], loads[new] = new, loads[full] - weights[slot], loads[new] + weights[slot]
    return out


def rebalance(slot_map: list[int], weights: list[int], shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """An edit of the map for changed weights: the fullest shard gives slots to the emptiest while that brings it nearer to the mean.

    Of equal loads the lower shard counts, of equal weights the lower slot; slots without weight stay. An empty map stays empty.
    """
    out, loads = list(slot_map), [0] * shards
    for slot, shard in enumerate(out):
        loads[shard] += weights[slot]
    mean = sum(weights) / shards
    while True:
        full, poor = max(range(shards), key=loads.__getitem__), min(range(shards), key=loads.__getitem__)
        if loads[full] <= mean * (1 + tolerance):
            return out
        room = min(loads[full] - mean, mean - loads[poor])
        fits = [s for s, x in enumerate(out) if x == full and 0 < weights[s] <= room]
        if not fits:
            return out
        slot = max(fits, key=lambda s: (weights[s], -s))
        out[slot] = poor
        loads[full], loads[poor] = loads[full] - weights[slot], loads[poor] + weights[slot]


def store_map(spark: SparkSession, slot_map: list[int], path: str, version: int) -> None:
    """Write one version of the map; earlier versions stay, a version that is there is an error."""
    rows = spark.range(len(slot_map)).select(F.col("id").cast("int").alias("virtual_slot"), _lookup(F.col("id"), slot_map).alias("shard"))
    rows.coalesce(1).write.parquet(f"{path}/version={version:06d}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int]]:
    """(version, map), the newest one if none is asked for; version 0 and no map if nothing is stored."""
    try:
        stored = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
        found = version or stored.agg(F.max("version")).first()[0] or 0
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, []
    return found, [r[1] for r in sorted(stored.filter(F.col("version") == found).select("virtual_slot", "shard").collect())]


def current_map(spark: SparkSession, weights: list[int], shards: int, path: str) -> list[int]:
    """The stored map, edited and stored as a new version where the shards are more or out of balance; made and stored where there is none."""
    version, old = load_map(spark, path)
    new = rebalance(grow(old, weights, shards) if max(old) + 1 < shards else old, weights, shards) if old else first_map(weights, shards)
    if new != old:
        store_map(spark, new, path, version + 1)
    return load_map(spark, path)[1]


def _lookup(slot: Column, slot_map: list[int]) -> Column:
    return F.get(F.expr(f"array({','.join(map(str, slot_map))})"), slot.cast("int"))


def shard_documents(
    docs: DataFrame, shards: int = 8, slots: int = SLOTS, id_col: str = "doc_id", text: str = "text", path: str | None = None
) -> DataFrame:
    """Deal rows to shards of nearly equal bytes.

    A row weighs its text's UTF-8 bytes plus 1; a null text has no bytes. Rows
    hash by id and text, so only equal rows share a slot for sure; null ids and
    texts hash like any other. The map of slots is read from ``path``, edited there
    as a new version if need be, or made there; without a path it is stored in a new
    folder. ``slot`` is the row's place in its shard, from 0 without gaps: slots
    follow each other in order, rows in a slot by id, then by checksum; equal rows
    take their places in any order. Other columns are not read. Very long texts weigh what they are. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    hashed = slot_of(F.col(id_col), F.col(text), slots=slots).alias("virtual_slot")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size")
    rows = docs.select(F.col(id_col).alias("doc_id"), size, F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), hashed)
    found = {r[0]: (r[1], r[2]) for r in docs.select(hashed, size).groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect()}
    weights = [int(found.get(s, (0, 0))[0]) for s in range(slots)]
    slot_map = current_map(spark, weights, shards, path or f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}")
    starts, so_far = [0] * slots, [0] * shards
    for s in range(slots):
        starts[s] = so_far[slot_map[s]]
        so_far[slot_map[s]] += found.get(s, (0, 0))[1]
    inside = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        _lookup(F.col("virtual_slot"), slot_map).alias("shard"),
        (inside - 1 + _lookup(F.col("virtual_slot"), starts)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )
