"""Sharding over fixed virtual slots.

Rows are hashed into a fixed number of virtual slots, bytes and rows are summed per slot,
and a map says which shard a slot belongs to. Only the map changes when shards are
rebalanced or added, so a row moves only when its slot moves. Every version of the map is
kept. A map has one row per slot (``SLOTS`` rows at most), which bounds what is collected
and broadcast whatever the size of the table.
"""

import heapq
import uuid

import pyspark.sql.functions as F
from pyspark.sql import Window

from ..session import shared_folder
from .common import text_bytes, without

SLOTS = 8192
ADDED = ("size", "text_crc32", "virtual_slot", "shard", "slot", "map_version")


def slotted(docs, slots=SLOTS):
    """Size, text checksum and virtual slot of each row.

    The slot hashes ``doc_id`` and the text checksum, so rows without an id still spread.
    A null text counts as empty: size 16, checksum 0. Identical rows share a slot.
    """
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")))
    out = without(docs, *ADDED)
    return (out.withColumn("size", text_bytes() + 16).withColumn("text_crc32", crc)
            .withColumn("virtual_slot", F.pmod(F.xxhash64(F.col("doc_id"), F.col("text_crc32")), F.lit(slots)).cast("int")))


def slot_totals(slot_rows, slots=SLOTS):
    """[(bytes, rows)] by virtual slot; at most ``slots`` rows reach the driver."""
    out = [(0, 0)] * slots
    for r in slot_rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        out[r["virtual_slot"]] = (r["b"], r["n"])
    return out


def first_map(shards, slots=SLOTS):
    """Version 0: slots dealt out in turn."""
    return [s % shards for s in range(slots)]


def rebalance(owner, weight, shards):
    """Edits of a map, ``{slot: new shard}``, that level the shards' weights.

    Overfull shards give up slots that fit their excess, largest first; those go, again
    largest first, to the lightest shard; then single moves from the heaviest to the
    lightest shard go on while they narrow the gap. Slots that need not move stay.
    """
    load, own = [0] * shards, [[] for _ in range(shards)]
    for slot, shard in enumerate(owner):
        if shard < shards:
            load[shard] += weight[slot]
            own[shard].append(slot)
    mean, loose = sum(weight) / shards, [s for s, shard in enumerate(owner) if shard >= shards]
    for shard in range(shards):
        keep = []
        for slot in sorted(own[shard], key=lambda s: (-weight[s], s)):
            if weight[slot] and load[shard] - weight[slot] >= mean or weight[slot] > mean < load[shard] and keep:
                load[shard] -= weight[slot]
                loose.append(slot)
            else:
                keep.append(slot)
        own[shard] = keep
    # one more slot from each shard over the mean lets the filling below even out the rest
    for shard in range(shards):
        for slot in sorted(own[shard], key=lambda s: (-weight[s], s))[:4] if load[shard] > mean else []:
            if len(own[shard]) > 1:
                load[shard] -= weight[slot]
                own[shard].remove(slot)
                loose.append(slot)
    heap = [(load[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda s: (-weight[s], s)):
        w, shard = heapq.heappop(heap)
        own[shard].append(slot)
        heapq.heappush(heap, (w + weight[slot], shard))
    load = [sum(weight[s] for s in o) for o in own]
    for _ in range(4 * shards):
        top, low = max(range(shards), key=lambda s: load[s]), min(range(shards), key=lambda s: load[s])
        gap = load[top] - load[low]
        moves = [s for s in own[top] if 0 < weight[s] < gap]
        if not moves:
            break
        slot = min(moves, key=lambda s: (abs(gap - 2 * weight[s]), s))
        own[top].remove(slot)
        own[low].append(slot)
        load[top] -= weight[slot]
        load[low] += weight[slot]
    new = {slot: shard for shard in range(shards) for slot in own[shard]}
    return {slot: shard for slot, shard in sorted(new.items()) if owner[slot] != shard}


def grow(owner, weight, shards):
    """Edits that add one shard: each old shard gives it slots up to its share, no others move."""
    new, target = {}, sum(weight) / (shards + 1)
    load = [0] * shards
    for slot, shard in enumerate(owner):
        load[shard] += weight[slot]
    for slot in sorted(range(len(owner)), key=lambda s: (-weight[s], s)):
        if load[owner[slot]] - weight[slot] >= target:
            load[owner[slot]] -= weight[slot]
            new[slot] = shards
    return new


def map_frame(spark, owner, totals, version):
    """The map as a table: slot, shard, version, bytes, rows and the rows of its shard's earlier slots."""
    before, rows = {}, []
    for slot, shard in enumerate(owner):
        b, n = totals[slot]
        rows.append(f"{slot},{shard},{version},{b},{n},{before.get(shard, 0)}")
        before[shard] = before.get(shard, 0) + n
    text = spark.range(1).select(F.explode(F.split(F.lit(";".join(rows)), ";")).alias("r"))
    part = F.split("r", ",")
    return text.select(*[part[i].cast(t).alias(c) for i, (c, t) in enumerate(
        [("virtual_slot", "int"), ("shard", "int"), ("map_version", "int"), ("slot_bytes", "long"), ("slot_rows", "long"), ("rows_before", "long")])])


def save_map(frame, folder):
    """Append a version to the folder of maps; earlier versions stay readable."""
    frame.coalesce(1).write.mode("append").partitionBy("map_version").parquet(folder)


def load_map(spark, folder, version=None):
    maps = spark.read.parquet(folder)
    if version is None:
        version = maps.agg(F.max("map_version")).first()[0]
    return maps.filter(F.col("map_version") == version)


def balanced_map(spark, slot_rows, shards, folder, slots=SLOTS):
    """Versions 0 (dealt in turn) and 1 (levelled by bytes) of the map; returns the second."""
    totals = slot_totals(slot_rows, slots)
    owner = first_map(shards, slots)
    save_map(map_frame(spark, owner, totals, 0), folder)
    for slot, shard in rebalance(owner, [b for b, _ in totals], shards).items():
        owner[slot] = shard
    save_map(map_frame(spark, owner, totals, 1), folder)
    return load_map(spark, folder, 1)


def assign(slot_rows, slot_map):
    """Attach shard and map version. The map has one row per virtual slot, so it is broadcast."""
    return slot_rows.join(F.broadcast(slot_map.select("virtual_slot", "shard", "map_version", "rows_before")), "virtual_slot")


def positions(assigned):
    """``slot``: the row's place in its shard, from 0 without gaps.

    Rows are numbered inside their virtual slot and shifted by the rows of the shard's
    earlier slots, so no task sees a whole shard.
    """
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return assigned.withColumn("slot", F.col("rows_before") + F.row_number().over(inside) - 1)


def map_folder(spark):
    return f"{shared_folder(spark)}/slot-maps-{uuid.uuid4().hex}"


def shard_documents(spark, docs, shards, folder=None, slots=SLOTS):
    """All rows of ``docs`` with size, text_crc32, virtual_slot, shard and map_version.

    Shards differ in bytes by less than a slot as long as slots are small against a shard.
    The text is not moved; an empty table gives an empty result; columns of the same names
    are replaced. ``folder`` keeps the versions of the map.
    """
    slot_rows = slotted(docs, slots)
    return assign(slot_rows, balanced_map(spark, slot_rows, shards, folder or map_folder(spark), slots)).drop("rows_before")


def shard_positions(spark, docs, shards, folder=None, slots=SLOTS):
    """``shard_documents`` without the text, with ``slot``: the row's place in its shard."""
    slot_rows = slotted(docs, slots).drop("text")
    return positions(assign(slot_rows, balanced_map(spark, slot_rows, shards, folder or map_folder(spark), slots)))
