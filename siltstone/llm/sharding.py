"""Fixed virtual slots (operator 3).

Records hash into thousands of slots whose number never changes. Bytes are
summed for each slot, and a small versioned table says which shard each slot
belongs to. Rebalancing and growing edit that table: the next version moves whole
slots, and only as many as it must; all versions stay in the table.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.columns import quoted
from siltstone.llm.scratch import Scratch, exists

SLOTS = 4096
#: Places in a shard are counted in runs of about so many rows.
RUN_ROWS = 20_000
ROW_BYTES = 16
#: Shards whose bytes differ by less than this share of their mean are even.
UNEVEN = 0.001
MAP_SCHEMA = "virtual_slot int, shard int, bytes bigint, version int"
#: A version of the map: each slot's shard and bytes.
SlotMap = dict[int, tuple[int, int]]


def slot_of(*keys: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def dealt_map(shards: int, slots: int = SLOTS) -> SlotMap:
    """Slots dealt to shards in turn, before any bytes are known."""
    return {slot: (slot % shards, 0) for slot in range(slots)}


def with_sizes(latest: SlotMap, sizes: dict[int, int]) -> SlotMap:
    return {slot: (shard, sizes.get(slot, 0)) for slot, (shard, _) in latest.items()}


def _by_shard(latest: SlotMap) -> dict[int, list[tuple[int, int]]]:
    held = defaultdict(list)
    for slot, (shard, size) in latest.items():
        held[shard].append((size, slot))
    return held


def rebalanced_map(latest: SlotMap, uneven: float = UNEVEN) -> SlotMap:
    """Slots move from the fullest shard to the emptiest until both are even.

    Each step moves the slot, or swaps the two slots, that halves the gap of the two
    shards best; it ends where no step narrows it.
    """
    held, out = _by_shard(latest), dict(latest)
    loads = {shard: sum(size for size, _ in own) for shard, own in held.items()}
    while True:
        full, empty = max(loads, key=lambda s: (loads[s], s)), min(loads, key=lambda s: (loads[s], s))
        gap = loads[full] - loads[empty]
        if gap <= uneven * sum(loads.values()) / len(loads):
            return out
        give, take = np.array(sorted(held[full])), np.array([(0, -1), *sorted(held[empty])])
        less = give[:, :1] - take[None, :, 0]
        left = np.where((less > 0) & (less < gap), abs(gap - 2 * less), gap)
        a, b = np.unravel_index(left.argmin(), left.shape)
        if left[a, b] >= gap:
            return out
        for (size, slot), source, target in ((give[a].tolist(), full, empty), (take[b].tolist(), empty, full)):
            if slot >= 0:
                held[source].remove((size, slot)), held[target].append((size, slot))
                loads[source] -= size
                loads[target] += size
                out[slot] = (target, size)


def grown_map(latest: SlotMap, shards: int) -> SlotMap:
    """A map of more shards: slots move only into the new ones.

    The fullest old shard gives its largest slot that still fits, until the
    emptiest new shard has its even share.
    """
    held, out = _by_shard(latest), dict(latest)
    share = sum(size for _, size in latest.values()) / shards
    loads = {s: sum(size for size, _ in own) for s, own in held.items()}
    for shard in (s for s in range(shards) if s not in loads):
        got = 0
        while got < share:
            giver = max(loads, key=lambda s: (loads[s], s))
            fits = [x for x in held[giver] if 0 < x[0] and got + x[0] <= share + x[0] / 2]
            if len(held[giver]) < 2 or not fits:
                break
            size, slot = max(fits)
            held[giver].remove((size, slot))
            loads[giver] -= size
            got += size
            out[slot] = (shard, size)
    return out


def stored_versions(spark: SparkSession, path: str, slots: int = SLOTS) -> dict[int, SlotMap]:
    """All versions of the map at ``path``; one that isn't whole is left out."""
    if not exists(spark, path):
        return {}
    out: dict[int, SlotMap] = defaultdict(dict)
    for r in spark.read.schema(MAP_SCHEMA).parquet(path).collect():
        out[r["version"]][r["virtual_slot"]] = (r["shard"], r["bytes"])
    return {version: out[version] for version in sorted(out) if len(out[version]) == slots}


def _store(spark: SparkSession, path: str, version: int, slot_map: SlotMap) -> None:
    table = spark.createDataFrame([(slot, *v) for slot, v in slot_map.items()], MAP_SCHEMA.rsplit(",", 1)[0])
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def grow(spark: SparkSession, path: str, shards: int, slots: int = SLOTS) -> int:
    """Add a version with more shards to the map at ``path``; returns its number."""
    versions = stored_versions(spark, path, slots)
    version, latest = max(versions.items())
    if shards < len({shard for shard, _ in latest.values()}):
        raise ValueError("a map grows; it doesn't shrink")
    _store(spark, path, version + 1, grown_map(latest, shards))
    return version + 1


def with_slots(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Add ``virtual_slot`` and ``place`` to ``doc_id, size, text_crc32``.

    Equal rows of which there are more than a quarter of a slot's even share are
    told apart by their places. There are at most four times as many such groups
    as slots, so they are broadcast.
    """
    n = rows.count()
    heavy = rows.groupBy("doc_id", "text_crc32").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(2, -(-n // (4 * slots))))
    heavy = heavy.select(F.col("doc_id").alias("d"), F.col("text_crc32").alias("c"), "n")
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    placed = placed.join(F.broadcast(heavy), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_crc32") == F.col("c")), "left")
    spread = F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("place"), F.col("n")))
    return placed.withColumn("virtual_slot", slot_of(F.col("doc_id"), F.col("text_crc32"), spread, slots=slots)).drop("d", "c", "n")


def _slot_sizes(rows: DataFrame) -> dict[int, int]:
    # One row for each of a fixed number of slots.
    return {r["virtual_slot"]: r["bytes"] for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect()}


def shard_rows(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Put every row into a shard so that the shards' bytes are nearly equal.

    Returns ``id_col, size, text_crc32, law, shard, slot, grown_shard,
    virtual_slot, map_version, first_shard``. A row's ``size`` is the UTF-8 bytes
    of its text (null: none) and 16 more. Its virtual slot is a hash of its id and
    text, so rows that share an id, or have none, spread. Rows repeated in id and
    text so often that one slot of them would be heavy spread too, by their places.
    ``slot`` is a row's place in its shard, from 0 without gaps.

    The map at ``map_path`` is read and edited: it grows to ``shards`` if it has
    fewer, and slots move where the bytes have become uneven; each edit is a new
    version beside the ones before. Without a map (by default there is none) the
    first version deals slots out in turn and the second evens their bytes.
    ``first_shard`` is the shard by the oldest version. An empty table gives an
    empty one; other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    path = map_path or scratch.path("map")
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows = with_slots(rows, slots)
    rows = scratch.keep(rows, "rows")
    sizes, versions = _slot_sizes(rows), stored_versions(spark, path, slots)
    if not versions:
        versions[1] = with_sizes(dealt_map(shards, slots), sizes)
        _store(spark, path, 1, versions[1])
    latest, held = max(versions), len({shard for shard, _ in versions[max(versions)].values()})
    if held > shards:
        raise ValueError(f"the map at {path} has {held} shards; a map grows, it doesn't shrink")
    known = with_sizes(versions[latest], sizes)
    edited = rebalanced_map(grown_map(known, shards) if held < shards else known)
    if any(edited[slot][0] != shard for slot, (shard, _) in known.items()):
        latest += 1
        versions[latest] = edited
        _store(spark, path, latest, edited)
    first = versions[min(versions)]
    table = spark.createDataFrame([(slot, shard, latest, first[slot][0]) for slot, (shard, _) in versions[latest].items()], "virtual_slot int, shard int, map_version int, first_shard int")
    return place_rows(rows, table, scratch).withColumnRenamed("doc_id", id_col)


def place_rows(rows: DataFrame, table: DataFrame, scratch: Scratch) -> DataFrame:
    """Each row's shard by a version of the map, and its place there.

    Rows are numbered inside runs of a bounded number of rows; only the lengths
    of the runs are summed up over a shard.
    """
    runs = max(1, -(-rows.count() // RUN_ROWS))
    rows = rows.join(F.broadcast(table), "virtual_slot")  # one row for each slot
    rows = rows.withColumn("run", F.pmod(F.xxhash64("place"), F.lit(runs)))
    lengths = scratch.keep(rows.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n")), "lengths")
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = lengths.select(F.col("shard").alias("s"), F.col("run").alias("r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "run").orderBy("place")
    placed = rows.withColumn("at", F.row_number().over(inside) - 1)
    placed = placed.join(starts, (F.col("shard") == F.col("s")) & (F.col("run") == F.col("r")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version", "first_shard")
