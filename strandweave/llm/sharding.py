"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots (thousands). Bytes are summed per slot, the
slot -> shard map is packed from those sums, and the map is a small versioned table: growing
the cluster edits the map (whole slots move, only into the new shard), never the hash.

Only DataFrame operations touch the rows. The driver sees one row per *slot*, a number that is
a parameter and does not grow with the data.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.llm._shared import documents, keep
from strandweave.operators._store import shared_path

SLOTS = 4096
SHARDS = 8
MAP_SCHEMA = "version int, slot int, shard int, slot_bytes long, slot_rows long"


def with_slot(records: DataFrame, key: tuple[str, ...], slots: int = SLOTS, name: str = "virtual_slot") -> DataFrame:
    """Add the virtual slot of each record: a hash of ``key`` (nulls hash like a value of their own)."""
    return records.withColumn(name, F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in key]), F.lit(slots)).cast("int"))


def spread_slot(records: DataFrame, shards: int, slots: int = SLOTS, name: str = "virtual_slot", crc: str = "text_crc32", size: str = "size") -> DataFrame:
    """``with_slot`` by doc_id and ``crc``, but rows of a key that has more than a sixteenth of a shard's bytes are dealt over all slots.

    Such keys (rows that repeat id and text) are fewer than 16 x shards, so they are broadcast.
    Which of the equal rows gets which slot is by place in the table; they are interchangeable.
    """
    keys = records.groupBy("doc_id", crc).agg(F.sum(size).alias("_b"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    total = records.agg(F.sum(size).alias("_all"))
    heavy = keys.crossJoin(F.broadcast(total)).where(F.col("_b") * 16 * shards > F.col("_all"))  # a one-row table
    heavy = heavy.select(F.col("doc_id").alias("__sw_d"), F.col(crc).alias("__sw_c"), F.lit(True).alias("__sw_heavy"))
    rows = records.withColumn("__sw_row", F.monotonically_increasing_id())
    rows = rows.join(F.broadcast(heavy), F.col("doc_id").eqNullSafe(F.col("__sw_d")) & (F.col(crc) == F.col("__sw_c")), "left")
    place = F.when(F.col("__sw_heavy"), F.xxhash64("doc_id", crc, "__sw_row")).otherwise(F.xxhash64("doc_id", crc))
    return rows.withColumn(name, F.pmod(place, F.lit(slots)).cast("int")).drop("__sw_row", "__sw_d", "__sw_c", "__sw_heavy")


def slot_sizes(records: DataFrame, slot: str = "virtual_slot", size: str = "size") -> dict[int, tuple[int, int]]:
    """slot -> (bytes, rows); at most ``slots`` entries, so it may come to the driver."""
    rows = records.groupBy(slot).agg(F.sum(size).alias("b"), F.count(F.lit(1)).alias("n")).collect()
    return {r[slot]: (int(r["b"]), int(r["n"])) for r in rows}


def pack(sizes: dict[int, tuple[int, int]], slots: int, shards: int) -> dict[int, int]:
    """Slot -> shard, largest slot first into the emptiest shard. Empty slots are dealt round robin."""
    if shards < 1:
        raise ValueError("shards must be positive")
    load = [(0, s) for s in range(shards)]
    out = {}
    for slot in sorted(sizes, key=lambda s: (-sizes[s][0], s)):
        used, shard = heapq.heappop(load)
        out[slot] = shard
        heapq.heappush(load, (used + sizes[slot][0], shard))
    for slot in range(slots):
        out.setdefault(slot, slot % shards)
    return out


def grow(mapping: dict[int, int], sizes: dict[int, tuple[int, int]], shards: int) -> dict[int, int]:
    """The next version of the map with one more shard (number ``shards``).

    Each old shard gives up whole slots until it holds its share of the new average; slots move
    into the new shard and nowhere else.
    """
    goal = sum(b for b, _ in sizes.values()) / (shards + 1)
    held: dict[int, list[int]] = {s: [] for s in range(shards)}
    for slot, shard in mapping.items():
        held[shard].append(slot)
    out = dict(mapping)
    for mine in held.values():
        extra = sum(sizes.get(s, (0, 0))[0] for s in mine) - goal
        for slot in sorted(mine, key=lambda s: (-sizes.get(s, (0, 0))[0], s)):
            b = sizes.get(slot, (0, 0))[0]
            if 0 < b <= extra:
                out[slot] = shards
                extra -= b
    return out


def _append(spark: SparkSession, path: str, version: int, mapping: dict[int, int], sizes: dict[int, tuple[int, int]]) -> None:
    rows = [(version, slot, shard, *sizes.get(slot, (0, 0))) for slot, shard in sorted(mapping.items())]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)  # one row per slot


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """The stored slot -> shard map: a row for each version and slot."""
    return spark.read.schema(MAP_SCHEMA).parquet(path)


def create_map(records: DataFrame, path: str, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Store version 0 of the map for ``records(virtual_slot, size)`` at ``path``, which must be new."""
    sizes = slot_sizes(records)
    _append(records.sparkSession, path, 0, pack(sizes, slots, shards), sizes)
    return read_map(records.sparkSession, path)


def grow_map(spark: SparkSession, path: str, records: DataFrame | None = None) -> int:
    """Read the newest version of the stored map, give it one more shard and append the result as the next version, which is returned.

    Sizes are those stored with the map, or those of ``records(virtual_slot, size)`` as they are
    now. Older versions stay, so records can be found under any of them.
    """
    known = read_map(spark, path)
    last = known.agg(F.max("version")).first()[0]
    rows = known.where(F.col("version") == last).collect()  # one row per slot
    sizes = {r["slot"]: (r["slot_bytes"], r["slot_rows"]) for r in rows if r["slot_rows"]} if records is None else slot_sizes(records)
    _append(spark, path, last + 1, grow({r["slot"]: r["shard"] for r in rows}, sizes, max(r["shard"] for r in rows) + 1), sizes)
    return last + 1


def build_map(records: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """A stored map in the shared folder with version 0 (``shards`` shards) and version 1 (one more)."""
    spark = records.sparkSession
    path = shared_path(spark)
    create_map(records, path, shards, slots)
    grow_map(spark, path)
    return read_map(spark, path)


def assign(records: DataFrame, slot_map: DataFrame, version: int, column: str = "shard", slot: str = "virtual_slot") -> DataFrame:
    """Add the shard of each record under one version of the map. The map has one row per slot, so it is broadcast."""
    chosen = slot_map.where(F.col("version") == version).select(F.col("slot").alias("__sw_slot"), F.col("shard").alias(column))
    return records.join(F.broadcast(chosen), F.col(slot) == F.col("__sw_slot"), "left").drop("__sw_slot")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1; 1 for null), text_crc32 (null text counts as empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Every column of ``docs`` plus ``virtual_slot`` and ``shard``; the text is never shuffled.

    Null ids and null texts are records like others; repeated rows share a slot unless they are so
    many that a shard would overflow (see ``spread_slot``); an empty table gives an empty result. A
    column named like an added one is replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = {"__sw_crc": F.crc32(text), "__sw_size": (F.octet_length(text) + 1).cast("long")}
    keyed = spread_slot(docs.drop("virtual_slot", "shard").withColumns(own), shards, slots, crc="__sw_crc", size="__sw_size")
    slot_map = build_map(keyed.select("virtual_slot", F.col("__sw_size").alias("size")), shards, slots)
    return assign(keyed.drop(*own), slot_map, 0)


def op2_virtual_slots(spark: SparkSession, sf_dir: str, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """All documents in shards of near-equal bytes (law ``bytes``).

    ``slot`` numbers the rows of a shard from 0 without gaps: rows before the record's virtual
    slot in its shard (from the map) plus its rank inside the virtual slot, so no window ever
    spans a whole shard. ``rebalanced_shard`` is the shard under the edited map with one more
    shard; ``grown_shard`` belongs to the law ``key`` and is null. Null texts count as empty, null
    ids are a key like others, repeated rows are numbered one by one, an empty table gives none.
    Equal texts are no unit of this law: each row is dealt by id and text, and rows that repeat
    both so often that they weigh on a shard are dealt one by one (``spread_slot``).
    """
    records = keep(spread_slot(keep(sized(documents(spark, sf_dir))), shards, slots))
    slot_map = build_map(records, shards, slots)
    ahead = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = slot_map.where("version = 0").select(
        F.col("slot").alias("_slot"), "shard", F.coalesce(F.sum("slot_rows").over(ahead), F.lit(0)).alias("_ahead")
    )
    grown = slot_map.where("version = 1").select(F.col("slot").alias("_slot"), F.col("shard").alias("rebalanced_shard"))
    placed = placed.join(F.broadcast(grown), "_slot")
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        records.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(F.broadcast(placed), F.col("virtual_slot") == F.col("_slot"))
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("_ahead") + F.col("_rank")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "rebalanced_shard",
        )
    )
