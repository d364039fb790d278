"""Sharding by longest-processing-time scheduling."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesignal.llm.common import map_batches, numbered, settle

LARGE_PER_SHARD = 64
BLOCKS = 4096


def least_loaded(sizes, loads: list[tuple[int, int]]):
    """Give each size, largest first, to the least-loaded bin of a heap; yields its bin."""
    heapq.heapify(loads)
    for size in sizes:
        load, at = loads[0]
        heapq.heapreplace(loads, (load + size, at))
        yield at


def group_shards(groups: DataFrame, shards: int) -> DataFrame:
    """Shards for groups (``key``, ``size``): one row per group, with ``shard``.

    Groups of at least a 64th of a shard's share, at most 64 times the shards
    in number, are scheduled exactly on the driver. The others are dealt by a hash
    of their key into 4,096 blocks, whatever the session's settings; each block schedules its groups, sorted by size,
    onto as many bins as there are shards, and the bins of all blocks are then
    scheduled like groups, largest first, on top of the large groups' loads. So
    only bin loads (at most 4,096 blocks times the shards) meet in one place. Within a
    block, loads differ by at most its largest group, a 64th of a shard's share; with
    fewer groups than blocks the schedule is close to that of all groups together.
    """
    spark = groups.sparkSession
    groups = settle(groups.select("key", "size"))
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    large = F.col("size") * (LARGE_PER_SHARD * shards) >= F.lit(total)
    first = sorted(groups.where(large).collect(), key=lambda r: (-r["size"], r["key"]))
    loads = [(0, s) for s in range(shards)]
    placed = [
        (r["key"], s) for r, s in zip(first, least_loaded((r["size"] for r in first), loads), strict=True)
    ]

    small = (
        groups.where(~large)
        .withColumn("block", F.pmod(F.xxhash64("key"), F.lit(BLOCKS)).cast("int"))
        .repartition("block")
        .sortWithinPartitions("block", F.desc("size"), "key")
    )

    def prepare():
        state = {}

        def step(part):
            bins = []
            for block, size in zip(part["block"], part["size"], strict=True):
                if block not in state:
                    state.clear()
                    state[block] = [(0, s) for s in range(shards)]
                heap = state[block]
                load, at = heap[0]
                heapq.heapreplace(heap, (load + size, at))
                bins.append(at)
            return [part["key"], part["size"], part["block"], bins]

        return step

    columns = [("key", "string"), ("size", "bigint"), ("block", "int"), ("bin", "int")]
    small = settle(map_batches(small, prepare, columns, rows=10_000))
    bins = small.groupBy("block", "bin").agg(F.sum("size").alias("size")).collect()
    bins.sort(key=lambda r: (-r["size"], r["block"], r["bin"]))
    of_bin = [
        (r["block"], r["bin"], s)
        for r, s in zip(bins, least_loaded((r["size"] for r in bins), loads), strict=True)
    ]
    of_bin = spark.createDataFrame(of_bin, "block int, bin int, shard int")
    placed = spark.createDataFrame(placed, "key string, shard int")
    return small.join(F.broadcast(of_bin), ["block", "bin"]).select("key", "shard").unionByName(placed)


def shard(docs: DataFrame, shards: int = 24, group: Column | None = None) -> DataFrame:
    """Put all documents into shards of near equal bytes; groups stay together.

    Columns: doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law
    (``bytes``), shard, slot (gapless from 0 in each shard) and grown_shard
    (null: this law promises nothing about more shards). ``group`` is text by
    which documents stay together; equal texts by default.

    A null text has no bytes and is grouped with the empty ones. Repeated rows
    and null ids are placed row by row. A group larger than a shard's share
    makes its shard larger, as it may not be split. An empty table gives an
    empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5((text if group is None else group).cast("binary")).alias("key"),
    )
    placed = group_shards(rows.groupBy("key").agg(F.sum("size").alias("size")), shards)
    rows = rows.join(placed, "key")
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("key")]
    return numbered(rows, ["shard"], order, "slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
