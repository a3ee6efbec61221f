"""Sharding by Karmarkar-Karp differencing: groups of equal texts stay whole, shard sizes end up close.

Groups fall into blocks by a hash of their text (``BLOCK_GROUPS`` groups each on average). In a block the differencing heap
repeatedly takes the two partial partitions with the largest spread and adds them in opposite order, until one is left.
The blocks' partitions, tuples of shard sums, are differenced in the same way, ``FAN`` at a time and level by level, so no
task holds more than a block. A group of more bytes than a shard's share fills its shard alone as far as possible: groups
are never split.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import read
from tessella.session import materialize

SHARDS = 40
BLOCK_GROUPS = 20_000
FAN = 2_000
#: Bytes a document counts besides its text.
ROW_BYTES = 16
#: Rows of one shard that get their slots in one task, on average.
SLOT_ROWS = 100_000


def difference(tuples: np.ndarray) -> np.ndarray:
    """Final shard of each part of each partial partition (partitions, shards), sums in any order.

    Merges are kept as a forest and read back from the root.
    """
    n, k = tuples.shape
    sort = np.argsort(-tuples, axis=1, kind="stable")
    sums: dict[int, np.ndarray] = {i: tuples[i, sort[i]] for i in range(n)}
    heap = [(-(s[0] - s[-1]), i) for i, s in sums.items()]
    heapq.heapify(heap)
    merged: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-both, kind="stable")
        new = n + len(merged)
        merged.append((a, b, order))
        sums[new] = both = both[order]
        heapq.heappush(heap, (-(both[0] - both[-1]), new))
    place: dict[int, np.ndarray] = {heap[0][1]: np.arange(k)}
    for i in range(len(merged) - 1, -1, -1):
        a, b, order = merged[i]
        mine = place.pop(n + i)
        of = np.empty(k, np.int64)
        of[order] = mine
        place[a], place[b] = of, of[::-1]
    out = np.empty((n, k), np.int64)
    for i in range(n):
        out[i, sort[i]] = place[i]
    return out


def _first_level(shards: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "text_key"], ascending=[False, True], ignore_index=True)
        size = rows["bytes"].to_numpy(np.int64)
        tuples = np.zeros((len(size), shards), np.int64)
        tuples[:, 0] = size
        part = difference(tuples)[:, 0]
        return pd.DataFrame({"block": rows["block"], "text_key": rows["text_key"], "bytes": size, "part": part.astype(np.int32)})

    return run


def _next_level(shards: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(rows["block"].to_numpy(np.int64), return_inverse=True)
        sums = np.zeros((len(ids), shards), np.int64)
        np.add.at(sums, (at, rows["part"].to_numpy(np.int64)), rows["bytes"].to_numpy(np.int64))
        place = difference(sums)
        return pd.DataFrame({"above": np.repeat(rows["above"].iloc[0], len(ids) * shards), "block": np.repeat(ids, shards), "part": np.tile(np.arange(shards, dtype=np.int32), len(ids)), "bytes": sums.reshape(-1), "to": place.reshape(-1).astype(np.int32)})

    return run


def assign_groups(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``groups(text_key, bytes)``, one row per group -> (text_key, shard)."""
    spark = groups.sparkSession
    blocks = max(1, math.ceil(groups.count() / BLOCK_GROUPS))
    blocked = groups.select("text_key", "bytes", F.pmod(F.xxhash64("text_key"), F.lit(blocks)).alias("block"))
    parts = materialize(blocked.groupBy("block").applyInPandas(_first_level(shards), "block bigint, text_key binary, bytes bigint, part int"), "parts")
    level = parts.groupBy("block", "part").agg(F.sum("bytes").alias("bytes"))
    mapping = None  # (block, part) of the first level -> (above, part)
    while True:
        rows = level.withColumn("above", F.floor(F.col("block") / FAN))
        up = materialize(rows.groupBy("above").applyInPandas(_next_level(shards), "above bigint, block bigint, part int, bytes bigint, `to` int"), "level")
        step = up.select(F.col("block").alias("at"), F.col("part").alias("at_part"), "above", "to")
        if mapping is None:
            mapping = step.select(F.col("at").alias("block"), F.col("at_part").alias("part"), "above", "to")
        else:
            mapping = mapping.withColumnsRenamed({"above": "at", "to": "at_part"}).join(step, ["at", "at_part"]).select("block", "part", "above", "to")
        if blocks <= FAN:
            break
        blocks = math.ceil(blocks / FAN)
        level = up.groupBy(F.col("above").alias("block"), F.col("to").alias("part")).agg(F.sum("bytes").alias("bytes"))
    return parts.join(mapping, ["block", "part"]).select("text_key", F.col("to").alias("shard"))


def with_slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 in every shard, ordered by hash bucket and then ``order``.

    A shard is cut into buckets by the hash of the ids, whose counts give each its first slot, so no task sorts a whole shard.
    """
    total = rows.count()
    buckets = max(16, math.ceil(total / SLOT_ROWS / SHARDS))
    cut = rows.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = cut.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    in_bucket = F.row_number().over(Window.partitionBy("shard", "__bucket").orderBy(*order))
    return cut.join(first, ["shard", "__bucket"]).withColumn("slot", F.col("__first") + in_bucket - 1).drop("__bucket", "__first")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; rows of equal text share a shard, null and empty text count as equal.

    Repeated rows and null ids take slots of their own. An empty table gives none.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("text_key"))
    rows = materialize(rows, "sizes")
    groups = materialize(rows.groupBy("text_key").agg(F.sum("size").alias("bytes")), "groups")
    placed = materialize(rows.join(assign_groups(groups, shards), "text_key").select("doc_id", "size", "text_crc32", "shard"), "placed")
    return with_slots(placed, ["doc_id", "text_crc32"])


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
