"""Balanced shards by Karmarkar-Karp differencing over indivisible groups.

Documents of equal text form one group and share a shard.  A *partial partition* deals some
groups into ``shards`` subsets, sorted by bytes.  Differencing repeatedly takes the two
partial partitions of largest spread and adds them in opposite order, largest subset to
smallest.  Groups are dealt into hashed blocks of about ``block_groups``; every block is
differenced in a task of its own, then the blocks' partial partitions are differenced in turn,
``fan_in`` at a time, until one is left.  No task ever holds more than one block.

Defined cases: a null text has no bytes and is a group of its own, apart from empty texts;
rows with one doc_id are separate rows; an empty table gives an empty result; a group larger than a fair
share makes its shard larger, as it can't be divided.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadline.llm.common import prefix_sums
from loadline.plans.staging import stage


def difference(partials: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions (rows, each sorted descending).

    Returns the subset sums of the whole, descending, and for every row and subset the
    subset of the whole that it becomes part of.
    """
    n, k = partials.shape
    sums: dict[int, np.ndarray] = dict(enumerate(partials))
    heap = [(int(s[-1] - s[0]), i) for i, s in sums.items()]
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, left = heapq.heappop(heap)
        _, right = heapq.heappop(heap)
        both = sums.pop(left) + sums.pop(right)[::-1]
        order = np.argsort(-both, kind="stable")
        node = n + len(made)
        sums[node] = both[order]
        made.append((left, right, order.astype(np.int16)))
        heapq.heappush(heap, (int(sums[node][-1] - sums[node][0]), node))
    root = heap[0][1]
    labels = {root: np.arange(k, dtype=np.int16)}
    for i in range(len(made) - 1, -1, -1):
        left, right, order = made[i]
        mine = labels.pop(n + i)
        unsorted = np.empty(k, np.int16)
        unsorted[order] = mine
        labels[left], labels[right] = unsorted, unsorted[::-1]
    return sums[root], np.stack([labels[i] for i in range(n)])


def text_group(column: str = "text"):
    """128-bit identity of a text; null texts have their own."""
    return F.coalesce(F.md5(F.col(column).cast("binary")), F.lit("null"))


def place_groups(groups: DataFrame, shards: int, block_groups: int = 20_000, fan_in: int = 500) -> DataFrame:
    """(group, shard) for groups (group, bytes)."""
    groups = stage(groups.select("group", "bytes"), "groups")
    blocks = max(1, -(-groups.count() // block_groups))

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "group"], ascending=[False, True])
        leaves = np.zeros((len(rows), shards), np.int64)
        leaves[:, 0] = rows["bytes"]
        _, to = difference(leaves)
        return pd.DataFrame({"group": rows["group"], "bytes": rows["bytes"], "block": rows["block"], "part": to[:, 0].astype(np.int32)})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(rows["block"].unique())
        at = {b: i for i, b in enumerate(ids)}
        sums = np.zeros((len(ids), shards), np.int64)
        sums[rows["block"].map(at), rows["part"]] = rows["bytes"]
        order = np.argsort(-sums, axis=1, kind="stable")
        _, to = difference(np.take_along_axis(sums, order, 1))
        back = np.empty_like(order)
        np.put_along_axis(back, order, to, 1)
        return pd.DataFrame({"block": np.repeat(ids, shards), "part": np.tile(np.arange(shards, dtype=np.int32), len(ids)),
                             "over": ids[0] // fan_in, "into": back.ravel().astype(np.int32)})

    placed = stage(groups.withColumn("block", F.pmod(F.xxhash64("group"), F.lit(blocks))).groupBy("block")
                   .applyInPandas(first, "group string, bytes long, block long, part int"), "placed")
    while blocks > 1:
        parts = placed.groupBy("block", "part").agg(F.sum("bytes").alias("bytes"))
        moved = parts.groupBy(F.expr(f"block div {fan_in}")).applyInPandas(merge, "block long, part int, over long, into int")
        placed = stage(placed.join(moved, ["block", "part"]).select(
            "group", "bytes", F.col("over").alias("block"), F.col("into").alias("part")), "placed")
        blocks = -(-blocks // fan_in)
    return placed.select("group", F.col("part").alias("shard"))


def shard_by_bytes(docs: DataFrame, shards: int = 40, overhead: int = 16, keep: tuple[str, ...] = ("doc_id",),
                   block_groups: int = 20_000) -> DataFrame:
    """``keep`` columns of every document with size, shard and slot (0, 1, ... in its shard).

    Only the kept columns, the size and a 16-byte identity of the text are shuffled.
    """
    rows = docs.select(*keep, (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("long").alias("size"),
                       text_group().alias("group"))
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    placed = rows.join(place_groups(groups, shards, block_groups), "group")
    numbered = prefix_sums(placed.withColumn("_one", F.lit(1)), ["group", *keep], "_one", "slot", ("shard",), "slots")
    return numbered.select(*keep, "size", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 40, rows_per_file: int = 100_000) -> None:
    """The documents as folders shard=0, shard=1, ... of files of bounded length."""
    placed = shard_by_bytes(docs, shards, keep=tuple(docs.columns))
    (placed.repartition("shard", F.expr(f"slot div {rows_per_file}")).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
