"""Best-fit-decreasing sharding: groups of equal texts, largest first, enter the tightest shard that holds them.

Groups above a 512th of all bytes, or of all rows (1,024 at most), are placed on the driver; all others are dealt into
blocks by their hash, and each block is packed by one task into its share of the room that the large groups left.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transcript_jobs.llm.common import cut, table, text_or_empty

#: A group of more than a LARGE-th of all bytes or rows is placed alone; so there are 2 * LARGE of them at most.
LARGE = 512
GROUPS_PER_BLOCK = 40_000
#: Rows that one task numbers.
ROWS_PER_BLOCK = 100_000


class Room:
    """Bins in a treap by (remaining room, bin): the tightest that holds an item is found in O(log bins)."""

    def __init__(self) -> None:
        self.left, self.right, self.key, self.rank = [0], [0], [(0, 0)], [0.0]
        self.root, self.draw = 0, random.Random(7)

    def _split(self, t: int, key: tuple) -> tuple[int, int]:
        if not t:
            return 0, 0
        if self.key[t] < key:
            a, b = self._split(self.right[t], key)
            self.right[t] = a
            return t, b
        a, b = self._split(self.left[t], key)
        self.left[t] = b
        return a, t

    def _merge(self, a: int, b: int) -> int:
        if not a or not b:
            return a or b
        if self.rank[a] > self.rank[b]:
            self.right[a] = self._merge(self.right[a], b)
            return a
        self.left[b] = self._merge(a, self.left[b])
        return b

    def add(self, room: int, bin_: int) -> None:
        for store, x in ((self.left, 0), (self.right, 0), (self.key, (room, bin_)), (self.rank, self.draw.random())):
            store.append(x)
        a, b = self._split(self.root, (room, bin_))
        self.root = self._merge(self._merge(a, len(self.key) - 1), b)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the bin with the least room of ``size`` or more."""
        a, b = self._split(self.root, (size, -1))
        if not b:
            self.root = a
            return None
        t = b
        while self.left[t]:
            t = self.left[t]
        one, rest = self._split(b, (self.key[t][0], self.key[t][1] + 1))
        self.root = self._merge(a, rest)
        return self.key[one]

    def take_roomiest(self) -> tuple[int, int]:
        t = self.root
        while self.right[t]:
            t = self.right[t]
        a, _ = self._split(self.root, self.key[t])
        self.root = a
        return self.key[t]


def best_fit_decreasing(sizes: list[int], rooms: list[int], capacity: int | None = None) -> list[int]:
    """The bin of each size; sizes must not rise. ``rooms``: the bins there are.

    An item that fits nowhere opens a bin of ``capacity`` (alone in it if it is larger still); without a
    capacity the number of bins is fixed, and it goes where most room is left.
    """
    tree, out, n = Room(), [], len(rooms)
    for i, r in enumerate(rooms):
        tree.add(r, i)
    for size in sizes:
        got = tree.take(size)
        if got is None and capacity is not None:
            got, n = (capacity, n), n + 1
        room, at = got or tree.take_roomiest()
        tree.add(room - size, at)
        out.append(at)
    return out


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(_id, size, crc, g): g tells equal texts; a null text has size 1, like the empty one, and is its group's equal."""
    t = text_or_empty(text)
    return docs.select(
        F.col(key).alias("_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).cast("long").alias("crc"), F.md5(t).alias("g")
    )


def _block(n: int):
    return F.pmod(F.xxhash64("g"), F.lit(n)).cast("int")


def shard(docs: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard, slot: rows dealt to ``n_shards`` of near equal bytes, equal texts together.

    ``slot`` counts a shard's rows from 0 without gaps, by block, then key; repeated rows get slots of their
    own. Null and empty texts are one group. A group beyond a shard's fair share makes its shard as large.
    An empty table gives no rows.
    """
    rows = _keyed(docs, key, text)
    groups = cut(rows.groupBy("g").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    total, n, n_rows = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    blocks, row_blocks = max(1, -(-n // GROUPS_PER_BLOCK)), max(1, -(-n_rows // ROWS_PER_BLOCK))
    alone = (F.col("bytes") * LARGE > total) | (F.col("n") * LARGE > n_rows)
    large = groups.filter(alone).orderBy(F.desc("bytes"), "g").collect()
    share = [total * (i + 1) // n_shards - total * i // n_shards for i in range(n_shards)]
    placed = best_fit_decreasing([r["bytes"] for r in large], share)
    room = list(share)
    for r, s in zip(large, placed, strict=True):
        room[s] -= r["bytes"]
    room = [max(0, x) for x in room]
    spark = docs.sparkSession
    head = F.broadcast(
        spark.createDataFrame([(r["g"], s) for r, s in zip(large, placed, strict=True)], "g string, _head int")
    )

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "g"], ascending=[False, True], ignore_index=True)
        whole = int(pdf["bytes"].sum())
        rooms = [whole * x // max(1, sum(room)) for x in room]
        return pd.DataFrame({"g": pdf["g"], "_tail": best_fit_decreasing(pdf["bytes"].tolist(), rooms)})

    tail = groups.filter(~alone).select("g", "bytes").groupBy(_block(blocks).alias("_b")).applyInPandas(pack, "g string, _tail int")
    # rows of a large group have their shard already: they are spread in the join by their own hash, which no group has
    own = F.xxhash64("_id", "g")
    spread = F.when(F.col("_head").isNull(), F.col("g")).otherwise(own.cast("string"))
    dealt = (
        rows.join(head, "g", "left")
        .withColumn("_g", spread)
        .join(tail.withColumnRenamed("g", "_g"), "_g", "left")
        .withColumn("shard", F.coalesce("_head", "_tail"))
        .withColumn("_b", F.pmod(own, F.lit(row_blocks)).cast("int"))
    )
    dealt = cut(dealt.select("_id", "size", "crc", "shard", "_b"))
    counts = dealt.groupBy("shard", "_b").agg(F.count("*").alias("_n"))
    starts = counts.select("shard", "_b", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_b")) - F.col("_n")).alias("_start"))
    at = F.row_number().over(Window.partitionBy("shard", "_b").orderBy("_id", "crc", "size")) - 1
    return dealt.withColumn("_at", at).join(starts, ["shard", "_b"]).select(
        F.col("_id").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("_start") + F.col("_at")).cast("long").alias("slot")
    )


def pack_capacity(docs: DataFrame, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, block, bin: as few shards of ``capacity`` bytes as best fit decreasing finds, equal texts together.

    Blocks are packed apart, which costs a part-filled bin per block. A group larger than a bin has a bin of its own.
    """
    rows = _keyed(docs, key, text)
    groups = rows.groupBy("g").agg(F.sum("size").alias("bytes"))
    blocks = max(1, -(-groups.count() // GROUPS_PER_BLOCK))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "g"], ascending=[False, True], ignore_index=True)
        return pdf.assign(bin=best_fit_decreasing(pdf["bytes"].tolist(), [], capacity))[["g", "block", "bin"]]

    bins = groups.withColumn("block", _block(blocks)).groupBy("block").applyInPandas(pack, "g string, block int, bin int")
    return rows.join(bins, "g").select(F.col("_id").alias(key), "size", "block", "bin")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: Best fit is a sequential search; the tests hold it against a brute-force version.
SQL = None
