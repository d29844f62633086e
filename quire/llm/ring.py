"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Ring points are a hash of the key; each shard owns the arcs that end at its virtual nodes.
No shard takes more than its bound of rows; rows that find their shard full continue
clockwise to the next virtual node of a shard with room.  What fills up depends on the
number of rows at each ring point only, so the walk is done once over those counts (bounded by
the number of ring points); Spark counts, numbers the rows of each point and looks up where they go.
Without slack the bounds add up to the number of rows, so that all shards end at most one row apart.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import common
from quire.sources.scratch import written


def nodes(shards: int, virtual: int, points: int) -> list[tuple[int, int]]:
    """(ring point, shard) of all virtual nodes, clockwise."""

    def spot(shard: int, k: int) -> int:
        return int.from_bytes(hashlib.blake2b(b"%d/%d" % (shard, k), digest_size=8).digest(), "big")

    ring = sorted((spot(s, k), s) for s in range(shards) for k in range(virtual))
    return [(h * points >> 64, s) for h, s in ring]


def bounds(total: int, shards: int, slack: float) -> list[int]:
    """The most rows each shard takes; with no slack they add up to ``total``."""
    if slack > 0:
        return [math.ceil((1 + slack) * total / shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def walk(counts: Mapping[int, int], shards: int, virtual: int, points: int, slack: float) -> list[tuple]:
    """Segments for ``common.placed``: which ranks of each ring point go to which shard and slots."""
    ring = nodes(shards, virtual, points)
    room = bounds(sum(counts.values()), shards, slack)
    used, done, out = [0] * shards, dict.fromkeys(counts, 0), []
    following = list(range(len(ring) + 1))  # the next node of a shard with room, len(ring): none before the end

    def settle(k: int) -> int:
        """The first node from k on, around the ring, whose shard has room."""
        turned = False
        while True:
            while following[k] != k:
                following[k] = following[following[k]]
                k = following[k]
            if k == len(ring):
                if turned:
                    raise ValueError("more rows than room")
                turned, k = True, 0
            elif room[ring[k][1]]:
                return k
            else:
                following[k] = k + 1

    def give(point: int, shard: int) -> None:
        n = min(room[shard], counts[point] - done[point])
        if n:
            low = done[point]
            out.append((point, low, low + n, n, shard, used[shard], 1))
            done[point], room[shard], used[shard] = low + n, room[shard] - n, used[shard] + n

    owner, k = {}, 0
    for point in sorted(counts):
        while k < len(ring) and ring[k][0] < point:
            k += 1
        owner[point] = k % len(ring)
    for point in sorted(counts):  # everyone at home first, then what is left over
        give(point, ring[owner[point]][1])
    for point in sorted(counts):
        k = owner[point]
        while done[point] < counts[point]:
            k = settle(k)
            give(point, ring[k][1])
    return out


def shard(
    df: DataFrame,
    key: str,
    shards: int,
    carried: Mapping[str, Column],
    virtual: int = 64,
    points: int = 1 << 14,
    slack: float = 0.0,
) -> DataFrame:
    """One row per row of ``df``: the key as ``key``, the ``carried`` expressions, ``shard`` and ``slot``.

    Slots are gapless from 0 in each shard.  Null keys share one ring point; rows that are
    equal in the key and in everything carried take adjacent slots in any order.  An empty
    table gives no rows.
    """
    names = list(carried)
    rows = df.select(F.col(f"`{key}`").alias("key"), *(c.alias(n) for n, c in carried.items()))
    if "key" in names or "rank" in names:
        raise ValueError("carried columns may not be named key or rank")
    point = F.pmod(F.xxhash64(F.col("key")), F.lit(points)).cast("int")
    rows = written(rows.withColumn("_point", point))
    counts = {r["_point"]: r["n"] for r in rows.groupBy("_point").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = walk(counts, shards, virtual, points, slack)
    numbered = common.ranked(rows, "_point", ["key", *names], buckets=64)
    out = common.placed(numbered, "_point", plan)
    return out.select("key", *names, F.col("sequence").cast("int").alias("shard"), "slot")


def shard_documents(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", **ring) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot; a null text has no bytes."""
    data = F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8")
    carried = {"size": F.octet_length(data).cast("long") + 16, "text_crc32": F.crc32(data)}
    return shard(docs, doc_id, shards, carried, **ring).withColumnRenamed("key", "doc_id")
