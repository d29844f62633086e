"""Best-fit-decreasing packing into id matrices.

Overlong documents are split without loss into full rows and a rest.  The rests are placed
longest first, each into the fullest row that still takes it; a segment tree over the free
room finds that row.  Rows that were filled alike stay together as one group, so the
search runs over one count per length and its work is bounded by the capacity, whatever the number
of documents.  Rows come out with ids, cumulative segment lengths and positions that start again at 0.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import packing
from quire.llm.packing import Fill


class Room:
    """Segment tree over the amounts of free room; knows which are present."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.present = [False] * (2 * self.size)

    def set(self, room: int, present: bool) -> None:
        k = room + self.size
        self.present[k] = present
        while k > 1:
            k //= 2
            self.present[k] = self.present[2 * k] or self.present[2 * k + 1]

    def first(self, least: int) -> int | None:
        """The smallest amount present that is not below ``least``."""
        k = least + self.size
        while not self.present[k]:
            while k & 1:  # a right child: go up until something stands to the right
                k //= 2
            if k == 0:
                return None
            k += 1
            if k & (k - 1) == 0:  # past the last leaf of a level
                return None
        while k < self.size:
            k = 2 * k if self.present[2 * k] else 2 * k + 1
        return k - self.size


def fills(counts: Mapping[int, int], capacity: int) -> list[Fill]:
    """Rows as (number of rests of each length, how many such rows), as best fit decreasing fills them."""
    tree, groups = Room(capacity), {}

    def keep(room: int, fill: dict[int, int], rows: int) -> None:
        if rows:
            groups.setdefault(room, []).append((fill, rows))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = tree.first(length)
            if room is None:
                room, fill, rows = capacity, {}, left
            else:
                fill, rows = groups[room].pop()
                if not groups[room]:
                    tree.set(room, False)
            # A row that has taken one is now the fullest that takes the next, until it takes no more.
            each = room // length
            full = min(rows, left // each)
            keep(room - each * length, fill | {length: each}, full)
            left -= full * each
            some = left if full < rows else 0
            if some:
                keep(room - some * length, fill | {length: some}, 1)
                left = 0
            if fill:
                keep(room, fill, rows - full - bool(some))
    return [group for room in sorted(groups) for group in groups[room]]


def pack_matrix(
    docs: DataFrame,
    capacity: int = 1024,
    files: tuple[str, str] | None = None,
    pad_id: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per packed sequence.

    sequence_id; n_tokens; doc_ids and starts (document and its first id in each segment);
    cu_seqlens (0 and the end of each segment); input_ids (``capacity`` little-endian unsigned 32-bit
    numbers, padded with ``pad_id``); position_ids (as many, from 0 in each segment, 0 in the padding).
    A null text counts as empty, which is one end token; extra columns are ignored; an
    empty table gives no rows.  A sequence has at most ``capacity`` segments.
    """
    parts = packing.pack(docs, capacity, files, doc_id, text, planner=fills)
    segment = F.struct("offset", "length", "doc_id", "start", "ids")
    alone = F.col("length") == capacity
    whole = parts.filter(alone).select("sequence_id", F.array(segment).alias("s"))
    mixed = parts.filter(~alone).groupBy("sequence_id").agg(F.sort_array(F.collect_list(segment)).alias("s"))
    n = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    ids = F.aggregate("s", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    pad = F.lit(pad_id.to_bytes(4, "little"))
    count_up = F.lit(b"".join(k.to_bytes(4, "little") for k in range(capacity)))
    positions = F.aggregate("s", F.lit(b""), lambda a, x: F.concat(a, F.substring(count_up, F.lit(1), (4 * x["length"]).cast("int"))))
    return (
        whole.unionByName(mixed)
        .withColumn("n_tokens", n)
        .select(
            "sequence_id",
            "n_tokens",
            F.col("s.doc_id").alias("doc_ids"),
            F.col("s.start").alias("starts"),
            F.concat(F.transform("s", lambda x: x["offset"].cast("int")), F.array(F.col("n_tokens").cast("int"))).alias("cu_seqlens"),
            F.rpad(ids, F.lit(4 * capacity), pad).alias("input_ids"),
            F.rpad(positions, F.lit(4 * capacity), F.lit(bytes(4))).alias("position_ids"),
        )
    )


def write_matrix(packed: DataFrame, path: str) -> None:
    """The packed sequences as Parquet files, ids as one fixed-width binary value per row."""
    packed.write.parquet(path)
