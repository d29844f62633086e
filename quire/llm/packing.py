"""Packing by minimum bin slack.

Documents become token ids; a long document is cut into full windows, which need no
partner, and a rest.  The rests are packed: the longest rest left opens a window, and a
subset-sum table over the multiset of the lengths left (one bit for each sum, Python
integers as bitsets) finds the fill that comes closest to the capacity; the table is
traced back to the number of rests of each length.  As only lengths matter, this works
on one count for each length below the capacity, and a fill is repeated while the counts
last: the plan is bounded by the capacity, never by the rows.  Spark numbers the rests of
each length and looks their windows up in the plan.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common, tokens
from quire.sources.scratch import written

Fill = tuple[dict[int, int], int]


def best_fill(left: Mapping[int, int], room: int) -> dict[int, int]:
    """How many rests of each length bring the sum closest to ``room`` from below."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x in left if x <= room and left[x] > 0), reverse=True):
        count, part = min(left[length], room // length), 1
        while count > 0:  # binary parts of the count
            take = min(part, count)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            count -= take
            part *= 2
        if reach >> room & 1:
            break
    total, fill = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:  # not reachable without this part
            fill[length] = fill.get(length, 0) + take
            total -= length * take
    return fill


def fills(counts: Mapping[int, int], capacity: int) -> list[Fill]:
    """Windows as (number of rests of each length, how many such windows), longest rests first."""
    left, out = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        fill = best_fill(left, capacity - longest)
        left[longest] += 1
        fill[longest] = fill.get(longest, 0) + 1
        times = min(left[k] // n for k, n in fill.items())
        out.append((fill, times))
        for k, n in fill.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def segments(plan: list[Fill]) -> tuple[list[tuple], int]:
    """The plan for ``common.placed``, and its number of windows."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for fill, times in plan:
        offset = 0
        for length in sorted(fill, reverse=True):
            low = used.get(length, 0)
            used[length] = low + fill[length] * times
            rows.append((length, low, used[length], fill[length], first, offset, length))
            offset += length * fill[length]
        first += times
    return rows, first


def pack(
    docs: DataFrame,
    capacity: int = 1024,
    files: tuple[str, str] | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    planner=fills,
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    A null text counts as empty, which is one end token; every row of the input is packed,
    rows with the same id and null ids too.  Extra columns are ignored; an empty table gives no rows.
    ``ids`` are little-endian unsigned 32-bit numbers.  The tokenized pieces are
    written to the shared folder once, as their counts come before their placement.
    """
    source = common.columns(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text")
    cut = written(tokens.pieces_of(source, capacity, files or tokens.vocabulary()))
    rest = F.col("length") < capacity
    counts = {r["length"]: r["n"] for r in cut.filter(rest).groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan, windows = segments(planner(counts, capacity))
    rests = common.placed(common.ranked(cut.filter(rest), "length", ["doc_id", "start", "doc_tokens", "ids"]), "length", plan)
    full = cut.filter(~rest).withColumns({"sequence": F.monotonically_increasing_id() + windows, "slot": F.lit(0).cast("long")})
    names = ["doc_id", "start", F.col("length").cast("long").alias("length"), "doc_tokens", "ids", F.col("sequence").alias("sequence_id"), F.col("slot").alias("offset")]
    return rests.select(*names).unionByName(full.select(*names))
