"""Importance resampling towards a target, with features hashed by position tables.

Words and their runs are hashed into buckets.  The logarithm of how much more often a bucket's features
occur in the target than in the corpus is the bucket's gain; a document's weight is the mean gain
of its features, and adding Gumbel noise to the weights and keeping the highest sums draws documents
without replacement in proportion to their weights.

The hash is CRC-32, for all features of a stretch of text at once.  A check sum is linear in the bits of its
message but for a constant that depends on the length alone, so every byte contributes one number
known from its value and its distance from the end of the feature.  The contributions are looked up
in a table, combined by one ``bitwise_xor.reduceat`` over the spans, and the constant of the length is
added.  A span longer than the table is cut into blocks from its end, whose sums are carried past
the blocks behind them and combined in the same way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.skew import running
from quire.sources.scratch import written

WIDTH = 64  # distances in the table
_ONES = np.uint32(0xFFFFFFFF)


def _position_table(width: int = WIDTH, polynomial: int = 0xEDB88320) -> np.ndarray:
    """[d, b]: what a byte b with d bytes behind it adds to a check sum."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(polynomial), one >> 1)
    rows = [one]
    for _ in range(width - 1):
        rows.append((rows[-1] >> np.uint32(8)) ^ one[rows[-1] & 0xFF])
    return np.stack(rows)


def _carried(tables: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Sums after the zero bytes that the four tables, one for each byte of a sum, stand for."""
    out = tables[0][sums & 0xFF]
    for k in (1, 2, 3):
        out = out ^ tables[k][(sums >> np.uint32(8 * k)) & 0xFF]
    return out


def _carriers(table: np.ndarray, doublings: int = 40) -> list[np.ndarray]:
    """Tables for WIDTH * 2**j zero bytes."""
    out = [np.stack([table[WIDTH - 1 - k] for k in range(4)])]
    for _ in range(doublings - 1):
        out.append(np.stack([_carried(out[-1], t) for t in out[-1]]))
    return out


TABLE = _position_table()
CARRIERS = _carriers(TABLE)


def _past(sums: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Sums carried past so many blocks of WIDTH zero bytes."""
    bit = 0
    while (left := blocks >> bit).any():
        odd = np.flatnonzero(left & 1)
        sums[odd] = _carried(CARRIERS[bit], sums[odd])
        bit += 1
    return sums


def _length_constants() -> np.ndarray:
    """Check sums of 0 to WIDTH - 1 zero bytes, before the last inversion."""
    out = np.full(WIDTH, _ONES)
    for n in range(1, WIDTH):
        out[n] = (out[n - 1] >> np.uint32(8)) ^ TABLE[0][out[n - 1] & 0xFF]
    return out


CONSTANTS = _length_constants()


def crc32_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end] for each pair; spans may overlap, none is empty."""
    if not len(starts):
        return np.empty(0, np.uint32)
    sizes = ends - starts
    behind = (sizes - 1) // WIDTH  # blocks after the first one of a span
    if behind.any():  # spans as blocks, the first of which may be shorter
        owner = np.repeat(np.arange(len(starts)), behind + 1)
        first = np.cumsum(behind + 1) - behind - 1
        after = behind[owner] - (np.arange(len(owner)) - first[owner])
        block_ends = ends[owner] - after * WIDTH
        block_starts = np.maximum(starts[owner], block_ends - WIDTH)
    else:
        block_starts, block_ends = starts, ends
    widths = block_ends - block_starts
    at = np.cumsum(widths) - widths
    place = np.arange(int(widths.sum())) + np.repeat(block_starts - at, widths)
    distance = np.repeat(block_ends - 1, widths) - place
    sums = np.bitwise_xor.reduceat(TABLE.reshape(-1)[distance * 256 + data[place]], at)
    if behind.any():
        sums = np.bitwise_xor.reduceat(_past(sums, after), first)
    return sums ^ _past(CONSTANTS[sizes % WIDTH], sizes // WIDTH) ^ _ONES


# ---- words and runs ----------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Digits, small letters and all bytes of characters beyond ASCII.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _runs(data: np.ndarray, cuts: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Lower-cased words joined by single bytes of space, starts and ends of the words in them, the part
    (between two cuts) each word lies in, and where it starts in ``data``."""
    low = _LOWER[data]
    inside = _IN_WORD[low]
    before = np.zeros(len(low), bool)
    before[1:] = inside[:-1]
    before[cuts[:-1][cuts[:-1] < len(low)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(low), bool)
    after[:-1] = inside[1:]
    inner = cuts[1:-1]
    after[inner[(inner > 0) & (inner < len(low))] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    part = np.searchsorted(cuts, starts, side="right") - 1
    if most == 1:
        return low, starts, ends, part, starts
    sizes = ends - starts
    joined = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
    to = np.cumsum(sizes + 1) - sizes - 1
    shift = np.repeat(to - starts, sizes)
    place = np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    joined[place + shift] = low[place]
    return joined, to, to + sizes, part, starts


def features(data: np.ndarray, offsets: np.ndarray, most: int, stretch: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, check sum) of every run of 1 to ``most`` words, and the texts of the single words, stretch by stretch.

    Text i is data[offsets[i]:offsets[i + 1]].  Texts are taken together up to ``stretch`` bytes; a longer one is
    cut between words, and the last words of a cut are read again for the runs that reach across it.
    """
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + stretch, side="right")) - 1)
        last = min(last, n)
        low, high = int(offsets[first]), int(offsets[last])
        old = 0  # words that were ends of runs already
        while True:
            end = high
            if high - low > 2 * stretch:
                end = _gap(data, low + stretch, high)
            cuts = (offsets[first : last + 1] - low).clip(0, end - low) if end == high and low <= offsets[first] else np.array([0, end - low])
            bytes_, starts, ends, part, origin = _runs(data[low:end], cuts, most)
            owners, sums = [], []
            for k in range(1, most + 1):
                head = np.arange(max(0, len(starts) - k + 1))
                tail = head + k - 1
                head, tail = (x[(part[head] == part[tail]) & (tail >= old)] for x in (head, tail))
                owners.append(part[head] + first)
                sums.append(crc32_of(bytes_, starts[head], ends[tail]))
            yield np.concatenate(owners), np.concatenate(sums), part[old:] + first
            if end == high:
                break
            again = min(most - 1, len(starts))
            low, old = (low + int(origin[-again]), again) if again else (end, 0)
        first = last


def _gap(data: np.ndarray, low: int, high: int, look: int = 1 << 16) -> int:
    """The first place from ``low`` on that is in no word, or ``high``."""
    for at in range(low, high, look):
        free = np.flatnonzero(~_IN_WORD[_LOWER[data[at : min(at + look, high)]]])
        if len(free):
            return at + int(free[0])
    return high


def _texts(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow column of byte strings without nulls, and offsets into them."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), offsets


def _bytes(df: DataFrame, text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")


def bucket_counts(df: DataFrame, text: str = "text", most: int = 1, buckets: int = 10_000, stretch: int = 1 << 20) -> np.ndarray:
    """How many features of all texts lie in each bucket; tasks send sums, the driver gets one row per bucket."""
    import pyarrow as pa

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, sums, _ in features(*_texts(batch.column(0)), most, stretch):
                held += np.bincount(sums % buckets, minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["bucket", "n"])

    found = df.select(_bytes(df, text).alias("t")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray, buckets: int) -> np.ndarray:
    """floor(1000 * ln(smoothed share in the target / smoothed share in the corpus)) of each bucket."""
    whole, aimed = float(corpus.sum() + buckets), float(target.sum() + buckets)
    out = [math.floor(1000 * math.log(((t + 1) * whole) / ((s + 1) * aimed))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]
    return np.array(out, np.int64)


def weighed(df: DataFrame, gain: np.ndarray, doc_id: str, text: str, most: int, stretch: int) -> DataFrame:
    """(id, n_words, n_features, weight) of each row."""
    import pyarrow as pa

    names = ["doc_id", "n_words", "n_features", "weight"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            words, many, total = (np.zeros(size, np.int64) for _ in range(3))
            for owner, sums, single in features(*_texts(batch.column(1)), most, stretch):
                if len(owner):
                    low = int(owner.min())
                    n = np.bincount(owner - low)
                    many[low : low + len(n)] += n
                    np.add.at(total, owner, gain[sums % len(gain)])
                    words += np.bincount(single, minlength=size)
            mean = np.floor_divide(total, np.maximum(many, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, many, mean))], names)

    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), _bytes(df, text).alias("t"))
    return rows.mapInArrow(weigh, ", ".join(f"{n} long" for n in names))


# ---- the draw ----------------------------------------------------------------------------------


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    most: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    stretch: int = 1 << 20,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``.

    Of the N rows with at least ``least_words`` words, the floor(percent * N / 100) with the highest scores
    are drawn; they are ranked from 1, ties by the smaller doc_id, a null id first; all others have no rank.  Rows that
    repeat an id are ranked each for itself, equal ones in any order.  A null text has no words and
    weight 0; an empty corpus gives no rows, an empty target gains from smoothing alone.  Extra columns are ignored.

    Every count covers all rows.  Scores are whole numbers in a range that the doubles behind
    them bound (some 100,000 values), so the rows per score reach the driver; the places
    within a score come from range parts.
    """
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, text, most, buckets, stretch), bucket_counts(target, target_text, most, buckets, stretch), buckets)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10)
    unit = (noise.cast("long").cast("double") + 0.5) / 4294967296.0
    score = F.col("weight") + F.floor(F.lit(-1000.0) * F.ln(-F.ln(unit)))
    rows = written(weighed(docs, gain, doc_id, text, most, stretch).withColumn("score", score.cast("long")))
    fit = F.col("n_words") >= least_words
    counts = rows.filter(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()
    draw, above, offsets, least = percent * sum(r["n"] for r in counts) // 100, 0, [], None
    for r in sorted(counts, key=lambda r: -r["score"]):
        if above >= draw:
            break
        offsets.append((r["score"], above))
        above, least = above + r["n"], r["score"]
    none = F.lit(None).cast("long")
    if least is None:
        return rows.withColumn("rank", none)
    high = fit & (F.col("score") >= least)
    starts = F.broadcast(spark.createDataFrame(offsets, "score long, above long"))  # one row per score, bounded as said above
    placed = running(rows.filter(high), ["score"], ["doc_id", "n_features", "weight"], F.lit(1)).join(starts, "score")
    rank = F.col("above") + F.col("before") + 1
    placed = placed.withColumn("rank", F.when(rank <= draw, rank).cast("long")).select(*rows.columns, "rank")
    return placed.unionByName(rows.filter(~high).withColumn("rank", none))
