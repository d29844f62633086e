"""What several operators need: tables, whole ranks, placement by plan, hashing of bytes."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def columns(df: DataFrame, **named: str) -> DataFrame:
    """The named columns under the operator's own names, so that no extra column can clash."""
    return df.select(*(F.col(f"`{c}`").alias(n) for n, c in named.items()))


def ranked(df: DataFrame, key: str, order: Sequence[str], buckets: int = 1024) -> DataFrame:
    """``rank``: the place of each row within its key, gapless from 0.

    A key may hold any share of the rows: it is dealt into ``buckets`` by a hash of the
    order columns, each bucket is numbered alone, and the counts of the buckets before it are added.
    Rows that are equal in all order columns take adjacent numbers in any order.
    """
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy(key, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    within = Window.partitionBy(key, "_bucket").orderBy(*order)
    numbered = dealt.withColumn("_row", F.row_number().over(within))
    return (
        numbered.join(offsets, [key, "_bucket"])
        .withColumn("rank", F.col("_before") + F.col("_row") - 1)
        .drop("_bucket", "_before", "_row")
    )


def placed(df: DataFrame, key: str, segments: Iterable[tuple], limit: int = 200_000) -> DataFrame:
    """``sequence`` and ``slot`` of ranked rows by a plan.

    A segment (key, low, high, each, first, offset, step) says: the rows of the key with ranks
    from low to below high go to the sequences first, first + 1, ..., each of which takes
    ``each`` of them, at offset, offset + step, ...  The plan is bounded by the number of
    keys, whatever the number of rows; ``limit`` guards its broadcast.
    """
    rows = list(segments)
    if len(rows) > limit:
        raise ValueError(f"a plan of {len(rows)} segments is more than a broadcast should hold")
    plan = df.sparkSession.createDataFrame(
        rows, "_key int, _low long, _high long, _each long, _first long, _offset long, _step long"
    )
    at = F.col("rank") - F.col("_low")
    return (
        df.join(F.broadcast(plan), (F.col(key) == F.col("_key")) & (F.col("rank") >= F.col("_low")) & (F.col("rank") < F.col("_high")))
        .withColumn("sequence", F.col("_first") + F.floor(at / F.col("_each")).cast("long"))
        .withColumn("slot", F.col("_offset") + F.pmod(at, F.col("_each")) * F.col("_step"))
        .drop("_key", "_low", "_high", "_each", "_first", "_offset", "_step")
    )


# Hashes of substrings.  For bytes b0 b1 ... the sums of table[b] * ODD**i are kept for all
# prefixes; a difference of two, times ODD**-start, depends on the substring alone (mod 2**64).

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x + np.uint64((0x632BE59BD9B4E019 * (2 * salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mixed(np.arange(256, dtype=np.uint64), 7)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, np.uint64(base), dtype=np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """For substring_hashes; one longer than ``data``."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * _powers(_ODD, len(data)), out=out[1:])
    return out


def substring_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] for each pair."""
    return mixed((sums[ends] - sums[starts]) * _powers(_INVERSE, len(sums))[starts])
