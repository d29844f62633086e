"""Joins and nestings that stay even when one key holds a large share of the rows.

Aggregations are pre-aggregated per task before the shuffle; rank filters with a fixed top
likewise.  A join of two sides that are both shuffled for it is split at run time by
adaptive execution.  It cannot split a join whose other side was just aggregated on the join
key, as that side has no shuffle of its own; so such a side, which has one row per key, is
written to the shared folder first (``written``) and joined plainly.  ``running`` numbers and
sums within keys, ``nest`` builds arrays per key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.scratch import written

__all__ = ["SECTION", "crowded", "nest", "running", "same_keys", "written"]

# Items of one key that one document holds.
SECTION = 10_000


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where NULL equals NULL; no keys join two one-row tables."""
    if not keys:
        return left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one", how).drop("_one")
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], amount: Column, latest: bool = False) -> DataFrame:
    """``rows`` with ``before``: the sum of ``amount`` over the rows of the key that come earlier, or
    with ``latest`` the largest (NULL if there is none).

    Rows are range-partitioned by key and order, summed within their part, and the sums of
    the parts before are added: the result does not depend on how rows are dealt, and a key
    of any size is shared by many tasks.  ``order`` should be unique within a key.
    """
    keys, order = list(keys), list(order)
    dealt = rows.withColumn("_amount", amount).repartitionByRange(*keys, *order)
    parts = written(dealt.withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    fold = F.max if latest else F.sum
    whole = (lambda c: c) if latest else (lambda c: F.coalesce(c, F.lit(0)))
    starts = parts.groupBy(*keys, "_part").agg(fold("_amount").alias("_sum"))
    # Only a key that goes on from one part into the next has a start: at most one row per part.
    starts = written(starts.select(*keys, "_part", fold("_sum").over(earlier).alias("_start")).filter("_start is not null"))
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = same_keys(parts.withColumn("_within", whole(fold("_amount").over(within))), starts, [*keys, "_part"], "left")
    both = F.greatest("_start", "_within") if latest else whole(F.col("_start")) + F.col("_within")
    return joined.withColumn("before", both).drop("_amount", "_part", "_start", "_within")


def crowded(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys with more than ``SECTION`` rows, which ``nest`` should not number within one task."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return written(counts.filter(F.col("_n") > SECTION).select(*keys))


def nest(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    fields: Sequence[str],
    make: Callable[[Column], Column],
    name: str,
    section_length: int = SECTION,
    small: bool = False,
) -> DataFrame:
    """One row per key and section with the sorted array ``name`` of its rows.

    Section k of a key holds its items from ``k * section_length`` on, in order, so short keys have the
    single section 0.  ``order`` should end in a unique column.

    Only the ``order`` columns (o0, o1, ...) and ``fields`` are shuffled; ``make`` builds
    an item from them once they are sorted.  With ``small``, where no key is ``crowded``, a key is numbered
    by the task that packs it, so that rows are shuffled once, by ``keys``.
    """
    keys = list(keys)
    by = [f"o{i}" for i in range(len(order))]
    narrow = df.select(*keys, *[c.alias(o) for c, o in zip(order, by, strict=True)], *fields)
    if small:
        placed = narrow.withColumn("before", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)) - 1)
    else:
        placed = running(narrow, keys, by, F.lit(1))
    placed = placed.withColumn("section", F.floor(F.col("before") / section_length).cast("int"))
    packed = F.sort_array(F.collect_list(F.struct(*by, *fields))).alias(name)
    return placed.groupBy(*keys, "section").agg(packed).withColumn(name, F.transform(name, make))
