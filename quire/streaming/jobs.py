"""Structured Streaming forms; each shares its logic with the batch operator.

The quota and latency streams drop rows older than the watermark.  The cart stream
applies commands in (ts, cmd_id) order within a micro-batch and batches in arrival
order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators import cart as C
from quire.operators import requests as R
from quire.sources.tables import publish, read_published

LATENESS = "15 minutes"


def quota_stream(requests: DataFrame, lateness: str = LATENESS, window: str = R.WINDOW) -> DataFrame:
    return R.quota_counts(requests.withWatermark("ts", lateness), window)


def latency_stream(requests: DataFrame, lateness: str = LATENESS, length: str = "1 minute") -> DataFrame:
    return R.per_minute(requests.withWatermark("ts", lateness), length)


def cart_batch(base: str, books: DataFrame, start: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """Writer for ``foreachBatch``: folds a micro-batch of commands into the stored cart and answers each command.

    Batch n reads the version before n and writes version n of ``cart_items`` and ``cart_results``, so that a
    repeated batch gives the same version again.
    """

    def write(commands: DataFrame, batch: int) -> None:
        before = start if batch == 0 else None
        if before is None:
            before = read_published(commands.sparkSession, base, "cart_items", before=batch)
        done = C.fold(before, books, commands)
        publish({"cart_items": done.cart, "cart_results": done.results}, base, batch)

    return write


def run_available(
    stream: DataFrame,
    checkpoint: str,
    write: Callable[[DataFrame, int], None],
    mode: str = "append",
) -> StreamingQuery:
    """Process everything that is there, then stop."""
    query = (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def latest_to(path: str) -> Callable[[DataFrame, int], None]:
    """Writer for complete mode: each batch replaces the result table of that number."""

    def write(result: DataFrame, batch: int) -> None:
        result.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The result of the last batch written by ``latest_to``."""
    everything = spark.read.parquet(path)
    last = everything.agg(F.max("batch")).first()[0]
    return everything.filter(F.col("batch") == last).drop("batch")
