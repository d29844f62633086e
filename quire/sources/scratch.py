"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: set[str] = set()
_OPTION = "spark.checkpoint.dir"


def use_if_unset(spark: SparkSession, folder: str) -> None:
    """Name ``folder`` as the place for checkpoints, for a session of one local process that names none.

    On a cluster this does nothing: the folder must be one that all machines share."""
    context = spark.sparkContext
    named = spark.conf.get(_OPTION, None) or context.getCheckpointDir()
    if named is None and context.master.partition("[")[0] == "local":
        context.setCheckpointDir(folder)


def shared_folder(spark: SparkSession, base: str | None = None) -> str:
    """A new place under ``base``, or else under the folder the session names for checkpoints."""
    base = base or spark.conf.get(_OPTION, None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        raise ValueError(f"set {_OPTION} to a folder that the driver and all executors share")
    path = f"{base.rstrip('/')}/quire-{uuid.uuid4().hex}"
    _FOLDERS.add(path)
    return path


def written(df: DataFrame, base: str | None = None, by: str | None = None) -> DataFrame:
    """The same rows from a table written to the shared folder, with a folder for each value of the column ``by``.

    Used where an intermediate result is read several times: it is computed once, survives
    lost executors, and its size is known to the optimizer.
    """
    path = shared_folder(df.sparkSession, base)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def collected() -> Iterator[set[str]]:
    """The places taken inside the block, for ``clear``."""
    before, made = set(_FOLDERS), set()
    try:
        yield made
    finally:
        made |= _FOLDERS - before


def clear(spark: SparkSession, folders: Iterable[str] | None = None) -> None:
    """Delete these places, or all that this process has taken; only once no result needs them any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in list(_FOLDERS if folders is None else folders):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
        _FOLDERS.discard(folder)
