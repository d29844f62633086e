"""Reading, defaulting, publishing and appending tables."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire import schemas
from quire.sources.scratch import written

_MARKER_SCHEMA = "version long, attempt long, name string, path string"


def apply_defaults(df: DataFrame, table: str) -> DataFrame:
    """Fill NULLs of the columns that declare a default."""
    known = {k: v for k, v in schemas.DEFAULTS[table].items() if k in df.columns}
    return df.fillna(known) if known else df


def conform(df: DataFrame, table: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Add the declared columns that are missing (default or NULL) and widen
    ``book_id`` to text; other columns keep their type and any extra ones stay."""
    defaults = schemas.DEFAULTS[table]
    added = {}
    for field in schemas.TABLES[table].fields:
        if columns is not None and field.name not in columns:
            continue
        if field.name not in df.columns:
            added[field.name] = F.lit(defaults.get(field.name)).cast(field.dataType)
    if "book_id" in df.columns:
        added["book_id"] = F.col("book_id").cast("string")
    return df.withColumns(added) if added else df


def read_table(spark: SparkSession, base: str, name: str, fmt: str = "parquet", **options) -> DataFrame:
    """One store table with its declared types; hash columns are never loaded."""
    reader = spark.read.options(**options)
    if fmt in ("csv", "json") and name in schemas.TABLES:
        reader = reader.schema(schemas.TABLES[name])
    return _declared(reader.format(fmt).load(f"{base.rstrip('/')}/{name}"), name)


def _declared(df: DataFrame, name: str) -> DataFrame:
    """Declared columns in their declared types, others as they are, hash columns gone."""
    df = df.drop(*schemas.DROPPED_ON_LOAD)
    kinds = {f.name: f.dataType for f in schemas.TABLES[name].fields} if name in schemas.TABLES else {}
    return df.withColumns({c: F.col(c).cast(t) for c, t in kinds.items() if c in df.columns and df.schema[c].dataType != t})


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    lower: str | None = None,
    upper: str | None = None,
    partitions: int = 1,
    **options: str,
) -> DataFrame:
    """A table of a relational store, read in parallel ranges of ``partition_column``."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column is not None:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", lower)
            .option("upperBound", upper)
            .option("numPartitions", partitions)
        )
    return _declared(reader.load(), table)


def append_rows(new_rows: DataFrame, path: str) -> DataFrame:
    """Append to a parquet table and return the rows added; they are computed once, so both are the same."""
    added = written(new_rows)
    added.write.mode("append").parquet(path)
    return added


def publish(tables: dict[str, DataFrame], base: str, version: int) -> None:
    """Write all tables to new places, then make them current with one small write.

    A failure before the last step leaves the earlier version current, and so does a failing
    repetition of a version: each attempt has places of its own, and the last one to finish counts.
    """
    base = base.rstrip("/")
    spark = next(iter(tables.values())).sparkSession
    rows, attempt = [], time.time_ns()
    for name, df in tables.items():
        path = f"{base}/data/{name}/version={version}/attempt={attempt}"
        df.write.parquet(path)
        rows.append((version, attempt, name, path))
    spark.createDataFrame(rows, _MARKER_SCHEMA).coalesce(1).write.mode("append").json(f"{base}/current")


def read_published(spark: SparkSession, base: str, name: str, before: int | None = None) -> DataFrame:
    """The current version of a published table, or the last one below ``before``."""
    marks = spark.read.schema(_MARKER_SCHEMA).json(f"{base.rstrip('/')}/current")
    if before is not None:
        marks = marks.filter(F.col("version") < before)
    row = marks.filter(F.col("name") == name).agg(F.max_by("path", F.struct("version", "attempt")).alias("path")).first()
    if row["path"] is None:
        raise ValueError(f"no published version of {name}")
    return spark.read.parquet(row["path"])


def read_all_published(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The rows of all versions of a published table with their ``version``; of a version published twice, the last attempt.

    The paths of the versions are the only thing the driver holds."""
    marks = spark.read.schema(_MARKER_SCHEMA).json(f"{base.rstrip('/')}/current").filter(F.col("name") == name)
    last = marks.groupBy("version").agg(F.max_by("path", "attempt").alias("path")).orderBy("version").collect()
    if not last:
        raise ValueError(f"no published version of {name}")
    rows = spark.read.option("basePath", f"{base.rstrip('/')}/data/{name}").parquet(*(r["path"] for r in last))
    return rows.drop("attempt")


def write_documents(docs: DataFrame, path: str) -> None:
    """JSON document sink."""
    docs.write.mode("overwrite").json(path)


def as_json(docs: DataFrame, name: str = "document") -> DataFrame:
    """Each row as one JSON text."""
    return docs.select(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}).alias(name))


def add_missing(df: DataFrame, fields: dict[str, T.DataType | str]) -> DataFrame:
    """Add columns that are absent as typed NULLs."""
    new = {n: F.lit(None).cast(t) for n, t in fields.items() if n not in df.columns}
    return df.withColumns(new) if new else df
