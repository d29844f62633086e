"""Load-test measurements: raw points, raw CSV and saved summaries."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schemas
from quire.sources.tables import add_missing

# The layout of raw measurement points and of a saved summary.
_POINT = (
    "type string, metric string, data struct<time: timestamp, value: double, "
    "tags: map<string, string>>"
)
_FLAT = ("metric", "ts", "value", "endpoint", "check_group", "check_name", "status", "expected")
_SUMMARY = (
    "metrics map<string, struct<avg: double, min: double, med: double, max: double, "
    "`p(90)`: double, `p(95)`: double, count: double, rate: double, passes: double, "
    "fails: double, value: double, thresholds: map<string, boolean>>>"
)


def read_requests(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Per-request rows in the fixed ``requests`` schema, from JSON lines or CSV."""
    reader = spark.read.schema(schemas.REQUESTS)
    return reader.csv(path, header=True) if fmt == "csv" else reader.json(path)


class Log(NamedTuple):
    """The sound points of a raw log, and per file its lines and how many of them are damaged."""

    points: DataFrame
    damage: DataFrame


def read_log(spark: SparkSession, path: str, fmt: str = "json") -> Log:
    """A raw log as JSON lines or CSV; a damaged line costs nothing but itself, and is counted.

    A line is damaged if it cannot be parsed, if it says no type (JSON), or if it is a point without a metric, a time or a
    value.  Lines of other types are no points and not damaged.
    """
    rows = _csv_lines(spark, path) if fmt == "csv" else _json_lines(spark, path)
    points = rows.filter(~F.col("damaged") & F.col("is_point")).select(*_FLAT)
    damage = rows.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.count_if("damaged").alias("damaged"))
    return Log(points, damage)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Raw JSON-lines points as flat rows, one per sample; damaged lines are left out, see ``read_log``."""
    return read_log(spark, path).points


def read_points_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw CSV points (epoch-second timestamps) in the shape of ``read_points``."""
    return read_log(spark, path, "csv").points


def _judged(rows: DataFrame, broken: Column, is_point: Column) -> DataFrame:
    lacking = F.col("metric").isNull() | F.col("ts").isNull() | F.col("value").isNull()
    flags = {"is_point": F.coalesce(is_point, F.lit(False)), "damaged": F.coalesce(broken | (is_point & lacking), F.lit(True))}
    return rows.withColumns({"file": F.col("_metadata.file_name")} | flags)


def _json_lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(f"{_POINT}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    tag = lambda name: F.try_element_at(F.col("data.tags"), F.lit(name))
    flat = raw.withColumns(
        {
            "ts": F.col("data.time"),
            "value": F.col("data.value"),
            "endpoint": tag("name"),
            "check_group": tag("group"),
            "check_name": tag("check"),
            "status": tag("status").try_cast("int"),
            "expected": tag("expected_response") == "true",
        }
    )
    return _judged(flat, F.col("_broken").isNotNull() | F.col("type").isNull(), F.col("type") == "Point")


def _csv_lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    flat = raw.withColumns(
        {
            "metric": F.col("metric_name"),
            "ts": F.timestamp_seconds(F.col("timestamp").try_cast("long")),
            "value": F.col("metric_value").try_cast("double"),
            "endpoint": F.col("name"),
            "check_group": F.col("group"),
            "check_name": F.col("check"),
            "status": F.col("status").try_cast("int"),
            "expected": F.col("expected_response") == "true",
        }
    )
    return _judged(flat, F.lit(False), F.lit(True))


def points_to_requests(points: DataFrame, metric: str = "http_req_duration") -> DataFrame:
    """Points of one trend metric as rows of the ``requests`` schema; checks come apart, see ``points_to_checks``."""
    rows = points.filter(F.col("metric") == metric).withColumns(
        {
            "duration_ms": F.col("value"),
            "failed": F.coalesce(~F.col("expected"), (F.col("status") == 0) | (F.col("status") >= 400), F.lit(False)),
        }
    )
    return add_missing(rows.drop("check_group", "check_name"), {f.name: f.dataType for f in schemas.REQUESTS.fields}).select(*schemas.REQUESTS.names)


def points_to_checks(points: DataFrame) -> DataFrame:
    """Points of the metric ``checks``, one per check made, as rows (ts, check_group, check_name, check_ok)."""
    return points.filter(F.col("metric") == "checks").select("ts", "check_group", "check_name", (F.col("value") > 0).alias("check_ok"))


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """A saved summary as one row per metric."""
    raw = spark.read.schema(_SUMMARY).json(path, multiLine=True)
    return raw.select(F.explode("metrics").alias("metric", "m")).select("metric", "m.*")
