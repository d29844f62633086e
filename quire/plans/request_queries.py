"""Request-log queries, batch and streamed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import requests as R
from quire.plans import views as V
from quire.plans.cart_queries import FOLD_RESULTS_SQL, FOLD_SQL, fold_tables
from quire.plans.registry import as_text, query, r6
from quire.plans.views import with_views
from quire.sources import request_log as L
from quire.sources.scratch import shared_folder
from quire.sources.tables import publish, read_all_published, read_published
from quire.streaming import jobs as J

_TREND_SQL = """
    SELECT endpoint, count(duration_ms) AS n, round(avg(duration_ms), 6) AS avg, min(duration_ms) AS min,
      max(duration_ms) AS max, round(quantile_cont(duration_ms, 0.5), 6) AS med,
      round(quantile_cont(duration_ms, 0.9), 6) AS p90, round(quantile_cont(duration_ms, 0.95), 6) AS p95
    FROM v_requests {} GROUP BY endpoint"""
# The test log has at most two requests per client, endpoint and window.
ALLOWANCES = {"click": 1, "error": 1, "view": 2, "signup": 0}
_ALLOWANCE_SQL = "CASE endpoint WHEN 'click' THEN 1 WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 0 END"


# Values at places of the sorted list, as approximate percentiles of few values give them.
_PLACES_SQL = ", ".join(
    f"round(list_sort(list(duration_ms))[cast(greatest(1, ceil({p} * count(*))) as int)], 6) AS {n}" for n, p in R.PERCENTILES.items()
)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


@query("request_latency", with_views("v_requests", _TREND_SQL.format("")))
def request_latency(spark: SparkSession, base: str) -> DataFrame:
    return _rounded(R.trend(V.requests(spark, base)), "avg", "med", "p90", "p95")


@query(
    "request_latency_rough",
    with_views("v_requests", f"""
    SELECT endpoint, count(duration_ms) AS n, min(duration_ms) AS min, max(duration_ms) AS max FROM v_requests GROUP BY endpoint"""),
)
def request_latency_rough(spark: SparkSession, base: str) -> DataFrame:
    """Approximate percentiles are held to a hundredth of the exact ones' rank; what is left must be equal."""
    log = V.requests(spark, base)
    rough = R.trend(log, exact=False)
    names = list(R.PERCENTILES)
    ranks = log.join(F.broadcast(rough), "endpoint").groupBy("endpoint", "n", "min", "max").agg(
        *[(F.count_if(F.col("duration_ms") <= F.col(p)) / F.count(F.lit(1))).alias(f"r_{p}") for p in names]
    )
    near = [F.abs(F.col(f"r_{p}") - F.lit(R.PERCENTILES[p])) <= 0.01 + 1 / F.col("n") for p in names]
    return ranks.filter(near[0] & near[1] & near[2]).select("endpoint", "n", "min", "max")


# The log of the events as the load generator writes it: clicks and views as JSON lines, the rest as CSV, each with damaged
# lines beside the sound ones: JSON cut off or without a value, CSV with words for numbers.
_IN_JSON = "endpoint IN ('click', 'view')"
_CUT, _LACKING = "duration_ms < 5", "duration_ms > 95"


def _written_log(spark: SparkSession, base: str) -> tuple[str, str]:
    log = V.requests(spark, base).select("ts", "endpoint", "duration_ms", "status", "failed")
    place = shared_folder(spark)
    expected = F.when(F.col("failed"), "false").otherwise("true")
    tags = F.create_map(F.lit("name"), F.col("endpoint"), F.lit("status"), F.col("status").cast("string"), F.lit("expected_response"), expected)
    line = lambda *value: F.to_json(
        F.struct(F.lit("Point").alias("type"), F.lit("http_req_duration").alias("metric"), F.struct(F.col("ts").alias("time"), *value, tags.alias("tags")).alias("data"))
    )
    whole = line(F.col("duration_ms").alias("value"))
    lines = [whole, F.when(F.expr(_CUT), F.substring(whole, 1, 60)), F.when(F.expr(_LACKING), line())]
    log.filter(_IN_JSON).select(F.explode(F.array_compact(F.array(*lines))).alias("value")).write.text(f"{place}/json")
    numbers = [(F.unix_timestamp("ts").cast("string"), F.col("duration_ms").cast("string"))]
    numbers += [(F.when(F.expr(_CUT), "soon"), F.lit("1.5")), (F.when(F.expr(_LACKING), "1767225600"), F.lit("slow"))]
    pairs = F.filter(F.array(*[F.struct(t.alias("timestamp"), v.alias("metric_value")) for t, v in numbers]), lambda x: x["timestamp"].isNotNull())
    table = log.filter(f"NOT {_IN_JSON}").select(F.explode(pairs).alias("p"), "endpoint", "status", expected.alias("expected_response"))
    names = [F.lit("http_req_duration").alias("metric_name"), "p.timestamp", "p.metric_value", F.col("endpoint").alias("name")]
    empty = [F.lit("").alias("group"), F.lit("").alias("check")]
    table.select(*names, *empty, "status", "expected_response").write.option("header", True).csv(f"{place}/csv")
    return f"{place}/json", f"{place}/csv"


@query("request_latency_from_log", with_views("v_requests", _TREND_SQL.format("")))
def request_latency_from_log(spark: SparkSession, base: str) -> DataFrame:
    lines, table = _written_log(spark, base)
    points = L.read_points(spark, lines).unionByName(L.read_points_csv(spark, table))
    return _rounded(R.trend(L.points_to_requests(points)), "avg", "med", "p90", "p95")


@query(
    "request_log_damage",
    with_views("v_requests", f"""
    SELECT CASE WHEN {_IN_JSON} THEN 'json' ELSE 'csv' END AS format,
      count(*) + count(*) FILTER ({_CUT}) + count(*) FILTER ({_LACKING}) AS lines,
      count(*) FILTER ({_CUT}) + count(*) FILTER ({_LACKING}) AS damaged
    FROM v_requests GROUP BY 1"""),
)
def request_log_damage(spark: SparkSession, base: str) -> DataFrame:
    """Lines and damaged lines by format, summed over the files."""
    found = [L.read_log(spark, path, fmt).damage.withColumn("format", F.lit(fmt)) for fmt, path in zip(("json", "csv"), _written_log(spark, base), strict=True)]
    total = lambda c: F.sum(c).alias(c)
    return found[0].unionByName(found[1]).groupBy("format").agg(total("lines"), total("damaged"))


@query("request_latency_ok", with_views("v_requests", _TREND_SQL.format("WHERE NOT failed")))
def request_latency_ok(spark: SparkSession, base: str) -> DataFrame:
    return _rounded(R.trend_of_successful(V.requests(spark, base)), "avg", "med", "p90", "p95")


@query(
    "request_error_rate",
    with_views("v_requests", """
    SELECT endpoint, count(*) FILTER (failed) AS passes, count(*) FILTER (NOT failed) AS fails,
      round(cast(count(*) FILTER (failed) as double) / cast(count(*) as double), 6) AS value
    FROM v_requests GROUP BY endpoint"""),
)
def request_error_rate(spark: SparkSession, base: str) -> DataFrame:
    return _rounded(R.rate(V.requests(spark, base), R.is_failed(), ["endpoint"]), "value")


_SPAN = "cast(epoch_us(max(ts)) - epoch_us(min(ts)) as double)"


@query(
    "request_counters",
    with_views("v_requests", f"""
    SELECT counter, n AS count, round(cast(n as double) * 1e6 / us, 6) AS rate FROM (
      SELECT unnest(['requests', 'failed_requests', 'successful_signups']) AS counter,
        unnest([count(*), count(*) FILTER (failed), count(*) FILTER (endpoint = 'signup' AND status = 200)]) AS n,
        {_SPAN} AS us
      FROM v_requests)"""),
)
def request_counters(spark: SparkSession, base: str) -> DataFrame:
    flags = {
        "requests": F.lit(True),
        "failed_requests": R.is_failed(),
        "successful_signups": (F.col("endpoint") == "signup") & (F.col("status") == 200),
    }
    return _rounded(R.counters(V.requests(spark, base), flags), "rate")


@query(
    "request_checks",
    with_views("v_requests", """
    SELECT check_group, check_name, count(*) FILTER (check_ok) AS passes, count(*) FILTER (NOT check_ok) AS fails
    FROM v_requests GROUP BY 1, 2"""),
)
def request_checks(spark: SparkSession, base: str) -> DataFrame:
    return R.checks(V.requests(spark, base))


@query(
    "request_thresholds",
    with_views("v_requests", f"""
    t_all AS (SELECT avg(duration_ms) AS a, quantile_cont(duration_ms, 0.95) AS p,
      cast(count(*) FILTER (failed) as double) / count(*) AS f, cast(count(*) as double) * 1e6 / {_SPAN} AS r,
      cast(count(*) FILTER (check_ok) as double) / count(*) AS c FROM v_requests)
    SELECT 'http_req_duration' AS metric, 'avg' AS statistic, '<' AS comparison, 2000e0 AS bound, round(a, 6) AS actual, a < 2000 AS met FROM t_all
    UNION ALL SELECT 'http_req_duration', 'p95', '<', 3000e0, round(p, 6), p < 3000 FROM t_all
    UNION ALL SELECT 'http_req_failed', 'rate', '<', 0.01e0, round(f, 6), f < 0.01 FROM t_all
    UNION ALL SELECT 'http_reqs', 'rate', '>=', 20e0, round(r, 6), r >= 20 FROM t_all
    UNION ALL SELECT 'checks', 'rate', '>', 0.95e0, round(c, 6), c > 0.95 FROM t_all"""),
)
def request_thresholds(spark: SparkSession, base: str) -> DataFrame:
    return _rounded(R.verdicts(V.requests(spark, base)), "actual")


_WINDOWS = """
q_windows AS (SELECT time_bucket(INTERVAL '15 minutes', ts) AS w, client_key, endpoint, count(*) AS requests
  FROM v_requests GROUP BY 1, 2, 3)
"""


@query(
    "quota_by_window",
    with_views("v_requests", f"""{_WINDOWS.strip()},
    q_allowed AS (SELECT *, cast({_ALLOWANCE_SQL} as int) AS allowance FROM q_windows)
    SELECT cast(w as varchar) AS window_start, client_key, endpoint, requests, allowance,
      cast(CASE WHEN requests > allowance THEN requests - allowance ELSE 0 END as bigint) AS excess FROM q_allowed"""),
)
def quota_by_window(spark: SparkSession, base: str) -> DataFrame:
    return as_text(R.quota_by_window(V.requests(spark, base), ALLOWANCES), "window_start")


@query(
    "quota_excess_requests",
    with_views("v_requests", f"""
    SELECT request_id, client_key, endpoint, cast(ts as varchar) AS ts FROM (
      SELECT *, row_number() OVER (PARTITION BY client_key, endpoint, time_bucket(INTERVAL '15 minutes', ts)
        ORDER BY ts, request_id) AS rn FROM v_requests)
    WHERE rn > ({_ALLOWANCE_SQL})"""),
)
def quota_excess_requests(spark: SparkSession, base: str) -> DataFrame:
    over = R.quota_excess(V.requests(spark, base), ALLOWANCES, ties=["request_id"])
    return as_text(over.select("request_id", "client_key", "endpoint", "ts"), "ts")


# Streams over the event table as a file source -----------------------------------------


def _event_stream(spark: SparkSession, base: str) -> DataFrame:
    name = "events.parquet"
    schema = spark.read.parquet(f"{base.rstrip('/')}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(base)


@query(
    "stream_quota",
    with_views("v_requests", f"""{_WINDOWS.strip()}
    SELECT cast(w as varchar) AS window_start, client_key, endpoint, requests FROM q_windows"""),
)
def stream_quota(spark: SparkSession, base: str) -> DataFrame:
    requests = _event_stream(spark, base).selectExpr(*[f"{e} as `{a}`" for e, a in V.REQUESTS])
    place = shared_folder(spark)
    J.run_available(J.quota_stream(requests), f"{place}/state", J.latest_to(f"{place}/out"), "complete")
    return as_text(J.read_latest(spark, f"{place}/out"), "window_start")


@query(
    "stream_latency",
    with_views("v_requests", """
    SELECT cast(time_bucket(INTERVAL '1 minute', ts) as varchar) AS minute_start, count(*) AS requests,
      count(*) FILTER (failed) AS failed,
      round(cast(count(*) FILTER (failed) as double) / count(*), 6) AS error_rate, round(avg(duration_ms), 6) AS avg, """ + _PLACES_SQL + """
    FROM v_requests GROUP BY 1"""),
)
def stream_latency(spark: SparkSession, base: str) -> DataFrame:
    requests = _event_stream(spark, base).selectExpr(*[f"{e} as `{a}`" for e, a in V.REQUESTS])
    place = shared_folder(spark)
    J.run_available(J.latency_stream(requests), f"{place}/state", J.latest_to(f"{place}/out"), "complete")
    out = J.read_latest(spark, f"{place}/out")
    return as_text(_rounded(out, "error_rate", "avg", *R.PERCENTILES), "minute_start")


@query(
    "latency_per_minute",
    with_views("v_requests", """
    SELECT cast(time_bucket(INTERVAL '1 minute', ts) as varchar) AS minute_start, count(*) AS requests,
      count(*) FILTER (failed) AS failed, round(avg(duration_ms), 6) AS avg, """ + _PLACES_SQL + """
    FROM v_requests GROUP BY 1"""),
)
def latency_per_minute(spark: SparkSession, base: str) -> DataFrame:
    out = R.per_minute(V.requests(spark, base)).drop("error_rate")
    return as_text(_rounded(out, "avg", *R.PERCENTILES), "minute_start")


def _served_cart(spark: SparkSession, base: str) -> str:
    """Where the cart and the answers are after the command stream has been served."""
    events = _event_stream(spark, base).selectExpr(*[f"{e} as `{a}`" for e, a in V._event_number("spark")])
    commands = events.filter("event_type <> 'purchase'").selectExpr(*[f"{e} as `{a}`" for e, a in V.SMALL_COMMANDS])
    place = shared_folder(spark)
    start, books, _ = fold_tables(spark, base)
    publish({"cart_items": start}, place, -1)
    J.run_available(commands, f"{place}/state", J.cart_batch(place, books))
    return place


@query("stream_cart", FOLD_SQL)
def stream_cart(spark: SparkSession, base: str) -> DataFrame:
    return as_text(read_published(spark, _served_cart(spark, base), "cart_items"), "created_at", "updated_at")


@query("stream_cart_results", FOLD_RESULTS_SQL)
def stream_cart_results(spark: SparkSession, base: str) -> DataFrame:
    return read_all_published(spark, _served_cart(spark, base), "cart_results").drop("version")
