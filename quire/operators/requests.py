"""Request-log statistics: trends, rates, counters, checks, verdicts and quotas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.skew import running, same_keys, written

# Window length, requests allowed per window, percentiles and the targets
# a run is held against (metric, statistic, comparison, bound).
WINDOW = "15 minutes"
ALLOWANCES = {"auth": 20, "profile": 100, "books": 200, "cart": 100, "orders": 50, "order-items": 100}
PERCENTILES = {"med": 0.5, "p90": 0.9, "p95": 0.95}
TARGETS = (
    ("http_req_duration", "avg", "<", 2000.0),
    ("http_req_duration", "p95", "<", 3000.0),
    ("http_req_failed", "rate", "<", 0.01),
    ("http_reqs", "rate", ">=", 20.0),
    ("checks", "rate", ">", 0.95),
)
_ACCURACY = 10_000


def _ratio(part: Column, whole: Column) -> Column:
    return part.cast("double") / whole.cast("double")


def trend(
    requests: DataFrame,
    by: Sequence[str] = ("endpoint",),
    value: str = "duration_ms",
    exact: bool = True,
    wanted: Mapping[str, float] = PERCENTILES,
) -> DataFrame:
    """n, avg, min, max and the wanted percentiles per group; ``exact=False`` takes approximate
    percentiles in the same single pass.

    For the exact ones rows are counted per group and value, and running counts over the values
    tell which of them stand at the wanted places, for all percentiles at once.
    """
    by = list(by)
    if not exact:
        rough = F.percentile_approx(value, list(wanted.values()), _ACCURACY).alias("_p")
        simple = [F.count(value).alias("n"), F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max")]
        out = requests.groupBy(*by).agg(*simple, rough)
        return out.withColumns({n: F.col("_p")[i] for i, n in enumerate(wanted)}).drop("_p")
    values = requests.select(*by, F.col(value).cast("double").alias("_v"))
    counted = running(values.groupBy(*by, "_v").agg(F.count("_v").alias("_c")), by, ["_v"], F.col("_c"))
    totals = written(
        counted.groupBy(*by).agg(
            F.sum("_c").alias("n"),
            (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("avg"),
            F.min("_v").alias("min"),
            F.max("_v").alias("max"),
        )
        if by
        else counted.agg(
            F.coalesce(F.sum("_c"), F.lit(0)).alias("n"),
            (F.sum(F.col("_v") * F.col("_c")) / F.nullif(F.sum("_c"), F.lit(0))).alias("avg"),
            F.min("_v").alias("min"),
            F.max("_v").alias("max"),
        )
    )
    place = same_keys(counted, totals.select(*by, "n"), by)
    picks, shown = [], {}
    for name, p in wanted.items():
        at = (F.col("n") - 1) * F.lit(p)
        for side, k in (("low", F.floor(at)), ("high", F.ceil(at))):
            here = (F.col("before") <= k) & (k < F.col("before") + F.col("_c"))
            picks.append(F.max(F.when(here, F.col("_v"))).alias(f"_{side}_{name}"))
        part = (F.col("n") - 1) * F.lit(p) - F.floor((F.col("n") - 1) * F.lit(p))
        shown[name] = F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * part
    found = same_keys(totals, place.groupBy(*by).agg(*picks), by)
    return found.select(*by, "n", "avg", "min", "max", *[c.alias(n) for n, c in shown.items()])


def is_failed() -> Column:
    """As the log says; a refused or timed-out request has failed whatever its status."""
    return F.col("failed")


def trend_of_successful(requests: DataFrame, by: Sequence[str] = ("endpoint",), **options) -> DataFrame:
    return trend(requests.filter(~is_failed()), by, **options)


def rate(rows: DataFrame, flag: Column, by: Sequence[str] = ()) -> DataFrame:
    """passes (flag true), fails and their share."""
    counted = rows.groupBy(*by).agg(F.count_if(flag).alias("passes"), F.count_if(~flag).alias("fails"))
    return counted.withColumn("value", _ratio(F.col("passes"), F.col("passes") + F.col("fails")))


def counters(rows: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """Count and per-second rate of each named condition over the span of the log."""
    span = F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))
    one = rows.agg(span.alias("_us"), *[F.count_if(c).alias(n) for n, c in flags.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("counter"), F.col(n).alias("count")) for n in flags])
    return one.select("_us", F.inline(pairs)).select(
        "counter",
        "count",
        F.when(F.col("_us") > 0, F.col("count").cast("double") * 1000000.0 / F.col("_us").cast("double")).alias("rate"),
    )


def checks(rows: DataFrame) -> DataFrame:
    """Passes and fails of every check in its group."""
    return rows.groupBy("check_group", "check_name").agg(
        F.count_if("check_ok").alias("passes"), F.count_if(~F.col("check_ok")).alias("fails")
    )


def run_statistics(requests: DataFrame, checked: DataFrame | None = None) -> DataFrame:
    """The statistics the targets speak of, as (metric, statistic, actual) rows.

    ``checked`` holds the checks (check_ok) where the log keeps them apart from the requests.
    """
    latency = trend(requests, [])
    span = F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))
    rest = requests.agg(
        span.cast("double").alias("_us"), F.count(F.lit(1)).alias("_requests"), F.count_if(is_failed()).alias("_failed")
    )
    passed = (requests if checked is None else checked).agg(
        F.count_if("check_ok").alias("_passed"), F.count("check_ok").alias("_checked")
    )
    one = same_keys(same_keys(latency, rest, []), passed, [])
    values = (
        ("http_req_duration", "avg", F.col("avg")),
        ("http_req_duration", "p95", F.col("p95")),
        ("http_req_failed", "rate", _ratio(F.col("_failed"), F.col("_requests"))),
        ("http_reqs", "rate", F.col("_requests").cast("double") * 1000000.0 / F.nullif(F.col("_us"), F.lit(0.0))),
        ("checks", "rate", _ratio(F.col("_passed"), F.col("_checked"))),
    )
    rows = [F.struct(F.lit(m).alias("metric"), F.lit(s).alias("statistic"), v.alias("actual")) for m, s, v in values]
    return one.select(F.inline(F.array(*rows)))


def verdicts(requests: DataFrame, targets=TARGETS, checked: DataFrame | None = None) -> DataFrame:
    """Each target with the actual value and whether it is met."""
    spark = requests.sparkSession
    rules = spark.createDataFrame(list(targets), "metric string, statistic string, comparison string, bound double")
    actual, bound = F.col("actual"), F.col("bound")
    met = (
        F.when(F.col("comparison") == "<", actual < bound)
        .when(F.col("comparison") == ">", actual > bound)
        .when(F.col("comparison") == ">=", actual >= bound)
        .otherwise(actual <= bound)
    )
    found = run_statistics(requests, checked)
    return found.join(F.broadcast(rules), ["metric", "statistic"]).withColumn("met", met)


def _allowance(allowances: Mapping[str, int], default: int | None) -> Column:
    table = F.create_map(*[F.lit(x) for pair in allowances.items() for x in pair]) if allowances else None
    found = F.try_element_at(table, F.col("endpoint")) if table is not None else F.lit(None).cast("int")
    return F.coalesce(found, F.lit(default).cast("int"))


def quota_counts(requests: DataFrame, window: str = WINDOW) -> DataFrame:
    """Requests per client, endpoint and clock-aligned window."""
    return (
        requests.groupBy(F.window("ts", window).alias("w"), "client_key", "endpoint")
        .agg(F.count(F.lit(1)).alias("requests"))
        .select(F.col("w.start").alias("window_start"), "client_key", "endpoint", "requests")
    )


def quota_by_window(
    requests: DataFrame,
    allowances: Mapping[str, int] = ALLOWANCES,
    default: int | None = None,
    window: str = WINDOW,
) -> DataFrame:
    """Counts against the endpoint's allowance; NULL allowance means none applies."""
    allowed = _allowance(allowances, default)
    excess = F.greatest(F.col("requests") - F.col("allowance"), F.lit(0))
    return (
        quota_counts(requests, window)
        .withColumn("allowance", allowed)
        .withColumn("excess", F.coalesce(excess, F.lit(0)).cast("long"))
    )


def quota_excess(
    requests: DataFrame,
    allowances: Mapping[str, int] = ALLOWANCES,
    default: int | None = None,
    window: str = WINDOW,
    ties: Sequence[str] = (),
) -> DataFrame:
    """The requests beyond the allowance of their client, endpoint and window, in order of
    time and then of ``ties`` (rows equal in these may stand for each other).

    Requests are counted per second first.  The running counts over the seconds of a window, of
    which it has few, tell which seconds are allowed whole, which are beyond, and in which one the
    allowance ends; only that second's requests are ranked.
    """
    group = ["_w", "client_key", "endpoint"]
    limited = requests.withColumns(
        {"_allowed": _allowance(allowances, default), "_w": F.window("ts", window)["start"], "_s": F.date_trunc("second", "ts")}
    ).filter(F.col("_allowed").isNotNull())
    earlier = Window.partitionBy(*group).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    seconds = limited.groupBy(*group, "_s", "_allowed").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    )
    over = written(seconds.filter(F.col("_before") + F.col("_n") > F.col("_allowed")).select(*group, "_s", "_before"))
    late = same_keys(limited, over, [*group, "_s"])
    beyond = late.filter(F.col("_before") >= F.col("_allowed"))
    at = Window.partitionBy(*group, "_s").orderBy("ts", *ties)
    ends = late.filter(F.col("_before") < F.col("_allowed")).withColumn("_rank", F.row_number().over(at))
    cut = ends.filter(F.col("_before") + F.col("_rank") > F.col("_allowed"))
    return beyond.select(*requests.columns).unionByName(cut.select(*requests.columns))


def per_minute(requests: DataFrame, length: str = "1 minute") -> DataFrame:
    """Latency and error rate per tumbling minute, in a form that also streams."""
    names = list(PERCENTILES)
    rough = F.percentile_approx("duration_ms", [PERCENTILES[n] for n in names], _ACCURACY)
    out = requests.groupBy(F.window("ts", length).alias("w")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(is_failed()).alias("failed"),
        F.sum("duration_ms").alias("_sum"),
        rough.alias("_p"),
    )
    return out.select(
        F.col("w.start").alias("minute_start"),
        "requests",
        "failed",
        _ratio(F.col("failed"), F.col("requests")).alias("error_rate"),
        (F.col("_sum") / F.col("requests")).alias("avg"),
        *[F.col("_p")[i].alias(n) for i, n in enumerate(names)],
    )
