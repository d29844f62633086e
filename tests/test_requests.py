import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from helpers import at, by

from quire import schemas
from quire.operators import requests as R
from quire.sources import request_log as L


def log(spark, rows):
    schema = (
        "request_id string, ts timestamp, client_key string, endpoint string, duration_ms double, status int, failed boolean, "
        "check_group string, check_name string, check_ok boolean"
    )
    return spark.createDataFrame(rows, schema)


def row(n, minute=0.0, client="c", endpoint="cart", ms=1.0, status=200, ok=True):
    return (f"r{n:04d}", at(minute), client, endpoint, float(ms), status, status == 0 or status >= 400, "g", "status 200", ok)


def test_exact_percentiles(spark):
    rng = random.Random(5)
    values = {
        "wide": [rng.lognormvariate(6, 2) for _ in range(3000)],
        "ties": [5.0] * 1500 + [rng.random() for _ in range(40)] + [9.0] * 10,
        "one": [3.5],
        None: [float(i) for i in range(101)],
    }
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("one", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in R.trend(df, ["k"], "v").collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        for name, p in R.PERCENTILES.items():
            assert got[k][name] == pytest.approx(np.percentile(vs, 100 * p), rel=1e-12), (k, name)


def test_trend_rate_counters_checks(spark):
    df = log(spark, [row(0, 0, ms=10), row(1, 1, ms=20, status=500, ok=False), row(2, 2, ms=60, endpoint="books"), row(3, 4, ms=30)])
    got = by(R.trend(df), "endpoint")
    assert (got["cart"]["avg"], got["cart"]["med"], got["cart"]["min"], got["cart"]["max"]) == (20.0, 20.0, 10.0, 30.0)
    assert by(R.trend_of_successful(df), "endpoint", "avg")["cart"] == 20.0
    rough = by(R.trend(df, exact=False), "endpoint")["cart"]
    assert rough["n"] == 3 and rough["med"] == 20.0
    assert tuple(R.rate(df, R.is_failed()).first()) == (1, 3, 0.25)
    counted = by(R.counters(df, {"failed": R.is_failed()}), "counter", "count", "rate")
    assert counted["failed"] == (1, 1 / 240)
    assert tuple(R.checks(df).first())[2:] == (3, 1)


def test_verdicts(spark):
    df = log(spark, [row(n, n / 600, ms=100) for n in range(60)] + [row(99, 0.1, ms=2500, status=500, ok=False)])
    got = by(R.verdicts(df).withColumnRenamed("metric", "m").selectExpr("m || ':' || statistic as k", "met"), "k", "met")
    assert got == {
        "http_req_duration:avg": True, "http_req_duration:p95": True, "http_req_failed:rate": False, "http_reqs:rate": False, "checks:rate": True,
    }


def test_quota(spark):
    rows = [row(n, minute=n / 10, endpoint="orders") for n in range(60)] + [row(100, 16, endpoint="orders"), row(101, 1, endpoint="free")]
    df = log(spark, rows)
    counts = {(r["window_start"], r["endpoint"]): (r["requests"], r["allowance"], r["excess"]) for r in R.quota_by_window(df).collect()}
    assert counts[at(0), "orders"] == (60, 50, 10) and counts[at(15), "orders"] == (1, 50, 0)
    assert counts[at(0), "free"] == (1, None, 0)
    over = R.quota_excess(df, ties=["request_id"])
    assert sorted(r["request_id"] for r in over.collect()) == [f"r{n:04d}" for n in range(50, 60)] and over.columns == df.columns
    assert R.quota_excess(df.drop("request_id")).count() == 10
    burst = log(spark, [row(n, minute=0, endpoint="orders") for n in range(3000)])
    assert R.quota_excess(burst, {"orders": 2500}, ties=["request_id"]).agg(F.min("request_id"), F.count("*")).first()[:] == ("r2500", 500)
    assert R.quota_excess(df, {}, default=1).count() == 59
    assert R.quota_excess(df, {"orders": 0}).count() == 61


def test_raw_points(spark, tmp_path):
    points = [
        {"type": "Metric", "metric": "http_req_duration", "data": {"name": "x"}},
        {"type": "Point", "metric": "http_req_duration",
         "data": {"time": "2026-01-01T00:00:01Z", "value": 12.5, "tags": {"name": "GET /api/books", "status": "200", "expected_response": "true"}}},
        {"type": "Point", "metric": "checks", "data": {"time": "2026-01-01T00:00:02Z", "value": 1, "tags": {"check": "status 200", "group": "::Browse"}}},
    ]
    path = tmp_path / "points.json"
    path.write_text("\n".join(json.dumps(p) for p in points))
    df = L.read_points(spark, str(path))
    assert df.count() == 2
    got = L.points_to_requests(df).first()
    assert (got["endpoint"], got["duration_ms"], got["status"], got["failed"], got["ts"]) == ("GET /api/books", 12.5, 200, False, at(1 / 60))
    csv = tmp_path / "points.csv"
    csv.write_text(
        "metric_name,timestamp,metric_value,check,error,expected_response,group,name,status\n"
        "http_req_duration,1767225601,12.5,,,true,::Browse,GET /api/books,200\n"
    )
    assert L.points_to_requests(L.read_points_csv(spark, str(csv))).first() == got


def test_statistics_from_raw_points(spark, tmp_path):
    def point(metric, second, value, **tags):
        return {"type": "Point", "metric": metric, "data": {"time": f"2026-01-01T00:00:{second:02d}Z", "value": value, "tags": tags}}

    rows = [("200", "true", 10.0), ("0", "false", 0.0), ("500", "false", 40.0)]
    points = [point("http_req_duration", n, v, name="GET /x", status=s, expected_response=e) for n, (s, e, v) in enumerate(rows)]
    points += [point("checks", n, ok, check="status 200", group="::G") for n, ok in enumerate([1, 0, 1, 1])]
    (tmp_path / "p.json").write_text("\n".join(json.dumps(p) for p in points))
    lines = ["metric_name,timestamp,metric_value,check,error,expected_response,group,name,status"]
    lines += [f"http_req_duration,{1767225600 + n},{v},,,{e},,GET /x,{s}" for n, (s, e, v) in enumerate(rows)]
    lines += [f"checks,{1767225600 + n},{ok},status 200,,,::G,," for n, ok in enumerate([1, 0, 1, 1])]
    (tmp_path / "p.csv").write_text("\n".join(lines) + "\n")
    for found in (L.read_points(spark, str(tmp_path / "p.json")), L.read_points_csv(spark, str(tmp_path / "p.csv"))):
        requests, checked = L.points_to_requests(found), L.points_to_checks(found)
        assert requests.columns == schemas.REQUESTS.names
        assert R.rate(requests, R.is_failed()).first()[:] == (2, 1, pytest.approx(2 / 3))
        assert [r["n"] for r in R.trend_of_successful(requests).collect()] == [1]
        assert R.checks(checked).first()[:] == ("::G", "status 200", 3, 1)
        got = {(r["metric"], r["statistic"]): (r["actual"], r["met"]) for r in R.verdicts(requests, checked=checked).collect()}
        assert got["checks", "rate"] == (0.75, False) and got["http_req_failed", "rate"] == (pytest.approx(2 / 3), False)
        assert got["http_reqs", "rate"] == (1.5, False) and got["http_req_duration", "p95"] == (pytest.approx(37.0), True)
        assert R.counters(requests, {"failed": R.is_failed()}).first()["count"] == 2
        assert R.quota_excess(requests.fillna("c", ["client_key"]), {"GET /x": 1}).count() == 2


def test_requests_and_summary(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"ts":"2026-01-01T00:00:00Z","client_key":"c","endpoint":"cart","duration_ms":3.5,"status":200}\n')
    (tmp_path / "r.csv").write_text(
        "ts,client_key,endpoint,duration_ms,status,failed,check_group,check_name,check_ok\n2026-01-01T00:00:00Z,c,cart,3.5,200,,,,\n"
    )
    from_json = L.read_requests(spark, str(tmp_path / "r.json")).collect()
    assert from_json == L.read_requests(spark, str(tmp_path / "r.csv"), "csv").collect() and from_json[0]["ts"] == at(0)
    summary = {"metrics": {"http_req_duration": {"avg": 1.5, "p(95)": 3.0, "thresholds": {"avg<2000": False}}, "http_reqs": {"count": 10, "rate": 2.5}}}
    (tmp_path / "s.json").write_text(json.dumps(summary, indent=2))
    got = by(L.read_summary(spark, str(tmp_path / "s.json")), "metric")
    assert got["http_req_duration"]["p(95)"] == 3.0 and got["http_reqs"]["rate"] == 2.5
    assert got["http_req_duration"]["thresholds"] == {"avg<2000": False}


def test_damaged_lines_are_left_out_and_counted(spark, tmp_path):
    sound = {"type": "Point", "metric": "m", "data": {"time": "2026-01-01T00:00:00Z", "value": 2.5, "tags": {"name": "GET /x"}}}
    header = {"type": "Metric", "metric": "m", "data": {}}
    lacking = [{**sound, "metric": None}, {**sound, "data": {"time": "2026-01-01T00:00:00Z"}}, {**sound, "data": {"time": "soon", "value": 1.0}}, {}]
    for name, lines in (("a", [header, sound, *lacking]), ("b", [sound, sound])):
        text = "\n".join(map(json.dumps, lines)) + "\n" + (json.dumps(sound)[:50] + "\nnot a line\n" if name == "a" else "")
        (tmp_path / f"{name}.json").write_text(text)
    log = L.read_log(spark, f"{tmp_path}/*.json")
    assert by(log.damage, "file", "lines", "damaged") == {"a.json": (8, 6), "b.json": (2, 0)}
    assert [r["value"] for r in log.points.collect()] == [2.5] * 3
    (tmp_path / "c.csv").write_text(
        "metric_name,timestamp,metric_value,name,group,check,status,expected_response\n"
        "m,1767225600,2.5,GET /x,,,200,true\nm,soon,2.5,GET /x,,,200,true\nm,1767225600,fast,,,,x,\nm,17672\n,1767225600,1.0,,,,,\n"
    )
    log = L.read_log(spark, f"{tmp_path}/c.csv", "csv")
    assert by(log.damage, "file", "lines", "damaged") == {"c.csv": (5, 4)}
    assert [(r["ts"], r["value"], r["expected"]) for r in log.points.collect()] == [(at(0), 2.5, True)]
