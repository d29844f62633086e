from helpers import add, at, book, books, cart, cart_row, command
from pyspark.sql import functions as F

from quire import schemas
from quire.operators import cart as C
from quire.operators import requests as R
from quire.sources.tables import publish, read_all_published, read_published
from quire.streaming import jobs as J


def write(spark, folder, n, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part={n}")


def log_rows(lo, hi):
    return [(at(m), f"c{m % 3}", "cart", float(m), 500 if m % 7 == 0 else 200, m % 7 == 0) for m in range(lo, hi)]


SCHEMA = "ts timestamp, client_key string, endpoint string, duration_ms double, status int, failed boolean"


def test_streams_equal_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    for n in range(3):
        write(spark, source, n, log_rows(n * 40, n * 40 + 40), SCHEMA)
    stream = spark.readStream.schema(SCHEMA + ", part int").parquet(source).drop("part")
    batch = spark.read.schema(SCHEMA + ", part int").parquet(source).drop("part")
    for name, streamed, whole in (
        ("quota", J.quota_stream(stream), R.quota_counts(batch)),
        ("latency", J.latency_stream(stream), R.per_minute(batch)),
    ):
        out = str(tmp_path / name)
        J.run_available(streamed, f"{out}-state", J.latest_to(out), "complete")
        got = J.read_latest(spark, out).select(*whole.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect()))


def test_late_rows_are_dropped_and_windows_close(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, source, 0, log_rows(0, 30), SCHEMA)

    def run():
        stream = spark.readStream.schema(SCHEMA + ", part int").parquet(source).drop("part")
        J.run_available(J.quota_stream(stream), f"{out}-state", lambda df, n: df.write.mode("append").parquet(out), "append")

    def closed():
        return {r["window_start"]: r["n"] for r in spark.read.parquet(out).groupBy("window_start").agg(F.sum("requests").alias("n")).collect()}

    run()
    write(spark, source, 1, [(at(100), "c0", "cart", 1.0, 200, False)], SCHEMA)  # closes the earlier windows
    run()
    assert closed() == {at(0): 15, at(15): 15}
    write(spark, source, 2, [(at(1), "c0", "cart", 1.0, 200, False), (at(200), "c0", "cart", 1.0, 200, False)], SCHEMA)
    run()
    assert closed()[at(0)] == 15 and closed()[at(90)] == 1


def test_cart_stream_equals_fold_and_repeats(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path / "store")
    shelf = books(spark, book("B1", "T1", "Vol 1"), book("B2", "T2", "Vol 2"))
    start = cart(spark, cart_row("s1", "u1", "B1", 2))
    rows = [
        add("m1", "T1", "1", "3", minute=1), command("m2", "set", minute=2, book_id="B1", quantity="9"), add("m3", "T2", "2", "1", user="u2", minute=3),
        command("m4", "remove", minute=4, book_id="B1"), add("m5", "T1", "1", "4", minute=5), add("m6", "T2", "2", "2", user="u2", minute=6),
    ]
    names = [f.name for f in schemas.CART_COMMANDS.fields]
    publish({"cart_items": start}, base, -1)
    stream = spark.readStream.schema(schemas.CART_COMMANDS).parquet(f"{source}/*")
    writer = J.cart_batch(base, shelf)
    for n in range(3):  # three micro-batches of two commands
        write(spark, source, n, [tuple(r.get(c) for c in names) for r in rows[2 * n : 2 * n + 2]], schemas.CART_COMMANDS)
        J.run_available(stream, f"{base}-state", writer)
    everything = spark.read.schema(schemas.CART_COMMANDS).parquet(f"{source}/*")
    want = C.fold_commands(start, shelf, everything).select(*C.COLUMNS)
    got = read_published(spark, base, "cart_items").select(*C.COLUMNS)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {(r["user_id"], r["book_id"], r["quantity"]) for r in got.collect()} == {("u1", "B1", 4), ("u2", "B2", 3)}
    last = spark.read.schema(schemas.CART_COMMANDS).parquet(f"{source}/part=2")
    writer(last, 2)  # the same batch once more
    answers = read_all_published(spark, base, "cart_results")
    assert {r["cmd_id"]: (r["version"], r["status"]) for r in answers.collect()} == {f"m{n}": ((n - 1) // 2, "ok") for n in range(1, 7)}
    assert answers.count() == 6
    again = read_published(spark, base, "cart_items").select(*C.COLUMNS)
    assert sorted(map(str, again.collect())) == sorted(map(str, want.collect()))
