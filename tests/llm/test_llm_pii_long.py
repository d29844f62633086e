"""Personal data in texts with very many matches, and the array helpers behind it."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quire.llm import pii


@pytest.mark.parametrize("size", [0, 1, 255, 256, 257, 1000])
def test_folds_before_each(spark, size):
    values = [random.Random(size).randint(0, 9) for _ in range(size)]
    df = spark.createDataFrame([(values,)], "v array<int>")
    sums, tops = df.select(pii.before_each(F.col("v"), lambda a, x: a + x), pii.before_each(F.col("v"), F.greatest)).first()
    assert sums == [0, *itertools.accumulate(values)][:size]
    assert tops == [0, *itertools.accumulate(values, max)][:size]


def test_cuts_and_places(spark):
    text = "".join(random.Random(1).choices("ab\n \U0001f600é", k=1500))
    rows = [(text, a, b) for a, b in [(0, 0), (0, 1), (-5, 3), (250, 262), (255, 256), (256, 512), (100, 1400), (1490, 1700), (1500, 1501)]]
    df = spark.createDataFrame(rows, "t string, a int, b int").select("a", "b", pii.cut(pii.runs_of(F.col("t")), F.col("a"), F.col("b")))
    assert all(got == text[max(a, 0) : b] for a, b, got in df.collect())
    df = spark.createDataFrame([([1, 1, 4, 9], x) for x in range(-1, 11)] + [([], 3)], "v array<int>, x int")
    assert all(n == sum(y <= x for y in v) for v, x, n in df.select("v", "x", pii.up_to(F.col("v"), F.col("x"))).collect())


@pytest.mark.parametrize(
    ("unit", "kind", "low", "high"),
    [("x some.one@mail.example.com ", 0, 2, 27), ("\U0001f600 4111 1111 1111 1111 ", 2, 2, 21), ("at 10.0.200.255, ", 1, 3, 15)],
)
def test_many_matches(spark, unit, kind, low, high):
    times = 20_000
    docs = spark.createDataFrame([(1, unit * times)], "doc_id long, text string")
    row = pii.find(docs).first()
    assert [tuple(x) for x in row["base"]] == [(low + i * len(unit), kind, high + i * len(unit)) for i in range(times)]
    want = (unit[:low] + f"<{pii.KINDS[kind].upper()}>" + unit[high:]) * times
    assert pii.redact(docs).first()["text"] == want


def test_address_of_many_labels(spark):
    text = "a@b" + ".cc" * 100_000
    row = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(x) for x in row["base"]] == [tuple(x) for x in row["spans"]] == [(0, 0, len(text))]
