from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quire.functions import exprs as X


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text, want",
    [("  a b ", "a b"), ("\t\n a ", "a"), ("   ", None), ("", None), (None, None), ("﻿x　", "x"), ("\x85a", "\x85a")],
)
def test_text_or_null(spark, text, want):
    assert one(spark, X.text_or_null, text) == want


def test_space_only_trim_keeps_tabs(spark):
    assert one(spark, X.is_blank, "\t") is False
    assert one(spark, X.is_blank, "  ") is True
    assert one(spark, X.is_blank, None) is True


@pytest.mark.parametrize(
    "text, want",
    [
        ("3", 3), (" 3 ", 3), ("2e0", 2), ("1.0", 1), ("1.5", None), ("0", None), ("-1", None), ("abc", None), ("", None),
        (None, None), ("1d", None), ("Infinity", None), ("NaN", None), ("2147483647", 2147483647), ("2147483648", None),
        ("+4", 4), (".5e1", 5), ("1e999", None),
    ],
)
def test_quantity(spark, text, want):
    assert one(spark, X.quantity_or_null, text) == want


def test_quantity_after_many_zeros(spark):
    assert [one(spark, X.quantity_or_null, b + "0" * 4100 + "5") for b in ("0x", "0o")] == [5, 5]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Vol 2", 2.0), ("Vol 2.5", 2.5), ("7", 7.0), (None, None), ("", None), ("Vol ", None), ("Vol Vol 1", None),
        ("Special", None), ("Vol 1d", None), ("Vol 1e999", None), ("Vol -1e999", None), ("x Vol 1", None),
    ],
)
def test_volume_number(spark, text, want):
    assert one(spark, X.volume_number, text) == want


def test_prefix_goes_once(spark):
    assert one(spark, X.strip_volume_prefix, "Vol Vol 1") == "Vol 1"
    assert one(spark, X.canonical_volume, "Vol 3") == "Vol 3"
    assert one(spark, X.canonical_volume, "3") == "Vol 3"


def test_lists(spark):
    assert one(spark, X.to_list, " Action, ,Fantasy ,") == ["Action", "Fantasy"]
    assert one(spark, X.to_list, None) == []
    as_array = lambda c: X.to_list(c, True)
    assert one(spark, as_array, [" Popular ", " New ", "42", " "], "array<string>") == ["Popular", "New", "42"]
    assert one(spark, as_array, None, "array<string>") == []
    assert one(spark, as_array, [1, 2], "array<int>") == ["1", "2"]


def test_book_volume(spark):
    assert one(spark, X.book_volume, "Salt Harbor::2") == "2"
    assert one(spark, X.book_volume, "a::b::c") == "b"
    for text in ("SH001", "Salt Harbor::", "", None):
        assert one(spark, X.book_volume, text) is None


@pytest.mark.parametrize(
    "book_id, title, volume, want",
    [
        (None, " Salt Harbor ", " 1 ", ("Salt Harbor", "1")),
        ("Marrow::2", "Salt Harbor", None, ("Marrow", "2")),
        ("Marrow::2", "Salt Harbor", "5", ("Marrow", "5")),
        ("::2", "Salt Harbor", None, (None, "2")),
        ("SH001", "Salt Harbor", "1", ("Salt Harbor", "1")),
    ],
)
def test_requested_book(spark, book_id, title, volume, want):
    df = spark.createDataFrame([(book_id, title, volume)], "b string, t string, v string")
    assert tuple(df.select(X.requested_book("b", "t", "v").alias("r")).first()["r"]) == want


def test_distinct_ids(spark):
    got = one(spark, X.distinct_ids, [" b ", "a", "b", "", None, "a"], "array<string>")
    assert got == ["b", "a"]
    assert one(spark, X.distinct_ids, None, "array<string>") == []


@pytest.mark.parametrize(
    "cover, book_id, want",
    [
        ("images/sl_vol_2.jpg", "TO009", "Vol 2"), (None, "SH003", "Vol 3"), ("x.jpg", "AB000", "Vol 1"), (None, None, "Vol 1"),
        ("x.jpg", "AB010", "Vol 10"), ("a_vol_012.jpg", "X1", "Vol 012"),
    ],
)
def test_repaired_volume(spark, cover, book_id, want):
    df = spark.createDataFrame([(cover, book_id)], "c string, b string")
    assert df.select(X.repaired_volume("c", "b").alias("v")).first()["v"] == want


def test_money(spark):
    assert one(spark, X.delivery_fee, Decimal("10.05"), "decimal(10,2)") == Decimal("1.01")
    assert one(spark, X.delivery_fee, Decimal("0.00"), "decimal(10,2)") == Decimal("0.00")
    assert one(spark, X.display_price, Decimal("30.00"), "decimal(10,2)") == Decimal("29.99")
    assert one(spark, X.money_text, Decimal("2.675"), "decimal(10,3)") == "2.68"


def test_clamp(spark):
    got = [one(spark, lambda c, s=s: X.clamp_quantity(c, s), q, "int") for q, s in ((10, 1), (1, -1), (4, 1), (40, -1))]
    assert got == [10, 1, 5, 10]


def test_links_round_trip(spark):
    title = "Kaguya-sama: Love Is War! (it's ~100% + é/ñ*)"
    link = one(spark, lambda c: X.book_link(c, F.lit("2")), title)
    assert link == (
        "/book/Kaguya-sama%3A%20Love%20Is%20War!%20(it's%20~100%25%20%2B%20%C3%A9%2F%C3%B1*)/2"
    )
    assert one(spark, X.decode_component, link.split("/")[2]) == title
    assert one(spark, X.decode_component, "a+b") == "a+b"


def test_derived_ids_repeat(spark):
    first = one(spark, lambda c: X.derived_id(c), "c1")
    assert first == one(spark, lambda c: X.derived_id(c), "c1") and len(first) == 36
