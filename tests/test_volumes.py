"""What is shuffled, read and held grows no faster than it must."""

import re

from pyspark.sql import functions as F

from quire.llm import divergence
from quire.operators import cart as C
from quire.operators import catalog
from quire.operators import orders as O
from quire.operators import quality as Q
from quire.operators import skew as S
from quire.plans import views as V

BASE = "/root/testdata/sf0.001"


def plan(df, mode="simple"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def test_lines_are_shuffled_by_order_only_once(spark):
    text = plan(O.order_history(V.orders(spark, BASE), V.items(spark, BASE), V.books(spark, BASE)))
    assert len(re.findall(r"Exchange hashpartitioning\(order_id#\d+, \d+\)", text)) == 1


def test_orders_with_very_many_lines_keep_their_sections(spark, monkeypatch):
    orders, books = V.orders(spark, BASE), V.books(spark, BASE)
    odd = V.items(spark, BASE).limit(1).withColumn("order_id", F.lit(None).cast("string"))
    items = V.items(spark, BASE).unionByName(odd)
    before = O.order_history(orders, items, books, section_length=2).select("id", "section", F.col("items.id").alias("lines"))
    monkeypatch.setattr(S, "SECTION", 3)
    assert 0 < S.crowded(items, ["order_id"]).count() < orders.count()
    after = O.order_history(orders, items, books, section_length=2).select("id", "section", F.col("items.id").alias("lines"))
    assert sorted(map(tuple, before.collect())) == sorted(map(tuple, after.collect()))
    assert after.select(F.sum(F.size("lines"))).first()[0] == V.items(spark, BASE).join(orders.select(F.col("id").alias("order_id")), "order_id").count()


def test_starts_of_parts_are_few(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(S, "written", lambda df: kept.append(df) or df)
    rows = spark.range(5000).select((F.col("id") % 1000).alias("k"), "id")
    numbered = S.running(rows, ["k"], ["id"], F.lit(1))
    assert numbered.filter("before <> floor(id / 1000)").count() == 0
    assert kept[1].count() < 200


def test_rows_of_other_users_are_not_shuffled_for_a_batch(spark):
    adds = V.commands(spark, BASE).filter("op = 'add'")
    text = plan(C.add_to_cart(V.cart(spark, BASE), V.books(spark, BASE), adds).cart)
    assert "LeftAnti" in text and "LeftSemi" in text


def test_the_cart_is_looked_up_once_for_a_mixed_batch(spark, monkeypatch):
    calls, stored = [], C._stored
    monkeypatch.setattr(C, "_stored", lambda *a: calls.append(1) or stored(*a))
    C.fold(V.small_cart(spark, BASE), V.small_books(spark, BASE), V.small_commands(spark, BASE))
    assert len(calls) == 1


def test_owners_are_told_once(spark):
    asked = spark.createDataFrame([("1",)] * 50 + [("2",), (None,)], "user_id string")
    assert C._owners(asked).count() == 3
    assert "Scan ExistingRDD" not in plan(C.cart_view(V.cart(spark, BASE), asked))


def test_changed_lines_need_no_table_of_hits(spark, monkeypatch):
    monkeypatch.setattr(O, "written", lambda df: 1 / 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sets = V.line_commands(spark, BASE).filter("op = 'set'")
        text = plan(O.update_quantities(V.orders(spark, BASE), V.items(spark, BASE), sets).items)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Two for the commands' own join, by order lines and owners, by line commands, owned lines and lines.
    assert text.count("Exchange hashpartitioning") == 7


def test_deleted_users_are_read_from_a_small_table(spark):
    tables = {"users": V.users(spark, BASE), "cart_items": V.cart(spark, BASE), "orders": V.orders(spark, BASE), "order_items": V.items(spark, BASE)}
    gone = spark.createDataFrame([("1",)] * 5 + [(None,)], "id string")
    left = Q.cascade_delete_users(tables, gone)
    assert all("Scan ExistingRDD" not in plan(left[t]) for t in tables)
    assert left["users"].count() == tables["users"].count() - 1
    assert left["cart_items"].count() == tables["cart_items"].filter("user_id <> '1'").count()


def test_lines_of_a_hot_book_are_not_sorted(spark):
    items = V.items(spark, BASE)
    assert "ShuffledHashJoin" in plan(catalog.backfill_item_covers(items, V.books(spark, BASE)))


def test_totals_of_histograms_are_summed_once():
    assert str(divergence.distance(F.col("p"), F.col("q"))).count("aggregate(") <= 3


def test_counts_of_characters(spark):
    text = "Äa b#1\t Zz, [*]\n\nein—wort 日本\x0b(x)$"
    row = divergence.features(spark.createDataFrame([(1, text, "de"), (2, None, None)], "doc_id long, text string, lang string")).orderBy("doc_id").first()
    inside = [c for c in text if c not in " \t\n\x0b\x0c\r"]
    assert row["word_chars"] == len(inside) and row["n_symbols"] == sum(c in "#*$%&|<>" for c in inside)
    counted = [sum(map(f, inside)) for f in (lambda c: c in "#*$%&|<>", str.isupper, str.isdigit, lambda c: c in ".,;:!?'\"()-", lambda c: ord(c) > 127)]
    assert list(row["chars"])[:5] == [float(n) for n in counted]
