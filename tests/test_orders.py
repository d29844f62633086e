from decimal import Decimal

from helpers import at, book, books, by, table

from quire import schemas
from quire.operators import orders as O


def order(id, user="u1", total="30.00", minute=0, status="completed"):
    return {"id": id, "user_id": user, "total_amount": Decimal(total), "status": status, "created_at": at(minute)}


def item(id, order_id, quantity=1, price="30.00", book_id="Salt Harbor::1", cover="c.jpg"):
    return {
        "id": id, "order_id": order_id, "book_id": book_id, "title": "Salt Harbor", "cover": cover, "unit_price": Decimal(price),
        "quantity": quantity, "line_total": Decimal(price) * quantity,
    }


def orders(spark, *rows):
    return table(spark, schemas.ORDERS, rows)


def items(spark, *rows):
    return table(spark, schemas.ORDER_ITEMS, rows)


def commands(spark, *rows):
    return table(spark, schemas.ORDER_ITEM_COMMANDS, rows)


def command(cmd_id, item_id, order_id=None, quantity=None, user="u1", minute=0, op="set"):
    return {"cmd_id": cmd_id, "user_id": user, "op": op, "order_item_id": item_id, "order_id": order_id, "quantity": quantity, "ts": at(minute)}


def test_history_documents(spark):
    heads = orders(spark, order("o1", total="30.00", minute=1), order("o2", total="60.00", minute=2), order("o3", user="u2"), order("o4", minute=0))
    lines = items(spark, item("i2", "o2", 2, book_id="Salt Harbor::2"), item("i1", "o1"), item("i0", "o1", book_id="SH001", cover=""), item("i9", "o3"))
    users = spark.createDataFrame([("u1",)], "user_id string")
    got = O.order_history(heads, lines, books(spark, book("SH001", "Salt Harbor", cover="book.jpg")), users).collect()
    assert [r["id"] for r in got] == ["o2", "o1", "o4"]
    assert got[0]["purchase_date"] == got[0]["created_at"] == at(2)
    only = got[0]["items"][0]
    assert (only["volume"], only["book_title"], only["price"], only["quantity"]) == ("2", "Salt Harbor", Decimal("30.00"), 2)
    assert [(i["id"], i["volume"], i["cover"]) for i in got[1]["items"]] == [("i0", None, "book.jpg"), ("i1", "1", "c.jpg")]
    assert got[2]["items"] == [] and got[2]["section"] == 0
    flat = O.history_lines(heads, lines, books(spark), users).collect()
    assert sorted((r["order_id"], r["item_id"]) for r in flat if r["item_id"]) == [("o1", "i0"), ("o1", "i1"), ("o2", "i2")]
    assert [r["order_id"] for r in flat if r["item_id"] is None] == ["o4"]


def test_long_order_comes_in_sections(spark):
    lines = items(spark, *[item(f"i{n:03d}", "big") for n in range(30)], item("s", "small"))
    got = O.order_history(orders(spark, order("big"), order("small")), lines, books(spark), section_length=7).collect()
    big = sorted((r for r in got if r["id"] == "big"), key=lambda r: r["section"])
    assert len(big) > 1 and [i["id"] for r in big for i in r["items"]] == [f"i{n:03d}" for n in range(30)]
    assert len([r for r in got if r["id"] == "small"]) == 1


def test_cover_fallback(spark):
    shelf = books(spark, book("A", "a", cover=None), book("B", "b", cover="b.jpg"))
    lines = items(spark, item("1", "o", book_id="A", cover=""), item("2", "o", book_id="B", cover=""), item("3", "o", book_id="Z", cover=""))
    assert by(O.items_with_cover(lines, shelf), "id", "cover") == {"1": "", "2": "b.jpg", "3": ""}


def test_totals_and_charges(spark):
    heads = orders(spark, order("o1", total="1.00", minute=1), order("o2", minute=2), order("o3", minute=3), order("o4", minute=4), order("o5", user="u2"))
    lines = items(spark, item("a", "o1", 2, "10.05"), item("b", "o1", 1, "0.10"), item("c", "o2", 1), item("d", "o4", 3))
    assert by(O.recalculated_totals(heads, lines), "id", "total_amount")["o1"] == Decimal("20.20")
    assert by(O.recalculated_totals(heads, lines), "id", "total_amount")["o3"] == Decimal("0.00")
    assert set(by(O.total_drift(heads, lines), "id", "lines_total")) == {"o1", "o3", "o4", "o5"}
    assert {r["id"] for r in O.without_items(heads, lines).collect()} == {"o3", "o5"}
    got = by(O.charges(heads, lines), "id", "item_count", "subtotal", "delivery_fee", "total")
    assert got["o1"] == (2, Decimal("20.20"), Decimal("2.02"), Decimal("22.22"))
    assert got["o3"] == (0, Decimal("0.00"), Decimal("0.00"), Decimal("0.00"))
    recent = O.recent_purchases(heads, lines).filter("user_id = 'u1'")
    assert by(recent, "id", "rank", "amount") == {"o4": (1, Decimal("99.00")), "o3": (2, Decimal("0.00")), "o2": (3, Decimal("33.00"))}
    assert by(O.purchase_counts(heads, lines), "user_id", "orders", "items") == {"u1": (4, 4), "u2": (1, 0)}


def test_set_line_quantity(spark):
    heads = orders(spark, order("o1", total="60.00"), order("o2", user="u2", total="1.00"))
    lines = items(spark, item("i1", "o1"), item("i2", "o1"), item("i3", "o2"))
    change = O.update_quantities(
        heads,
        lines,
        commands(
            spark, command("k1", "i1", quantity="9"), command("k2", " i1 ", quantity="3", minute=1), command("k3", "i3", quantity="2"),
            command("k4", "i1", quantity="1.5"), command("k5", " ", quantity="1"), command("k6", "zz", quantity="1"),
        ),
    )
    assert by(change.results, "cmd_id", "status") == {"k1": "ok", "k2": "ok", "k3": "not_found", "k4": "invalid", "k5": "invalid", "k6": "not_found"}
    assert by(change.items, "id", "quantity", "line_total")["i1"] == (3, Decimal("90.00"))
    assert by(change.orders, "id", "total_amount") == {"o1": Decimal("120.00"), "o2": Decimal("1.00")}


def test_set_quantity_of_lines_and_orders_that_repeat(spark):
    heads = orders(spark, order("o1"), order("o1"), order("o1", user="u2"), order("o2", user="u3"), order("o3", user=None), order(None))
    lines = items(spark, item("i1", "o1"), item("i1", "o1", 5), item("i1", "o2"), item("i2", "o3"), item("i3", None), item("i4", "o9"), item(None, "o1"))
    change = O.update_quantities(
        heads,
        lines,
        commands(
            spark, command("k1", "i1", quantity="2"), command("k2", "i1", user="u2", quantity="3", minute=1), command("k3", "i1", user="u3", quantity="4", minute=1),
            command("k4", "i1", user="u4", quantity="9", minute=9), command("k5", "i2", user=None, quantity="9"), command("k6", "i3", quantity="9"),
            command("k7", "i4", quantity="9"), command("k8", None, quantity="9"),
        ),
    )
    got = sorted((str(r["id"]), str(r["order_id"]), r["quantity"]) for r in change.items.collect())
    untouched = sorted((str(r["id"]), str(r["order_id"]), r["quantity"]) for r in lines.filter("id is null or id <> 'i1'").collect())
    assert got == sorted([("i1", "o1", 4), ("i1", "o1", 4), ("i1", "o2", 4), *untouched])
    status = {(r["cmd_id"], r["status"]) for r in change.results.collect()}
    assert status == {(f"k{i}", "ok" if i < 4 else "invalid" if i == 8 else "not_found") for i in range(1, 9)}


def test_remove_lines(spark):
    heads = orders(spark, order("o1"), order("o2", total="60.00"), order("o3", user="u2"))
    lines = items(spark, item("i1", "o1"), item("i2", "o1"), item("i3", "o2"), item("i4", "o2", 1, "5.00"), item("i5", "o3"))
    change = O.delete_items(
        heads,
        lines,
        commands(
            spark,
            command("k1", "i1", "o1", op="remove"), command("k2", "i2", "o1", minute=1, op="remove"), command("k3", "i2", "o1", minute=2, op="remove"),
            command("k4", "i3", "o2", op="remove"), command("k5", "i5", "o3", op="remove"), command("k6", "i4", "o1", op="remove"),
            command("k7", "i4", None, op="remove"),
        ),
    )
    assert by(change.results, "cmd_id", "status", "order_deleted") == {
        "k1": ("ok", False), "k2": ("ok", True), "k3": ("not_found", False), "k4": ("ok", False), "k5": ("not_found", False),
        "k6": ("not_found", False), "k7": ("invalid", False),
    }
    assert {r["id"] for r in change.items.collect()} == {"i4", "i5"}
    assert by(change.orders, "id", "total_amount") == {"o2": Decimal("5.00"), "o3": Decimal("30.00")}
    assert {r["id"] for r in O.total_drift(change.orders, change.items).collect()} == set()
