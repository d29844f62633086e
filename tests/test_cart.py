import random
from decimal import Decimal

import pytest
from helpers import add, at, book, books, by, cart, cart_row, command, commands

from quire.functions import exprs as X
from quire.operators import cart as C


def shelf(spark):
    return books(
        spark,
        book("SH001", "Salt Harbor", "Vol 1", "30.00", cover="op1.jpg"),
        book("SH001B", "salt harbor", "Vol 1", "99.00"),
        book(None, "Lanterns of the Valley", "Vol 1"),
        book("COTE002", "Lanterns of the Valley", "Vol 2", "14.00", cover=None),
    )


def test_view_consolidates_and_keeps_owners_apart(spark):
    df = cart(
        spark,
        cart_row("c1", quantity=2, minute=1, price="10.00", title="old"),
        cart_row("c2", quantity=3, minute=5, title="new"),
        cart_row("c3", book_id="SH002", minute=9),
        cart_row("c4", user="u2", quantity=7),
    )
    asked = spark.createDataFrame([("u1",), ("u1",)], "user_id string")
    got = C.cart_view(df, asked).collect()
    assert [r["id"] for r in got] == ["c3", "c2"]
    assert (got[1]["quantity"], got[1]["price"], got[1]["book_title"]) == (5, Decimal("30.00"), "new")
    assert {r["id"] for r in C.duplicates(df).collect()} == {"c1"}
    assert C.consolidate(df).groupBy().sum("quantity").first()[0] == 13


def test_equal_times_fall_back_to_id(spark):
    df = cart(spark, cart_row("c1", quantity=1), cart_row("c2", quantity=1))
    assert C.consolidate(df).first()["id"] == "c2"


def test_add_takes_catalog_values(spark):
    change = C.add_to_cart(
        cart(spark),
        shelf(spark),
        commands(
            spark,
            add("a1", quantity="2"),
            add("a2", title="Lanterns of the Valley", volume="Vol 1"),
            add("a3", title="Lanterns of the Valley", volume="Vol 2"),
            add("a4", title="Nothing"),
            add("a5", quantity="0"),
            add("a6", title=" "),
            add("a7", user="u2", title="x", volume="1", book_id="SALT harbor::9"),
            add("a8", user="u2", title="SALT HARBOR", volume=None, book_id="Salt Harbor::1"),
        ),
    )
    assert by(change.results, "cmd_id", "status") == {
        "a1": "ok", "a2": "not_found", "a3": "ok", "a4": "not_found", "a5": "invalid", "a6": "invalid", "a7": "ok", "a8": "invalid",
    }
    got = {(r["user_id"], r["book_id"]): r for r in change.cart.collect()}
    assert set(got) == {("u1", "SH001"), ("u1", "COTE002"), ("u2", "SH001")}
    piece = got["u1", "SH001"]
    assert (piece["unit_price"], piece["cover"], piece["volume"], piece["quantity"]) == (Decimal("30.00"), "op1.jpg", "1", 2)
    assert got["u1", "COTE002"]["cover"] == "" and piece["id"] is not None


def test_two_adds_make_one_row(spark):
    change = C.add_to_cart(cart(spark), shelf(spark), commands(spark, add("a1", quantity="2"), add("a2", quantity="3", minute=101)))
    row = change.cart.collect()
    assert len(row) == 1 and row[0]["quantity"] == 5
    assert row[0]["created_at"] == at(100) and row[0]["updated_at"] == at(101)


def test_add_merges_into_newest_of_duplicates(spark):
    df = cart(
        spark,
        cart_row("cart-1", quantity=2, minute=1),
        cart_row("cart-2", quantity=3, minute=2, price="11.00"),
        cart_row("other-1", book_id="Z", quantity=1, minute=1),
        cart_row("other-2", book_id="Z", quantity=1, minute=2),
    )
    got = by(C.add_to_cart(df, shelf(spark), commands(spark, add("a1", quantity="2"))).cart, "id")
    assert set(got) == {"cart-2", "other-1", "other-2"}
    assert got["cart-2"]["quantity"] == 7 and got["cart-2"]["unit_price"] == Decimal("11.00")
    assert got["cart-2"]["updated_at"] == at(100)


def test_set_and_remove_respect_ownership(spark):
    df = cart(spark, cart_row("cart-1"), cart_row("cart-2", user="u2"))
    sets = commands(
        spark,
        command("s1", "set", cart_item_id="cart-1", quantity="9"),
        command("s2", "set", cart_item_id="cart-1", quantity="3", minute=101),
        command("s3", "set", cart_item_id="cart-2", quantity="3"),
        command("s4", "set", cart_item_id="cart-1", quantity="x", minute=102),
    )
    change = C.set_quantity(df, sets)
    assert by(change.results, "cmd_id", "status") == {"s1": "ok", "s2": "ok", "s3": "not_found", "s4": "invalid"}
    assert by(change.cart, "id", "quantity") == {"cart-1": 3, "cart-2": 1}
    removals = commands(
        spark,
        command("r1", "remove", cart_item_id="cart-1"),
        command("r2", "remove", cart_item_id="cart-1", minute=101),
        command("r3", "remove", cart_item_id="cart-2"),
    )
    change = C.remove_from_cart(df, removals)
    assert by(change.results, "cmd_id", "status", "affected_rows") == {"r1": ("ok", 1), "r2": ("not_found", 0), "r3": ("not_found", 0)}
    assert {r["id"] for r in change.cart.collect()} == {"cart-2"}


def test_items_by_ids_and_totals(spark):
    df = cart(spark, cart_row("c1", quantity=2), cart_row("c2", book_id="B", price="10.05"), cart_row("c3", user="u2"))
    asked = spark.createDataFrame([("u1", [" c1 ", "c3", "c1"]), ("u2", None)], "user_id string, cart_item_ids array<string>")
    assert [r["id"] for r in C.items_by_ids(df, asked).collect()] == ["c1"]
    got = by(C.selection_totals(df, spark.createDataFrame([("c2",), ("c3",)], "id string")), "user_id")
    assert tuple(got["u1"])[1:] == (1, Decimal("10.05"), False, Decimal("1.01"), Decimal("11.06"))
    assert got["u2"]["all_selected"] is True
    none = by(C.selection_totals(df, spark.createDataFrame([], "id string")), "user_id")
    assert none["u1"]["total"] == Decimal("0.00")
    assert by(C.line_subtotals(df), "id", "subtotal")["c1"] == Decimal("60.00")


def replay(stored, steps, new_id):
    """One command after another on {(user, book): [id, qty, updated]}."""
    state = {k: list(v) for k, v in stored.items()}
    said = {}
    for ts, cmd, user, book_id, op, qty in sorted(steps):
        key = (user, book_id)
        said[cmd] = C.OK if op == "add" or key in state else C.NOT_FOUND
        if op == "add":
            if key in state and (state[key][1] < 0 or state[key][1] + qty > 2147483647):
                said[cmd] = C.INVALID
            elif key in state:
                state[key][1] += qty
                state[key][2] = ts
            else:
                state[key] = [new_id(cmd), qty, ts]
        elif key in state:
            if op == "set":
                state[key][1:] = [qty, ts]
            else:
                del state[key]
    return {k: tuple(v) for k, v in state.items()}, said


@pytest.mark.parametrize("sizes", [(1, 2, 3, 4, 5), (1, 900_000_000, 2147483640, 2147483647)])
def test_fold_equals_serial_replay(spark, sizes):
    rng = random.Random(7)
    shelf_rows = [book(f"B{i}", f"T{i}", f"Vol {i}") for i in range(4)]
    stored = {("u1", "B0"): ("s0", 2, at(0)), ("u1", "B1"): ("s1", 1, at(0)), ("u9", "B0"): ("s9", 4, at(0)),
              ("u2", "B2"): ("s2", -5, at(0)), ("u3", "B3"): ("s3", 2147483646, at(0))}
    rows, steps = [], []
    for n in range(400):
        user, b, op, qty, cmd = f"u{rng.randrange(12)}", rng.randrange(4), rng.choice(["add", "add", "set", "remove"]), rng.choice(sizes), f"m{n:04d}"
        minute = rng.randrange(1, 60)
        steps.append((at(minute), cmd, user, f"B{b}", op, qty))
        if op == "add":
            rows.append(add(cmd, f"T{b}", str(b), str(qty), user=user, minute=minute))
        else:
            rows.append(command(cmd, op, user, minute, book_id=f"B{b}", quantity=str(qty)))
    ids = {r["c"]: r["i"] for r in spark.createDataFrame([(s[1],) for s in steps], "c string").select("c", X.derived_id("c").alias("i")).collect()}
    start = cart(spark, *[cart_row(v[0], k[0], k[1], v[1]) for k, v in stored.items()])
    done = C.fold(start, books(spark, *shelf_rows), commands(spark, *rows))
    got = done.cart.collect()
    state = {(r["user_id"], r["book_id"]): (r["id"], r["quantity"], r["updated_at"]) for r in got}
    assert len(state) == len(got)
    assert (state, by(done.results, "cmd_id", "status")) == replay(stored, steps, ids.get)


def test_a_good_set_outlives_a_bad_add(spark):
    shelf = books(spark, book("SH001", "Salt Harbor"))
    stored = cart(spark, cart_row("c1", quantity=2147483647), cart_row("c2", user="u2", quantity=-1))
    asked = commands(
        spark,
        add("a1", minute=1, quantity="5"),
        command("s1", "set", minute=2, book_id="SH001", quantity="3"),
        add("a2", minute=3, quantity="2147483647"),
        add("a3", minute=4, quantity="4"),
        add("b1", user="u2", minute=1),
        command("s2", "set", user="u2", minute=2, book_id="SH001", quantity="1"),
        add("b2", user="u2", minute=3),
    )
    done = C.fold(stored, shelf, asked)
    assert by(done.cart, "id", "quantity") == {"c1": 7, "c2": 2}
    assert by(done.results, "cmd_id", "status") == {
        "a1": C.INVALID, "s1": C.OK, "a2": C.INVALID, "a3": C.OK, "b1": C.INVALID, "s2": C.OK, "b2": C.OK,
    }


def test_one_bad_key_stops_nobody_else(spark):
    shelf = books(spark, book("SH001", "Salt Harbor"), book("TO001", "Tin Orchard"))
    stored = cart(spark, cart_row("c1", quantity=2147483647), cart_row("c9", user="u9", quantity=-1), cart_row("c3", user="u3", quantity=2))
    asked = commands(spark, add("a1", quantity="5"), add("a2", user="u9"), add("a3", user="u3"), add("a4", user="u4", quantity="0x2"))
    done = C.add_to_cart(stored, shelf, asked)
    assert by(done.results, "cmd_id", "status") == {"a1": C.INVALID, "a2": C.INVALID, "a3": C.OK, "a4": C.OK}
    left = {r["user_id"]: r["quantity"] for r in done.cart.collect()}
    assert left == {"u1": 2147483647, "u9": -1, "u3": 3, "u4": 2}
    assert {r["user_id"]: r["quantity"] for r in C.fold_commands(stored, shelf, asked).collect()} == left
    twice = cart(spark, cart_row("c1", quantity=2147483647), cart_row("c2", quantity=1, minute=1), cart_row("c3", user="u3", quantity=2))
    assert {r["user_id"]: r["quantity"] for r in C.cart_view(twice).collect()} == {"u1": None, "u3": 2}


def test_results_of_a_mixed_batch(spark):
    shelf = books(spark, book("SH001", "Salt Harbor"))
    asked = commands(
        spark,
        command("s1", "set", minute=1, book_id="SH001", quantity="3"),
        add("a1", minute=2),
        command("s2", "set", minute=3, book_id="SH001", quantity="x"),
        command("r1", "remove", minute=4, book_id="SH001"),
        command("r2", "remove", minute=5, book_id="SH001"),
        command("s3", "set", user="u2", minute=1, book_id="SH001", quantity="2"),
    )
    got = by(C.fold_results(cart(spark, cart_row("c1", user="u2")), shelf, asked), "cmd_id", "status")
    assert got == {"s1": C.NOT_FOUND, "a1": C.OK, "s2": C.INVALID, "r1": C.OK, "r2": C.NOT_FOUND, "s3": C.OK}
