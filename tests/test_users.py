from decimal import Decimal

from helpers import at, book, books, by, cart, cart_row, table

from quire import schemas
from quire.operators import quality as Q
from quire.operators import users as U


def user(id, name="Name", email=None):
    return {"id": id, "name": name, "email": email or f"{id}@x.org", "created_at": at(0), "updated_at": at(0)}


def users(spark, *rows):
    return table(spark, schemas.USERS, rows)


def command(cmd_id, user_id=None, name=None, email=None, minute=1, op="update"):
    return {"cmd_id": cmd_id, "op": op, "user_id": user_id, "name": name, "email": email, "ts": at(minute)}


def commands(spark, *rows):
    return table(spark, schemas.USER_COMMANDS, rows)


def test_register(spark):
    change = U.register(
        users(spark, user("u1")),
        commands(
            spark,
            command("r1", None, " Ann ", "ann@x.org"),
            command("r2", None, "Bob", "u1@x.org"),
            command("r3", None, " ", "c@x.org"),
            command("r4", None, "Dan", ""),
            command("r5", None, "Eve", "ann@x.org", minute=0),
            command("r6", None, "Fay", "ANN@x.org"),
            command("r7", None, "Gus", " ann@x.org"),
        ),
    )
    assert by(change.results, "cmd_id", "status") == {
        "r1": "conflict", "r2": "conflict", "r3": "invalid", "r4": "invalid", "r5": "ok", "r6": "ok", "r7": "ok",
    }
    assert by(change.users, "email", "name") == {"u1@x.org": "Name", "ann@x.org": "Eve", "ANN@x.org": "Fay", " ann@x.org": "Gus"}


def test_update_profiles(spark):
    change = U.update_profiles(
        users(spark, user("u1"), user("u2"), user("u3")),
        commands(
            spark,
            command("p1", "u1", name=" New "),
            command("p2", "u1", name=" "),
            command("p3", "u1"),
            command("p4", "zz", name="X"),
            command("p5", "u1", email="u2@x.org"),
            command("p6", "u1", email="u1@x.org", minute=2),
            command("p7", "u2", email=" fresh@x.org ", minute=3),
            command("p8", "u3", email="fresh@x.org", minute=4),
            command("p9", "u3", name="Last", minute=5),
            command("p10", "u3", name="Earlier", minute=4),
        ),
    )
    assert by(change.results, "cmd_id", "status") == {
        "p1": "ok", "p2": "invalid", "p3": "invalid", "p4": "not_found", "p5": "conflict", "p6": "ok", "p7": "ok", "p8": "conflict",
        "p9": "ok", "p10": "ok",
    }
    assert by(change.users, "id", "name", "email", "updated_at") == {
        "u1": ("New", "u1@x.org", at(2)), "u2": ("Name", "fresh@x.org", at(3)), "u3": ("Last", "u3@x.org", at(5)),
    }
    conflicts = U.email_conflicts(users(spark, user("u1"), user("u2")), commands(spark, command("a", "u1", email=" u2@x.org "), command("b", "u2", email="u2@x.org")))
    assert by(conflicts, "cmd_id", "held_by") == {"a": "u2"}


def test_profiles(spark):
    asked = spark.createDataFrame([("u2",), ("u2",)], "user_id string")
    got = U.profiles(users(spark, user("u1"), user("u2")), asked)
    assert got.columns == ["id", "name", "email", "created_at"] and [r["id"] for r in got.collect()] == ["u2"]


def test_command_rules(spark):
    rows = commands(
        spark, command("1", name="ab", email="a@b.org"), command("2", name="abc", email="a@b.museum"), command("3"),
        command("4", name=" ", email="a.b+c@d-e.io"), command("5", name="abc", email="a@b.org"),
    )
    faults = by(Q.validate_registrations(rows), "cmd_id", "faults")
    assert faults == {
        "1": ["name_too_short"], "2": ["email_format"], "3": ["email_required", "name_required", "name_too_short"],
        "4": ["name_required", "name_too_short"], "5": [],
    }
    assert by(Q.validate_profile_updates(rows), "cmd_id", "status")["3"] == "invalid"
    lines = table(
        spark,
        schemas.ORDER_ITEM_COMMANDS,
        [
            {"cmd_id": "a", "op": "set", "order_item_id": "i", "quantity": "0"}, {"cmd_id": "b", "op": "remove", "order_item_id": " ", "order_id": "o"},
            {"cmd_id": "c", "op": "remove", "order_item_id": "i", "order_id": "o"},
        ],
    )
    assert by(Q.validate_order_commands(lines), "cmd_id", "faults") == {"a": ["quantity"], "b": ["id"], "c": []}
    asked = table(spark, schemas.CHECKOUT_REQUESTS, [{"request_id": "r", "cart_item_ids": [" "]}, {"request_id": "s", "cart_item_ids": ["x"]}])
    assert by(Q.validate_checkouts(asked), "request_id", "status") == {"r": "invalid", "s": "ok"}


def order(id, user="u1", total="1.00", status="completed"):
    return {"id": id, "user_id": user, "total_amount": Decimal(total), "status": status, "created_at": at(0)}


def line(id, order_id, quantity=1, price="1.00", total=None):
    return {"id": id, "order_id": order_id, "book_id": "B", "title": "T", "cover": "", "unit_price": Decimal(price), "quantity": quantity,
            "line_total": Decimal(total or price)}


def broken(df):
    return sorted((r["row_key"], r["rule"]) for r in df.collect())


def test_table_rules(spark):
    orders = table(spark, schemas.ORDERS, [order("o1"), order("o2", status="paid"), order("o3", total="-1.00"), order("o4", user=None, status=None)])
    lines = table(spark, schemas.ORDER_ITEMS, [line("i1", "o1"), line("i2", "o1", 0), line("i3", "zz", 2, "1.00", "2.01")])
    assert broken(Q.statuses(orders)) == [("o2", "status")]
    assert broken(Q.value_checks(orders, "orders")) == [("o3", "total_amount < 0")]
    assert broken(Q.value_checks(lines, "order_items")) == [("i2", "quantity <= 0")]
    assert broken(Q.line_totals(lines)) == [("i2", "line_total"), ("i3", "line_total")]
    assert broken(Q.not_null(orders, "orders")) == [("o4", "status is null"), ("o4", "user_id is null")]
    shelf = books(spark, book("B" * 121, "t"), book("B1", "t" * 255), book("B1", "t" * 256))
    assert [r for _, r in broken(Q.lengths(shelf, "books"))] == ["title > 255", "book_id > 120"]
    assert [tuple(r) for r in Q.not_unique(shelf, "books").collect()] == [("books", "book_id", "B1", 2)]
    rows = cart(spark, cart_row("c1"), cart_row("c2"), cart_row("c3", user="u2"))
    assert [r["key_value"] for r in Q.not_unique(rows, "cart_items").collect()] == ["u1|SH001"]


def test_references_and_cascade(spark):
    tables = {
        "users": users(spark, user("u1"), user("u2")),
        "cart_items": cart(spark, cart_row("c1"), cart_row("c2", user="gone")),
        "orders": table(spark, schemas.ORDERS, [order("o1"), order("o2", "u2"), order("o3", None)]),
        "order_items": table(spark, schemas.ORDER_ITEMS, [line("i1", "o1"), line("i2", "o2"), line("i3", "zz")]),
    }
    assert broken(Q.fk_orphans(tables)) == [("c2", "user_id -> users"), ("i3", "order_id -> orders")]
    left = Q.cascade_delete_users(tables, spark.createDataFrame([("u1",)], "id string"))
    ids = {name: sorted(r["id"] for r in df.select("id").collect()) for name, df in left.items()}
    assert ids == {"users": ["u2"], "cart_items": ["c2"], "orders": ["o2", "o3"], "order_items": ["i2", "i3"]}
