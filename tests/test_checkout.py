import random
from decimal import Decimal

import pytest
from helpers import at, by, cart, cart_row, table

from quire import schemas
from quire.operators import checkout as K


def request(request_id, *ids, user="u1", minute=0):
    return {"request_id": request_id, "user_id": user, "cart_item_ids": list(ids), "ts": at(minute)}


def requests(spark, *rows):
    return table(spark, schemas.CHECKOUT_REQUESTS, rows)


def test_one_checkout(spark):
    df = cart(spark, cart_row("c1", quantity=2, cover="own.jpg"), cart_row("c2", book_id="B"))
    done = K.checkout(df, requests(spark, request("r1", " c1 ", "c1", "")))
    order = done.orders.collect()[0]
    assert (order["total_amount"], order["status"], order["user_id"]) == (Decimal("60.00"), "completed", "u1")
    line = done.lines.collect()
    assert len(line) == 1 and (line[0]["cover"], line[0]["line_total"], line[0]["order_id"]) == ("own.jpg", Decimal("60.00"), order["id"])
    assert [r["id"] for r in done.cart.collect()] == ["c2"]
    assert by(done.results, "request_id", "status", "order_id") == {"r1": ("ok", order["id"])}


def test_all_or_nothing(spark):
    df = cart(spark, cart_row("c1"), cart_row("c2", user="u2"))
    done = K.checkout(df, requests(spark, request("r1", "c1", "c2"), request("r2", "c1", "zz"), request("r3", " "), request("r4")))
    assert by(done.results, "request_id", "status") == {"r1": "not_found", "r2": "not_found", "r3": "invalid", "r4": "invalid"}
    assert done.orders.count() == done.lines.count() == 0 and done.cart.count() == 2


def test_rejected_request_takes_nothing(spark):
    df = cart(spark, cart_row("c1"), cart_row("c2", book_id="B"), cart_row("c3", book_id="C"))
    done = K.checkout(
        df, requests(spark, request("r1", "c1", "c2"), request("r2", "c2", "c3", minute=1), request("r3", "c3", minute=2), request("r4", "c3", "c1", minute=3))
    )
    assert by(done.results, "request_id", "status") == {"r1": "ok", "r2": "not_found", "r3": "ok", "r4": "not_found"}


def serial(owned, asked):
    taken, won = set(), set()
    for ts, rid, user, ids in sorted(asked):
        if ids and all(owned.get(i) == user and i not in taken for i in ids):
            taken |= set(ids)
            won.add(rid)
    return won, taken


def test_equals_serial_service(spark):
    rng = random.Random(3)
    owned = {f"c{n:03d}": f"u{rng.randrange(4)}" for n in range(120)}
    rows = [cart_row(i, u, f"B{i}", minute=n) for n, (i, u) in enumerate(owned.items())]
    asked = []
    for n in range(150):
        user = "u0" if rng.random() < 0.5 else f"u{rng.randrange(4)}"  # one busy user
        own = [i for i, u in owned.items() if u == user] or ["none"]
        ids = {rng.choice(own) for _ in range(rng.randrange(1, 4))} | ({"zz"} if rng.random() < 0.1 else set())
        asked.append((at(rng.randrange(30)), f"r{n:03d}", user, sorted(ids)))
    frame = requests(spark, *[{"request_id": r, "user_id": u, "cart_item_ids": i, "ts": t} for t, r, u, i in asked])
    done = K.checkout(cart(spark, *rows), frame)
    won, taken = serial(owned, asked)
    assert {r["request_id"] for r in done.results.filter("status = 'ok'").collect()} == won
    sold = [r["cart_item_id"] for r in done.lines.collect()]
    left = [r["id"] for r in done.cart.collect()]
    assert sorted(sold) == sorted(taken) and sorted(sold + left) == sorted(owned)  # each row moves once


def test_lines_oldest_first(spark):
    df = cart(spark, cart_row("c1", minute=9), cart_row("c2", book_id="B", minute=1))
    done = K.checkout(df, requests(spark, request("r1", "c1", "c2")))
    assert [(r["line_no"], r["cart_item_id"]) for r in K.numbered_lines(done.lines).orderBy("line_no").collect()] == [(1, "c2"), (2, "c1")]
