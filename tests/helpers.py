"""Small tables in the declared schemas."""

from datetime import datetime, timedelta
from decimal import Decimal

from quire import schemas

T0 = datetime(2026, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def table(spark, schema, rows):
    """Rows given as dicts; what is left out is NULL."""
    names = [f.name for f in schema.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def book(book_id, title, volume="Vol 1", price="30.00", **more):
    return {
        "book_id": book_id, "title": title, "volume": volume, "price": Decimal(price), "author": "A", "genre": "Action, Fantasy",
        "type": "manga", "publisher": "P", "keywords": "k", "description": "d", "cover": f"images/{book_id}.jpg",
        "page_count": 192, "release_date": "2020-01-01", "stock": 10, **more,
    }


def books(spark, *rows):
    return table(spark, schemas.BOOKS, rows)


def cart_row(id, user="u1", book_id="SH001", quantity=1, minute=0, price="30.00", **more):
    return {
        "id": id, "user_id": user, "book_id": book_id, "title": "Salt Harbor", "volume": "1", "cover": "c.jpg",
        "unit_price": Decimal(price), "quantity": quantity, "created_at": at(minute), "updated_at": at(minute), **more,
    }


def cart(spark, *rows):
    return table(spark, schemas.CART_ITEMS, rows)


def command(cmd_id, op="add", user="u1", minute=100, **more):
    return {"cmd_id": cmd_id, "user_id": user, "op": op, "ts": at(minute), **more}


def add(cmd_id, title="Salt Harbor", volume="1", quantity="1", **more):
    return command(cmd_id, book_title=title, volume=volume, quantity=quantity, **more)


def commands(spark, *rows):
    return table(spark, schemas.CART_COMMANDS, rows)


def by(df, key, *columns):
    """{key value: row or single column}."""
    rows = df.collect()
    pick = (lambda r: r[columns[0]]) if len(columns) == 1 else (lambda r: tuple(r[c] for c in columns) if columns else r)
    out = {r[key]: pick(r) for r in rows}
    assert len(out) == len(rows)
    return out
