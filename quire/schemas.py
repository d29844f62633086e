"""Declared tables: column types, defaults and rules."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "strings": T.ArrayType(T.StringType()),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "money": T.DecimalType(10, 2),
}


def _schema(text: str) -> T.StructType:
    pairs = [column.split() for column in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Columns and types of the tables.
BOOKS = _schema(
    "book_id string, title string, author string, genre string, description string, "
    "price money, volume string, cover string, type string, publisher string, "
    "keywords string, stock int, page_count int, release_date string, created_at timestamp"
)
BOOKS_FIX = _schema("title string, volume string, cover string, page_count int, release_date string")
USERS = _schema("id string, name string, email string, created_at timestamp, updated_at timestamp")
CART_ITEMS = _schema(
    "id string, user_id string, book_id string, title string, volume string, cover string, "
    "unit_price money, quantity int, created_at timestamp, updated_at timestamp"
)
ORDERS = _schema("id string, user_id string, total_amount money, status string, created_at timestamp")
ORDER_ITEMS = _schema(
    "id string, order_id string, book_id string, title string, cover string, "
    "unit_price money, quantity int, line_total money"
)
CART_COMMANDS = _schema(
    "cmd_id string, user_id string, op string, cart_item_id string, book_id string, "
    "book_title string, volume string, quantity string, ts timestamp"
)
CHECKOUT_REQUESTS = _schema("request_id string, user_id string, cart_item_ids strings, ts timestamp")
ORDER_ITEM_COMMANDS = _schema(
    "cmd_id string, user_id string, op string, order_item_id string, order_id string, "
    "quantity string, ts timestamp"
)
USER_COMMANDS = _schema("cmd_id string, op string, user_id string, name string, email string, ts timestamp")
REQUESTS = _schema(
    "ts timestamp, client_key string, endpoint string, duration_ms double, status int, failed boolean, "
    "check_group string, check_name string, check_ok boolean"
)

TABLES = {
    "books": BOOKS,
    "users": USERS,
    "cart_items": CART_ITEMS,
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
}

# Columns never carried into a DataFrame.
DROPPED_ON_LOAD = ("password_hash",)

# Defaults, lengths, required columns, statuses and foreign keys
# declared by the store's tables.
DEFAULTS = {
    "books": {"stock": 0, "page_count": 0},
    "cart_items": {"volume": "", "cover": ""},
    "orders": {"status": "completed"},
    "order_items": {"cover": ""},
    "users": {},
}
MAX_LENGTHS = {
    "books": {"book_id": 120, "title": 255, "author": 255, "genre": 200, "volume": 50, "type": 50,
              "publisher": 255, "release_date": 20},
    "cart_items": {"book_id": 120, "title": 255, "volume": 50},
    "orders": {"status": 40},
    "order_items": {"book_id": 120, "title": 255},
    "users": {"name": 120, "email": 255},
}
REQUIRED = {
    "books": ("book_id", "title", "price"),
    "cart_items": ("user_id", "book_id", "title", "unit_price", "quantity", "created_at", "updated_at",
                   "volume", "cover"),
    "orders": ("user_id", "total_amount", "status", "created_at"),
    "order_items": ("order_id", "book_id", "title", "cover", "unit_price", "quantity", "line_total"),
    "users": ("name", "email", "created_at", "updated_at"),
}
ORDER_STATUSES = ("pending", "completed", "cancelled")
UNIQUE_KEYS = {
    "books": (("book_id",),),
    "users": (("email",),),
    "cart_items": (("user_id", "book_id"),),
}
FOREIGN_KEYS = (
    ("cart_items", "user_id", "users"),
    ("orders", "user_id", "users"),
    ("order_items", "order_id", "orders"),
)
PRIMARY_KEYS = {"books": "book_id", "users": "id", "cart_items": "id", "orders": "id", "order_items": "id"}
