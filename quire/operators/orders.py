"""Orders: history documents, charges, totals, line changes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import exprs as X
from quire.operators.cart import INVALID, NOT_FOUND, OK
from quire.operators.skew import SECTION, crowded, nest, written

RECENT_ORDERS = 3  # fixed value
ITEM_FIELDS = (
    "id", "order_id", "book_id", "title", "unit_price", "quantity", "line_total", "cover",
    "book_title", "volume", "price",
)


class LineChange(NamedTuple):
    """Orders and lines after the commands, and one result row per command."""

    orders: DataFrame
    items: DataFrame
    results: DataFrame


def items_with_cover(items: DataFrame, books: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Order lines with the book's cover where their own is empty, and the fields a
    reader of the history sees; ``more`` names further columns to keep."""
    covers = books.select("book_id", F.col("cover").alias("_cover"))
    joined = items.join(covers, "book_id", "left")
    return joined.withColumns(
        {
            "cover": X.cover_or_fallback("cover", "_cover"),
            "book_title": F.col("title"),
            "volume": X.book_volume("book_id"),
            "price": F.col("unit_price"),
        }
    ).select(*ITEM_FIELDS, *more)


def _of_users(orders: DataFrame, users: DataFrame | None) -> DataFrame:
    if users is None:
        return orders
    return orders.join(users.select("user_id"), "user_id", "left_semi")


def _newest_first() -> list[Column]:
    return [F.col("created_at").desc_nulls_first(), F.col("id").desc()]


def history_lines(
    orders: DataFrame, items: DataFrame, books: DataFrame, users: DataFrame | None = None
) -> DataFrame:
    """Flat history: one row per order line, one row with NULL line fields for an
    order without lines."""
    heads = _of_users(orders, users).select(
        F.col("id").alias("order_id"), "user_id", "total_amount", "status", F.col("created_at").alias("purchase_date")
    )
    owned = items.join(heads, "order_id")
    lines = items_with_cover(owned, books, heads.columns[1:]).withColumnRenamed("id", "item_id")
    bare = heads.join(items.select("order_id").distinct(), "order_id", "left_anti")
    return lines.unionByName(bare, allowMissingColumns=True)


def order_history(
    orders: DataFrame,
    items: DataFrame,
    books: DataFrame,
    users: DataFrame | None = None,
    section_length: int = SECTION,
) -> DataFrame:
    """Order documents with nested lines, newest first per user: rows of one user stand together in a
    part, in this order.  An order has a row for each ``section_length`` lines."""
    chosen = _of_users(orders, users)
    shown = items
    if users is not None:
        ids = chosen.select(F.col("id").alias("order_id"))
        shown = items.join(ids, "order_id", "left_semi")
    shown = shown.filter(F.col("order_id").isNotNull())
    fields = ("book_id", "title", "unit_price", "quantity", "line_total", "cover")

    def item(x: Column) -> Column:
        return F.struct(
            x["o0"].alias("id"),
            F.col("order_id"),
            *[x[c].alias(c) for c in fields],
            x["title"].alias("book_title"),
            X.book_volume(x["book_id"]).alias("volume"),
            x["unit_price"].alias("price"),
        )

    def nested(lines: DataFrame, small: bool) -> DataFrame:
        covered = items_with_cover(lines, books)
        docs = nest(covered, ["order_id"], [F.col("id")], fields, item, "items", section_length, small)
        return docs.withColumnRenamed("order_id", "id")

    # Orders with very many lines are told apart, so that the lines of all others are shuffled by order only once.
    large = crowded(shown, ["order_id"])
    few = nested(shown.join(large, "order_id", "left_anti"), True)
    many = nested(shown.join(large, "order_id", "left_semi"), False)
    others = chosen.join(large.withColumnRenamed("order_id", "id"), "id", "left_anti")
    item_type = few.schema["items"].dataType
    return (
        others.join(few, "id", "left")
        .unionByName(chosen.join(many, "id"))
        .withColumns(
            {
                "purchase_date": F.col("created_at"),
                "items": F.coalesce("items", F.array().cast(item_type)),
                "section": F.coalesce("section", F.lit(0)),
            }
        )
        .repartition("user_id")
        .sortWithinPartitions("user_id", *_newest_first(), "section")
    )


def order_lines_total(items: DataFrame) -> DataFrame:
    return items.groupBy("order_id").agg(F.sum("line_total").cast(X.WIDE_MONEY).alias("lines_total"))


def recalculated_totals(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders with their total set to the sum of their lines, 0 without any."""
    sums = order_lines_total(items).withColumnRenamed("order_id", "id")
    return (
        orders.join(sums, "id", "left")
        .withColumn("total_amount", F.coalesce("lines_total", F.lit(0)).cast(X.WIDE_MONEY))
        .select(*orders.columns)
    )


def total_drift(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders whose stored total differs from their lines."""
    sums = order_lines_total(items).withColumnRenamed("order_id", "id")
    return (
        orders.join(sums, "id", "left")
        .withColumn("lines_total", F.coalesce("lines_total", F.lit(0)).cast(X.WIDE_MONEY))
        .filter(F.col("total_amount") != F.col("lines_total"))
        .select("id", F.col("total_amount").cast(X.WIDE_MONEY).alias("total_amount"), "lines_total")
    )


def without_items(orders: DataFrame, items: DataFrame) -> DataFrame:
    keys = items.select(F.col("order_id").alias("id")).distinct()
    return orders.join(keys, "id", "left_anti")


def charges(orders: DataFrame, items: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Per order: subtotal of its lines, delivery fee, total and number of lines;
    ``more`` names further order columns to keep."""
    amount = (F.col("unit_price") * F.col("quantity")).cast(X.WIDE_MONEY)
    sums = items.groupBy(F.col("order_id").alias("id")).agg(
        F.sum(amount).alias("_sum"), F.count(F.lit(1)).alias("_n")
    )
    return (
        orders.join(sums, "id", "left")
        .withColumns(
            {
                "subtotal": F.coalesce("_sum", F.lit(0)).cast(X.WIDE_MONEY),
                "item_count": F.coalesce("_n", F.lit(0)),
            }
        )
        .withColumn("delivery_fee", X.delivery_fee("subtotal"))
        .withColumn("total", (F.col("subtotal") + F.col("delivery_fee")).cast(X.WIDE_MONEY))
        .select("id", "user_id", "created_at", "item_count", "subtotal", "delivery_fee", "total", *more)
    )


def recent_purchases(orders: DataFrame, items: DataFrame, count: int = RECENT_ORDERS) -> DataFrame:
    """The latest orders of each user with their amount.

    The rank filter keeps ``count`` rows per user in every task before the shuffle, and
    lines are summed per order before they meet the orders.
    """
    by_user = Window.partitionBy("user_id").orderBy(*_newest_first())
    latest = orders.withColumn("rank", F.row_number().over(by_user)).filter(F.col("rank") <= count)
    return charges(latest, items, ["rank"]).select(
        "user_id", "rank", "id", "created_at", F.col("total").alias("amount"), "item_count"
    )


def purchase_counts(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Per user: number of orders and of order lines."""
    sizes = items.groupBy(F.col("order_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    return (
        orders.join(sizes, "id", "left")
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("orders"), F.coalesce(F.sum("_n"), F.lit(0)).alias("items"))
    )


def _own_lines(commands: DataFrame, items: DataFrame, orders: DataFrame, keys: list[str]) -> DataFrame:
    """Commands joined to the lines they name in orders of their user."""
    lines = items.select(F.col("id").alias("order_item_id"), "order_id")
    owners = orders.select(F.col("id").alias("order_id"), "user_id")
    return commands.join(lines, keys).join(owners, ["order_id", "user_id"])


def _retotal(orders: DataFrame, items: DataFrame, touched: DataFrame) -> DataFrame:
    """Recalculate the totals of the touched orders (order_id) only."""
    lines = items.join(touched, "order_id", "left_semi")
    sums = touched.join(order_lines_total(lines), "order_id", "left").select(
        F.col("order_id").alias("id"),
        F.coalesce("lines_total", F.lit(0)).cast(X.WIDE_MONEY).alias("_total"),
    )
    return (
        orders.join(sums, "id", "left")
        .withColumn("total_amount", F.coalesce("_total", "total_amount"))
        .select(*orders.columns)
    )


class QuantityChange:
    """Like ``LineChange``, but each part is planned when it is asked for: the lines alone need no table of hits."""

    def __init__(self, orders: DataFrame, items: DataFrame, commands: DataFrame) -> None:
        item_id, qty = X.text_or_null("order_item_id"), X.quantity_or_null("quantity")
        self._orders, self._items = orders, items
        self._parsed = commands.select("cmd_id", "user_id", item_id.alias("order_item_id"), qty.alias("qty"), "ts")
        self._bad = F.col("order_item_id").isNull() | F.col("qty").isNull()
        self._valid = self._parsed.filter(~self._bad)

    @cached_property
    def items(self) -> DataFrame:
        return _with_quantities(self._items, _last_sets(self._valid, self._items, self._orders))

    @cached_property
    def orders(self) -> DataFrame:
        own = _own_lines(self._valid, self._items, self._orders, ["order_item_id"])
        hits = written(own.select("order_id", "order_item_id", "cmd_id", "ts", "qty"))
        last = hits.groupBy(F.col("order_item_id").alias("id")).agg(_last_quantity())
        return _retotal(self._orders, _with_quantities(self._items, last), hits.select("order_id").distinct())

    @cached_property
    def results(self) -> DataFrame:
        hits = _own_lines(self._valid, self._items, self._orders, ["order_item_id"])
        hit = hits.select("cmd_id", F.lit(True).alias("_hit"))
        status = F.when(self._bad, INVALID).when(F.col("_hit"), OK).otherwise(NOT_FOUND)
        return (
            self._parsed.join(hit, "cmd_id", "left")
            .withColumn("status", status)
            .select("cmd_id", "user_id", "status", F.when(F.col("status") == OK, 1).otherwise(0).alias("affected_rows"))
        )


def _last_quantity() -> Column:
    return F.max_by("qty", F.struct("ts", "cmd_id")).alias("_qty")


def _last_sets(commands: DataFrame, items: DataFrame, orders: DataFrame) -> DataFrame:
    """Per line (id) that its order's user sets: the quantity of the last command.

    Lines get their owner first, by order; then lines and commands are shuffled by the line's id, and stay there for the
    last command and for a join with the lines.  The owner is compared as a list of one: as a second join key it would
    cost another shuffle.  The commands of one line pass through one task, one at a time.
    """
    owners = orders.select(F.col("id").alias("order_id"), F.col("user_id").alias("_owner"))
    lines = items.select(F.col("id").alias("order_item_id"), "order_id").join(owners, "order_id")
    own = F.array_contains(F.array("_owner"), F.col("user_id"))
    hits = commands.join(lines.select("order_item_id", "_owner"), "order_item_id").filter(own)
    return hits.groupBy(F.col("order_item_id").alias("id")).agg(_last_quantity())


def _with_quantities(items: DataFrame, last: DataFrame) -> DataFrame:
    total = (F.col("unit_price") * F.col("_qty")).cast(X.WIDE_MONEY)
    return (
        items.join(last, "id", "left")
        .withColumns(
            {
                "quantity": F.coalesce("_qty", "quantity"),
                "line_total": F.when(F.col("_qty").isNotNull(), total).otherwise(F.col("line_total")),
            }
        )
        .select(*items.columns)
    )


def update_quantities(orders: DataFrame, items: DataFrame, commands: DataFrame) -> QuantityChange:
    """Set line quantities (last valid command of a line counts) and the totals of
    the orders concerned."""
    return QuantityChange(orders, items, commands)


def delete_items(orders: DataFrame, items: DataFrame, commands: DataFrame) -> LineChange:
    """Remove lines; an order left without lines goes too (``order_deleted`` on the
    command that took its last line), otherwise its total is recalculated."""
    parsed = commands.select(
        "cmd_id",
        "user_id",
        X.text_or_null("order_item_id").alias("order_item_id"),
        X.text_or_null("order_id").alias("order_id"),
        "ts",
    )
    bad = F.col("order_item_id").isNull() | F.col("order_id").isNull()
    named = _own_lines(parsed.filter(~bad), items, orders, ["order_item_id", "order_id"])
    first = written(named.groupBy("order_item_id", "order_id").agg(F.min(F.struct("ts", "cmd_id")).alias("_at")))
    kept = items.join(first.select(F.col("order_item_id").alias("id")), "id", "left_anti").select(*items.columns)
    touched = first.groupBy("order_id").agg(F.max("_at").alias("_last"))
    left = kept.join(touched.select("order_id"), "order_id", "left_semi")
    remaining = written(left.select("order_id").distinct())
    emptied = touched.join(remaining, "order_id", "left_anti")
    kept_orders = orders.join(emptied.select(F.col("order_id").alias("id")), "id", "left_anti")
    new_orders = _retotal(kept_orders.select(*orders.columns), kept, remaining)
    hit = first.select(F.col("_at.cmd_id").alias("cmd_id"), F.lit(True).alias("_hit"))
    ended = emptied.select(F.col("_last.cmd_id").alias("cmd_id"), F.lit(True).alias("_ended"))
    results = (
        parsed.join(hit, "cmd_id", "left")
        .join(ended, "cmd_id", "left")
        .select(
            "cmd_id",
            "user_id",
            F.when(bad, INVALID).when(F.col("_hit"), OK).otherwise(NOT_FOUND).alias("status"),
            F.coalesce(F.col("_hit").cast("int"), F.lit(0)).alias("affected_rows"),
            F.coalesce("_ended", F.lit(False)).alias("order_deleted"),
        )
    )
    return LineChange(new_orders, kept, results)
