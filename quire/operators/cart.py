"""Cart: consolidation, changes from command tables, selections."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import exprs as X
from quire.operators.catalog import resolve
from quire.operators.skew import running, written

KEY = ["user_id", "book_id"]
COLUMNS = (
    "id", "user_id", "book_id", "title", "volume", "cover", "unit_price", "quantity", "created_at", "updated_at",
)
SNAPSHOT = ("title", "volume", "cover", "unit_price")
MOST = 2147483647  # of an integer column

# Result codes of commands.
OK, INVALID, NOT_FOUND, CONFLICT = "ok", "invalid", "not_found", "conflict"


class CartChange(NamedTuple):
    """The cart after the commands, and one result row per command."""

    cart: DataFrame
    results: DataFrame


def _newest() -> Column:
    return F.struct("created_at", "id")


def consolidate(cart: DataFrame) -> DataFrame:
    """One row per (user, book): newest row's data, summed quantity, latest times.

    A sum beyond the integer range comes as NULL.
    """
    latest = F.max_by(F.struct("id", *SNAPSHOT), _newest())
    return (
        cart.groupBy(*KEY)
        .agg(
            latest.alias("_l"),
            F.sum("quantity").try_cast("int").alias("quantity"),
            F.max("created_at").alias("created_at"),
            F.max("updated_at").alias("updated_at"),
        )
        .select("_l.*", *KEY, "quantity", "created_at", "updated_at")
        .select(*COLUMNS)
    )


def _owners(rows: DataFrame) -> DataFrame:
    """The users of ``rows`` once each, written: a table small enough to be sent to all tasks, so that the cart rows of all
    other users are told apart without a shuffle."""
    return written(rows.select("user_id").distinct())


def cart_view(cart: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """What each user sees, newest first; ``users`` (user_id) limits the owners."""
    if users is not None:
        cart = cart.join(_owners(users), "user_id", "left_semi")
    return (
        consolidate(cart)
        .withColumnsRenamed({"title": "book_title", "unit_price": "price"})
        .orderBy("user_id", F.col("created_at").desc_nulls_first(), F.col("id").desc())
    )


def duplicates(cart: DataFrame) -> DataFrame:
    """Rows that consolidation folds into a newer one."""
    kept = cart.groupBy(*KEY).agg(F.max_by("id", _newest()).alias("id")).select("id")
    return cart.join(kept, "id", "left_anti")


def items_by_ids(cart: DataFrame, requests: DataFrame) -> DataFrame:
    """Cart rows named by requests (user_id, cart_item_ids) of their owner."""
    wanted = requests.select("user_id", F.explode(X.distinct_ids("cart_item_ids")).alias("id"))
    return cart.join(wanted, ["id", "user_id"], "left_semi")


def command_faults(columns: dict[str, Column]) -> Column:
    """Names of the rules a command fails, in the given order."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in columns.items()]))


def add_faults() -> Column:
    return command_faults(
        {
            "book_title": X.text_or_null("book_title").isNull(),
            "volume": X.text_or_null("volume").isNull(),
            "quantity": X.quantity_or_null("quantity").isNull(),
        }
    )


def resolve_adds(commands: DataFrame, books: DataFrame) -> DataFrame:
    """Add commands with ``status``, the number ``qty`` and the resolved ``item``."""
    checked = commands.withColumns({"faults": add_faults(), "qty": X.quantity_or_null("quantity")})
    return resolve(checked, books).withColumn(
        "status",
        F.when(F.size("faults") > 0, INVALID).when(F.col("item").isNull(), NOT_FOUND).otherwise(OK),
    )


def _first_add(cond: Column | None = None) -> Column:
    """Data of the earliest add, which founds a new row."""
    when = F.struct("ts", "cmd_id")
    what = F.struct(
        F.col("cmd_id").alias("cmd_id"),
        F.col("ts").alias("ts"),
        F.col("item.title").alias("title"),
        F.col("item.volume").alias("volume"),
        F.col("item.cover").alias("cover"),
        F.col("item.price").alias("unit_price"),
    )
    return F.min_by(what, when) if cond is None else F.min_by(what, F.when(cond, when))


def _stored(cart: DataFrame, keys: DataFrame, owners: DataFrame) -> DataFrame:
    """Per key among ``keys``, whose users are ``owners``: the row that is kept and the total, which is NULL if a
    stored quantity is missing or negative."""
    sound = F.bool_and(F.coalesce(F.col("quantity") >= 0, F.lit(False)))
    rows = cart.join(owners, "user_id", "left_semi").join(keys.select(*KEY), KEY, "left_semi")
    return rows.groupBy(*KEY).agg(
        F.max_by("id", _newest()).alias("_keep"), F.when(sound, F.sum("quantity")).alias("_have")
    )


def _fits(total: Column) -> Column:
    return F.coalesce((total >= 0) & (total <= MOST), F.lit(False))


def _apply(cart: DataFrame, touched: DataFrame, owners: DataFrame) -> DataFrame:
    """Replace the rows of the touched keys; only rows of ``owners``, who own all touched keys, are shuffled for it.

    ``touched`` has one row per key: _keep (id or NULL), _exists, _qty, _updated and
    the struct _new used where no stored row is kept.
    """
    live = F.col("_exists")
    touched = written(touched)  # read twice below, and small beside the cart
    changes = touched.select(*KEY, F.lit(True).alias("_touched"), "_keep", "_exists", "_qty", "_updated")
    merged = (
        cart.join(owners, "user_id", "left_semi")
        .join(changes, KEY, "left")
        .filter(F.col("_touched").isNull() | (live & F.col("_keep").eqNullSafe(F.col("id"))))
        .withColumns(
            {
                "quantity": F.coalesce(F.col("_qty").cast("int"), F.col("quantity")),
                "updated_at": F.coalesce("_updated", "updated_at"),
            }
        )
        .select(*COLUMNS)
    )
    inserted = touched.filter(live & F.col("_keep").isNull()).select(
        X.derived_id("_new.cmd_id").alias("id"),
        *KEY,
        *[F.col(f"_new.{c}").alias(c) for c in SNAPSHOT],
        F.col("_qty").cast("int").alias("quantity"),
        F.col("_new.ts").alias("created_at"),
        F.col("_updated").alias("updated_at"),
    )
    return cart.join(owners, "user_id", "left_anti").select(*COLUMNS).unionByName(merged).unionByName(inserted)


def add_to_cart(cart: DataFrame, books: DataFrame, commands: DataFrame) -> CartChange:
    """Add commands: merge into the newest row of the key, whose other data stay, or
    insert a row with the catalog's data.  Keys without a command stay as they are.

    Where the sum would leave the integer range, or a stored quantity is not sound, the key stays as
    it is and its adds are invalid; other keys do not notice."""
    resolved = resolve_adds(commands, books)
    adds = written(
        resolved.filter(F.col("status") == OK)
        .groupBy("user_id", F.col("item.book_id").alias("book_id"))
        .agg(F.sum("qty").alias("_add"), _first_add().alias("_new"), F.max("ts").alias("_updated"))
    )
    owners = _owners(adds)
    total = F.col("_add") + F.when(F.col("_keep").isNull(), F.lit(0)).otherwise(F.col("_have"))
    merged = written(adds.join(_stored(cart, adds, owners), KEY, "left").withColumns({"_exists": F.lit(True), "_qty": total}))
    bad = merged.filter(~_fits(F.col("_qty"))).select(*KEY, F.lit(True).alias("_bad"))
    told = resolved.select("cmd_id", "user_id", "status", F.col("item.book_id").alias("book_id"))
    status = F.when((F.col("status") == OK) & F.col("_bad"), INVALID).otherwise(F.col("status"))
    results = told.join(bad, KEY, "left").select("cmd_id", "user_id", status.alias("status"), "book_id")
    return CartChange(_apply(cart, merged.filter(_fits(F.col("_qty"))), owners), results)


def _owned(commands: DataFrame, cart: DataFrame) -> DataFrame:
    """Commands whose cart row belongs to their user."""
    rows = cart.select(F.col("id").alias("cart_item_id"), "user_id")
    return commands.join(rows, ["cart_item_id", "user_id"], "left_semi")


def _results(commands: DataFrame, hits: DataFrame, bad: Column) -> DataFrame:
    hit = hits.select("cmd_id", F.lit(True).alias("_hit"))
    status = F.when(bad, INVALID).when(F.col("_hit"), OK).otherwise(NOT_FOUND)
    return (
        commands.join(hit, "cmd_id", "left")
        .withColumn("status", status)
        .withColumn("affected_rows", F.when(F.col("status") == OK, 1).otherwise(0))
        .select("cmd_id", "user_id", "status", "affected_rows")
    )


def set_quantity(cart: DataFrame, commands: DataFrame) -> CartChange:
    """Set commands on own rows; the last valid one of a row counts."""
    qty = X.quantity_or_null("quantity")
    valid = commands.filter(qty.isNotNull())
    last = valid.groupBy(F.col("cart_item_id").alias("id"), "user_id").agg(
        F.max_by(F.struct(qty.alias("qty"), F.col("ts").alias("ts")), F.struct("ts", "cmd_id")).alias("_s")
    )
    changed = (
        cart.join(last, ["id", "user_id"], "left")
        .withColumns(
            {
                "quantity": F.coalesce("_s.qty", "quantity"),
                "updated_at": F.coalesce("_s.ts", "updated_at"),
            }
        )
        .select(*COLUMNS)
    )
    return CartChange(changed, _results(commands, _owned(valid, cart), qty.isNull()))


def remove_from_cart(cart: DataFrame, commands: DataFrame) -> CartChange:
    """Remove commands on own rows; a second one for the same row finds nothing."""
    first = commands.groupBy("cart_item_id", "user_id").agg(
        F.min_by("cmd_id", F.struct("ts", "cmd_id")).alias("cmd_id")
    )
    named = first.select(F.col("cart_item_id").alias("id"), "user_id")
    left = cart.join(named, ["id", "user_id"], "left_anti").select(*COLUMNS)
    return CartChange(left, _results(commands, _owned(first, cart), F.lit(False)))


def _steps(books: DataFrame, commands: DataFrame) -> DataFrame:
    """Commands of a mixed batch with the book they name, their number and their status before the cart is looked at."""
    adds = resolve_adds(commands.filter(F.col("op") == "add"), books)
    names = ["cmd_id", "user_id", "book_id", "op", "ts", "qty", "item", "status"]
    others = commands.filter(F.col("op").isin("set", "remove")).withColumns(
        {
            "book_id": X.text_or_null("book_id"),
            "qty": X.quantity_or_null("quantity"),
            "item": F.lit(None).cast(adds.schema["item"].dataType),
        }
    )
    lacking = (F.col("op") == "set") & F.col("qty").isNull()
    others = others.withColumn("status", F.when(lacking, INVALID).otherwise(OK))
    return adds.withColumn("book_id", F.col("item.book_id")).select(*names).unionByName(others.select(*names))


def _in_turn(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Commands come sorted by key and time; the ids of adds that a row's quantity cannot take.

    Only the quantity of the key at hand is held: None without a row, negative while it is unsound."""
    key = have = None
    for part in parts:
        refused = []
        columns = (part.column(n).to_pylist() for n in ("user_id", "book_id", "cmd_id", "op", "qty", "_start"))
        for user, book, cmd, op, qty, start in zip(*columns, strict=True):
            if (user, book) != key:
                key, have = (user, book), start
            if op == "remove":
                have = None
            elif op == "set":
                have = have if have is None else qty
            elif have is None:
                have = qty
            elif have < 0 or have + qty > MOST:
                refused.append(cmd)
            else:
                have += qty
        yield pa.RecordBatch.from_arrays([pa.array(refused, pa.string())], ["cmd_id"])


class _Batch(NamedTuple):
    """The steps of a mixed batch and what they find in the cart."""

    steps: DataFrame
    owners: DataFrame  # all users of the steps
    stored: DataFrame  # of all keys of the steps
    refused: DataFrame


def _batch(cart: DataFrame, books: DataFrame, commands: DataFrame) -> _Batch:
    steps = written(_steps(books, commands))
    owners = _owners(steps)
    stored = written(_stored(cart, written(steps.select(*KEY).distinct()), owners))
    return _Batch(steps, owners, stored, written(_refused(stored, steps)))


def _refused(stored: DataFrame, steps: DataFrame) -> DataFrame:
    """Ids of adds that find an unsound quantity or would leave the integer range when the batch is served in order.

    Only keys that could come to this are served in turn: those with an unsound stored quantity, and those
    where the stored quantity, all adds and the largest set together exceed the range.
    """
    valid = steps.filter(F.col("status") == OK)
    load = written(
        valid.groupBy(*KEY)
        .agg(
            F.sum(F.when(F.col("op") == "add", F.col("qty"))).alias("_adds"),
            F.max(F.when(F.col("op") == "set", F.col("qty"))).alias("_sets"),
        )
        .filter(F.col("_adds").isNotNull())
    )
    start = F.when(F.col("_keep").isNotNull(), F.coalesce("_have", F.lit(-1)))
    most = F.col("_adds") + F.coalesce("_sets", F.lit(0)) + F.coalesce(start, F.lit(0))
    keys = load.join(stored, KEY, "left").withColumn("_start", start)
    risky = written(keys.filter((F.col("_start") < 0) | (most > MOST)).select(*KEY, "_start"))
    rows = valid.join(risky, KEY).select(*KEY, "ts", "cmd_id", "op", "qty", "_start").repartition(*KEY)
    return rows.sortWithinPartitions(*KEY, "ts", "cmd_id").mapInArrow(_in_turn, "cmd_id string")


def fold_commands(cart: DataFrame, books: DataFrame, commands: DataFrame) -> DataFrame:
    """The cart after a mixed batch of add, set and remove commands in (ts, cmd_id) order.

    Adds name a book as in ``add_to_cart``; set and remove name the ``book_id`` of the
    row.  An add that finds an unsound quantity, or would leave the integer range, changes nothing; the
    commands before and after it count as if it were not there.

    Nothing is sorted or collected per key, but for keys that hold such an add: what counts is the last remove, the
    last set, the first add after the last remove and the sums of the adds after them,
    all of which are plain aggregates.
    """
    return _folded(cart, _batch(cart, books, commands))


def _folded(cart: DataFrame, batch: _Batch) -> DataFrame:
    valid = batch.steps.filter(F.col("status") == OK)
    adds = valid.filter(F.col("op") == "add").join(batch.refused, "cmd_id", "left_anti")
    others = valid.filter(F.col("op") != "add")
    at = F.struct("ts", "cmd_id")
    marks = others.groupBy(*KEY).agg(
        F.max(F.when(F.col("op") == "remove", at)).alias("_removed"),
        F.max(F.when(F.col("op") == "set", F.struct("ts", "cmd_id", "qty"))).alias("_s"),
    )
    marks = marks.select(*KEY, "_removed", F.struct("_s.ts", "_s.cmd_id").alias("_set"), F.col("_s.qty").alias("_set_qty"))
    marks = marks.withColumn("_set", F.when(F.col("_set_qty").isNotNull(), F.col("_set")))
    marks = written(marks)
    marked = adds.join(marks.select(*KEY, "_removed", "_set"), KEY, "left")
    after_remove = F.col("_removed").isNull() | (at > F.col("_removed"))
    after_set = after_remove & F.col("_set").isNotNull() & (at > F.col("_set"))
    added = marked.groupBy(*KEY).agg(
        F.sum(F.when(after_remove, F.col("qty"))).alias("_sum"),
        F.sum(F.when(after_set, F.col("qty"))).alias("_sum_after_set"),
        F.max(F.when(after_remove, F.col("ts"))).alias("_last_add"),
        _first_add(after_remove).alias("_new"),
    )
    folded = written(added.join(marks, KEY, "full_outer"))
    keys = folded.join(batch.stored, KEY, "left")
    kept = F.col("_keep").isNotNull() & F.col("_removed").isNull()
    founded = F.col("_new").isNotNull()
    set_counts = (
        F.col("_set").isNotNull()
        & (F.col("_removed").isNull() | (F.col("_set") > F.col("_removed")))
        & (kept | (F.struct(F.col("_new.ts"), F.col("_new.cmd_id")) < F.col("_set")))
    )
    set_counts = F.coalesce(set_counts, F.lit(False))
    zero = F.lit(0)
    base = F.when(kept, F.col("_have")).otherwise(zero) + F.coalesce("_sum", zero)
    touched = keys.withColumns(
        {
            "_exists": kept | founded,
            "_qty": F.when(set_counts, F.col("_set_qty") + F.coalesce("_sum_after_set", zero)).otherwise(base),
            "_updated": F.greatest("_last_add", F.when(set_counts, F.col("_set.ts"))),
            "_keep": F.when(kept, F.col("_keep")),
        }
    )
    return _apply(cart, touched.withColumn("_qty", F.when(F.col("_exists"), F.col("_qty"))), batch.owners)


def fold_results(cart: DataFrame, books: DataFrame, commands: DataFrame) -> DataFrame:
    """One row per command of a mixed batch: cmd_id, user_id, op, status, as if served one after another.

    An add is ``ok`` exactly if ``fold_commands`` counts it.  A set or remove finds its row if the last add or remove of
    the key before it was an add or, where there was none, if the cart holds the key.
    """
    return _fold_results(_batch(cart, books, commands))


def _fold_results(batch: _Batch) -> DataFrame:
    every = batch.steps.select("cmd_id", "user_id", "book_id", "op", "ts", "status")
    founding = (F.col("status") == OK) & F.col("op").isin("add", "remove")
    at = F.when(founding, F.struct("ts", "cmd_id", "op"))
    followed = running(every, KEY, ["ts", "cmd_id"], at, latest=True)
    seen = followed.join(batch.stored.select(*KEY, F.lit(True).alias("_held")), KEY, "left")
    there = F.when(F.col("before").isNull(), F.coalesce("_held", F.lit(False))).otherwise(F.col("before.op") == "add")
    refused = batch.refused.withColumn("_refused", F.lit(True))
    status = (
        F.when(F.col("_refused"), INVALID)
        .when((F.col("op") != "add") & (F.col("status") == OK) & ~there, NOT_FOUND)
        .otherwise(F.col("status"))
    )
    return seen.join(refused, "cmd_id", "left").select("cmd_id", "user_id", "op", status.alias("status"))


def fold(cart: DataFrame, books: DataFrame, commands: DataFrame) -> CartChange:
    """``fold_commands`` and ``fold_results`` of the same batch."""
    batch = _batch(cart, books, commands)
    return CartChange(_folded(cart, batch), _fold_results(batch))


def line_subtotals(rows: DataFrame, price: str = "unit_price") -> DataFrame:
    return rows.withColumn("subtotal", (F.col(price) * F.col("quantity")).cast(X.WIDE_MONEY))


def selection_totals(cart: DataFrame, selection: DataFrame) -> DataFrame:
    """Per user: selected count, subtotal, delivery fee, total, and whether all rows
    are selected.  ``selection`` holds the ids of selected rows."""
    chosen = selection.select("id").distinct().withColumn("_sel", F.lit(True))
    marked = cart.join(chosen, "id", "left").withColumn("_sel", F.coalesce("_sel", F.lit(False)))
    amount = (F.col("unit_price") * F.col("quantity")).cast(X.WIDE_MONEY)
    per_user = marked.groupBy("user_id").agg(
        F.count_if("_sel").alias("selected_count"),
        F.coalesce(F.sum(F.when(F.col("_sel"), amount)), F.lit(0)).cast(X.WIDE_MONEY).alias("subtotal"),
        F.bool_and("_sel").alias("all_selected"),
    )
    return per_user.withColumn("delivery_fee", X.delivery_fee("subtotal")).withColumn(
        "total", (F.col("subtotal") + F.col("delivery_fee")).cast(X.WIDE_MONEY)
    )


def step_quantities(rows: DataFrame, step: Column | int) -> DataFrame:
    """Quantity moved by a step within the allowed range."""
    return rows.withColumn("stepped", X.clamp_quantity("quantity", step).cast("int"))
