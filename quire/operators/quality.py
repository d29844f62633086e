"""Table rules and command rules as violation rows, each table read once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import schemas
from quire.functions import exprs as X
from quire.operators.cart import add_faults, command_faults
from quire.operators.skew import written
from quire.operators.users import registration_faults, update_faults


def violations(df: DataFrame, table: str, rules: Mapping[str, Column]) -> DataFrame:
    """(table_name, row_key, rule) for every rule a row breaks; all rules in one pass."""
    key = F.col(schemas.PRIMARY_KEYS[table]).cast("string")
    return df.select(
        F.lit(table).alias("table_name"),
        key.alias("row_key"),
        F.explode(command_faults({n: F.coalesce(c, F.lit(False)) for n, c in rules.items()})).alias("rule"),
    )


def not_null(df: DataFrame, table: str) -> DataFrame:
    return violations(df, table, {f"{c} is null": F.col(c).isNull() for c in schemas.REQUIRED[table]})


# The declared value checks.
_NOT_NEGATIVE = {"cart_items": ("unit_price",), "order_items": ("unit_price",), "orders": ("total_amount",)}
_POSITIVE = {"cart_items": ("quantity",), "order_items": ("quantity",)}


def value_checks(df: DataFrame, table: str) -> DataFrame:
    rules = {f"{c} < 0": F.col(c) < 0 for c in _NOT_NEGATIVE.get(table, ())}
    rules |= {f"{c} <= 0": F.col(c) <= 0 for c in _POSITIVE.get(table, ())}
    return violations(df, table, rules)


def line_totals(items: DataFrame) -> DataFrame:
    wrong = F.col("line_total") != F.col("unit_price") * F.col("quantity")
    return violations(items, "order_items", {"line_total": wrong})


def statuses(orders: DataFrame) -> DataFrame:
    return violations(orders, "orders", {"status": ~F.col("status").isin(*schemas.ORDER_STATUSES)})


def lengths(df: DataFrame, table: str, limits: Mapping[str, int] | None = None) -> DataFrame:
    limits = schemas.MAX_LENGTHS[table] if limits is None else limits
    return violations(df, table, {f"{c} > {n}": F.length(c) > n for c, n in limits.items()})


def not_unique(df: DataFrame, table: str) -> DataFrame:
    """Key values held by more than one row."""
    out = None
    for key in schemas.UNIQUE_KEYS[table]:
        rows = (
            df.dropna(subset=list(key))
            .groupBy(*key)
            .agg(F.count(F.lit(1)).alias("rows"))
            .filter(F.col("rows") > 1)
            .select(
                F.lit(table).alias("table_name"),
                F.lit(",".join(key)).alias("rule"),
                F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("key_value"),
                "rows",
            )
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def orphans(child: DataFrame, table: str, column: str, parent: DataFrame, parent_table: str) -> DataFrame:
    """Child rows whose non-NULL reference has no parent row."""
    key = schemas.PRIMARY_KEYS[parent_table]
    parents = parent.select(F.col(key).alias(column))
    row_key = schemas.PRIMARY_KEYS[table]
    rows = child.select(F.col(row_key).alias("_key"), column).filter(F.col(column).isNotNull())
    return rows.join(parents, column, "left_anti").select(
        F.lit(table).alias("table_name"),
        F.col("_key").cast("string").alias("row_key"),
        F.lit(f"{column} -> {parent_table}").alias("rule"),
    )


def fk_orphans(tables: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for child, column, parent in schemas.FOREIGN_KEYS:
        rows = orphans(tables[child], child, column, tables[parent], parent)
        out = rows if out is None else out.unionByName(rows)
    return out


def cascade_delete_users(tables: Mapping[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the given users (id) and whatever belongs to them."""
    ids = written(gone.select("id").distinct())  # read three times, and small beside the rows it takes away
    owners = ids.withColumnRenamed("id", "user_id")
    orders = tables["orders"]
    lost_orders = written(orders.join(owners, "user_id", "left_semi").select(F.col("id").alias("order_id")))
    return {
        **tables,
        "users": tables["users"].join(ids, "id", "left_anti"),
        "cart_items": tables["cart_items"].join(owners, "user_id", "left_anti").select(*tables["cart_items"].columns),
        "orders": orders.join(owners, "user_id", "left_anti").select(*orders.columns),
        "order_items": tables["order_items"].join(lost_orders, "order_id", "left_anti"),
    }


def _verdicts(commands: DataFrame, faults: Column) -> DataFrame:
    out = commands.withColumn("faults", faults)
    return out.withColumn("status", F.when(F.size("faults") > 0, "invalid").otherwise("ok"))


def validate_registrations(commands: DataFrame) -> DataFrame:
    return _verdicts(commands, registration_faults())


def validate_profile_updates(commands: DataFrame) -> DataFrame:
    return _verdicts(commands, update_faults())


def validate_cart_commands(commands: DataFrame) -> DataFrame:
    """Adds need title, volume and quantity; sets need a quantity."""
    only_quantity = command_faults({"quantity": X.quantity_or_null("quantity").isNull()})
    none = F.array().cast("array<string>")
    faults = F.when(F.col("op") == "add", add_faults()).when(F.col("op") == "set", only_quantity).otherwise(none)
    return _verdicts(commands, faults)


def validate_order_commands(commands: DataFrame) -> DataFrame:
    """Sets need the line and a quantity, removes the line and its order."""
    item = X.text_or_null("order_item_id").isNull()
    is_set = F.col("op") == "set"
    return _verdicts(
        commands,
        command_faults(
            {
                "id": item,
                "quantity": is_set & X.quantity_or_null("quantity").isNull(),
                "order_id": ~is_set & X.text_or_null("order_id").isNull(),
            }
        ),
    )


def validate_checkouts(requests: DataFrame) -> DataFrame:
    return _verdicts(requests, command_faults({"cart_item_ids": F.size(X.distinct_ids("cart_item_ids")) == 0}))
