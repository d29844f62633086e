"""User and data-quality queries."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schemas
from quire.functions import exprs as X
from quire.operators import quality as Q
from quire.operators import users as U
from quire.plans import views as V
from quire.plans.registry import as_text, q_md5_id, q_text, q_trim, query
from quire.plans.views import with_views

_TIMES = ("created_at", "updated_at")


@query(
    "user_profile",
    with_views("v_users", """
    SELECT id, name, email, cast(created_at as varchar) AS created_at FROM v_users
    WHERE id IN (SELECT cast(user_id as varchar) FROM events WHERE event_type = 'view')"""),
)
def user_profile(spark: SparkSession, base: str) -> DataFrame:
    asked = V.events(spark, base).filter("event_type = 'view'")
    return as_text(U.profiles(V.users(spark, base), asked), "created_at")


_REGISTER = f"""
u_reg AS (SELECT *, email IS NULL OR email = '' OR {q_text('name')} IS NULL AS bad FROM v_user_commands WHERE op = 'register'),
u_won AS (SELECT email, arg_min(cmd_id, struct_pack(a := ts, b := cmd_id)) AS cmd_id FROM u_reg
  WHERE NOT bad AND email NOT IN (SELECT email FROM v_users) GROUP BY 1),
u_res AS (SELECT *, CASE WHEN bad THEN 'invalid' WHEN cmd_id IN (SELECT cmd_id FROM u_won) THEN 'ok' ELSE 'conflict' END AS status
  FROM u_reg)
"""


def _register(spark: SparkSession, base: str) -> U.UserChange:
    return U.register(V.users(spark, base), V.user_commands(spark, base).filter("op = 'register'"))


@query(
    "register_users",
    with_views("v_users v_user_commands", f"{_REGISTER.strip()} SELECT cmd_id, email, status FROM u_res"),
)
def register_users(spark: SparkSession, base: str) -> DataFrame:
    return _register(spark, base).results


@query(
    "registered_users",
    with_views("v_users v_user_commands", f"""{_REGISTER.strip()}
    SELECT id, name, email, cast(created_at as varchar) AS created_at FROM v_users
    UNION ALL SELECT {q_md5_id('cmd_id')}, {q_trim('name')}, email, cast(ts as varchar) FROM u_res WHERE status = 'ok'"""),
)
def registered_users(spark: SparkSession, base: str) -> DataFrame:
    return as_text(_register(spark, base).users.drop("updated_at"), "created_at")


_UPDATES = f"""
p_cmds AS (SELECT *, {q_text('name')} AS n, {q_text('email')} AS e,
    (name IS NOT NULL AND {q_text('name')} IS NULL) OR (email IS NOT NULL AND {q_text('email')} IS NULL)
      OR (name IS NULL AND email IS NULL) AS bad
  FROM v_user_commands WHERE op = 'update'),
p_taken AS (SELECT c.cmd_id FROM p_cmds c JOIN v_users u ON u.email = c.e AND u.id <> c.user_id WHERE NOT c.bad),
p_known AS (SELECT * FROM p_cmds WHERE NOT bad AND cmd_id NOT IN (SELECT cmd_id FROM p_taken)
  AND user_id IN (SELECT id FROM v_users)),
p_first AS (SELECT e, arg_min(user_id, struct_pack(a := ts, b := cmd_id)) AS holder FROM p_known WHERE e IS NOT NULL GROUP BY 1),
p_late AS (SELECT k.cmd_id FROM p_known k JOIN p_first f ON f.e = k.e WHERE f.holder <> k.user_id),
p_ok AS (SELECT * FROM p_known WHERE cmd_id NOT IN (SELECT cmd_id FROM p_late)),
p_last AS (SELECT user_id, arg_max(n, struct_pack(a := ts, b := cmd_id)) FILTER (n IS NOT NULL) AS n,
  arg_max(e, struct_pack(a := ts, b := cmd_id)) FILTER (e IS NOT NULL) AS e, max(ts) AS ts FROM p_ok GROUP BY 1)
"""


def _updates(spark: SparkSession, base: str) -> U.UserChange:
    return U.update_profiles(V.users(spark, base), V.user_commands(spark, base).filter("op = 'update'"))


@query(
    "update_profiles",
    with_views("v_users v_user_commands", f"""{_UPDATES.strip()}
    SELECT u.id, coalesce(l.n, u.name) AS name, coalesce(l.e, u.email) AS email, cast(u.created_at as varchar) AS created_at,
      cast(coalesce(l.ts, u.updated_at) as varchar) AS updated_at
    FROM v_users u LEFT JOIN p_last l ON l.user_id = u.id"""),
)
def update_profiles(spark: SparkSession, base: str) -> DataFrame:
    return as_text(_updates(spark, base).users, *_TIMES)


@query(
    "update_profile_results",
    with_views("v_users v_user_commands", f"""{_UPDATES.strip()}
    SELECT cmd_id, user_id, status, cast(CASE WHEN status = 'ok' THEN 1 ELSE 0 END as int) AS affected_rows FROM (
      SELECT cmd_id, user_id, CASE WHEN bad THEN 'invalid' WHEN cmd_id IN (SELECT cmd_id FROM p_taken)
          OR cmd_id IN (SELECT cmd_id FROM p_late) THEN 'conflict'
        WHEN cmd_id IN (SELECT cmd_id FROM p_ok) THEN 'ok' ELSE 'not_found' END AS status FROM p_cmds)"""),
)
def update_profile_results(spark: SparkSession, base: str) -> DataFrame:
    return _updates(spark, base).results


@query(
    "email_conflicts",
    with_views("v_users v_user_commands", f"""
    SELECT c.cmd_id, c.user_id, u.email, u.id AS held_by
    FROM v_user_commands c JOIN v_users u ON u.email = {q_text('c.email')} AND u.id <> c.user_id"""),
)
def email_conflicts(spark: SparkSession, base: str) -> DataFrame:
    return U.email_conflicts(V.users(spark, base), V.user_commands(spark, base))


def _faults_sql(rules: dict[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in rules.items())
    return f"array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ',')"


@query(
    "validate_users",
    with_views("v_user_commands", "SELECT cmd_id, CASE WHEN faults = '' THEN 'ok' ELSE 'invalid' END AS status, faults FROM (SELECT cmd_id, " + _faults_sql({
        "email_required": "email IS NULL OR email = ''",
        "name_required": f"{q_text('name')} IS NULL",
        "name_too_short": "coalesce(length(name), 0) < 3",
        "email_format": f"email <> '' AND NOT regexp_full_match(email, '{X.EMAIL_PATTERN.strip('^$')}')",
    }) + " AS faults FROM v_user_commands)"),
)
def validate_users(spark: SparkSession, base: str) -> DataFrame:
    return Q.validate_registrations(V.user_commands(spark, base)).select(
        "cmd_id", "status", F.array_join("faults", ",").alias("faults")
    )


@query(
    "validate_profile_updates",
    with_views("v_user_commands", "SELECT cmd_id, CASE WHEN faults = '' THEN 'ok' ELSE 'invalid' END AS status, faults FROM (SELECT cmd_id, " + _faults_sql({
        "name_blank": f"name IS NOT NULL AND {q_text('name')} IS NULL",
        "email_blank": f"email IS NOT NULL AND {q_text('email')} IS NULL",
        "no_fields": "name IS NULL AND email IS NULL",
    }) + " AS faults FROM v_user_commands)"),
)
def validate_profile_updates(spark: SparkSession, base: str) -> DataFrame:
    return Q.validate_profile_updates(V.user_commands(spark, base)).select(
        "cmd_id", "status", F.array_join("faults", ",").alias("faults")
    )


# Table rules ---------------------------------------------------------------------------
#
# The test tables keep every rule, so each query below bends its input in a fixed way,
# the same on both sides.

_BENT = {
    "books": {
        "title": "case when cover = '' then null else title end",
        "price": "case when page_count is null then null else price end",
        "author": "case when page_count = 0 then repeat('long author ', 30) else author end",
        "genre": "case when volume = '  ' then repeat('genre ', 50) else genre end",
    },
    "order_items": {
        "unit_price": "case when quantity = 7 then cast(-unit_price as decimal(10,2)) else unit_price end",
        "quantity": "case when quantity = 9 then 0 when quantity = 11 then -1 else quantity end",
        "title": "case when quantity = 13 then repeat('long title ', 30) when quantity = 15 then null else title end",
        "order_id": "case when quantity = 17 then 'gone-' || order_id else order_id end",
    },
    "cart_items": {
        "quantity": "case when quantity = 9 then 0 else quantity end",
        "unit_price": "case when quantity = 7 then cast(-unit_price as decimal(10,2)) else unit_price end",
        "volume": "case when quantity = 11 then null when quantity = 13 then repeat('volume ', 9) else volume end",
        "user_id": "case when user_id like '%17' then 'gone-' || user_id else user_id end",
    },
    "orders": {
        "status": "case when user_id like '%7' then 'paid' else status end",
        "total_amount": "case when user_id like '%5' then cast(-total_amount as decimal(10,2)) else total_amount end",
        "user_id": "case when user_id like '%13' then 'gone-' || user_id else user_id end",
    },
    "users": {
        "email": "case when id like '%3' then 'shared@example.com' when id like '%6' then null else email end",
        "name": "case when id like '%8' then repeat('long name ', 20) else name end",
    },
}
_VIEW = {"books": "v_books", "order_items": "v_items", "orders": "v_orders", "users": "v_users", "cart_items": "v_cart"}
_READ = {"books": V.books, "order_items": V.items, "orders": V.orders, "users": V.users, "cart_items": V.cart}


def _bent(spark: SparkSession, base: str, table: str) -> DataFrame:
    df = _READ[table](spark, base)
    return df.withColumns({c: F.expr(e) for c, e in _BENT.get(table, {}).items()})


def _bent_sql(table: str) -> str:
    if table not in _BENT:
        return _VIEW[table]
    changes = ", ".join(f"{e} AS {c}" for c, e in _BENT[table].items())
    return f"(SELECT * REPLACE ({changes}) FROM {_VIEW[table]})"


def _rules_sql(table: str, rules: dict[str, str]) -> str:
    key = schemas.PRIMARY_KEYS[table]
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, {key} AS row_key, '{name}' AS rule FROM {_bent_sql(table)} WHERE {cond}"
        for name, cond in rules.items()
    )


_ALL_VIEWS = " ".join(_VIEW.values())


def _every(spark: SparkSession, base: str, rule: Callable[[DataFrame, str], DataFrame], tables: Iterable[str]) -> DataFrame:
    """What breaks a kind of rule in any of the tables."""
    return functools.reduce(DataFrame.unionByName, [rule(_bent(spark, base, t), t) for t in tables])


def _every_sql(rules: dict[str, dict[str, str]]) -> str:
    return " UNION ALL ".join(_rules_sql(table, of) for table, of in rules.items())


@query(
    "dq_not_null",
    with_views(
        _ALL_VIEWS, _every_sql({t: {f"{c} is null": f"{c} IS NULL" for c in columns} for t, columns in schemas.REQUIRED.items()})
    ),
)
def dq_not_null(spark: SparkSession, base: str) -> DataFrame:
    return _every(spark, base, Q.not_null, schemas.REQUIRED)


_LINE_CHECKS = {"unit_price < 0": "unit_price < 0", "quantity <= 0": "quantity <= 0"}


@query(
    "dq_checks",
    with_views(
        "v_items v_orders v_cart",
        _every_sql({"order_items": _LINE_CHECKS, "cart_items": _LINE_CHECKS, "orders": {"total_amount < 0": "total_amount < 0"}}),
    ),
)
def dq_checks(spark: SparkSession, base: str) -> DataFrame:
    return _every(spark, base, Q.value_checks, ("order_items", "cart_items", "orders"))


@query(
    "dq_line_totals",
    with_views("v_items", """
    SELECT 'order_items' AS table_name, id AS row_key, 'line_total' AS rule FROM v_items
    WHERE line_total <> unit_price * quantity"""),
)
def dq_line_totals(spark: SparkSession, base: str) -> DataFrame:
    return Q.line_totals(V.items(spark, base))


@query(
    "dq_status",
    with_views("v_orders", _rules_sql("orders", {"status": "status NOT IN ('pending', 'completed', 'cancelled')"})),
)
def dq_status(spark: SparkSession, base: str) -> DataFrame:
    return Q.statuses(_bent(spark, base, "orders"))


@query(
    "dq_unique",
    with_views("v_books v_users v_cart", f"""
    SELECT 'users' AS table_name, 'email' AS rule, email AS key_value, count(*) AS rows FROM {_bent_sql('users')}
      WHERE email IS NOT NULL GROUP BY email HAVING count(*) > 1
    UNION ALL SELECT 'cart_items', 'user_id,book_id', user_id || '|' || book_id, count(*) FROM {_bent_sql('cart_items')}
      GROUP BY user_id, book_id HAVING count(*) > 1
    UNION ALL SELECT 'books', 'book_id', book_id, count(*) FROM v_books GROUP BY book_id HAVING count(*) > 1"""),
)
def dq_unique(spark: SparkSession, base: str) -> DataFrame:
    found = [Q.not_unique(_bent(spark, base, t), t) for t in ("users", "cart_items", "books")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    "dq_lengths",
    with_views(
        _ALL_VIEWS, _every_sql({t: {f"{c} > {n}": f"length({c}) > {n}" for c, n in limits.items()} for t, limits in schemas.MAX_LENGTHS.items()})
    ),
)
def dq_lengths(spark: SparkSession, base: str) -> DataFrame:
    return _every(spark, base, Q.lengths, schemas.MAX_LENGTHS)


def _tables(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    return {t: _READ[t](spark, base) if t == "users" else _bent(spark, base, t) for t in _READ}


@query(
    "fk_orphans",
    with_views("v_users v_cart v_orders v_items", f"""
    SELECT 'cart_items' AS table_name, id AS row_key, 'user_id -> users' AS rule FROM {_bent_sql('cart_items')} c
      WHERE NOT EXISTS (SELECT 1 FROM v_users u WHERE u.id = c.user_id)
    UNION ALL SELECT 'orders', id, 'user_id -> users' FROM {_bent_sql('orders')} o
      WHERE NOT EXISTS (SELECT 1 FROM v_users u WHERE u.id = o.user_id)
    UNION ALL SELECT 'order_items', id, 'order_id -> orders' FROM {_bent_sql('order_items')} i
      WHERE NOT EXISTS (SELECT 1 FROM v_orders o WHERE o.id = i.order_id)"""),
)
def fk_orphans(spark: SparkSession, base: str) -> DataFrame:
    return Q.fk_orphans(_tables(spark, base))


@query(
    "cascade_delete_user",
    with_views("v_users v_cart v_orders v_items", """
    g AS (SELECT DISTINCT cast(user_id as varchar) AS id FROM events WHERE event_type = 'error')
    SELECT 'users' AS table_name, id AS row_key FROM v_users WHERE id NOT IN (SELECT id FROM g)
    UNION ALL SELECT 'cart_items', id FROM v_cart WHERE user_id NOT IN (SELECT id FROM g)
    UNION ALL SELECT 'orders', id FROM v_orders WHERE user_id NOT IN (SELECT id FROM g)
    UNION ALL SELECT 'order_items', i.id FROM v_items i JOIN v_orders o ON o.id = i.order_id
      WHERE o.user_id NOT IN (SELECT id FROM g)"""),
)
def cascade_delete_user(spark: SparkSession, base: str) -> DataFrame:
    gone = V.events(spark, base).filter("event_type = 'error'").select(F.col("user_id").alias("id"))
    tables = {t: read(spark, base) for t, read in _READ.items() if t != "books"}
    left = Q.cascade_delete_users(tables, gone)
    out = None
    for name in ("users", "cart_items", "orders", "order_items"):
        rows = left[name].select(F.lit(name).alias("table_name"), F.col("id").alias("row_key"))
        out = rows if out is None else out.unionByName(rows)
    return out
