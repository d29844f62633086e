"""Order history, charges, totals and line changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import orders as O
from quire.operators import quality as Q
from quire.plans import views as V
from quire.plans.registry import as_text, q_quantity, q_text, query
from quire.plans.views import with_views

_LINES = """
h_lines AS (
  SELECT i.id, i.order_id, i.book_id, i.title, i.unit_price, i.quantity, i.line_total,
    coalesce(nullif(i.cover, ''), b.cover, '') AS cover, i.title AS book_title,
    nullif(split_part(i.book_id, '::', 2), '') AS volume, i.unit_price AS price
  FROM v_items i LEFT JOIN v_books b ON b.book_id = i.book_id)
"""


@query(
    "order_items_with_cover",
    with_views("v_items v_books", f"{_LINES.strip()} SELECT * FROM h_lines"),
)
def order_items_with_cover(spark: SparkSession, base: str) -> DataFrame:
    return O.items_with_cover(V.items(spark, base), V.books(spark, base))


def _line_text(x):
    blank = F.lit("-")
    return F.concat_ws(
        "|", x["id"], x["book_id"], x["book_title"], F.coalesce(x["volume"], blank), x["cover"],
        x["price"].cast("string"), x["quantity"].cast("string"), x["line_total"].cast("string"),
    )


@query(
    "order_history_sections",
    with_views("v_orders v_items", """
    h_placed AS (SELECT order_id, id, (row_number() OVER (PARTITION BY order_id ORDER BY id) - 1) // 3 AS section FROM v_items),
    h_sections AS (SELECT order_id, section, string_agg(id, ';' ORDER BY id) AS items FROM h_placed GROUP BY 1, 2)
    SELECT o.id, o.user_id, cast(coalesce(s.section, 0) as int) AS section, coalesce(s.items, '') AS items
    FROM v_orders o LEFT JOIN h_sections s ON s.order_id = o.id"""),
)
def order_history_sections(spark: SparkSession, base: str) -> DataFrame:
    docs = O.order_history(V.orders(spark, base), V.items(spark, base), V.books(spark, base), section_length=3)
    return docs.select("id", "user_id", "section", F.array_join("items.id", ";").alias("items"))


@query(
    "order_history",
    with_views("v_orders v_items v_books", f"""{_LINES.strip()}
    SELECT o.id, o.user_id, o.total_amount, o.status, cast(o.created_at as varchar) AS created_at,
      cast(o.created_at as varchar) AS purchase_date, coalesce(l.n, 0) AS n_items, coalesce(l.items, '') AS items,
      cast(0 as int) AS section
    FROM v_orders o LEFT JOIN (
      SELECT order_id, count(*) AS n, string_agg(id || '|' || book_id || '|' || book_title || '|' || coalesce(volume, '-') || '|' ||
        cover || '|' || cast(price as varchar) || '|' || cast(quantity as varchar) || '|' || cast(line_total as varchar),
        ';' ORDER BY id) AS items FROM h_lines GROUP BY 1) l ON l.order_id = o.id
    ORDER BY o.user_id, o.created_at DESC, o.id DESC"""),
)
def order_history(spark: SparkSession, base: str) -> DataFrame:
    docs = O.order_history(V.orders(spark, base), V.items(spark, base), V.books(spark, base))
    shown = docs.withColumn("n_items", F.size("items").cast("long")).withColumn(
        "items", F.array_join(F.transform("items", _line_text), ";")
    )
    return as_text(shown, "created_at", "purchase_date")


@query(
    "order_history_lines",
    with_views("v_orders v_items v_books", f"""{_LINES.strip()}
    SELECT o.id AS order_id, o.user_id, o.status, cast(o.created_at as varchar) AS purchase_date, l.id AS item_id,
      l.volume, l.cover, l.quantity
    FROM v_orders o LEFT JOIN h_lines l ON l.order_id = o.id
    WHERE o.user_id IN (SELECT cast(user_id as varchar) FROM events WHERE event_type = 'view')"""),
)
def order_history_lines(spark: SparkSession, base: str) -> DataFrame:
    askers = V.events(spark, base).filter("event_type = 'view'")
    rows = O.history_lines(V.orders(spark, base), V.items(spark, base), V.books(spark, base), askers)
    shown = rows.select("order_id", "user_id", "status", "purchase_date", "item_id", "volume", "cover", "quantity")
    return as_text(shown, "purchase_date")


_CHARGES = """
o_charges AS (
  SELECT id, user_id, created_at, item_count, subtotal,
    cast(CASE WHEN subtotal > 0 THEN round(subtotal * cast(0.1 as decimal(2,1)), 2) ELSE 0 END as decimal(28,2)) AS delivery_fee,
    cast(subtotal + CASE WHEN subtotal > 0 THEN round(subtotal * cast(0.1 as decimal(2,1)), 2) ELSE 0 END as decimal(28,2)) AS total
  FROM (SELECT o.id, o.user_id, o.created_at, count(i.id) AS item_count,
      cast(coalesce(sum(i.unit_price * i.quantity), 0) as decimal(28,2)) AS subtotal
    FROM v_orders o LEFT JOIN v_items i ON i.order_id = o.id GROUP BY o.id, o.user_id, o.created_at))
"""


@query(
    "order_charges",
    with_views("v_orders v_items", f"""{_CHARGES.strip()}
    SELECT id, user_id, item_count, subtotal, delivery_fee, total FROM o_charges"""),
)
def order_charges(spark: SparkSession, base: str) -> DataFrame:
    return O.charges(V.orders(spark, base), V.items(spark, base)).drop("created_at")


@query(
    "recent_purchases",
    with_views("v_orders v_items", f"""{_CHARGES.strip()}
    SELECT user_id, cast(rank as int) AS rank, id, cast(created_at as varchar) AS created_at, total AS amount, item_count
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rank FROM o_charges)
    WHERE rank <= 3"""),
)
def recent_purchases(spark: SparkSession, base: str) -> DataFrame:
    return as_text(O.recent_purchases(V.orders(spark, base), V.items(spark, base)), "created_at")


@query(
    "purchase_counts",
    with_views("v_orders v_items", """
    SELECT o.user_id, count(DISTINCT o.id) AS orders, count(i.id) AS items
    FROM v_orders o LEFT JOIN v_items i ON i.order_id = o.id GROUP BY 1"""),
)
def purchase_counts(spark: SparkSession, base: str) -> DataFrame:
    return O.purchase_counts(V.orders(spark, base), V.items(spark, base))


_TOTALS = "(SELECT order_id, sum(line_total) AS s FROM v_items GROUP BY 1)"


@query(
    "order_totals_recalc",
    with_views("v_orders v_items", f"""
    SELECT o.id, o.user_id, o.status, cast(coalesce(t.s, 0) as decimal(28,2)) AS total_amount
    FROM v_orders o LEFT JOIN {_TOTALS} t ON t.order_id = o.id"""),
)
def order_totals_recalc(spark: SparkSession, base: str) -> DataFrame:
    done = O.recalculated_totals(V.orders(spark, base), V.items(spark, base))
    return done.select("id", "user_id", "status", "total_amount")


@query(
    "order_total_drift",
    with_views("v_orders v_items", f"""
    SELECT o.id, cast(o.total_amount as decimal(28,2)) AS total_amount, cast(coalesce(t.s, 0) as decimal(28,2)) AS lines_total
    FROM v_orders o LEFT JOIN {_TOTALS} t ON t.order_id = o.id WHERE o.total_amount <> coalesce(t.s, 0)"""),
)
def order_total_drift(spark: SparkSession, base: str) -> DataFrame:
    return O.total_drift(V.orders(spark, base), V.items(spark, base))


@query(
    "orders_without_items",
    with_views("v_orders v_items", """
    SELECT id, user_id, status FROM v_orders o WHERE NOT EXISTS (SELECT 1 FROM v_items i WHERE i.order_id = o.id)"""),
)
def orders_without_items(spark: SparkSession, base: str) -> DataFrame:
    return O.without_items(V.orders(spark, base), V.items(spark, base)).select("id", "user_id", "status")


_SETS = f"""
u_cmds AS (SELECT cmd_id, user_id, {q_text('order_item_id')} AS item, {q_quantity('quantity')} AS qty, ts
  FROM v_line_commands WHERE op = 'set'),
u_hits AS (SELECT c.*, i.order_id FROM u_cmds c JOIN v_items i ON i.id = c.item
  JOIN v_orders o ON o.id = i.order_id AND o.user_id = c.user_id WHERE c.qty IS NOT NULL),
u_last AS (SELECT item, arg_max(qty, struct_pack(a := ts, b := cmd_id)) AS qty FROM u_hits GROUP BY 1),
u_items AS (SELECT i.* REPLACE (coalesce(l.qty, i.quantity) AS quantity,
    CASE WHEN l.qty IS NULL THEN i.line_total ELSE cast(i.unit_price * l.qty as decimal(28,2)) END AS line_total)
  FROM v_items i LEFT JOIN u_last l ON l.item = i.id)
"""
_LINE_VIEWS = "v_orders v_items v_line_commands"


def _sets(spark: SparkSession, base: str) -> O.QuantityChange:
    sets = V.line_commands(spark, base).filter("op = 'set'")
    return O.update_quantities(V.orders(spark, base), V.items(spark, base), sets)


@query(
    "order_item_qty_update",
    with_views(_LINE_VIEWS, f"""{_SETS.strip()}
    SELECT cmd_id, user_id, CASE WHEN item IS NULL OR qty IS NULL THEN 'invalid'
        WHEN cmd_id IN (SELECT cmd_id FROM u_hits) THEN 'ok' ELSE 'not_found' END AS status,
      cast(CASE WHEN cmd_id IN (SELECT cmd_id FROM u_hits) THEN 1 ELSE 0 END as int) AS affected_rows
    FROM u_cmds"""),
)
def order_item_qty_update(spark: SparkSession, base: str) -> DataFrame:
    return _sets(spark, base).results


@query(
    "order_item_qty_lines",
    with_views(_LINE_VIEWS, f"{_SETS.strip()} SELECT id, order_id, quantity, unit_price, line_total FROM u_items"),
)
def order_item_qty_lines(spark: SparkSession, base: str) -> DataFrame:
    return _sets(spark, base).items.select("id", "order_id", "quantity", "unit_price", "line_total")


@query(
    "order_item_qty_totals",
    with_views(_LINE_VIEWS, f"""{_SETS.strip()}
    SELECT o.id, o.user_id, CASE WHEN o.id IN (SELECT order_id FROM u_hits) THEN
        cast((SELECT sum(line_total) FROM u_items i WHERE i.order_id = o.id) as decimal(28,2)) ELSE o.total_amount END AS total_amount
    FROM v_orders o"""),
)
def order_item_qty_totals(spark: SparkSession, base: str) -> DataFrame:
    return _sets(spark, base).orders.select("id", "user_id", "total_amount")


_REMOVALS = f"""
r_cmds AS (SELECT cmd_id, user_id, {q_text('order_item_id')} AS item, {q_text('order_id')} AS ord, ts
  FROM v_line_commands WHERE op = 'remove'),
r_hits AS (SELECT c.*, row_number() OVER (PARTITION BY item ORDER BY ts, cmd_id) AS rn FROM r_cmds c
  JOIN v_items i ON i.id = c.item AND i.order_id = c.ord JOIN v_orders o ON o.id = i.order_id AND o.user_id = c.user_id),
r_gone AS (SELECT * FROM r_hits WHERE rn = 1),
r_items AS (SELECT * FROM v_items WHERE id NOT IN (SELECT item FROM r_gone)),
r_emptied AS (SELECT ord, arg_max(cmd_id, struct_pack(a := ts, b := cmd_id)) AS cmd_id FROM r_gone
  WHERE ord NOT IN (SELECT order_id FROM r_items) GROUP BY 1)
"""


def _removals(spark: SparkSession, base: str) -> O.LineChange:
    removals = V.line_commands(spark, base).filter("op = 'remove'")
    return O.delete_items(V.orders(spark, base), V.items(spark, base), removals)


@query(
    "order_item_delete",
    with_views(_LINE_VIEWS, f"{_REMOVALS.strip()} SELECT id, order_id, quantity, line_total FROM r_items"),
)
def order_item_delete(spark: SparkSession, base: str) -> DataFrame:
    return _removals(spark, base).items.select("id", "order_id", "quantity", "line_total")


@query(
    "order_delete_outcome",
    with_views(_LINE_VIEWS, f"""{_REMOVALS.strip()}
    SELECT cmd_id, user_id, CASE WHEN item IS NULL OR ord IS NULL THEN 'invalid'
        WHEN cmd_id IN (SELECT cmd_id FROM r_gone) THEN 'ok' ELSE 'not_found' END AS status,
      cast(CASE WHEN cmd_id IN (SELECT cmd_id FROM r_gone) THEN 1 ELSE 0 END as int) AS affected_rows,
      cmd_id IN (SELECT cmd_id FROM r_emptied) AS order_deleted
    FROM r_cmds"""),
)
def order_delete_outcome(spark: SparkSession, base: str) -> DataFrame:
    return _removals(spark, base).results


@query(
    "order_delete_totals",
    with_views(_LINE_VIEWS, f"""{_REMOVALS.strip()}
    SELECT o.id, o.user_id, CASE WHEN o.id IN (SELECT ord FROM r_gone) THEN
        cast((SELECT sum(line_total) FROM r_items i WHERE i.order_id = o.id) as decimal(28,2)) ELSE o.total_amount END AS total_amount
    FROM v_orders o WHERE o.id NOT IN (SELECT ord FROM r_emptied)"""),
)
def order_delete_totals(spark: SparkSession, base: str) -> DataFrame:
    return _removals(spark, base).orders.select("id", "user_id", "total_amount")


@query(
    "validate_order_commands",
    with_views("v_line_commands", f"""
    SELECT cmd_id, op, CASE WHEN faults = '' THEN 'ok' ELSE 'invalid' END AS status, faults FROM (
      SELECT cmd_id, op, array_to_string(list_filter([
        CASE WHEN {q_text('order_item_id')} IS NULL THEN 'id' END,
        CASE WHEN op = 'set' AND ({q_quantity('quantity')}) IS NULL THEN 'quantity' END,
        CASE WHEN op <> 'set' AND {q_text('order_id')} IS NULL THEN 'order_id' END], lambda x: x IS NOT NULL), ',') AS faults
      FROM v_line_commands)"""),
)
def validate_order_commands(spark: SparkSession, base: str) -> DataFrame:
    return Q.validate_order_commands(V.line_commands(spark, base)).select(
        "cmd_id", "op", "status", F.array_join("faults", ",").alias("faults")
    )
