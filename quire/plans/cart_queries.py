"""Cart and checkout queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import cart as C
from quire.operators import checkout as K
from quire.operators import quality as Q
from quire.plans import views as V
from quire.plans.catalog_queries import RESOLVE_SQL
from quire.plans.registry import as_text, q_md5_id, q_quantity, q_text, query
from quire.plans.views import with_views

_TIMES = ("created_at", "updated_at")
_ALL = ", ".join(C.COLUMNS)
_ALL_TEXT = _ALL.replace("created_at", "cast(created_at as varchar) AS created_at").replace(
    "updated_at", "cast(updated_at as varchar) AS updated_at"
)
_CONSOLIDATED = """
SELECT arg_max(id, {at}) AS id, user_id, book_id, arg_max(title, {at}) AS title, arg_max(volume, {at}) AS volume,
  arg_max(cover, {at}) AS cover, arg_max(unit_price, {at}) AS unit_price, cast(sum(quantity) as int) AS quantity,
  max(created_at) AS created_at, max(updated_at) AS updated_at
FROM v_cart GROUP BY user_id, book_id""".format(at="struct_pack(a := created_at, b := id)")


@query(
    "cart_view",
    with_views("v_cart", f"""
    SELECT id, user_id, book_id, title AS book_title, volume, cover, unit_price AS price, quantity,
      cast(created_at as varchar) AS created_at, cast(updated_at as varchar) AS updated_at
    FROM ({_CONSOLIDATED}) ORDER BY user_id, created_at DESC, id DESC"""),
)
def cart_view(spark: SparkSession, base: str) -> DataFrame:
    return as_text(C.cart_view(V.cart(spark, base)), *_TIMES)


@query(
    "cart_view_of_users",
    with_views("v_cart", f"""
    SELECT id, user_id, book_id, title AS book_title, quantity FROM ({_CONSOLIDATED})
    WHERE user_id IN (SELECT cast(user_id as varchar) FROM events WHERE event_type = 'click')"""),
)
def cart_view_of_users(spark: SparkSession, base: str) -> DataFrame:
    askers = V.events(spark, base).filter("event_type = 'click'")
    return C.cart_view(V.cart(spark, base), askers).select("id", "user_id", "book_id", "book_title", "quantity")


@query("cart_compact", with_views("v_cart", f"SELECT {_ALL_TEXT} FROM ({_CONSOLIDATED})"))
def cart_compact(spark: SparkSession, base: str) -> DataFrame:
    return as_text(C.consolidate(V.cart(spark, base)), *_TIMES)


@query(
    "cart_duplicates",
    with_views("v_cart", """
    SELECT id, user_id, book_id, quantity FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, book_id ORDER BY created_at DESC, id DESC) AS rn FROM v_cart)
    WHERE rn > 1"""),
)
def cart_duplicates(spark: SparkSession, base: str) -> DataFrame:
    return C.duplicates(V.cart(spark, base)).select("id", "user_id", "book_id", "quantity")


# The ids each purchase names, as rows.
_ASKED = """
k_asked AS (
  SELECT request_id, user_id, ts, unnest([user_id || '-' || cast(k % 10 as varchar),
         user_id || '-' || cast((k + 1) % 10 as varchar)]) AS id FROM v_purchases WHERE NOT is_empty
  UNION ALL SELECT request_id, user_id, ts, 'x-1' FROM v_purchases WHERE NOT is_empty AND foreign_row)
"""


@query(
    "cart_items_by_ids",
    with_views("v_small_cart v_purchases", f"""{_ASKED.strip()}
    SELECT id, user_id, book_id, quantity, unit_price FROM v_small_cart c
    WHERE EXISTS (SELECT 1 FROM k_asked a WHERE a.id = c.id AND a.user_id = c.user_id)"""),
)
def cart_items_by_ids(spark: SparkSession, base: str) -> DataFrame:
    found = C.items_by_ids(V.small_cart(spark, base), V.checkout_requests(spark, base))
    return found.select("id", "user_id", "book_id", "quantity", "unit_price")


_ADD_SQL = with_views("v_commands v_books v_cart", RESOLVE_SQL.strip() + f""",
    d_adds AS (
      SELECT user_id, r_book_id AS book_id, sum(qty) AS add_qty, max(ts) AS last_ts,
        arg_min(cmd_id, struct_pack(a := ts, b := cmd_id)) AS first_cmd, min(ts) AS first_ts,
        any_value(r_title) AS title, any_value(r_volume) AS volume, any_value(r_cover) AS cover,
        any_value(r_price) AS price
      FROM a_resolved WHERE status = 'ok' GROUP BY 1, 2),
    d_ranked AS (
      SELECT c.*, row_number() OVER (PARTITION BY user_id, book_id ORDER BY created_at DESC, id DESC) AS rn,
        sum(quantity) OVER (PARTITION BY user_id, book_id) AS total FROM v_cart c),
    d_result AS (
      SELECT c.id, c.user_id, c.book_id, c.title, c.volume, c.cover, c.unit_price,
        cast(CASE WHEN d.add_qty IS NULL THEN c.quantity ELSE c.total + d.add_qty END as int) AS quantity,
        c.created_at, coalesce(d.last_ts, c.updated_at) AS updated_at
      FROM d_ranked c LEFT JOIN d_adds d USING (user_id, book_id) WHERE d.add_qty IS NULL OR c.rn = 1
      UNION ALL
      SELECT {q_md5_id('d.first_cmd')}, d.user_id, d.book_id, d.title, d.volume, d.cover, d.price,
        cast(d.add_qty as int), d.first_ts, d.last_ts
      FROM d_adds d WHERE NOT EXISTS (SELECT 1 FROM v_cart c WHERE c.user_id = d.user_id AND c.book_id = d.book_id))
    SELECT {_ALL_TEXT} FROM d_result""")


@query("cart_add", _ADD_SQL)
def cart_add(spark: SparkSession, base: str) -> DataFrame:
    adds = V.commands(spark, base).filter("op = 'add'")
    change = C.add_to_cart(V.cart(spark, base), V.books(spark, base), adds)
    return as_text(change.cart, *_TIMES)


_SETS = f"""
s_cmds AS (SELECT *, {q_quantity('quantity')} AS qty FROM v_small_commands WHERE op = 'set'),
s_hits AS (SELECT s.* FROM s_cmds s JOIN v_small_cart c ON c.id = s.cart_item_id AND c.user_id = s.user_id
  WHERE s.qty IS NOT NULL)
"""


@query(
    "cart_set_quantity",
    with_views("v_small_cart v_small_commands", f"""{_SETS.strip()},
    s_last AS (SELECT cart_item_id, arg_max(qty, struct_pack(a := ts, b := cmd_id)) AS qty, max(ts) AS ts
      FROM s_hits GROUP BY 1),
    s_done AS (SELECT c.* REPLACE (coalesce(l.qty, c.quantity) AS quantity, coalesce(l.ts, c.updated_at) AS updated_at)
      FROM v_small_cart c LEFT JOIN s_last l ON l.cart_item_id = c.id)
    SELECT {_ALL_TEXT} FROM s_done"""),
)
def cart_set_quantity(spark: SparkSession, base: str) -> DataFrame:
    sets = V.small_commands(spark, base).filter("op = 'set'")
    return as_text(C.set_quantity(V.small_cart(spark, base), sets).cart, *_TIMES)


@query(
    "cart_set_results",
    with_views("v_small_cart v_small_commands", f"""{_SETS.strip()}
    SELECT cmd_id, user_id, CASE WHEN qty IS NULL THEN 'invalid'
        WHEN cmd_id IN (SELECT cmd_id FROM s_hits) THEN 'ok' ELSE 'not_found' END AS status,
      cast(CASE WHEN cmd_id IN (SELECT cmd_id FROM s_hits) THEN 1 ELSE 0 END as int) AS affected_rows
    FROM s_cmds"""),
)
def cart_set_results(spark: SparkSession, base: str) -> DataFrame:
    sets = V.small_commands(spark, base).filter("op = 'set'")
    return C.set_quantity(V.small_cart(spark, base), sets).results


_REMOVALS = """
x_first AS (SELECT cart_item_id AS id, arg_min(cmd_id, struct_pack(a := ts, b := cmd_id)) AS cmd_id
  FROM v_small_commands s WHERE op = 'remove'
    AND EXISTS (SELECT 1 FROM v_small_cart c WHERE c.id = s.cart_item_id AND c.user_id = s.user_id) GROUP BY 1)
"""


@query(
    "cart_remove",
    with_views("v_small_cart v_small_commands", f"""{_REMOVALS.strip()}
    SELECT {_ALL_TEXT} FROM v_small_cart WHERE id NOT IN (SELECT id FROM x_first)"""),
)
def cart_remove(spark: SparkSession, base: str) -> DataFrame:
    removals = V.small_commands(spark, base).filter("op = 'remove'")
    left = C.remove_from_cart(V.small_cart(spark, base), removals).cart
    return as_text(left.select(*C.COLUMNS), *_TIMES)


@query(
    "cart_remove_results",
    with_views("v_small_cart v_small_commands", f"""{_REMOVALS.strip()}
    SELECT cmd_id, user_id, CASE WHEN cmd_id IN (SELECT cmd_id FROM x_first) THEN 'ok' ELSE 'not_found' END AS status,
      cast(CASE WHEN cmd_id IN (SELECT cmd_id FROM x_first) THEN 1 ELSE 0 END as int) AS affected_rows
    FROM v_small_commands WHERE op = 'remove'"""),
)
def cart_remove_results(spark: SparkSession, base: str) -> DataFrame:
    removals = V.small_commands(spark, base).filter("op = 'remove'")
    return C.remove_from_cart(V.small_cart(spark, base), removals).results


# Some rows of the small cart are full and some are unsound, in the same expression on both sides.
_PLANTED = "case when id like '%-3' then 2147483640 when id like '%-4' then -1 else quantity end"
_REFUSED = "(s.op = 'add' AND coalesce(r.qty < 0 OR r.qty + s.q > 2147483647, false))"


def fold_tables(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    planted = V.small_cart(spark, base).withColumn("quantity", F.expr(_PLANTED).cast("int"))
    return planted, V.small_books(spark, base), V.small_commands(spark, base)


FOLD_SQL = with_views("v_small_cart v_small_commands v_small_books", f"""
    f_cart AS (SELECT * REPLACE (cast({_PLANTED} as int) AS quantity) FROM v_small_cart),
    f_cmds AS (
      SELECT cmd_id, user_id, book_id, op, ts, {q_quantity('quantity')} AS q,
        row_number() OVER (PARTITION BY user_id, book_id ORDER BY ts, cmd_id) AS n
      FROM v_small_commands WHERE op = 'remove' OR ({q_quantity('quantity')}) IS NOT NULL),
    f_run AS (
      SELECT k.user_id, k.book_id, cast(0 as bigint) AS n, cast(c.quantity as bigint) AS qty,
        cast(null as varchar) AS born_cmd, cast(null as timestamp) AS born_ts, cast(null as timestamp) AS changed
      FROM (SELECT DISTINCT user_id, book_id FROM f_cmds) k LEFT JOIN f_cart c USING (user_id, book_id)
      UNION ALL
      SELECT r.user_id, r.book_id, s.n,
        CASE WHEN {_REFUSED} THEN r.qty WHEN s.op = 'add' THEN coalesce(r.qty, 0) + s.q WHEN s.op = 'set' AND r.qty IS NOT NULL THEN s.q END,
        CASE WHEN s.op = 'remove' THEN NULL WHEN s.op = 'add' AND r.qty IS NULL THEN s.cmd_id ELSE r.born_cmd END,
        CASE WHEN s.op = 'remove' THEN NULL WHEN s.op = 'add' AND r.qty IS NULL THEN s.ts ELSE r.born_ts END,
        CASE WHEN s.op = 'remove' THEN NULL WHEN {_REFUSED} OR (s.op = 'set' AND r.qty IS NULL) THEN r.changed ELSE s.ts END
      FROM f_run r JOIN f_cmds s ON s.user_id = r.user_id AND s.book_id = r.book_id AND s.n = r.n + 1),
    f_end AS (SELECT user_id, book_id, arg_max(struct_pack(qty := qty, born_cmd := born_cmd, born_ts := born_ts, changed := changed), n) AS e
      FROM f_run GROUP BY 1, 2),
    f_result AS (
      SELECT c.* FROM f_cart c WHERE NOT EXISTS
        (SELECT 1 FROM f_end f WHERE f.user_id = c.user_id AND f.book_id = c.book_id)
      UNION ALL
      SELECT CASE WHEN e.born_cmd IS NULL THEN c.id ELSE {q_md5_id('e.born_cmd')} END, f.user_id, f.book_id,
        CASE WHEN e.born_cmd IS NULL THEN c.title ELSE b.title END,
        CASE WHEN e.born_cmd IS NULL THEN c.volume ELSE replace(b.volume, 'Vol ', '') END,
        CASE WHEN e.born_cmd IS NULL THEN c.cover ELSE b.cover END,
        CASE WHEN e.born_cmd IS NULL THEN c.unit_price ELSE b.price END, cast(e.qty as int),
        coalesce(e.born_ts, c.created_at), coalesce(e.changed, c.updated_at)
      FROM f_end f LEFT JOIN f_cart c USING (user_id, book_id) LEFT JOIN v_small_books b ON b.book_id = f.book_id
      WHERE e.qty IS NOT NULL)
    SELECT {_ALL_TEXT} FROM f_result""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("cart_fold", FOLD_SQL)
def cart_fold(spark: SparkSession, base: str) -> DataFrame:
    done = C.fold_commands(*fold_tables(spark, base))
    return as_text(done, *_TIMES)


_FOLD_STEPS = FOLD_SQL[: FOLD_SQL.index("f_end AS")]
FOLD_RESULTS_SQL = f"""{_FOLD_STEPS}
    f_bad AS (SELECT * FROM v_small_commands WHERE op <> 'remove' AND ({q_quantity('quantity')}) IS NULL)
    SELECT s.cmd_id, s.user_id, s.op, CASE WHEN {_REFUSED} THEN 'invalid' WHEN s.op <> 'add' AND r.qty IS NULL THEN 'not_found' ELSE 'ok' END AS status
    FROM f_cmds s JOIN f_run r ON r.user_id = s.user_id AND r.book_id = s.book_id AND r.n = s.n - 1
    UNION ALL SELECT cmd_id, user_id, op, 'invalid' FROM f_bad"""


@query("cart_fold_results", FOLD_RESULTS_SQL)
def cart_fold_results(spark: SparkSession, base: str) -> DataFrame:
    return C.fold_results(*fold_tables(spark, base))


@query(
    "cart_add_results",
    with_views("v_commands v_books v_cart", RESOLVE_SQL.strip() + """
    SELECT cmd_id, user_id, status, r_book_id AS book_id FROM a_resolved"""),
)
def cart_add_results(spark: SparkSession, base: str) -> DataFrame:
    adds = V.commands(spark, base).filter("op = 'add'")
    return C.add_to_cart(V.cart(spark, base), V.books(spark, base), adds).results


@query(
    "line_subtotals",
    with_views("v_cart", """
    SELECT id, quantity, unit_price, cast(unit_price * quantity as decimal(28,2)) AS subtotal FROM v_cart"""),
)
def line_subtotals(spark: SparkSession, base: str) -> DataFrame:
    return C.line_subtotals(V.cart(spark, base)).select("id", "quantity", "unit_price", "subtotal")


# Rows of odd line numbers count as selected.
@query(
    "selection_totals",
    with_views("v_cart", """
    SELECT user_id, selected_count, subtotal,
      cast(CASE WHEN subtotal > 0 THEN round(subtotal * cast(0.1 as decimal(2,1)), 2) ELSE 0 END as decimal(28,2)) AS delivery_fee,
      cast(subtotal + CASE WHEN subtotal > 0 THEN round(subtotal * cast(0.1 as decimal(2,1)), 2) ELSE 0 END as decimal(28,2)) AS total,
      all_selected
    FROM (SELECT user_id, count(*) FILTER (chosen) AS selected_count,
        cast(coalesce(sum(unit_price * quantity) FILTER (chosen), 0) as decimal(28,2)) AS subtotal, bool_and(chosen) AS all_selected
      FROM (SELECT *, volume IN ('1', '3', '5', '7') AS chosen FROM v_cart) GROUP BY user_id)"""),
)
def selection_totals(spark: SparkSession, base: str) -> DataFrame:
    rows = V.cart(spark, base)
    chosen = rows.filter(F.col("volume").isin("1", "3", "5", "7")).select("id")
    return C.selection_totals(rows, chosen).select(
        "user_id", "selected_count", "subtotal", "delivery_fee", "total", "all_selected"
    )


@query(
    "clamp_quantity",
    with_views("v_items", """
    SELECT id, quantity, cast(greatest(least(quantity + 1, 10), 1) as int) AS up,
      cast(greatest(least(quantity - 1, 10), 1) as int) AS down FROM v_items"""),
)
def clamp_quantity(spark: SparkSession, base: str) -> DataFrame:
    rows = V.items(spark, base).select("id", "quantity")
    up = C.step_quantities(rows, 1).withColumnRenamed("stepped", "up")
    return C.step_quantities(up, -1).withColumnRenamed("stepped", "down")


@query(
    "validate_cart_commands",
    with_views("v_commands", f"""
    SELECT cmd_id, op, status, faults FROM (
      SELECT cmd_id, op, array_to_string(list_filter([
          CASE WHEN op = 'add' AND {q_text('book_title')} IS NULL THEN 'book_title' END,
          CASE WHEN op = 'add' AND {q_text('volume')} IS NULL THEN 'volume' END,
          CASE WHEN op IN ('add', 'set') AND ({q_quantity('quantity')}) IS NULL THEN 'quantity' END
        ], lambda x: x IS NOT NULL), ',') AS faults, CASE WHEN faults = '' THEN 'ok' ELSE 'invalid' END AS status
      FROM v_commands)"""),
)
def validate_cart_commands(spark: SparkSession, base: str) -> DataFrame:
    return Q.validate_cart_commands(V.commands(spark, base)).select(
        "cmd_id", "op", "status", F.array_join("faults", ",").alias("faults")
    )


# Checkout ----------------------------------------------------------------------------

_VALIDATED = """
k_own AS (SELECT user_id, cast(bit_or(cast(1 as bigint) << cast(volume as int)) as bigint) AS mask FROM v_small_cart GROUP BY 1),
k_req AS (
  SELECT p.*, coalesce(o.mask, 0) AS mask,
    (cast(1 as bigint) << (k % 10)) | (cast(1 as bigint) << ((k + 1) % 10)) AS need,
    CASE WHEN is_empty THEN 0 WHEN foreign_row THEN 3 ELSE 2 END AS requested
  FROM v_purchases p LEFT JOIN k_own o USING (user_id)),
k_valid AS (
  SELECT *, CASE WHEN is_empty THEN 0 ELSE bit_count(need & mask) END AS matched,
    CASE WHEN is_empty THEN 'invalid' WHEN foreign_row OR (need & mask) <> need THEN 'not_found' ELSE 'ok' END AS checked
  FROM k_req)
"""
_DECIDED = f"""{_VALIDATED.strip()},
k_turns AS (
  SELECT user_id, request_id, need, row_number() OVER (PARTITION BY user_id ORDER BY ts, request_id) AS n
  FROM k_valid WHERE checked = 'ok'),
k_run AS (
  SELECT DISTINCT user_id, cast(0 as bigint) AS n, cast(0 as bigint) AS taken, cast(null as varchar) AS request_id,
    false AS won FROM k_turns
  UNION ALL
  SELECT r.user_id, t.n, CASE WHEN (r.taken & t.need) = 0 THEN r.taken | t.need ELSE r.taken END, t.request_id,
    (r.taken & t.need) = 0
  FROM k_run r JOIN k_turns t ON t.user_id = r.user_id AND t.n = r.n + 1),
k_won AS (SELECT v.* FROM k_valid v WHERE request_id IN (SELECT request_id FROM k_run WHERE won)),
k_bought AS (
  SELECT w.request_id, w.ts, c.* FROM k_won w JOIN v_small_cart c ON c.user_id = w.user_id
    AND cast(c.volume as int) IN (w.k % 10, (w.k + 1) % 10))
"""


def _checkout_sql(body: str) -> str:
    return with_views("v_small_cart v_purchases", f"{_DECIDED.strip()} {body.strip()}").replace(
        "WITH ", "WITH RECURSIVE ", 1
    )


def _checkout(spark: SparkSession, base: str) -> K.Checkout:
    return K.checkout(V.small_cart(spark, base), V.checkout_requests(spark, base))


@query(
    "checkout_validate",
    with_views("v_small_cart v_purchases", f"""{_VALIDATED.strip()}
    SELECT request_id, user_id, cast(requested as int) AS requested, cast(matched as int) AS matched, checked AS status
    FROM k_valid"""),
)
def checkout_validate(spark: SparkSession, base: str) -> DataFrame:
    checked = K.validate(V.small_cart(spark, base), V.checkout_requests(spark, base))
    return checked.select("request_id", "user_id", "requested", "matched", "status")


@query(
    "checkout_results",
    _checkout_sql(f"""
    SELECT request_id, user_id, CASE WHEN checked = 'ok' AND request_id NOT IN (SELECT request_id FROM k_won)
        THEN 'not_found' ELSE checked END AS status,
      CASE WHEN request_id IN (SELECT request_id FROM k_won) THEN {q_md5_id('request_id')} END AS order_id
    FROM k_valid"""),
)
def checkout_results(spark: SparkSession, base: str) -> DataFrame:
    return _checkout(spark, base).results


@query(
    "checkout_orders",
    _checkout_sql(f"""
    SELECT {q_md5_id('request_id')} AS id, user_id, cast(sum(unit_price * quantity) as decimal(28,2)) AS total_amount,
      'completed' AS status, cast(any_value(ts) as varchar) AS created_at
    FROM k_bought GROUP BY request_id, user_id"""),
)
def checkout_orders(spark: SparkSession, base: str) -> DataFrame:
    return as_text(_checkout(spark, base).orders, "created_at")


@query(
    "checkout_lines",
    _checkout_sql(f"""
    SELECT {q_md5_id("request_id || '|' || id")} AS id, {q_md5_id('request_id')} AS order_id, book_id, title, cover,
      unit_price, quantity, cast(unit_price * quantity as decimal(28,2)) AS line_total,
      cast(created_at as varchar) AS cart_created_at, id AS cart_item_id,
      cast(row_number() OVER (PARTITION BY request_id ORDER BY created_at NULLS LAST, id) as int) AS line_no
    FROM k_bought"""),
)
def checkout_lines(spark: SparkSession, base: str) -> DataFrame:
    return as_text(K.numbered_lines(_checkout(spark, base).lines), "cart_created_at")


@query(
    "checkout_remaining_cart",
    _checkout_sql(f"SELECT {_ALL_TEXT} FROM v_small_cart WHERE id NOT IN (SELECT id FROM k_bought)"),
)
def checkout_remaining_cart(spark: SparkSession, base: str) -> DataFrame:
    return as_text(_checkout(spark, base).cart, *_TIMES)
