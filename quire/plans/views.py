"""The store's tables as projections of the driver's test tables.

Each view is one list of (expression, alias) pairs that reads the same in Spark SQL
and in ANSI SQL, so both sides of a comparison start from one text.  The test tables
hold no blanks; the CASE rules put NULLs, blanks and odd values on fixed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BOOK_NO = "lpad(cast({} as string), 7, '0')"


def _book_id(column: str) -> str:
    return "'P' || " + _BOOK_NO.format(column)


_LINE_ID = (
    "cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' || "
    "cast(l_partkey as string) || '-' || cast(l_suppkey as string) || '-' || cast(cast(l_quantity as int) as string)"
)
_TS = "cast('2024-01-01 00:00:00' as timestamp)"
_EVENT_ID = "lpad(cast(event_id as string), 12, '0')"

BOOKS = [
    (_book_id("p_partkey"), "book_id"),
    ("p_name", "title"),
    ("case when p_partkey % 11 = 0 then null else 'Author ' || p_brand end", "author"),
    ("replace(p_name, ' ', ', ')", "genre"),
    ("'Size ' || cast(p_size as string) || ' ' || p_type", "description"),
    ("cast(p_retailprice as decimal(10,2))", "price"),
    (
        "case when p_partkey % 7 = 0 then null when p_partkey % 7 = 1 then '  ' "
        "when p_partkey % 13 = 0 then 'Special' else 'Vol ' || cast(p_size as string) end",
        "volume",
    ),
    (
        "case when p_partkey % 5 = 0 then null when p_partkey % 5 = 1 then '' "
        "when p_partkey % 5 = 2 then 'images/plain.jpg' "
        "else 'images/x_vol_' || cast(p_size as string) || '.jpg' end",
        "cover",
    ),
    ("p_type", "type"),
    ("p_brand", "publisher"),
    (
        "replace(p_name, ' ', ' ,') || case when p_partkey % 3 = 0 then ', , bestsellers ' else '' end",
        "keywords",
    ),
    ("cast(10 as int)", "stock"),
    (
        "case when p_partkey % 9 = 0 then 0 when p_partkey % 9 = 1 then null else 100 + p_size * 4 end",
        "page_count",
    ),
    (
        "case when p_partkey % 6 = 0 then null when p_partkey % 6 = 1 then ' ' "
        "else '2020-01-' || lpad(cast(1 + p_size % 28 as string), 2, '0') end",
        "release_date",
    ),
    (_TS, "created_at"),
]

USERS = [
    ("cast(c_custkey as string)", "id"),
    ("c_name", "name"),
    ("lower(replace(c_name, '#', '.')) || '@example.com'", "email"),
    (_TS, "created_at"),
    (_TS, "updated_at"),
]

ORDERS = [
    ("cast(o_orderkey as string)", "id"),
    ("cast(o_custkey as string)", "user_id"),
    ("cast(o_totalprice as decimal(10,2))", "total_amount"),
    ("case o_orderstatus when 'P' then 'pending' when 'O' then 'completed' else 'cancelled' end", "status"),
    ("cast(o_orderdate as timestamp)", "created_at"),
]

_UNIT = "cast(l_extendedprice as decimal(10,2))"
ITEMS = [
    (_LINE_ID, "id"),
    ("cast(l_orderkey as string)", "order_id"),
    (
        "case when l_linenumber = 6 then 'Title ' || cast(l_partkey as string) || '::' || "
        "cast(l_linenumber as string) when l_linenumber = 5 then 'Title::' else "
        + _book_id("l_partkey")
        + " end",
        "book_id",
    ),
    ("'Title ' || cast(l_partkey as string)", "title"),
    ("case when l_linenumber <= 3 then '' else 'images/c_' || cast(l_partkey as string) || '.jpg' end", "cover"),
    (_UNIT, "unit_price"),
    ("cast(l_quantity as int)", "quantity"),
    (
        f"cast({_UNIT} * cast(l_quantity as int) + case when l_returnflag = 'N' and l_linenumber = 4 "
        "then cast(0.01 as decimal(10,2)) else cast(0 as decimal(10,2)) end as decimal(10,2))",
        "line_total",
    ),
]

CART_FROM = "lineitem JOIN orders ON l_orderkey = o_orderkey"
CART = [
    (_LINE_ID, "id"),
    ("cast(o_custkey as string)", "user_id"),
    (_book_id("l_partkey % 100"), "book_id"),
    ("'Title ' || cast(l_partkey % 100 as string)", "title"),
    ("cast(l_linenumber as string)", "volume"),
    ("case when l_suppkey % 3 = 0 then '' else 'images/c_' || cast(l_partkey % 100 as string) || '.jpg' end", "cover"),
    (_UNIT, "unit_price"),
    ("cast(l_quantity as int)", "quantity"),
    ("cast(l_shipdate as timestamp)", "created_at"),
    ("cast(o_orderdate as timestamp)", "updated_at"),
]

# A cart with one row per (user, book) of ten books, whose ids commands can name.
SMALL_CART = [
    ("cast(o_custkey as string) || '-' || cast(l_partkey % 10 as string)", "id"),
    ("cast(o_custkey as string)", "user_id"),
    (_book_id("l_partkey % 10"), "book_id"),
    ("'Title ' || cast(l_partkey % 10 as string)", "title"),
    ("cast(l_partkey % 10 as string)", "volume"),
    ("'images/c_' || cast(l_partkey % 10 as string) || '.jpg'", "cover"),
    ("cast(max(l_extendedprice) as decimal(10,2))", "unit_price"),
    ("cast(count(*) as int)", "quantity"),
    ("cast(min(l_shipdate) as timestamp)", "created_at"),
    ("cast(max(l_shipdate) as timestamp)", "updated_at"),
]
SMALL_CART_GROUP = "o_custkey, l_partkey % 10"

FIXES = [
    ("p_name", "title"),
    ("'Vol ' || cast(p_size as string)", "volume"),
    ("'images/fix_' || cast(min(p_partkey) as string) || '.jpg'", "cover"),
    ("cast(100 + min(p_partkey) % 300 as int)", "page_count"),
    ("'2021-02-' || lpad(cast(1 + min(p_partkey) % 28 as string), 2, '0')", "release_date"),
]
FIXES_GROUP = "p_name, p_size"

EVENTS = [
    (_EVENT_ID, "event_id"),
    ("event_id", "event_no"),
    ("cast(ts as timestamp)", "ts"),
    ("cast(user_id as string)", "user_id"),
    ("event_type", "event_type"),
    ("value", "value"),
]

# Requests: an error event is a server error or, with a small value, a refused connection; otherwise a
# very small value is a missing page.
_STATUS = (
    "cast(case when event_type = 'error' and user_id % 3 > 0 and value < 10 then 0 "
    "when event_type = 'error' and user_id % 3 > 0 then 500 when value < 1 then 404 else 200 end as int)"
)
REQUESTS = [
    (_EVENT_ID, "request_id"),
    ("cast(ts as timestamp)", "ts"),
    ("cast(user_id as string)", "client_key"),
    ("event_type", "endpoint"),
    ("value", "duration_ms"),
    (_STATUS, "status"),
    (f"{_STATUS} = 0 or {_STATUS} >= 400", "failed"),
    ("event_type", "check_group"),
    ("case when user_id % 2 = 0 then 'status 200' else 'has body' end", "check_name"),
    ("value < 20 and event_type <> 'error'", "check_ok"),
]

_K = {"spark": "cast(get_json_object(props, '$.k') as int)", "sql": "cast(json_extract_string(props, '$.k') as int)"}


def _event_number(side: str) -> list[tuple[str, str]]:
    return EVENTS + [(_K[side], "k")]


# Cart commands over the event rows joined to the book k names (a missing book gives NULLs).
_QTY = (
    "case when event_no % 17 = 0 then 'abc' when event_no % 19 = 0 then '0' when event_no % 23 = 0 then ' 3 ' "
    "when event_no % 29 = 0 then '1.5' when event_no % 31 = 0 then '2e0' else cast(1 + k % 5 as string) end"
)
COMMANDS = [
    ("event_id", "cmd_id"),
    ("user_id", "user_id"),
    ("case event_type when 'error' then 'remove' when 'view' then 'set' else 'add' end", "op"),
    ("user_id || '-' || cast(k % 10 as string)", "cart_item_id"),
    (
        "case when event_type in ('view', 'error') then ' ' || " + _book_id("k % 10") + " "
        "when event_no % 37 = 0 then title || '::' || volume else null end",
        "book_id",
    ),
    (
        "case when event_no % 41 = 0 then ' ' when event_no % 43 = 0 then 'No such book' "
        "when event_no % 3 = 0 then upper(title) || ' ' else title end",
        "book_title",
    ),
    ("case when event_no % 2 = 0 then replace(volume, 'Vol ', '') else volume end", "volume"),
    (_QTY, "quantity"),
    ("ts", "ts"),
]
# Commands over the small cart's books: k % 10 names a title and volume of SMALL_BOOKS.
SMALL_COMMANDS = [
    ("event_id", "cmd_id"),
    ("user_id", "user_id"),
    ("case event_type when 'error' then 'remove' when 'view' then 'set' else 'add' end", "op"),
    ("case when event_no % 13 = 0 then 'x' else user_id end || '-' || cast(k % 10 as string)", "cart_item_id"),
    (_book_id("k % 10"), "book_id"),
    ("'Title ' || cast(k % 10 as string)", "book_title"),
    ("cast(k % 10 as string)", "volume"),
    (_QTY, "quantity"),
    ("ts", "ts"),
]
SMALL_BOOKS = [
    (_book_id("p_partkey"), "book_id"),
    ("'Title ' || cast(p_partkey as string)", "title"),
    ("cast(null as string)", "author"),
    ("cast(null as string)", "genre"),
    ("cast(null as string)", "description"),
    ("cast(p_retailprice as decimal(10,2))", "price"),
    ("'Vol ' || cast(p_partkey as string)", "volume"),
    ("'images/s_' || cast(p_size as string) || '.jpg'", "cover"),
]

USER_COMMANDS = [
    ("event_id", "cmd_id"),
    ("case when event_type = 'signup' then 'register' else 'update' end", "op"),
    ("case when event_no % 11 = 0 then 'nobody' else user_id end", "user_id"),
    (
        "case when event_no % 7 = 0 then '  ' when event_no % 5 = 0 then null when event_no % 3 = 0 "
        "then ' N' || cast(k as string) || ' ' else 'Name ' || cast(k as string) end",
        "name",
    ),
    (
        "case when event_no % 13 = 0 then '' when event_no % 4 = 0 then null when event_no % 9 = 0 "
        "then 'customer.' || lpad(cast(k as string), 9, '0') || '@example.com' when event_no % 10 = 0 "
        "then 'bad address' || cast(k as string) else ' fresh' || cast(k + event_no % 50 as string) || '@example.org' end",
        "email",
    ),
    ("ts", "ts"),
]

# Line commands made from the lines themselves.
LINE_COMMANDS_FROM = CART_FROM
LINE_COMMANDS = [
    ("'c' || " + _LINE_ID, "cmd_id"),
    ("case when l_suppkey % 10 = 0 then 'x' else cast(o_custkey as string) end", "user_id"),
    ("case when l_returnflag = 'R' then 'remove' else 'set' end", "op"),
    ("case when l_linenumber = 7 and l_suppkey % 7 = 0 then '  ' else ' ' || " + _LINE_ID + " end", "order_item_id"),
    ("case when l_suppkey % 9 = 0 then null else cast(l_orderkey as string) end", "order_id"),
    ("case when l_suppkey % 8 = 0 then '-1' else cast(1 + l_linenumber * 3 as string) end", "quantity"),
    ("cast(l_shipdate as timestamp)", "ts"),
]


def _select(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return df.selectExpr(*[f"{e} as `{a}`" for e, a in pairs])


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def books(spark: SparkSession, base: str) -> DataFrame:
    return _select(table(spark, base, "part"), BOOKS)


def small_books(spark: SparkSession, base: str) -> DataFrame:
    return _select(table(spark, base, "part"), SMALL_BOOKS)


def users(spark: SparkSession, base: str) -> DataFrame:
    return _select(table(spark, base, "customer"), USERS)


def orders(spark: SparkSession, base: str) -> DataFrame:
    return _select(table(spark, base, "orders"), ORDERS)


def items(spark: SparkSession, base: str) -> DataFrame:
    return _select(table(spark, base, "lineitem"), ITEMS)


def _lines_with_orders(spark: SparkSession, base: str) -> DataFrame:
    lines, heads = table(spark, base, "lineitem"), table(spark, base, "orders")
    return lines.join(heads, lines.l_orderkey == heads.o_orderkey)


def cart(spark: SparkSession, base: str) -> DataFrame:
    return _select(_lines_with_orders(spark, base), CART)


def small_cart(spark: SparkSession, base: str) -> DataFrame:
    rows = _lines_with_orders(spark, base).select("o_custkey", "l_partkey", "l_extendedprice", "l_shipdate")
    grouped = rows.groupBy("o_custkey", F.expr("l_partkey % 10").alias("k")).agg(
        F.max("l_extendedprice").alias("price"),
        F.count(F.lit(1)).alias("n"),
        F.min("l_shipdate").alias("first"),
        F.max("l_shipdate").alias("last"),
    )
    renamed = {
        "cast(max(l_extendedprice) as decimal(10,2))": "cast(price as decimal(10,2))",
        "cast(count(*) as int)": "cast(n as int)",
        "cast(min(l_shipdate) as timestamp)": "cast(first as timestamp)",
        "cast(max(l_shipdate) as timestamp)": "cast(last as timestamp)",
    }
    return _select(grouped, [(renamed.get(e, e).replace("l_partkey % 10", "k"), a) for e, a in SMALL_CART])


def fixes(spark: SparkSession, base: str) -> DataFrame:
    least = table(spark, base, "part").groupBy("p_name", "p_size").agg(F.min("p_partkey").alias("least"))
    return _select(least, [(e.replace("min(p_partkey)", "least"), a) for e, a in FIXES])


def events(spark: SparkSession, base: str) -> DataFrame:
    return _select(table(spark, base, "events"), _event_number("spark"))


def requests(spark: SparkSession, base: str) -> DataFrame:
    return _select(table(spark, base, "events"), REQUESTS)


def commands(spark: SparkSession, base: str) -> DataFrame:
    """Cart commands (events other than purchases) on books by title and volume."""
    titled = books(spark, base).select("title", F.col("volume"), F.expr("cast(substr(book_id, 2) as int)").alias("no"))
    asked = events(spark, base).filter("event_type <> 'purchase'")
    return _select(asked.join(titled, asked.k == titled.no, "left"), COMMANDS)


def small_commands(spark: SparkSession, base: str) -> DataFrame:
    return _select(events(spark, base).filter("event_type <> 'purchase'"), SMALL_COMMANDS)


def user_commands(spark: SparkSession, base: str) -> DataFrame:
    return _select(events(spark, base), USER_COMMANDS)


def line_commands(spark: SparkSession, base: str) -> DataFrame:
    return _select(_lines_with_orders(spark, base), LINE_COMMANDS)


def checkout_requests(spark: SparkSession, base: str) -> DataFrame:
    """A purchase asks for two neighbouring rows of the small cart; some add a row that
    is not theirs, some ask for nothing."""
    first, second = "user_id || '-' || cast(k % 10 as string)", "user_id || '-' || cast((k + 1) % 10 as string)"
    ids = (
        f"case when event_no % 29 = 0 then array(' ') when event_no % 13 = 0 then array({first}, {second}, 'x-1') "
        f"when event_no % 7 = 0 then array(' ' || {first}, {second}, {first}, null) else array({first}, {second}) end"
    )
    bought = events(spark, base).filter("event_type = 'purchase'")
    return bought.selectExpr("event_id as request_id", "user_id", f"{ids} as cart_item_ids", "ts", "k", "event_no")


def _sql(pairs: list[tuple[str, str]], source: str, tail: str = "") -> str:
    columns = ", ".join(f"{e} AS {a}" for e, a in pairs)
    return f"SELECT {columns} FROM {source}{tail}"


_PURCHASE_NEEDS = (
    "SELECT event_id AS request_id, user_id, ts, k, event_no, "
    "event_no % 29 = 0 AS is_empty, event_no % 13 = 0 AS foreign_row "
    "FROM v_events WHERE event_type = 'purchase'"
)

VIEWS = {
    "v_books": _sql(BOOKS, "part"),
    "v_small_books": _sql(SMALL_BOOKS, "part"),
    "v_users": _sql(USERS, "customer"),
    "v_orders": _sql(ORDERS, "orders"),
    "v_items": _sql(ITEMS, "lineitem"),
    "v_cart": _sql(CART, CART_FROM),
    "v_small_cart": _sql(SMALL_CART, CART_FROM, f" GROUP BY {SMALL_CART_GROUP}"),
    "v_fixes": _sql(FIXES, "part", f" GROUP BY {FIXES_GROUP}"),
    "v_events": _sql(_event_number("sql"), "events"),
    "v_requests": _sql(REQUESTS, "events"),
    "v_commands": _sql(
        COMMANDS,
        "(SELECT e.*, b.title, b.volume FROM v_events e LEFT JOIN v_books b "
        "ON e.k = cast(substr(b.book_id, 2) as int) WHERE e.event_type <> 'purchase')",
    ),
    "v_small_commands": _sql(SMALL_COMMANDS, "v_events", " WHERE event_type <> 'purchase'"),
    "v_user_commands": _sql(USER_COMMANDS, "v_events"),
    "v_line_commands": _sql(LINE_COMMANDS, LINE_COMMANDS_FROM),
    "v_purchases": _PURCHASE_NEEDS,
}
_NEEDS = {
    "v_commands": ("v_events", "v_books"),
    "v_small_commands": ("v_events",),
    "v_user_commands": ("v_events",),
    "v_purchases": ("v_events",),
}


def with_views(names: str, body: str) -> str:
    """Prefix ``body`` (a SELECT, or further CTEs starting with a name) with views."""
    wanted: list[str] = []
    for name in names.split():
        for need in (*_NEEDS.get(name, ()), name):
            if need not in wanted:
                wanted.append(need)
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    joiner = " " if body.lstrip().upper().startswith("SELECT") else ", "
    return f"WITH {ctes}{joiner}{body.strip()}"
