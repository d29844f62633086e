"""Catalog, search, repair and scalar-rule queries."""

from __future__ import annotations

import functools
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import exprs as X
from quire.operators import cart as CART
from quire.operators import catalog as C
from quire.operators import search as S
from quire.operators.skew import written
from quire.plans import views as V
from quire.plans.registry import (
    as_text, q_blank, q_list, q_quantity, q_text, q_trim, q_volume_number, query,
)
from quire.plans.views import with_views
from quire.sources import tables as T

LOW, HIGH = Decimal("900.00"), Decimal("901.50")

_TITLES = f"""
c_titles AS (
  SELECT title, author, {q_list('genre')} AS genre, type, publisher, {q_list('keywords')} AS keywords,
         price, description
  FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY volume ASC NULLS LAST, book_id) AS rn
        FROM v_books) WHERE rn = 1)
"""
_VOLUMES = f"""
c_volumes AS (
  SELECT title, volume, book_id, {q_volume_number('volume')} AS volume_number, cover, page_count, release_date
  FROM v_books)
"""


def _titles_sql(body: str, views: str = "v_books") -> str:
    return with_views(views, f"{_TITLES.strip()}, {_VOLUMES.strip()} {body.strip()}")




def _volume_text(v):
    return F.concat_ws(
        "/",
        F.coalesce(v["volumeNumber"].cast("long").cast("string"), F.lit("-")),
        F.coalesce(v["cover"], F.lit("-")),
        F.coalesce(v["page_count"].cast("string"), F.lit("-")),
        F.coalesce(v["release_date"], F.lit("-")),
    )


@query(
    "catalog",
    _titles_sql("""
    SELECT t.title, t.author, array_to_string(t.genre, ', ') AS genre, t.type, t.publisher,
           array_to_string(t.keywords, ', ') AS keywords, t.price, t.description, cast(0 as int) AS section,
           string_agg(coalesce(cast(cast(v.volume_number as bigint) as varchar), '-') || '/' || coalesce(v.cover, '-')
             || '/' || coalesce(cast(v.page_count as varchar), '-') || '/' || coalesce(v.release_date, '-'),
             ';' ORDER BY v.volume ASC NULLS LAST, v.book_id) AS volumes
    FROM c_titles t JOIN c_volumes v USING (title)
    GROUP BY ALL"""),
)
def catalog(spark: SparkSession, base: str) -> DataFrame:
    docs = C.catalog(V.books(spark, base))
    return (
        docs.withColumns(
            {
                "genre": F.array_join("genre", ", "),
                "keywords": F.array_join("keywords", ", "),
                "volumes": F.array_join(F.transform("volumes", _volume_text), ";"),
            }
        )
        .orderBy("title", "section")
    )


@query(
    "catalog_sections",
    with_views("v_books", """
    c_placed AS (SELECT title, book_id, volume, (row_number() OVER (PARTITION BY title ORDER BY volume ASC NULLS LAST, book_id) - 1) // 2 AS section
      FROM v_books WHERE title IS NOT NULL)
    SELECT title, cast(section as int) AS section, count(*) AS n FROM c_placed GROUP BY 1, 2"""),
)
def catalog_sections(spark: SparkSession, base: str) -> DataFrame:
    docs = C.catalog(V.books(spark, base), section_length=2)
    return docs.select("title", "section", F.size("volumes").cast("long").alias("n"))


@query(
    "catalog_json",
    _titles_sql("""
    SELECT cast(to_json({'title': t.title, 'author': t.author, 'genre': t.genre, 'type': t.type,
      'publisher': t.publisher, 'keywords': t.keywords, 'price': cast(t.price as varchar), 'description': t.description,
      'volumes': list({'volumeNumber': v.volume_number, 'cover': v.cover, 'page_count': v.page_count,
                       'release_date': v.release_date} ORDER BY v.volume ASC NULLS LAST, v.book_id), 'section': 0}) as varchar)
      AS document
    FROM c_titles t JOIN c_volumes v USING (title)
    GROUP BY t.title, t.author, t.genre, t.type, t.publisher, t.keywords, t.price, t.description"""),
)
def catalog_json(spark: SparkSession, base: str) -> DataFrame:
    docs = C.catalog(V.books(spark, base))
    return T.as_json(docs.withColumn("price", F.col("price").cast("string")))


@query(
    "catalog_legacy_scan",
    with_views("v_books", """
    SELECT cast(null as varchar) AS book_id, title, author, genre, description, price, volume, cover, type,
           publisher, cast(null as varchar) AS keywords, cast(null as int) AS page_count,
           cast(null as varchar) AS release_date FROM v_books"""),
)
def catalog_legacy_scan(spark: SparkSession, base: str) -> DataFrame:
    return C.catalog_scan(V.books(spark, base).drop("page_count"))


_CARD_SQL = """
    SELECT v.title, t.author, t.price, v.volume_number, v.cover,
           cast(t.price - 0.01 as decimal(10,2)) AS display_price, v.volume, v.book_id
    FROM c_volumes v JOIN c_titles t USING (title)"""

_MATCH = {
    "text": "(contains(lower(t.title), 'or') OR coalesce(contains(lower(t.author), 'or'), false) "
    "OR coalesce(contains(lower(t.type), 'or'), false) OR len([g for g in t.genre if contains(lower(g), 'or')]) > 0 "
    "OR len([g for g in t.keywords if contains(lower(g), 'or')]) > 0)",
    "type": "lower(t.type) = 'economy'",
    "publisher": "t.publisher IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#10', 'Brand#17')",
    "genre": "(list_contains(t.genre, 'red') OR list_contains(t.genre, 'bolt'))",
    "price": "t.price >= 900 AND t.price <= 901.5",
}
_FACETS: dict[str, dict] = {
    "text": {"query": "OR"},
    "type": {"kind": "Economy"},
    "publisher": {"publishers": ["Brand#1", "Brand#2", "Brand#3", "Brand#10", "Brand#17"]},
    "genre": {"genres": ["red", "bolt", ""]},
    "price": {"min_price": LOW, "max_price": HIGH},
}
_OPEN = {"min_price": None, "max_price": None}


def _facet_query(name: str) -> None:
    facets = {**_OPEN, **_FACETS[name]}

    @query(f"search_{name}", _titles_sql(f"{_CARD_SQL} WHERE {_MATCH[name]}"))
    def run(spark: SparkSession, base: str) -> DataFrame:
        return S.search_cards(V.books(spark, base), **facets)


for _name in _FACETS:
    _facet_query(_name)

_WIDE = {"query": "e", "genres": ["red", "blue", "small", "bolt", "ring"], "min_price": Decimal("900"), "max_price": HIGH}
_WIDE_MATCH = (
    _MATCH["text"].replace("'or'", "'e'")
    + " AND len(list_intersect(t.genre, ['red', 'blue', 'small', 'bolt', 'ring'])) > 0 AND "
    + _MATCH["price"]
)


@query("search_faceted", _titles_sql(f"{_CARD_SQL} WHERE {_WIDE_MATCH}"))
def search_faceted(spark: SparkSession, base: str) -> DataFrame:
    return S.search_cards(V.books(spark, base), **_WIDE)


@query("product_cards", _titles_sql(_CARD_SQL))
def product_cards(spark: SparkSession, base: str) -> DataFrame:
    books = V.books(spark, base)
    return S.cards(books, S.titles(books))


_SORT_SQL = {
    "title-asc": "title ASC",
    "title-desc": "title DESC",
    "price-asc": "price ASC",
    "price-desc": "price DESC",
}


def _sort_query(sort: str, order: str) -> None:
    name = f"search_sorted_{sort.replace('-', '_')}"
    sql = f"SELECT * FROM ({_CARD_SQL}) ORDER BY {order}, title, volume ASC NULLS LAST, book_id"

    @query(name, _titles_sql(sql))
    def run(spark: SparkSession, base: str) -> DataFrame:
        return S.sort_cards(S.search_cards(V.books(spark, base), **_OPEN), sort)


for _sort, _order in _SORT_SQL.items():
    _sort_query(_sort, _order)


@query(
    "search_page",
    _titles_sql(
        f"SELECT * FROM ({_CARD_SQL}) ORDER BY price DESC, title, volume ASC NULLS LAST, book_id LIMIT 8 OFFSET 16"
    ),
)
def search_page(spark: SparkSession, base: str) -> DataFrame:
    return S.page(S.search_cards(V.books(spark, base), **_OPEN), "price-desc", 3)


def _placed_sql(sort: str) -> str:
    order = f"{_SORT_SQL[sort]}, title, volume ASC NULLS LAST, book_id"
    return f"SELECT *, row_number() OVER (ORDER BY {order}) AS position, count(*) OVER () AS n FROM ({_CARD_SQL})"


_POSITIONS = " UNION ALL ".join(f"SELECT '{sort}' AS sort, position, book_id FROM ({_placed_sql(sort)})" for sort in _SORT_SQL)


@query("search_positions", _titles_sql(f"SELECT * FROM ({_POSITIONS})"))
def search_positions(spark: SparkSession, base: str) -> DataFrame:
    """The place of every card in each of the four orders."""
    found = written(S.search_cards(V.books(spark, base), **_OPEN))
    placed = [S.positions(S.page_index(found, sort)).select(F.lit(sort).alias("sort"), "position", "book_id") for sort in _SORT_SQL]
    return functools.reduce(DataFrame.unionByName, placed)


@query(
    "search_deep_page",
    _titles_sql(f"SELECT * EXCLUDE (n) FROM ({_placed_sql('price-desc')}) WHERE position > n // 8 * 8 - 8 AND position <= n // 8 * 8"),
)
def search_deep_page(spark: SparkSession, base: str) -> DataFrame:
    """The last full page."""
    index = S.page_index(S.search_cards(V.books(spark, base), **_OPEN), "price-desc")
    return S.page_at(index, index.parts.agg(F.sum("rows")).first()[0] // 8)


@query(
    "search_page_counts",
    _titles_sql(f"""
    SELECT count(*) AS total, cast(ceil(count(*) / 8.0) as bigint) AS pages, least(24, count(*)) AS shown
    FROM ({_CARD_SQL} WHERE {_WIDE_MATCH})"""),
)
def search_page_counts(spark: SparkSession, base: str) -> DataFrame:
    return S.page_counts(S.search_cards(V.books(spark, base), **_WIDE), 3)


@query(
    "featured_titles",
    _titles_sql("""
    SELECT title, author, price, array_to_string(keywords, ', ') AS keywords FROM c_titles
    WHERE len([k for k in keywords if lower(k) = 'bestsellers']) > 0 ORDER BY title LIMIT 6"""),
)
def featured_titles(spark: SparkSession, base: str) -> DataFrame:
    found = S.featured(V.books(spark, base))
    return found.select("title", "author", "price", F.array_join("keywords", ", ").alias("keywords"))


@query(
    "book_detail",
    _titles_sql(f"""
    SELECT lookup_id, unnest(['Title', 'Author', 'Publisher', 'Genre', 'Keywords', 'Release date', 'Page count']) AS label,
      unnest([title, author, publisher, array_to_string(genre, ', '), array_to_string(keywords, ', '), release_date,
              cast(page_count as varchar)]) AS value
    FROM (
      SELECT l.lookup_id, t.*, f.release_date, f.page_count
      FROM (SELECT book_id AS lookup_id, title, {q_text("substr(cover, 14, length(cover) - 17)")} AS n FROM v_books
            WHERE contains(cover, '_vol_')) l
      JOIN (SELECT title, volume_number, release_date, page_count,
              row_number() OVER (PARTITION BY title, volume_number ORDER BY volume ASC NULLS LAST, book_id) AS rn
            FROM c_volumes WHERE volume_number IS NOT NULL) f
        ON f.title = l.title AND f.volume_number = cast(l.n as double) AND f.rn = 1
      JOIN c_titles t ON t.title = l.title)"""),
)
def book_detail(spark: SparkSession, base: str) -> DataFrame:
    books = V.books(spark, base)
    lookups = books.filter(F.contains("cover", F.lit("_vol_"))).select(
        F.col("book_id").alias("lookup_id"), "title", F.regexp_extract("cover", "_vol_([0-9]+)", 1).alias("volume")
    )
    return S.book_details(books, lookups)


@query(
    "book_links",
    _titles_sql("""
    SELECT v.title, '/book/' || replace(v.title, ' ', '%20') || '/' ||
      coalesce(cast(cast(v.volume_number as bigint) as varchar), 'null') AS link, v.title AS title_back, v.book_id
    FROM c_volumes v"""),
)
def book_links(spark: SparkSession, base: str) -> DataFrame:
    return S.book_links(C.volumes(V.books(spark, base))).select("title", "link", "title_back", "book_id")


_RESOLVE_VIEWS = "v_commands"
RESOLVE_SQL = f"""
a_cmds AS (
  SELECT *, {q_text('book_title')} AS bt, {q_text('volume')} AS bv, {q_text('book_id')} AS bid,
         {q_quantity('quantity')} AS qty
  FROM v_commands WHERE op = 'add'),
a_asked AS (
  SELECT *, CASE WHEN contains(bid, '::') THEN {q_text("split_part(bid, '::', 1)")} ELSE bt END AS want_title,
    'Vol ' || regexp_replace(CASE WHEN contains(bid, '::') THEN coalesce(bv, {q_text("split_part(bid, '::', 2)")})
      ELSE bv END, 'Vol ', '') AS want_volume
  FROM a_cmds),
a_cand AS (
  SELECT lower(title) AS tl, volume AS cv, min(book_id) AS found_id FROM v_books WHERE volume IS NOT NULL GROUP BY 1, 2),
a_resolved AS (
  SELECT a.*, b.book_id AS r_book_id, b.title AS r_title, regexp_replace(b.volume, 'Vol ', '') AS r_volume,
    CASE WHEN b.book_id IS NOT NULL THEN coalesce({q_text('b.cover')}, '') END AS r_cover, b.price AS r_price,
    CASE WHEN a.bt IS NULL OR a.bv IS NULL OR a.qty IS NULL THEN 'invalid' WHEN b.book_id IS NULL THEN 'not_found'
      ELSE 'ok' END AS status
  FROM a_asked a LEFT JOIN a_cand c ON c.tl = lower(a.want_title) AND c.cv = a.want_volume
  LEFT JOIN v_books b ON b.book_id = c.found_id)
"""


@query(
    "resolve_catalog_items",
    with_views("v_commands v_books", RESOLVE_SQL.strip() + """
    SELECT cmd_id, status, r_book_id AS book_id, r_title AS title, r_volume AS volume, r_cover AS cover,
           r_price AS price FROM a_resolved"""),
)
def resolve_catalog_items(spark: SparkSession, base: str) -> DataFrame:
    adds = V.commands(spark, base).filter("op = 'add'")
    resolved = CART.resolve_adds(adds, V.books(spark, base))
    return resolved.select("cmd_id", "status", "item.*")


# Repairs -----------------------------------------------------------------------------

_LACKS = (
    f"({q_blank('cover')} OR page_count IS NULL OR page_count = 0 OR {q_blank('release_date')})"
)
_REPAIRED = (
    f"CASE WHEN {q_blank('volume')} THEN 'Vol ' || coalesce(nullif(regexp_extract(cover, '_vol_([0-9]+)', 1), ''), "
    "nullif(ltrim(regexp_extract(book_id, '([0-9]+)$', 1), '0'), ''), '1') ELSE volume END"
)


def _backfilled(source: str) -> str:
    use = f"{_LACKS.replace('cover', 'b.cover').replace('page_count', 'b.page_count').replace('release_date', 'b.release_date')} AND f.title IS NOT NULL"
    return (
        "SELECT b.book_id, b.title, b.volume, "
        + ", ".join(
            f"CASE WHEN {use} THEN f.{c} ELSE b.{c} END AS {c}" for c in ("cover", "page_count", "release_date")
        )
        + f" FROM {source} b LEFT JOIN v_fixes f ON f.title = b.title AND f.volume = b.volume"
    )


_BACKFILL_COLUMNS = ("book_id", "title", "volume", "cover", "page_count", "release_date")


@query(
    "books_missing_fields",
    with_views("v_books", f"SELECT book_id, title, cover, page_count, release_date FROM v_books WHERE {_LACKS}"),
)
def books_missing_fields(spark: SparkSession, base: str) -> DataFrame:
    return C.books_missing_fields(V.books(spark, base)).select(
        "book_id", "title", "cover", "page_count", "release_date"
    )


@query("volume_repair", with_views("v_books", f"SELECT book_id, {_REPAIRED} AS volume FROM v_books"))
def volume_repair(spark: SparkSession, base: str) -> DataFrame:
    return C.repair_volumes(V.books(spark, base)).select("book_id", "volume")


@query("books_backfill", with_views("v_books v_fixes", _backfilled("v_books")))
def books_backfill(spark: SparkSession, base: str) -> DataFrame:
    return C.backfill_books(V.books(spark, base), V.fixes(spark, base)).select(*_BACKFILL_COLUMNS)


_ITEM_COVER = (
    "SELECT i.id, i.order_id, i.book_id, CASE WHEN i.cover = '' AND trim(coalesce(b.cover, '')) <> '' "
    "THEN b.cover ELSE i.cover END AS cover FROM v_items i LEFT JOIN {} b ON b.book_id = i.book_id"
)


@query("order_item_cover_backfill", with_views("v_items v_books", _ITEM_COVER.format("v_books")))
def order_item_cover_backfill(spark: SparkSession, base: str) -> DataFrame:
    done = C.backfill_item_covers(V.items(spark, base), V.books(spark, base))
    return done.select("id", "order_id", "book_id", "cover")


@query(
    "migrate_books",
    with_views(
        "v_books v_fixes v_items",
        f"m_repaired AS (SELECT * REPLACE ({_REPAIRED} AS volume) FROM v_books), "
        f"m_books AS ({_backfilled('m_repaired')}) "
        "SELECT 'book' AS kind, book_id AS row_key, volume, cover, page_count, release_date FROM m_books "
        "UNION ALL SELECT 'line', id, null, cover, null, null FROM "
        f"({_ITEM_COVER.format('m_books')})",
    ),
)
def migrate_books(spark: SparkSession, base: str) -> DataFrame:
    done = C.migrate(
        {
            "books": V.books(spark, base),
            "cart_items": V.cart(spark, base),
            "order_items": V.items(spark, base),
        },
        V.fixes(spark, base),
    )
    changed = done["books"].select(
        F.lit("book").alias("kind"), F.col("book_id").alias("row_key"), "volume", "cover", "page_count", "release_date"
    )
    lines = done["order_items"].select(F.lit("line").alias("kind"), F.col("id").alias("row_key"), "cover")
    return changed.unionByName(lines, allowMissingColumns=True)


@query(
    "conform_schema",
    "SELECT cast(p_partkey as varchar) AS book_id, p_name AS title, cast(null as varchar) AS volume, "
    "cast(null as varchar) AS cover, cast(null as varchar) AS keywords, cast(0 as int) AS page_count, "
    "cast(null as varchar) AS release_date FROM part",
)
def conform_schema(spark: SparkSession, base: str) -> DataFrame:
    raw = V.table(spark, base, "part").selectExpr("p_partkey as book_id", "p_name as title")
    return T.conform(raw, "books", ("volume", "cover", "keywords", "page_count", "release_date"))


@query(
    "apply_defaults",
    with_views("v_books", """
    SELECT book_id, coalesce(page_count, 0) AS page_count, stock, cover FROM v_books"""),
)
def apply_defaults(spark: SparkSession, base: str) -> DataFrame:
    return T.apply_defaults(V.books(spark, base), "books").select("book_id", "page_count", "stock", "cover")


# Scalar rules, each over a whole table -------------------------------------------------

_ODD = {
    "spark": "case when event_id % 7 = 0 then concat('\\t ', event_type, ' \\u00a0') when event_id % 11 = 0 then ' \\n ' "
    "when event_id % 13 = 0 then null else concat(' ', event_type, ' ', cast(event_id as string)) end",
    "sql": "case when event_id % 7 = 0 then chr(9) || ' ' || event_type || ' ' || chr(160) when event_id % 11 = 0 "
    "then ' ' || chr(10) || ' ' when event_id % 13 = 0 then null else ' ' || event_type || ' ' || cast(event_id as varchar) end",
}


@query(
    "fn_normalize_text",
    f"SELECT event_id, {q_text('raw')} AS normalized FROM (SELECT event_id, {_ODD['sql']} AS raw FROM events)",
)
def fn_normalize_text(spark: SparkSession, base: str) -> DataFrame:
    raw = V.table(spark, base, "events").select("event_id", F.expr(_ODD["spark"]).alias("raw"))
    return raw.select("event_id", X.text_or_null("raw").alias("normalized"))


@query(
    "fn_quantity",
    with_views("v_commands", f"SELECT cmd_id, quantity, {q_quantity('quantity')} AS parsed FROM v_commands"),
)
def fn_quantity(spark: SparkSession, base: str) -> DataFrame:
    return V.commands(spark, base).select("cmd_id", "quantity", X.quantity_or_null("quantity").alias("parsed"))


@query(
    "fn_to_list",
    with_views("v_books", f"SELECT book_id, len({q_list('keywords')}) AS n, array_to_string({q_list('keywords')}, '|') AS parts FROM v_books"),
)
def fn_to_list(spark: SparkSession, base: str) -> DataFrame:
    parts = X.to_list("keywords")
    return V.books(spark, base).select(
        "book_id", F.size(parts).cast("long").alias("n"), F.array_join(parts, "|").alias("parts")
    )


@query(
    "fn_volume_number",
    with_views("v_books", f"SELECT book_id, {q_volume_number('volume')} AS volume_number FROM v_books"),
)
def fn_volume_number(spark: SparkSession, base: str) -> DataFrame:
    return V.books(spark, base).select("book_id", X.volume_number("volume").alias("volume_number"))


@query(
    "fn_book_volume",
    with_views("v_items", "SELECT id, nullif(split_part(book_id, '::', 2), '') AS volume FROM v_items"),
)
def fn_book_volume(spark: SparkSession, base: str) -> DataFrame:
    return V.items(spark, base).select("id", X.book_volume("book_id").alias("volume"))


@query(
    "fn_composite_id",
    with_views("v_commands", f"""
    SELECT cmd_id, CASE WHEN contains({q_text('book_id')}, '::') THEN {q_text("split_part(book_id, '::', 1)")}
        ELSE {q_text('book_title')} END AS title,
      CASE WHEN contains({q_text('book_id')}, '::') THEN coalesce({q_text('volume')}, {q_text("split_part(book_id, '::', 2)")})
        ELSE {q_text('volume')} END AS volume
    FROM v_commands"""),
)
def fn_composite_id(spark: SparkSession, base: str) -> DataFrame:
    asked = X.requested_book("book_id", "book_title", "volume")
    return V.commands(spark, base).select("cmd_id", asked.alias("a")).select("cmd_id", "a.*")


@query(
    "fn_cart_ids",
    with_views("v_purchases", """
    SELECT request_id, CASE WHEN is_empty THEN '' ELSE user_id || '-' || cast(k % 10 as varchar) || ',' || user_id || '-' ||
      cast((k + 1) % 10 as varchar) || CASE WHEN foreign_row THEN ',x-1' ELSE '' END END AS ids FROM v_purchases"""),
)
def fn_cart_ids(spark: SparkSession, base: str) -> DataFrame:
    return V.checkout_requests(spark, base).select(
        "request_id", F.array_join(X.distinct_ids("cart_item_ids"), ",").alias("ids")
    )


@query(
    "fn_cover_volume",
    with_views("v_books", """
    SELECT book_id, 'Vol ' || coalesce(nullif(regexp_extract(cover, '_vol_([0-9]+)', 1), ''),
      nullif(ltrim(regexp_extract(book_id, '([0-9]+)$', 1), '0'), ''), '1') AS volume FROM v_books"""),
)
def fn_cover_volume(spark: SparkSession, base: str) -> DataFrame:
    return V.books(spark, base).select("book_id", X.repaired_volume("cover", "book_id").alias("volume"))


@query(
    "fn_money_text",
    with_views("v_items", """
    SELECT id, cast(line_total as varchar) AS total_text,
      cast(cast(round(line_total * cast(0.125 as decimal(4,3)), 2) as decimal(28,2)) as varchar) AS eighth_text
    FROM v_items"""),
)
def fn_money_text(spark: SparkSession, base: str) -> DataFrame:
    """Totals, and eighths of them, of which many end in half a cent."""
    total, eighth = F.col("line_total"), F.lit(Decimal("0.125"))
    return V.items(spark, base).select("id", X.money_text(total).alias("total_text"), X.money_text(total * eighth).alias("eighth_text"))
