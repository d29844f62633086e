"""Catalog: tolerant scan, nested documents, lookup, repairs and backfills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import exprs as X
from quire.operators.skew import SECTION, nest, written
from quire.sources.tables import add_missing, conform

# The column sets a catalog read falls back through, in order.
_BASE = ("title", "author", "genre", "description", "price")
_TAIL = ("type", "publisher")
PROJECTIONS = (
    ("book_id", *_BASE, "volume", "cover", *_TAIL, "keywords", "page_count", "release_date"),
    (*_BASE, "volume", "cover", *_TAIL, "keywords", "page_count", "release_date"),
    (*_BASE, "volume", "cover", *_TAIL),
    (*_BASE, "volume", *_TAIL),
    (*_BASE, "cover", *_TAIL),
    (*_BASE, *_TAIL),
)
_OPTIONAL = {
    "book_id": "string",
    "volume": "string",
    "cover": "string",
    "keywords": "string",
    "page_count": "int",
    "release_date": "string",
}
ATTRIBUTES = ("author", "genre", "type", "publisher", "keywords", "price", "description")
BACKFILLED = ("cover", "page_count", "release_date")


def catalog_scan(books: DataFrame) -> DataFrame:
    """The first projection whose columns all exist; what it lacks comes as NULL."""
    present = set(books.columns)
    for columns in PROJECTIONS:
        if present.issuperset(columns):
            return add_missing(books.select(*columns), _OPTIONAL).select(*PROJECTIONS[0])
    lacking = sorted(set(PROJECTIONS[-1]) - present)
    raise ValueError(f"catalog columns missing: {', '.join(lacking)}")


def volume_order(numeric: bool = False) -> list[Column]:
    """Order of volumes within a title: text order with blanks last, or by number."""
    by_number = [X.volume_number("volume").isNull(), X.volume_number("volume")] if numeric else []
    return by_number + [
        F.col("volume").isNull(),
        F.col("volume"),
        F.col("book_id").isNull(),
        F.col("book_id"),
    ]


def _list(df: DataFrame, name: str) -> Column:
    return X.to_list(name, df.schema[name].dataType.typeName() == "array")


def titles(books: DataFrame) -> DataFrame:
    """One row per title with the attributes of its first volume."""
    rows = catalog_scan(books)
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(volume_order())])
    first = rows.groupBy("title").agg(F.min_by(F.struct(*ATTRIBUTES), rank).alias("a")).select("title", "a.*")
    return first.withColumns({"genre": _list(first, "genre"), "keywords": _list(first, "keywords")})


def volumes(books: DataFrame) -> DataFrame:
    """One row per book: title, volume fields and the keys that order them."""
    return catalog_scan(books).select(
        "title",
        "volume",
        "book_id",
        X.volume_number("volume").alias("volume_number"),
        "cover",
        "page_count",
        "release_date",
    )


def catalog(books: DataFrame, numeric_order: bool = False, section_length: int = SECTION) -> DataFrame:
    """Nested documents: title attributes with the array ``volumes``, a row for each
    ``section_length`` volumes of a title.

    Sort the result by ``title, section`` for the catalog's order.
    """
    fields = ("volume_number", *BACKFILLED)

    def item(x: Column) -> Column:
        return F.struct(x["volume_number"].alias("volumeNumber"), *[x[c].alias(c) for c in BACKFILLED])

    order = volume_order(numeric_order)
    nested = nest(volumes(books), ["title"], order, fields, item, "volumes", section_length)
    return nested.join(written(titles(books)), "title").select("title", *ATTRIBUTES, "volumes", "section")


def candidates(books: DataFrame) -> DataFrame:
    """One book per (lower-case title, volume): the one with the least id."""
    picked = F.struct("book_id", "title", "volume", "cover", F.col("price").cast(X.MONEY).alias("price"))
    return (
        books.filter(F.col("volume").isNotNull() & F.col("title").isNotNull())
        .groupBy(F.lower("title").alias("_title"), F.col("volume").alias("_volume"))
        .agg(F.min_by(picked, F.struct(F.col("book_id").isNull(), F.col("book_id"))).alias("found"))
    )


def resolve(commands: DataFrame, books: DataFrame) -> DataFrame:
    """Commands (book_id, book_title, volume) with the book they mean in the struct
    ``item`` (book_id, title, volume, cover, price), NULL when there is none."""
    asked = commands.withColumn("_asked", X.requested_book("book_id", "book_title", "volume")).withColumns(
        {"_title": F.lower("_asked.title"), "_volume": X.canonical_volume("_asked.volume")}
    )
    joined = asked.join(written(candidates(books)), ["_title", "_volume"], "left")
    item = F.struct(
        X.text_or_null("found.book_id").alias("book_id"),
        F.col("found.title").alias("title"),
        X.strip_volume_prefix("found.volume").alias("volume"),
        F.coalesce(X.text_or_null("found.cover"), F.lit("")).alias("cover"),
        F.col("found.price").alias("price"),
    )
    return joined.withColumn("item", F.when(X.text_or_null("found.book_id").isNotNull(), item)).drop(
        "_asked", "_title", "_volume", "found"
    )


def repair_volumes(books: DataFrame) -> DataFrame:
    """Fill blank volumes from the cover name or the id."""
    repaired = F.when(X.is_blank("volume"), X.repaired_volume("cover", "book_id")).otherwise(F.col("volume"))
    return books.withColumn("volume", repaired)


def lacks_fields() -> Column:
    """Cover, page count or release date is missing."""
    pages = F.col("page_count")
    return X.is_blank("cover") | pages.isNull() | (pages == 0) | X.is_blank("release_date")


def books_missing_fields(books: DataFrame) -> DataFrame:
    return books.filter(lacks_fields())


def backfill_books(books: DataFrame, fixes: DataFrame) -> DataFrame:
    """Where anything is missing and (title, volume) is listed, take all three
    columns from the list.  A key listed twice with different values is left alone: see
    ``conflicting_fixes``."""
    listed = (
        fixes.filter(F.col("title").isNotNull() & F.col("volume").isNotNull())
        .groupBy("title", "volume")
        .agg(F.min(F.struct(*BACKFILLED)).alias("_fix"), F.max(F.struct(*BACKFILLED)).alias("_other"))
        .filter(F.col("_fix") == F.col("_other"))
        .drop("_other")
    )
    joined = books.join(written(listed), ["title", "volume"], "left")
    use = lacks_fields() & F.col("_fix").isNotNull()
    filled = {c: F.when(use, F.col(f"_fix.{c}")).otherwise(F.col(c)) for c in BACKFILLED}
    return joined.withColumns(filled).select(*books.columns)


def conflicting_fixes(fixes: DataFrame) -> DataFrame:
    """Keys listed with different values, with the number of these; no book takes any of them."""
    return (
        fixes.filter(F.col("title").isNotNull() & F.col("volume").isNotNull())
        .groupBy("title", "volume")
        .agg(F.count_distinct(F.struct(*BACKFILLED)).alias("fixes"))
        .filter("fixes > 1")
    )


def backfill_item_covers(items: DataFrame, books: DataFrame) -> DataFrame:
    """Order lines with an empty cover take the book's, if that is not blank.

    A task holds its share of the books and lets the lines pass unsorted, however many name one book or none."""
    covers = books.filter(~X.is_blank("cover")).select("book_id", F.col("cover").alias("_cover")).hint("shuffle_hash")
    joined = items.join(covers, "book_id", "left")
    cover = F.when((F.col("cover") == "") & F.col("_cover").isNotNull(), F.col("_cover")).otherwise(F.col("cover"))
    return joined.withColumn("cover", cover).select(*items.columns)


def migrate(tables: dict[str, DataFrame], fixes: DataFrame) -> dict[str, DataFrame]:
    """The whole repeatable migration of books, cart items and order lines.

    Pure: publish the result with ``sources.tables.publish`` to make it current.
    """
    books = conform(
        tables["books"], "books", ("volume", "cover", "keywords", "page_count", "release_date", "book_id")
    )
    books = backfill_books(repair_volumes(books), fixes)
    cart = conform(tables["cart_items"], "cart_items", ("volume", "cover"))
    items = backfill_item_covers(conform(tables["order_items"], "order_items", ("cover",)), books)
    return {**tables, "books": books, "cart_items": cart, "order_items": items}
