"""Faceted catalog search on flat rows: title predicates, cards, sorts and pages."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import exprs as X
from quire.operators.catalog import titles, volume_order, volumes
from quire.operators.skew import written

# Price bounds, page length, featured keyword and count used when none are given.
MIN_PRICE, MAX_PRICE = Decimal("1"), Decimal("30")
PAGE_SIZE = 8
FEATURED_KEYWORD, FEATURED_COUNT = "Bestsellers", 6
DETAIL_LABELS = ("Title", "Author", "Publisher", "Genre", "Keywords", "Release date", "Page count")
SORTS = ("title-asc", "title-desc", "price-asc", "price-desc")


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def matches_text(query: str | None) -> Column:
    """Lower-case text contained in title, author, type, any genre or any keyword."""
    needle = F.lower(F.lit(query or ""))
    within = [_true(F.contains(F.lower(c), needle)) for c in ("title", "author", "type")]
    within += [_true(F.exists(c, lambda x: F.contains(F.lower(x), needle))) for c in ("genre", "keywords")]
    found = within[0]
    for c in within[1:]:
        found = found | c
    return found


def matches_type(kind: str | None) -> Column:
    if not kind or kind == "All":
        return F.lit(True)
    return _true(F.lower("type") == kind.lower())


def matches_publishers(publishers: Sequence[str]) -> Column:
    chosen = [p for p in publishers if p]
    return _true(F.col("publisher").isin(chosen)) if chosen else F.lit(True)


def matches_genres(genres: Sequence[str]) -> Column:
    chosen = [g for g in genres if g]
    if not chosen or "All" in chosen:
        return F.lit(True)
    return _true(F.arrays_overlap("genre", F.array(*[F.lit(g) for g in chosen])))


def matches_price(low: Decimal | None, high: Decimal | None) -> Column:
    inside = F.lit(True)
    if low is not None:
        inside = inside & (F.col("price") >= F.lit(low))
    if high is not None:
        inside = inside & (F.col("price") <= F.lit(high))
    return _true(inside)


def search_titles(
    books: DataFrame,
    query: str | None = "",
    kind: str | None = "All",
    publishers: Sequence[str] = (),
    genres: Sequence[str] = (),
    min_price: Decimal | None = MIN_PRICE,
    max_price: Decimal | None = MAX_PRICE,
) -> DataFrame:
    """Titles meeting all given facets; the price is that of the first volume."""
    return titles(books).filter(
        matches_text(query)
        & matches_type(kind)
        & matches_publishers(publishers)
        & matches_genres(genres)
        & matches_price(min_price, max_price)
    )


def cards(books: DataFrame, chosen_titles: DataFrame) -> DataFrame:
    """One product card per volume of the chosen titles."""
    return volumes(books).join(written(chosen_titles), "title").select(
        "title",
        "author",
        F.col("price").cast(X.MONEY).alias("price"),
        "volume_number",
        "cover",
        X.display_price("price").alias("display_price"),
        "volume",
        "book_id",
    )


def search_cards(books: DataFrame, **facets) -> DataFrame:
    return cards(books, search_titles(books, **facets))


def sort_keys(sort: str = "title-asc") -> list[Column]:
    """Chosen order first, catalog order to break ties."""
    title = F.collate("title", "UNICODE")
    chosen = {
        "title-asc": title.asc_nulls_last(),
        "title-desc": title.desc_nulls_last(),
        "price-asc": F.col("price").asc_nulls_last(),
        "price-desc": F.col("price").desc_nulls_last(),
    }.get(sort, title.asc_nulls_last())
    return [chosen, F.col("title"), *volume_order()]


def sort_cards(found: DataFrame, sort: str = "title-asc") -> DataFrame:
    return found.orderBy(*sort_keys(sort))


def page(found: DataFrame, sort: str = "title-asc", number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page of cards."""
    return found.orderBy(*sort_keys(sort)).offset(size * (number - 1)).limit(size)


class PageIndex(NamedTuple):
    """Cards in order, dealt into range parts (``part``, ``at`` within it), and per part the place where it begins."""

    rows: DataFrame
    parts: DataFrame


def page_index(found: DataFrame, sort: str = "title-asc", parts: int | None = None) -> PageIndex:
    """Sort once, for many pages: a page then reads the one or two parts it lies in, however deep it is.

    The rows are written by part, so that a filter on ``part`` prunes the files; ``parts`` holds one row for each.
    """
    keys = sort_keys(sort)
    dealt = found.repartitionByRange(parts, *keys) if parts else found.repartitionByRange(*keys)
    # Numbers of this kind are the task's number and, in the low 33 bits, the row's place in it.
    numbered = dealt.sortWithinPartitions(*keys).withColumn("_n", F.monotonically_increasing_id())
    place = F.shiftright("_n", 33).cast("int").alias("part"), (F.col("_n") - F.shiftleft(F.shiftright("_n", 33), 33)).alias("at")
    rows = written(numbered.select(*place, *found.columns), by="part")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    return PageIndex(rows, written(sizes.withColumn("begin", F.coalesce(F.sum("rows").over(before), F.lit(0)))))


def page_at(index: PageIndex, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """The cards of a page with their ``position`` (from 1) in the whole order."""
    low, high = size * (number - 1), size * number
    touched = index.parts.filter((F.col("begin") < high) & (F.col("begin") + F.col("rows") > low)).select("part", "begin").collect()
    rows = index.rows.filter(F.col("part").isin([r["part"] for r in touched]))  # at most ``size`` parts, mostly one
    begin = F.coalesce(*[F.when(F.col("part") == r["part"], F.lit(r["begin"])) for r in touched], F.lit(None).cast("long"))
    placed = rows.withColumn("position", begin + F.col("at") + 1).filter((F.col("position") > low) & (F.col("position") <= high))
    return placed.orderBy("position").drop("part", "at")


def positions(index: PageIndex) -> DataFrame:
    """All cards with their ``position`` (from 1) in the whole order."""
    return index.rows.join(index.parts, "part").withColumn("position", F.col("begin") + F.col("at") + 1).drop("part", "at", "begin", "rows")


def page_counts(found: DataFrame, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """Total matches, pages and cards shown up to the given page."""
    n = F.count(F.lit(1))
    return found.agg(
        n.alias("total"),
        F.ceil(n / F.lit(size)).cast("long").alias("pages"),
        F.least(F.lit(number * size).cast("long"), n).alias("shown"),
    )


def has_keyword(keyword: str) -> Column:
    wanted = F.lower(F.lit(keyword))
    return _true(F.exists("keywords", lambda k: F.lower(k) == wanted))


def featured(books: DataFrame, keyword: str = FEATURED_KEYWORD, count: int = FEATURED_COUNT) -> DataFrame:
    """The first titles that carry a keyword."""
    return titles(books).filter(has_keyword(keyword)).orderBy(F.col("title").asc_nulls_last()).limit(count)


def book_details(books: DataFrame, lookups: DataFrame) -> DataFrame:
    """Label/value rows for each lookup (lookup_id, title, volume) that finds a book;
    the title must be equal, the volume equal as a number."""
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(volume_order())])
    first = (
        volumes(books)
        .filter(F.col("volume_number").isNotNull())
        .groupBy("title", "volume_number")
        .agg(F.min_by(F.struct("release_date", "page_count"), rank).alias("v"))
        .select("title", "volume_number", "v.*")
    )
    asked = lookups.select("lookup_id", "title", X.number_or_null("volume").alias("volume_number"))
    found = asked.join(written(first), ["title", "volume_number"])
    full = found.join(written(titles(books)), "title")
    values = (
        F.col("title"),
        F.col("author"),
        F.col("publisher"),
        F.array_join("genre", ", "),
        F.array_join("keywords", ", "),
        F.col("release_date"),
        F.col("page_count").cast("string"),
    )
    pairs = F.array(
        *[F.struct(F.lit(k).alias("label"), v.alias("value")) for k, v in zip(DETAIL_LABELS, values)]
    )
    return full.select("lookup_id", F.explode(pairs).alias("d")).select("lookup_id", "d.*")


def book_links(found: DataFrame) -> DataFrame:
    """Cards with their link and the title read back from it."""
    number = F.when(F.col("volume_number") == F.floor("volume_number"), F.col("volume_number").cast("long").cast("string"))
    link = X.book_link("title", F.coalesce(number, F.col("volume_number").cast("string")))
    return found.withColumn("link", link).withColumn(
        "title_back", X.decode_component(F.split(F.col("link"), "/")[2])
    )
