import re
from decimal import Decimal

import pytest
from helpers import at, book, books, by, table
from pyspark.sql import functions as F

from quire import schemas
from quire.operators import catalog as C
from quire.operators import search as S
from quire.sources import tables as T


def shelf(spark):
    return books(
        spark,
        book("SH001", "Salt Harbor", "Vol 1", keywords="pirates, Bestsellers", release_date="2003-04-05", page_count=200),
        book("SH002", "Salt Harbor", "Vol 2"),
        book("SH010", "Salt Harbor", "Vol 10", author="late"),
        book("TO001", "Tin Orchard", "Vol 1", "20.00", type="light novel", publisher="Quill House", genre="Action"),
        book("BB001", "Red Kite", "Vol 1", "50.00", genre="Romance", author="Bee", keywords=None),
        book("XX001", "Ōkami", None, "39.90", genre=None, author=None),
    )


def docs(df, **options):
    return {r["title"]: r for r in C.catalog(df, **options).collect()}


def test_nested_documents(spark):
    got = docs(shelf(spark))
    piece = got["Salt Harbor"]
    assert [v["volumeNumber"] for v in piece["volumes"]] == [1.0, 10.0, 2.0]  # text order
    assert piece["author"] == "A" and piece["genre"] == ["Action", "Fantasy"]
    assert piece["keywords"] == ["pirates", "Bestsellers"] and piece["price"] == Decimal("30.00")
    assert piece["volumes"][0]["page_count"] == 200 and piece["section"] == 0
    assert got["Ōkami"]["volumes"][0]["volumeNumber"] is None and got["Ōkami"]["genre"] == []
    by_number = docs(shelf(spark), numeric_order=True)["Salt Harbor"]
    assert [v["volumeNumber"] for v in by_number["volumes"]] == [1.0, 2.0, 10.0]


def test_long_title_comes_in_sections(spark):
    rows = [book(f"A{i:03d}", "Long", f"Vol {i:03d}") for i in range(40)] + [book("S1", "Short")]
    got = C.catalog(books(spark, *rows), section_length=8).orderBy("title", "section").collect()
    assert [r["title"] for r in got].count("Short") == 1
    long = [r for r in got if r["title"] == "Long"]
    assert len(long) > 1 and all(len(r["volumes"]) < 40 for r in long)
    assert [v["volumeNumber"] for r in long for v in r["volumes"]] == [float(i) for i in range(40)]


def test_list_columns_pass(spark):
    rows = spark.createDataFrame(
        [("T", [" Action ", "Fantasy", "7"], [" Popular ", " New ", "42"])],
        "title string, genre array<string>, keywords array<string>",
    ).selectExpr(
        "'B1' book_id", "title", "'a' author", "genre", "'d' description", "cast(1 as decimal(10,2)) price", "'Vol 1' volume",
        "'c' cover", "'t' type", "'p' publisher", "keywords", "1 page_count", "'r' release_date",
    )
    got = docs(rows)["T"]
    assert got["genre"] == ["Action", "Fantasy", "7"] and got["keywords"] == ["Popular", "New", "42"]


@pytest.mark.parametrize(
    "dropped, lost",
    [
        ((), ()),
        (("book_id",), ("book_id",)),
        (("page_count",), ("book_id", "keywords", "page_count", "release_date")),
        (("cover", "keywords"), ("book_id", "cover", "keywords", "page_count", "release_date")),
        (("volume", "keywords"), ("book_id", "volume", "keywords", "page_count", "release_date")),
        (("volume", "cover"), ("book_id", "volume", "cover", "keywords", "page_count", "release_date")),
    ],
)
def test_fallback_scan(spark, dropped, lost):
    row = C.catalog_scan(shelf(spark).drop(*dropped)).filter("title = 'Salt Harbor'").first()
    assert row.__fields__ == list(C.PROJECTIONS[0])
    assert {c for c in row.__fields__ if row[c] is None} == set(lost)


def test_fallback_scan_gives_up(spark):
    with pytest.raises(ValueError, match="price"):
        C.catalog_scan(shelf(spark).drop("price"))


def found(df, **facets):
    open_price = {"min_price": None, "max_price": None}
    return sorted(r["title"] for r in S.search_titles(df, **{**open_price, **facets}).collect())


def test_facets(spark):
    df = shelf(spark)
    everything = ["Red Kite", "Salt Harbor", "Tin Orchard", "Ōkami"]
    assert found(df) == everything
    assert found(df, query="salt ha") == ["Salt Harbor"]
    assert found(df, query="BEST") == ["Salt Harbor"]  # keyword only
    assert found(df, query="bee") == ["Red Kite"]  # author; the title without one does not match
    assert found(df, kind="Light Novel") == ["Tin Orchard"] and found(df, kind="All") == everything == found(df, kind="")
    assert found(df, publishers=["Quill House", "X"]) == ["Tin Orchard"] and found(df, publishers=[""]) == everything
    assert found(df, genres=["Action"]) == ["Salt Harbor", "Tin Orchard"] and found(df, genres=["action"]) == []
    assert found(df, genres=["All", "Romance"]) == everything
    assert found(df, min_price=Decimal("20"), max_price=Decimal("30")) == ["Salt Harbor", "Tin Orchard"]
    assert found(df, query="a", genres=["Fantasy"], max_price=Decimal("30")) == ["Salt Harbor"]


def test_default_price_hides_dear_titles(spark):
    got = sorted(r["title"] for r in S.search_titles(shelf(spark)).collect())
    assert got == ["Salt Harbor", "Tin Orchard"]


def test_price_of_first_volume_decides(spark):
    df = books(spark, book("A1", "T", "Vol 1", "10.00"), book("A2", "T", "Vol 2", "99.00"))
    got = S.search_cards(df).collect()
    assert [r["price"] for r in got] == [Decimal("10.00")] * 2
    assert got[0]["display_price"] == Decimal("9.99")


def test_sorts_and_pages(spark):
    df = books(
        spark,
        *[book(f"B{i}", t, "Vol 1", p) for i, (t, p) in enumerate([("b", "3"), ("Ōkami", "1"), ("a", "2"), ("B", "3"), ("zed", "5")])],
    )
    cards = S.search_cards(df, min_price=None, max_price=None)
    order = lambda sort: [r["title"] for r in S.sort_cards(cards, sort).collect()]
    assert order("title-asc") == ["a", "b", "B", "Ōkami", "zed"]
    assert order("title-desc") == ["zed", "Ōkami", "B", "b", "a"]
    assert order("price-asc") == ["Ōkami", "a", "B", "b", "zed"]
    assert order("price-desc") == ["zed", "B", "b", "a", "Ōkami"]
    assert [r["title"] for r in S.page(cards, "title-asc", 2, 2).collect()] == ["B", "Ōkami"]
    assert tuple(S.page_counts(cards, 2, 2).first()) == (5, 3, 4)
    assert tuple(S.page_counts(cards, 3, 2).first()) == (5, 3, 5)
    assert tuple(S.page_counts(cards.limit(0), 1, 8).first()) == (0, 0, 0)


def test_featured(spark):
    assert [r["title"] for r in S.featured(shelf(spark)).collect()] == ["Salt Harbor"]
    many = books(spark, *[book(f"K{i}", f"T{i}", keywords="bestSELLERS") for i in range(9)])
    assert [r["title"] for r in S.featured(many).collect()] == [f"T{i}" for i in range(6)]


def test_details_and_links(spark):
    lookups = spark.createDataFrame(
        [("l1", "Salt Harbor", "2"), ("l2", "salt harbor", "2"), ("l3", "Salt Harbor", "9")], "lookup_id string, title string, volume string"
    )
    got = S.book_details(shelf(spark), lookups).collect()
    assert {r["lookup_id"] for r in got} == {"l1"} and len(got) == 7
    values = {r["label"]: r["value"] for r in got}
    assert values["Genre"] == "Action, Fantasy" and values["Page count"] == "192"
    links = {r["book_id"]: r["link"] for r in S.book_links(C.volumes(shelf(spark))).collect()}
    assert links["SH010"] == "/book/Salt%20Harbor/10" and links["XX001"] == "/book/%C5%8Ckami/null"


def test_json_documents(spark, tmp_path):
    documents = C.catalog(shelf(spark))
    T.write_documents(documents, str(tmp_path / "docs"))
    back = spark.read.json(str(tmp_path / "docs"))
    assert back.count() == 4
    text = T.as_json(documents.filter("title = 'Ōkami'")).first()["document"]
    assert '"author":null' in text and '"volumeNumber":null' in text


# Repairs ------------------------------------------------------------------------------


def fixes(spark, *rows):
    return table(spark, schemas.BOOKS_FIX, rows)


FIX = {"title": "Salt Harbor", "volume": "Vol 1", "cover": "new.jpg", "page_count": 200, "release_date": "2003-04-05"}


def test_volume_repair_leaves_good_volumes(spark):
    df = books(spark, book("SH003", "T", " ", cover=None), book("B2", "T", "Vol 9"), book("B3", "T", "\t", cover=None))
    got = {r["book_id"]: r["volume"] for r in C.repair_volumes(df).collect()}
    assert got == {"SH003": "Vol 3", "B2": "Vol 9", "B3": "\t"}


def test_backfill_takes_all_three(spark):
    df = books(
        spark,
        book("SH001", "Salt Harbor", "Vol 1", page_count=0, cover="good.jpg"),
        book("SH002", "Salt Harbor", "Vol 2", cover=" "),
        book("SH003", "Salt Harbor", "Vol 1", cover="kept.jpg"),
    )
    got = {r["book_id"]: (r["cover"], r["page_count"], r["release_date"]) for r in C.backfill_books(df, fixes(spark, FIX)).collect()}
    assert got["SH001"] == ("new.jpg", 200, "2003-04-05")
    assert got["SH002"] == (" ", 192, "2020-01-01") and got["SH003"][0] == "kept.jpg"


def test_backfill_leaves_conflicting_fixes(spark):
    df = books(spark, book("SH001", FIX["title"], FIX["volume"], page_count=0), book("S1", "Salt", "Vol 1", page_count=0))
    other = {**FIX, "page_count": 7}
    sure = {**FIX, "title": "Salt", "volume": "Vol 1"}
    got = by(C.backfill_books(df, fixes(spark, FIX, other, sure, sure)), "book_id", "page_count")
    assert got == {"SH001": 0, "S1": FIX["page_count"]}
    assert C.conflicting_fixes(fixes(spark, FIX, other, sure, sure)).collect()[0][:] == (FIX["title"], FIX["volume"], 2)


def item(id, book_id, cover=""):
    return {"id": id, "order_id": "o", "book_id": book_id, "title": "t", "cover": cover, "unit_price": Decimal("1"), "quantity": 1,
            "line_total": Decimal("1")}


def store(spark):
    return {
        "books": books(
            spark, book("SH001", "Salt Harbor", "", page_count=None, cover=None), book("B2", "T", "Vol 2", cover=" "), book("B3", "T", "Vol 3", cover="b3.jpg")
        ),
        "cart_items": table(spark, schemas.CART_ITEMS, []),
        "order_items": table(spark, schemas.ORDER_ITEMS, [item("i1", "SH001"), item("i2", "B2"), item("i3", "B3", "own.jpg"), item("i4", "B3")]),
    }


def rows(df):
    return sorted(map(str, df.collect()))


def test_migration_repeats(spark):
    once = C.migrate(store(spark), fixes(spark, FIX))
    covers = {r["id"]: r["cover"] for r in once["order_items"].collect()}
    assert covers == {"i1": "new.jpg", "i2": "", "i3": "own.jpg", "i4": "b3.jpg"}
    twice = C.migrate(once, fixes(spark, FIX))
    for name in once:
        assert rows(once[name]) == rows(twice[name])


def test_migration_adds_columns(spark):
    old = store(spark)
    old["books"] = old["books"].drop("keywords", "page_count", "release_date")
    old["order_items"] = old["order_items"].drop("cover").withColumn("book_id", F.lit(7))
    new = C.migrate(old, fixes(spark))
    assert {"keywords", "page_count", "release_date"} <= set(new["books"].columns)
    assert {r["page_count"] for r in new["books"].collect()} == {0}
    assert {(r["book_id"], r["cover"]) for r in new["order_items"].collect()} == {("7", "")}


def test_failed_migration_changes_nothing(spark, tmp_path):
    base = str(tmp_path / "store")
    T.publish(store(spark), base, 1)
    before = rows(T.read_published(spark, base, "books"))
    broken = fixes(spark, FIX).withColumn("cover", F.raise_error(F.lit("no list")).cast("string"))
    for version in (2, 1):  # a new version, and a repetition of the one being read
        with pytest.raises(Exception, match="no list"):
            T.publish({"books": store(spark)["books"].crossJoin(broken.select(F.col("cover").alias("c")))}, base, version)
        assert rows(T.read_published(spark, base, "books")) == before
    T.publish(C.migrate(store(spark), fixes(spark, FIX)), base, 3)
    assert rows(T.read_published(spark, base, "books")) != before
    assert rows(T.read_published(spark, base, "books", before=3)) == before


def test_tables_and_defaults(spark, tmp_path):
    raw = spark.createDataFrame([("u1", "n", "secret", at(0))], "id string, name string, password_hash string, created_at timestamp")
    raw.write.parquet(str(tmp_path / "users"))
    assert "password_hash" not in T.read_table(spark, str(tmp_path), "users").columns
    added = T.append_rows(raw.drop("password_hash").withColumn("id", F.lit("u2")), str(tmp_path / "users"))
    assert added.count() == 1 and T.read_table(spark, str(tmp_path), "users").count() == 2
    filled = T.apply_defaults(books(spark, book("B", "T", page_count=None, stock=None)), "books").first()
    assert (filled["page_count"], filled["stock"]) == (0, 0)


def test_indexed_pages_equal_sorted_pages(spark):
    rows = [book(f"B{i:03d}", f"T{i % 37:02d}", f"Vol {i // 37}", price=f"{i % 5}.00") for i in range(150)]
    found = S.search_cards(books(spark, *rows), min_price=None, max_price=None)
    for sort in ("title-desc", "price-asc"):
        index = S.page_index(found, sort, parts=6)
        assert index.parts.count() > 1
        want = [r["book_id"] for r in S.sort_cards(found, sort).collect()]
        for number in (1, 7, 19, 20):
            got = S.page_at(index, number).collect()
            assert [(r["position"], r["book_id"]) for r in got] == list(enumerate(want, 1))[8 * number - 8 : 8 * number]
        assert {r["book_id"]: r["position"] for r in S.positions(index).collect()} == {b: n for n, b in enumerate(want, 1)}
        plan = S.page_at(index, 15)._jdf.queryExecution().executedPlan().toString()  # reads the files of its parts alone
        named = re.search(r"PartitionFilters: \[.*?part#\d+ (?:IN \(([\d,]+)\)|= (\d+))", plan)
        assert named and len((named[1] or named[2]).split(",")) <= 2
    empty = S.page_index(found.limit(0))
    assert S.page_at(empty, 1).collect() == []
