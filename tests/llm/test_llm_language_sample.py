"""The sample that the language field learns from."""

from pyspark.sql import functions as F

from quire.llm import langid


def test_repeated_rows_count_once(spark):
    rows = [(1, "der die das", "de")] * 3000 + [(i, f"the text {i}", "en") for i in range(2, 30)] + [(40, "b", "fr"), (40, "a", "fr"), (None, "x", "en"), (41, None, "en"), (42, "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found = langid.training_rows(docs, F.col("doc_id").isNull(), 20, 64)
    assert sorted(x for x in found if x[1] != "en") == [("a", "fr"), ("der die das", "de")]
    assert len(set(found)) == len(found) == 22


def test_field_knows_the_rarer_language(spark):
    rows = [(1, "der hund und die katze " * 3, "de")] * 13_000 + [(i, "the dog and the cat in town", "en") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(langid.learned_field(docs.repartition(4)).languages) >= {"de", "en"}
