"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402
from quire.llm import ann, bagminhash, bestfit, divergence, langid, packing, pieces, pii, ring, suffixes  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("rank", "key", "node", "slot", "base", "spans", "kept", "n_bytes", "t", "w", "h", "_c0", "print", "list", "size")
LONG = "the quick brown fox jumps over a lazy dog while it rains in the old town " * 700
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "  \n\t ", "en", "a", 5),
    (4, "12345 !!", None, "b", 8),
    (5, "one", "en", None, 3),
    (6, LONG, "en", "a", None),
    (7, "der die und das nicht mit von zu sich auch " * 8, "de", "a", 1),
    (7, "der die und das nicht mit von zu sich auch " * 8, "de", "a", 1),
    (8, "der die und das nicht mit von zu sich auch " * 8, "de", "c", 1),
    (None, "ein text ohne nummer aber mit vielen worten darin", "de", "c", 1),
    (None, "ein text ohne nummer aber mit vielen worten darin", "de", "c", 1),
    (9, "x" * 30_000, "en", "c", 1),
    (10, "mail me at some.one@mail.example.com or +1 (555) 555-0100 \U0001f600", "en", "c", 1),
]
OPERATORS = {
    "packing": (packing.pack, 13),
    "language": (langid.identify, 13),
    "pii": (pii.find, 13),
    "suffixes": (suffixes.remove_repeats, 13),
    "quality": (divergence.quality, 13),
    "ring": (lambda d: ring.shard_documents(d, shards=3), 13),
    "matrix": (bestfit.pack_matrix, None),
    "minhash": (bagminhash.near_duplicates, 13),
    "pieces": (lambda d: pieces.decode(pieces.encode(d, chunk=1000)), 13),
}


def documents(spark, rows=ROWS, clash=False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("extra") for c in CLASHING}) if clash else df


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows(spark, name):
    run, rows = OPERATORS[name]
    found = run(documents(spark, clash=True)).collect()
    if name == "packing":
        assert sum(r["start"] == 0 for r in found) == rows
    elif rows is not None:
        assert len(found) == rows
    else:
        assert sum(list(r["starts"]).count(0) for r in found) == 13


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name][0](documents(spark, [])).collect() == []


def test_nearest_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (None, [1.0, 1.0]), (5, [1.0]), (6, [2.0, 0.0]), (7, [2.0, 0.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"list": F.lit(1), "v": F.lit(2), "rank": F.lit(3)})
    found = [tuple(r) for r in ann.nearest(df).orderBy("query_id", "rank").collect()]
    assert [r[2] for r in found[:2]] == [6, 7] and {r[0] for r in found} == {0} and all(r[3] == 1.0 for r in found)
    assert ann.nearest(df.limit(0)).collect() == []


@pytest.mark.parametrize("clash", [False, True])
def test_stages_keep_columns(spark, tmp_path, clash):
    docs = documents(spark, clash=clash)
    names, sizes = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "edges")
        path = f"{tmp_path}/{k}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        sizes.append(docs.count())
        assert docs.columns == names or k == len(corpus_pipeline.STAGES) - 1
    # nulls, empty and letterless texts go first; then the copies
    assert sizes[:4] == [9, 6, 6, 6]


def test_stages_on_empty_table(spark, tmp_path):
    docs = documents(spark, [])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "empty").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.schema(docs.schema).parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0
