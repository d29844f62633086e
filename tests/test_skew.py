import pytest
from pyspark.sql import functions as F

from quire.operators import skew as S


@pytest.fixture(scope="module")
def sides(spark):
    """A third of the rows share key 1, a tenth have none."""
    big = spark.range(30000).select(
        F.col("id").cast("string").alias("row"),
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 10 == 1, None).otherwise(F.col("id") % 5000).cast("int").alias("k"),
    )
    other = spark.range(0, 5000, 2).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    return big, other.unionByName(spark.createDataFrame([(1, -1)], "k int, v bigint"))


def test_written_side_lets_a_hot_key_be_split(spark, sides):
    big, other = sides
    keyed = S.written(other.groupBy("k").agg(F.max("v").alias("v")))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        for how in ("inner", "left", "left_semi", "left_anti"):
            joined = big.repartition(8).join(keyed, "k", how)
            joined.count()
            assert joined.exceptAll(big.join(other.groupBy("k").agg(F.max("v").alias("v")), "k", how)).count() == 0
            joined.collect()
            assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString(), how
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_nest_keeps_everything(sides):
    big, _ = sides
    rows = big.dropna()
    make = lambda x: F.struct(x["o0"].alias("row"))
    whole = S.nest(rows, ["k"], [F.col("row")], [], make, "rows", 20_000)
    parts = S.nest(rows, ["k"], [F.col("row")], [], make, "rows", 500)
    assert whole.count() == rows.select("k").distinct().count() and {r[0] for r in whole.select("section").distinct().collect()} == {0}
    assert parts.agg(F.max(F.size("rows"))).first()[0] == 500
    hot = parts.filter("k = 1").orderBy("section").collect()
    assert [r["section"] for r in hot] == list(range(len(hot))) and all(len(r["rows"]) == 500 for r in hot[:-1])
    got = [x["row"] for r in hot for x in r["rows"]]
    assert got == sorted(got) == [x["row"] for x in whole.filter("k = 1").first()["rows"]]
    assert parts.filter("k <> 1").agg(F.max("section"), F.sum(F.size("rows"))).first()[1] == rows.filter("k <> 1").count()


def test_written_keeps_rows_and_types(spark, sides):
    big, _ = sides
    again = S.written(big)
    assert again.dtypes == big.dtypes and again.exceptAll(big).count() == 0 and again.count() == big.count()
    empty = S.written(big.limit(0))
    assert empty.count() == 0 and empty.columns == big.columns
