"""The plans are the ones wanted."""

import pytest

from quire.operators import cart as C
from quire.operators import orders as O
from quire.operators import requests as R
from quire.plans import queries
from quire.plans import views as V

BASE = "/root/testdata/sf0.001"


def plan(df, mode="simple"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.mark.parametrize(
    "name", ["order_history", "catalog", "cart_view", "cart_add", "cart_fold", "order_item_qty_totals", "quota_excess_requests", "search_faceted"]
)
def test_no_python_no_nested_loops(spark, name):
    text = plan(queries.QUERIES[name](spark, BASE))
    for bad in ("Python", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition"):
        assert bad not in text, bad


def test_filters_and_columns_reach_the_scan(spark):
    heads = V.table(spark, BASE, "orders")
    text = plan(heads.filter("o_custkey = 7").select("o_orderkey"))
    assert "EqualTo(o_custkey,7)" in text and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text
    pruned = plan(O.order_lines_total(V.items(spark, BASE)))
    assert "l_shipdate" not in pruned and "l_suppkey" not in pruned


def test_latest_orders_are_cut_before_the_shuffle(spark):
    text = plan(O.recent_purchases(V.orders(spark, BASE), V.items(spark, BASE)))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_requests_are_ranked_within_a_second_only(spark):
    ranks = [x for x in plan(R.quota_excess(V.requests(spark, BASE), {"click": 5000})).splitlines() if "row_number()" in x and "windowspecdefinition" in x]
    assert ranks and all("_s#" in x.partition("windowspecdefinition")[2] for x in ranks)


def test_consolidation_aggregates_before_the_shuffle(spark):
    text = plan(C.consolidate(V.cart(spark, BASE)))
    assert "partial_sum" in text and "partial_max" in text


def test_adaptive_execution_splits_a_hot_book(spark):
    """A third of the lines name one book; the plain join of two shuffled sides is split."""
    lines = V.items(spark, "/root/testdata/sf0.01")
    hot = lines.selectExpr(
        "id", "order_id", "case when quantity <= 17 then 'P0000001' else book_id end as book_id", "title", "''  as cover", "unit_price",
        "quantity", "line_total",
    ).repartition(16)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        joined = O.items_with_cover(hot, V.books(spark, "/root/testdata/sf0.01"))
        assert len(joined.collect()) == 60000
        assert "skew=true" in plan(joined)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
