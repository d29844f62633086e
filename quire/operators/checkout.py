"""Checkout: all-or-nothing requests that turn cart rows into orders and lines.

Requests of one user are served in (ts, request_id) order; a request fails when one
of its rows is not the user's or went to an earlier successful request.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import exprs as X
from quire.operators.cart import INVALID, NOT_FOUND, OK
from quire.operators.skew import written

# Rounds over the whole set before what is left is served in turn.
ROUNDS = 2


class Checkout(NamedTuple):
    orders: DataFrame
    lines: DataFrame
    cart: DataFrame
    results: DataFrame


def _pairs(requests: DataFrame) -> DataFrame:
    return requests.withColumn("_ids", X.distinct_ids("cart_item_ids")).select(
        "request_id", "user_id", "ts", F.size("_ids").alias("_wanted"), F.explode("_ids").alias("id")
    )


def _checked_pairs(cart: DataFrame, requests: DataFrame) -> DataFrame:
    rows = cart.select("id", "user_id", F.lit(1).alias("_own"))
    return _pairs(requests).join(rows, ["id", "user_id"], "left")


def _found(checked: DataFrame) -> DataFrame:
    return checked.groupBy("request_id").agg(
        F.count("_own").alias("_found"), F.max("_wanted").alias("_wanted")
    )


def validate(cart: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request: ids asked for, ids that are the user's, and the status before
    any conflict between requests."""
    return _statuses(requests, _found(_checked_pairs(cart, requests)).drop("_wanted"))


def _statuses(requests: DataFrame, found: DataFrame) -> DataFrame:
    asked = F.size(X.distinct_ids("cart_item_ids"))
    matched = F.coalesce("_found", F.lit(0)).cast("int")
    return requests.join(found, "request_id", "left").select(
        "request_id",
        "user_id",
        "ts",
        "cart_item_ids",
        asked.alias("requested"),
        matched.alias("matched"),
        F.when(asked == 0, INVALID).when(matched == asked, OK).otherwise(NOT_FOUND).alias("status"),
    )


def _one_round(open_pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Winners of a round, and the pairs still open after it.

    A request wins when it is the earliest open one for every row it names; requests
    that share a row with a winner are out.
    """
    first = open_pairs.groupBy("id").agg(
        F.min_by("request_id", F.struct("ts", "request_id")).alias("request_id")
    )
    leads = first.groupBy("request_id").agg(F.count(F.lit(1)).alias("_leads"))
    needs = open_pairs.groupBy("request_id").agg(F.count(F.lit(1)).alias("_needs"))
    winners = leads.join(needs, "request_id").filter("_leads = _needs").select("request_id")
    taken = first.join(winners, "request_id", "left_semi").select("id")
    out = open_pairs.join(written(taken), "id", "left_semi").select("request_id").distinct()
    return winners, open_pairs.join(out, "request_id", "left_anti")


def _in_turn(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (user_id, ts, request_id, id) come sorted; a request that finds all its rows free takes them.

    Only the ids taken from the user at hand are held."""
    user = turn = None
    taken: set[str] = set()
    asked: list[str] = []
    won: list[str] = []

    def settle() -> None:
        if turn is not None and taken.isdisjoint(asked):
            taken.update(asked)
            won.append(turn)

    for part in parts:
        for owner, request, row in zip(*(part.column(n).to_pylist() for n in ("user_id", "request_id", "id")), strict=True):
            if (owner, request) != (user, turn):
                settle()
                if owner != user:
                    taken.clear()
                user, turn, asked = owner, request, []
            asked.append(row)
        yield pa.RecordBatch.from_arrays([pa.array(won, pa.string())], ["request_id"])
        won.clear()
    settle()
    yield pa.RecordBatch.from_arrays([pa.array(won, pa.string())], ["request_id"])


def _serve_in_turn(pairs: DataFrame) -> DataFrame:
    """Winners when each user's requests are served one after another."""
    rows = pairs.select("user_id", "ts", "request_id", "id").repartition("user_id")
    return rows.sortWithinPartitions("user_id", "ts", "request_id", "id").mapInArrow(_in_turn, "request_id string")


def decide(cart: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request with its final status.

    Requests that share rows are settled in a fixed number of rounds over the whole set, each of
    which also settles any number of requests for the same row; chains of requests that are
    still open then are served user by user in order.
    """
    checked = written(_checked_pairs(cart, requests))
    found = _found(checked)
    complete = found.filter("_found = _wanted").select("request_id")
    pairs = checked.join(complete, "request_id", "left_semi").drop("_own")
    shared = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("id")
    contested = pairs.join(written(shared), "id", "left_semi").select("request_id").distinct()
    left = pairs.join(contested, "request_id", "left_semi")
    valid = _statuses(requests, found.drop("_wanted"))
    won = None
    for _ in range(ROUNDS):
        winners, left = _one_round(written(left))
        won = winners if won is None else won.unionByName(winners)
    won = won.unionByName(_serve_in_turn(left))
    lost = written(contested.join(won, "request_id", "left_anti")).withColumn("_lost", F.lit(True))
    return (
        valid.join(lost, "request_id", "left")
        .withColumn("status", F.when(F.col("_lost"), NOT_FOUND).otherwise(F.col("status")))
        .drop("_lost")
    )


def checkout(cart: DataFrame, requests: DataFrame) -> Checkout:
    """Serve all requests.  Every cart row goes to at most one order, or stays."""
    decided = written(decide(cart, requests))
    bought = _pairs(decided.filter(F.col("status") == OK)).select("request_id", "ts", "id", "user_id")
    order_id = X.derived_id("request_id")
    lines = (
        bought.join(cart, ["id", "user_id"])
        .withColumn("line_total", (F.col("unit_price") * F.col("quantity")).cast(X.WIDE_MONEY))
        .select(
            X.derived_id("request_id", "id").alias("id"),
            order_id.alias("order_id"),
            "book_id",
            "title",
            "cover",
            "unit_price",
            "quantity",
            "line_total",
            F.col("created_at").alias("cart_created_at"),
            F.col("id").alias("cart_item_id"),
            "user_id",
            "ts",
        )
    )
    orders = lines.groupBy("order_id", "user_id", "ts").agg(
        F.sum("line_total").cast(X.WIDE_MONEY).alias("total_amount")
    ).select(
        F.col("order_id").alias("id"),
        "user_id",
        "total_amount",
        F.lit("completed").alias("status"),
        F.col("ts").alias("created_at"),
    )
    left = cart.join(bought.select("id", "user_id"), ["id", "user_id"], "left_anti").select(*cart.columns)
    results = decided.withColumn("order_id", F.when(F.col("status") == OK, order_id)).select(
        "request_id", "user_id", "status", "order_id"
    )
    return Checkout(orders, lines.drop("user_id", "ts"), left, results)


def numbered_lines(lines: DataFrame) -> DataFrame:
    """Lines with ``line_no``, the order in which they are written: oldest cart row first within an order."""
    oldest = Window.partitionBy("order_id").orderBy(F.col("cart_created_at").asc_nulls_last(), "cart_item_id")
    return lines.withColumn("line_no", F.row_number().over(oldest))
