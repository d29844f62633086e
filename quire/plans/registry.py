"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def as_text(df: DataFrame, *columns: str) -> DataFrame:
    """Columns as text, for results that are compared across engines."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# Text pieces of the SQL side.
_WS = r"[\s\x{00A0}]"


def q_trim(x: str) -> str:
    return f"regexp_replace(cast({x} as varchar), '^{_WS}+|{_WS}+$', '', 'g')"


def q_text(x: str) -> str:
    return f"nullif({q_trim(x)}, '')"


def q_number(x: str) -> str:
    t = q_trim(x)
    return (
        rf"case when regexp_full_match({t}, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') "
        f"then try_cast({t} as double) end"
    )


def q_quantity(x: str) -> str:
    n = f"({q_number(x)})"
    return f"case when {n} = floor({n}) and {n} > 0 and {n} <= 2147483647 then cast({n} as int) end"


def q_volume_number(x: str) -> str:
    return q_number(f"regexp_replace(coalesce({x}, ''), 'Vol ', '')")


def q_list(x: str) -> str:
    return f"[trim(e) for e in string_split(coalesce({x}, ''), ',') if trim(e) <> '']"


def q_md5_id(x: str) -> str:
    return f"regexp_replace(md5({x}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


def q_blank(x: str) -> str:
    return f"({x} is null or trim({x}) = '')"
