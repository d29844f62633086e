"""Scalar rules as plain Column builders (JVM side only, no Python UDF).

Two trims are in use on purpose: ``F.btrim`` removes spaces only and serves the
table-repair rules, ``js_trim`` removes every whitespace character a browser
would and serves input normalisation.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace stripped from user input, number syntax, the id
# delimiter, the volume prefix and the e-mail rule.
_SPACE = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
_BASES = {"x": (16, "[0-9a-fA-F]"), "o": (8, "[0-7]"), "b": (2, "[01]")}
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
ID_DELIMITER = "::"
VOLUME_PREFIX = "Vol "
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-z]{2,3}$"
FEE_RATE = Decimal("0.1")
MIN_STEP_QUANTITY, MAX_STEP_QUANTITY = 1, 10

MONEY = "decimal(10,2)"
# Products and sums: one huge order must not fail the job for all others.
WIDE_MONEY = "decimal(28,2)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(_SPACE))


def text_or_null(c: Column | str) -> Column:
    """Trimmed text, or NULL when nothing is left."""
    return F.nullif(js_trim(_col(c).cast("string")), F.lit(""))


def is_blank(c: Column | str) -> Column:
    """NULL or spaces only (the table-repair notion of missing)."""
    c = _col(c)
    return c.isNull() | (F.btrim(c) == "")


def _via(c: Column, *steps: Callable[[Column], Column]) -> Column:
    """Apply steps one after another, each to a value computed once however often the
    step mentions it (a one-element array stands in for a local variable)."""
    values = F.array(c)
    for step in steps:
        values = F.transform(values, step)
    return F.get(values, F.lit(0))


def _parsed(text: Column) -> Column:
    digits = F.substring(text, F.lit(3), F.length(text))
    value = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    for letter, (base, pattern) in _BASES.items():  # at most 15 digits, beyond which no integer column goes
        plain = F.ltrim(digits, F.lit("0"))
        number = F.when(F.length(plain) <= (62 if base == 2 else 15), F.conv(F.concat(F.lit("0"), plain), base, 10).try_cast("double"))
        value = F.when(text.rlike(f"^0[{letter}{letter.upper()}]{pattern}+$"), F.coalesce(number, F.lit(1e18))).otherwise(value)
    return value


def number_or_null(c: Column | str) -> Column:
    """Finite number written in plain, exponent, hex, octal or binary notation, else NULL."""
    infinite = float("inf")
    return _via(
        js_trim(_col(c).cast("string")), _parsed, lambda v: F.when((v < infinite) & (v > -infinite), v)
    )


def quantity_or_null(c: Column | str) -> Column:
    """Positive whole number that fits an integer column, else NULL."""

    def whole(v: Column) -> Column:
        return F.when((v == F.floor(v)) & (v > 0) & (v <= 2147483647), v.cast("int"))

    return _via(js_trim(_col(c).cast("string")), _parsed, whole)


def to_list(c: Column | str, is_array: bool = False) -> Column:
    """Comma text (or an array) as a list of trimmed non-empty strings."""
    c = _col(c)
    if is_array:
        parts = F.transform(c, lambda x: js_trim(F.coalesce(x.cast("string"), F.lit("null"))))
    else:
        parts = F.transform(F.split(c, ","), js_trim)
    kept = F.filter(parts, lambda x: x != "")
    return F.coalesce(kept, F.array().cast("array<string>"))


def strip_volume_prefix(c: Column | str) -> Column:
    """Remove the first occurrence of the volume prefix only."""
    return F.regexp_replace(_col(c), f"(?s)^(.*?){VOLUME_PREFIX}", "$1")


def canonical_volume(c: Column | str) -> Column:
    return F.concat(F.lit(VOLUME_PREFIX), strip_volume_prefix(c))


def volume_number(c: Column | str) -> Column:
    return number_or_null(strip_volume_prefix(F.coalesce(_col(c), F.lit(""))))


def book_volume(book_id: Column | str) -> Column:
    """Volume part of a ``title::volume`` id."""
    return F.nullif(F.get(F.split(_col(book_id), ID_DELIMITER), F.lit(1)), F.lit(""))


def requested_book(book_id: Column | str, title: Column | str, volume: Column | str) -> Column:
    """Struct(title, volume) a command asks for; a composite id decides the title
    and fills in the volume when none is given."""
    key = text_or_null(book_id)
    parts = F.split(key, ID_DELIMITER)
    composite = F.coalesce(F.contains(key, F.lit(ID_DELIMITER)), F.lit(False))
    asked_volume = text_or_null(volume)
    return F.struct(
        F.when(composite, text_or_null(F.get(parts, F.lit(0)))).otherwise(text_or_null(title)).alias("title"),
        F.when(composite, F.coalesce(asked_volume, text_or_null(F.get(parts, F.lit(1)))))
        .otherwise(asked_volume)
        .alias("volume"),
    )


def distinct_ids(ids: Column | str) -> Column:
    """Trimmed non-empty ids in first-seen order without repeats."""
    trimmed = F.transform(_col(ids), lambda x: js_trim(F.coalesce(x.cast("string"), F.lit(""))))
    kept = F.array_distinct(F.filter(trimmed, lambda x: x != ""))
    return F.coalesce(kept, F.array().cast("array<string>"))


def repaired_volume(cover: Column | str, book_id: Column | str) -> Column:
    """Volume worked out from the cover name, else the id's digits, else 1."""
    from_cover = F.nullif(F.regexp_extract(_col(cover), "_vol_([0-9]+)", 1), F.lit(""))
    from_id = F.nullif(F.ltrim(F.regexp_extract(_col(book_id), r"([0-9]+)\z", 1), F.lit("0")), F.lit(""))
    return F.concat(F.lit(VOLUME_PREFIX), F.coalesce(from_cover, from_id, F.lit("1")))


def cover_or_fallback(item_cover: Column | str, book_cover: Column | str) -> Column:
    return F.coalesce(F.nullif(_col(item_cover), F.lit("")), _col(book_cover), F.lit(""))


def delivery_fee(subtotal: Column | str) -> Column:
    subtotal = _col(subtotal)
    fee = F.round(subtotal * F.lit(FEE_RATE), 2).cast(WIDE_MONEY)
    return F.when(subtotal > 0, fee).otherwise(F.lit(0).cast(WIDE_MONEY))


def display_price(price: Column | str) -> Column:
    return (_col(price) - F.lit(Decimal("0.01"))).cast(MONEY)


def money_text(c: Column | str) -> Column:
    """Two-decimal text, halves rounded up."""
    return F.round(_col(c), 2).cast(WIDE_MONEY).cast("string")


def clamp_quantity(quantity: Column | str, step: Column | int) -> Column:
    return F.greatest(
        F.least(_col(quantity) + step, F.lit(MAX_STEP_QUANTITY)), F.lit(MIN_STEP_QUANTITY)
    )


# Characters a URL component leaves as they are but url_encode escapes.
_URL_LITERALS = (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"))


def encode_component(c: Column | str) -> Column:
    out = F.replace(F.url_encode(_col(c)), F.lit("+"), F.lit("%20"))
    for escaped, plain in _URL_LITERALS:
        out = F.replace(out, F.lit(escaped), F.lit(plain))
    return out


def decode_component(c: Column | str) -> Column:
    return F.url_decode(F.replace(_col(c), F.lit("+"), F.lit("%2B")))


def book_link(title: Column | str, volume: Column | str) -> Column:
    return F.concat(
        F.lit("/book/"),
        encode_component(title),
        F.lit("/"),
        F.coalesce(_col(volume).cast("string"), F.lit("null")),
    )


def derived_id(*parts: Column | str) -> Column:
    """Repeatable id in UUID shape from the given parts."""
    digest = F.md5(F.concat_ws("|", *[_col(p).cast("string") for p in parts]))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
