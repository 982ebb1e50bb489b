"""Numbers and text: defaults, parsing of request text, rounding, money."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
PRICE = "decimal(10,2)"
EXACT = "decimal(18,6)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def money(x: Column | str) -> Column:
    return _c(x).cast(MONEY)


def big(x: Column | str) -> Column:
    return _c(x).cast("bigint")


def units(quantity: Column | str = "quantity") -> Column:
    """Moved units whatever sign the writer used."""
    return F.abs(_c(quantity))


def signed_units(quantity: Column | str = "quantity", txn_type: Column | str = "txn_type") -> Column:
    """Units as the stock feels them: receipts add, every other movement takes away."""
    return F.when(_c(txn_type) == "STOCK_IN", units(quantity)).otherwise(-units(quantity))


def text_or(x: Column | str, default: str | Column) -> Column:
    """Default for a missing or empty text."""
    d = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(_c(x), F.lit("")), d)


def number_or(x: Column | str, default) -> Column:
    """Default for a missing number and for zero."""
    return F.coalesce(F.nullif(_c(x), F.lit(0)), F.lit(default))


def first_text(*xs: Column | str, default: str | None = None) -> Column:
    """First of the texts that is neither missing nor empty."""
    picks = [F.nullif(_c(x), F.lit("")) for x in xs]
    return F.coalesce(*picks, *([F.lit(default)] if default is not None else []))


def parse_int(x: Column | str) -> Column:
    """Leading whole number of a text, NULL when there is none or it does not fit."""
    return F.regexp_extract(_c(x), r"^\s*([+-]?\d+)", 1).try_cast("int")


def parse_decimal(x: Column | str, default=None) -> Column:
    """Leading decimal number of a text."""
    number = F.regexp_extract(_c(x), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast(EXACT)
    return number if default is None else F.coalesce(number, F.lit(default).cast(EXACT))


def round2(x: Column | str) -> Column:
    """Two places, ties away from zero, on decimals."""
    return F.round(_c(x), 2).cast(MONEY)


def share(part: Column | str, total: Column | str) -> Column:
    return F.round(_c(part).cast("double") / F.nullif(_c(total).cast("double"), F.lit(0.0)), 6)


def like_any(term: str, *xs: Column | str) -> Column:
    """Case-insensitive substring match in any column; % and _ in the term are wildcards."""
    return reduce(Column.__or__, [F.coalesce(F.ilike(_c(x), F.lit(f"%{term}%")), F.lit(False)) for x in xs])


def contains_any(term: str, *xs: Column | str) -> Column:
    """Case-insensitive substring match in any column, term taken literally."""
    t = term.lower()
    return reduce(Column.__or__, [F.coalesce(F.lower(_c(x)).contains(t), F.lit(False)) for x in xs])
