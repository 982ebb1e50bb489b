"""Reporting dates: periods of the ledger and the three meanings of near expiry."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampType

from .fixed import NEAR_EXPIRY_DAYS


def period_bounds(period: str | None, as_of: date) -> tuple[date | None, date | None]:
    """Half-open day range [from, to) of a named period; None means unbounded."""
    if period == "TODAY":
        return as_of, as_of + timedelta(days=1)
    if period == "THIS_WEEK":
        return as_of - timedelta(days=7), None
    if period == "THIS_MONTH":
        start = as_of.replace(day=1)
        return start, (start + timedelta(days=32)).replace(day=1)
    if period == "THIS_YEAR":
        return date(as_of.year, 1, 1), date(as_of.year + 1, 1, 1)
    return None, None


def day_start(day: date, column_type: DataType = TimestampType()) -> Column:
    """Midnight as a literal of the column's own type, so that the comparison reaches the scan."""
    stamp = datetime.combine(day, time()).isoformat(sep=" ")
    return F.lit(stamp).cast(column_type)


def days_to_expiry(as_of: date, expiry: str = "expiry_date") -> Column:
    return F.datediff(F.col(expiry), F.lit(as_of))


def expires_soon_or_expired(as_of: date, expiry: str = "expiry_date") -> Column:
    """List form: in stock and expiring up to the horizon, expired stock included."""
    horizon = as_of + timedelta(days=NEAR_EXPIRY_DAYS)
    return F.col(expiry).isNotNull() & (F.col(expiry) <= F.lit(horizon)) & (F.col("available_qty") > 0)


def expires_in_window(as_of: date, expiry: str = "expiry_date") -> Column:
    """Window form: in stock and expiring between the day and the horizon, both included."""
    horizon = as_of + timedelta(days=NEAR_EXPIRY_DAYS)
    return F.col(expiry).between(F.lit(as_of), F.lit(horizon)) & (F.col("available_qty") > 0)


def near_expiry_flag(as_of: date, expiry: str = "expiry_date") -> Column:
    """Batch form: 1 when the batch has an expiry date at most the horizon away."""
    return F.when(days_to_expiry(as_of, expiry) <= NEAR_EXPIRY_DAYS, 1).otherwise(0)
