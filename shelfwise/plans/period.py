"""Movements of a named period."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day_start, period_bounds

DAY_FOLDER = "txn_day"


def within(rows: DataFrame, period: str | None, as_of: date) -> DataFrame:
    """Rows of the period, by plain ranges that reach the scan.

    Where the ledger is stored in day folders, the same range on the folder column
    skips whole folders; the column is dropped again.
    """
    start, end = period_bounds(period, as_of)
    stamp = rows.schema["txn_date"].dataType
    for bound, test in ((start, "__ge__"), (end, "__lt__")):
        if bound is None:
            continue
        rows = rows.filter(getattr(F.col("txn_date"), test)(day_start(bound, stamp)))
        if DAY_FOLDER in rows.columns:
            rows = rows.filter(getattr(F.col(DAY_FOLDER), test)(F.lit(bound)))
    return rows.drop(DAY_FOLDER)
