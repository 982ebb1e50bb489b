"""Live figures over the stream of movements. No row is too late for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import big, money, units
from .runs import keyed_state


def daily_totals(movements: DataFrame) -> DataFrame:
    """Count, units and value per day and type, for output mode update.

    A late movement corrects its day. The state is one row per calendar day and type, so it
    needs no watermark to stay small.
    """
    return movements.groupBy(F.to_date("txn_date").alias("txn_day"), "txn_type").agg(
        big(F.count(F.lit(1))).alias("movements"),
        big(F.sum(units())).alias("units"),
        money(F.sum("total_amount")).alias("total_value"),
    )


def first_only(movements: DataFrame) -> DataFrame:
    """Movements without those sent before, however long ago: the same number on the same day.

    The numbers seen are keys of Spark's state store, which looks up those of a micro-batch
    and no others. None is forgotten, as a repeat may come at any time.
    """
    keyed_state(movements.sparkSession)
    columns = movements.columns
    return movements.withColumn("txn_day", F.to_date("txn_date")).dropDuplicates(["txn_day", "txn_number"]).select(*columns)
