"""Roll-ups of the ledger by day, kept up to date load by load, and reports from them.

A load's movements are summed per day, type and product and stored under the load's number,
so a load that is stored twice overwrites itself. Sums merge by adding, whatever the order:
a load that brings late movements adds rows for their days and rewrites nothing. Reports add
up the stored sums and those of the tail, movements that no load has stored yet.

Distinct bills do not add up. Bills are numbered densely as they first appear, and a load
stores one bitmap for each day and 32,768 numbers; bitmaps of any days merge by OR, so one
stored table answers every period exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import period_bounds
from ..functions.values import MONEY, big, money, units
from ..operators.lineage import cut
from ..operators.running import CHUNK, in_chunks
from ..sources.tables import Tables
from . import reports
from .batches import near_expiry_count
from .catalog import low_stock_count

SUMS = "txn_day date, txn_type string, product_id bigint, movements bigint, units bigint, total_amount decimal(38,2), discount_amount decimal(38,2)"
BITS = "txn_day date, bucket bigint, bits binary"
BILLS = "invoice_ref string, number bigint"


def day_sums(movements: DataFrame) -> DataFrame:
    """Partial sums per day, type and product; adding them up loses nothing."""
    return movements.groupBy(F.to_date("txn_date").alias("txn_day"), "txn_type", F.col("product_id").cast("bigint").alias("product_id")).agg(
        big(F.count(F.lit(1))).alias("movements"),
        big(F.sum(units())).alias("units"),
        F.sum("total_amount").cast("decimal(38,2)").alias("total_amount"),
        F.sum("discount_amount").cast("decimal(38,2)").alias("discount_amount"),
    )


def numbered(bills: DataFrame, after: int) -> DataFrame:
    """(invoice_ref, number) with numbers without gaps from ``after`` + 1 on, counted chunk by chunk."""
    placed = in_chunks(bills.select("invoice_ref").distinct(), "invoice_ref", "invoice_ref")
    sizes = placed.groupBy(CHUNK).agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per chunk
    inside = F.row_number().over(Window.partitionBy(CHUNK).orderBy("invoice_ref"))
    starts = sizes.select(CHUNK, before.alias("_before"))
    return placed.withColumn("_at", inside).join(starts, CHUNK).select("invoice_ref", (F.lit(after) + F.col("_before") + F.col("_at")).cast("bigint").alias("number"))


@dataclass(frozen=True)
class RollUps:
    """Stored sums, bill numbers and bitmaps of a ledger, one folder for each load."""

    spark: SparkSession
    root: str

    def _put(self, name: str, load: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/load={load}")

    def _all(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        try:
            rows = self.spark.read.schema(f"{schema}, load int").parquet(f"{self.root}/{name}")
        except Exception as error:  # nothing has been stored yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            rows = self.spark.createDataFrame([], f"{schema}, load int")
        return (rows if before is None else rows.where(F.col("load") < before)).drop("load")

    def add(self, load: int, movements: DataFrame) -> None:
        """Store the sums of one load; only its own days are touched. Loads are numbered from 0 in the order they come."""
        moves = cut(movements.select("txn_date", "txn_type", "product_id", "quantity", "total_amount", "discount_amount", "invoice_ref"), "load")
        sums = day_sums(moves)
        self._put("sums", load, sums.repartitionByRange("txn_day").sortWithinPartitions("txn_day"))
        sold = moves.where("txn_type = 'SALE' AND invoice_ref IS NOT NULL").select(F.to_date("txn_date").alias("txn_day"), "invoice_ref").distinct()
        known = self._all("bills", BILLS, load)
        last = known.agg(F.max("number")).first()[0] or 0
        fresh = sold.join(known, "invoice_ref", "left_anti")
        self._put("bills", load, numbered(fresh, last))
        numbers = sold.join(self._all("bills", BILLS, load + 1), "invoice_ref")
        self._put("bitmaps", load, bitmaps(numbers).sortWithinPartitions("txn_day"))

    def sums(self, tail: DataFrame | None = None) -> DataFrame:
        stored = self._all("sums", SUMS)
        return stored if tail is None else stored.unionByName(day_sums(tail))

    def bitmaps(self) -> DataFrame:
        return self._all("bitmaps", BITS)


def bitmaps(numbers: DataFrame) -> DataFrame:
    """One bitmap for each day and bucket of bill numbers."""
    bucket = F.bitmap_bucket_number("number").alias("bucket")
    return numbers.groupBy("txn_day", bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def within_days(rows: DataFrame, period: str | None, tables: Tables) -> DataFrame:
    """Stored rows of a period, by a range on the day that reaches the scan."""
    start, end = period_bounds(period, tables.as_of)
    if start is not None:
        rows = rows.where(F.col("txn_day") >= F.lit(start))
    return rows if end is None else rows.where(F.col("txn_day") < F.lit(end))


def distinct_bills(tables: Tables, stored: RollUps, period: str | None = None) -> DataFrame:
    """One row: the distinct bills of a period, from the bitmaps of its days."""
    merged = within_days(stored.bitmaps(), period, tables).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.agg(big(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0))).alias("total_bills"))


PERIODS = ["ALL", "TODAY", "THIS_WEEK", "THIS_MONTH", "THIS_YEAR"]


def bills_by_period(tables: Tables, stored: RollUps) -> DataFrame:
    """Distinct bills of every named period, in one pass over the bitmaps."""
    spans = []
    for period in PERIODS:
        start, end = period_bounds(period, tables.as_of)
        inside = F.lit(True) if start is None else F.col("txn_day") >= F.lit(start)
        spans.append((period, inside if end is None else inside & (F.col("txn_day") < F.lit(end))))
    named = F.explode(F.array_compact(F.array(*[F.when(inside, F.lit(period)) for period, inside in spans]))).alias("period")
    merged = stored.bitmaps().select(named, "bucket", "bits").groupBy("period", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    counts = merged.groupBy("period").agg(big(F.sum(F.bitmap_count("bits"))).alias("total_bills"))
    listed = stored.spark.createDataFrame([(p,) for p in PERIODS], "period string")
    return listed.join(counts, "period", "left").fillna(0, ["total_bills"])


def sales_summary(tables: Tables, stored: RollUps, period: str | None = None) -> DataFrame:
    """``reports.sales_summary`` from sums and bitmaps; every movement must be in a load."""
    sales = within_days(stored.sums(), period, tables).where("txn_type = 'SALE'")
    amount = money(F.coalesce(F.sum("total_amount"), F.lit(0)))
    row = sales.agg(
        big(F.coalesce(F.sum("units"), F.lit(0))).alias("total_units_sold"), amount.alias("gross_sales"),
        money(F.coalesce(F.sum("discount_amount"), F.lit(0))).alias("total_discounts"), amount.alias("net_revenue"),
    )
    return row.withColumn("total_bills", distinct_bills(tables, stored, period).scalar()).select(
        "total_bills", "total_units_sold", "gross_sales", "total_discounts", "net_revenue"
    )


def dashboard_stats(tables: Tables, stored: RollUps, tail: DataFrame | None = None) -> DataFrame:
    """``reports.dashboard_stats`` from the sums of the loads and of the tail."""
    sums = stored.sums(tail).where(F.col("txn_type").isin("STOCK_IN", "SALE"))
    today, figures = F.col("txn_day") == F.lit(tables.as_of), []
    for kind, name in (("STOCK_IN", "stock_in"), ("SALE", "stock_out")):
        for when, prefix in ((today & (F.col("txn_type") == kind), "today"), (F.col("txn_type") == kind, "all_time")):
            figures.append(big(F.coalesce(F.sum(F.when(when, F.col("movements"))), F.lit(0))).alias(f"{prefix}_{name}_count"))
            figures.append(money(F.coalesce(F.sum(F.when(when, F.col("total_amount"))), F.lit(0))).alias(f"{prefix}_{name}_value"))
    row = sums.agg(*figures)
    for alert in (low_stock_count(tables), near_expiry_count(tables)):
        row = row.withColumn(alert.columns[0], alert.scalar())
    return row


def velocity_by_product(tables: Tables, stored: RollUps, tail: DataFrame | None = None) -> DataFrame:
    """``reports.velocity_by_product`` with sales from the sums of the loads and of the tail."""
    sales = stored.sums(tail).where("txn_type = 'SALE'").groupBy("product_id")
    sold = sales.agg(big(F.sum("units")).alias("total_sold"), F.sum("total_amount").cast(MONEY).alias("total_revenue"))
    return reports.velocity_by_product(tables, sold)
