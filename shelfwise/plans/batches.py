"""Stock batches: first-expired-first-out order, expiry, offers, balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, labels
from ..functions.values import big, first_text, money, round2, signed_units
from ..operators.running import in_chunks, running_before
from ..sources.tables import Tables

def fefo_order() -> list[Column]:
    """Earliest expiry first, batches without expiry last, older batch first."""
    return [F.asc_nulls_last("expiry_date"), F.asc("id")]


def stock_by_product(batches: DataFrame) -> DataFrame:
    """Units on hand and number of batches of each product that has a batch."""
    return batches.groupBy("product_id").agg(
        big(F.sum("available_qty")).alias("total_stock"), big(F.count("id")).alias("batch_count")
    )


def in_stock(tables: Tables, product_id: int | None = None) -> DataFrame:
    """Batches in issue order, of one product or of all of them product by product."""
    rows = tables.product_batches.filter(F.col("available_qty") > 0)
    if product_id is not None:
        rows = rows.filter(F.col("product_id") == product_id)
    flagged = rows.select(
        "*",
        dates.days_to_expiry(tables.as_of).alias("days_to_expiry"),
        dates.near_expiry_flag(tables.as_of).alias("is_near_expiry"),
    )
    return flagged.orderBy(*([] if product_id is not None else [F.asc("product_id")]), *fefo_order())


def fefo_pick(tables: Tables) -> DataFrame:
    """The batch to issue first, for every product with stock.

    A minimum over (no expiry, expiry, id) combines on the map side, so a product
    with very many batches costs no more than any other.
    """
    rank = F.struct(F.col("expiry_date").isNull(), "expiry_date", "id")
    rest = F.struct("id", "batch_number", "expiry_date", "available_qty", "selling_price")
    return (
        tables.product_batches.filter(F.col("available_qty") > 0)
        .groupBy("product_id")
        .agg(F.min_by(rest, rank).alias("b"))
        .select(
            "product_id",
            F.col("b.id").alias("batch_id"),
            "b.batch_number",
            "b.expiry_date",
            "b.available_qty",
            "b.selling_price",
        )
    )


def near_expiry(tables: Tables) -> DataFrame:
    """In-stock batches that expire within the horizon or have expired already."""
    names = tables.products.select(
        F.col("id").alias("product_id"),
        F.col("title").alias("product_title"),
        F.col("sku").alias("product_sku"),
        "unit_of_measure",
    )
    return (
        tables.product_batches.filter(dates.expires_soon_or_expired(tables.as_of))
        .join(names, "product_id")
        .withColumn("days_to_expiry", dates.days_to_expiry(tables.as_of))
        .orderBy("expiry_date", "id")
    )


def near_expiry_count(tables: Tables) -> DataFrame:
    return tables.stock.filter(dates.expires_in_window(tables.as_of)).agg(
        big(F.count(F.lit(1))).alias("near_expiry_count")
    )


def offered_discount(tables: Tables) -> DataFrame:
    """Discount per unit that the batch's own offer gives."""
    percent = F.col("batch_discount_percent")
    off = F.when(percent > 0, round2(F.col("selling_price") * percent / 100)).otherwise(F.lit(0).cast("decimal(18,2)"))
    return tables.product_batches.select(
        F.col("id").alias("batch_id"), "batch_number", money("selling_price").alias("selling_price"),
        percent, money(off).alias("discount_amount"),
    )


def display(tables: Tables, no_offer: str = "Regular Stock") -> DataFrame:
    """Batch texts; pick lists say 'Regular Price' and alerts 'Near Expiry' where there is no offer."""
    return tables.stock.select(
        F.col("id").alias("batch_id"),
        "batch_number",
        labels.iso_day("expiry_date", "N/A").alias("expiry_text"),
        "available_qty",
        first_text("offer_description", default=no_offer).alias("offer_text"),
    )


def reconcile(tables: Tables) -> DataFrame:
    """Ledger balance of every batch against the balance on hand; a report, not a rule."""
    booked = (
        tables.movements.filter(F.col("batch_id").isNotNull())
        .groupBy("batch_id")
        .agg(big(F.sum(signed_units())).alias("ledger_qty"))
    )
    held = tables.stock.select(F.col("id").alias("batch_id"), big("available_qty").alias("on_hand_qty"))
    both = held.join(booked, "batch_id", "full_outer")
    gap = F.coalesce("on_hand_qty", F.lit(0)) - F.coalesce("ledger_qty", F.lit(0))
    return both.select("batch_id", "ledger_qty", "on_hand_qty", gap.alias("difference"), (gap == 0).alias("reconciles"))


def first_divergence(movements: DataFrame, counts: DataFrame) -> DataFrame:
    """Per counted batch, the first day on which a stock count differs from what the ledger had booked by then.

    ``counts`` holds (batch_id, count_day, counted) of counts made apart from the ledger, on any
    days. A count is set against the movements up to the end of its day. Returns every counted
    batch with the number of counts, its first differing day (NULL if there is none) with both
    figures, and the last day before it that still agreed, which bounds where to look.
    """
    moved = movements.filter(F.col("batch_id").isNotNull() & F.col("txn_date").isNotNull())
    by_day = moved.groupBy("batch_id", F.to_date("txn_date").alias("day")).agg(big(F.sum(signed_units())).alias("delta"))
    none = F.lit(None).cast("bigint")
    # within a day, its movements come before its count
    rows = by_day.select("batch_id", F.struct("day", F.lit(0).alias("kind")).alias("at"), "delta", none.alias("counted"))
    days = counts.select("batch_id", F.struct(F.col("count_day").alias("day"), F.lit(1).alias("kind")).alias("at"), F.lit(0).cast("bigint").alias("delta"), big("counted").alias("counted"))
    placed = in_chunks(rows.unionByName(days), "batch_id", "at")
    found = running_before(placed, "batch_id", "at", {"booked": F.col("delta")}).filter(F.col("counted").isNotNull())
    differs = F.col("counted") != F.col("booked")
    found = found.select("batch_id", "at.day", "booked", "counted", differs.alias("differs"))
    wrong = F.min(F.when(F.col("differs"), F.struct("day", "booked", "counted"))).alias("first")
    firsts = found.groupBy("batch_id").agg(big(F.count(F.lit(1))).alias("counts"), wrong)
    right = ~F.col("differs") & (F.col("first").isNull() | (F.col("day") < F.col("first.day")))
    return found.join(firsts, "batch_id").groupBy("batch_id").agg(
        F.first("counts").alias("counts"), F.first("first.day").alias("first_wrong_day"), F.first("first.booked").alias("booked"),
        F.first("first.counted").alias("counted"), F.max(F.when(right, F.col("day"))).alias("last_right_day"),
    )
