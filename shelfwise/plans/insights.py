"""Recommendations drawn from stock, expiry and sales."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, labels
from ..functions.fixed import INSIGHTS_PER_RULE, STOCKOUT_UNITS
from ..functions.values import big
from ..sources.tables import Tables
from .batches import stock_by_product
from .reports import sales_by_product


def sold_products(tables: Tables) -> DataFrame:
    return tables.movements.filter(F.col("txn_type") == "SALE").select("product_id").distinct()


def never_sold(tables: Tables) -> DataFrame:
    sold = tables.movements.filter(F.col("txn_type") == "SALE").select(F.col("product_id").alias("id"))
    return tables.products.select("id", "sku", "title").join(sold.distinct(), "id", "left_anti")


def stockout_candidates(tables: Tables) -> DataFrame:
    """Products that sell and have run down to their reorder level."""
    sold = sales_by_product(tables).filter(F.col("total_sold") >= STOCKOUT_UNITS)
    stock = stock_by_product(tables.stock).withColumnRenamed("product_id", "_stocked")
    return (
        tables.products.join(
            sold.select(F.col("product_id").alias("id"), F.col("total_sold").alias("sold")), "id"
        )
        .join(stock, F.col("id") == F.col("_stocked"), "left")
        .withColumn("stock", F.coalesce("total_stock", F.lit(0).cast("bigint")))
        .filter(F.col("stock") <= F.col("min_reorder_level"))
        .select("id", "sku", "title", "stock", "sold")
    )


def clearance_candidates(tables: Tables) -> DataFrame:
    """In-stock batches that expire within the window."""
    titles = tables.products.select(F.col("id").alias("product_id"), "title")
    return (
        tables.stock.filter(dates.expires_in_window(tables.as_of))
        .join(titles, "product_id")
        .select("id", "batch_number", "available_qty", "expiry_date", "title")
    )


def dead_stock_candidates(tables: Tables) -> DataFrame:
    """Products with stock that were never sold."""
    stock = stock_by_product(tables.stock).filter(F.col("total_stock") > 0)
    return never_sold(tables).join(
        stock.select(F.col("product_id").alias("id"), F.col("total_stock").alias("stock")), "id"
    )


def _insight(rows: DataFrame, order: list, rule: int, kind: str, icon: str, title, description) -> DataFrame:
    """The rule's first rows as insight rows, numbered by rule and place."""
    top = rows.orderBy(*order).limit(INSIGHTS_PER_RULE)
    return top.select(
        F.lit(rule).alias("rule"),
        big(F.row_number().over(Window.orderBy(*order))).alias("place"),
        F.lit(kind).alias("type"),
        F.lit(icon).alias("icon"),
        title.alias("title"),
        description.alias("description"),
    )


def stockout(tables: Tables) -> DataFrame:
    return _insight(
        stockout_candidates(tables), [F.desc("sold"), F.asc("id")], 1, "DANGER", "🚀",
        F.concat(F.lit("Fast-Moving Stockout Risk: "), "title"),
        F.format_string(
            "This product sold %d units recently but current stock is down to %d! "
            "Place a reorder now to prevent sales revenue loss.", "sold", "stock",
        ),
    )


def clearance(tables: Tables) -> DataFrame:
    return _insight(
        clearance_candidates(tables), [F.asc("expiry_date"), F.asc("id")], 2, "WARNING", "🏷️",
        F.concat(F.lit("Clearance Discount Strategy: Batch "), "batch_number"),
        F.format_string(
            '%d units of "%s" expire on %s. '
            "Apply a 20-30%% clearance discount in Stock Out form to recover capital!",
            "available_qty", "title", labels.iso_day("expiry_date"),
        ),
    )


def dead_stock(tables: Tables) -> DataFrame:
    return _insight(
        dead_stock_candidates(tables), [F.asc("id")], 3, "INFO", "💡",
        F.concat(F.lit("Unlock Capital from Dead Stock: "), "title"),
        F.format_string(
            "Has %d units in inventory but zero recent sales. "
            "Create a promotional bundle or BOGO offer to liquidate stock and release cash flow.", "stock",
        ),
    )


def smart_insights(tables: Tables) -> DataFrame:
    """The three rules in order, or one all-clear row when none of them fired."""
    found = stockout(tables).unionByName(clearance(tables)).unionByName(dead_stock(tables))
    row = F.struct(*found.columns)
    all_clear = F.struct(
        F.lit(4).alias("rule"),
        F.lit(1).cast("bigint").alias("place"),
        F.lit("SUCCESS").alias("type"),
        F.lit("✅").alias("icon"),
        F.lit("Optimal Inventory Health!").alias("title"),
        F.lit(
            "Stock levels are balanced, turnover velocity is steady, "
            "and no immediate expiry risks were detected."
        ).alias("description"),
    )
    # At most two rows per rule reach this aggregate, so the list holds six at most.
    listed = found.agg(F.sort_array(F.collect_list(row)).alias("rows"))
    shown = F.when(F.size("rows") > 0, F.col("rows")).otherwise(F.array(all_clear))
    return listed.select(F.explode(shown).alias("i")).select("i.*")
