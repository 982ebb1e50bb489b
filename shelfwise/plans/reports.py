"""Executive reports: sales, velocity, valuation, dashboard, shares."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, labels
from ..functions.values import MONEY, big, contains_any, money, share, units
from ..sources.tables import Tables
from .batches import near_expiry_count, stock_by_product
from .catalog import low_stock_count, with_category
from .period import within


def _or_zero(column: str, kind: str = "bigint") -> Column:
    return F.coalesce(F.col(column), F.lit(0).cast(kind))


def _sales(tables: Tables, period: str | None = None) -> DataFrame:
    return within(tables.movements, period, tables.as_of).filter(F.col("txn_type") == "SALE")


def sales_summary(tables: Tables, period: str | None = None) -> DataFrame:
    """Totals over all sales. Discounts are already inside the amounts, so gross equals net."""
    amount = money(F.coalesce(F.sum("total_amount"), F.lit(0)))
    return _sales(tables, period).agg(
        big(F.count_distinct("invoice_ref")).alias("total_bills"),
        big(F.coalesce(F.sum(units()), F.lit(0))).alias("total_units_sold"),
        amount.alias("gross_sales"),
        money(F.coalesce(F.sum("discount_amount"), F.lit(0))).alias("total_discounts"),
        amount.alias("net_revenue"),
    )


def sales_by_product(tables: Tables, period: str | None = None) -> DataFrame:
    return _sales(tables, period).groupBy("product_id").agg(
        big(F.sum(units())).alias("total_sold"), money(F.sum("total_amount")).alias("total_revenue")
    )


def sales_by_category(tables: Tables, period: str | None = None, search: str | None = None) -> DataFrame:
    """Sales rolled up to products first, then to categories: distinct products become a count."""
    products = tables.products.select("id", "category_id")
    sold = sales_by_product(tables, period).join(products, F.col("product_id") == F.col("id"))
    rows = (
        with_category(sold, tables.categories)
        .groupBy("_category", "category_name", "domain_type")
        .agg(
            big(F.count(F.lit(1))).alias("total_products_sold"),
            big(F.sum("total_sold")).alias("total_units_sold"),
            money(F.sum("total_revenue")).alias("revenue"),
        )
        .select(
            labels.category_label().alias("category_name"),
            labels.domain_label().alias("domain_type"),
            "total_products_sold",
            "total_units_sold",
            "revenue",
        )
    )
    return _search_category(rows, search).orderBy(F.desc("revenue"), "category_name")


def _search_category(rows: DataFrame, search: str | None) -> DataFrame:
    return rows.filter(contains_any(search, "category_name")) if search else rows


def _product_activity(tables: Tables, sold: DataFrame | None = None) -> DataFrame:
    """Every product with its stock, batch count and sales; both sides are summed before the join."""
    stock = stock_by_product(tables.stock).withColumnRenamed("product_id", "_stocked")
    sold = (sales_by_product(tables) if sold is None else sold).withColumnRenamed("product_id", "_sold")
    return (
        tables.products.join(stock, F.col("id") == F.col("_stocked"), "left")
        .join(sold, F.col("id") == F.col("_sold"), "left")
        .drop("_stocked", "_sold")
        .withColumn("current_stock", _or_zero("total_stock"))
        .withColumn("total_units_sold", _or_zero("total_sold"))
        .withColumn("total_revenue", _or_zero("total_revenue", MONEY))
        .withColumn("batch_count", _or_zero("batch_count"))
    )


def velocity_by_product(tables: Tables, sold: DataFrame | None = None) -> DataFrame:
    """Stock, units sold, revenue and demand class of every product; ``sold`` gives sales per product where they are at hand."""
    return (
        with_category(_product_activity(tables, sold), tables.categories)
        .select(
            "id", "sku", "title", "min_reorder_level", "unit_of_measure",
            labels.category_label().alias("category_name"),
            "current_stock", "total_units_sold", "total_revenue",
            labels.velocity_class().alias("velocity_status"),
        )
        .orderBy(F.desc("total_units_sold"), "id")
    )


def velocity_by_category(tables: Tables, *, per_batch: bool = True, search: str | None = None) -> DataFrame:
    """Demand per category.

    With ``per_batch`` each product's sales and class count once per batch it has (once
    without a batch), the figures of a plain join of batches and sales. That weight is
    applied to summed rows, so the join never multiplies them. Without it every product
    counts once.
    """
    weight = F.greatest(F.col("batch_count"), F.lit(1)) if per_batch else F.lit(1)
    sold = F.col("total_units_sold")
    rows = (
        with_category(_product_activity(tables), tables.categories)
        .withColumn("_weight", weight)
        .groupBy("_category", "category_name")
        .agg(
            big(F.count(F.lit(1))).alias("total_products"),
            big(F.sum("current_stock")).alias("total_stock"),
            big(F.sum(sold * F.col("_weight"))).alias("total_units_sold"),
            money(F.sum(F.col("total_revenue") * F.col("_weight"))).alias("total_revenue"),
            big(F.sum(F.when(sold >= 10, F.col("_weight")).otherwise(0))).alias("fast_products_count"),
            big(F.sum(F.when(sold == 0, F.col("_weight")).otherwise(0))).alias("dead_products_count"),
        )
        .withColumn("category_name", labels.category_label())
        .drop("_category")
    )
    return _search_category(rows, search).orderBy(F.desc("total_units_sold"), "category_name")


def velocity_drilldown(
    tables: Tables, category: str, status: str | None = None, search: str | None = None
) -> DataFrame:
    rows = velocity_by_product(tables).filter(F.col("category_name") == category)
    if status and status != "ALL":
        rows = rows.filter(F.col("velocity_status") == status)
    return rows.filter(contains_any(search, "title", "sku")) if search else rows


def velocity_status_counts(tables: Tables) -> DataFrame:
    """Products per demand class."""
    stockless = tables.products.select("id").join(
        sales_by_product(tables).select(F.col("product_id").alias("_sold"), "total_sold"),
        F.col("id") == F.col("_sold"),
        "left",
    )
    status = labels.velocity_class(_or_zero("total_sold"))
    return stockless.groupBy(status.alias("velocity_status")).agg(big(F.count(F.lit(1))).alias("products"))


def _value_by_product(tables: Tables) -> DataFrame:
    qty, cost, price = F.col("available_qty"), F.col("purchase_price"), F.col("selling_price")
    return tables.product_batches.groupBy(F.col("product_id").alias("_stocked")).agg(
        big(F.sum(qty)).alias("total_stock"),
        money(F.sum(qty * cost)).alias("total_cost_value"),
        money(F.sum(qty * price)).alias("total_selling_value"),
        money(F.sum(qty * (price - cost))).alias("projected_margin"),
    )


_VALUES = ["total_cost_value", "total_selling_value", "projected_margin"]


def valuation_by_product(tables: Tables) -> DataFrame:
    joined = tables.products.join(_value_by_product(tables), F.col("id") == F.col("_stocked"), "left")
    return (
        with_category(joined, tables.categories)
        .select(
            "id", "sku", "title", "domain_preset",
            labels.category_label().alias("category_name"),
            _or_zero("total_stock").alias("total_stock"),
            *[_or_zero(v, MONEY).alias(v) for v in _VALUES],
        )
        .orderBy(F.desc("total_cost_value"), "id")
    )


def valuation_by_category(tables: Tables, search: str | None = None) -> DataFrame:
    joined = tables.products.select("id", "category_id").join(
        _value_by_product(tables), F.col("id") == F.col("_stocked"), "left"
    )
    rows = (
        with_category(joined, tables.categories)
        .groupBy("_category", "category_name", "domain_type")
        .agg(
            big(F.count(F.lit(1))).alias("total_products"),
            big(F.coalesce(F.sum("total_stock"), F.lit(0))).alias("total_stock"),
            *[money(F.coalesce(F.sum(v), F.lit(0))).alias(v) for v in _VALUES],
        )
        .withColumn("category_name", labels.category_label())
        .withColumn("domain_type", labels.domain_label())
        .drop("_category")
    )
    return _search_category(rows, search).orderBy(F.desc("total_cost_value"), "category_name")


#: Names of the levels of a report by domain and category, by the columns that a row leaves out.
LEVELS = {0: "CATEGORY", 1: "DOMAIN", 3: "TOTAL"}


def _by_level(rows: DataFrame, *figures: Column) -> DataFrame:
    """Categories, domains and the total from one aggregation over the products' rows."""
    keyed = rows.withColumn("domain_type", labels.domain_label()).withColumn("category", F.struct("_category", labels.category_label().alias("name")))
    level = F.grouping_id("domain_type", "category").cast("int")
    return keyed.rollup("domain_type", "category").agg(level.alias("_level"), *figures).select(
        F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])[F.col("_level")].alias("level"),
        "domain_type", F.col("category.name").alias("category_name"), F.expr("* EXCEPT (domain_type, category, _level)"),
    )


def sales_by_level(tables: Tables, period: str | None = None) -> DataFrame:
    """Products sold, units and revenue of every category, every domain and altogether."""
    products = tables.products.select("id", "category_id")
    sold = sales_by_product(tables, period).join(products, F.col("product_id") == F.col("id"))
    return _by_level(
        with_category(sold, tables.categories), big(F.count(F.lit(1))).alias("total_products_sold"),
        big(F.coalesce(F.sum("total_sold"), F.lit(0))).alias("total_units_sold"),
        money(F.coalesce(F.sum("total_revenue"), F.lit(0))).alias("revenue"),
    )


def valuation_by_level(tables: Tables) -> DataFrame:
    """Products, stock and values of every category, every domain and altogether."""
    joined = tables.products.select("id", "category_id").join(_value_by_product(tables), F.col("id") == F.col("_stocked"), "left")
    return _by_level(
        with_category(joined, tables.categories), big(F.count(F.lit(1))).alias("total_products"),
        big(F.coalesce(F.sum("total_stock"), F.lit(0))).alias("total_stock"),
        *[money(F.coalesce(F.sum(v), F.lit(0))).alias(v) for v in _VALUES],
    )


def valuation_totals(tables: Tables) -> DataFrame:
    qty = F.col("available_qty")
    known = tables.products.select(F.col("id").alias("product_id"))
    return (
        tables.product_batches.join(known, "product_id", "left_semi")
        .agg(
            money(F.coalesce(F.sum(qty * F.col("purchase_price")), F.lit(0))).alias("total_cost_value"),
            money(F.coalesce(F.sum(qty * F.col("selling_price")), F.lit(0))).alias("total_selling_value"),
        )
    )


def valuation_drilldown(tables: Tables, category: str, search: str | None = None) -> DataFrame:
    rows = valuation_by_product(tables).filter(F.col("category_name") == category)
    return rows.filter(contains_any(search, "title", "sku")) if search else rows


def dashboard_stats(tables: Tables) -> DataFrame:
    """Receipts and sales of the day and of all time in one pass, with the two alert counts."""
    day = dates.day_start(tables.as_of, tables.movements.schema["txn_date"].dataType)
    next_day = dates.day_start(tables.as_of + timedelta(days=1), tables.movements.schema["txn_date"].dataType)
    today = (F.col("txn_date") >= day) & (F.col("txn_date") < next_day)

    def figures(kind: str, name: str) -> list:
        is_kind = F.col("txn_type") == kind
        return [
            figure
            for when, prefix in ((is_kind & today, "today"), (is_kind, "all_time"))
            for figure in (
                big(F.count_if(when)).alias(f"{prefix}_{name}_count"),
                money(F.coalesce(F.sum(F.when(when, F.col("total_amount"))), F.lit(0))).alias(f"{prefix}_{name}_value"),
            )
        ]

    ledger = tables.movements.filter(F.col("txn_type").isin("STOCK_IN", "SALE")).agg(
        *figures("STOCK_IN", "stock_in"), *figures("SALE", "stock_out")
    )
    alerts = [low_stock_count(tables), near_expiry_count(tables)]
    for single_row in alerts:
        ledger = ledger.withColumn(single_row.columns[0], single_row.scalar())
    return ledger


def dashboard_headline(tables: Tables) -> DataFrame:
    """Two headline cards: the day's value, or the lifetime value on a day without any."""
    stats = dashboard_stats(tables).drop("low_stock_count", "near_expiry_count")

    def text(value):
        return value.cast("string")

    def card(name: str, noun: str):
        count, value, life = (
            F.col(f"today_{name}_count"), F.col(f"today_{name}_value"), F.col(f"all_time_{name}_value")
        )
        caption = F.concat(
            F.lit("Today: "), text(count), F.lit(f" {noun} (₹"), text(value), F.lit(") | Lifetime: ₹"), text(life)
        )
        return F.struct(
            F.lit(name).alias("card"),
            F.when(value > 0, value).otherwise(life).alias("headline_value"),
            caption.alias("caption"),
        )

    return stats.select(F.explode(F.array(card("stock_in", "entries"), card("stock_out", "sales"))).alias("c")).select(
        "c.*"
    )


def with_share(report: DataFrame, measure: str) -> DataFrame:
    """Label, measure and share of the total of a category report.

    The report has one row per category, so the single window partition is as small as
    the category table.
    """
    return report.select(
        "category_name", measure, share(measure, F.sum(measure).over(Window.partitionBy())).alias("share")
    )
