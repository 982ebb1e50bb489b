"""The product catalog: stock per product, filters, look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.fixed import TYPEAHEAD_ROWS
from ..functions.values import big, contains_any, first_text, like_any
from ..sources.tables import Tables
from .batches import stock_by_product


def with_category(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Adds category name and domain; NULL where the category is unknown."""
    names = categories.select(
        F.col("id").alias("_category"), F.col("name").alias("category_name"), "domain_type"
    )
    return products.join(names, F.col("category_id") == F.col("_category"), "left")


def with_stock(products: DataFrame, batches: DataFrame) -> DataFrame:
    """Adds units on hand and batch count; batches are summed before they meet the products."""
    stock = stock_by_product(batches).withColumnRenamed("product_id", "_stocked")
    return (
        products.join(stock, F.col("id") == F.col("_stocked"), "left")
        .drop("_stocked")
        .withColumn("total_stock", F.coalesce("total_stock", F.lit(0).cast("bigint")))
        .withColumn("batch_count", F.coalesce("batch_count", F.lit(0).cast("bigint")))
    )


def catalog(
    tables: Tables,
    *,
    domain: str | None = None,
    category_id: int | None = None,
    search: str | None = None,
    literal_search: str | None = None,
) -> DataFrame:
    """Products with category and stock, by title."""
    rows = tables.products
    if domain and domain != "ALL":
        rows = rows.filter(F.col("domain_preset") == domain)
    if category_id:
        rows = rows.filter(F.col("category_id") == category_id)
    if search:
        rows = rows.filter(like_any(search, "title", "sku", "barcode"))
    if literal_search:
        rows = rows.filter(contains_any(literal_search, "title", "sku"))
    named = with_category(rows, tables.categories).drop("_category", "domain_type")
    return with_stock(named, tables.stock).orderBy("title", "id")


def status(tables: Tables) -> DataFrame:
    """Stock badge of each product."""
    low = F.col("total_stock") <= F.col("min_reorder_level")
    unit = first_text("unit_of_measure", default="Pcs")
    stock = F.col("total_stock").cast("string")
    return with_stock(tables.products, tables.stock).select(
        "id",
        "sku",
        "total_stock",
        F.coalesce(low, F.lit(False)).alias("is_low"),
        F.when(low, F.concat(F.lit("⚠️ Low Stock ("), stock, F.lit(")")))
        .otherwise(F.concat(stock, F.lit(" "), unit))
        .alias("stock_label"),
    )


def low_stock(tables: Tables) -> DataFrame:
    """Products at or below their reorder level, emptiest first."""
    stocked = with_stock(tables.products, tables.stock)
    short = stocked.filter(F.col("total_stock") <= F.col("min_reorder_level"))
    return (
        with_category(short, tables.categories)
        .select(
            "id", "sku", "barcode", "title", "min_reorder_level", "unit_of_measure", "domain_preset",
            "category_name", "total_stock",
        )
        .orderBy("total_stock", "id")
    )


def low_stock_status(tables: Tables) -> DataFrame:
    return low_stock(tables).select(
        "id", "sku", "total_stock", "min_reorder_level", labels.alert_status().alias("status")
    )


def low_stock_count(tables: Tables) -> DataFrame:
    stocked = with_stock(tables.products.select("id", "min_reorder_level"), tables.stock)
    short = stocked.filter(F.col("total_stock") <= F.col("min_reorder_level"))
    return short.agg(big(F.count(F.lit(1))).alias("low_stock_count"))


def by_name(rows: DataFrame) -> DataFrame:
    return rows.orderBy("name", "id")


def _pick_list(rows: DataFrame, title: str, subtitle: Column, term: str) -> DataFrame:
    wanted = term.strip()
    listed = rows.select("id", F.col(title).alias("title"), subtitle.alias("subtitle"))
    return listed.filter(contains_any(wanted, "title", "subtitle")).orderBy("title", "id").limit(TYPEAHEAD_ROWS)


def typeahead_products(tables: Tables, term: str) -> DataFrame:
    return _pick_list(
        with_stock(tables.products, tables.stock), "title", labels.product_subtitle(), term
    )


def typeahead_suppliers(tables: Tables, term: str) -> DataFrame:
    return _pick_list(tables.suppliers, "name", labels.contact_subtitle(), term)


def typeahead_categories(tables: Tables, term: str) -> DataFrame:
    return _pick_list(tables.categories, "name", labels.domain_subtitle(), term)


def resolve_typed(tables: Tables, typed: list[str]) -> DataFrame:
    """The product each typed text stands for: same title first, then a subtitle that contains it.

    The texts are what users typed into a form, a short list, so all of them are
    answered in one pass with one running minimum each instead of a join.
    """
    terms = list(dict.fromkeys(t.strip().lower() for t in typed if t.strip()))
    listed = with_stock(tables.products, tables.stock).select(
        "id", "title", F.lower("title").alias("_title"), F.lower(labels.product_subtitle()).alias("_sub")
    )

    def best(i: int, term: str) -> Column:
        same = F.col("_title") == term
        hit = same | F.col("_sub").contains(term)
        rank = F.when(hit, F.struct(F.when(same, 0).otherwise(1).alias("rank"), F.col("id"), F.col("title")))
        return F.min(rank).alias(f"t{i}")

    answers = listed.agg(*[best(i, t) for i, t in enumerate(terms)])
    rows = F.array(*[F.struct(F.lit(t).alias("typed"), F.col(f"t{i}").alias("hit")) for i, t in enumerate(terms)])
    return (
        answers.select(F.explode(rows).alias("r"))
        .select("r.typed", F.col("r.hit.id").alias("product_id"), F.col("r.hit.title").alias("title"))
    )
