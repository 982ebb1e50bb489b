"""The movement ledger: joined, filtered, searched, paged, displayed."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.fixed import LEDGER_PAGE, RECENT_ROWS
from ..functions.values import contains_any, first_text, like_any
from ..operators.lineage import cut
from ..operators.lookup import left_lookup, lookup_few, lookup_known, pair_lookup
from ..sources.tables import Tables
from .period import DAY_FOLDER, within

# Columns that a movement's product, batch, supplier and user give it.
NAMES = ["product_title", "product_sku", "unit_of_measure", "batch_number", "expiry_date", "supplier_name", "user_name"]


def newest_first() -> list[Column]:
    return [F.desc("txn_date"), F.asc("txn_number")]


def _is_set(choice: str | None) -> bool:
    return bool(choice) and choice != "ALL"


def _on_fact(tables: Tables, rows: DataFrame, txn_type: str | None, period: str | None) -> DataFrame:
    """Movements or entries after the filters that need nothing else, so that these reach the scan."""
    facts = within(rows, period, tables.as_of)
    return facts.filter(F.col("txn_type") == txn_type) if _is_set(txn_type) else facts


def _product_names(products: DataFrame) -> DataFrame:
    return products.select(
        F.col("id").alias("_product"),
        F.col("title").alias("product_title"),
        F.col("sku").alias("product_sku"),
        "unit_of_measure",
    )


def _batch_names(batches: DataFrame) -> DataFrame:
    return batches.select(F.col("id").alias("_batch"), "batch_number", "expiry_date")


def _supplier_names(suppliers: DataFrame) -> DataFrame:
    return suppliers.select(F.col("id").alias("_supplier"), F.col("name").alias("supplier_name"))


def _user_names(users: DataFrame) -> DataFrame:
    return users.select(F.col("id").alias("_user"), F.col("name").alias("user_name"))


@dataclass(frozen=True)
class _Search:
    """Where a term is looked for: on products, on batches, on the movement itself."""

    product: Column
    batch: Column
    movement: Column


def _searches(search: str | None, literal_search: str | None) -> list[_Search]:
    found = []
    if search:
        found.append(
            _Search(
                like_any(search, "product_title", "product_sku"),
                like_any(search, "batch_number"),
                like_any(search, "txn_number", "invoice_ref", "customer_name"),
            )
        )
    if literal_search:
        found.append(
            _Search(contains_any(literal_search, "product_title"), F.lit(False), contains_any(literal_search, "txn_number"))
        )
    return found


def _with_names(tables: Tables, facts: DataFrame) -> DataFrame:
    """Left joins to the four dimensions."""
    joined = facts.join(_product_names(tables.products), F.col("product_id") == F.col("_product"), "left")
    joined = left_lookup(joined, _batch_names(tables.stock), "batch_id", "_batch", spread_by="txn_number")
    joined = left_lookup(joined, _supplier_names(tables.suppliers), "supplier_id", "_supplier", spread_by="txn_number")
    return joined.join(_user_names(tables.users), F.col("user_id") == F.col("_user"), "left").drop("_product", "_user")


def _complete_with_names(tables: Tables, facts: DataFrame, searches: list[_Search]) -> DataFrame:
    """Entries with all lookups and the names of the four dimensions, keeping those that every search finds somewhere.

    All that hangs on a product or a batch is put together once per pair of them that moves, as
    there are far fewer pairs than movements, so the movements are shuffled for one lookup
    instead of three. Product and batch texts are matched once per product and batch. Keys and
    searched texts are worked out where they are needed and dropped again.
    """
    batch, supplier, user = (tables.spelled(c) for c in ("batch_id", "supplier_id", "user_id"))
    products, batches = _product_names(tables.products), _batch_names(tables.stock)
    for i, s in enumerate(searches):
        products = products.withColumn(f"_in_product{i}", s.product)
        batches = batches.withColumn(f"_in_batch{i}", s.batch)
    pairs = tables.priced(facts.select("product_id", batch.alias("batch_id")).distinct())
    pairs = pairs.join(products, F.col("product_id") == F.col("_product"), "left").drop("_product")
    pairs = left_lookup(pairs, batches, "batch_id", "_batch", spread_by="product_id")
    joined = lookup_known(tables.bought(facts), _supplier_names(tables.suppliers), supplier, "_supplier")
    keys = F.col("product_id"), batch
    joined = pair_lookup(joined, pairs, "product_id", "batch_id", keys=keys, spread_by=tables.spelled("txn_number"))
    kept = joined.columns
    for i, s in enumerate(searches):
        in_names = [F.coalesce(F.col(c), F.lit(False)) for c in (f"_in_product{i}", f"_in_batch{i}")]
        seen = joined.withColumns({c: tables.spelled(c) for c in ("txn_number", "invoice_ref")})
        joined = seen.filter(in_names[0] | in_names[1] | s.movement).select(*kept)
    return joined.join(_user_names(tables.users), user == F.col("_user"), "left").drop("_user")


def _in_order(tables: Tables, rows: DataFrame) -> DataFrame:
    """Complete rows of entries, newest first.

    Entries are dealt to tasks by ranges of the order's columns. These ranges are the ones that the
    sort needs, so it moves no row again, and what is worked out from an entry is not sent.
    """
    dealt = rows.repartitionByRange(F.desc("txn_date"), tables.spelled("txn_number").asc())
    in_order = dealt.withColumn("txn_number", tables.spelled("txn_number")).orderBy(*newest_first())
    columns = tables.complete(tables.movements.drop(DAY_FOLDER)).columns
    return in_order.select(*(c if c in in_order.columns else tables.spelled(c).alias(c) for c in columns), *NAMES)


def ledger(
    tables: Tables,
    *,
    txn_type: str | None = None,
    period: str | None = None,
    search: str | None = None,
    literal_search: str | None = None,
) -> DataFrame:
    """Every matching movement with its dimension names, newest first.

    ``search`` treats % and _ as wildcards and looks at six columns;
    ``literal_search`` takes the term as it is and looks at title and number.
    """
    facts = _on_fact(tables, tables.entries, txn_type, period)
    return _in_order(tables, _complete_with_names(tables, facts, _searches(search, literal_search)))


def named(tables: Tables, rows: DataFrame) -> DataFrame:
    """Complete ledger rows with the names of their product, batch, supplier and user."""
    return _with_names(tables, rows)


def page_size(text: str | int | None) -> int:
    """Requested page size: the whole number that a text starts with; the default if there is none or it is not positive."""
    found = re.match(r"\s*\+?(\d+)", str(text if text is not None else ""))
    return (int(found[1]) if found else 0) or LEDGER_PAGE


def _found(tables: Tables, movements: DataFrame, searches: list[_Search]) -> DataFrame:
    """Movements that every search finds somewhere; products and batches are matched once each, before the join."""
    for s in searches:
        products = _product_names(tables.products).filter(s.product).select("_product", F.lit(True).alias("_in_product"))
        batches = _batch_names(tables.stock).filter(s.batch).select("_batch", F.lit(True).alias("_in_batch"))
        joined = movements.join(products, F.col("product_id") == F.col("_product"), "left")
        joined = left_lookup(joined, batches, "batch_id", "_batch", spread_by="txn_number")
        in_names = F.coalesce(F.col("_in_product"), F.lit(False)) | F.coalesce(F.col("_in_batch"), F.lit(False))
        movements = joined.filter(in_names | s.movement).drop("_product", "_in_product", "_in_batch")
    return movements


def ledger_page(
    tables: Tables,
    limit: str | int | None = None,
    *,
    txn_type: str | None = None,
    period: str | None = None,
    search: str | None = None,
    literal_search: str | None = None,
) -> DataFrame:
    """Newest rows of the ledger after the filters and searches of ``ledger``.

    The page is cut from movements without names, and only the rows on it meet the
    dimensions. Without a search, a pass over the dates alone finds the oldest date that
    can be on the page, and the other columns are read from there on.
    """
    n = page_size(limit)
    facts, searches = _on_fact(tables, tables.movements, txn_type, period), _searches(search, literal_search)
    if searches:
        facts = _found(tables, tables.complete(facts), searches)
    else:
        dates_on_page = facts.select("txn_date").orderBy(F.desc("txn_date")).limit(n)
        oldest = dates_on_page.agg(F.min("txn_date")).scalar()
        facts = facts.filter(F.col("txn_date").isNull() | (F.col("txn_date") >= oldest))
    page = cut(facts.orderBy(*newest_first()).limit(n), "page")
    named = page if searches else tables.complete(page, few=True)
    for dim, key, fact_key in (
        (_product_names(tables.products), "_product", "product_id"),
        (_batch_names(tables.stock), "_batch", "batch_id"),
        (_supplier_names(tables.suppliers), "_supplier", "supplier_id"),
        (_user_names(tables.users), "_user", "user_id"),
    ):
        named = lookup_few(named, dim, fact_key, key, keys_of=page)
    return named.orderBy(*newest_first())


def recent(tables: Tables) -> DataFrame:
    return ledger_page(tables, RECENT_ROWS)


def display(rows: DataFrame) -> DataFrame:
    """Columns as the ledger screen shows them."""
    return rows.select(
        F.date_format("txn_date", "HH:mm").alias("time_of_day"),
        "txn_number",
        labels.type_label().alias("type_label"),
        first_text("product_title", default="Product").alias("product_title"),
        first_text("product_sku", default="").alias("product_sku"),
        first_text("batch_number", default="N/A").alias("batch_number"),
        labels.shown_quantity().alias("shown_quantity"),
        F.col("unit_price").cast("decimal(18,2)").alias("unit_price"),
        F.col("total_amount").cast("decimal(18,2)").alias("total_amount"),
        labels.counterparty("supplier_name", "customer_name", "dept_name").alias("counterparty"),
        first_text("user_name", default="Clerk").alias("user_name"),
    )


def export_columns(rows: DataFrame) -> DataFrame:
    """The eleven columns of the ledger file, in order."""
    return rows.select(
        F.col("txn_date").alias("Timestamp"),
        F.col("txn_number").alias("Txn ID"),
        F.col("txn_type").alias("Type"),
        F.col("product_title").alias("Product"),
        F.col("product_sku").alias("SKU"),
        F.col("batch_number").alias("Batch"),
        F.col("quantity").alias("Quantity"),
        F.col("unit_price").alias("Unit Price"),
        F.col("total_amount").alias("Total Amount"),
        labels.counterparty("supplier_name", "customer_name", default="").alias("Partner"),
        first_text("user_name", default="").alias("Logged By"),
    )
