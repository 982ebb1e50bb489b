"""The order and line-item tables read as an inventory.

Parts are products, line items are stock movements, suppliers are suppliers. A
movement's own columns come from the line item alone; price and customer are
lookups, so a plan that does not ask for them joins nothing. The lookups are left
joins: a movement is never lost because a price or an order is missing.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import signed_units
from ..operators.lookup import left_lookup, lookup_few, lookup_known
from .tables import Tables

# The reporting date, which replaces the wall clock, and the small dimensions.
AS_OF = date(1999, 6, 24)
CATEGORIES = [
    (1, "General Merchandise", "GENERAL"),
    (2, "Pharmaceuticals", "PHARMACY"),
    (3, "Packaged Foods & Dairy", "GROCERY"),
    (4, "Consumer Electronics", "ELECTRONICS"),
    (5, "Apparel", "APPAREL"),
]
USERS = [
    (1, "Super Admin", "admin@inventory.com", "ADMIN", "ACTIVE"),
    (2, "Store Manager", "manager@inventory.com", "MANAGER", "ACTIVE"),
    (3, "Inventory Clerk", "clerk@inventory.com", "CLERK", "ACTIVE"),
    (4, "Auditor Viewer", "auditor@inventory.com", "AUDITOR", "ACTIVE"),
]
# Part type -> (category id, domain).
PART_TYPES = {
    "ECONOMY": (1, "GENERAL"),
    "LARGE": (2, "PHARMACY"),
    "MEDIUM": (3, "GROCERY"),
    "PROMO": (4, "ELECTRONICS"),
    "SMALL": (5, "APPAREL"),
}
OTHER_TYPE = (6, "HARDWARE")


# Columns of the tables read; given here, they cost no look into the files.
COLUMNS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _by_part_type(pick: int) -> str:
    whens = " ".join(f"WHEN '{part_type}' THEN {values[pick]!r}" for part_type, values in PART_TYPES.items())
    return f"CASE p_type {whens} ELSE {OTHER_TYPE[pick]!r} END"


def _constant(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """Inline table, whose size the optimizer knows."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join(str(r) for r in rows)} AS t({columns})")


def categories(spark: SparkSession) -> DataFrame:
    return _constant(spark, CATEGORIES, "id, name, domain_type")


def categories_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categories that the part table mentions."""
    used = table(spark, sf_dir, "part").selectExpr(f"{_by_part_type(0)} AS id").distinct()
    return categories(spark).join(used, "id", "left_semi")


def users(spark: SparkSession) -> DataFrame:
    return _constant(spark, USERS, "id, name, email, role, status")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS id",
        "s_name AS name",
        "IF(s_nationkey % 5 <> 0, 'Agent ' || s_nationkey, NULL) AS contact_person",
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id",
        "'SKU-' || lpad(p_partkey, 8, '0') AS sku",
        "IF(p_partkey % 7 <> 0, '890' || lpad(p_partkey, 10, '0'), NULL) AS barcode",
        "p_name AS title",
        f"{_by_part_type(0)} AS category_id",
        "CASE p_size % 3 WHEN 0 THEN 'Boxes' WHEN 1 THEN 'Kg' ELSE 'Pcs' END AS unit_of_measure",
        "p_size AS min_reorder_level",
        f"{_by_part_type(1)} AS domain_preset",
        "p_brand AS brand",
        "'Rack ' || p_size % 10 AS storage_location",
    )


_TXN_TYPE = """
    CASE WHEN l_returnflag = 'A' OR (l_returnflag = 'R' AND l_linestatus = 'F') THEN 'STOCK_IN'
         WHEN l_returnflag = 'R' AND l_linenumber % 3 = 0 THEN 'INTERNAL_USE'
         WHEN l_returnflag = 'R' AND l_linenumber % 3 = 1 THEN 'DAMAGE_WRITE_OFF'
         WHEN l_returnflag = 'R' THEN 'VENDOR_RETURN'
         WHEN l_partkey % 10 = 0 THEN 'INTERNAL_USE'
         WHEN l_partkey % 10 IN (1, 2) AND (l_linestatus <> 'F' OR l_quantity > 5) THEN 'INTERNAL_USE'
         ELSE 'SALE' END AS txn_type
"""


def entries(line_items: DataFrame) -> DataFrame:
    """Line items by what a movement's columns are worked out from; ``SPELLING`` gives the columns that are not here."""
    return line_items.selectExpr(
        "l_orderkey AS order_key",
        "l_linenumber AS line_number",
        "l_partkey AS product_id",
        "l_suppkey AS line_supplier",
        _TXN_TYPE,
        "CAST(l_quantity AS INT) AS quantity",
        "CAST(l_extendedprice AS DECIMAL(10,2)) AS total_amount",
        "CAST(l_discount AS DECIMAL(5,2)) AS discount_rate",
        "CAST(l_tax AS DECIMAL(5,2)) AS tax_rate",
        "l_shipdate AS txn_date",
    )


SPELLING = {
    "txn_number": "concat(IF(txn_type = 'STOCK_IN', 'TXN-IN-', 'TXN-OUT-'), order_key, '-', line_number, '-', product_id, '-',"
    " line_supplier, '-', year(txn_date) * 10000 + month(txn_date) * 100 + day(txn_date))",
    "batch_id": "product_id * 10 + line_supplier % 3",
    "discount_amount": "CAST(total_amount * discount_rate AS DECIMAL(10,2))",
    "tax_amount": "CAST(total_amount * tax_rate AS DECIMAL(10,2))",
    "supplier_id": "IF(txn_type IN ('STOCK_IN', 'VENDOR_RETURN'), line_supplier, NULL)",
    "dept_name": "IF(txn_type = 'INTERNAL_USE', 'DEPT-' || line_supplier % 5, NULL)",
    "invoice_ref": "CASE txn_type WHEN 'SALE' THEN 'BILL-' || order_key WHEN 'STOCK_IN' THEN 'INV-' || order_key END",
    "payment_status": "elt(line_number % 4 + 1, 'PAID', 'PENDING', 'CREDIT', 'PARTIAL')",
    "user_id": "1 + order_key % 4",
}
MOVEMENT = [
    "txn_number", "txn_type", "product_id", "batch_id", "quantity", "discount_amount", "tax_amount", "total_amount", "supplier_id",
    "dept_name", "invoice_ref", "payment_status", "user_id", "txn_date", "order_key",
]


def movements(line_items: DataFrame) -> DataFrame:
    """Ledger columns that the line item carries itself; works on a stream as well."""
    return entries(line_items).selectExpr(*(f"{SPELLING[c]} AS {c}" if c in SPELLING else c for c in MOVEMENT))


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS priced_id", "CAST(p_retailprice AS DECIMAL(10,2)) AS unit_price"
    )


def _buyers(orders: DataFrame, customers: DataFrame) -> DataFrame:
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").select("sale_order", "customer_name")


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sale_order"), "o_custkey")
    return orders, table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("customer_name"))


def _sale_key() -> Column:
    return F.when(F.col("txn_type") == "SALE", F.col("order_key"))


def bought(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Movements or entries with, on sales, the customer; they are read once for sales and once for the rest."""
    return lookup_known(rows, _buyers(*_orders(spark, sf_dir)), _sale_key(), "sale_order")


def priced(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Rows with their product's price."""
    return rows.join(_prices(spark, sf_dir), F.col("product_id") == F.col("priced_id"), "left").drop("priced_id")


def complete(spark: SparkSession, sf_dir: str, rows: DataFrame, few: bool = False) -> DataFrame:
    """Movements with unit price and, on sales, the customer; ``few`` says that they are a written page."""
    orders, customers = _orders(spark, sf_dir)
    prices = _prices(spark, sf_dir)
    keyed = rows.withColumn("sale_key", _sale_key())
    if few:
        bought = lookup_few(keyed, orders, "sale_key", "sale_order")
        named = lookup_few(bought, customers, "o_custkey", "c_custkey")
        priced = lookup_few(named, prices, "product_id", "priced_id", keys_of=rows)
    else:
        named = left_lookup(keyed, _buyers(orders, customers), "sale_key", "sale_order", spread_by="txn_number")
        priced = named.join(prices, F.col("product_id") == F.col("priced_id"), "left")
    return priced.drop("sale_key", "order_key", "o_custkey", "priced_id")


def stock(narrow: DataFrame) -> DataFrame:
    """Batches with the balance the ledger leaves, without prices."""
    balance = narrow.groupBy("batch_id", "product_id").agg(F.sum(signed_units()).alias("net"))
    return balance.selectExpr(
        "batch_id AS id",
        "'BATCH-' || batch_id AS batch_number",
        "product_id",
        f"IF(product_id % 5 <> 0, date_add(DATE '{AS_OF}', INT((product_id * 7 + batch_id % 10 * 31) % 120 - 20)), NULL)"
        " AS expiry_date",
        "INT(greatest(0, net)) AS available_qty",
        "CAST(IF(product_id % 4 = 0, 20, 0) AS DECIMAL(5,2)) AS batch_discount_percent",
        "IF(product_id % 4 = 0, '20% Clearance', NULL) AS offer_description",
    )


def product_batches(spark: SparkSession, sf_dir: str, unpriced: DataFrame) -> DataFrame:
    """Batches with their prices; the price joins after the roll-up."""
    priced = unpriced.join(_prices(spark, sf_dir), F.col("product_id") == F.col("priced_id"), "left")
    return priced.selectExpr(
        "id", "batch_number", "product_id", "expiry_date", "available_qty",
        "CAST(unit_price * 0.60BD AS DECIMAL(10,2)) AS purchase_price",
        "CAST(unit_price + id % 10 AS DECIMAL(10,2)) AS selling_price",
        "batch_discount_percent", "offer_description",
    )


def load(spark: SparkSession, sf_dir: str) -> Tables:
    tables = Tables(
        AS_OF,
        lambda rows, few: complete(spark, sf_dir, rows, few),
        lambda rows: bought(spark, sf_dir, rows),
        lambda rows: priced(spark, sf_dir, rows),
        {name: F.expr(spelled) for name, spelled in SPELLING.items()},
        users=lambda: users(spark),
        categories=lambda: categories(spark),
        suppliers=lambda: suppliers(spark, sf_dir),
        products=lambda: products(spark, sf_dir),
        product_batches=lambda: product_batches(spark, sf_dir, tables.stock),
        stock=lambda: stock(tables.movements),
        transactions=lambda: tables.complete(tables.movements),
        movements=lambda: movements(table(spark, sf_dir, "lineitem")),
        entries=lambda: entries(table(spark, sf_dir, "lineitem")),
    )
    return tables
