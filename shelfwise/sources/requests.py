"""Request documents: readers for stored ones, and streams of them cut from the test tables.

The test tables hold no requests, so orders, customers, parts and events are read as
such. The odd values below put every default, parse rule and refusal on some rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fixed import NEW_ID_BASE
from ..functions.values import signed_units
from . import scaled

NO_SUCH_ID = 900_000_000_000


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def stream_json(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def _text(x: Column) -> Column:
    return x.cast("string")


def _tagged(prefix: str, x: Column) -> Column:
    return F.concat(F.lit(prefix), _text(x))


def _sku(x: Column, prefix: str = "SKU-") -> Column:
    return F.concat(F.lit(prefix), F.lpad(_text(x), 8, "0"))


def receipts(orders: DataFrame) -> DataFrame:
    """One receipt request per order; works on a stream as well."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    n = 1 + k % 50
    amount = _text(F.col("o_totalprice").cast("decimal(12,2)"))
    batch = _text(c * 10 + k % 4)
    third = k % 3
    quantity = (
        F.when(k % 11 == 0, "0").when(k % 11 == 1, "-1").when(k % 11 == 2, F.concat(_text(n), F.lit("abc")))
        .when(k % 11 == 3, F.concat(_text(n), F.lit(".7"))).when(k % 11 == 5, "x")
        .when(k % 11 == 6, F.concat(F.lit(" "), _text(n))).when(k % 11 != 4, _text(n))
    )
    return orders.select(
        k.alias("seq"),
        F.col("o_orderdate").alias("received_at"),
        F.when(k % 97 == 0, F.lit(NO_SUCH_ID) + c).when(third == 0, c).when(k % 30 == 1, 0).alias("product_id"),
        F.when(third == 1, F.lit(None)).when(k % 4 == 1, "RED WIDGET").when(k % 4 != 3, _tagged("New item ", c % 500))
        .alias("product_title"),
        F.when((third == 1) & (k % 2 == 0), _sku(c, "sku-")).when(third == 1, _sku(c))
        .when(k % 4 == 0, _tagged("NEW-", c % 500)).when(k % 4 == 1, "").alias("sku"),
        F.when(k % 53 == 0, "8900000000001").alias("barcode"),
        F.when(k % 2 == 0, 1 + c % 5).cast("bigint").alias("category_id"),
        F.when(k % 2 == 0, "Kg").alias("unit_of_measure"),
        F.when(k % 4 == 0, "GROCERY").alias("domain_preset"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 7 == 0, F.concat(F.lit("batch-"), batch))
        .otherwise(F.concat(F.lit("BATCH-"), batch)).alias("batch_number"),
        F.when(k % 6 != 0, F.date_add(F.lit(scaled.AS_OF), (c % 200).cast("int"))).alias("expiry_date"),
        F.when(k % 10 == 0, _tagged("SN-", k)).alias("serial_number"),
        quantity.alias("quantity"),
        F.when(k % 101 == 5, "99999999999").when(k % 9 == 1, "12.345").when(k % 9 == 2, "abc").when(k % 9 != 0, amount).alias("purchase_price"),
        F.when(k % 9 == 0, "").otherwise(amount).alias("selling_price"),
        F.when(k % 4 == 0, 20).cast("decimal(5,2)").alias("batch_discount_percent"),
        F.when(k % 4 == 0, "Clearance").otherwise("").alias("offer_description"),
        F.when(k % 83 == 9, NO_SUCH_ID).otherwise(k % 10).alias("supplier_id"),
        F.when(k % 2 == 0, _tagged("INV-", k)).alias("invoice_ref"),
        F.when(k % 3 == 0, "CREDIT").alias("payment_status"),
        F.when(k % 89 == 7, 999).otherwise(k % 5).alias("user_id"),
        F.when(k % 8 == 0, "Counted").alias("remarks"),
    )


def bills(orders: DataFrame) -> DataFrame:
    """One bill request per order: one-item form, or two or three items, some on one batch."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    none = F.lit(None).cast("string")
    quantity = F.when(k % 19 == 0, "x").otherwise(_text(1 + k % 5))
    price = F.when(k % 6 == 0, "12.50").when(k % 12 == 1, "abc")
    discount = F.when(k % 7 == 0, "1.255")
    tax = F.when(k % 7 == 1, "2.5")
    first_product = F.when(k % 17 != 0, c)

    def item(product: Column, batch: Column, quantity: Column, price: Column) -> Column:
        return F.struct(
            product.alias("product_id"), batch.alias("batch_id"), quantity.alias("quantity"),
            price.alias("unit_price"), discount.alias("discount_amount"), tax.alias("tax_amount"),
        )

    other = F.when(k % 13 == 0, F.lit(NO_SUCH_ID) + c).when(k % 23 == 0, c * 10).otherwise((c + 7) * 10 + k % 3)
    one = item(first_product, c * 10 + k % 3, quantity, price)
    two = item(c + 7, other, _text(1 + k % 3), none)
    again = item(c, c * 10 + k % 3, _text(1 + k % 2), none)
    # the items are columns by themselves first, else every branch below repeats their expressions
    rows = orders.select("o_orderkey", "o_custkey", "o_orderdate", one.alias("one"), two.alias("two"), again.alias("again"))
    single = k % 4 == 0
    several = F.when(k % 5 == 0, F.array("one", "two", "again")).otherwise(F.array("one", "two"))
    items = F.when(k % 8 == 0, F.lit(None)).when(single, F.slice(F.array("one"), 1, 0)).otherwise(several)
    return rows.select(
        k.alias("seq"),
        F.col("o_orderdate").alias("received_at"),
        F.when(k % 3 == 0, _tagged("BILL-", k)).alias("invoice_ref"),
        F.when(k % 10 == 0, "INTERNAL_USE").alias("txn_type"),
        F.when(k % 10 != 0, _tagged("Customer ", c)).alias("customer_name"),
        F.when(k % 10 == 0, "DEPT-1").alias("dept_name"),
        (k % 5).alias("user_id"),
        none.alias("remarks"),
        items.alias("items"),
        *[F.when(single, F.col("one")[f]).alias(f) for f in (
            "product_id", "batch_id", "quantity", "unit_price", "discount_amount", "tax_amount"
        )],
    )


def sale_demand(movements: DataFrame) -> DataFrame:
    """Bills as the ledger has them: sales of one order form one bill, served by order number."""
    return (
        movements.filter(F.col("txn_type") == "SALE")
        .groupBy(F.col("order_key").alias("seq"), "batch_id")
        .agg(F.sum("quantity").alias("qty"))
    )


def guard_moves(events: DataFrame) -> DataFrame:
    """Receipts and issues of fifty stock keys, cut from the events; rows that move nothing drop out."""
    qty = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.col("event_type")
    delta = F.when(kind == "signup", qty).when(kind.isin("purchase", "click", "error"), -qty)
    return (
        events.select("event_id", "ts", (F.col("user_id") % 50).alias("stock_key"), kind.alias("event_type"), delta.alias("delta"))
        .filter(F.col("delta").isNotNull() & (F.col("delta") != 0))
    )


def stock_counts(movements: DataFrame) -> DataFrame:
    """Stock counts of every batch on the 10th and 20th of the months it moves in; some find two units too many from March 1996 on."""
    day, batch = F.to_date("txn_date"), F.col("batch_id")
    daily = movements.groupBy("batch_id", day.alias("count_day")).agg(F.sum(signed_units()).alias("net"))
    held = F.sum("net").over(Window.partitionBy("batch_id").orderBy("count_day"))
    found = F.when((batch % 97 < 3) & (F.col("count_day") >= F.lit("1996-03-01").cast("date")), 2).otherwise(0)
    counted = daily.select("batch_id", "count_day", (held + found).cast("bigint").alias("counted"))
    return counted.where(F.dayofmonth("count_day").isin(10, 20))


def access_log(events: DataFrame) -> DataFrame:
    """Who asked for what, cut from the events."""
    who, kind = F.col("user_id") % 7, F.col("event_type")
    role = (
        F.when(who == 0, "ADMIN").when(who == 1, "MANAGER").when(who == 2, "CLERK").when(who == 3, "AUDITOR")
        .when(who == 4, "").when(who == 5, "GUEST")
    )
    permission = (
        F.when(kind == "view", "READ").when(kind == "click", "STOCK_OUT").when(kind == "purchase", "STOCK_IN")
        .when(kind == "signup", "MANAGE_PRODUCTS").otherwise("EXPORT_REPORTS")
    )
    return events.select(
        F.col("event_id").alias("seq"), role.alias("role"), permission.alias("permission")
    )


def product_creates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One create request per customer; some repeat a stored SKU or one another's."""
    k = F.col("c_custkey")
    sku = (
        F.when(k % 6 == 0, _sku(k)).when(k % 6 == 1, "").when(k % 6 == 2, _tagged("CUS-", F.floor(k / 12)))
        .otherwise(_tagged("CUST-", k))
    )
    barcode = (
        F.when(k % 6 == 3, F.concat(F.lit("890"), F.lpad(_text(k), 10, "0"))).when(k % 6 == 4, _tagged("BC-", F.floor(k / 12)))
        .when(k % 6 == 5, "")
    )
    return scaled.table(spark, sf_dir, "customer").select(
        k.alias("seq"),
        sku.alias("sku"),
        barcode.alias("barcode"),
        F.when(k % 10 != 9, F.col("c_name")).alias("title"),
        F.when(k % 25 != 0, 1 + F.col("c_nationkey") % 6).cast("bigint").alias("category_id"),
        F.when(k % 2 == 0, "Boxes").alias("unit_of_measure"),
        (k % 4 * 5).cast("int").alias("min_reorder_level"),
        F.when(k % 3 == 0, "HARDWARE").alias("domain_preset"),
        F.when(k % 2 == 1, "").otherwise("Acme").alias("brand"),
        F.lit(None).cast("string").alias("storage_location"),
    )


def product_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One update request per order; many products get several."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    sku = F.when(k % 29 == 0, _tagged("NEW-", k % 31)).when(k % 13 == 0, _sku(c + 1)).when(k % 17 != 0, _sku(c))
    return scaled.table(spark, sf_dir, "orders").select(
        k.alias("seq"),
        F.when(k % 37 == 0, NO_SUCH_ID + c).otherwise(c).alias("id"),
        sku.alias("sku"),
        F.when(k % 2 == 0, F.concat(F.lit("890"), F.lpad(_text(c), 10, "0"))).alias("barcode"),
        F.when(k % 9 != 0, _tagged("Title ", k)).otherwise("").alias("title"),
        F.when(k % 3 != 0, 1 + k % 5).cast("bigint").alias("category_id"),
        F.when(k % 5 == 0, "").otherwise("Packs").alias("unit_of_measure"),
        (k % 3 * 7).cast("int").alias("min_reorder_level"),
        F.when(k % 4 == 0, "APPAREL").alias("domain_preset"),
        F.when(k % 2 == 0, "Acme").alias("brand"),
        F.when(k % 8 == 0, "Bin 1").alias("storage_location"),
    )


def unsold_products(spark: SparkSession, sf_dir: str, products: DataFrame) -> DataFrame:
    """Catalog entries without a movement, one per supplier, in the shape of ``products``."""
    k = F.col("s_suppkey")
    values = {"id": F.lit(NEW_ID_BASE) + k, "sku": _tagged("PLAN-", k), "title": F.col("s_name"), "category_id": F.lit(1)}
    return scaled.table(spark, sf_dir, "supplier").select(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in products.schema]
    )


def product_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids to delete: sold products, planned products and ids that do not exist."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    sold = scaled.table(spark, sf_dir, "customer").select(
        F.when(k % 5 == 0, F.lit(NO_SUCH_ID) + k).otherwise(k).alias("id")
    )
    planned = scaled.table(spark, sf_dir, "supplier").select((F.lit(NEW_ID_BASE) + s).alias("id"))
    return sold.unionByName(planned)


def seed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed products, one per part: known SKUs under a new title, and new SKUs, ten rows each."""
    k = F.col("p_partkey")
    return scaled.table(spark, sf_dir, "part").select(
        k.alias("seq"),
        (F.lit(NEW_ID_BASE) + k).alias("id"),
        F.when(k % 2 == 0, _sku(k, "sku-")).otherwise(_tagged("SEED-", F.floor(k / 10))).alias("sku"),
        F.concat(F.lit("Renamed "), "p_name").alias("title"),
        F.lit(1).alias("category_id"),
        F.lit("Pcs").alias("unit_of_measure"),
        F.col("p_brand").alias("brand"),
    )


def seed_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed products with SKU and barcode, each stored, another's, shared with other seed rows, or new."""
    k = F.col("p_partkey")
    barcode = F.when(k % 5 == 1, F.concat(F.lit("890"), F.lpad(_text(k - 1), 10, "0"))).when(k % 5 == 2, _tagged("X-", F.floor(k / 9)))
    return seed_rows(spark, sf_dir).withColumn("p_partkey", F.col("seq")).withColumn("barcode", barcode).drop("p_partkey")


def seed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed batches, one per part: stored numbers, the same numbers on other products, and new ones, some without a number."""
    k = F.col("p_partkey")
    number = F.when(k % 5 == 0, _tagged("batch-", k * 10)).when(k % 5 == 1, "SEED-LOT").when(k % 5 != 2, _tagged("LOT-", k))
    return scaled.table(spark, sf_dir, "part").select(
        k.alias("seq"),
        (F.lit(NEW_ID_BASE) + k).alias("id"),
        number.alias("batch_number"),
        F.when(k % 3 == 0, k).otherwise(k - k % 10).alias("product_id"),
        k.cast("int").alias("available_qty"),
    )


def seed_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed categories, one per supplier: stored names in another case, and new ones, several rows each."""
    k = F.col("s_suppkey")
    name = F.when(k % 5 == 0, "PHARMACEUTICALS").when(k % 5 == 1, "general merchandise").otherwise(F.concat(F.lit("Aisle "), F.floor(k / 7).cast("string")))
    return scaled.table(spark, sf_dir, "supplier").select(
        k.alias("seq"), (F.lit(NEW_ID_BASE) + k).alias("id"), name.alias("name"), F.concat(F.lit("TYPE-"), k.cast("string")).alias("domain_type")
    )
