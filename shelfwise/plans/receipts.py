"""Incoming goods: receipts change batches, create products and write ledger rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import DEFAULT_REORDER_LEVEL, NEW_ID_BASE
from ..functions.values import PRICE, big, number_or, parse_decimal, parse_int, round2, text_or
from ..operators.claims import first_come
from ..operators.lineage import cut
from ..operators.lookup import left_lookup

# Texts of refusals and defaults.
BAD_QUANTITY = "Valid Quantity (> 0) is required."
BAD_AMOUNT = "Amount is out of range."
BARCODE_USED = "Barcode is already in use."
NEW_TITLE = "New Received Item"


def _numbered(prefix: str) -> Column:
    """Reference number from the request's day and sequence number."""
    return F.concat_ws("-", F.lit(prefix), F.date_format("received_at", "yyyyMMdd"), F.col("seq").cast("string"))


def normalise(requests: DataFrame) -> DataFrame:
    """Receipt requests with parsed numbers and all defaults filled in."""
    return requests.select(
        "seq",
        "received_at",
        F.nullif("product_id", F.lit(0)).alias("product_id"),
        text_or("product_title", NEW_TITLE).alias("title"),
        text_or("sku", _numbered("SKU")).alias("sku"),
        F.nullif("barcode", F.lit("")).alias("barcode"),
        number_or("category_id", 1).alias("category_id"),
        text_or("unit_of_measure", "Pcs").alias("unit_of_measure"),
        text_or("domain_preset", "GENERAL").alias("domain_preset"),
        text_or("batch_number", _numbered("BATCH")).alias("batch_number"),
        "expiry_date",
        F.nullif("serial_number", F.lit("")).alias("serial_number"),
        parse_int("quantity").alias("qty"),
        parse_decimal("purchase_price", 0).alias("exact_cost"),
        parse_decimal("purchase_price", 0).try_cast(PRICE).alias("purchase_price"),
        parse_decimal("selling_price", 0).try_cast(PRICE).alias("selling_price"),
        F.coalesce("batch_discount_percent", F.lit(0)).try_cast("decimal(5,2)").alias("batch_discount_percent"),
        F.nullif("offer_description", F.lit("")).alias("offer_description"),
        F.nullif("supplier_id", F.lit(0)).alias("supplier_id"),
        text_or("invoice_ref", "RECEIPT-IN").alias("invoice_ref"),
        text_or("payment_status", "PAID").alias("payment_status"),
        number_or("user_id", 1).cast("bigint").alias("user_id"),
        text_or("remarks", "Stock In Entry").alias("remarks"),
        _problem().alias("problem"),
    )


def _problem() -> Column:
    """What is wrong with a receipt's numbers, whatever the stored tables hold."""
    qty = parse_int("quantity")

    def unfit(c: str) -> Column:
        exact = parse_decimal(c)
        given = F.col(c).rlike(r"^\s*[+-]?(?:\d|\.\d)")
        return F.coalesce(given & (exact.isNull() | exact.try_cast(PRICE).isNull()), F.lit(False))

    total = F.round(qty * parse_decimal("purchase_price", 0), 2).try_cast(PRICE)
    discount = F.coalesce("batch_discount_percent", F.lit(0)).try_cast("decimal(5,2)")
    return F.when(~F.coalesce(qty > 0, F.lit(False)), BAD_QUANTITY).when(
        unfit("purchase_price") | unfit("selling_price") | total.isNull() | discount.isNull(), BAD_AMOUNT
    )


def _checked(receipts: DataFrame, products: DataFrame, suppliers: DataFrame | None, users: DataFrame | None) -> DataFrame:
    """Fills ``problem`` for unknown users and suppliers; ``_bar_used``: a stored product has the barcode that a new one would take."""
    reasons = [F.col("problem")]
    for table, key, label in ((users, "user_id", "User"), (suppliers, "supplier_id", "Supplier")):
        if table is not None:
            known = table.select(F.col("id").alias(f"_{key}"), F.lit(True).alias(f"_known_{key}"))
            receipts = left_lookup(receipts, known, key, f"_{key}", spread_by="seq")
            text = F.concat(F.lit(f"{label} ID "), F.col(key).cast("string"), F.lit(" not found."))
            reasons.append(F.when(F.col(key).isNotNull() & F.col(f"_known_{key}").isNull(), text))
    bars = products.filter(F.col("barcode").isNotNull()).select(F.lower("barcode").alias("_bar")).distinct()
    new = F.col("matched_id").isNull() & F.col("product_id").isNull()
    receipts = receipts.withColumn("_new_bar", F.when(new, F.lower("barcode")))
    receipts = left_lookup(receipts, bars.withColumn("_bar_used", F.lit(True)), "_new_bar", "_bar", spread_by="seq")
    return receipts.withColumn("problem", F.coalesce(*reasons)).drop("_known_user_id", "_known_supplier_id", "_new_bar")


def match_products(receipts: DataFrame, products: DataFrame) -> DataFrame:
    """Adds ``matched_id``: the given product, else the one with the SKU, else the lowest id with the title (``by_title``).

    SKU and title are two equi joins against one row per value, so a title shared by
    very many products multiplies nothing.
    """
    ids = products.select(F.col("id").alias("_id"), F.lit(True).alias("_exists"))
    by_sku = products.groupBy(F.lower("sku").alias("_sku")).agg(F.min("id").alias("_sku_id"))
    by_title = products.groupBy(F.lower("title").alias("_title")).agg(F.min("id").alias("_title_id"))
    wants = F.col("product_id").isNull()
    keyed = (
        receipts.withColumn("_row", F.col("seq").cast("string"))
        .withColumn("_given", F.col("product_id"))
        .withColumn("_want_sku", F.when(wants, F.lower("sku")))
        .withColumn("_want_title", F.when(wants, F.lower("title")))
    )
    found = left_lookup(keyed, ids, "_given", "_id", spread_by="_row")
    found = left_lookup(found, by_sku, "_want_sku", "_sku", spread_by="_row")
    found = left_lookup(found, by_title, "_want_title", "_title", spread_by="_row")
    matched = F.when(F.col("_exists"), F.col("product_id")).otherwise(F.coalesce("_sku_id", "_title_id"))
    by_title = F.col("_exists").isNull() & F.col("_sku_id").isNull() & F.col("_title_id").isNotNull()
    return found.withColumn("matched_id", matched).withColumn("by_title", by_title).drop(
        "_row", "_given", "_want_sku", "_want_title", "_exists", "_sku_id", "_title_id"
    )


def _resolve(sound: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Receipts with their product in ``matched_id`` (NULL: refused, with a ``problem``), and the products to create.

    A receipt goes to the product with its SKU, stored or created by an earlier receipt;
    else to the oldest one with its title; else it creates one, unless a product has its
    barcode by then. One that goes to a product adds no SKU, title or barcode of its own, so
    the creators are those that come first on all three among the receipts that could create.
    """
    keys = [F.lower(c).alias(f"_{c}") for c in ("sku", "title", "barcode")]
    open_ = cut(sound.filter(F.col("matched_id").isNull() | F.col("by_title")).select("*", *keys), "receipts")
    could = F.col("matched_id").isNull() & F.col("product_id").isNull() & F.col("_bar_used").isNull()
    claims = ["_sku", "_title", "_barcode"]
    first = first_come(open_.filter(could), "seq", claims).filter("granted").select("seq")
    own = F.lit(NEW_ID_BASE) + F.col("seq")
    creators = cut(open_.join(first, "seq").withColumn("_new_id", own), "receipts")
    created = creators.select(
        F.col("_new_id").alias("id"), "sku", "barcode", "title", "category_id", "unit_of_measure",
        F.lit(DEFAULT_REORDER_LEVEL).alias("min_reorder_level"), "domain_preset",
        F.lit(None).cast("string").alias("brand"), F.lit(None).cast("string").alias("storage_location"),
    )
    placed = open_.withColumn("_asks_sku", F.when(F.col("product_id").isNull(), F.col("_sku")))
    placed = placed.withColumn("_asks_title", F.when(F.col("product_id").isNull() & ~F.col("by_title"), F.col("_title")))
    for asked, holds, found in (("product_id", "_new_id", "_by_id"), ("_asks_sku", "_sku", "_by_sku"), ("_asks_title", "_title", "_by_new_title")):
        owner = creators.select(F.col(holds).alias("_held"), F.col("_new_id").alias(found))
        placed = left_lookup(placed, owner, asked, "_held", spread_by="seq")
    by_then = lambda c: F.when(F.col(c) <= own, F.col(c))
    target = F.coalesce(by_then("_by_id"), by_then("_by_sku"), "matched_id", by_then("_by_new_title"))
    lost = F.concat(F.lit("Product ID "), F.col("product_id").cast("string"), F.lit(" not found."))
    reason = F.when(F.col("matched_id").isNotNull(), None).when(F.col("product_id").isNotNull(), lost).otherwise(BARCODE_USED)
    placed = placed.withColumn("matched_id", target).withColumn("problem", reason)
    certain = sound.filter(F.col("matched_id").isNotNull() & ~F.col("by_title"))
    return cut(certain.unionByName(placed.select(*certain.columns)), "receipts"), created


@dataclass(frozen=True)
class Received:
    """Outcome of a run of receipts."""

    batches: DataFrame
    ledger: DataFrame
    new_products: DataFrame
    rejects: DataFrame


def receive(
    requests: DataFrame, products: DataFrame, batches: DataFrame, suppliers: DataFrame | None = None, users: DataFrame | None = None
) -> Received:
    """Apply receipts in ``seq`` order to the stored products and batches.

    A receipt with unfit numbers, an unknown product, supplier or user, or the barcode of
    another product where it would create one, is refused with its reason and changes
    nothing. How the receipts are cut into runs makes no difference.

    An existing batch gains the quantities and takes the last receipt's prices; its
    other columns stay. A new batch takes its other columns from its first receipt.
    """
    matched = match_products(normalise(requests), products)
    matched = cut(_checked(matched, products, suppliers, users), "receipts")
    placed, created = _resolve(matched.filter(F.col("problem").isNull()))
    resolved = placed.filter(F.col("matched_id").isNotNull())
    refused = matched.filter(F.col("problem").isNotNull()).select("seq", F.col("problem").alias("reason"))
    rejects = refused.unionByName(placed.filter(F.col("matched_id").isNull()).select("seq", F.col("problem").alias("reason")))

    received = resolved.withColumn("_number", F.lower("batch_number"))
    arrived = received.groupBy("matched_id", "_number").agg(
        big(F.sum("qty")).alias("_in"),
        F.max_by(F.struct("purchase_price", "selling_price"), "seq").alias("_last"),
        F.min_by(
            F.struct(
                "seq", "batch_number", "expiry_date", "serial_number", "batch_discount_percent", "offer_description"
            ),
            "seq",
        ).alias("_first"),
    )
    stored = batches.select(
        F.struct("*").alias("_old"), F.col("product_id").alias("matched_id"), F.lower("batch_number").alias("_number")
    )
    both = stored.join(arrived, ["matched_id", "_number"], "full_outer")
    is_old, is_in = F.col("_old").isNotNull(), F.col("_in").isNotNull()
    batch_id = F.when(is_old, F.col("_old.id")).otherwise(F.lit(NEW_ID_BASE) + F.col("_first.seq"))
    from_first = ["batch_number", "expiry_date", "serial_number", "batch_discount_percent", "offer_description"]

    def column(c: str) -> Column:
        if c == "id":
            return batch_id
        if c == "product_id":
            return F.col("matched_id")
        if c == "available_qty":
            return big(F.coalesce("_old.available_qty", F.lit(0))) + F.coalesce("_in", F.lit(0))
        if c in ("purchase_price", "selling_price"):
            return F.when(is_in, F.col(f"_last.{c}")).otherwise(F.col(f"_old.{c}"))
        new = F.col(f"_first.{c}") if c in from_first else F.lit(None)
        return F.when(is_old, F.col(f"_old.{c}")).otherwise(new)

    after = both.select(*[column(c).alias(c) for c in batches.columns])
    numbers = both.filter(is_in).select("matched_id", "_number", batch_id.alias("batch_id"))
    ledger = received.join(numbers, ["matched_id", "_number"]).select(
        _numbered("TXN-IN").alias("txn_number"),
        F.lit("STOCK_IN").alias("txn_type"),
        F.col("matched_id").alias("product_id"),
        "batch_id",
        F.col("qty").alias("quantity"),
        F.col("purchase_price").alias("unit_price"),
        F.lit(0).cast(PRICE).alias("discount_amount"),
        F.lit(0).cast(PRICE).alias("tax_amount"),
        round2(F.col("qty") * F.col("exact_cost")).try_cast(PRICE).alias("total_amount"),
        "supplier_id",
        F.lit(None).cast("string").alias("customer_name"),
        F.lit(None).cast("string").alias("dept_name"),
        "invoice_ref", "payment_status", "remarks", "user_id",
        F.col("received_at").alias("txn_date"),
    )
    return Received(after, ledger, created, rejects)
