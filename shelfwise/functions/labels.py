"""Classes and texts derived from a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import FAST_UNITS, NO_CATEGORY_DOMAIN, NO_CATEGORY_NAME, TXN_TYPE_LABELS
from .values import first_text, units


def velocity_class(sold: Column | str = "total_units_sold") -> Column:
    sold = F.col(sold) if isinstance(sold, str) else sold
    return (
        F.when(sold >= FAST_UNITS, "FAST_MOVING")
        .when(sold >= 1, "MODERATE_MOVING")
        .otherwise("SLOW_DEAD_STOCK")
    )


def category_label(name: str = "category_name") -> Column:
    return F.coalesce(F.col(name), F.lit(NO_CATEGORY_NAME))


def domain_label(domain: str = "domain_type") -> Column:
    return F.coalesce(F.col(domain), F.lit(NO_CATEGORY_DOMAIN))


def alert_status(stock: str = "total_stock") -> Column:
    return F.when(F.col(stock) == 0, "OUT OF STOCK").otherwise("LOW STOCK")


def type_label(txn_type: str = "txn_type") -> Column:
    pairs = [F.lit(x) for pair in TXN_TYPE_LABELS.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(txn_type)), F.col(txn_type))


def shown_quantity(txn_type: str = "txn_type", quantity: str = "quantity") -> Column:
    return F.when(
        F.col(txn_type) == "STOCK_IN", F.concat(F.lit("+"), F.col(quantity).cast("string"))
    ).otherwise(F.concat(F.lit("-"), units(quantity).cast("string")))


def counterparty(*names: str, default: str = "N/A") -> Column:
    return first_text(*names, default=default)


def iso_day(day: str, missing: str | None = None) -> Column:
    text = F.date_format(F.col(day), "yyyy-MM-dd")
    return text if missing is None else F.coalesce(text, F.lit(missing))


def product_subtitle() -> Column:
    """Second line of a product in a pick list."""
    return F.concat(
        F.lit("SKU: "), F.col("sku"),
        F.lit(" | Barcode: "), first_text("barcode", default="N/A"),
        F.lit(" | Stock: "), F.col("total_stock").cast("string"),
        F.lit(" "), first_text("unit_of_measure", default="Pcs"),
    )


def contact_subtitle() -> Column:
    contact = F.nullif(F.col("contact_person"), F.lit(""))
    return F.when(contact.isNotNull(), F.concat(F.lit("Contact: "), contact)).otherwise("")


def domain_subtitle() -> Column:
    return F.concat(F.lit("Domain: "), first_text("domain_type", default=NO_CATEGORY_DOMAIN))
