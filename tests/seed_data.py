"""The demo rows: small, with the edge cases whose results are known by hand."""

from datetime import date, datetime
from decimal import Decimal as D

from pyspark.sql import SparkSession

from shelfwise.sources import schemas
from shelfwise.sources.tables import Tables

AS_OF = date(2026, 8, 8)

# The demo rows.
USERS = [
    (1, "Super Admin", "admin@inventory.com", None, "ADMIN", "ACTIVE"),
    (2, "Store Manager", "manager@inventory.com", None, "MANAGER", "ACTIVE"),
    (3, "Inventory Clerk", "clerk@inventory.com", None, "CLERK", "ACTIVE"),
    (4, "Auditor Viewer", "auditor@inventory.com", None, "AUDITOR", "ACTIVE"),
]
CATEGORIES = [
    (1, "Pharmaceuticals", "Medicines, Vaccines & Healthcare", "PHARMACY"),
    (2, "Packaged Foods & Dairy", "Fresh food, canned goods & beverages", "GROCERY"),
    (3, "Consumer Electronics", "Mobiles, Laptops & Accessories", "ELECTRONICS"),
    (4, "General Merchandise", "Hardware, Tools & Stationery", "GENERAL"),
]
SUPPLIERS = [
    (1, "PharmaSupply Co.", "Dr. Robert Vance", "+1-555-0192", "orders@pharmasupply.com", "452 Medical Parkway, Hub City"),
    (2, "Global Electronics Ltd.", "Sarah Jenkins", "+1-555-0388", "sales@globalelectronics.com", "101 Tech Blvd, Silicon Valley"),
    (3, "Metro Wholesalers", "Mike Ross", "+1-555-0471", "supply@metrowholesale.com", "88 Commercial Street, Metro City"),
]
PRODUCTS = [
    (1, "PHARM-5001", "8901001002001", "Paracetamol 500mg Tablets (Box of 100)", 1, "Boxes", 15, "PHARMACY", "HealthPharma", "Rack A-1"),
    (2, "PHARM-5002", "8901001002002", "Amoxicillin 250mg Capsules", 1, "Boxes", 10, "PHARMACY", "CureLabs", "Rack A-2"),
    (3, "ELEC-1001", "8902002003001", "Wireless Ergonomic Mouse", 3, "Pcs", 5, "ELECTRONICS", "TechGear", "Shelf B-4"),
    (4, "ELEC-1002", "8902002003002", "USB-C Fast Charging Cable 2m", 3, "Pcs", 20, "ELECTRONICS", "PowerFast", "Shelf B-5"),
    (5, "FOOD-3001", "8903003004001", "Whole Wheat Bread 400g", 2, "Pcs", 25, "GROCERY", "FreshBake", "Counter C-1"),
]
BATCHES = [
    (1, "BATCH-PHARM-2026A", 1, date(2026, 8, 20), None, 12, D("10.00"), D("15.00"), D("20.00"), "🔥 20% Near-Expiry Clearance"),
    (2, "BATCH-PHARM-2026B", 1, date(2027, 4, 15), None, 85, D("11.50"), D("16.50"), D("0.00"), "Fresh Batch"),
    (3, "BATCH-AMOX-2026X", 2, date(2026, 11, 30), None, 40, D("18.00"), D("25.00"), D("5.00"), "5% Seasonal Discount"),
    (4, "BATCH-ELEC-MOUSE1", 3, None, None, 30, D("12.00"), D("24.99"), D("0.00"), "Regular Price"),
    (5, "BATCH-FOOD-BREAD1", 5, date(2026, 8, 8), None, 18, D("1.20"), D("2.50"), D("10.00"), "10% Daily Baked Fresh"),
]
_Z = D("0.00")
TRANSACTIONS = [
    (1, "TXN-IN-20260801-01", "STOCK_IN", 1, 1, 100, D("10.00"), _Z, _Z, D("1000.00"), 1, None, None, "INV-PHARM-992", "PAID", "Initial Stock Receipt", 1, datetime(2026, 8, 1, 9, 30)),
    (2, "TXN-OUT-20260802-01", "SALE", 1, 1, 2, D("12.00"), _Z, _Z, D("24.00"), None, None, None, "BILL-1001", "PAID", "Direct Counter Sale", 3, datetime(2026, 8, 2, 10, 0)),
    (3, "TXN-OUT-20260803-01", "INTERNAL_USE", 4, None, 2, D("5.00"), _Z, _Z, D("10.00"), None, None, None, "REF-HR-04", "PAID", "Issued USB cables to HR Team", 2, datetime(2026, 8, 3, 11, 15)),
]


def frame(spark: SparkSession, rows, ddl: str, padding: int = 0):
    return spark.createDataFrame([tuple(r) + (None,) * padding for r in rows], ddl)


def tables(spark: SparkSession) -> Tables:
    return Tables(
        AS_OF,
        users=frame(spark, USERS, schemas.USERS, 2),
        categories=frame(spark, CATEGORIES, schemas.CATEGORIES, 1),
        suppliers=frame(spark, SUPPLIERS, schemas.SUPPLIERS, 1),
        products=frame(spark, PRODUCTS, schemas.PRODUCTS, 2),
        product_batches=frame(spark, BATCHES, schemas.PRODUCT_BATCHES, 2),
        transactions=frame(spark, TRANSACTIONS, schemas.TRANSACTIONS),
    )
