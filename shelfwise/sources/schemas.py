"""Schemas of the six stored tables and of the request documents (fixed values), as DDL."""

USERS = (
    "id bigint, name string, email string, password_hash string, role string, status string, "
    "created_at timestamp, updated_at timestamp"
)
CATEGORIES = "id bigint, name string, description string, domain_type string, created_at timestamp"
SUPPLIERS = (
    "id bigint, name string, contact_person string, phone string, email string, address string, created_at timestamp"
)
PRODUCTS = (
    "id bigint, sku string, barcode string, title string, category_id bigint, unit_of_measure string, "
    "min_reorder_level int, domain_preset string, brand string, storage_location string, "
    "created_at timestamp, updated_at timestamp"
)
PRODUCT_BATCHES = (
    "id bigint, batch_number string, product_id bigint, expiry_date date, serial_number string, available_qty int, "
    "purchase_price decimal(10,2), selling_price decimal(10,2), batch_discount_percent decimal(5,2), "
    "offer_description string, created_at timestamp, updated_at timestamp"
)
TRANSACTIONS = (
    "id bigint, txn_number string, txn_type string, product_id bigint, batch_id bigint, quantity int, "
    "unit_price decimal(10,2), discount_amount decimal(10,2), tax_amount decimal(10,2), total_amount decimal(10,2), "
    "supplier_id bigint, customer_name string, dept_name string, invoice_ref string, payment_status string, "
    "remarks string, user_id bigint, txn_date timestamp"
)

RECEIPT_REQUEST = (
    "seq bigint, received_at timestamp, role string, product_id bigint, product_title string, sku string, "
    "barcode string, category_id bigint, unit_of_measure string, domain_preset string, batch_number string, "
    "expiry_date date, serial_number string, quantity string, purchase_price string, selling_price string, "
    "batch_discount_percent decimal(5,2), offer_description string, supplier_id bigint, invoice_ref string, "
    "payment_status string, user_id bigint, remarks string"
)
_LINE = "product_id bigint, batch_id bigint, quantity string, unit_price string, discount_amount string, tax_amount string"
BILL_REQUEST = (
    "seq bigint, received_at timestamp, role string, invoice_ref string, txn_type string, customer_name string, "
    f"dept_name string, user_id bigint, remarks string, items array<struct<{_LINE}>>, {_LINE}"
)
PRODUCT_REQUEST = (
    "seq bigint, id bigint, sku string, barcode string, title string, category_id bigint, unit_of_measure string, "
    "min_reorder_level int, domain_preset string, brand string, storage_location string"
)
