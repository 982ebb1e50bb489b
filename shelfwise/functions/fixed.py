"""Fixed values that results depend on."""

# Allowed codes per enumerated column.
ROLES = ["ADMIN", "MANAGER", "CLERK", "AUDITOR"]
USER_STATUSES = ["ACTIVE", "INACTIVE"]
DOMAINS = ["GENERAL", "PHARMACY", "GROCERY", "ELECTRONICS", "APPAREL", "HARDWARE"]
TXN_TYPES = ["STOCK_IN", "SALE", "INTERNAL_USE", "DAMAGE_WRITE_OFF", "VENDOR_RETURN", "ADJUSTMENT"]
PAYMENT_STATUSES = ["PAID", "PENDING", "CREDIT", "PARTIAL"]

# What each role may do.
ROLE_PERMISSIONS = {
    "ADMIN": ["READ", "STOCK_IN", "STOCK_OUT", "MANAGE_PRODUCTS", "MANAGE_USERS", "MANAGE_SETTINGS"],
    "MANAGER": ["READ", "STOCK_IN", "STOCK_OUT", "MANAGE_PRODUCTS", "EXPORT_REPORTS"],
    "CLERK": ["READ", "STOCK_IN", "STOCK_OUT"],
    "AUDITOR": ["READ"],
}
DEFAULT_ROLE = "CLERK"

# Display names of movement types; any other type shows as it is.
TXN_TYPE_LABELS = {
    "STOCK_IN": "📥 STOCK IN",
    "SALE": "🛒 SALE",
    "INTERNAL_USE": "🏢 INTERNAL",
    "DAMAGE_WRITE_OFF": "⚠️ DAMAGE",
    "VENDOR_RETURN": "↩️ RETURN",
}

# Labels of rows whose category is missing.
NO_CATEGORY_NAME = "General Merchandise"
NO_CATEGORY_DOMAIN = "GENERAL"

# Thresholds and page sizes.
NEAR_EXPIRY_DAYS = 30
FAST_UNITS = 10
STOCKOUT_UNITS = 5
DEFAULT_REORDER_LEVEL = 10
LEDGER_PAGE = 200
RECENT_ROWS = 5
INSIGHTS_PER_RULE = 2
TYPEAHEAD_ROWS = 50

# Ids of rows that a job creates: this base plus the request's sequence number.
NEW_ID_BASE = 1 << 40
