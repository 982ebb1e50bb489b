"""Every query by name, as a function of a session and a folder of test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.values import parse_decimal, parse_int, round2
from .operators import trigrams
from .operators.guard import guarded_balance
from .operators.lineage import cut, work_path
from .operators.upsert import seed_upsert, upsert_by_any
from .plans import access, batches, bills, catalog, insights, ledger, products, quality, receipts, reports, rollups
from .plans import search as index_search
from .sources import requests, scaled, sinks
from .sources.tables import Tables
from .streaming import balances, runs, stock
from .streaming import movements as live

TYPED = ["red widget", " SKU-00000012 ", "8900000000005", "Stock: 0 kg", "no such thing"]


def _on_tables(build: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(scaled.load(spark, sf_dir))


def _with_used_categories(build: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = scaled.load(spark, sf_dir)
        return build(tables.replaced(categories=lambda: scaled.categories_in_use(spark, sf_dir)))

    return run


READS: dict[str, Callable[[Tables], DataFrame]] = {
    # ledger
    "ledger": ledger.ledger,
    "ledger_by_type": lambda t: ledger.ledger(t, txn_type="VENDOR_RETURN"),
    "ledger_today": lambda t: ledger.ledger(t, period="TODAY"),
    "ledger_week": lambda t: ledger.ledger(t, period="THIS_WEEK"),
    "ledger_month": lambda t: ledger.ledger(t, period="THIS_MONTH"),
    "ledger_year": lambda t: ledger.ledger(t, period="THIS_YEAR"),
    "ledger_search": lambda t: ledger.ledger(t, search="blue_b%t"),
    "ledger_search_literal": lambda t: ledger.ledger(t, literal_search="Blue Bolt"),
    "ledger_latest": ledger.ledger_page,
    "ledger_recent": ledger.recent,
    "ledger_search_latest": lambda t: ledger.ledger_page(t, "50abc", txn_type="SALE", period="THIS_YEAR", search="blue%t"),
    "ledger_display": lambda t: ledger.display(ledger.ledger(t, period="THIS_YEAR")),
    "ledger_export": lambda t: ledger.export_columns(ledger.ledger(t, period="THIS_YEAR")),
    # catalog
    "catalog": catalog.catalog,
    "catalog_by_domain": lambda t: catalog.catalog(t, domain="PHARMACY"),
    "catalog_by_category": lambda t: catalog.catalog(t, category_id=3),
    "catalog_search": lambda t: catalog.catalog(t, search="red%g_t"),
    "catalog_search_literal": lambda t: catalog.catalog(t, literal_search="RED W"),
    "catalog_status": catalog.status,
    "low_stock": catalog.low_stock,
    "low_stock_status": catalog.low_stock_status,
    "low_stock_count": catalog.low_stock_count,
    "typeahead_products": lambda t: catalog.typeahead_products(t, " Bolt "),
    "resolve_typed_product": lambda t: catalog.resolve_typed(t, TYPED),
    "list_suppliers": lambda t: catalog.by_name(t.suppliers),
    "typeahead_suppliers": lambda t: catalog.typeahead_suppliers(t, "agent 1"),
    # batches
    "stock_by_product": lambda t: batches.stock_by_product(t.stock),
    "fefo_batches": batches.in_stock,
    "fefo_pick": batches.fefo_pick,
    "near_expiry": batches.near_expiry,
    "near_expiry_count": batches.near_expiry_count,
    "batch_discount": batches.offered_discount,
    "batch_display": batches.display,
    "stock_reconcile": batches.reconcile,
    # reports
    "dashboard_stats": reports.dashboard_stats,
    "dashboard_headline": reports.dashboard_headline,
    "sales_summary": reports.sales_summary,
    "sales_summary_month": lambda t: reports.sales_summary(t, "THIS_MONTH"),
    "sales_by_category": reports.sales_by_category,
    "sales_by_category_search": lambda t: reports.sales_by_category(t, search="FOOD"),
    "sales_by_product": reports.sales_by_product,
    "sales_share": lambda t: reports.with_share(reports.sales_by_category(t), "revenue"),
    "velocity_by_product": reports.velocity_by_product,
    "velocity_by_category": reports.velocity_by_category,
    "velocity_by_category_dedup": lambda t: reports.velocity_by_category(t, per_batch=False),
    "velocity_drilldown": lambda t: reports.velocity_drilldown(t, "General Merchandise", "FAST_MOVING", "ring"),
    "velocity_status_counts": reports.velocity_status_counts,
    "stock_share": lambda t: reports.with_share(reports.velocity_by_category(t), "total_stock"),
    "valuation_by_category": reports.valuation_by_category,
    "valuation_by_product": reports.valuation_by_product,
    "valuation_totals": reports.valuation_totals,
    "valuation_by_level": reports.valuation_by_level,
    "sales_by_level": reports.sales_by_level,
    "valuation_drilldown": lambda t: reports.valuation_drilldown(t, "Pharmaceuticals", "sku-0"),
    "value_share": lambda t: reports.with_share(reports.valuation_by_category(t), "total_selling_value"),
    "report_export": lambda t: sinks.quoted(reports.velocity_by_product(t)),
    # insights
    "sold_products": insights.sold_products,
    "never_sold": insights.never_sold,
    "insight_stockout": insights.stockout,
    "insight_clearance": insights.clearance,
    "insight_dead_stock": insights.dead_stock,
    "smart_insights": insights.smart_insights,
    # integrity
    "dq_duplicates": quality.duplicates,
    "dq_orphans": quality.orphans,
    "dq_domain": quality.domain_violations,
}


def _received(spark: SparkSession, sf_dir: str) -> receipts.Received:
    t = scaled.load(spark, sf_dir)
    return receipts.receive(requests.receipts(scaled.table(spark, sf_dir, "orders")), t.products, t.product_batches, t.suppliers, t.users)


def _stock_in_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = scaled.load(spark, sf_dir)
    return receipts.match_products(receipts.normalise(requests.receipts(scaled.table(spark, sf_dir, "orders"))), t.products).select(
        "seq", "matched_id"
    )


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = scaled.load(spark, sf_dir)
    return bills.priced_lines(bills.bill_lines(requests.bills(scaled.table(spark, sf_dir, "orders"))), t.product_batches, t.products)


def _cart(spark: SparkSession, sf_dir: str, build: Callable = bills.merged_lines) -> DataFrame:
    priced = _priced(spark, sf_dir).filter(F.col("problem").isNull())
    return build(priced, scaled.load(spark, sf_dir).product_batches)


def _settled_sales(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = scaled.load(spark, sf_dir)
    opening = t.product_batches.select(F.col("id").alias("batch_id"), "available_qty")
    return t.product_batches, bills.settle(requests.sale_demand(t.movements), opening)


def _checked_out(spark: SparkSession, sf_dir: str) -> bills.CheckedOut:
    t = scaled.load(spark, sf_dir)
    held = cut(t.product_batches.select("id", "product_id", "selling_price", "available_qty"), "batches")  # read for prices and for stock
    return bills.check_out(requests.bills(scaled.table(spark, sf_dir, "orders")), t.products, held)


def _batches_after_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, settled = _settled_sales(spark, sf_dir)
    return bills.batches_after(held, settled).select("id", "product_id", "available_qty")


def _created(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = scaled.load(spark, sf_dir)
    return products.create(requests.product_creates(spark, sf_dir), t.products, t.categories)


def _updated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return products.update(requests.product_updates(spark, sf_dir), scaled.products(spark, sf_dir))


def _batches_after_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches left by the deletions; every planned product has a batch, which goes with it."""
    t = scaled.load(spark, sf_dir)
    planned = requests.unsold_products(spark, sf_dir, t.products)
    lots = t.product_batches.select("id", "product_id", "available_qty")
    empty = planned.select("id", F.col("id").alias("product_id"), F.lit(0).cast(lots.schema["available_qty"].dataType).alias("available_qty"))
    asked = requests.product_deletes(spark, sf_dir)
    return products.delete(asked, t.products.unionByName(planned), lots.unionByName(empty), t.movements)[1]


def _appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows of the receipts, written by day and read back."""
    rows, path = _received(spark, sf_dir).ledger, work_path(spark, "ledger")
    sinks.append_ledger(rows, path)
    return spark.read.parquet(path).select(*rows.columns)


def _json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written as JSON rows and read back."""
    rows, path = reports.velocity_by_product(scaled.load(spark, sf_dir)), work_path(spark, "json")
    sinks.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


def _deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = scaled.load(spark, sf_dir)
    all_products = t.products.unionByName(requests.unsold_products(spark, sf_dir, t.products))
    return products.delete_outcome(requests.product_deletes(spark, sf_dir), all_products, t.movements)


def _parsed(spark: SparkSession, sf_dir: str, value: Callable) -> DataFrame:
    return requests.receipts(scaled.table(spark, sf_dir, "orders")).select("seq", *value())


JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "list_categories": _with_used_categories(lambda t: catalog.by_name(t.categories)),
    "typeahead_categories": _with_used_categories(lambda t: catalog.typeahead_categories(t, "domain: g")),
    "seed_upsert": lambda spark, sf_dir: seed_upsert(
        scaled.products(spark, sf_dir), requests.seed_rows(spark, sf_dir), "sku", "title", "seq"
    ),
    "seed_upsert_products": lambda spark, sf_dir: upsert_by_any(
        scaled.products(spark, sf_dir), requests.seed_products(spark, sf_dir), ["sku", "barcode"], "title", "seq"
    ),
    "seed_upsert_batches": lambda spark, sf_dir: seed_upsert(
        scaled.load(spark, sf_dir).product_batches.select("id", "batch_number", "product_id", F.col("available_qty").cast("int").alias("available_qty")),
        requests.seed_batches(spark, sf_dir), ["batch_number", "product_id"], "available_qty", "seq",
    ),
    "seed_upsert_categories": lambda spark, sf_dir: seed_upsert(
        scaled.load(spark, sf_dir).categories.select(F.col("id").cast("bigint").alias("id"), "name", "domain_type"),
        requests.seed_categories(spark, sf_dir), "name", "domain_type", "seq",
    ),
    "stock_in_normalised": lambda spark, sf_dir: receipts.normalise(requests.receipts(scaled.table(spark, sf_dir, "orders"))).drop("exact_cost"),
    "stock_in_product_match": _stock_in_match,
    "stock_in_batches": lambda spark, sf_dir: _received(spark, sf_dir).batches,
    "stock_in_ledger": lambda spark, sf_dir: _received(spark, sf_dir).ledger,
    "ledger_appended": _appended,
    "report_json": _json_report,
    "stock_in_new_products": lambda spark, sf_dir: _received(spark, sf_dir).new_products,
    "stock_in_rejects": lambda spark, sf_dir: _received(spark, sf_dir).rejects,
    "bill_lines": lambda spark, sf_dir: bills.bill_lines(requests.bills(scaled.table(spark, sf_dir, "orders"))),
    "bill_lines_priced": _priced,
    "bill_lines_merged": _cart,
    "cart_rejects": lambda spark, sf_dir: _cart(spark, sf_dir, bills.cart_rejects),
    "bill_totals": lambda spark, sf_dir: bills.bill_totals(_cart(spark, sf_dir)),
    "guard_single": lambda spark, sf_dir: guarded_balance(
        requests.guard_moves(scaled.table(spark, sf_dir, "events")), "stock_key", "event_id", "delta"
    ),
    "bill_guard": lambda spark, sf_dir: bills.guard_outcome(_settled_sales(spark, sf_dir)[1]),
    "bill_rejects": lambda spark, sf_dir: _checked_out(spark, sf_dir).rejects,
    "bill_ledger": lambda spark, sf_dir: _checked_out(spark, sf_dir).ledger,
    "batches_after_bills": _batches_after_bills,
    "product_create": lambda spark, sf_dir: _created(spark, sf_dir)[0],
    "product_create_rejects": lambda spark, sf_dir: _created(spark, sf_dir)[1],
    "product_update": lambda spark, sf_dir: _updated(spark, sf_dir)[0],
    "product_update_rejects": lambda spark, sf_dir: _updated(spark, sf_dir)[1],
    "product_delete_batches": _batches_after_deletion,
    "product_delete": _deletion,
    "access_allowed": lambda spark, sf_dir: access.allowed(requests.access_log(scaled.table(spark, sf_dir, "events"))),
    "access_denied": lambda spark, sf_dir: access.denied(requests.access_log(scaled.table(spark, sf_dir, "events"))),
    "fn_parse_int": lambda spark, sf_dir: _parsed(
        spark, sf_dir, lambda: ["quantity", parse_int("quantity").alias("parsed")]
    ),
    "fn_parse_decimal": lambda spark, sf_dir: _parsed(
        spark, sf_dir, lambda: ["purchase_price", parse_decimal("purchase_price", 0).alias("parsed")]
    ),
    "fn_round2": lambda spark, sf_dir: _parsed(
        spark, sf_dir, lambda: [round2(parse_decimal("purchase_price", 0) / 8).alias("rounded")]
    ),
}

def _indexed(spark: SparkSession, sf_dir: str, search: Callable, term: str) -> DataFrame:
    """A search through an index of the tables, whose movements come in two loads."""
    tables, index = scaled.load(spark, sf_dir), trigrams.GramIndex(spark, work_path(spark, "grams"))
    index_search.index_products(index, 0, tables.products)
    index_search.index_batches(index, 1, tables.stock)
    rows = tables.transactions
    for load in range(2):
        index_search.index_movements(index, 2 + load, rows.where(F.pmod(F.xxhash64("txn_number"), F.lit(2)) == load))
    return search(tables, index, term)


def _divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = scaled.load(spark, sf_dir).movements
    return batches.first_divergence(moves, requests.stock_counts(moves))


#: Loads that the ledger is stored in for the roll-ups; what they leave is the tail.
LOADS = 3


def _rolled(spark: SparkSession, sf_dir: str, build: Callable, with_tail: bool = True) -> DataFrame:
    """A report from roll-ups of the ledger, stored in loads that each hold movements of all days."""
    tables = scaled.load(spark, sf_dir)
    part = F.pmod(F.xxhash64("order_key"), F.lit(LOADS + with_tail))
    stored = rollups.RollUps(spark, work_path(spark, "rollups"))
    for load in range(LOADS):
        stored.add(load, tables.movements.where(part == load))
    return build(tables, stored, tables.movements.where(part == LOADS)) if with_tail else build(tables, stored)


STORED: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "dashboard_stats_rolled": lambda spark, sf_dir: _rolled(spark, sf_dir, rollups.dashboard_stats),
    "velocity_by_product_rolled": lambda spark, sf_dir: _rolled(spark, sf_dir, rollups.velocity_by_product),
    "sales_summary_rolled": lambda spark, sf_dir: _rolled(spark, sf_dir, rollups.sales_summary, with_tail=False),
    "sales_summary_month_rolled": lambda spark, sf_dir: _rolled(
        spark, sf_dir, lambda t, stored: rollups.sales_summary(t, stored, "THIS_MONTH"), with_tail=False
    ),
    "ledger_search_indexed": lambda spark, sf_dir: _indexed(spark, sf_dir, index_search.ledger_search, "blue_b%t"),
    "catalog_search_indexed": lambda spark, sf_dir: _indexed(spark, sf_dir, index_search.catalog_search, "red%g_t"),
    "stock_divergence": _divergence,
    "bills_by_period": lambda spark, sf_dir: _rolled(spark, sf_dir, rollups.bills_by_period, with_tail=False),
}


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return runs.table_stream(spark, sf_dir, name, scaled.COLUMNS[name])


def _resent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The movements as a stream in which every sale arrives twice."""
    sent = scaled.movements(_stream(spark, sf_dir, "lineitem"))
    again = scaled.movements(_stream(spark, sf_dir, "lineitem")).filter(F.col("txn_type") == "SALE")
    root, kept = work_path(spark, "kept"), live.first_only(sent.unionByName(again))
    runs.to_table(kept, root)
    return runs.rows_of(kept, root).select("txn_number", "txn_type", "product_id", "batch_id", "quantity", "total_amount", "txn_date")


def _streamed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = live.daily_totals(scaled.movements(_stream(spark, sf_dir, "lineitem")))
    return runs.latest_groups(totals, "totals", ["txn_day", "txn_type"])


def _streamed_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stock keys start empty."""
    root = work_path(spark, "guard")
    decisions = balances.guarded_issues(requests.guard_moves(_stream(spark, sf_dir, "events")), "stock_key", "event_id", "delta")
    runs.to_table(decisions, root)
    return runs.rows_of(decisions, root)


def _streamed_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_path(spark, "alerts")
    listed = scaled.products(spark, sf_dir).select("id", "min_reorder_level", F.lit(0).alias("opening_stock"))
    alerts = balances.low_stock_alerts(scaled.movements(_stream(spark, sf_dir, "lineitem")), listed)
    runs.to_table(alerts, root)
    return runs.rows_of(alerts, root)


def _stock_folder(spark: SparkSession, sf_dir: str) -> stock.StockFolder:
    t = scaled.load(spark, sf_dir)
    return stock.StockFolder.start(work_path(spark, "stock"), t.products, t.product_batches, t.suppliers, t.users)


def _streamed_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _stock_folder(spark, sf_dir)
    query = runs.each_batch(requests.receipts(_stream(spark, sf_dir, "orders")), folder.root, folder.receive)
    return folder.batches(runs.last_batch(query) + 1)


def _streamed_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _stock_folder(spark, sf_dir)
    runs.each_batch(requests.bills(_stream(spark, sf_dir, "orders")), folder.root, folder.issue)
    return folder.all_of("ledger")


STREAMS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "stream_receipts": _streamed_receipts,
    "stream_bills": _streamed_bills,
    "stream_guard": _streamed_guard,
    "stream_daily_totals": _streamed_totals,
    "stream_dedup": _resent,
    "stream_low_stock_alerts": _streamed_alerts,
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: _on_tables(build) for name, build in READS.items()},
    **JOBS,
    **STORED,
    **STREAMS,
}
