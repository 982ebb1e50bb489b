"""Known results on the demo rows."""

from decimal import Decimal as D

from shelfwise.plans import batches, catalog, insights, ledger, quality, reports


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_catalog_counts_products_without_a_batch(seed):
    got = sorted(rows(catalog.catalog(seed), "id", "total_stock", "batch_count"))
    assert got == [(1, 97, 2), (2, 40, 1), (3, 30, 1), (4, 0, 0), (5, 18, 1)]
    assert [r.title for r in catalog.catalog(seed).collect()] == sorted(r[3] for r in __import__("seed_data").PRODUCTS)


def test_catalog_filters(seed):
    assert rows(catalog.catalog(seed, domain="ALL", search="%-500_"), "id") == [(2,), (1,)]
    assert rows(catalog.catalog(seed, domain="PHARMACY", literal_search="amox"), "id") == [(2,)]
    assert catalog.catalog(seed, literal_search="%").isEmpty()
    assert rows(catalog.catalog(seed, category_id=2), "category_name") == [("Packaged Foods & Dairy",)]


def test_low_stock_is_inclusive_and_ascending(seed):
    assert rows(catalog.low_stock_status(seed), "id", "status") == [(4, "OUT OF STOCK"), (5, "LOW STOCK")]
    assert rows(catalog.low_stock_count(seed), "low_stock_count") == [(2,)]


def test_missing_reorder_level_never_matches(spark, seed):
    import pyspark.sql.functions as F

    bare = seed.replaced(products=seed.products.withColumn("min_reorder_level", F.lit(None).cast("int")))
    assert catalog.low_stock(bare).isEmpty()


def test_expiry_meanings_differ(seed):
    assert rows(batches.near_expiry(seed), "id", "days_to_expiry") == [(5, 0), (1, 12)]
    assert rows(batches.near_expiry_count(seed), "near_expiry_count") == [(2,)]


def test_expired_and_boundary_batches(spark, seed):
    from datetime import timedelta

    from seed_data import AS_OF, BATCHES, frame
    from shelfwise.sources import schemas

    def batch(i, days, qty=1):
        return (i, f"B{i}", 1, AS_OF + timedelta(days=days), None, qty, *BATCHES[0][6:])

    moved = seed.replaced(
        product_batches=frame(
            spark, [batch(1, -1), batch(2, 0), batch(3, 30), batch(4, 31), batch(5, 3, 0)], schemas.PRODUCT_BATCHES, 2
        )
    )
    assert rows(batches.near_expiry(moved), "id") == [(1,), (2,), (3,)]
    assert rows(batches.near_expiry_count(moved), "near_expiry_count") == [(2,)]
    assert rows(batches.in_stock(moved, 1), "id", "is_near_expiry") == [(1, 1), (2, 1), (3, 1), (4, 0)]


def test_first_expired_first_out(seed):
    got = rows(batches.in_stock(seed, 1), "batch_number", "days_to_expiry", "is_near_expiry")
    assert got == [("BATCH-PHARM-2026A", 12, 1), ("BATCH-PHARM-2026B", 250, 0)]
    assert sorted(rows(batches.fefo_pick(seed), "product_id", "batch_id")) == [(1, 1), (2, 3), (3, 4), (5, 5)]


def test_dated_batch_goes_before_undated(spark, seed):
    from seed_data import BATCHES, frame
    from shelfwise.sources import schemas

    undated = (1, "U", 1, None, *BATCHES[0][4:])
    dated = (2, "D", 1, *BATCHES[1][3:])
    mixed = seed.replaced(product_batches=frame(spark, [undated, dated], schemas.PRODUCT_BATCHES, 2))
    assert rows(batches.in_stock(mixed, 1), "id") == [(2,), (1,)]
    assert rows(batches.fefo_pick(mixed), "batch_id") == [(2,)]


def test_offer_discount_and_texts(seed):
    got = dict(rows(batches.offered_discount(seed), "batch_id", "discount_amount"))
    assert got[1] == D("3.00") and got[2] == D("0.00") and got[3] == D("1.25") and got[5] == D("0.25")
    assert (4, "N/A") in rows(batches.display(seed), "batch_id", "expiry_text")


def test_sales(seed):
    got = rows(
        reports.sales_summary(seed), "total_bills", "total_units_sold", "gross_sales", "total_discounts", "net_revenue"
    )
    assert got == [(1, 2, D("24.00"), D("0.00"), D("24.00"))]
    assert rows(reports.sales_by_category(seed), "category_name", "total_products_sold", "total_units_sold", "revenue") == [
        ("Pharmaceuticals", 1, 2, D("24.00"))
    ]
    nothing = rows(reports.sales_summary(seed, "TODAY"), "total_bills", "total_units_sold", "gross_sales")
    assert nothing == [(0, 0, D("0.00"))]


def test_negative_quantities_count_as_units(seed):
    import pyspark.sql.functions as F

    written = seed.replaced(
        transactions=seed.transactions.withColumn(
            "quantity", F.when(F.col("txn_type") == "STOCK_IN", F.col("quantity")).otherwise(-F.col("quantity"))
        )
    )
    assert rows(reports.sales_summary(written), "total_units_sold") == [(2,)]
    assert reports.velocity_by_product(written).collect() == reports.velocity_by_product(seed).collect()


def test_velocity(seed):
    got = dict(rows(reports.velocity_by_product(seed), "id", "velocity_status"))
    assert got == {1: "MODERATE_MOVING", **{i: "SLOW_DEAD_STOCK" for i in (2, 3, 4, 5)}}
    columns = (
        "category_name", "total_products", "total_stock", "total_units_sold", "total_revenue", "fast_products_count",
        "dead_products_count",
    )
    written = sorted(rows(reports.velocity_by_category(seed), *columns))
    assert written == [
        ("Consumer Electronics", 2, 30, 0, D("0.00"), 0, 2),
        ("Packaged Foods & Dairy", 1, 18, 0, D("0.00"), 0, 1),
        ("Pharmaceuticals", 2, 137, 4, D("48.00"), 0, 1),
    ]
    corrected = sorted(rows(reports.velocity_by_category(seed, per_batch=False), *columns))
    assert corrected == written[:2] + [("Pharmaceuticals", 2, 137, 2, D("24.00"), 0, 1)]


def test_unmatched_category_is_grouped_apart_from_its_namesake(spark, seed):
    import pyspark.sql.functions as F

    moved = seed.replaced(
        products=seed.products.withColumn("category_id", F.when(F.col("id") == 5, 4).when(F.col("id") == 4, 99).otherwise(1))
    )
    labels = [r.category_name for r in reports.valuation_by_category(moved).collect()]
    assert labels.count("General Merchandise") == 2
    assert len(rows(reports.valuation_drilldown(moved, "General Merchandise"), "id")) == 2


def test_valuation(seed):
    columns = ("category_name", "total_cost_value", "total_selling_value", "projected_margin")
    assert rows(reports.valuation_by_category(seed), *columns) == [
        ("Pharmaceuticals", D("1817.50"), D("2582.50"), D("765.00")),
        ("Consumer Electronics", D("360.00"), D("749.70"), D("389.70")),
        ("Packaged Foods & Dairy", D("21.60"), D("45.00"), D("23.40")),
    ]
    assert rows(reports.valuation_totals(seed), "total_cost_value", "total_selling_value") == [(D("2199.10"), D("3377.20"))]


def test_shares_add_up_and_survive_a_zero_total(seed):
    shares = [r.share for r in reports.with_share(reports.valuation_by_category(seed), "total_cost_value").collect()]
    assert abs(sum(shares) - 1) < 1e-5
    empty = seed.replaced(product_batches=seed.product_batches.limit(0))
    assert {r.share for r in reports.with_share(reports.valuation_by_category(empty), "total_cost_value").collect()} == {None}


def test_insights(seed):
    got = rows(insights.smart_insights(seed), "type", "title")
    assert [t for t, _ in got] == ["WARNING", "WARNING", "INFO", "INFO"]
    assert [t.split(": ")[1] for _, t in got] == [
        "Batch BATCH-FOOD-BREAD1", "Batch BATCH-PHARM-2026A", "Amoxicillin 250mg Capsules", "Wireless Ergonomic Mouse",
    ]
    first = insights.clearance(seed).collect()[0].description
    assert first.startswith('18 units of "Whole Wheat Bread 400g" expire on 2026-08-08. Apply a 20-30%')


def test_all_clear_when_no_rule_fires(seed):
    calm = seed.replaced(product_batches=seed.product_batches.limit(0), transactions=seed.transactions.limit(0))
    assert rows(insights.smart_insights(calm), "type", "title") == [("SUCCESS", "Optimal Inventory Health!")]


def test_dashboard(seed):
    got = reports.dashboard_stats(seed).collect()[0].asDict()
    assert got["today_stock_in_count"] == 0 and got["all_time_stock_in_value"] == D("1000.00")
    assert got["all_time_stock_out_count"] == 1 and got["low_stock_count"] == 2 and got["near_expiry_count"] == 2
    cards = dict(rows(reports.dashboard_headline(seed), "card", "headline_value"))
    assert cards == {"stock_in": D("1000.00"), "stock_out": D("24.00")}


def test_ledger_joins_keep_rows_without_a_batch(seed):
    got = rows(ledger.ledger(seed), "id", "product_sku", "batch_number", "supplier_name", "user_name")
    assert got == [
        (3, "ELEC-1002", None, None, "Store Manager"),
        (2, "PHARM-5001", "BATCH-PHARM-2026A", None, "Inventory Clerk"),
        (1, "PHARM-5001", "BATCH-PHARM-2026A", "PharmaSupply Co.", "Super Admin"),
    ]


def test_ledger_filters(seed):
    def ids(**filters):
        return [r.id for r in ledger.ledger(seed, **filters).collect()]

    assert ids(txn_type="SALE") == [2] and ids(txn_type="ALL") == [3, 2, 1]
    assert ids(period="TODAY") == [] and ids(period="THIS_WEEK") == [3, 2, 1] and ids(period="THIS_YEAR") == [3, 2, 1]
    assert ids(search="bill-1001") == [2]
    assert ids(search="PHARM_2026") == [2, 1]
    assert ids(search="TXN%0_") == [3, 2, 1]
    assert ids(literal_search="TXN%") == []
    assert ids(literal_search="usb-c") == [3]


def test_ledger_page_equals_the_head_of_the_ledger(seed):
    whole = ledger.ledger(seed)
    for n in (1, 2, 3, 50):
        page = ledger.ledger_page(seed, n).select(*whole.columns).collect()
        assert page == whole.collect()[:n]
    assert ledger.page_size("50abc") == 50 and ledger.page_size(" 3.7") == 3
    assert ledger.page_size("0") == ledger.page_size("many") == ledger.page_size(None) == 200


def test_ledger_display_and_export(seed):
    shown = {r.txn_number: r for r in ledger.display(ledger.ledger(seed)).collect()}
    assert shown["TXN-IN-20260801-01"].shown_quantity == "+100" and shown["TXN-IN-20260801-01"].time_of_day == "09:30"
    assert shown["TXN-OUT-20260803-01"].shown_quantity == "-2"
    assert shown["TXN-OUT-20260803-01"].counterparty == "N/A" and shown["TXN-OUT-20260803-01"].batch_number == "N/A"
    assert ledger.export_columns(ledger.ledger(seed)).columns[0] == "Timestamp"


def test_typed_text_resolves_title_before_subtitle(seed):
    got = dict(rows(catalog.resolve_typed(seed, ["wireless ergonomic mouse", "PHARM-500", " 8903003004001", "zzz"]), "typed", "product_id"))
    assert got == {"wireless ergonomic mouse": 3, "pharm-500": 1, "8903003004001": 5, "zzz": None}
    assert rows(catalog.typeahead_products(seed, "stock: 0"), "id") == [(4,)]
    assert rows(catalog.typeahead_suppliers(seed, "sarah"), "title") == [("Global Electronics Ltd.",)]


def test_quality(seed):
    assert {r.rule: r.extra_rows for r in quality.duplicates(seed).collect()}["products.sku"] == 0
    import pyspark.sql.functions as F

    twice = seed.replaced(products=seed.products.unionByName(seed.products.filter(F.col("id") == 1)))
    assert {r.rule: r.extra_rows for r in quality.duplicates(twice).collect()}["products.sku"] == 1
    fewer = seed.replaced(products=seed.products.filter(F.col("id") != 1))
    orphans = {r.rule: r.orphan_rows for r in quality.orphans(fewer).collect()}
    assert orphans["product_batches.product_id"] == 2 and orphans["transactions.product_id"] == 2
    odd = seed.replaced(users=seed.users.withColumn("role", F.lit("ROOT")))
    found = {(r.column_name, r.check): r.violations for r in quality.domain_violations(odd).collect()}
    assert found["users.role", "allowed values"] == 4 and found["users.name", "not null"] == 0


def test_reconcile_reports_the_gap(seed):
    got = {r.batch_id: (r.ledger_qty, r.on_hand_qty, r.reconciles) for r in batches.reconcile(seed).collect()}
    assert got[1] == (98, 12, False) and got[2] == (None, 85, False)
