"""Roll-ups, bitmaps, the gram index, stock counts, carts and seeds with several keys."""

from __future__ import annotations

import datetime
import os
import random
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import trigrams
from shelfwise.operators.upsert import upsert_by_any
from shelfwise.plans import batches, bills, catalog, ledger, reports, rollups, search

MOVES = (
    "txn_number string, txn_type string, product_id bigint, batch_id bigint, quantity int, total_amount decimal(10,2),"
    " discount_amount decimal(10,2), invoice_ref string, txn_date timestamp"
)
NOON = datetime.datetime(2026, 8, 8, 12)


def moves(rng: random.Random, count: int, first: int = 0) -> list[tuple]:
    kinds = ["SALE", "SALE", "STOCK_IN", "INTERNAL_USE"]
    return [
        (
            f"T{first + i}", rng.choice(kinds), rng.choice([1, 2, 3, 4, 5]), rng.randrange(1, 6), rng.randrange(1, 20), Decimal(rng.randrange(1, 9999)) / 100,
            Decimal(rng.randrange(0, 99)) / 100, rng.choice([None, f"B{rng.randrange(60)}"]), NOON - datetime.timedelta(days=rng.randrange(0, 400)),
        )
        for i in range(count)
    ]


@pytest.fixture()
def loads(spark, seed, tmp_path):
    """Three loads with movements of all days, each later than the one before, and a tail."""
    rng = random.Random(12)
    parts = [moves(rng, 150, 1000 * i) for i in range(4)]
    frames = [spark.createDataFrame(p, MOVES) for p in parts]
    whole = spark.createDataFrame(sum(parts, []), MOVES)
    stored = rollups.RollUps(spark, str(tmp_path / "rolled"))
    for n in range(3):
        stored.add(n, frames[n])
    return stored, frames, seed.replaced(movements=whole, transactions=whole), str(tmp_path / "rolled")


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_reports_from_rollups_and_tail(loads):
    stored, frames, tables, _ = loads
    same(rollups.dashboard_stats(tables, stored, frames[3]), reports.dashboard_stats(tables))
    same(rollups.velocity_by_product(tables, stored, frames[3]), reports.velocity_by_product(tables))
    stored.add(3, frames[3])
    same(rollups.dashboard_stats(tables, stored), reports.dashboard_stats(tables))
    for period in rollups.PERIODS:
        same(rollups.sales_summary(tables, stored, period), reports.sales_summary(tables, period))
    counts = {r.period: r.total_bills for r in rollups.bills_by_period(tables, stored).collect()}
    assert counts == {p: reports.sales_summary(tables, p).first().total_bills for p in rollups.PERIODS}


def test_a_load_touches_its_own_days_and_repeats_safely(loads):
    stored, frames, tables, root = loads
    before = {name: sorted(os.listdir(f"{root}/sums/{name}")) for name in ("load=0", "load=1")}
    stored.add(2, frames[2])  # again, as after a failure
    same(rollups.dashboard_stats(tables, stored, frames[3]), reports.dashboard_stats(tables))
    assert before == {name: sorted(os.listdir(f"{root}/sums/{name}")) for name in before}
    one_day = frames[3].limit(1)
    stored.add(3, one_day)
    assert stored.spark.read.parquet(f"{root}/sums/load=3").count() == 1


def test_bill_numbers_are_dense(loads):
    stored, frames, _, root = loads
    rows = stored.spark.read.parquet(f"{root}/bills").collect()
    sold = {r.invoice_ref for f in frames[:3] for r in f.where("txn_type = 'SALE' AND invoice_ref IS NOT NULL").collect()}
    assert sorted(r.number for r in rows) == list(range(1, len(sold) + 1))
    assert {r.invoice_ref for r in rows} == sold


def test_bitmaps_over_several_buckets(spark, seed, tmp_path):
    """More bills than one bitmap holds, on two days that share some."""
    rows = [(f"T{i}", "SALE", 1, 1, 1, Decimal(1), Decimal(0), f"B{i % 40_000}", NOON - datetime.timedelta(days=i % 2)) for i in range(50_000)]
    stored = rollups.RollUps(spark, str(tmp_path / "many"))
    stored.add(0, spark.createDataFrame(rows, MOVES))
    assert rollups.distinct_bills(seed, stored).first()[0] == 40_000
    assert stored.bitmaps().select("bucket").distinct().count() == 2


def test_levels_add_up(seed):
    rows = reports.valuation_by_level(seed).collect()
    total = next(r for r in rows if r.level == "TOTAL")
    for level in ("CATEGORY", "DOMAIN"):
        assert sum(r.total_cost_value for r in rows if r.level == level) == total.total_cost_value
    assert total.domain_type is None and total.total_products == seed.products.count()


# --- index


@pytest.mark.parametrize("term,grams", [("ab", []), ("a%b_c", []), ("Blue_b%t", ["blu", "lue"]), ("x%abcd", ["abc", "bcd"]), ("a\\%bcd", [])])
def test_grams_of_a_term(term, grams):
    assert trigrams.term_grams(term) == grams


def indexed(spark, seed, root):
    index = trigrams.GramIndex(spark, root)
    search.index_products(index, 0, seed.products)
    search.index_batches(index, 1, seed.product_batches)
    search.index_movements(index, 2, seed.transactions)
    return index


@pytest.mark.parametrize("term", ["para", "PHARM", "2026a", "a", "p%r_c", "txn-", "no such text", "%%%"])
def test_indexed_search_has_the_rows_of_the_scan(spark, seed, tmp_path, term):
    index = indexed(spark, seed, str(tmp_path / "grams"))
    same(search.ledger_search(seed, index, term), ledger.ledger(seed, search=term))
    same(search.catalog_search(seed, index, term), catalog.catalog(seed, search=term))


def test_a_task_hands_on_each_gram_of_a_thing_once():
    rows = [("day", "1", ["abcd", None, "", "xy"]), ("day", "1", ["abcd zabc"]), ("day", "1", ["é🙂漢字", "abc"]), ("day", "2", [None]), ("sku", "2", ["a", "b", "cde", "abc"])]
    column = lambda i, kind: pa.array([r[i] for r in rows], kind)
    whole = pa.record_batch({"kind": column(0, pa.string()), "ref": column(1, pa.string()), "texts": column(2, pa.list_(pa.string()))})
    got = [tuple(r.values()) for part in trigrams._gatherer()(iter([whole.slice(0, 2), whole.slice(2)])) for r in part.to_pylist()]
    want = {(kind, ref, t[i : i + 3]) for kind, ref, texts in rows for t in texts if t for i in range(len(t) - 2)}
    assert len(got) == len(set(got)) and set(got) == want


def test_index_grows_and_reads_its_own_folders(spark, seed, tmp_path):
    root = str(tmp_path / "grams")
    index = indexed(spark, seed, root)
    added = spark.createDataFrame([(77, "Zebra Ink", "ZB-77", None)], "id bigint, title string, sku string, barcode string")
    assert index.candidates("zebra").count() == 0
    search.index_products(index, 3, added)
    search.index_products(index, 3, added)  # stored twice, there once
    assert [tuple(r) for r in index.candidates("zebra").collect()] == [("product", "77")]
    plan = index.candidates("zebra")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    files = index.candidates("zebra").inputFiles()
    grams = set(trigrams.term_grams("zebra"))
    wanted = {r.b for r in spark.createDataFrame([(g,) for g in grams], "g string").select(trigrams._bucket(F.col("g")).alias("b")).collect()}
    assert len(wanted) < trigrams.BUCKETS and files


# --- stock counts


def test_a_planted_fault_is_named_with_its_day(spark):
    day = datetime.date(2026, 8, 1)
    at = lambda n: datetime.datetime.combine(day + datetime.timedelta(days=n), datetime.time(9))
    rows = [(f"{b}-{n}", "STOCK_IN" if n % 3 == 0 else "SALE", b, 9 if n % 3 == 0 else 2, at(n)) for b in (1, 2, 3) for n in range(20)]
    ledger_rows = spark.createDataFrame(rows, "txn_number string, txn_type string, batch_id bigint, quantity int, txn_date timestamp")
    held = {b: [sum((9 if k % 3 == 0 else -2) for k in range(n + 1)) for n in range(20)] for b in (1, 2, 3)}
    counts = [(b, day + datetime.timedelta(days=n), held[b][n] + (4 if b == 2 and n >= 11 else 0)) for b in (1, 2, 3) for n in range(0, 20, 2)]
    counts += [(3, day - datetime.timedelta(days=5), 0), (9, day, 3), (1, day + datetime.timedelta(days=90), held[1][19])]
    found = batches.first_divergence(ledger_rows, spark.createDataFrame(counts, "batch_id bigint, count_day date, counted bigint")).collect()
    got = {r.batch_id: (r.counts, r.first_wrong_day, r.booked, r.counted, r.last_right_day) for r in found}
    assert got[2] == (10, day + datetime.timedelta(days=12), held[2][12], held[2][12] + 4, day + datetime.timedelta(days=10))
    assert got[1] == (11, None, None, None, day + datetime.timedelta(days=90))
    assert got[3] == (11, None, None, None, day + datetime.timedelta(days=18))
    assert got[9] == (1, day, 0, 3, None)


# --- carts and seeds


def test_cart_refuses_what_a_batch_does_not_have(spark):
    lines = [
        (1, 1, 7, 70, 4, "10", "1"), (1, 2, 7, 70, 9, "11", "2"), (1, 3, 7, 70, 6, "12", "3"), (1, 4, 7, 70, 1, "13", "0"),
        (2, 1, 7, 70, 11, "10", "0"), (3, 1, 7, 71, 1, "10", "0"), (4, 1, 8, 70, 10, "2", "30"),
    ]
    money = "decimal(10,2)"
    df = spark.createDataFrame(lines, "seq bigint, line_no int, product_id bigint, batch_id bigint, qty int, p string, d string")
    df = df.select("*", F.col("p").cast(money).alias("unit_price"), F.col("d").cast(money).alias("discount_amount"))
    stock = spark.createDataFrame([(70, "L70", 10)], "id bigint, batch_number string, available_qty int")
    cart = {r.seq: r for r in bills.merged_lines(df, stock).collect()}
    assert set(cart) == {1, 4}
    # 4 then 6 units: first line's price and discount stay, the subtotal goes by the last one's
    assert (cart[1].quantity, cart[1].merged, cart[1].line_no) == (10, 2, 1)
    assert (cart[1].unit_price, cart[1].discount_amount, cart[1].subtotal) == (Decimal("10.00"), Decimal("1.00"), Decimal("115.00"))
    assert cart[4].subtotal == Decimal("0.00")
    refused = {(r.seq, r.line_no): r.reason for r in bills.cart_rejects(df, stock).collect()}
    assert refused == {
        (1, 2): "Cannot exceed 10 units for Batch #L70.", (1, 4): "Cannot exceed 10 units for Batch #L70.",
        (2, 1): "Requested 11 units, but selected batch only has 10 units available.", (3, 1): "Batch ID 71 not found in database.",
    }


def test_seeds_with_two_unique_keys(spark):
    rng = random.Random(6)
    stored = [(i, f"S{i}", f"B{i}" if i % 2 else None, "old") for i in range(1, 30)]
    incoming = [(100 + n, n, rng.choice([f"s{rng.randrange(60)}", f"n{rng.randrange(80)}", None]), rng.choice([None, f"b{rng.randrange(40)}", f"X{rng.randrange(50)}"]), f"t{n}") for n in range(400)]
    rows = {i: [s, b, t] for i, s, b, t in stored}
    by_sku, by_bar = {s.lower(): i for i, s, _, _ in stored}, {b.lower(): i for i, _, b, _ in stored if b}
    for i, _, s, b, t in incoming:
        if s is None:
            continue
        target = by_sku.get(s.lower(), by_bar.get(b.lower()) if b else None)
        if target is not None:
            rows[target][2] = t
            continue
        rows[i] = [s, b, t]
        by_sku[s.lower()] = i
        if b:
            by_bar[b.lower()] = i
    old = spark.createDataFrame(stored, "id bigint, sku string, barcode string, title string")
    new = spark.createDataFrame(incoming, "id bigint, seq bigint, sku string, barcode string, title string")
    got = upsert_by_any(old, new, ["sku", "barcode"], "title", "seq").collect()
    assert {r.id: [r.sku, r.barcode, r.title] for r in got} == rows and len(got) == len(rows)
    assert upsert_by_any(old, new.limit(0), ["sku", "barcode"], "title", "seq").count() == 29
