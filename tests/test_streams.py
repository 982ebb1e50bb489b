"""Streams give what one batch run gives, also over several micro-batches."""

from __future__ import annotations

import datetime
import json
import os
import random
import shutil

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from check_oracle import oracle_rows, rows_of
from shelfwise.plans import bills, receipts
from shelfwise.sources import requests, schemas
from shelfwise.streaming import balances, movements, runs, stock

MOVE = "txn_number string, txn_type string, product_id bigint, quantity int, total_amount decimal(10,2), txn_date timestamp"


def feed(tmp_path, spark, schema, *files, per_trigger=1):
    """A stream over JSON files, one micro-batch each."""
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate(files):
        file = folder / f"{i}.json"
        file.write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))  # files are read oldest first
    return requests.stream_json(spark, str(folder), schema, per_trigger)


@pytest.fixture()
def work(spark, tmp_path):
    yield str(tmp_path / "work")
    shutil.rmtree(tmp_path / "work", ignore_errors=True)


def move(n, kind="SALE", day="2026-08-08", product=1, qty=1):
    return {
        "txn_number": n, "txn_type": kind, "product_id": product, "quantity": qty, "total_amount": 2.5,
        "txn_date": f"{day}T10:00:00Z",
    }


def guard_files(tmp_path, *files):
    return [[{"k": k, "o": o, "d": d} for k, o, d in rows] for rows in files]


def test_balances_carry_over_micro_batches(spark, tmp_path, work):
    files = guard_files(tmp_path, [(1, 2, -3), (1, 1, 5), (2, 1, -1)], [(1, 3, -3), (1, 4, -2)])
    stream = feed(tmp_path, spark, "k bigint, o bigint, d bigint", *files)
    opening = spark.createDataFrame([(2, 1), (3, 9)], "k bigint, balance bigint")
    decisions = balances.guarded_issues(stream, "k", "o", "d", opening)
    runs.to_table(decisions, work)
    got = {(r.k, r.o): (r.accepted, r.balance) for r in runs.rows_of(decisions, work).collect()}
    assert got == {(1, 1): (True, 5), (1, 2): (True, 2), (1, 3): (False, 2), (1, 4): (True, 0), (2, 1): (True, 0)}


def test_guard_goes_on_from_its_checkpoint(spark, tmp_path, work):
    """Stopped and started again, with a micro-batch whose commit was lost; the rows are those of one run."""
    rng = random.Random(4)
    rows = [(rng.randrange(5), i, rng.choice([-4, -1, 3])) for i in range(600)]
    files = guard_files(tmp_path, rows[:200], rows[200:400], rows[400:])
    opening = spark.createDataFrame([(0, 7)], "k bigint, balance bigint")
    schema = "k bigint, o bigint, d bigint"
    decisions = balances.guarded_issues(feed(tmp_path, spark, schema, *files[:2]), "k", "o", "d", opening)
    runs.to_table(decisions, work)
    assert runs.rows_of(decisions, work).count() == 400
    for lost in ("1", ".1.crc"):
        os.remove(f"{work}/progress/commits/{lost}")
    late = tmp_path / "in" / "2.json"
    late.write_text("\n".join(json.dumps(r) for r in files[2]))
    os.utime(late, (1_700_000_002, 1_700_000_002))
    again = balances.guarded_issues(requests.stream_json(spark, str(tmp_path / "in"), schema, 1), "k", "o", "d", opening)
    runs.to_table(again, work)
    balance, want = {0: 7}, {}
    for k, o, d in rows:
        ok = balance.get(k, 0) + d >= 0
        balance[k] = balance.get(k, 0) + (d if ok else 0)
        want[k, o] = (ok, balance[k])
    got = runs.rows_of(again, work).collect()
    assert len(got) == 600 and {(r.k, r.o): (r.accepted, r.balance) for r in got} == want


def test_late_movements_correct_their_day(spark, tmp_path):
    stream = feed(
        tmp_path, spark, MOVE,
        [move("a"), move("b", qty=2), move("c", "STOCK_IN")], [move("d", day="2026-08-11")], [move("e", day="2026-08-11")],
        [move("late", day="2026-08-08")],
    )
    totals = runs.latest_groups(movements.daily_totals(stream), "t", ["txn_day", "txn_type"]).collect()
    got = {(str(r.txn_day), r.txn_type): (r.movements, r.units) for r in totals}
    assert got == {("2026-08-08", "SALE"): (3, 4), ("2026-08-08", "STOCK_IN"): (1, 1), ("2026-08-11", "SALE"): (2, 2)}


def test_repeats_are_dropped_however_late(spark, tmp_path, work):
    stream = feed(
        tmp_path, spark, MOVE, [move("a"), move("a"), move("b")], [move("b"), move("c", day="2027-01-01")], [move("a"), move("c", day="2027-01-01")]
    )
    kept = movements.first_only(stream)
    runs.to_table(kept, work)
    assert sorted(r.txn_number for r in runs.rows_of(kept, work).collect()) == ["a", "b", "c"]


def test_a_table_changed_twice_by_one_micro_batch(spark, work):
    """A micro-batch that failed half-way, with some buckets replaced, sees the table as it first did when it runs again."""
    schema = spark.createDataFrame([], "id bigint, n int").schema
    table = runs.KeyedTable(spark, work, schema)
    rows = lambda *pairs: spark.createDataFrame(list(pairs), schema)
    held = lambda n: {tuple(r) for r in table.before(n).collect()}
    table.open(rows(*[(i, 0) for i in range(50)]))
    table.change(0, rows((1, 10), (2, 10), (60, 10)))
    assert held(0) == {(i, 0) for i in range(50)}
    after_first = {(i, 10 if i in (1, 2) else 0) for i in range(50)} | {(60, 10)}
    assert held(1) == after_first
    table.change(1, rows((1, 21)))
    assert held(1) == after_first
    table.change(1, rows((1, 21), (3, 21), (70, 21)))
    assert held(1) == after_first
    assert held(2) == {(i, {1: 21, 2: 10, 3: 21}.get(i, 0)) for i in range(50)} | {(60, 10), (70, 21)}
    assert {r.id for r in table.before(2, rows((7, 0))).collect()} >= {7}
    assert len(held(2)) > table.before(2, rows((7, 0))).count()
    table.change(2, rows())
    assert len(held(3)) == 52


ORDERED = {
    "stream_receipts": ("orders", "o_orderkey"), "stream_bills": ("orders", "o_orderkey"), "stream_guard": ("events", "event_id"),
    "stream_daily_totals": ("lineitem", None), "stream_dedup": ("lineitem", None),
    "stream_low_stock_alerts": ("lineitem", "l_shipdate"),
}


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """The smallest test tables, the streamed ones as three files each, in the order of their events."""
    source, folder = "/root/testdata/sf0.001", tmp_path_factory.mktemp("many")
    streamed = {"orders": "o_orderkey", "events": "event_id", "lineitem": "l_shipdate"}
    for file in sorted(os.listdir(source)):
        name = file.removesuffix(".parquet")
        if name not in streamed:
            os.symlink(f"{source}/{file}", folder / file)
            continue
        (folder / file).mkdir()
        rows = spark.read.parquet(f"{source}/{file}")
        ranked = rows.withColumn("_n", F.ntile(3).over(Window.orderBy(streamed[name])))
        # a day must not be split between files: the alerts go by date
        first = ranked.groupBy(streamed[name]).agg(F.min("_n").alias("_part"))
        parts = rows.join(first, streamed[name])
        for n in (1, 2, 3):
            out = folder / f"_{name}{n}"
            parts.where(F.col("_part") == n).drop("_part").select(*rows.columns).coalesce(1).write.parquet(str(out))
            part = next(out.glob("part-*.parquet"))
            target = folder / file / f"part-{n}.parquet"
            shutil.copy(part, target)
            os.utime(target, (1_700_000_000 + n, 1_700_000_000 + n))
    return str(folder)


@pytest.mark.parametrize("name", list(ORDERED))
@pytest.mark.parametrize("per_trigger", [None, 1])
def test_streams_over_many_files(spark, many_files, monkeypatch, name, per_trigger):
    monkeypatch.setattr(runs, "FILES_PER_TRIGGER", per_trigger)
    got = queries()[name](spark, many_files)
    columns, want, _ = oracle_rows("/root/testdata/sf0.001", oracle_sql()[name])
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want)


def test_alerts_fire_on_each_crossing(spark, tmp_path, work):
    stream = feed(
        tmp_path, spark, MOVE,
        [move("1", qty=4), move("2", qty=2)], [move("3", qty=1), move("4", "STOCK_IN", qty=10), move("5", qty=9)],
    )
    listed = spark.createDataFrame([(1, 5, 10), (2, 5, 10)], "id bigint, min_reorder_level int, opening_stock int")
    alerts = balances.low_stock_alerts(stream, listed)
    runs.to_table(alerts, work)
    got = runs.rows_of(alerts, work).orderBy("txn_number").collect()
    assert [(r.txn_number, r.stock, r.min_reorder_level) for r in got] == [("2", 4, 5), ("5", 4, 5)]


def test_a_call_takes_the_movements_of_many_products():
    class Held(dict):
        getValue, updateValue = dict.get, dict.__setitem__  # noqa: N815

    crossings = balances._Crossings()
    crossings.held = Held({(2,): (4,)})
    day = datetime.date(2026, 8, 1)
    rows = [(p, day, f"{p}-{n}", d, 3, 10) for p, deltas in ((1, [-8, 5, -5]), (2, [-1, 4]), (3, [-2])) for n, d in enumerate(deltas)]
    frames = [pd.DataFrame(rows[i::2], columns=["product_id", "txn_date", "txn_number", "delta", "min_reorder_level", "opening"]) for i in (0, 1)]
    got = [tuple(r) for part in crossings.handleInputRows((7,), iter(frames), None) for r in part.itertuples(index=False)]
    assert sorted(got) == [(1, "1-0", 2, 3), (1, "1-2", 2, 3), (2, "2-0", 3, 3)]
    assert crossings.held == {(1,): (2,), (2,): (7,), (3,): (8,)}


def test_products_added_later_alert(spark, tmp_path, work):
    columns = "id bigint, min_reorder_level int, opening_stock int"
    listed = str(tmp_path / "listed")
    spark.createDataFrame([(1, 5, 10)], columns).write.parquet(listed)
    stream = feed(tmp_path, spark, MOVE, [move("1", qty=4), move("2", product=3, qty=1)])
    runs.to_table(balances.low_stock_alerts(stream, spark.read.parquet(listed)), work)
    spark.createDataFrame([(3, 2, 3)], columns).write.mode("append").parquet(listed)
    late = tmp_path / "in" / "9.json"
    late.write_text("\n".join(json.dumps(r) for r in [move("3", qty=1), move("4", product=3, qty=1)]))
    stream = requests.stream_json(spark, str(tmp_path / "in"), MOVE, 1)
    alerts = balances.low_stock_alerts(stream, spark.read.parquet(listed))
    runs.to_table(alerts, work)
    assert sorted((r.txn_number, r.stock) for r in runs.rows_of(alerts, work).collect()) == [("3", 5), ("4", 2)]


def test_receipt_stream_equals_batch(spark, seed, tmp_path, work):
    rows = [
        {"seq": 1, "received_at": "2026-08-08T10:00:00Z", "product_id": 1, "batch_number": "BATCH-PHARM-2026A", "quantity": "5", "purchase_price": "1", "selling_price": "2"},
        {"seq": 2, "received_at": "2026-08-08T10:00:00Z", "product_title": "Tea", "sku": "T1", "batch_number": "X", "quantity": "7"},
        {"seq": 3, "received_at": "2026-08-08T10:00:00Z", "product_title": "tea", "batch_number": "x", "quantity": "2"},
        {"seq": 4, "received_at": "2026-08-08T10:00:00Z", "product_id": 1, "quantity": "zero"},
    ]
    folder = stock.StockFolder.start(work, seed.products, seed.product_batches)
    stream = feed(tmp_path, spark, schemas.RECEIPT_REQUEST, rows[:2], rows[2:])
    runs.each_batch(stream, work, folder.receive)
    whole = receipts.receive(
        spark.read.schema(schemas.RECEIPT_REQUEST).json(str(tmp_path / "in")), seed.products, seed.product_batches
    )
    key = ["id", "batch_number", "product_id", "available_qty", "purchase_price"]
    assert sorted(folder.batches(2).select(*key).collect()) == sorted(whole.batches.select(*key).collect())
    assert folder.all_of("ledger").count() == 3 and folder.all_of("rejects").count() == 1
    assert folder.products(2).count() == 6


def test_bill_stream_equals_batch_and_repeats_safely(spark, seed, tmp_path, work):
    def bill(seq, *items):
        return {
            "seq": seq, "received_at": "2026-08-08T10:00:00Z",
            "items": [{"product_id": p, "batch_id": b, "quantity": str(q)} for p, b, q in items],
        }

    rows = [bill(1, (1, 1, 10)), bill(2, (1, 1, 5), (2, 3, 1)), bill(3, (1, 1, 2)), bill(4, (2, 3, 40))]
    folder = stock.StockFolder.start(work, seed.products, seed.product_batches)
    runs.each_batch(feed(tmp_path, spark, schemas.BILL_REQUEST, rows[:2], rows[2:]), work, folder.issue)
    read = spark.read.schema(schemas.BILL_REQUEST).json(str(tmp_path / "in"))
    whole = bills.check_out(read, seed.products, seed.product_batches)
    want = bills.batches_after(seed.product_batches, whole.settled).select("id", "available_qty").collect()
    assert sorted(folder.batches(2).select("id", "available_qty").collect()) == sorted(want)
    booked = sorted(r.txn_number for r in folder.all_of("ledger").collect())
    assert booked == sorted(r.txn_number for r in whole.ledger.collect())
    # The last micro-batch again, as after a failure before its commit.
    folder.issue(read.filter(F.col("seq") > 2), 1)
    assert sorted(r.txn_number for r in folder.all_of("ledger").collect()) == booked
